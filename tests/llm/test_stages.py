"""Every pipeline stage on nulls, empty texts, repeats, ties, clashing columns; and run() against the stages done by hand."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyhall.llm.tokens import WordEncoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, spans string, fp long, bin int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "ti", "on", "ing", "é", "ou", "la"]) for _ in range(r.randint(1, 4))) for _ in range(n))


A, B, PASSAGE = prose(1, 120), prose(2, 150), prose(3, 70)
ROWS = [
    (1, A), (1, A), (2, A), (1, B), (None, prose(4, 90)), (3, None), (4, ""), (5, " \n "), (6, "word"), (7, prose(5, 100) + " " + PASSAGE), (8, PASSAGE + "\n" + prose(6, 100)),
    (9, prose(7, 80) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (10, "$ # % | " * 60), (11, "same same same " * 40), (12, prose(8, 3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 1, 2) for i, t in ROWS], SCHEMA).repartition(3)


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_rules(spark, docs):
    out = P.quality_stage(spark, docs, "")
    kept = rows(out)
    assert out.columns == P.COLUMNS
    assert kept == sorted([(i, t) for i, t in ROWS if t and i not in (5, 6, 10, 11)], key=str)


def test_near_dedup(spark, docs):
    out = P.near_dedup_stage(spark, docs, "")
    kept = rows(out)
    assert out.columns == P.COLUMNS
    blank = [x for x in kept if not (x[1] or "").strip()]
    assert blank == [(3, None)]  # texts without words are one class
    assert [x for x in kept if x not in blank] == sorted({(1, A), (1, B), *((i, t) for i, t in ROWS if i not in (1, 2) and (t or "").strip())}, key=str)


def test_repeats(spark, docs):
    kept = rows(P.repeats_stage(spark, docs, ""))
    assert (3, None) in kept and (4, "") in kept and (5, " \n ") in kept and (6, "word") in kept
    assert (1, B) in kept and all(PASSAGE not in (t or "") for _, t in kept)
    # The three copies of A and the texts of one phrase lose everything, and go.
    assert sorted(i for i, _ in kept if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 12] and len(kept) == 10


def test_secrets(spark, docs):
    kept = rows(P.secrets_stage(spark, docs, ""))
    assert len(kept) == len(ROWS) and (3, None) in kept
    changed = [(i, t) for i, t in kept if (i, t) not in ROWS]
    assert changed == [(9, prose(7, 80) + ' token = "[SECRET]"')]


def test_packing(spark, docs):
    out = P.packing_stage(spark, docs, "").collect()
    encoder = WordEncoder.get(default_path("word_bpe_49k.json"))
    want = []
    for (i, _), ids in zip(ROWS, encoder._whole([t or "" for _, t in ROWS]), strict=True):
        ids += b"\x01\x00\x00\x00"
        want += [(i, k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[lo : lo + 4 * 4096] for lo in range(0, len(ids), 4 * 4096))]
    assert sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)


def test_stages_on_an_empty_table(spark, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run_applies_the_stages_in_their_order(spark, docs, tmp_path):
    sf = "file://" + str(tmp_path)
    docs.select(*P.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    by_hand = docs
    for _, stage in P.STAGES:
        by_hand = P.stash(stage(spark, by_hand, sf), "t")
    got = P.run(spark, sf)
    one = lambda df: sorted((tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert one(got) == one(by_hand)
    # Brute force over the whole: which documents are left, and how many tokens each has.
    left = {1: B, None: ROWS[4][1], 7: prose(5, 100) + " ", 8: "\n" + prose(6, 100), 9: prose(7, 80) + ' token = "[SECRET]"', 12: ROWS[-1][1]}
    encoder = WordEncoder.get(default_path("word_bpe_49k.json"))
    a = B if not any(r.doc_id == 1 and r.length == 0 for r in got.collect()) else ""
    tokens = {i: len(x) // 4 + 1 for (i, _), x in zip(left.items(), encoder._whole([*left.values()]), strict=True)}
    tokens[1] += len(encoder._whole([A])[0]) // 4 + 1 if a else 0  # A (of ids 1 and 2, one stays) and B share the id
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
