"""Removal of repeats across segment borders, in periodic texts, among many copies and shared edges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyhall.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(texts: list[str], size: int) -> list[bytes]:
    data = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in data:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                hit[i : i + size] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~hit]))
    return out


def held(spark, texts, **how):
    rows = S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), **how).collect()
    return [bytes(r.kept) for r in sorted(rows, key=lambda r: r.doc_id)]


def words(r, n, kinds="abcdefgh"):
    return "".join(r.choice(kinds) for _ in range(n))


def test_near_copies_and_shared_passages(spark):
    r = random.Random(2)
    base, passage = words(r, 900), words(r, 260)
    texts = [base]
    for _ in range(12):  # one or two bytes changed anywhere
        t = list(base)
        for k in r.sample(range(len(t)), r.randint(1, 2)):
            t[k] = "Z"
        texts.append("".join(t))
    texts += [words(r, r.randint(0, 300)) + passage[r.randint(0, 70) : r.randint(190, 260)] + words(r, r.randint(0, 300)) for _ in range(25)]
    texts += [base[:450], base[300:], passage, passage]
    assert held(spark, texts) == brute(texts, 200)


def test_periodic_texts(spark):
    r = random.Random(3)
    unit = words(r, 37)
    texts = ["a" * 199, "a" * 200, "ab" * 300, unit * 20, (unit * 20)[5:], unit * 6 + "x" + unit * 6, words(r, 300) * 2, "b" * 1000 + "c" + "b" * 1000]
    assert held(spark, texts) == brute(texts, 200)


def test_segments_meet(spark, monkeypatch):
    r = random.Random(4)
    whole = words(r, 3 * S._SEGMENT)
    cut = S._SEGMENT
    texts = [whole, whole[cut - 300 : cut + 300], words(r, 50) + whole[2 * cut - 100 : 2 * cut + 101]]
    kept = held(spark, texts)
    assert kept[1] == b"" and kept[2] == texts[2][:50].encode()
    assert kept[0] == (whole[: cut - 300] + whole[cut + 300 : 2 * cut - 100] + whole[2 * cut + 101 :]).encode()


def test_repeated_rows_and_copies(spark):
    r = random.Random(5)
    a, b = words(r, 500), words(r, 500)
    rows = [(1, a)] * 40 + [(k, b) for k in range(40)] + [(None, b[:250] + "q" + a[:210]), (None, None), (7, "")]
    out = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert sorted(bytes(x.kept) for x in out if x.kept) == [b"q"] and sum(x.kept == b"" for x in out) == len(rows) - 1
    assert all([(s.lo, s.hi) for s in x.removed] == [(0, 500)] for x in out if x.text and len(x.text) == 500)


@pytest.mark.parametrize("seed", range(3))
def test_short_thresholds(spark, seed):
    r = random.Random(seed)
    texts = [words(r, r.randint(0, 60), "ab") for _ in range(40)]
    assert held(spark, texts, threshold=12, first=3, size=2) == brute(texts, 12)


def test_thresholds_that_do_not_double():
    with pytest.raises(ValueError):
        S.repeated_spans(None, threshold=150, first=50)
