"""Each operator against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhall.llm import byte_bpe, dac, media_source, packing, quality_knn, quality_rules, secret_scan, simhash, suffix_dedup, toxicity
from tallyhall.llm.tokens import WordEncoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, rank int, kept string, spans string, bin int"


def _texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "ti", "on", "é", "ing", "ß"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(70), prose(300)
    near = base.split(" ")
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "One TWO"), (9, prose(120) + " " + passage + " " + prose(80)),
        (10, passage + "\n" + prose(60)), (11, "a" * 500), (12, "The the the " * 200), (13, prose(9000)), (14, "x\x1cy <|endoftext|> z    q"), (15, "日本語。 text!! it's  ok\n\n end "),
        (15, prose(40)), (None, prose(90)), (None, None), (1, base), (20, 'say token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962'),
        (21, "line\nline\nline\n" + prose(60)),
    ]
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7, 8, "k", "s", 9) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def expected(values):
    return sorted(map(str, values))


def test_simhash_against_brute_force(docs):
    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((ROWS[k][0] for k in range(len(ROWS)) if group[k] == g and ROWS[k][0] is not None), default=None) for g in set(group)}
    want = [(ROWS[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(ROWS))]
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected(want)


def test_simhash_large_shards_and_empty(spark, none):
    r = random.Random(1)
    fps = sorted({(0xABCDEF << 40) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(300)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        for x in fps:
            parent[x] = x
        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in fps]

    want = classes((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3)
    for tree in (8, 2048):
        got = [(row.src % 2**64, row.dst % 2**64) for row in simhash.links(df, tree=tree).collect()]
        assert classes(got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_bk_tree_follows_only_near_edges():
    r = np.random.default_rng(2)
    values = r.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xFFFF)
    tree = simhash.BKTree(values)
    found = {(tree.values[n], int(q)) for n, at in tree.search(values, 2) for q in values[at]}
    assert found == {(int(a), int(b)) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= 2}


def test_quality_rules(docs, none):
    def count(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(grams) < 2000 else None
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), None if again is None else len(again)

    got = quality_rules.judge(docs).collect()
    want = [(i, *count(t)) for i, t in ROWS]
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    short = lambda rows: expected(r[:6] for r in rows if r[1] < 2000)
    assert short([tuple(r[c] for c in cols) for r in got]) == short(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(none).count() == 0
    assert "Python" not in quality_rules.judge(docs)._jdf.queryExecution().toString()


def test_quality_rules_order_does_not_change_the_verdict(docs):
    counted = quality_rules.counts(docs.select("doc_id", "text"))
    asked = quality_rules.rules()
    a, b = (by_row(counted.withColumn("v", quality_rules.verdict(o)), "doc_id", "n_words", "v") for o in (asked, asked[::-1]))
    assert a == b
    text = counted.withColumn("kept", quality_rules.verdict(asked)).filter("kept")
    assert text.count() == sum("True" in x for x in a)  # a filter on the verdict isn't pushed into the counts


def brute_repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                hit[i : i + size] = b"\x01" * size
        out.append((len(b), sum(hit), sum(hit[i] and not (i and hit[i - 1]) for i in range(len(hit))), bytes(x for x, y in zip(b, hit, strict=True) if not y)))
    return out


def test_suffix_dedup(docs, none):
    want = [(i, n, k, s, hashlib.sha256(b).hexdigest()) for (i, _), (n, k, s, b) in zip(ROWS, brute_repeats([t for _, t in ROWS], 200), strict=True)]
    assert by_row(suffix_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected(want)
    out = suffix_dedup.remove_repeats(docs.withColumnRenamed("kept", "kept_").withColumnRenamed("spans", "removed_"))
    assert {"kept", "removed", "kept_", "_text"} <= set(out.columns)
    assert suffix_dedup.digest(none).count() == 0


@pytest.mark.parametrize("seed", [1, 4096])
def test_suffix_dedup_common_ranks_and_short_thresholds(spark, seed):
    r = random.Random(seed)
    passage = "".join(r.choice("abcd") for _ in range(60))
    rows = [(k, "".join(r.choice("abcd") for _ in range(r.randint(0, 80))) + passage[r.randint(0, 9) : r.randint(50, 60)] + "".join(r.choice("abcd") for _ in range(20))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, threshold=20, first=5)
    want = [(i, b) for (i, _), (_, _, _, b) in zip(rows, brute_repeats([t for _, t in rows], 20), strict=True)]
    assert sorted((x.doc_id, bytes(x.kept)) for x in got.collect()) == sorted(want)


def test_byte_bpe(docs, none):
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = []
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(byte_bpe.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)
    assert byte_bpe.encode_decode(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "   a", "a   b", "a \n b\n", "x\n\n y", "x\n  y", "\t y  ", "a\x1cb", "don't've ①② \xa0\xa0 x", "aaaa aaaaaaa", "a<|endoftext|><|endoftext|> b"])
def test_byte_bpe_white_space(text):
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    b = byte_bpe.ByteBPE.get(default_path("byte_bpe_50k.json"))
    ids = t.encode(text, add_special_tokens=False).ids
    assert b.encode([text]) == [ids] and b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def word_ids(text):
    return WordEncoder.get(default_path("word_bpe_49k.json"))._whole([text or ""])[0]


def test_word_encoder_equals_the_library():
    texts = [t or "" for _, t in ROWS] + ["It's THE.. ,. a.b! ΑΣ. İx. don't've", "é ́x", "'s 's. I'M.", "É. x.. .,", "x​y  z"]
    e = WordEncoder(default_path("word_bpe_49k.json"))
    assert e.by_word and e.encode(texts) == e._whole(texts)


def test_token_store(docs, none, tmp_path):
    want, start = [], 0
    rows = dac.read_tokens(dac.write_tokens(docs)).collect()
    sizes = {}
    for i, t in ROWS:
        ids = word_ids(t) + struct.pack("<I", 1)
        sizes.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and (r.n_tokens, r.ids_crc32) in sizes[r.doc_id]
        sizes[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
        want.append(r.doc_id)
    assert not any(sizes.values()) and want == sorted(want, key=lambda x: (x is not None, x or 0))
    assert dac.read_tokens(dac.write_tokens(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
def test_directly_addressable_codes(n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 2**31, n) >> r.integers(0, 31, n)).astype(np.uint32)
    f = dac.TokenFile(dac.dump([3, None], np.array([0, n // 2, n]), ids))
    assert [f.codes[i] for i in range(n)] == ids.tolist() and f.doc_ids == [3, None]
    for lo, hi in ((0, n), (n // 3, n // 2), (n, n)):
        assert (f.codes.slice(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(IndexError):
        f.codes[n]


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    pieces = []
    for i, t in ROWS:
        ids = word_ids(t) + struct.pack("<I", 1)
        pieces += [(i, k, k * 4096, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[a : a + 16384] for a in range(0, len(ids), 16384))]
    assert expected(tuple(r)[:5] for r in rows) == expected(pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) == -(-sum(p[3] for p in pieces) // 4096)
    assert packing.pack_documents(none).count() == 0


def test_packing_islands_and_levels(spark):
    r = random.Random(3)
    size = [r.randint(300, 1500) for _ in range(600)]
    df = spark.createDataFrame([(k, k, 0, 0, s, 0) for k, s in enumerate(size)], packing._PIECE)
    out = packing.pack(df, block_pieces=100, rounds=2).collect()
    assert sorted(x.uid for x in out) == list(range(600))
    assert len({x.sequence_id for x in out}) <= -(-sum(size) // 4096) + 4
    assert all(x.crossovers > 0 for x in out)  # no piece is placed by best fit alone


def test_crossover_closes_the_waste_of_first_orders():
    plain = bred_ = 0
    for seed in range(6):
        r = random.Random(seed)
        size = [r.randint(200, 1800) for _ in range(900)]
        best, bred = packing.evolve(size, 4096, seed)
        plain += len(packing.fit_all(sorted(range(len(size)), key=lambda i: -size[i]), size, 4096))
        bred_ += len(best)
        assert bred > 0 and sorted(i for x in best for i in x) == list(range(len(size))) and max(sum(size[i] for i in x) for x in best) <= 4096
    assert bred_ < plain  # fewer bins than best fit alone, largest first


def test_grouping_crossover_keeps_every_piece():
    r = random.Random(5)
    size = [r.randint(1, 60) for _ in range(200)]
    order = sorted(range(200), key=lambda i: -size[i])
    a, b = packing.fit_all(order, size, 100), packing.fit_all(list(range(200)), size, 100)
    child = packing.crossover(a, b, size, 100, r)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(size[i] for i in x) <= 100 for x in child)


def test_media(docs, none, spark, tmp_path):
    rows = media_source.media_features(docs).collect()
    want = []
    for i, t in ROWS:
        p = media_source.pad((t or "").encode())
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert expected(tuple(r)[:5] for r in rows) == expected(want)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media_source.media_features(none).count() == 0


def test_media_ranges_cover_every_member_once(docs, spark, tmp_path):
    media_source.register(spark)
    path = "file://" + str(tmp_path / "m")
    media_source.store(docs, path)
    for step in (1000, 10**9):
        got = spark.read.format("media_archive").option("rangeBytes", step).load(path)
        assert sorted(media_source.from_png(bytes(r.media)) for r in got.collect()) == sorted(media_source.pad((t or "").encode()) for _, t in ROWS)


def test_media_retries_one_member(tmp_path):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def open_input_file(self, path):
            self.calls += 1
            if self.calls < 3:
                raise OSError("gone")
            return open(path, "rb")

    (tmp_path / "a").write_bytes(b"__payload")
    fs = Flaky()
    assert media_source.MediaReader._payload(fs, str(tmp_path / "a"), 2, 7, zlib.crc32(b"payload")) == b"payload" and fs.calls == 3
    with pytest.raises(ValueError):
        media_source.MediaReader._payload(fs, str(tmp_path / "a"), 0, 7, 1)


def test_png_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 3):
        p = media_source.pad(data)
        assert len(p) % 64 == 0 and len(p) and media_source.from_png(media_source.to_png(p)) == p


def test_secret_forest_on_held_out_findings():
    found = secret_scan.labelled_findings(2000, seed=1)
    scanner = secret_scan.Scanner.train(found[:1500])
    hits = [any(s and a < hi and lo < b for a, b, _, _, s in scanner.scan(t)) == bool(y) for t, lo, hi, y in found[1500:]]
    assert np.mean(hits) > 0.95


def test_secret_scan(docs, none):
    rows = secret_scan.findings(docs).collect()
    mine = [r for r in rows if r.doc_id == 20]
    assert [(r.start, r.length, r.is_secret) for r in sorted(mine, key=lambda r: r.start)] == [(13, 40, True), (66, 40, False)]
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 20").first().text.startswith('say token = "[SECRET]" and commit 04')
    assert out.filter("text IS NULL").count() == 2 and secret_scan.findings(none).count() == 0


def test_classifiers_on_held_out_rows(spark, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for op, label, folds, fold, least in ((quality_knn, "quality", 5, 0, 0.9), (toxicity, "toxic", 3, 1, 0.8)):
        out = op.classify(docs, labels)
        got = out.join(labels, "doc_id").filter("held_out").toPandas()
        assert set(got["held_out"]) == {True} and all(zlib.crc32(str(i).encode()) % folds == fold for i in got["doc_id"])
        assert (got["predicted"] == got[label]).mean() > least and got["score"].between(0, 1).all()
        assert out.count() == docs.count()


def test_classifiers_edges(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    for op in (quality_knn, toxicity):
        assert op.classify(docs, labels).filter("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
        assert op.classify(docs, labels.limit(0)).count() == len(ROWS)
        assert op.classify(none, labels).count() == 0


def test_hidden_words_are_restored(spark):
    text = "the idiot is stupid and worthless, a loser and a moron said the clown to the trash " * 50
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    d = toxicity.Decoder(toxicity.language_model(toxicity.corpus_counts(df)))
    assert [toxicity.restore_token(w, d) for w in ("1d10t", "m0r0n", "tr@sh", "stuuuupid", "s.t.u.p.i.d", "the", "3.14")] == ["idiot", "moron", "trash", "stupid", "stupid", "the", "3.14"]
    assert "stupid" in toxicity.restore("a s t u p i d plan", d)
