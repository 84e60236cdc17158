"""The pipeline's stages on a small table, each against its operator's rule."""

from __future__ import annotations

import corpus_pipeline as P
from tallyhall.llm import quality_rules, secret_scan, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = P.documents(spark, SF)
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    q = P.stash(P.quality_stage(spark, docs, SF), "t")
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in q.collect()} == kept and q.columns == P.COLUMNS
    n = P.stash(P.near_dedup_stage(spark, q, SF), "t")
    assert {r.doc_id for r in n.collect()} == {r.component_id for r in simhash.near_duplicates(q).collect()}
    s = P.stash(P.repeats_stage(spark, n, SF), "t")
    cut = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(n).collect()}
    got = {r.doc_id: r.text for r in s.collect()}
    assert got == {k: v.decode("utf-8", "ignore") for k, v in cut.items() if v or not n.filter(f"doc_id = {k}").first().text}
    t = P.stash(P.secrets_stage(spark, s, SF), "t")
    scanner = secret_scan.Scanner.train(secret_scan.labelled_findings())
    assert {r.doc_id: r.text for r in t.collect()} == {k: scanner.redact(v) for k, v in got.items()}
    out = P.packing_stage(spark, t, SF).collect()
    assert {r.doc_id for r in out} == set(got)


def test_run_and_empty_table(spark):
    docs = P.documents(spark, SF).limit(0)
    for _, stage in P.STAGES:
        docs = P.stash(stage(spark, docs, SF), "t")
    assert docs.count() == 0
