"""Near-dedup keeps one row of every class, also where ids repeat."""

from __future__ import annotations

import corpus_pipeline as P


def test_rows_that_share_an_id_keep_their_texts(spark):
    a, b, c = ("one two three four five six seven", "red green blue white black grey brown", "sun moon stars sky cloud rain snow")
    rows = [(15, a), (15, b), (15, b), (3, a), (None, c), (9, c), (None, "quite alone here with no id at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in P.near_dedup_stage(spark, docs, "").collect()), key=str)
    assert kept == sorted([(3, a), (15, b), (9, c), (None, "quite alone here with no id at all")], key=str)
