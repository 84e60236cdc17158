"""The nearest-neighbour vote against plain loops over all pairs, and the corpus statistics against plain counts."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallyhall.llm import quality_knn as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_equal_a_vote_over_all_pairs(tables):
    docs, labels = tables
    m = Q.train(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    for r in rows:
        counts = Q.terms(r.text or "")
        v = [math.log1p(c) * w for c, w in zip(counts.tolist(), m.idf.tolist(), strict=True)]
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        latent = (np.array(v) / size) @ m.project.astype(np.float64)
        latent /= math.sqrt(float((latent**2).sum())) or 1.0
        near = sorted(((float(a @ latent), float(y)) for a, y in zip(m.vectors.astype(np.float64), m.labels, strict=True)), reverse=True)[: Q.NEIGHBOURS]
        weight = [math.exp(Q.SHARPNESS * (s - near[0][0])) for s, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[r.doc_id] - want) < 2e-3, (r.doc_id, got[r.doc_id], want)


def test_document_frequencies_cover_every_row(tables):
    docs, _ = tables
    n, df = Q.document_frequencies(docs)
    have = np.stack([Q.terms(r.text or "") for r in docs.collect()]) > 0
    assert n == len(have) and (df == have.sum(0)).all()


def test_latent_space_is_that_of_the_leading_singular_vectors(tables):
    docs, labels = tables
    r = np.random.default_rng(1)
    counts = r.poisson(0.05, (120, Q.TERMS)).astype(np.float32)
    counts[:60, :40] += 6
    counts[60:, 40:80] += 6
    m = Q.fit(counts, np.repeat([0, 1], 60), len(counts), (counts > 0).sum(0), dimensions=2)
    a = np.log1p(counts) * m.idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    top = np.linalg.svd(a, full_matrices=False)[2][:2]
    assert np.allclose(np.linalg.svd(top @ m.project)[1], 1, atol=1e-2)
