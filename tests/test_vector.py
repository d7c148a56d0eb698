"""Many nearest-neighbour searches against brute force."""

import os

import numpy as np
import pytest

import __spark_entry__ as E
from corvane.operators import vector

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        best: dict = {}
        for i, d in zip(ids, np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1)), strict=True):
            best[i] = min(d, best.get(i, np.inf))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_many_blocks(spark):
    v = np.random.default_rng(3).normal(size=(60, 4))
    c = spark.createDataFrame([(i // 3, v[i].tolist()) for i in range(60)], "context_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["context_id"] for r in vector.search_many(c, q, 5, block=7).collect()}
    want = brute([i // 3 for i in range(60)], v, range(60), 5)
    assert got == {(i, n): e for i, best in want.items() for n, (_, e) in enumerate(best, 1)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_twentieth_vector_is_a_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    assert ids == list(range(len(ids)))
    got: dict = {}
    for r in E.queries()["knn_many"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["distance"])
    want = brute([i // 10 for i in ids], v, [i for i in ids if i % 20 == 0], 5)
    assert got.keys() == want.keys() and all(np.allclose(got[q], [d for d, _ in want[q]], atol=2e-5) for q in want)
