"""Registered queries that SQL can't express, against plain code on the smallest tables."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
from corvane.functions import chunking
from corvane.functions import text as tx
from corvane.plans.queries import Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_outline_nodes(spark, texts):
    """Every line is a section: titles, levels and places follow from the lines alone."""
    got = {}
    for r in E.queries()["outline_nodes"](spark, SF).collect():
        got.setdefault(r["id"], []).append((r["char_start"], r["level"], r["title"], r["char_end"]))
    for i, t in texts.items():
        made = "# " + t.replace("\n", "\n\n## ")
        want, at = [], 0
        for line in made.split("\n"):
            if m := re.match(r"(#{1,2}) (.*)$", line, re.S):
                want.append([at, len(m[1]), re.sub(r"(^|\s+)#+\s*$", "", m[2]).strip()])
            at += len(line) + 1
        ends = [next((y[0] for y in want[k + 1 :] if y[1] <= x[1]), len(made)) for k, x in enumerate(want)]
        assert sorted(got[str(i)]) == sorted([(0, 0, "", len(made)), *((*x, e) for x, e in zip(want, ends, strict=True))])


def test_stemmed_search(spark, texts):
    """BM25 over stems, document by document."""
    docs = {i: [tx.stem(w) for w, _, _ in tx.tokenize(t)] for i, t in texts.items()}
    want = [tx.stem("thats"), tx.stem("oner")]
    avg = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for w in want}
    score = {}
    for i, d in docs.items():
        n = Counter(d)
        if all(n[w] for w in want):
            score[i] = sum(max(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for w in want)
    got = {r["id"]: r["score"] for r in E.queries()["fts_stemmed"](spark, SF).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - s) < 1e-9 for i, s in score.items())


def test_chunks_by_hand():
    text = "One two.\n\nThree four five. Six\nseven\n\nEight"
    assert [c[1:] for c in chunking.chunks(text, 16, 4)] == [(0, 8, "One two."), (10, 25, "Three four five"), (25, 30, ". Six"), (31, 36, "seven"), (38, 43, "Eight")]
    assert chunking.chunks("aaaaaaaaa a", 10, 2) == [(0, 0, 9, "aaaaaaaaa"), (1, 10, 11, "a")]
    assert [c[1:] for c in chunking.chunks("ab ab ab ab", 5, 2)] == [(0, 5, "ab ab"), (6, 8, "ab"), (9, 11, "ab")]
    assert [c[1:3] for c in chunking.chunks("aa bb cc dd ee", 9, 4)] == [(0, 8), (6, 14)]
    assert chunking.chunks(" " * 50, 10, 2) == [(0, 0, 50, " " * 50)]


def test_chunk_text(spark, texts):
    """Chunks are slices of at most 1,500 characters in order, which leave out white space only."""
    got = {}
    for r in E.queries()["chunk_text"](spark, SF).collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["start_index"], r["end_index"]))
    for i, t in texts.items():
        rows = sorted(got[str(i)])
        assert [x[0] for x in rows] == list(range(len(rows))) and (len(t) > 1500 or rows == [(0, 0, len(t))])
        assert all(z - a <= 1500 for _, a, z in rows) and all(b[1] > a[1] and b[2] > a[2] and a[2] - b[1] <= 150 for a, b in zip(rows, rows[1:], strict=False))
        covered = set().union(*(range(a, z) for _, a, z in rows))
        assert all(c in covered or t[c].isspace() for c in range(len(t)))


def test_quantized_search(spark):
    """The twenty nearest entries by estimate are mostly those by inner product."""
    v = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect():
        v.setdefault(r["vec_id"] // 10, []).append(float(np.dot(r["embedding"], Q)))
    exact = sorted(v, key=lambda i: -max(v[i]))[:20]
    got = [r["context_id"] for r in E.queries()["quantized_knn"](spark, SF).collect()]
    assert len(got) == min(20, len(v)) and len(set(got) & set(exact)) >= 0.8 * len(got)
