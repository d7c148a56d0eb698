"""Raking and sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing


def test_marginals():
    rng = np.random.default_rng(3)
    targets = {"a": {"x": 0.7, "y": 0.3}, "b": {"p": 0.2, "q": 0.5, "r": 0.3}}
    cells = {(i, j): float(rng.integers(5, 500)) for i in "xy" for j in "pqr"}
    w = mixing.rake(cells, targets, 60)
    total = sum(cells.values())
    for d, (_, want) in enumerate(targets.items()):
        for c, share in want.items():
            assert abs(sum(n * w[k] for k, n in cells.items() if k[d] == c) / total - share) < 1e-6
    assert mixing.rake({}, targets) == {} and mixing.rake({("x", "p"): 0.0}, targets) == {}
    rest = mixing.rake({("x", "p"): 50.0, (mixing.REST, "p"): 50.0}, {"a": {"x": 1.0}, "b": {"p": 1.0}})
    assert abs(rest[("x", "p")] - 1) < 1e-9 and abs(rest[(mixing.REST, "p")] - 1) < 1e-9


def test_sample(spark):
    rows = [(i, f"src{i % 3}" if i % 50 else None, "en" if i % 4 else "de", ("a | b " if i % 10 == 0 else "word ") * 20, 1) for i in range(6000)] + [(7000, "src1", "en", None, 1), (7001, "src1", "xx", "", 1), (1, "src1", "en", "word " * 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n int")
    targets = {"source": {"src0": 0.5, "src1": 0.25, "src2": 0.25}, "lang": {"en": 0.5, "de": 0.5}}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.mix(docs, dims, targets, keep=0.25).persist()
    assert out.count() == len(rows) and out.filter("mix_kept is null").count() == 0
    total, kept = out.agg(F.sum("mix_tokens"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")))).first()
    assert abs(kept / total - 0.25) < 0.01
    for r in mixing.marginals(out, dims, targets, keep=0.25).collect():
        assert abs(r["asked"] - r["reached"]) < 0.03 and r["lacking"] < 0.02 * total  # 3,000 documents are drawn
    assert out.filter("doc_id = 1").select("mix_kept").distinct().count() == 1
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        mixing.mix_documents(docs.withColumn("mix_prob", F.lit(1)))


def test_rare_cell_falls_short_alone(spark):
    """A cell whose weight would set the scale is kept whole; the budget is met by the others."""
    rows = [(i, "a", "word " * 10) for i in range(4000)] + [(10_000 + i, "b", "word " * 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    dims, targets = {"source": F.col("source")}, {"source": {"a": 0.5, "b": 0.5}}
    out = mixing.mix(docs, dims, targets, keep=0.3).persist()
    assert out.filter("source = 'b' and mix_kept").count() == 20 and out.filter("source = 'b'").select("mix_prob").distinct().first()[0] == 1.0
    assert abs(out.filter("mix_kept").count() / 4020 - 0.3) < 0.01
    lacking = {r["category"]: r["lacking"] for r in mixing.marginals(out, dims, targets, keep=0.3).collect()}
    assert lacking["a"] == 0 and 5000 < lacking["b"] < 6200
    assert mixing.mix(docs, dims, targets, keep=1.0).filter("mix_kept").count() == 4020


def test_factor():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, w = rng.integers(1, 100, 12).astype(float), rng.choice([0.0, 0.1, 1.0, 1.0, 30.0], 12)
        budget = n.sum() * rng.random() * 0.9
        c = mixing.factor(n, w, budget)
        if np.isfinite(c):
            assert abs((n * np.minimum(1, c * w)).sum() - budget) < 1e-6
        else:
            assert n[w > 0].sum() <= budget + 1e-6
