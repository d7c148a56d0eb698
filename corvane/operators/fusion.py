"""Reciprocal rank fusion, reranking and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..schema import RANK_DEPTH

OVERFETCH_LIMIT = 20_000


def leg(hits: DataFrame, order: list[Column], depth: int) -> DataFrame:
    """The first `depth` hits with their rank from 1; the window sees only these."""
    top = hits.orderBy(*order).limit(min(depth, OVERFETCH_LIMIT))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(fts: DataFrame, semantic: DataFrame, k: int = 60, doc: str = "id") -> DataFrame:
    """Fuse two ranked legs (id, rank, and score or distance): sum of 1 / (k + rank)."""
    if not 1 <= k <= 1000:
        raise ValueError("k must lie in 1..1000")
    f = fts.filter(F.col(doc).isNotNull()).select(doc, F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score"))
    s = semantic.filter(F.col(doc).isNotNull()).select(doc, F.col("rank").alias("semantic_rank"), F.col("distance").alias("semantic_distance"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return f.join(s, doc, "full_outer").withColumn("rrf", part("fts_rank") + part("semantic_rank")).select(doc, "rrf", "fts_rank", "semantic_rank", "fts_score", "semantic_distance")


def best_first(doc: str = "id") -> list[Column]:
    return [F.desc("rrf"), F.asc(doc)]


def overlap(fused: DataFrame) -> DataFrame:
    both = F.col("fts_rank").isNotNull() & F.col("semantic_rank").isNotNull()
    return fused.agg(F.count_if(F.col("fts_rank").isNotNull()).alias("fts_count"), F.count_if(F.col("semantic_rank").isNotNull()).alias("semantic_count"), F.count_if(both).alias("overlap"), F.count("*").alias("total"))


def lexical_scorer(query: str) -> Callable[[str], float]:
    """A deterministic stand-in for a cross-encoder: share of query words in the passage, by length."""
    want = {t for t, _, _ in tokenize(query)}

    def score(text: str) -> float:
        have = [t for t, _, _ in tokenize(text or "")]
        return len(want & set(have)) / max(1, len(want)) + sum(t in want for t in have) / (10.0 + len(have))

    return score


def rerank(rows: DataFrame, passage: Column, scorer: Callable[[str], float], rank: str = "rank") -> DataFrame:
    """rows (at most the ranked depth) by the scorer, ties by the former rank; a scorer that fails leaves the order."""

    def run(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in col:
            try:
                yield s.map(scorer).astype(float)
            except Exception:  # noqa: BLE001 - the scorer is the caller's
                yield pd.Series([None] * len(s), dtype="float64")

    scored = rows.withColumn("rerank_score", F.pandas_udf(run, "double")(passage))
    return scored.orderBy(F.desc_nulls_last("rerank_score"), F.asc(rank))


def fetched(make: Callable[[], DataFrame], order: list[Column], depth: int) -> tuple[DataFrame | None, str | None]:
    """The leg that make() gives, run on its own, as rows of at most the depth; or None and why it failed."""
    try:
        hits = make()
        top = leg(hits, order, depth)
        return hits.sparkSession.createDataFrame(top.collect(), top.schema), None  # at most OVERFETCH_LIMIT rows
    except Exception as e:  # noqa: BLE001 - whatever a leg fails with, the other one may answer
        return None, str(e).strip().split("\n")[0] or type(e).__name__


def together(legs: dict[str, tuple[Callable[[], DataFrame], list[Column]]], depth: int) -> dict[str, tuple[DataFrame | None, str | None]]:
    """Each leg fetched in a thread of its own, so that Spark runs their jobs side by side."""
    with ThreadPoolExecutor(len(legs) or 1) as pool:
        return dict(zip(legs, pool.map(lambda x: fetched(*x, depth), legs.values()), strict=True))


def hybrid(fts: DataFrame | None, semantic: DataFrame | None, k: int = 60, overfetch: int = 2, doc: str = "id", why: dict[str, str] | None = None) -> dict:
    """Both legs fused to the ranked depth; one missing leg gives a warning, two an error, with the reasons in why."""
    why = why or {}
    if fts is None and semantic is None:
        return {"rows": None, "error": "both searches failed" + "".join(f"; {n}: {w}" for n, w in why.items())}
    some = fts if fts is not None else semantic
    depth = min(RANK_DEPTH * overfetch, OVERFETCH_LIMIT)
    empty = lambda c: some.select(doc).limit(0).withColumn("rank", F.lit(None).cast("int")).withColumn(c, F.lit(None).cast("double"))
    f = leg(fts, [F.desc("score"), F.desc(doc)], depth) if fts is not None else empty("score")
    s = leg(semantic, [F.asc("distance"), F.asc(doc)], depth) if semantic is not None else empty("distance")
    out = {"rows": rrf(f, s, k, doc).orderBy(*best_first(doc)).limit(RANK_DEPTH), "search_modes_used": [n for n, x in (("fts", fts), ("semantic", semantic)) if x is not None]}
    if fts is None or semantic is None:
        lost = "fts" if fts is None else "semantic"
        out["warnings"] = [f"{'full-text' if fts is None else 'semantic'} search failed" + (f" ({why[lost]})" if lost in why else "") + "; results of the other only"]
    return out
