"""Mixing to target weights by iterative proportional fitting.

Tokens are summed per cell of (source, language, topic). Raking scales the cells until
their marginals meet the targets. A document is kept with the probability min(1, c * weight of its
cell), where c is solved so that the expected tokens are `keep` of all: a rare cell that
lacks tokens is kept whole and falls short alone. The decision compares a hash of the id and
a seed with that probability; the threshold is then calibrated on the sums of tokens by
ratio of the two, so that the tokens kept meet the budget within the largest documents. It
doesn't depend on partitioning. marginals() reports the share asked, reached and lacking of each category.

What reaches the driver is bounded by the targets and STEPS: categories that a target
doesn't name fall into one, which keeps its present share; sums by ratio have at most 2 * STEPS + 1 rows.

Defined results: null and unnamed categories count as that rest; null or empty texts have no
tokens and take the probability of their cell (keep, if the cell is unknown);
repeated documents share one decision; an empty table stays empty; other columns pass through, and a
column named as one of those that are added is refused.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, refuse_clash

REST = "*"
#: Parts in which ratios of hash to probability are counted.
STEPS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by what a text contains: table, legal, contact or prose. Plain substring tests, as they cost far less than patterns."""

    def holds(t: Column, *words: str) -> Column:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out

    t = F.coalesce(text, F.lit(""))
    legal = [a + b for w in ("icense", "icence", "opyright", "arranty") for a, b in zip({"i": "Ll", "o": "Cc", "a": "Ww"}[w[0]], (w, w), strict=True)]
    return F.when(holds(t, " | "), "table").when(holds(t, *legal), "legal").when(holds(t, "@", "password", "http://", "https://"), "contact").otherwise("prose")


def rake(cells: Mapping[tuple, float], targets: Mapping[str, Mapping[str, float]], sweeps: int = 500, tolerance: float = 1e-13) -> dict[tuple, float]:
    """Weight of each cell, a tuple of categories in the order of targets, given its tokens; sweeps until no marginal share moves by more than tolerance."""
    keys = sorted(k for k, v in cells.items() if v > 0)
    if not keys:
        return {}
    n, w = np.array([float(cells[k]) for k in keys]), np.ones(len(keys))
    total = n.sum()
    dims = []
    for d, want in enumerate(targets.values()):
        names = sorted({k[d] for k in keys})
        at = np.array([names.index(k[d]) for k in keys])
        have = np.bincount(at, n, len(names)) / total
        rest = have[names.index(REST)] if REST in names and REST not in want else 0.0
        named = sum(want.get(c, 0.0) for c in names)
        share = np.array([have[i] if c == REST and REST not in want else (1 - rest) * want.get(c, 0.0) / named if named else have[i] for i, c in enumerate(names)])
        dims.append((at, share))
    for _ in range(sweeps):
        moved = 0.0
        for at, share in dims:
            now = np.bincount(at, n * w, len(share)) / total
            moved = max(moved, float(np.abs(share - now)[now > 0].max(initial=0.0)))
            w = w * np.divide(share, now, out=np.ones_like(now), where=now > 0)[at]
        if moved <= tolerance:
            break
    return dict(zip(keys, w.tolist(), strict=True))


def _named(target: Mapping[str, float]):
    return lambda c: F.when(c.isin(list(target)), c).otherwise(F.lit(REST))


def unit_hash(doc: Column, seed: str) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(doc.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def factor(n: np.ndarray, w: np.ndarray, budget: float) -> float:
    """The c with sum(n * min(1, c * w)) = budget; infinite if the budget takes everything."""
    order = np.argsort(-w, kind="stable")
    n, w = n[order], w[order]
    full, rest = np.concatenate([[0.0], np.cumsum(n)]), (n * w).sum() - np.concatenate([[0.0], np.cumsum(n * w)])
    for j in range(len(w)):  # the j heaviest cells are kept whole
        if rest[j] > 0 and budget > full[j] and (c := (budget - full[j]) / rest[j]) * w[j] <= 1:
            return float(c)
    return float("inf")


def mix(docs: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]], doc: str = "doc_id", text: str = "text", keep: float = 0.5, seed: str = "mix", sweeps: int = 500) -> DataFrame:
    """docs with mix_tokens, mix_weight, mix_prob and mix_kept; dims gives the column of each dimension of targets, keep the share of tokens wanted."""
    if not 0 < keep <= 1:
        raise ValueError("keep must lie in (0, 1]")
    names = [f"mix_dim{i}" for i in range(len(dims))]
    refuse_clash(docs, *names, "mix_tokens", "mix_weight", "mix_prob", "mix_kept")
    cats = [let(c, _named(targets[d])).alias(x) for x, (d, c) in zip(names, dims.items(), strict=True)]
    cells = docs.select(*cats, tokens(F.col(text)).alias("n")).groupBy(*names).agg(F.sum("n").alias("n")).collect()  # at most the product of the targets' sizes
    of = {tuple(r[k] for k in names): r["n"] for r in cells}
    weights = rake(of, {d: targets[d] for d in dims}, sweeps)
    budget = keep * sum(of.values())
    c = factor(np.array([float(of[k]) for k in weights]), np.array(list(weights.values())), budget)
    spark = docs.sparkSession
    known = spark.createDataFrame([(*k, w, min(1.0, c * w) if w else 0.0) for k, w in weights.items()], ", ".join(f"{x} string" for x in names) + ", mix_weight double, mix_prob double")
    out = docs.select("*", *cats, tokens(F.col(text)).alias("mix_tokens")).join(F.broadcast(known), names, "left").drop(*names)
    out = out.withColumn("mix_prob", F.coalesce("mix_prob", F.lit(keep)))
    ratio = unit_hash(F.col(doc), seed) / F.col("mix_prob")
    part = F.when(F.col("mix_prob") > 0, F.least(F.floor(ratio * STEPS), F.lit(2 * STEPS))).otherwise(F.lit(2 * STEPS))
    sums = out.groupBy(part.alias("b")).agg(F.sum("mix_tokens").alias("n")).collect()  # at most 2 * STEPS + 1 rows
    return out.withColumn("mix_kept", part <= _last_part({r["b"]: r["n"] for r in sums}, budget))


def _last_part(sums: Mapping[int, int], budget: float) -> int:
    """The part up to which documents are kept, so that their tokens are nearest to the budget; the first of equals."""
    best, at, total = None, STEPS - 1, 0
    for b in sorted(x for x in sums if x < 2 * STEPS):
        total += sums[b]
        if best is None or abs(total - budget) < best:
            best, at = abs(total - budget), b
    return at if sum(sums.values()) else STEPS - 1


def marginals(mixed: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]], keep: float = 0.5) -> DataFrame:
    """dimension, category, asked (share of the tokens kept that the targets give it), reached, lacking (tokens short of the budget's share)."""
    out = None
    for d, c in dims.items():
        whole = sum(targets[d].values())
        asked = F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, v / whole)])
        own = mixed.select(let(c, _named(targets[d])).alias("category"), "mix_tokens", "mix_kept").groupBy("category").agg(F.sum("mix_tokens").alias("n"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0)).alias("k"))
        sums = own.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.coalesce(F.sum(F.when(F.col("category") == REST, F.col("n"))), F.lit(0)).alias("rest"))
        own = own.crossJoin(F.broadcast(sums))  # one row
        share = F.when(F.col("category") == REST, F.col("rest") / F.col("all_n")).otherwise((1 - F.col("rest") / F.col("all_n")) * F.try_element_at(asked, F.col("category")))
        own = own.select(F.lit(d).alias("dimension"), "category", share.alias("asked"), F.try_divide(F.col("k"), F.col("all_k")).alias("reached"), F.greatest(F.lit(0.0), share * F.col("all_n") * keep - F.col("k")).alias("lacking"))
        out = own if out is None else out.unionAll(own)
    return out


#: The mixture that the registered query and the pipeline aim at.
TARGETS = {
    "source": {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)},
    "lang": {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14},
    "topic": {"prose": 0.85, "table": 0.05, "legal": 0.04, "contact": 0.06},
}


def document_dims() -> dict[str, Column]:
    """The dimensions of a documents table."""
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() over source, lang and topic of a documents table."""
    return mix(docs, document_dims(), TARGETS, **options)
