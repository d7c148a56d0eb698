"""Quality classifier: random Fourier features over document statistics.

A document becomes a fixed vector of statistics of its whole text. Cosines of
random projections approximate a Gaussian kernel; every partition sums its part of the
normal equations (per fold), the driver solves the ridge systems, and isotonic
regression over out-of-fold scores turns raw scores into probabilities.

Fitting uses at most max_rows labelled rows, those with the lowest hash of the
id; scoring covers every document. What reaches the driver is bounded by
max_rows, the number of features and fit_parts.

A score is interpolated between the means of the isotonic blocks, and 0.2 % of it is the raw score, so
that documents within a block keep an order. Which signs are counted is fixed by hand, what they mean is learned.

Defined results: null text counts as empty and is scored like any text; repeated
documents are scored alike; labels that are null are ignored; with no labelled rows, or
labels of one class only, every score is that class's mean (0.5 without rows); an empty table stays empty;
other columns of the input pass through score() unchanged, and one named as its result is refused.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, refuse_clash

#: Byte classes counted: upper, lower, digit, white space, beyond ASCII, then single signs.
SIGNS = b"!|%&$#*.,?-:;()=@/_\"'"
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _c = bytes([_i])
    _CLASS[_i] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _i > 127 else 6 + SIGNS.index(_c) if _c in SIGNS else 0
N_CLASS = 6 + len(SIGNS)
N_STATS = N_CLASS + 14


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all zero for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CLASS)[:N_CLASS] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = set(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    line_kinds = set(lines)
    twice = sum(map(len, lines)) - sum(map(len, line_kinds))
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    counts = np.bincount(at)
    stuck = float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0
    ends = sum(w[-1] in b"!|%&$#*" for w in words) / n
    return [
        *share.tolist(), np.log1p(n), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float(lengths.max() > 40), np.log(len(kinds)) / np.log(n + 1.0),
        len(kinds) / n, pairs / max(1, n - 1), stuck, float(counts.max()) / n, twice / len(raw), 1 - len(line_kinds) / max(1, len(lines)), ends, float((lengths <= 2).mean()),
    ]


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    proj: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def basis(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.proj + self.phase)
        return np.hstack([np.ones((len(z), 1)), z])

    def predict(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.values[0])
        raw = self.basis(stats) @ self.weights
        # the small share of the raw score orders the documents within a step of the isotonic fit
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 * np.clip(raw, 0, 1), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of the blocks, in order of x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _stats_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(name).to_pylist()], np.float64).reshape(-1, N_STATS)


def fit(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", train: Column | None = None,
    max_rows: int = 20_000, features: int = 192, width: float = 4.0, ridge: float = 1e-2, folds: int = 5, fit_parts: int = 6, seed: int = 7,
) -> Model:
    """Fit on the labelled rows that satisfy train (a condition on the labels table)."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull())
    if train is not None:
        known = known.filter(train)
    known = known.select(F.col(doc).alias("_id"), F.col(label).cast("double").alias("_y")).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_y").limit(max_rows)
    rows = known.collect()  # at most max_rows ids and labels
    constant = lambda v: Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 0)), np.zeros(0), np.zeros(0), np.zeros(1), np.array([v]))
    if not rows:
        return constant(0.5)
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "_id long, _y double, _h long"))
    sample = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).join(picked, "_id").select("_text", "_y", F.pmod("_h", F.lit(folds)).cast("int").alias("_fold"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats_column(b, "_text").astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), N_STATS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([flat, b.column("_y"), b.column("_fold")], names=["s", "y", "fold"])

    paths: list[str] = []
    made = materialize(sample.mapInArrow(stats, "s array<float>, y double, fold int"), paths).coalesce(fit_parts)
    agg = made.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(F.get("s", F.lit(i))).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.get("s", F.lit(i))).alias(f"d{i}") for i in range(N_STATS)]).first()
    if not agg["n"] or agg["y"] in (0.0, 1.0):
        discard(spark, paths)
        return constant(agg["y"] if agg["n"] else 0.5)
    rng = np.random.default_rng(seed)
    scale = np.array([agg[f"d{i}"] for i in range(N_STATS)])
    model = Model(np.array([agg[f"m{i}"] for i in range(N_STATS)]), np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
    dim = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, dim, dim + 1))
        for b in batches:
            z = model.basis(_matrix(b))
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            for f in range(folds):
                total[f] += z[fold == f].T @ np.hstack([z, y[:, None]])[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "m"])

    eq = np.zeros((folds, dim, dim + 1))
    for r in made.mapInArrow(sums, "fold int, m binary").toLocalIterator():
        eq[r["fold"]] += np.frombuffer(r["m"]).reshape(dim, dim + 1)
    solve = lambda m: np.linalg.solve(m[:, :-1] + ridge * m[0, 0] / dim * np.eye(dim), m[:, -1])
    outer = np.array([solve(eq.sum(0) - eq[f]) if (eq.sum(0) - eq[f])[0, 0] else np.zeros(dim) for f in range(folds)])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (model.basis(_matrix(b)) * outer[b.column("fold").to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("y")], names=["raw", "y"])

    bins = made.mapInArrow(held, "raw double, y double").groupBy(F.round("raw", 4).alias("x")).agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()  # at most max_rows
    knots, values = isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("x", "y", "n")))
    discard(spark, paths)
    return dataclasses.replace(model, weights=solve(eq.sum(0)), knots=knots, values=values)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    c = b.column("s")
    return c.flatten().to_numpy().astype(np.float64).reshape(len(c), N_STATS)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column of the model's probability of label 1."""
    refuse_clash(docs, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.predict(_stats_column(b, text)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def held_out(doc: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == fold, F.lit(False))
