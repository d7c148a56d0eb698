"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, accents and digit or sign
substitutions to plain letters and everything else to spaces, so a lexicon
entry matches however it is disguised. Entries begin at a word's start; those that end in a
space are whole words, the others stems. The weights are log odds learned from at
most max_rows labelled rows (lowest hash of the id), added to a small seed list.
A document's weighted matches, without those inside exception phrases, are
normalised by its length and calibrated by a logistic fit on rows that the
lexicon of the other half did not see.

Defined results: null text counts as empty and gets the score of no match;
repeated documents score alike; null labels are ignored; without labelled rows
the seed list and a fixed calibration are used; an empty table stays empty; other columns pass through, and
one named as the result is refused.
"""

from __future__ import annotations

import dataclasses
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, refuse_clash, scratch

#: Insults that count even before anything is learned.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "not stupid", "no idiot", "sore loser")
#: Letters of other scripts and signs that look like the letters below them.
LOOK_ALIKES = {
    "а": "a", "б": "b", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɡ": "g", "ı": "i", "ß": "s", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i",
}


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in range(0x250):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch.lower())[0]
        out[c] = base if base.isalpha() and base.isascii() else ch.lower() if ch.isalpha() else " "
    out |= {ord(a): b for a, b in LOOK_ALIKES.items()}
    return out


class _Fold(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[0].lower()
        v = self[c] = base if base.isalpha() else "" if unicodedata.category(ch) in ("Mn", "Cf") else " "
        return v


FOLD = _Fold(_table())


def fold(text: str | None) -> str:
    """Folded text between single outer spaces; l and i fold together, as 1 stands for both."""
    return f" {(text or '').lower().translate(FOLD).replace('l', 'i')} "


def seeds() -> dict[str, float]:
    return {f" {fold(s).strip()}": 4.0 for s in SEEDS}


@dataclasses.dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slopes: tuple[float, ...] = (2.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        for k in self.exceptions:
            a.add_word(f"{fold(k)}", (len(fold(k)), None))
        a.make_automaton()
        return a


def matches(auto, folded: str) -> tuple[float, int]:
    """Summed weight and number of the words matched, each by its heaviest entry."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in auto.iter(folded):
        at = end - n + 1
        if w is None:
            spared.append((at, end))
        elif w > best.get(at, 0.0):
            best[at] = w
    if spared and best:
        merged: list[list[int]] = []
        for a, z in sorted(spared):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        starts = [a for a, _ in merged]
        best = {k: v for k, v in best.items() if not ((i := bisect_right(starts, k)) and k < merged[i - 1][1])}
    return sum(best.values()), len(best)


def measures(auto, text: str | None) -> tuple[float, float]:
    """What the calibration reads: match weight, and that weight per length."""
    f = fold(text)
    total, _ = matches(auto, f) if len(auto) else (0.0, 0)
    words = f.count(" ") + 1
    return np.log1p(total), total / np.sqrt(words + 20.0)


def entries_of(text: str | None, shortest: int = 4, longest: int = 8) -> set[str]:
    """Lexicon candidates of a text: stems and whole words, each after a space."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= shortest:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def _odds(rows: DataFrame, n_bad: int, n_good: int, floor: float, least: int = 3) -> dict[str, tuple[float, int]]:
    """Smoothed log odds, and number of bad texts, of each candidate that reaches floor and occurs in `least` bad texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found.update((e, y) for e in entries_of(t))
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["e", "y", "n"])

    sums = rows.mapInArrow(run, "e string, y int, n long").groupBy("e").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "bad"), (0, "good"))])
    odds = F.ln((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.ln((F.col("good") + 0.5) / (n_good + 1.0))
    return {r["e"]: (r["o"], r["bad"]) for r in sums.filter(F.col("bad") >= least).select("e", "bad", odds.alias("o")).filter(F.col("o") >= floor).toLocalIterator()}


def learn(rows: DataFrame, n_bad: int, n_good: int, floor: float = 3.0) -> dict[str, float]:
    """Weights of the entries whose smoothed log odds reach floor, longer ones left out that tell little more than a stem of theirs.

    rows is the bounded sample of fit(), which bounds the entries too.
    """
    weights = seeds()
    if not n_bad or not n_good:
        return weights
    odds = _odds(rows, n_bad, n_good, floor)
    for e, (o, n) in odds.items():
        stems = [odds[e[:k]] for k in range(5, len(e)) if e[:k] in odds]
        if not stems or (n < 0.9 * max(x[1] for x in stems) and o > max(x[0] for x in stems) + 1.0):
            weights[e] = max(weights.get(e, 0.0), o)
    return weights


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None, max_rows: int = 12_000) -> Lexicon:
    """Learn weights and calibration from the labelled rows that satisfy train, at most max_rows of them."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, doc, text, label, train, max_rows)


def _fit(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, train: Column | None, max_rows: int) -> Lexicon:
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull())
    if train is not None:
        known = known.filter(train)
    rows = known.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y")).withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(max_rows).collect()
    start = Lexicon(seeds())
    if not rows:
        return start
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "id long, y int, h long"))
    sample = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(picked, "id").groupBy("text", "y").agg(F.min("h").alias("h"))
    sample = materialize(sample.select("text", "y", F.pmod("h", F.lit(2)).alias("half")))
    n = {(r["half"], r["y"]): r["n"] for r in sample.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    xs, ys = [], []
    for half in (0, 1):
        auto_of = Lexicon(learn(sample.filter(F.col("half") != half), n.get((1 - half, 1), 0), n.get((1 - half, 0), 0)))

        def run(batches: Iterator[pa.RecordBatch], lex=auto_of) -> Iterator[pa.RecordBatch]:
            auto = lex.automaton()
            for b in batches:
                m = np.array([measures(auto, t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1]), b.column("y")], names=["a", "b", "y"])

        for r in sample.filter(F.col("half") == half).mapInArrow(run, "a double, b double, y int").toLocalIterator():  # at most max_rows
            xs.append((r["a"], r["b"]))
            ys.append(float(r["y"]))
    weights = learn(sample, n.get((0, 1), 0) + n.get((1, 1), 0), n.get((0, 0), 0) + n.get((1, 0), 0))
    if len(set(ys)) < 2:
        return dataclasses.replace(start, weights=weights)
    coef = logistic(np.array(xs), np.array(ys))
    return Lexicon(weights, bias=float(coef[0]), slopes=tuple(map(float, coef[1:])))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - penalty * w), -2, 2)
    return w


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column of the probability of being toxic."""
    refuse_clash(docs, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b in batches:
            m = np.array([measures(auto, t) for t in b.column(text).to_pylist()], np.float64).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(lexicon.bias + m @ np.array(lexicon.slopes), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
