"""Spelling variants of a corpus's words, grouped without pairs of words.

1. Words are counted over whole texts, before anything is dealt out by word.
2. Distinct words are numbered in one order, by falling count and then by code points. A smaller number
   is a better word, so the best of several words is a minimum of numbers, and no word travels twice.
3. Two words of one length are near if they meet in a wildcard group (position, prefix, suffix). A word is near one that
   is longer by a code point if it is what is left of that by deleting one. Both keys are the word without one position, so
   each word sends a row for each of its positions, to where the key lives, and one for itself.
4. A wildcard group keeps its size and its two best words, which tell each member how many others there are and
   which is the best of these. Deletions meet the vocabulary in the same place: one row of a run of equal letters
   stands for the deletion of any of them.
5. Each word sums counts and takes the least number over its positions. Pairs are never made.
6. Forms lead to words that are at least `ratio` times as frequent, so chains are short and end; roots are
   found by doubling steps as often as the largest count allows.

Keys are two independent 64-bit sums of mixed (position, code point) pairs, so a word's keys cost one pass over it, whatever its
length; two different keys are taken for one with a probability of about 2^-128 a pair. A group has at most as many members as the
alphabet has letters, and a key as many times that as the word has positions: no word, however frequent, makes a group large.

Defined results: null and empty texts have no words; a null id counts as an empty string in the hash; repeated
rows count again; words may be of any length; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch
from .superminhash import U, mix

LETTERS = "A-Za-zÀ-ÿ"
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of the texts and how often they occur.

    A run of letters loses one code point where the crc32 of id and run is a multiple of `every`, which stands for a slip of the pen.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w")).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = F.pmod("h", F.length("w")).cast("int")
    slip = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    kept = each.select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("w")).alias("word")).filter(F.length("word") >= least_chars)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _keys(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For all positions of all texts, one after another: text index, position, whether it begins a run of equal letters,
    and the keys without it; then the keys of the whole texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(len(codes)) - starts[of]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (pos[1:] == 0)
    parts, whole = [], []
    with np.errstate(over="ignore"):
        at = pos.astype(U) << U(32)
        for seed in _SEEDS:
            here, before = mix(mix((at | codes) + seed)), mix(mix((at - (U(1) << U(32)) | codes) + seed))
            to, shifted = np.concatenate([[U(0)], np.cumsum(here)]), np.concatenate([[U(0)], np.cumsum(before)])
            ends = starts + sizes
            parts.append((to[:-1] - to[starts][of] + shifted[ends][of] - shifted[1:]).view(np.int64))
            whole.append((to[ends] - to[starts]).view(np.int64))
    return of, pos, first, *parts, *whole


def _rows(vocabulary: DataFrame) -> DataFrame:
    """Rows (a, b, at, first, rank): a word's keys without each position, and its own with position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "at", "first", "rank"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                texts, ranks = batch.column("word").to_pylist(), batch.column("rank").to_numpy()
                of, pos, first, a, b, wa, wb = _keys(texts)
                n = len(ranks)
                yield pa.RecordBatch.from_arrays([pa.array(wa), pa.array(wb), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, bool)), pa.array(ranks)], names=names)
                for i in range(0, len(of), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(pos[s].astype(np.int32)), pa.array(first[s]), pa.array(ranks[of[s]])], names=names)

    return vocabulary.select("word", "rank").mapInArrow(run, "a long, b long, at int, first boolean, rank long")


def _near(vocabulary: DataFrame) -> DataFrame:
    """(rank, n_near, best): number of near words and the least rank of these, for words that have any."""
    key = Window.partitionBy("a", "b")
    group = Window.partitionBy("a", "b", "at")
    ordered = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    word, cut = F.col("at") < 0, F.col("first")
    met = _rows(vocabulary).repartition("a", "b").select(
        "*", F.max(F.when(word, F.col("rank"))).over(key).alias("shorter"), F.count_if(cut).over(key).alias("n_longer"), F.min(F.when(cut, F.col("rank"))).over(key).alias("longer"),
        F.count("*").over(ordered).alias("size"), F.nth_value("rank", 1).over(ordered).alias("one"), F.nth_value("rank", 2).over(ordered).alias("two"),
    )
    other = F.when(F.col("one") == F.col("rank"), F.col("two")).otherwise(F.col("one"))
    below = F.when(cut, F.col("shorter"))
    told = met.select("rank", F.when(word, F.col("n_longer")).otherwise(F.col("size") - 1 + below.isNotNull().cast("int")).alias("k"), F.when(word, F.col("longer")).otherwise(F.least(other, below)).alias("best"))
    return told.filter(F.col("k") > 0).groupBy("rank").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(rank, root): where the forms (rank, form) lead in at most 2 ** steps steps."""
    out = forms.select("rank", F.col("form").alias("root"))
    for _ in range(steps):
        on = out.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        out = materialize(out.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root")))
    return out


def variants(counted: DataFrame, ratio: int = 10) -> DataFrame:
    """Words (word, n, each word once) with near words and forms: word, n, n_near, form, form_n and root.

    Near is: one code point inserted, deleted or replaced. A word's form is its most frequent near word (of equal ones the
    first in code-point order), if that is at least `ratio` times as frequent; its root is the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their words")
    with scratch(counted.sparkSession):
        ordered = materialize(counted.select("word", "n")).repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
        vocabulary = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()))
        most = vocabulary.agg(F.max("n").alias("n")).first()["n"] or 1
        best = _near(vocabulary).join(vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n")), "best")
        is_form = F.col("form_n") >= ratio * F.col("n")
        own = materialize(vocabulary.join(best, "rank", "left").select("rank", "word", "n", "n_near", *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")]))
        longest = max(1, math.ceil(math.log(most, ratio)))  # of a chain, as counts grow by ratio at each step
        roots = _roots(own.filter("best IS NOT NULL").select("rank", F.col("best").alias("form")), math.ceil(math.log2(longest)))
        ends = roots.join(vocabulary.select(F.col("rank").alias("root"), F.col("word").alias("end")), "root").select("rank", "end")
        out = own.join(ends, "rank", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("end", "word").alias("root"))
        return materialize(out, outer=True)


def digest(out: DataFrame) -> DataFrame:
    return out.select("word", "form", "root", "n", "n_near", "form_n")
