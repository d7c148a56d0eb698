"""Benchmark decontamination by winnowing: Spark expressions only.

A window is `window` consecutive item words (a shorter item is one window of its
own length). Of a window's k-gram hashes the smallest is its fingerprint, with
k = min(gram, length): equal windows have equal fingerprints, so joining the
fingerprints of documents and benchmark misses no shared window. In documents that
share one, each match is extended to the windows around it that have this fingerprint; their
words are compared with those of the distinct benchmark windows, and windows found merge into spans.

A document goes through explode and a hash join as distinct fingerprints beside the key of its text, never
as pairs with items or with its text; texts are joined once, where a fingerprint matched.
Distinct benchmark windows are joined, so a phrase in many items costs one match.

Defined results: null or empty texts have no words and no hits; texts may be of any length, and a long one that is a benchmark item itself takes time in proportion to its words; repeated
documents (or items) each get their own result; items without words are ignored;
an empty benchmark hits nothing; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, let, materialize, scratch, text_key

#: Windows of a text that are looked up together.
STRETCH = 1024
#: Letters of both cases are of words, as texts are also split as they are.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column, lower=ascii_lower) -> Column:
    """Runs of digits, lower-cased letters and everything beyond ASCII."""
    return F.array_remove(F.split(lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def count_words(text: Column) -> Column:
    return F.size(words(text, lambda t: t)).cast("long")


def _fold(text: Column) -> Column:
    """All letters lower-cased, many times faster than A-Z alone. For fingerprints only: equal words stay equal, as each character
    is mapped by itself but for the final sigma, which is made a common one. It moves no bound of a word."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def _runs_of(a: Column, n: int, pair) -> Column:
    """pair over every n neighbours of a, from runs of at most half the length that may overlap; the array is n - 1 shorter."""

    def grow(x: Column, have: int) -> Column:
        if have == n:
            return F.slice(x, F.lit(1), F.size(x) - (n - 1))
        more = min(2 * have, n)
        later = F.slice(x, F.lit(more - have + 1), F.greatest(F.size(x) - (more - have), F.lit(0)))
        return let(F.zip_with(x, later, pair), lambda y: grow(y, more))

    return grow(a, 1)


def _grams(w: Column, k: int) -> Column:
    """Hashes of k words in a row."""
    return F.transform(w, lambda x: F.xxhash64(x)) if k == 1 else _runs_of(w, k, lambda a, b: F.xxhash64(a, b))


def _per_length(w: Column, m: int, gram: int, body, empty: str) -> Column:
    """body(v) where w has a window of m words, v being the fingerprints of its windows."""
    k = min(gram, m)
    return F.when(F.size(w) >= m, let(_grams(w, k), lambda g: let(_lows(g, m, k), body))).otherwise(F.expr(empty))


def _prints(w: Column, lengths: list[int], gram: int) -> Column:
    one = lambda m: _per_length(w, m, gram, lambda v: v, "cast(array() as array<bigint>)")
    return F.array_distinct(F.concat(*[one(m) for m in lengths]))


def _lows(g: Column, m: int, k: int) -> Column:
    """The fingerprint of each window of m words, in order."""
    return _runs_of(g, m - k + 1, lambda a, b: F.least(a, b))


def _marked(lows: Column, among: Column) -> Column:
    """(start, print) of the fingerprints that are in among. Both are met by hashing, a stretch of starts at a time,
    so that a long text with many matches isn't searched through for each start."""
    nothing = F.expr("cast(array() as array<struct<start:int,print:bigint>>)")

    def stretch(at: Column, part: Column) -> Column:
        rows = lambda hit: F.filter(F.transform(part, lambda p, i: F.struct((at * STRETCH + i + 1).cast("int").alias("start"), p.alias("print"))), lambda r: F.array_contains(hit, r["print"]))
        return let(F.array_intersect(part, among), lambda hit: F.when(F.size(hit) > 0, rows(hit)).otherwise(nothing))

    count = F.floor((F.size(lows) - 1) / STRETCH).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), count), lambda at: let(F.slice(lows, at * STRETCH + 1, F.lit(STRETCH)), lambda part: stretch(at, part))))


def _windows(w: Column, lengths: list[int], gram: int, among: Column | None = None) -> Column:
    """(start, length, words, fingerprint) of the windows, of those with a fingerprint in among if given."""

    def one(folded: Column, m: int) -> Column:
        def body(v: Column) -> Column:
            whole = lambda r: F.struct(r["start"].alias("start"), F.lit(m).alias("length"), F.slice(w, r["start"], m).alias("window"), r["print"].alias("print"))
            each = F.transform(v, lambda p, i: F.struct((i + 1).alias("start"), p.alias("print"))) if among is None else _marked(v, among)
            return F.transform(each, whole)

        return _per_length(folded, m, gram, body, "cast(array() as array<struct<start:int,length:int,window:array<string>,print:bigint>>)")

    return let(F.transform(w, _fold), lambda folded: F.concat(*[one(folded, m) for m in lengths]))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10, gram: int = 5) -> tuple[DataFrame, list[int]]:
    """(item_id, window, length, print), materialized, and the window lengths that occur (at most `window`)."""
    def of(w: Column) -> Column:
        size = F.least(F.size(w), F.lit(window))
        return F.coalesce(*[F.when(size == m, _windows(w, [m], gram)) for m in range(1, window + 1)])

    rows = benchmark.select(F.col(item).alias("item_id"), let(words(F.col(text)), of).alias("ws"))
    rows = rows.select("item_id", F.inline("ws")).select("item_id", "window", "length", "print").distinct()
    out = materialize(rows)
    return out, sorted(r[0] for r in out.select("length").distinct().collect())


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """key (see text_key), spans: sorted array of (start, length) of the windows found, in words from 1, items: sorted array of item ids as strings.

    One row per distinct document text with a hit.
    """
    with scratch(docs.sparkSession):
        bench, lengths = benchmark_windows(benchmark, item, item_text, window, gram)
        if not lengths:
            return docs.sparkSession.createDataFrame([], "key binary, spans array<struct<start:int,length:int>>, items array<string>")
        prints = broadcast_if_small(materialize(bench.select(F.col("print").alias("p")).distinct()))
        keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
        scanned = keyed.select("key", let(words(F.col("text"), _fold), lambda w: _prints(w, lengths, gram)).alias("ps"))
        found = materialize(scanned.select("key", F.explode("ps").alias("p")).join(prints, "p").groupBy("key").agg(F.collect_set("p").alias("ps")))
        # texts are joined once, and only where a fingerprint matched
        texts = keyed.join(broadcast_if_small(found), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("ps").alias("ps"))
        spots = texts.select("key", let(words(F.col("text")), lambda w: _windows(w, lengths, gram, F.col("ps"))).alias("ws")).select("key", F.inline("ws"))
        own = bench.groupBy("window").agg(F.first("print").alias("print"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
        hits = spots.join(broadcast_if_small(materialize(own)), ["print", "window"]).select("key", "start", "length", "ids")
        hits = hits.groupBy("key").agg(
            F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        )
        return materialize(hits, outer=True)


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).cast("long").alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items."""
    hits = find_hits(docs, benchmark, text=text, **options)
    all_docs = docs.select(F.col(doc).alias("doc_id"), text_key(F.col(text)).alias("key"), count_words(F.col(text)).alias("n_words"))
    return all_docs.join(broadcast_if_small(hits), "key", "left").select(
        "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
