"""A stored inverted index for full-text search, kept in step with the entries by segments.

Postings are partitioned by a hash of the term and sorted by term within files, so a search for
terms opens their partitions only and a prefix search is cut down by the files' statistics. They carry
positions, term counts and document lengths; corpus totals are a row of their own. A search joins no
texts: it groups the few rows of its terms by document.

A write adds a segment with the postings of what it stored, and a tombstone for each document that it changed or deleted:
postings of an older segment than the tombstone are void. Totals follow by the lengths that come and go, so scores are those of an
index built anew. Searches leave void rows out by an anti-join, which they don't plan while there is no
tombstone. merge() makes one segment of all but the first, or of all, without void rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..operators import fts
from .commits import Snapshot, Transaction, setting

BUCKETS = 64
#: Postings that a task deals into blocks together.
BLOCK = 250_000
#: Rows, texts or blocks, that a task has in hand at a time while postings are written, if the session allows more.
ROWS = 500
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What deals terms to buckets; an index of another kind counts as none until it is built anew.
HASH = "crc32"
#: Tables of an index in a store.
NAMES = ("fts_postings", "fts_lengths", "fts_gone", "fts_totals")
#: Segments beside the first that a write leaves; one more, and they are merged.
SEGMENTS = 8


class TextIndex:
    def __init__(self, postings: DataFrame, lengths: DataFrame, totals: DataFrame, language: str, buckets: int = BUCKETS, gone: DataFrame | None = None):
        self.postings, self.totals, self.language, self.buckets, self.gone = postings, totals, language, buckets, gone
        self.lengths = live(lengths, gone, "id")

    def _rows(self, every: list[fts.Leaf]) -> DataFrame:
        """Postings of the terms and prefixes of the leaves."""
        words = sorted({w for x in every for w in (x.words[:-1] if x.prefix else x.words)})
        starts = sorted({x.words[-1] for x in every if x.prefix})
        cond = F.col("term").isin(words) if words else F.lit(False)
        for s in starts:
            cond = cond | F.col("term").startswith(s)
        rows = self.postings.filter(cond)
        if not starts:
            spark = self.postings.sparkSession
            at = spark.range(1).select(F.array(*[bucket(F.lit(w), self.buckets) for w in words]).alias("b")).first()["b"]
            rows = rows.filter(F.col("bucket").isin(sorted(set(at))))
        return live(rows, self.gone, "doc")

    def _counts(self, every: list[fts.Leaf]) -> DataFrame:
        """doc, dl and the count of each leaf, for the documents that hold any of their terms."""
        rows = self._rows(every)
        need = sorted({(w, x.prefix and i == len(x.words) - 1) for x in every for i, w in enumerate(x.words)})
        is_ = lambda w, p: F.col("term").startswith(w) if p else F.col("term") == w
        phrases = {(w, x.prefix and i == len(x.words) - 1) for x in every if len(x.words) > 1 for i, w in enumerate(x.words)}
        aggs = [F.sum(F.when(is_(w, p), F.col("tf")).otherwise(0)).alias(f"t{i}") for i, (w, p) in enumerate(need)]
        aggs += [F.flatten(F.collect_list(F.when(is_(w, p), F.col("positions")))).alias(f"p{i}") for i, (w, p) in enumerate(need) if (w, p) in phrases]
        own = rows.groupBy("doc").agg(F.first("dl").alias("dl"), *aggs)

        def count(x: fts.Leaf) -> Column:
            at = [need.index((w, x.prefix and i == len(x.words) - 1)) for i, w in enumerate(x.words)]
            if len(at) == 1:
                return F.col(f"t{at[0]}")
            starts = F.col(f"p{at[0]}")
            for i, n in enumerate(at[1:], 1):
                starts = F.array_intersect(starts, _moved(F.col(f"p{n}"), i))
            return F.size(starts)

        return own.select("doc", "dl", *[count(x).alias(f"n{i}") for i, x in enumerate(every)])

    def search(self, tree: fts.Leaf | fts.Node | None, doc: str = "id", keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of the matching documents, as fts.search() gives them over the texts."""
        if tree is None:
            kind = self.lengths.schema["id"].dataType.simpleString()
            return self.postings.sparkSession.createDataFrame([], f"{doc} {kind}, score double")
        every, ranked = fts.every_leaf(tree), fts.leaves(tree)
        counted = self._counts(every)
        seen = counted.agg(*[F.count_if(F.col(f"n{every.index(x)}") > 0).alias(f"df{i}") for i, x in enumerate(ranked)])
        total = self.totals.crossJoin(seen)  # a row each
        hit = counted.filter(fts.matches(tree, {x: F.col(f"n{i}") for i, x in enumerate(every)})).withColumnRenamed("doc", doc)
        if keep is not None:
            hit = hit.join(keep.select(doc), doc, "left_semi")
        return hit.crossJoin(F.broadcast(total)).select(doc, fts.bm25(every, ranked).alias("score"))

    def cover_rank(self, query: str, doc: str = "id") -> DataFrame:
        """(id, score) of documents with all words of the query by cover density, from the positions of the index."""
        want = fts.words_of(query, self.language)
        rows = self._rows(want)
        own = rows.groupBy("doc").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == x.words[0], F.col("positions")))).alias(f"p{i}") for i, x in enumerate(want)])
        return fts.by_cover(own.select(F.col("doc").alias(doc), F.array(*[f"p{i}" for i in range(len(want))]).alias("ps")), doc)


def live(rows: DataFrame, gone: DataFrame | None, doc: str) -> DataFrame:
    """rows (with a document and a segment) without those that a later tombstone voids."""
    if gone is None:
        return rows
    dead = gone.select(F.col("doc").alias("_doc"), F.col("seg").alias("_seg"))
    return rows.join(dead, (F.col(doc) == F.col("_doc")) & (F.col("seg") < F.col("_seg")), "left_anti")


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a term, as postings() has it."""
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def tables(docs: DataFrame, language: str, doc: str = "id", text: str = "text_content", buckets: int = BUCKETS, spread: int = 1, segment: int = 0) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of docs. spread is the number of files of a bucket, which splits frequent terms."""
    lengths = docs.select(F.col(doc).alias("id"), token_count(F.col(text)).alias("dl"), F.lit(segment).alias("seg"))
    own = fts.words(docs, doc, text, language)
    kind = own.schema["doc"].dataType.simpleString()
    return _dealt(own, fts.counted(language, buckets), kind, spread).withColumn("seg", F.lit(segment)), lengths


def _dealt(rows: DataFrame, make: Callable | None, kind: str, spread: int) -> DataFrame:
    """rows, of which make, if given, makes postings in the same task, by bucket, sorted within tasks. They travel in compressed blocks of many postings.

    Blocks are rebalanced, so that a bucket larger than Spark's advisory size becomes several tasks and files: what a task sorts doesn't grow with the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(make(batches) if make else batches, spread)

    own = rows.mapInArrow(run, "deal int, block binary").hint("rebalance", "deal").mapInArrow(unpacked, f"doc {kind}, term string, dl int, positions array<int>, bucket int")
    own = own.select("doc", "term", "dl", F.size("positions").alias("tf"), "positions", "bucket")
    return own.sortWithinPartitions("bucket", "term", "doc")


def packed(batches: Iterator[pa.RecordBatch], spread: int = 1) -> Iterator[pa.RecordBatch]:
    """Postings as blocks, each of many of one bucket, which is dealt into spread parts."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()
        deal = t["bucket"].to_numpy() * spread + np.arange(t.num_rows) % spread
        order = np.argsort(deal, kind="stable")
        deal, t = deal[order], t.take(pa.array(order)).combine_chunks()
        cuts = np.flatnonzero(np.diff(deal, prepend=deal[0] - 1, append=deal[-1] + 1))
        b = t.to_batches()[0]
        blocks = [_block(b.slice(a, z - a)) for a, z in pairwise(cuts.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(deal[cuts[:-1]], pa.int32()), pa.array(blocks, pa.binary())], names=["deal", "block"])

    for b in batches:
        if b.num_rows:
            held.append(b.select(["doc", "term", "dl", "positions", "bucket"]))
        if sum(x.num_rows for x in held) >= BLOCK:
            yield from flush()
    if held:
        yield from flush()


def _narrow(values: np.ndarray) -> pa.Array:
    """Numbers of at least 0 in as few bytes as they need, as one list."""
    small = pa.array(values.astype(np.min_scalar_type(int(values.max(initial=0)))))
    return pa.ListArray.from_arrays(pa.array([0, len(small)], pa.int32()), small)


def _block(b: pa.RecordBatch) -> bytes:
    """Postings of one bucket as one row of lists: documents and their lengths once, terms once a run, positions as steps."""
    docs, term = b.column("doc").dictionary_encode(), b.column("term").dictionary_encode()
    dl, number = np.zeros(len(docs.dictionary), np.int64), docs.indices.to_numpy()
    dl[number] = b.column("dl").to_numpy()
    word, ends = term.indices.to_numpy(), b.column("positions").offsets.to_numpy().astype(np.int64)
    n, steps = np.diff(ends), np.diff(b.column("positions").flatten().to_numpy().astype(np.int64), prepend=0)
    at = (ends[:-1] - ends[0])[n > 0]
    steps[at] = b.column("positions").flatten().to_numpy()[at]
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = {
        "docs": whole(docs.dictionary), "dls": _narrow(dl), "terms": whole(term.dictionary), "word": _narrow(word[heads]), "rows": _narrow(np.diff(np.append(heads, len(word)))),
        "doc": _narrow(number), "n": _narrow(n), "steps": _narrow(steps), "bucket": b.column("bucket").slice(0, 1),
    }
    sink, row = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packed() blocks."""
    for b in batches:
        for block in b.column("block"):
            row = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
            x = {c: row.column(c).flatten() for c in row.schema.names if c != "bucket"}
            number, n = x["doc"].to_numpy().astype(np.int64), x["n"].to_numpy().astype(np.int64)
            ends, word = np.concatenate([[0], np.cumsum(n)]), np.repeat(x["word"].to_numpy(), x["rows"].to_numpy())
            sums = np.concatenate([[0], np.cumsum(x["steps"].to_numpy().astype(np.int64))])
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums[1:] - np.repeat(sums[ends[:-1]], n), pa.int32()))
            dl, bucket = x["dls"].to_numpy()[number], np.full(len(number), row.column("bucket")[0].as_py())
            columns = [x["docs"].take(pa.array(number)), x["terms"].take(pa.array(word)), pa.array(dl, pa.int32()), positions, pa.array(bucket, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "term", "dl", "positions", "bucket"])


def _write(tx: Transaction, rows: DataFrame, append: bool = False) -> None:
    """Postings as a table, or a part of it, made of few texts and blocks at a time."""
    most = int(tx.spark.conf.get(ROWS_KEY, "0"))
    with setting(tx.spark, ROWS_KEY, str(min(most, ROWS) if most > 0 else ROWS)):
        tx.write("fts_postings", rows, append=append, partition="bucket")


def _totals(tx: Transaction, language: str, docs: int, words: int) -> None:
    row = [(docs, words / docs if docs else None, words, language)]
    tx.write("fts_totals", tx.spark.createDataFrame(row, "docs bigint, avgdl double, words bigint, language string"))


def _size(lengths: DataFrame) -> tuple[int, int]:
    r = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    return r["n"], r["words"]


def put(tx: Transaction, entries: DataFrame, language: str, spread: int = 1) -> None:
    """Index these entries, in place of a former index."""
    rows, lengths = tables(entries, language, spread=spread)
    _write(tx, rows)
    tx.state["tables"]["fts_postings"]["hash"] = HASH
    tx.write("fts_lengths", lengths)
    tx.forget("fts_gone")
    _totals(tx, language, *_size(tx.read("fts_lengths")))


def build(store, entries: DataFrame, language: str, spread: int = 1) -> None:
    """put() as a commit of its own."""
    store.commit(lambda tx: put(tx, entries, language, spread))


def follow(tx: Transaction, ids: DataFrame, entries: DataFrame | None = None) -> None:
    """The documents ids (a column id) have changed: void what the index has of them, and add what entries, if any, hold now.

    Does nothing without an index. ids and entries are small beside the index: one segment is written, and lengths are read.
    """
    if not _built(tx):
        return
    total = tx.read("fts_totals").first()
    docs, words = total["docs"], total["words"]
    segment = 1 + _last(tx)
    gone = tx.read("fts_gone") if tx.exists("fts_gone") else None
    dead = tx.stage(live(tx.read("fts_lengths"), gone, "id").join(ids.select("id"), "id", "left_semi"))
    n, w = _size(dead)
    if n:
        tx.write("fts_gone", dead.select(F.col("id").alias("doc"), F.lit(segment).alias("seg")), append=tx.exists("fts_gone"))
    docs, words = docs - n, words - w
    if entries is not None:
        rows, lengths = tables(entries, total["language"], segment=segment)
        lengths = tx.stage(lengths)
        _write(tx, rows, append=True)
        tx.write("fts_lengths", lengths, append=True)
        n, w = _size(lengths)
        docs, words = docs + n, words + w
    _totals(tx, total["language"], docs, words)
    tx.state["tables"]["fts_postings"] |= {"segment": segment, "hash": HASH}
    if len(tx.parts("fts_postings")) > SEGMENTS + 1:
        merge(tx)


def _built(at: Snapshot) -> bool:
    return at.exists("fts_totals") and at.state["tables"]["fts_postings"].get("hash") == HASH


def _last(at: Snapshot) -> int:
    """Number of the newest segment."""
    return at.state["tables"]["fts_postings"].get("segment", 0)


def merge(tx: Transaction, whole: bool = False) -> None:
    """One segment of all but the first, or of all; void rows go. Results stay the same."""
    gone = tx.read("fts_gone") if tx.exists("fts_gone") else None
    first, segment = ([], 0) if whole else (tx.parts("fts_postings")[:1], _last(tx))
    rows = live(tx.read("fts_postings"), gone, "doc")
    rows = rows if whole else rows.filter("seg > 0")
    lengths = tx.stage(live(tx.read("fts_lengths"), gone, "id"))
    kept = {k: v for k, v in tx.state["tables"]["fts_postings"].items() if k == "hash"}
    rows = _dealt(rows.drop("seg"), None, rows.schema["doc"].dataType.simpleString(), 1).withColumn("seg", F.lit(segment))
    _write(tx, rows)
    tx.state["tables"]["fts_postings"] |= kept | {"parts": [*first, *tx.parts("fts_postings")], "segment": segment}
    tx.write("fts_lengths", lengths.withColumn("seg", F.when(F.col("seg") > 0, segment).otherwise(0)))
    if whole:
        tx.forget("fts_gone")
    elif gone is not None:  # what voids rows of the first segment stays
        tx.write("fts_gone", gone.select("doc").distinct().withColumn("seg", F.lit(1)))


def open_index(store, language: str) -> TextIndex | None:
    """The store's index, or that of a snapshot; None if there is none or it is of another language."""
    at = store if isinstance(store, Snapshot) else store.snapshot()
    if not _built(at):
        return None
    totals = at.read("fts_totals")
    if totals.first()["language"] != language:
        return None
    return TextIndex(at.read("fts_postings"), at.read("fts_lengths"), totals.select("docs", "avgdl"), language, gone=at.read("fts_gone") if at.exists("fts_gone") else None)


def drop(store) -> None:
    store.commit(lambda tx: [tx.forget(name) for name in NAMES])
