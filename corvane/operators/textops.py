"""Grep, line and range reads, outlines, chunks and passages over entries."""

from __future__ import annotations

import bisect
import time
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking, outline, passages
from ..schema import names as names_of

#: Rows of what entries are taken apart into that are given on together.
ROWS = 20_000
MATCH = "id string, line_number int, line string, start int, end int, before array<string>, after array<string>, timed_out boolean"
NODE = "node_id string, level int, ordinal int, title string, char_start int, char_end int, parent_id string"


def compile_pattern(pattern: str, is_regex: bool = False, case_sensitive: bool = False):
    """A multi-line regular expression; a literal is escaped."""
    import regex

    if not pattern:
        raise ValueError("empty pattern")
    return regex.compile(pattern if is_regex else regex.escape(pattern), regex.MULTILINE | (0 if case_sensitive else regex.IGNORECASE))


def prefilter(text: Column, pattern: str, is_regex: bool, case_sensitive: bool) -> Column | None:
    """A substring test before Python, where it can't miss: plain ASCII that case doesn't change."""
    plain = not is_regex and pattern.isascii() and (case_sensitive or not any(c.isalpha() for c in pattern))
    return F.contains(text, F.lit(pattern)) if plain else None


def grep(entries: DataFrame, pattern: str, is_regex: bool = False, case_sensitive: bool = False, context: int = 0, timeout: float = 5.0, total: float | None = None, doc: str = "id", text: str = "text_content") -> DataFrame:
    """A row per match within a line; an entry that takes longer than timeout seconds, over all its lines, gives one row with timed_out.

    total bounds the seconds of each task: entries that it hasn't come to by then give such a row, too. timed_out() lists them, none is dropped in silence.
    """
    compile_pattern(pattern, is_regex, case_sensitive)  # errors before any plan
    rows = entries.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    if (cond := prefilter(F.col("t"), pattern, is_regex, case_sensitive)) is not None:
        rows = rows.filter(cond)

    def found_in(rx, t: str, until: float) -> Iterator[tuple[int, int, int]]:
        lines, starts = outline.split_lines(t)

        def spans(x: str) -> Iterator[tuple[int, int]]:
            left = until - time.monotonic()
            if left <= 0:
                raise TimeoutError
            for m in rx.finditer(x, timeout=left):
                yield m.span()

        if is_regex:
            for n, (x, s) in enumerate(zip(lines, starts, strict=True)):
                for a, z in spans(x):
                    yield n, s + a, s + z
            return
        for a, z in spans(t):
            n = bisect.bisect_right(starts, a) - 1
            if z <= starts[n] + len(lines[n]):
                yield n, a, z

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = compile_pattern(pattern, is_regex, case_sensitive)
        end = time.monotonic() + total if total is not None else float("inf")
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"], strict=True):
                try:
                    found = list(found_in(rx, t, min(end, time.monotonic() + timeout)))
                except TimeoutError:
                    out.append((i, None, None, None, None, [], [], True))
                    continue
                lines = outline.split_lines(t)[0] if found else []
                out += [(i, n + 1, lines[n], a, z, lines[max(0, n - context) : n], lines[n + 1 : n + 1 + context], False) for n, a, z in found]
            yield pd.DataFrame(out, columns=names_of(MATCH))

    return rows.mapInPandas(run, MATCH)


def timed_out(matches: DataFrame) -> DataFrame:
    """Ids of the entries that were not searched to their end."""
    return matches.filter("timed_out").select("id").distinct()


def grep_files(matches: DataFrame) -> DataFrame:
    return matches.filter(~F.col("timed_out")).select("id").distinct()


def grep_counts(matches: DataFrame) -> DataFrame:
    return matches.filter(~F.col("timed_out")).groupBy("id").agg(F.count("*").alias("match_count"))


def grep_content(matches: DataFrame, max_results: int) -> DataFrame:
    """The first max_results matches in order, with truncated."""
    order = [F.asc("id"), F.asc("start")]
    top = matches.filter(~F.col("timed_out")).orderBy(*order).limit(max_results + 1)
    w = Window.orderBy(*order)  # over at most max_results + 1 rows
    n = top.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > max_results)
    return n.filter(F.col("_n") <= max_results).drop("_n")


def read_chars(text: Column, start: Column | int, end: Column | int) -> Column:
    """Characters start..end, clamped to the text."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    a = F.least(F.greatest(lit(start), F.lit(0)), F.length(text))
    z = F.least(F.greatest(lit(end), a), F.length(text))
    return F.struct(a.alias("char_start"), z.alias("char_end"), F.substring(text, a + 1, z - a).alias("content"), line_of(text, a).alias("line_start"), line_of(text, F.greatest(z - 1, a)).alias("line_end"))


def line_of(text: Column, at: Column) -> Column:
    """Line number, from 1, of a position."""
    return F.size(F.split(F.substring(text, F.lit(1), at), "\n"))


def read_lines(text: Column, first: int, last: int) -> Column:
    """Lines first..last, from 1, both included and clamped; joined by \\n."""
    parts = F.split(text, "\r\n|\n")
    return F.array_join(F.slice(parts, max(first, 1), max(last - max(first, 1) + 1, 0)), "\n")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\r\n|\n"))


def _table(entries: DataFrame, doc: str, text: str, schema: str, body: Callable[[str], Iterable[tuple]]) -> DataFrame:
    full = f"id string, {schema}"
    kinds = {"string": pa.string(), "int": pa.int32()}
    own = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in full.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), own, strict=True)], schema=own)
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t"), strict=True):
                rows.extend((i, *r) for r in body(t.as_py() or ""))
                if len(rows) >= ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return entries.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("t")).mapInArrow(run, full)


def outline_nodes(entries: DataFrame, max_depth: int = 6, doc: str = "id", text: str = "text_content") -> DataFrame:
    """A row per outline node, the root included."""
    names = names_of(NODE)
    return _table(entries, doc, text, NODE, lambda t: [tuple(x[k] for k in names) for x in outline.outline(t, max_depth)])


def navigate(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes with their stored summaries, by node id or else by span."""
    s = stored.select(F.col("context_id").alias("id"), F.col("node_id"), F.col("char_start").alias("_a"), F.col("char_end").alias("_z"), "node_summary")
    by_id = nodes.join(s.select("id", "node_id", "node_summary"), ["id", "node_id"], "left")
    by_span = s.select("id", F.col("_a").alias("char_start"), F.col("_z").alias("char_end"), F.col("node_summary").alias("_other")).dropDuplicates(["id", "char_start", "char_end"])
    return by_id.join(by_span, ["id", "char_start", "char_end"], "left").withColumn("node_summary", F.coalesce("node_summary", "_other")).drop("_other")


def nested(rows: Iterable[Mapping]) -> dict | None:
    """The nodes of one entry as a tree: each with children, in order of their start."""
    made = {r["node_id"]: {**r, "children": []} for r in rows}
    for x in sorted(made.values(), key=lambda x: (x["char_start"], x["level"])):
        if x["parent_id"] in made:
            made[x["parent_id"]]["children"].append(x)
    return made.get(outline.ROOT)


def read_node(entries: DataFrame, nodes: DataFrame, node_id: str, doc: str = "id", text: str = "text_content") -> DataFrame:
    """The section of a node in each entry that has it."""
    own = nodes.filter(F.col("node_id") == node_id).select("id", "char_start", "char_end")
    return entries.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("t")).join(own, "id").select("id", read_chars(F.col("t"), F.col("char_start"), F.col("char_end")).alias("range"))


def chunk_rows(entries: DataFrame, size: int = 1500, overlap: int = 150, doc: str = "id", text: str = "text_content") -> DataFrame:
    return _table(entries, doc, text, "chunk_index int, start_index int, end_index int, chunk string", lambda t: chunking.chunks(t, size, overlap))


def rerank_text(text: Column, marked: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """What a reranker reads: the passage around the matches if marked is given, else the matched chunk, else the head; never nothing."""
    out = F.when(marked.isNotNull(), passage_column(text, marked))
    if start is not None and end is not None:
        out = out.when(end > start, F.substring(text, start + 1, end - start))
    return F.coalesce(F.nullif(out.otherwise(F.substring(text, 1, passages.MAX_PASSAGE)), F.lit("")), text)


def passage_column(text: Column, marked: Column, **options) -> Column:
    """Passage of each row; for the rows of a ranked page."""

    @F.pandas_udf("string")
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([passages.passage(x or "", y, **options) for x, y in zip(t, m, strict=True)])

    return run(text, marked)
