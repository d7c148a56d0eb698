"""Scans, look-ups, paging and display."""

from __future__ import annotations

import io
from collections.abc import Iterable
from contextlib import redirect_stdout

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metadata_columns import bare
from ..schema import MAX_OFFSET, MAX_PAGE, RANK_DEPTH
from . import filters


def page(df: DataFrame, order: Iterable[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page by a total order; planned as a top-k, not a sort. An offset that is too large is refused, not cut."""
    if errors := page_errors(limit, offset):
        raise filters.InvalidFilter(errors)
    return df.orderBy(*order).offset(offset).limit(min(limit, MAX_PAGE))


def page_errors(limit: int, offset: int) -> list[str]:
    return [m for bad, m in ((limit < 1, "limit must be at least 1"), (offset < 0, "offset must not be negative"), (offset > MAX_OFFSET, f"offset must be at most {MAX_OFFSET}")) if bad]


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def ranked_page(df: DataFrame, order: Iterable[Column], limit: int, offset: int = 0, depth: int = RANK_DEPTH) -> DataFrame:
    """A slice of one fixed ranking of `depth` rows; beyond it nothing."""
    if offset >= depth:
        return df.limit(0)
    order = list(order)
    return df.orderBy(*order).limit(depth).orderBy(*order).offset(offset).limit(min(limit, depth - offset))


def search_context(entries: DataFrame, tag_table: DataFrame | None = None, limit: int = 30, offset: int = 0, explain: bool = False, **conditions) -> dict:
    """Filtered, newest-first page. Validation errors are data, not exceptions."""
    clamped = min(limit, MAX_PAGE)
    try:
        rows = page(filters.apply_filters(entries, tag_table, **conditions), newest_first(), clamped, offset)
    except filters.InvalidFilter as e:
        return {"rows": bare(entries).limit(0), "error": "validation failed", "validation_errors": list(dict.fromkeys(e.errors))}
    out = {"rows": rows, "stats": {"filters_applied": filters.filters_applied(**conditions)}}
    if clamped != limit:
        out["clamped_limit"] = clamped
    if explain:
        out["stats"]["query_plan"] = plan_text(rows)
    return out


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    with redirect_stdout(io.StringIO()) as s:
        df.explain(mode)
    return s.getvalue()


def by_ids(entries: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Entries of the given ids (a bounded list from the caller), newest first."""
    spark: SparkSession = entries.sparkSession
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    return entries.join(F.broadcast(wanted), "id", "left_semi").orderBy(*newest_first())


def by_prefix(entries: DataFrame, prefix: str, limit: int = 2) -> DataFrame:
    return entries.filter(F.col("id").startswith(prefix.lower())).orderBy("id").limit(limit).select("id")


def resolve_prefix(entries: DataFrame, prefix: str) -> str:
    if not (8 <= len(prefix) <= 32 and all(c in "0123456789abcdef" for c in prefix.lower())):
        raise ValueError("a prefix has 8 to 32 hexadecimal digits")
    got = [r["id"] for r in by_prefix(entries, prefix).collect()]
    if len(got) != 1:
        raise LookupError("ambiguous prefix" if got else "no such entry")
    return got[0]


def probe(entries: DataFrame, entry_id: str) -> dict | None:
    """Version, content type and summary of one entry, None if absent."""
    r = entries.filter(F.col("id") == entry_id).select("version", "content_type", "summary").limit(1).collect()
    return r[0].asDict() if r else None


def tags_of(ids: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tags) with byte-ordered tags; [] for entries without any."""
    per = tags.groupBy(F.col("context_entry_id").alias("id")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    return ids.select("id").join(per, "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def images_of(ids: DataFrame, images: DataFrame, include_data: bool = False) -> DataFrame:
    """(id, images) by position; the blob column isn't read unless asked for."""
    cols = ["position", "mime_type", "image_metadata"] + (["image_data"] if include_data else [])
    per = images.groupBy(F.col("context_entry_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("images"))
    return ids.select("id").join(per, "id", "left")


def keyset_pages(entries: DataFrame, last_id: str | None, size: int = 200, char_budget: int | None = None) -> DataFrame:
    """Next rows by descending id below last_id, with truncated; cut where the running length passes the budget."""
    rows = entries if last_id is None else entries.filter(F.col("id") < last_id)
    rows = rows.orderBy(F.desc("id")).limit(size + 1)
    w = Window.orderBy(F.desc("id"))  # over at most size + 1 rows
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_more", F.max("_n").over(Window.partitionBy()) > size)
    rows = rows.filter(F.col("_n") <= size)
    if char_budget is not None:
        before = F.coalesce(F.sum(F.length("text_content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_before", before).withColumn("_more", F.col("_more") | (F.max("_before").over(Window.partitionBy()) > char_budget)).filter(F.col("_before") <= char_budget).drop("_before")
    return rows.withColumnRenamed("_more", "truncated").drop("_n")


def truncated(text: Column, width: int = 300) -> Column:
    """At most width characters, cut at the last space if it is past 70 %, with '...'."""
    head = F.substring(text, 1, width)
    back = F.instr(F.reverse(head), " ")
    at = F.lit(width) - back
    return F.when(F.length(text) <= width, text).when((back > 0) & (at > int(width * 0.7)), F.concat(F.substring(head, F.lit(1), at), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def display(entries: DataFrame) -> DataFrame:
    """What a result list shows of an entry."""
    return entries.select("id", "thread_id", "source", "content_type", truncated(F.col("text_content")).alias("text_content"), (F.length("text_content") > 300).alias("is_truncated"), F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", F.lit("")).otherwise(F.col("summary")).alias("summary"), iso(F.col("created_at")).alias("created_at"))
