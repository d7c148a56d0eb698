"""Grouped statistics over entries, tags, images, embeddings and index nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import iso


def thread_list(entries: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One row per thread, the one with the newest entry first."""
    g = entries.groupBy("thread_id").agg(
        F.count("*").alias("entry_count"), F.count_distinct("source").alias("source_types"), F.sum(F.when(F.col("content_type") == "multimodal", 1).otherwise(0)).alias("multimodal_count"),
        F.min("created_at").alias("_first"), F.max("created_at").alias("_last"), F.max("id").alias("last_id"),
    ).orderBy(F.desc("_last"), F.desc("last_id"))
    g = g.offset(offset) if offset else g
    g = g.limit(limit) if limit is not None else g
    return g.select("thread_id", "entry_count", "source_types", "multimodal_count", iso(F.col("_first")).alias("first_entry"), iso(F.col("_last")).alias("last_entry"), "last_id")


def counts_by(entries: DataFrame, column: str) -> DataFrame:
    return entries.groupBy(column).agg(F.count("*").alias("n"))


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total_entries"), F.count_distinct("thread_id").alias("total_threads"))


def average_per(df: DataFrame, column: str) -> DataFrame:
    """Mean size of the groups of column, to 2 places; 0 without rows."""
    return df.groupBy(column).count().agg(F.coalesce(F.round(F.avg("count"), 2), F.lit(0.0)).alias("average"))


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def thread_statistics(entries: DataFrame, tags: DataFrame, images: DataFrame, thread_id: str) -> DataFrame:
    own = entries.filter(F.col("thread_id") == thread_id)
    base = own.agg(F.count("*").alias("entry_count"), F.count_if(F.col("source") == "user").alias("user_count"), F.count_if(F.col("source") == "agent").alias("agent_count"), F.count_if(F.col("content_type") == "multimodal").alias("multimodal_count"))
    ids = own.select(F.col("id").alias("context_entry_id"))
    t = tags.join(ids, "context_entry_id", "left_semi").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    i = images.join(ids, "context_entry_id", "left_semi").agg(F.count("*").alias("image_count"))
    return base.crossJoin(t).crossJoin(i)  # one row each


def tag_statistics(tags: DataFrame) -> DataFrame:
    per = tags.groupBy("context_entry_id").count().agg(F.round(F.avg("count"), 2).alias("avg_tags_per_entry"))
    return tags.agg(F.count("*").alias("total_tags"), F.count_distinct("tag").alias("unique_tags")).crossJoin(per)  # one row each


def share(cond: Column, name: str) -> Column:
    """Percentage of rows that meet cond, to 2 places; 0 without rows."""
    return F.coalesce(F.round(F.lit(100.0) * F.count_if(cond) / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0)).alias(name)


def summary_coverage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"), share(F.coalesce("summary", F.lit("")) != "", "coverage"))


def embedding_stats(entries: DataFrame, embedding_metadata: DataFrame) -> DataFrame:
    """Coverage, chunks, mean chunks of an embedded entry, bytes at 4 per dimension."""
    m = entries.select("id").join(embedding_metadata, F.col("id") == F.col("context_id"), "left")
    return m.agg(
        F.count("*").alias("total_entries"), F.count("context_id").alias("embedded"), share(F.col("context_id").isNotNull(), "coverage"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.round(F.avg("chunk_count"), 2), F.lit(0.0)).alias("avg_chunks"), F.coalesce(F.sum(F.col("chunk_count").cast("long") * F.col("dimensions") * 4), F.lit(0)).alias("bytes"),
    )


def payload_bytes(compressed: DataFrame) -> DataFrame:
    return compressed.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"))


def statistics(entries: DataFrame, tags: DataFrame, images: DataFrame) -> dict:
    """All parts of the statistics report as DataFrames."""
    return {
        "totals": totals(entries), "by_source": counts_by(entries, "source"), "by_content_type": counts_by(entries, "content_type"), "images": images.agg(F.count("*").alias("total_images")),
        "tags": tags.agg(F.count_distinct("tag").alias("unique_tags")), "avg_per_thread": average_per(entries, "thread_id"), "top_threads": top(entries, "thread_id", 5), "top_tags": top(tags, "tag", 10), "summaries": summary_coverage(entries),
    }


def fts_coverage(entries: DataFrame, indexed: DataFrame | None) -> DataFrame:
    """total_entries, indexed, coverage in percent; indexed has a column id, None if there is no index."""
    own = entries.select("id").join(indexed.select("id", F.lit(1).alias("_in")), "id", "left") if indexed is not None else entries.select("id", F.lit(None).cast("int").alias("_in"))
    return own.agg(F.count("*").alias("total_entries"), F.count("_in").alias("indexed"), F.coalesce(F.round(F.try_divide(100.0 * F.count("_in"), F.count("*")), 2), F.lit(0.0)).alias("coverage"))
