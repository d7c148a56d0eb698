"""An append-only feed of entries as a stream: counts per window, and merging with dedup into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Tools
from ..schema import ENTRIES
from ..sources.store import Store


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts(feed: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Entries per window and source; rows later than the watermark are dropped."""
    return feed.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "source").agg(F.count("*").alias("n")).select("w.start", "w.end", "source", "n")


def merge_into(feed: DataFrame, store: Store, checkpoint: str, tools: Tools | None = None):
    """Store each batch behind the entries there are, as the tools do: what repeats its thread's newest, or the row before it, folds into that; ids that are there already are left out.

    A batch is one commit, with what the tools' makers make and with the full-text index, so a batch that runs again after a failure changes nothing twice.
    """
    tools = tools or Tools(store)
    return feed.writeStream.foreachBatch(lambda batch, _: tools.put_entries(batch)).option("checkpointLocation", checkpoint)
