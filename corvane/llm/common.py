"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written since each open scratch(), outermost first.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize() wrote meanwhile, but for those with outer."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        discard(spark, mine)


def materialize(df: DataFrame, keep: list | None = None, outer: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage
    and survives lost executors. keep, if given, collects the paths so that the
    caller can delete them with :func:`discard` once they are used up; else the innermost
    :func:`scratch` does, with outer the one around that, and without one the table stays."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    schema = df.schema
    scopes = _SCOPES.get()
    if keep is not None:
        keep.append(path)
    elif len(scopes) > outer:
        scopes[-1 - outer].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, paths: list) -> None:
    """Delete tables that materialize() wrote."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def text_key(text: Column) -> Column:
    """128-bit key of a text; null and empty share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, even inside lambdas."""
    return F.transform(F.array(value), body)[0]


def small(df: DataFrame, max_rows: int, max_bytes: int = 32 << 20) -> bool:
    """True if df (already materialized) has at most max_rows rows and max_bytes bytes as JSON."""
    r = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return r["n"] <= max_rows and r["b"] <= max_bytes


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of rows whose texts or bytes in column come to at most `most`, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(part, (part[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A broadcast hint behind a count of rows and bytes; larger sides are left to a shuffle join, with the same result."""
    return F.broadcast(df) if small(df, max_rows) else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def refuse_clash(df: DataFrame, *names: str) -> None:
    """Raises if df has a column of one of these names, in any case."""
    if clash := sorted({c for c in df.columns if c.lower() in {n.lower() for n in names}}):
        raise ValueError(f"columns clash with those that are added: {clash}")
