"""The common filter clause of every search: equality, dates, tags, metadata."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata_columns
from ..functions.metadata import compile_filters, predicate
from ..schema import MAX_TAGS


class InvalidFilter(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def parse_bound(value: str | None, end: bool = False) -> dt.datetime | None:
    """ISO date or time as UTC; a date alone as an end covers its whole day."""
    if not value:
        return None
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            day = dt.date.fromisoformat(value)
            return dt.datetime.combine(day, dt.time(23, 59, 59, 999999) if end else dt.time(), dt.UTC)
        t = dt.datetime.fromisoformat(value)
    except ValueError as e:
        raise InvalidFilter([f"invalid date: {value}"]) from e
    if t.tzinfo is None:
        return t.replace(tzinfo=dt.UTC)
    if t.utcoffset().total_seconds() % 60:
        raise InvalidFilter([f"offset below a minute: {value}"])
    return t.astimezone(dt.UTC)


def clean_tags(tags: Iterable[str] | None) -> list[str]:
    """Trimmed, lower-cased, distinct in order."""
    return list(dict.fromkeys(t.strip().lower() for t in tags or () if t.strip()))


def normalised_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def filters_applied(**dims: object) -> int:
    """One per active dimension; metadata counts each key and filter."""
    n = sum(1 for k in ("thread_id", "source", "content_type", "tags", "start_date", "end_date") if dims.get(k))
    return n + len(dims.get("metadata") or {}) + len(dims.get("metadata_filters") or [])


def condition_on(entries: DataFrame) -> Callable[..., Column]:
    """What makes a metadata condition: on the columns of a key where entries have them, on the JSON else."""
    have = set(entries.columns)

    def test(key: str, operator: str = "eq", value: object = None, case_sensitive: bool = False) -> Column:
        typed = metadata_columns.name_of(key, "kind") in have
        return metadata_columns.predicate(key, operator, value, case_sensitive) if typed else predicate(F.col("metadata"), key, operator, value, case_sensitive)

    return test


def apply_filters(
    entries: DataFrame, tag_table: DataFrame | None = None, thread_id: str | None = None, source: str | None = None, content_type: str | None = None, tags: Iterable[str] | None = None,
    start_date: str | None = None, end_date: str | None = None, metadata: Mapping[str, object] | None = None, metadata_filters: Iterable[Mapping] | None = None,
) -> DataFrame:
    """entries that meet all given conditions. Raises InvalidFilter before any plan is made."""
    lo, hi = parse_bound(start_date), parse_bound(end_date, end=True)
    if lo and hi and lo > hi:
        raise InvalidFilter(["start_date is after end_date"])
    wanted = None
    if tags:
        wanted = clean_tags(tags)
        if not wanted or len(wanted) > MAX_TAGS:
            raise InvalidFilter([f"tags: 1 to {MAX_TAGS} that aren't blank"])
    cond, errors = compile_filters(F.col("metadata"), metadata_filters or [], metadata, test=condition_on(entries))
    if errors:
        raise InvalidFilter(errors)
    out = entries
    for name, value in (("thread_id", thread_id), ("source", source), ("content_type", content_type)):
        if value:
            out = out.filter(F.col(name) == value)
    if lo:
        out = out.filter(F.col("created_at") >= F.lit(lo))
    if hi:
        out = out.filter(F.col("created_at") <= F.lit(hi))
    if cond is not None:
        out = out.filter(cond)
    if wanted:
        if tag_table is None:
            raise InvalidFilter(["no tags table"])
        hit = tag_table.filter(F.col("tag").isin(wanted)).select(F.col("context_entry_id").alias("_tagged"))
        out = out.join(hit, F.col("id") == F.col("_tagged"), "left_semi")
    return metadata_columns.bare(out)
