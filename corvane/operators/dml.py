"""Writes as batch transformations: dedup, update, patch, delete, validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata_columns import misfit
from ..functions.text import content_hash, merge_patch, storable, storable_metadata
from ..schema import ENTRY_KEY, MAX_IMAGE_BYTES, MAX_IMAGES, MAX_TAG_CHARS, MAX_TAGS, MAX_THREAD_CHARS
from ..session import materialized
from .filters import normalised_tags


def adjacent_runs(entries: DataFrame, thread: str = "thread_id", source: str = "source", order: str = "id", text: str = "text_content", split: bool = False) -> DataFrame:
    """entries with run: a number within the thread that grows where source or text changes.

    A thread is one window; with split, which writes the entries to the shared folder once, it is
    one window for each range of its entries, and a row per range carries the end of the one before.
    """
    h = F.coalesce(F.col("content_hash"), content_hash(F.col(text))) if "content_hash" in entries.columns else content_hash(F.col(text))
    e = entries.withColumn("_is", F.struct(F.col(source).alias("s"), h.alias("h")))
    if not split:
        w = Window.partitionBy(thread).orderBy(order)
        return e.withColumn("_new", (~F.lag("_is").over(w).eqNullSafe(F.col("_is"))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_is")
    e = materialized(e.repartitionByRange(thread, order).withColumn("_part", F.spark_partition_id()))
    w, parts = Window.partitionBy(thread, "_part").orderBy(order), Window.partitionBy(thread).orderBy("_part")

    def beside(rows: DataFrame, per: DataFrame, name: str) -> DataFrame:
        """rows with a value of their thread, null or not, and range."""
        per = per.select(F.col(thread).alias("_thread"), F.col("_part").alias("_range"), name)
        return rows.join(per, F.col(thread).eqNullSafe(F.col("_thread")) & (F.col("_part") == F.col("_range"))).drop("_thread", "_range")

    ends = e.groupBy(thread, "_part").agg(F.max_by("_is", order).alias("_last")).withColumn("_carried", F.lag("_last").over(parts)).drop("_last")
    e = e.withColumn("_at", F.row_number().over(w)).withColumn("_before", F.lag("_is").over(w))
    e = beside(e, ends, "_carried")
    e = e.withColumn("_new", (~F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_before")).eqNullSafe(F.col("_is"))).cast("int"))
    base = e.groupBy(thread, "_part").agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    e = beside(e, base, "_base").withColumn("run", F.col("_base") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select(*entries.columns, "run")


def fold_duplicates(entries: DataFrame, order: str = "id", split: bool = False) -> DataFrame:
    """Consecutive entries of one thread and source with one text become the first of them.

    Its metadata, summary and update time are the last that are not null; version counts the repeats.
    """
    runs = adjacent_runs(entries, order=order, split=split)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    first = lambda c: F.min_by(c, order).alias(c)
    out = runs.groupBy("thread_id", "run").agg(
        first("id"), first("source"), first("content_type"), first("text_content"), last("metadata"), last("summary"), first("content_hash"),
        (F.min_by("version", order) + F.count("*") - 1).alias("version"), first("created_at"), F.max("updated_at").alias("updated_at"),
    )
    return out.drop("run").select([c for c in entries.columns if c in out.columns])


def fold_new(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store new entries, in the order of their ids, after those of entries (the columns of entries).

    A new entry equal in source and text to its thread's newest, or to the new one before it, folds
    into that. Gives all entries, older ones untouched, and (new_id, id): the entry that each new one became.
    """
    newest = entries.join(new.select("thread_id").distinct(), "thread_id", "left_semi").groupBy("thread_id").agg(F.max_by(F.struct(*entries.columns), "id").alias("e")).select("e.*")
    both = newest.withColumn("_at", F.concat(F.lit("0"), "id")).unionByName(new.select(entries.columns).withColumn("_at", F.concat(F.lit("1"), "id")))
    runs = adjacent_runs(both, order="_at")
    first = runs.groupBy("thread_id", "run").agg(F.min_by("id", "_at").alias("_kept"))
    kept = runs.filter(F.col("_at").startswith("1")).join(first, ["thread_id", "run"]).select(F.col("id").alias("new_id"), F.col("_kept").alias("id"))
    folded = fold_duplicates(both, order="_at")
    return entries.join(newest.select("id"), "id", "left_anti").select(entries.columns).unionByName(folded.select(entries.columns)), kept


def would_fold(entries: DataFrame, thread_id: str, source: str, text: str) -> DataFrame:
    """The entry that storing (thread, source, text) would update, if any: the thread's newest, if it is of that source and text."""
    return entries.filter(F.col("thread_id") == thread_id).orderBy(F.desc("id")).limit(1).filter((F.col("source") == source) & (content_hash(F.col("text_content")) == content_hash(F.lit(text)))).select("id")


def update(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply changes (id, any of text_content, metadata, summary, content_type, patch; expected_version): entries, and the ids that conflict.

    A patch merges into the metadata after a change of it; a change whose version isn't the stored one does nothing.
    """
    cols = [c for c in ("text_content", "metadata", "summary", "content_type") if c in changes.columns]
    given = [*cols, *(["patch"] if "patch" in changes.columns else [])]
    c = changes.select(F.col("id"), *[F.col(x).alias(f"_{x}") for x in given], (F.col("expected_version") if "expected_version" in changes.columns else F.lit(None).cast("bigint")).alias("_v"), F.lit(True).alias("_hit"))
    j = entries.join(c, "id", "left")
    ok = F.col("_hit").isNotNull() & (F.col("_v").isNull() | (F.col("_v") == F.col("version")))
    new = {x: F.when(ok, F.coalesce(F.col(f"_{x}"), F.col(x))).otherwise(F.col(x)) for x in cols}
    new["version"] = F.when(ok, F.col("version") + 1).otherwise(F.col("version"))
    new["updated_at"] = F.when(ok, F.current_timestamp()).otherwise(F.col("updated_at"))
    if "text_content" in cols:
        new["content_hash"] = F.when(ok & F.col("_text_content").isNotNull(), content_hash(F.col("_text_content"))).otherwise(F.col("content_hash"))
    if "patch" in given:
        before = new.get("metadata", F.col("metadata"))
        new["metadata"] = F.when(ok & F.col("_patch").isNotNull(), merge_patch(F.coalesce(before, F.lit("{}")), F.when(ok, F.col("_patch")))).otherwise(before)
    return j.select(*[new.get(x, F.col(x)).alias(x) for x in entries.columns]), j.filter(F.col("_hit").isNotNull() & ~ok).select("id")


def refused(changes: DataFrame) -> list[str]:
    """Reasons why changes can't be applied as a whole, each once."""
    have = set(changes.columns)
    is_ = lambda c: F.col(c).isNotNull() if c in have else F.lit(False)
    checks = [("metadata and patch in one change", is_("metadata") & is_("patch"))]
    if "text_content" in have:
        checks += [("text is empty", F.trim("text_content") == ""), ("text holds a NUL", ~storable(F.col("text_content")))]
    if "metadata" in have:
        checks.append(("metadata isn't a JSON object", ~storable_metadata(F.col("metadata"))))
    if "tags" in have:
        checks += [("too many tags", F.size(normalised_tags(F.col("tags"))) > MAX_TAGS), ("tag is too long", F.exists("tags", lambda t: F.length(F.trim(t)) > MAX_TAG_CHARS))]
    if "images" in have:
        checks += [("too many images", F.size("images") > MAX_IMAGES), ("image isn't base64", F.exists("images", lambda i: decoded_image(i).isNull())), ("image is too large", F.exists("images", lambda i: F.octet_length(decoded_image(i)) > MAX_IMAGE_BYTES))]
    found = changes.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{i}") for i, (_, c) in enumerate(checks)]).first()
    return [text for i, (text, _) in enumerate(checks) if found[i]]


def touch(entries: DataFrame, ids: DataFrame, content_type: Column | None = None) -> DataFrame:
    """entries with a new time of update, and a content type if given, for the ids; versions stay."""
    j = entries.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    new = {"updated_at": F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col("updated_at"))}
    if content_type is not None:
        new["content_type"] = F.when(F.col("_hit"), content_type).otherwise(F.col("content_type"))
    return j.select(*[new.get(x, F.col(x)).alias(x) for x in entries.columns])


def replace_tags(tags: DataFrame, given: DataFrame) -> DataFrame:
    """The tags (context_entry_id, tag) with those of the ids in given (id, tags) in place of their former ones; an empty list removes all, null none."""
    own = given.filter("tags is not null").select(F.col("id").alias("context_entry_id"), "tags")
    new = own.select("context_entry_id", F.explode(normalised_tags(F.col("tags"))).alias("tag"))
    return tags.join(own.select("context_entry_id"), "context_entry_id", "left_anti").select(tags.columns).unionByName(new.select(tags.columns))


def matching(entries: DataFrame, ids: Iterable[str] | DataFrame | None = None, thread_ids: Iterable[str] | None = None, source: str | None = None, older_than_days: float | None = None, now: Column | None = None) -> DataFrame:
    """Ids that meet all given criteria; source or age alone is refused. ids may be a table with a column id."""
    if isinstance(ids, DataFrame):
        entries, ids = entries.join(ids.select("id"), "id", "left_semi"), None
    elif not ids and not thread_ids:
        raise ValueError("give ids or thread_ids" if source or older_than_days is not None else "no criteria")
    out = entries
    if ids:
        out = out.filter(F.col("id").isin(list(ids)))
    if thread_ids:
        out = out.filter(F.col("thread_id").isin(list(thread_ids)))
    if source:
        out = out.filter(F.col("source") == source)
    if older_than_days is not None:
        now = F.current_timestamp() if now is None else now
        out = out.filter(F.col("created_at") < F.timestamp_micros((F.unix_micros(now) - F.lit(int(older_than_days * 86_400_000_000)))))
    return out.select("id")


def delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the doomed ids."""
    return {n: df.join(doomed.select(F.col("id").alias(ENTRY_KEY[n])), ENTRY_KEY[n], "left_anti") if n in ENTRY_KEY else df for n, df in tables.items()}


def decoded_image(data: Column) -> Column:
    """Binary of base64 text, with or without a data URL's head; null if it isn't valid."""
    return F.try_to_binary(F.regexp_replace(F.regexp_replace(data, "^data:[^,]*,", ""), r"\s", ""), F.lit("base64"))


def image_type(data: Column) -> Column:
    """Media type by the first bytes of an image: png, jpeg, gif, webp; else octet-stream."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise("application/octet-stream")


def validated(batch: DataFrame, typed: Mapping[str, str] | None = None) -> DataFrame:
    """Rows to store (thread_id, source, text_content, metadata, tags, images) with error, null if valid, and what is derived. typed: kinds of metadata keys."""
    bad = lambda c, m: F.when(c, F.lit(m))
    out = batch.withColumn("tags", normalised_tags(F.coalesce("tags", F.array().cast("array<string>"))))
    error = F.coalesce(
        bad(F.trim(F.coalesce("thread_id", F.lit(""))) == "", "thread_id is empty"), bad(F.length("thread_id") > MAX_THREAD_CHARS, "thread_id is too long"), bad(~F.coalesce(F.col("source").isin("user", "agent"), F.lit(False)), "source is neither user nor agent"),
        bad(F.trim(F.coalesce("text_content", F.lit(""))) == "", "text is empty"), bad(~storable(F.col("text_content")), "text holds a NUL"), bad(~storable_metadata(F.col("metadata")), "metadata isn't a JSON object"), bad(F.size("tags") > MAX_TAGS, "too many tags"), bad(F.exists("tags", lambda t: F.length(t) > MAX_TAG_CHARS), "tag is too long"),
        bad(F.size(F.coalesce("images", F.array().cast("array<string>"))) > MAX_IMAGES, "too many images"), bad(F.exists(F.coalesce("images", F.array().cast("array<string>")), lambda i: decoded_image(i).isNull()), "image isn't base64"),
        bad(F.exists(F.coalesce("images", F.array().cast("array<string>")), lambda i: F.octet_length(decoded_image(i)) > MAX_IMAGE_BYTES), "image is too large"),
        *[bad(misfit(F.col("metadata"), k, kind), f"metadata {k} is no {kind}") for k, kind in (typed or {}).items()],
    )
    out = out.withColumn("error", error).withColumn("content_hash", content_hash(F.col("text_content")))
    return out.withColumn("content_type", F.when(F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0, "multimodal").otherwise("text"))


def accepted(batch: DataFrame, atomic: bool, typed: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows and failures; atomic: nothing is accepted if anything fails."""
    v = validated(batch, typed)
    bad = v.filter("error is not null")
    if atomic and not bad.isEmpty():
        return v.limit(0), bad
    return v.filter("error is null"), bad
