"""WARC records, and resolution of not-modified revisits.

A revisit is joined as of its date to the latest strictly earlier full response
of the same canonical URL. Its validators are then checked: entity tags by weak
comparison if both have one, else Last-Modified. If they agree, the headers
that a 304 may update replace those of the stored response and its body is taken over.

The as-of join sorts (URL, date) pairs into range chunks. Within a chunk a window gives the
latest response; across chunks only one row per URL and chunk is carried, so the
captures of a single URL spread over many tasks.

Defined results: captures with a null URL or date never match; of responses
to one URL at one instant the largest record_id counts; a revisit's status is resolved, mismatch,
unvalidated (no validator in common, nothing is merged) or missing (no earlier
response); repeated revisits each get a row; null headers count as none, and names of headers in any case come out in
lower case; a file that is cut off or damaged gives its readable records and a row of kind damaged; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize

#: Header fields of a 304 that may replace those of the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't name a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
CAPTURE = "record_id string, url string, captured_at timestamp, kind string, http_status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Scheme, www, default port, fragment, tracking parameters and last slashes dropped, host in lower case, parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"

    def of(u: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, head + "([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
        path = F.regexp_replace(F.regexp_extract(u, head + r"[^/?]*([^?]*)", 1), "/+$", "")
        query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
        return F.when(F.rlike(u, F.lit(head)), F.concat(host, path, let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))).otherwise(u)

    return let(u, of)


def unpacked(raw: bytes) -> tuple[bytes, bool]:
    """The content of all gzip members as far as it can be read, and whether that is all of it; other data as it is."""
    if raw[:2] != b"\x1f\x8b":
        return raw, True
    out = []
    while raw[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(raw))
        except zlib.error:
            # once more byte by byte of what is good: a damaged member still gives its beginning
            z, at = zlib.decompressobj(31), 0
            try:
                while at < len(raw):
                    out.append(z.decompress(raw[at : at + 64]))
                    at += 64
            except zlib.error:
                return b"".join(out), False
        if not z.eof:
            return b"".join(out), False
        raw = z.unused_data.lstrip(b"\0")
    return b"".join(out), not raw


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; gzip members are unpacked. A cut record ends it."""
    raw, at = unpacked(raw)[0], 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _fields(raw[at:end].split(b"\r\n")[1:])
        size = int(fields.get("content-length", "0")) if fields.get("content-length", "0").isdecimal() else 0
        if end + 4 + size > len(raw):
            return
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.decode("utf-8", "replace").partition(":")
        if colon:
            k = name.strip().lower()
            out[k] = f"{out[k]}, {value.strip()}" if k in out else value.strip()
    return out


def write_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in ({**fields, "Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def captures_of(raw: bytes) -> Iterator[dict]:
    """Response and revisit records as captures; one of kind damaged, all else null, where a gzip file can't be read to its end."""
    if not unpacked(raw)[1]:
        yield {"record_id": None, "url": None, "captured_at": None, "kind": "damaged", "http_status": None, "headers": {}, "body": None}
    for f, block in records(raw):
        if f.get("warc-type") not in ("response", "revisit"):
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        m = re.match(rb"HTTP/\S+\s+(\d{3})", lines[0])
        yield {"record_id": f.get("warc-record-id"), "url": f.get("warc-target-uri"), "captured_at": f.get("warc-date"), "kind": f["warc-type"], "http_status": int(m[1]) if m else None, "headers": _fields(lines[1:]), "body": body if f["warc-type"] == "response" else None}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all WARC files under path. A file is one row, so files must stay below 1 GB, as crawlers cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"record_id": pa.string(), "url": pa.string(), "captured_at": pa.string(), "kind": pa.string(), "http_status": pa.int32(), "headers": pa.map_(pa.string(), pa.string()), "body": pa.binary()}
        for b in batches:
            for raw in b.column("content"):
                rows = []
                for r in captures_of(raw.as_py()):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield _batch(rows, kinds)
                        rows = []
                yield _batch(rows, kinds)

    def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if k == "headers" else r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, CAPTURE.replace("timestamp", "string")).withColumn("captured_at", F.try_to_timestamp("captured_at"))


def as_of(stored: DataFrame, asked: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each distinct (key, at) of asked the value of stored's latest row with a smaller `at` (a long): key, at, found_at, found."""
    rows = stored.groupBy(key, at).agg(F.max(value).alias("v")).withColumn("q", F.lit(False))
    rows = rows.unionByName(asked.select(key, at).distinct().withColumn("v", F.lit(None).cast(stored.schema[value].dataType)).withColumn("q", F.lit(True)))
    rows = materialize(rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).repartitionByRange(key, at).withColumn("chunk", F.spark_partition_id()))
    hit = F.when(~F.col("q"), F.struct(F.col(at).alias("a"), F.col("v").alias("v")))
    near = rows.withColumn("near", F.max(hit).over(Window.partitionBy(key, "chunk").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy(key, "chunk").agg(F.max(hit).alias("last"))
    ends = ends.withColumn("carried", F.max("last").over(Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).filter("carried is not null").select(key, "chunk", "carried")
    out = near.filter("q").join(ends, [key, "chunk"], "left").withColumn("f", F.coalesce("near", "carried"))
    return out.filter("f is not null").select(key, at, F.col("f.a").alias("found_at"), F.col("f.v").alias("found"))


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only, the first in order of spelling."""
    of = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, F.lit(1), i), lambda y: F.lower(y["key"]) == F.lower(x["key"])))
    return F.map_from_entries(F.transform(let(F.array_sort(F.map_entries(headers)), of), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"))))


def resolve_revisits(captures: DataFrame, permitted: Iterable[str] = PERMITTED) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured_at, status, response_id, headers, body.

    A revisit with status 200 is one of an identical payload: it keeps its own headers and takes the earlier body.
    """
    none = F.expr("cast(map() as map<string,string>)")
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("c"), F.unix_micros("captured_at").alias("t"), "captured_at", "kind", "http_status", lower_names(F.coalesce("headers", none)).alias("headers"), "body")
    full = rows.filter((F.col("kind") == "response") & (F.col("http_status") == 200) & F.col("body").isNotNull())
    revisits = rows.filter(F.col("kind") == "revisit")
    found = as_of(full.select("c", "t", "record_id"), revisits.select("c", "t"), "c", "t", "record_id")
    asked = revisits.join(found, ["c", "t"], "left").select("record_id", "c", "captured_at", "http_status", F.col("headers").alias("new"), F.col("found_at").alias("t"), F.col("found").alias("response_id"))
    stored = full.groupBy("c", "t").agg(F.max_by(F.struct("headers", "body"), "record_id").alias("r"))
    both = asked.join(stored, ["c", "t"], "left")
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    old, new = F.col("r.headers"), F.col("new")
    tags = tag(old).isNotNull() & tag(new).isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    same = F.when(tags, tag(old) == tag(new)).when(dates, F.trim(old["last-modified"]) == F.trim(new["last-modified"]))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("http_status") == 200, "identical").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    may = F.map_filter(new, lambda k, v: k.isin([p.lower() for p in permitted]))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(may), k)), may)
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select("record_id", F.col("c").alias("canonical_url"), "captured_at", "status", "response_id", F.when(ok, merged).otherwise(new).alias("headers"), F.when(ok | (F.col("status") == "identical"), F.col("r.body")).alias("body"))
