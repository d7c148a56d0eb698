"""Tables of a folder, changed together.

A commit is a small manifest that names the Parquet folders of every table. It is published under the next number, by
an operation that fails if that number is taken; whoever loses starts again from what the winner wrote.
Readers hold one manifest, so they see all tables of one moment; a job that fails before
publishing has changed nothing. Tables of entries are split into buckets by a hash of the thread, those of what hangs
off entries by a hash of the entry, and a write gives new files to the buckets it touches only.

Entries that change or go are not rewritten with their buckets: their places (file and row) are noted as void, a bit each, and
new rows go to further parts of the buckets. Reads leave void rows out by these bits, which are broadcast, so that no text is
shuffled. A bucket is written anew once more than half of its rows are void, or it has more than PARTS parts.

Publishing is a hard link on local disks and a rename elsewhere, which HDFS refuses where the target exists; a store that
renames over existing files needs one writer at a time.
"""

from __future__ import annotations

import contextlib
import copy
import json
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metadata_columns
from ..schema import ENTRY_KEY, TABLES

#: Column that decides the bucket of a row.
BUCKET_KEY = ENTRY_KEY | {"entries": "thread_id"}
#: Places of rows: words of 64 rows of a file, a bit each.
SPOTS = "file string, word bigint, bits bigint"
#: Manifests that stay, with all that they name, for readers that have begun.
KEPT = 3
#: Parts that a bucket of entries has at most after a write.
PARTS = 8
#: Spark's setting that deletes the shuffle files of a job at its end, instead of whenever the driver collects garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another commit came first."""


class Folder:
    """Files below a path, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def publish(self, name: str, text: str) -> None:
        """Write a file that no one has written yet, whole or not at all; else Conflict."""
        draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = self._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority
                os.link(local(self._at(draft)).toString(), local(self._at(name)).toString())
            elif self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
                raise FileExistsError(name)
        except FileExistsError:
            raise Conflict(name) from None
        finally:
            self._fs.delete(self._at(draft), False)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that begin meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def swept(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Jobs that begin meanwhile leave no shuffle files, so that a commit of many jobs needs the disk of one."""
    return setting(spark, SWEPT, "true")


def placed(rows: DataFrame) -> DataFrame:
    """rows, as read from files, with _file (folder, bucket and name) and _row."""
    return rows.select("*", F.substring_index("_metadata.file_path", "/", -3).alias("_file"), F.col("_metadata.row_index").alias("_row"))


def at_spots(rows: DataFrame, spots: DataFrame, inside: bool) -> DataFrame:
    """Of rows, as read from files, those at the spots (file, word, bits: 64 rows of a file), or all others. A bit for each row of a file is broadcast."""
    words = spots.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
    spans = words.groupBy(F.col("file").alias("_file"), F.shiftright("word", 6).alias("_span")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(word % 64 as int)"), "bits"))).alias("m"))
    spans = spans.select("_file", "_span", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("_words"))
    own = placed(rows).withColumn("_span", F.shiftright("_row", 12)).join(F.broadcast(spans), ["_file", "_span"], "inner" if inside else "left")
    hit = F.coalesce(F.expr("getbit(get(_words, cast(shiftright(_row, 6) % 64 as int)), cast(_row % 64 as int)) = 1"), F.lit(False))
    return own.filter(hit if inside else ~hit).drop("_file", "_row", "_span", "_words")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Snapshot:
    """The tables of one commit. Its number is 0 where nothing was committed yet."""

    def __init__(self, folder: Folder, number: int, state: dict):
        self.folder, self.spark, self.number, self.state = folder, folder.spark, number, state

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def exists(self, name: str) -> bool:
        return name in self.state["tables"]

    def parts(self, name: str) -> list[list]:
        """Folder and bucket of each part of a table; the bucket is null where the table has none."""
        return self.state["tables"][name]["parts"]

    def schema(self, name: str) -> T.StructType:
        return TABLES[name] if name in TABLES else T.StructType.fromJson(self.state["tables"][name]["schema"])

    @property
    def typed(self) -> dict[str, str]:
        """Metadata keys that entries have columns of, and what they are declared as."""
        return self.state.get("typed", {})

    def read(self, name: str, buckets: Iterable[int] | None = None, typed: bool = False) -> DataFrame:
        """A table, or some buckets of it; entries with the columns of their metadata, if typed."""
        rows = self._stored(name, buckets, typed)
        return at_spots(rows, self._stored(f"{name}_void"), False) if self.exists(f"{name}_void") and self._found(name, buckets) else rows

    def _found(self, name: str, buckets: Iterable[int] | None = None) -> list[list]:
        wanted = None if buckets is None else set(buckets)
        return [p for p in self.parts(name) if wanted is None or p[1] in wanted]

    def _stored(self, name: str, buckets: Iterable[int] | None = None, typed: bool = False) -> DataFrame:
        """read() with the void rows."""
        if not self.exists(name):
            raise LookupError(f"no table {name}")
        found = self._found(name, buckets)
        schema = T.StructType(self.schema(name).fields + (metadata_columns.fields(self.typed) if typed else []))
        reader = self.spark.read.schema(schema)
        if not found:
            return self.spark.createDataFrame([], schema)
        if self.state["tables"][name].get("partition"):
            out = [reader.parquet(f"{self.folder.path}/{name}/{f}") for f, _ in found]
            for more in out[1:]:
                out[0] = out[0].unionByName(more)
            return out[0]
        return reader.parquet(*[f"{self.folder.path}/{name}/{f}" + ("" if b is None else f"/bucket={b}") for f, b in found])

    def at(self, name: str, spots: DataFrame) -> DataFrame:
        """The rows at the spots; void ones too, if these are asked for. No row is shuffled."""
        rows = self._stored(name)
        return rows.limit(0) if spots.isEmpty() else at_spots(rows, spots, True)


class Transaction(Snapshot):
    """A snapshot with changes that nobody else sees before publish()."""

    def __init__(self, base: Snapshot):
        super().__init__(base.folder, base.number, copy.deepcopy(base.state))
        self._made: list[str] = []
        self._staged: list[str] = []

    def _new(self, name: str) -> str:
        self._made.append(f"{name}/{uuid.uuid4().hex}")
        return self._made[-1]

    def stage(self, df: DataFrame) -> DataFrame:
        """df written once, beside the tables, and read back; gone after the transaction."""
        self._staged.append(f"_staged/{uuid.uuid4().hex}")
        path = f"{self.folder.path}/{self._staged[-1]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def create(self, name: str) -> None:
        """An empty table of TABLES."""
        self.state["tables"][name] = {"parts": []}

    def write(self, name: str, df: DataFrame, buckets: Iterable[int] | None = None, append: bool = False, partition: str | None = None) -> None:
        """df in place of a table, or of these buckets of it, or behind what it has."""
        if buckets is not None and not list(buckets):
            return
        out = df.select(TABLES[name].names) if name in TABLES else df
        if name == "entries":
            out = metadata_columns.shred(out, self.typed)
        at, key = self._new(name), BUCKET_KEY.get(name)
        folder = at.split("/")[1]
        before = self.parts(name) if self.exists(name) else []
        if key:
            out.withColumn("bucket", bucket_of(F.col(key), self.buckets)).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder.path}/{at}")
            made = [[folder, int(x[7:])] for x in self.folder.names(at) if x.startswith("bucket=")]
            kept = before if append else [p for p in before if p[1] not in set(buckets)] if buckets is not None else []
        else:
            (out.write.partitionBy(partition) if partition else out.write).option("compression", "zstd").parquet(f"{self.folder.path}/{at}")
            made, kept = [[folder, None]], before if append else []
        entry = {"parts": [*kept, *made]} | ({} if name in TABLES else {"schema": out.schema.jsonValue()}) | ({"partition": partition} if partition else {})
        self.state["tables"][name] = entry
        if key and buckets is None and not append:
            self.forget(f"{name}_void")

    def forget(self, name: str) -> None:
        self.state["tables"].pop(name, None)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of a table that hold rows of keys, a table with the bucket's column; as many as there are buckets at most."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col(BUCKET_KEY[name]), self.buckets).alias("b")).distinct().collect())

    def holding(self, name: str, ids: DataFrame) -> list[int]:
        """Buckets of a table that have rows of the entries ids (a column id); only keys are read."""
        if not self.parts(name):
            return []
        key = ENTRY_KEY[name]
        own = self.read(name).select(key, bucket_of(F.col(BUCKET_KEY[name]), self.buckets).alias("b"))
        return sorted(r[0] for r in own.join(ids.select(F.col("id").alias(key)), key, "left_semi").select("b").distinct().collect())

    def spots(self, name: str, ids: DataFrame) -> DataFrame:
        """Where the rows of ids (a column id) stand in a table, in words of 64 rows, staged; only keys are read."""
        key, rows = ENTRY_KEY[name], self._stored(name)
        if not self.parts(name):
            return self.spark.createDataFrame([], SPOTS)
        own = placed(rows.select(key))
        if self.exists(void := f"{name}_void"):
            dead = self._stored(void).select(F.col("file").alias("_file"), F.col("word").alias("_word"), "bits")
            own = own.withColumn("_word", F.shiftright("_row", 6)).join(dead, ["_file", "_word"], "left").filter(F.expr("bits is null or getbit(bits, cast(_row % 64 as int)) = 0"))
        hit = own.join(ids.select(F.col("id").alias(key)), key, "left_semi")
        return self.stage(hit.groupBy(F.col("_file").alias("file"), F.shiftright("_row", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(_row % 64 as int)))").alias("bits")))

    def exchange(self, name: str, spots: DataFrame, rows: DataFrame | None = None) -> None:
        """The rows at the spots become void, and rows, if any, are added."""
        if rows is not None:
            self.write(name, rows, append=True)
        void = f"{name}_void"
        if not spots.isEmpty():
            self._void(name, self._stored(void).unionByName(spots) if self.exists(void) else spots)
        crowded = {b for b, n in Counter(b for _, b in self.parts(name)).items() if n > PARTS}
        if not spots.isEmpty():
            bucket = F.regexp_extract("_file", "bucket=([0-9]+)", 1).cast("int")
            full = placed(self._stored(name)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
            dead = self._stored(void).withColumnRenamed("file", "_file").groupBy(bucket.alias("b")).agg(F.sum(F.bit_count("bits")).alias("dead"))
            crowded |= {r["b"] for r in full.join(dead, "b").filter("2 * dead > n").select("b").collect()}  # a row for each bucket at most
        if crowded:
            self.write(name, self.read(name, crowded), crowded)
            if self.exists(void):
                self._void(name, self._stored(void))

    def _void(self, name: str, spots: DataFrame) -> None:
        """These rows of a table count as void, as far as their files are still part of it; a row for each word."""
        live = F.substring_index("file", "/", 2).isin([f"{f}/bucket={b}" for f, b in self.parts(name)])
        self.write(f"{name}_void", spots.filter(live).groupBy("file", "word").agg(F.bit_or("bits").alias("bits")))

    def upsert(self, name: str, df: DataFrame, key: str | None = None, of: DataFrame | None = None) -> None:
        """df in place of all rows of the entries that it names, or of those in `of`: chunks, embedding metadata, index nodes, tags, images."""
        key = key or ENTRY_KEY[name]
        names = (df if of is None else of).select(key).distinct()
        touched = self.touched(name, names)
        own = self.read(name, touched)
        self.write(name, own.join(names, key, "left_anti").select(own.columns).unionByName(df.select(own.columns)), touched)

    def delete_of(self, ids: DataFrame, names: Iterable[str]) -> None:
        """Delete what belongs to ids (a column id) from the tables that have any of it."""
        for name in names:
            if name == "entries":
                self.exchange(name, self.spots(name, ids))
            elif touched := self.holding(name, ids):
                own = self.read(name, touched)
                self.write(name, own.join(ids.select(F.col("id").alias(ENTRY_KEY[name])), ENTRY_KEY[name], "left_anti").select(own.columns), touched)

    def publish(self) -> None:
        self.number += 1
        self.folder.publish(f"_commits/{self.number:010d}.json", json.dumps(self.state))
        self._unstage()

    def abandon(self) -> None:
        """Delete what was written."""
        for at in self._made:
            self.folder.delete(at)
        self._unstage()

    def _unstage(self) -> None:
        for at in self._staged:
            self.folder.delete(at)
        self._staged.clear()


class Commits:
    """The commits of a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        self._files = Folder(spark, self.path)

    def _numbers(self) -> list[int]:
        return [int(x[:-5]) for x in self._files.names("_commits") if x.endswith(".json") and not x.startswith(".")]

    def _state(self, number: int) -> dict:
        return json.loads(self._files.read(f"_commits/{number:010d}.json"))

    def snapshot(self) -> Snapshot:
        last = max(self._numbers(), default=0)
        return Snapshot(self._files, last, self._state(last) if last else {"buckets": self._buckets, "tables": {}})

    def commit(self, body: Callable[[Transaction], object], tries: int = 8) -> object:
        """Run body on a transaction and publish it; again, on the newer state, where another commit came first."""
        for left in reversed(range(tries)):
            tx = Transaction(self.snapshot())
            try:
                with swept(self.spark):
                    out = body(tx)
                tx.publish()
            except Conflict:
                tx.abandon()
                if not left:
                    raise
            except BaseException:
                tx.abandon()
                raise
            else:
                self._clean()
                return out

    def _clean(self) -> None:
        """Delete manifests but the last few, and files that none of these names."""
        old = self._numbers()[:-KEPT]
        if not old:
            return
        parts = lambda s: {f"{n}/{f}" + ("" if b is None else f"/bucket={b}") for n, t in s["tables"].items() for f, b in t["parts"]}
        live = set().union(*[parts(self._state(n)) for n in self._numbers()[-KEPT:]])
        folders = {"/".join(p.split("/")[:2]) for p in live}
        for n in old:
            for p in parts(self._state(n)) - live:
                self._files.delete(p)
                top = "/".join(p.split("/")[:2])
                if top not in folders:
                    self._files.delete(top)
            self._files.delete(f"_commits/{n:010d}.json")
