"""The entry store: tables in Parquet by default, JDBC for other databases; copy, compress and backfill jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metadata_columns
from ..functions.text import repaired, uuid7
from ..operators import quant, textops
from ..schema import ENTRY_KEY, MAX_SUMMARIES, TABLES
from . import derived
from .commits import Commits, Transaction


class Store(Commits):
    """The entry store: tables by name, each call a commit of its own; commit() changes several at once."""

    def init(self) -> None:
        """Create the tables that are missing."""
        missing = [n for n in TABLES if not self.exists(n)]
        if missing:
            self.commit(lambda tx: [tx.create(n) for n in missing if not tx.exists(n)])

    def exists(self, name: str) -> bool:
        return self.snapshot().exists(name)

    def drop(self, name: str) -> None:
        if self.exists(name):
            self.commit(lambda tx: tx.forget(name))

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def write(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        """Make df, which may be read from the table, its new content; any table, those of TABLES in their columns."""
        self.commit(lambda tx: tx.write(name, df, partition=partition))

    replace = write

    def append(self, name: str, df: DataFrame) -> None:
        self.commit(lambda tx: tx.write(name, df, append=True))

    def upsert(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Replace all rows of the entries that df names by those of df: chunks, embedding metadata, index nodes, tags, images."""
        self.commit(lambda tx: tx.upsert(name, df, key))

    def delete_of(self, ids: DataFrame, names: Iterable[str]) -> None:
        """Delete what belongs to ids (a column id) from the tables that have any of it."""
        self.commit(lambda tx: tx.delete_of(ids, names))


def index_metadata(store: Store, wanted: dict[str, str], mode: str = "additive") -> dict[str, list[str]]:
    """Bring the metadata keys that have columns in line with wanted (key: kind), in one commit; what was missing, what was extra.

    additive adds, auto adds and drops, warn changes nothing, strict raises where anything differs. A kind that differs counts as missing.
    Stored values that can't be of the kind are refused. Entries are rewritten once.
    """
    if mode not in ("additive", "auto", "warn", "strict"):
        raise ValueError(f"no mode {mode!r}")

    def body(tx: Transaction) -> dict[str, list[str]]:
        now = tx.typed
        missing, extra = sorted(k for k in wanted if now.get(k) != wanted[k]), sorted(k for k in now if k not in wanted)
        if mode == "strict" and (missing or extra):
            raise ValueError(f"metadata columns differ: missing {missing}, extra {extra}")
        after = {k: v for k, v in now.items() if mode != "auto" or k in wanted} | {k: wanted[k] for k in missing}
        if mode in ("additive", "auto") and after != now:
            own = tx.read("entries")
            bad = own.agg(*[F.count_if(metadata_columns.misfit(F.col("metadata"), k, wanted[k])).alias(f"n{i}") for i, k in enumerate(missing)]).first() if missing else ()
            if any(bad):
                raise ValueError("; ".join(f"{n} entries have a {k} that is no {wanted[k]}" for k, n in zip(missing, bad, strict=True) if n))
            tx.state["typed"] = after
            tx.write("entries", own)
        return {"missing": missing, "extra": extra}

    return store.commit(body)  # type: ignore[return-value]


def put_chunks(tx: Transaction, chunks: DataFrame, model: str) -> None:
    """Chunks (context_id, chunk_index, start_index, end_index, embedding) in place of their entries' former ones, and the entries' embedding metadata.

    A dimension other than the stored one is refused, and so are vectors of several dimensions. Compressed
    chunks follow where compression is recorded.
    """
    sizes = chunks.select(F.size("embedding").alias("d")).distinct().limit(2).collect()
    if len(sizes) > 1 or (sizes and conflicting_dimension(tx.read("embedding_metadata"), sizes[0]["d"])):
        raise ValueError("the vectors' dimension isn't the stored one")
    now = F.current_timestamp()
    meta = chunks.groupBy("context_id").agg(F.lit(model).alias("model_name"), F.max(F.size("embedding")).alias("dimensions"), F.count("*").cast("int").alias("chunk_count"), now.alias("created_at"), now.alias("updated_at"))
    tx.upsert("chunks", chunks)
    tx.upsert("embedding_metadata", meta)
    if (row := tx.read("compression").first()) is not None:
        q = quant.Quantizer(row["dim"], row["bits"], row["variant"], row["seed"])
        if q.fingerprint() != row["codebook_fingerprint"]:
            raise ValueError("the recorded quantizer can't be made again")
        tx.upsert("chunks_compressed", quant.compress(chunks, q))


def store_chunks(store: Store, chunks: DataFrame, model: str) -> None:
    """put_chunks() as a commit of its own; the chunks count as made from their entries' texts as they are."""

    def body(tx: Transaction) -> None:
        put_chunks(tx, chunks, model)
        derived.record(tx, ["chunks"], tx.read("entries").join(chunks.select(F.col("context_id").alias("id")).distinct(), "id", "left_semi"))

    store.commit(body)


def chunks_exist(store: Store, ids: DataFrame) -> DataFrame:
    """id and has_chunks for ids (a column id)."""
    have = store.read("chunks").select(F.col("context_id").alias("id"), F.lit(True).alias("has_chunks")).distinct()
    return ids.select("id").join(have, "id", "left").select("id", F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


def chunked(entries: DataFrame, encoder: Callable[[list[str]], list[list[float]]], size: int = 1500, overlap: int = 150) -> DataFrame:
    """Chunks of entries with the encoder's embeddings, ready for store_chunks()."""
    rows = textops.chunk_rows(entries, size, overlap)
    return embed(rows, encoder).select(F.col("id").alias("context_id"), "chunk_index", "start_index", "end_index", "embedding")


def read_jdbc(spark: SparkSession, url: str, name: str, partition: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC (the driver's jar comes with the session), split by a numeric column if given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        r = r.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def id_map(entries: DataFrame) -> DataFrame:
    """(old_id, new_id) for entries with other ids: time-ordered, from creation time and old id."""
    return entries.select(F.col("id").cast("string").alias("old_id"), uuid7(F.col("created_at"), F.col("id")).alias("new_id"))


def rewrite_references(metadata: str | None, names: dict[str, str], keys: tuple[str, ...] = ("references", "context_ids", "parent_id")) -> str | None:
    """metadata with mapped ids, wherever one of keys stands, at any depth."""
    if metadata is None:
        return None

    def walk(v: object, on: bool) -> object:
        if isinstance(v, dict):
            return {k: walk(x, on or k in keys) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, on) for x in v]
        return names.get(str(v), v) if on and not isinstance(v, bool) and isinstance(v, (str, int)) else v

    return json.dumps(walk(json.loads(metadata), False), ensure_ascii=False, sort_keys=True)


def referenced(metadata: str | None, keys: tuple[str, ...] = ("references", "context_ids", "parent_id")) -> list[str]:
    found: list[str] = []

    def walk(v: object, on: bool) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, on or k in keys)
        elif isinstance(v, list):
            for x in v:
                walk(x, on)
        elif on and isinstance(v, (str, int)) and not isinstance(v, bool):
            found.append(str(v))

    try:
        walk(json.loads(metadata) if metadata else None, False)
    except ValueError:
        pass
    return list(dict.fromkeys(found))


def copy_store(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with new entry ids everywhere, references in metadata included. The id map is joined, never collected."""
    ids = id_map(tables["entries"])
    out = {}
    for name, df in tables.items():
        if name not in ENTRY_KEY:
            out[name] = df
            continue
        key = ENTRY_KEY[name]
        out[name] = df.join(ids.withColumnRenamed("old_id", key), key).drop(key).withColumnRenamed("new_id", key).select(df.columns)
    refs = F.pandas_udf(lambda s: s.map(referenced), "array<string>")
    each = tables["entries"].select(F.col("id").cast("string").alias("old_id"), F.explode(refs("metadata")).alias("ref")).join(ids.select(F.col("old_id").alias("ref"), F.col("new_id").alias("to")), "ref")
    per = each.groupBy("old_id").agg(F.map_from_entries(F.collect_set(F.struct("ref", "to"))).alias("names")).join(ids, "old_id").select(F.col("new_id").alias("id"), "names")

    @F.pandas_udf("string")
    def rewrite(m: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([rewrite_references(a, dict(b)) if b is not None else a for a, b in zip(m, names, strict=True)])

    e = out["entries"].join(per, "id", "left")
    out["entries"] = e.withColumn("metadata", F.when(F.col("names").isNull(), F.col("metadata")).otherwise(rewrite("metadata", "names"))).select(tables["entries"].columns)
    return out


def compress_store(store: Store, quantizer: quant.Quantizer) -> None:
    """Write compressed chunks and their provenance row; from then on chunks are compressed as they are stored."""
    q = quantizer

    def body(tx: Transaction) -> None:
        tx.write("chunks_compressed", quant.compress(tx.read("chunks"), q))
        tx.write("compression", store.spark.createDataFrame([("rotated", q.bits, q.variant, q.seed, q.dim, q.fingerprint())], TABLES["compression"]))

    store.commit(body)


def decompress_store(store: Store, quantizer: quant.Quantizer) -> None:
    row = store.read("compression").first()
    if row is None or row["codebook_fingerprint"] != quantizer.fingerprint():
        raise ValueError("the quantizer isn't the recorded one")
    store.write("chunks", quant.decompress(store.read("chunks_compressed"), quantizer))


def missing_embeddings(entries: DataFrame, embedding_metadata: DataFrame) -> DataFrame:
    return entries.join(embedding_metadata.select(F.col("context_id").alias("id")), "id", "left_anti")


def embed(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str = "chunk") -> DataFrame:
    """chunks with embedding from a batch encoder that the caller provides."""

    def run(col: pd.Series) -> pd.Series:
        return pd.Series(encoder(col.tolist()))

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))


def summarise(entries: DataFrame, summariser: Callable[[str], str], least_chars: int = 500) -> DataFrame:
    """entries with a summary, where the text is long enough."""
    run = F.pandas_udf(lambda s: s.map(summariser), "string")
    return entries.withColumn("summary", F.when(F.length("text_content") >= least_chars, repaired(run("text_content"))).otherwise(F.col("summary")))


def summarised_nodes(entries: DataFrame, summariser: Callable[[str], str], max_depth: int = 6, least_chars: int = 500, most: int = MAX_SUMMARIES) -> DataFrame:
    """Index nodes of entries (columns of index_nodes), each section long enough with a summary of its own, of an entry the `most` shallowest and of these the longest first."""
    nodes = textops.outline_nodes(entries, max_depth).filter("node_id != 'root'")
    run = F.pandas_udf(lambda s: s.map(summariser), "string")
    cut = nodes.join(entries.select(F.col("id"), "text_content"), "id").withColumn("section", F.substring("text_content", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("level", F.desc(F.length("section")), "char_start"))
    cut = cut.withColumn("_of", F.when(F.length("section") >= least_chars, place))
    made = cut.withColumn("node_summary", F.when(F.col("_of") <= most, repaired(run("section"))))
    return made.select(F.col("id").alias("context_id"), "node_id", "level", "ordinal", "title", "node_summary", "char_start", "char_end")


def embedding_models(embedding_metadata: DataFrame) -> DataFrame:
    return embedding_metadata.select("model_name", "dimensions").distinct()


def conflicting_dimension(embedding_metadata: DataFrame, wanted: int) -> bool:
    return not embedding_metadata.filter(F.col("dimensions") != wanted).limit(1).isEmpty()
