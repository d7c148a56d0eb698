"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, fim, html_lstm, mixing, packing, quality, spelling, suffix, superminhash, tiff, toxicity, warc, winnow
from .common import table
from .sql import SQL


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of every page: the page itself, and a later not-modified answer.

    The answer of every eleventh page has another tag, that of every thirteenth none.
    """
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), "url", F.coalesce("html", F.lit("")).alias("html"), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16).alias("tag"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c)
    first = p.select(
        F.concat(F.lit("r"), F.lpad(F.col("i").cast("string"), 12, "0")).alias("record_id"), "url", at((F.col("i") * 37) % 86400).alias("captured_at"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"),
        F.create_map(F.lit("etag"), quote(F.col("tag")), F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.encode("html", "utf-8").alias("body"),
    )
    tag = F.when(F.col("i") % 11 == 0, F.concat(F.lit("x"), F.col("tag"))).otherwise(F.col("tag"))
    common = [F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("i") % 100).cast("string")), F.lit("content-type"), F.lit("text/plain"), F.lit("x-cache"), F.lit("HIT")]
    later = p.select(
        F.concat(F.lit("v"), F.lpad(F.col("i").cast("string"), 12, "0")).alias("record_id"), "url", at((F.col("i") * 37) % 86400 + (F.col("i") % 7) * 3600).alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"),
        F.when(F.col("i") % 13 == 0, F.create_map(*common)).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), quote(tag)), *common)).alias("headers"), F.lit(None).cast("binary").alias("body"),
    )
    out = warc.resolve_revisits(first.unionByName(later))
    head = lambda k: F.coalesce(F.col("headers")[k], F.lit("")).alias(k.replace("-", "_"))
    return out.select("record_id", "canonical_url", "status", "response_id", head("etag"), head("cache-control"), head("content-type"), head("x-cache"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("n_body"), F.coalesce(F.md5("body"), F.lit("")).alias("body_md5"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.text_images(table(spark, sf_dir, "documents"))
    stored = files.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return tiff.digest(tiff.tiff_pages(stored))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.digest(docs, suffix.repeated_spans(docs))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chatformat.digest(chatformat.format_chats(rows))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~quality.held_out())
    out = quality.score(docs, model)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("mix_prob", 6).alias("mix_prob"), "mix_kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = quality.held_out(folds=3, fold=1)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~apart)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(spelling.variants(spelling.words(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_revisits, op2_superminhash, op3_tiff, op4_html, op5_suffix, op6_winnowing, op7_chat_format, op8_quality, op9_mixing, op10_toxicity, op11_packing, op12_fill_in_middle, op13_spelling)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return SQL
