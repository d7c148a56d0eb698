"""A training-corpus pipeline over the documents table, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of documents; the last adds nothing either. Stages are written as
Parquet and reread between.

Defined results: a null text counts as empty; an empty text is scored like any, is nobody's
near copy and holds no repeated or benchmark string. Rows that repeat a document's id and text
become one, that with the smallest digest of all its columns; other rows with one id are documents of
their own. Of near copies the smallest id stays, a null one only where its group has no other. Empty tables stay empty
through every stage. Further columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, quality, suffix, superminhash, winnow
from corvane.llm.common import discard, free_name, materialize, scratch, table, text_key


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.3."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~quality.held_out())
    score = free_name(docs, "score")
    return quality.score(docs, model, column=score).filter(F.col(score) >= 0.3).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, 0.8)."""
    groups = superminhash.near_duplicates(docs, size=5, percent=80)
    key, other, twin = (free_name(docs, x) for x in ("key", "kept_id", "kept_key"))
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(other), F.col("text_key").alias(twin))
    keyed = docs.select("*", text_key(F.col("text")).alias(key))
    kept = keyed.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(key) == F.col(twin)), "left_semi")
    row = F.struct(*docs.columns)
    return kept.groupBy("doc_id", key).agg(F.min_by(row, F.md5(F.to_json(row))).alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 or more that occur elsewhere, cut at whole characters; documents left without text go."""
    key, kept = free_name(docs, "key"), free_name(docs, "kept")
    cut = suffix.cut_texts(suffix.repeated_spans(docs)).select(F.col("text_key").alias(key), F.col("kept").alias(kept))
    keyed = docs.select("*", text_key(F.col("text")).alias(key)).join(cut, key, "left")
    keyed = keyed.filter(F.col(kept).isNull() | (F.trim(F.col(kept)) != ""))
    new = {"text": F.coalesce(F.col(kept), F.col("text")), "n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)}
    return keyed.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    key = free_name(docs, "key")
    hits = winnow.find_hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("key").alias(key))
    return docs.select("*", text_key(F.col("text")).alias(key)).join(hits, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens whose shares of source, language and topic are the targets', as far as the corpus has them."""
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns])
    dims = {"source": F.col("own_source"), "lang": F.col("own_lang"), "topic": mixing.topic(F.col("own_text"))}
    mixed = mixing.mix(own, dims, mixing.TARGETS, doc="own_doc_id", text="own_text").filter("mix_kept")
    return mixed.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


STAGES = [
    ("quality classifier", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and the mixture's sums are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        made: list[str] = []
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), made)
        discard(spark, before)
        before = made
    return docs
