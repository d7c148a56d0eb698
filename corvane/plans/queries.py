"""Registered queries: the library's operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as meta
from ..functions import metadata_columns
from ..functions import text as tx
from ..operators import dml, filters, fts, fusion, quant, scan, stats, textops, vector
from ..session import shared_dir
from ..api import Tools
from ..sources import derived, generation, text_index
from ..sources.store import Store, index_metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """events as entries: the user is the thread, the type the source, props the metadata."""
    return table(spark, d, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("user_id").cast("string").alias("thread_id"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 5 == 0, "multimodal").otherwise("text").alias("content_type"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("metadata"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("summary"), "value",
    )


def chats(spark: SparkSession, d: str) -> DataFrame:
    """conversations as entries."""
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))
    return c.select(
        F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.when(F.col("role") == "user", "user").otherwise("agent").alias("source"),
        F.lit("text").alias("content_type"), F.col("text").alias("text_content"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("summary"), F.sha2("text", 256).alias("content_hash"), F.lit(1).cast("bigint").alias("version"),
        at.alias("created_at"), at.alias("updated_at"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_content"), "lang", "source")


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Language and source of a document as its tags."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("context_entry_id"), F.explode(F.array("lang", "source")).alias("tag")).filter("tag is not null")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as chunks: ten vectors make an entry."""
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("context_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_index"), (F.col("vec_id") % 10 * 100).cast("int").alias("start_index"), (F.col("vec_id") % 10 * 100 + 100).cast("int").alias("end_index"), "embedding", "label")


#: A fixed query vector of 64 dimensions, by rule.
Q = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]


@query
def scan_filter_topk(spark, d):
    r = scan.search_context(events(spark, d), limit=50, start_date="2020-01-01", metadata_filters=[{"key": "k", "operator": "gt", "value": 50}])["rows"]
    return r.select("id", "thread_id", "source", "metadata")


@query
def scan_date_range(spark, d):
    """Both bounds given, the end as a day that counts whole."""
    e = filters.apply_filters(events(spark, d), start_date="2024-01-02", end_date="2024-01-20", source="click")
    return e.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def scan_offset_page(spark, d):
    return scan.page(events(spark, d), scan.newest_first(), 20, 40).select("id", "source")


@query
def ranked_page(spark, d):
    return scan.ranked_page(events(spark, d), [F.desc("value"), F.asc("id")], 20, 90).select("id", "value")


@query
def keyset_page(spark, d):
    return scan.keyset_pages(chats(spark, d), None, 200, 20_000).select("id", "truncated")


@query
def lookup_ids(spark, d):
    return scan.by_ids(events(spark, d), [str(i).rjust(12, "0") for i in (3, 77, 500, 999999999)]).select("id", "source")


@query
def prefix_lookup(spark, d):
    return scan.by_prefix(events(spark, d), "00000000012", 5)


@query
def display_format(spark, d):
    e = chats(spark, d)
    return scan.display(e).select("id", "text_content", "is_truncated", "summary", "created_at")


def typed(spark, d) -> DataFrame:
    """documents as entries with metadata of all kinds: a rule over the id decides the kind of v, the row's columns its value."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), F.col("n_chars").cast("string").alias("n"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    i = F.col("id").cast("string")
    kinds = [
        F.col("n"), F.concat("n", F.lit(".5")), F.concat(F.lit("-"), i), q(F.col("l")), q(F.upper("l")), q(F.col("s")), q(F.col("n")), F.concat(F.lit("["), "n", F.lit(","), q(F.col("l")), F.lit(",true]")), F.concat(F.lit("["), q(F.upper("l")), F.lit(","), i, F.lit("]")),
        F.lit('{"b":1}'), F.lit("null"), F.when(F.col("id") % 2 == 0, "true").otherwise("false"),
    ]
    v = F.element_at(F.array(*kinds), (F.col("id") % 13 + 1).cast("int"))
    return t.select("id", F.when(F.col("id") % 13 == 12, F.lit("{}")).otherwise(F.concat(F.lit('{"v":'), v, F.lit("}"))).alias("metadata"))


def _meta(name: str, op: str, value: object, rows: Callable, key: str) -> None:
    def run(spark, d):
        return rows(spark, d).filter(meta.predicate(F.col("metadata"), key, op, value)).select("id", "metadata")

    run.__name__ = f"meta_{name}"
    query(run)


for _n, _op, _v in (
    ("eq", "eq", 7), ("ne", "ne", 7), ("gt", "gt", 90), ("gte", "gte", 90.5), ("lt", "lt", 5), ("lte", "lte", 4.5), ("in", "in", [1, 2, "3"]), ("not_in", "not_in", [1, 2]), ("exists", "exists", None), ("is_not_null", "is_not_null", None),
):
    _meta(_n, _op, _v, events, "k")

#: Operators and values over typed(); the SQL has the same list.
TYPED = [("not_exists", None), ("is_null", None), ("contains", "RC"), ("starts_with", "D"), ("ends_with", "3"), ("array_contains", "DE")]
for _op, _v in TYPED:
    _meta(_op, _op, _v, typed, "v")

#: (name, operator, value) of the matrix; the SQL has the same list.
MATRIX = [
    ("eq_de", "eq", "DE"), ("eq_n", "eq", 500), ("eq_true", "eq", True), ("ne_de", "ne", "de"), ("gt_0", "gt", 0), ("gt_f", "gt", 99.75), ("lt_f", "lt", -99.5), ("gte_s", "gte", "en"),
    ("in_mix", "in", ["FR", "src1", 500, True]), ("not_in_mix", "not_in", ["FR", "src1", 500, True]), ("has", "exists", None), ("hasnt", "not_exists", None), ("null", "is_null", None), ("contains", "contains", "C1"), ("starts", "starts_with", "S"), ("ends", "ends_with", "N"),
    ("arr_en", "array_contains", "en"), ("arr_60", "array_contains", 60), ("arr_true", "array_contains", True),
]


@query
def meta_typed_matrix(spark, d):
    return typed(spark, d).select("id", *[meta.predicate(F.col("metadata"), "v", op, v).alias(n) for n, op, v in MATRIX])


@query
def tags_any_semi(spark, d):
    e = documents(spark, d)
    return e.join(tags(spark, d).filter(F.col("tag").isin(filters.clean_tags([" DE ", "src3"]))).select(F.col("context_entry_id").alias("id")), "id", "left_semi").select("id")


@query
def tags_of_entries(spark, d):
    t = scan.tags_of(documents(spark, d), tags(spark, d))
    return t.select("id", F.array_join("tags", ",").alias("tags"))


@query
def missing_embeddings_anti(spark, d):
    have = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return documents(spark, d).join(have, "id", "left_anti").select("id")


@query
def thread_list(spark, d):
    return stats.thread_list(events(spark, d))


@query
def counts_by_source(spark, d):
    return stats.counts_by(events(spark, d), "source")


@query
def counts_by_content_type(spark, d):
    return stats.counts_by(events(spark, d), "content_type")


@query
def totals(spark, d):
    return stats.totals(events(spark, d))


@query
def avg_per_thread(spark, d):
    return stats.average_per(events(spark, d), "thread_id")


@query
def top_threads(spark, d):
    return stats.top(events(spark, d), "thread_id", 5)


@query
def top_tags(spark, d):
    return stats.top(tags(spark, d), "tag", 10)


@query
def tag_statistics(spark, d):
    return stats.tag_statistics(tags(spark, d))


@query
def thread_statistics(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("thread_id"), F.when(F.col("doc_id") % 2 == 0, "user").otherwise("agent").alias("source"), F.lit("text").alias("content_type"))
    images = table(spark, d, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("context_entry_id"), F.lit(0).alias("position"))
    r = stats.thread_statistics(e, tags(spark, d), images, "de")
    return r.withColumn("tags", F.array_join("tags", ","))


@query
def summary_coverage(spark, d):
    return stats.summary_coverage(events(spark, d))


@query
def embedding_statistics(spark, d):
    m = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("context_id")).agg(F.count("*").cast("int").alias("chunk_count"), F.max(F.size("embedding")).alias("dimensions"))
    return stats.embedding_stats(documents(spark, d), m)


@query
def adjacent_dedup(spark, d):
    return dml.fold_duplicates(_repeated(spark, d), split=True).select("id", "thread_id", "source", "version", F.length("text_content").cast("bigint").alias("n_chars"))


def _repeated(spark, d):
    """chats with every third turn stored twice in a row."""
    c = chats(spark, d)
    again = c.filter(F.substring("id", -1, 1).isin("0", "3", "6")).withColumn("id", F.concat("id", F.lit("x")))
    return c.unionByName(again)


@query
def latest_per_thread_source(spark, d):
    return chats(spark, d).groupBy("thread_id", "source").agg(F.max("id").alias("id"), F.max_by("content_hash", "id").alias("content_hash"))


@query
def content_hash(spark, d):
    return documents(spark, d).select("id", tx.content_hash(F.col("text_content")).alias("content_hash"))


@query
def merge_patch_flat(spark, d):
    patch = F.concat(F.lit('{"k":'), F.when(F.col("id") % 2 == 0, "null").otherwise("1"), F.lit(',"n":'), F.col("id").cast("string"), F.lit("}"))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "props").withColumn("patch", patch)
    return e.select("id", tx.merge_patch("props", "patch").alias("metadata"))


@query
def merge_patch_nested(spark, d):
    patch = F.concat(F.lit('{"k":null,"a":{"b":{"c":'), F.col("id").cast("string"), F.lit(',"d":null},"e":[1,null]}}'))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit('{"k":1,"a":{"b":{"d":2,"f":3}}}').alias("props")).withColumn("patch", patch)
    return e.select("id", tx.merge_patch("props", "patch").alias("metadata"))


@query
def tags_replaced(spark, d):
    """Even entries get new tags, every fourth loses all."""
    given = documents(spark, d).filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" New "), F.lit("new"), F.col("lang"))).alias("tags"))
    return dml.replace_tags(tags(spark, d), given).select("context_entry_id", "tag")


@query
def retention_delete(spark, d):
    e = events(spark, d)
    doomed = dml.matching(e, thread_ids=[str(i) for i in range(50)], older_than_days=5, now=F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return dml.delete({"entries": e}, doomed)["entries"].select("id")


@query
def version_update(spark, d):
    e = chats(spark, d)
    changes = e.filter(F.length("text_content") > 400).select("id", F.lit("short").alias("summary"), F.when(F.length("text_content") % 2 == 0, 1).otherwise(2).cast("bigint").alias("expected_version"))
    return dml.update(e, changes)[0].select("id", "version", F.coalesce("summary", F.lit("")).alias("summary"))


@query
def knn_l2(spark, d):
    s = vector.distances(table(spark, d, "embeddings"), Q).select("vec_id", F.round("distance", 6).alias("distance"))
    return s.orderBy("distance", "vec_id").limit(20)


@query
def knn_filtered(spark, d):
    s = vector.distances(table(spark, d, "embeddings").filter("label % 3 = 0"), Q).select("vec_id", F.round("distance", 6).alias("distance"))
    return s.orderBy("distance", "vec_id").limit(20)


@query
def best_chunk_per_entry(spark, d):
    b = vector.search(chunks(spark, d), Q)
    return b.select("context_id", F.round("distance", 6).alias("distance"), "start_index", "end_index")


@query
def knn_many(spark, d):
    """Five nearest entries of every vector whose id is divisible by 20."""
    q = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.search_many(chunks(spark, d), q, 5).select("query_id", "rank", "context_id", F.round("distance", 5).alias("distance"))


@query
def quantized_knn(spark, d):
    q = quant.Quantizer(64, 4, "ip")
    return quant.search(quant.compress(chunks(spark, d).drop("label"), q), Q, q).orderBy(*vector.nearest()).limit(20)


@query
def quantized_size(spark, d):
    return stats.payload_bytes(quant.compress(chunks(spark, d).drop("label"), quant.Quantizer(64, 3, "mse")))


#: Indexes of the documents, by session and folder; written once to the shared folder, like the full-text table of a store.
INDEXES: dict[tuple[str, str, str], text_index.TextIndex] = {}


def index(spark, d, language: str = "simple") -> text_index.TextIndex:
    """The full-text index of the documents; built at its first use in a session."""
    key = (spark.sparkContext.applicationId, d, language)
    if key not in INDEXES:
        store = Store(spark, f"{shared_dir(spark)}/fts-{len(INDEXES)}-{uuid.uuid4().hex}")
        text_index.build(store, documents(spark, d), language)
        INDEXES[key] = text_index.open_index(store, language)
    return INDEXES[key]


def _fts(name: str, text: str, mode: str):
    def run(spark, d):
        return index(spark, d).search(fts.parse(text, mode, "simple")).select("id", F.round("score", 6).alias("score"))

    run.__name__ = name
    query(run)


_fts("fts_match", "that with", "match")
_fts("fts_prefix", "tha wit", "prefix")
_fts("fts_phrase", "of the", "phrase")
_fts("fts_boolean", '("of the" OR with) AND that NOT clown', "boolean")


@query
def fts_bm25_topk(spark, d):
    h = index(spark, d).search(fts.parse("for was only", "match", "simple")).withColumn("score", F.round("score", 6))
    return h.orderBy(*fts.ranked(h)).limit(20)


@query
def fts_hybrid_words(spark, d):
    """The full-text leg of a hybrid search of many words: any of them."""
    h = index(spark, d).search(fts.hybrid_query("for was only that with", language="simple"))
    return h.select("id", F.round("score", 6).alias("score"))


@query
def fts_scan(spark, d):
    """The search without an index, over the texts."""
    return fts.search(documents(spark, d), "that with", "match", "simple").select("id", F.round("score", 6).alias("score"))


@query
def fts_stemmed(spark, d):
    return index(spark, d, "english").search(fts.parse("thats oner", "match", "english"))


@query
def fts_german(spark, d):
    return index(spark, d, "german").search(fts.parse("einen nichtes", "match", "german"))


@query
def fts_french(spark, d):
    return fts.search(documents(spark, d), "mentonne dans", "match", "french")


@query
def fts_spanish(spark, d):
    return fts.search(documents(spark, d), "paras conos", "match", "spanish")


@query
def stem_counts(spark, d):
    """Stems of each language's documents: in how many, how often, of how many words."""
    names = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}  # fixed values: the languages of the table
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("lang")]
    each = documents(spark, d).select("id", "lang", F.explode(tx.terms_by_row(F.col("text_content"), named)).alias("t")).select("id", "lang", "t.*")
    return each.groupBy("lang", "stem").agg(F.countDistinct("id").alias("df"), F.count("*").alias("cf"), F.countDistinct("word").alias("forms"))


@query
def fts_cover_density(spark, d):
    return index(spark, d).cover_rank("that with").select("id", F.round("score", 9).alias("score"))


@query
def fts_postings(spark, d):
    p = fts.postings(documents(spark, d))
    return p.groupBy("term").agg(F.countDistinct("doc").alias("df"), F.sum("tf").alias("cf"))


def _marked(spark, d) -> DataFrame:
    """The twenty best hits with their texts, plain and marked; the hits are broadcast, so no text is shuffled."""
    tree = fts.parse("that with", "match", "simple")
    h = index(spark, d).search(tree)
    top = documents(spark, d).join(F.broadcast(h.orderBy(*fts.ranked(h)).limit(20)), "id")
    return top.select("id", "text_content", fts.highlight(F.col("text_content"), tree).alias("highlighted"))


@query
def fts_highlight(spark, d):
    return _marked(spark, d).select("id", "highlighted")


def _legs(spark, d):
    h = index(spark, d).search(fts.parse("for was only", "match", "simple")).withColumn("score", F.round("score", 6))
    s = vector.distances(table(spark, d, "embeddings"), Q).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"))
    return h, s


@query
def hybrid_rrf(spark, d):
    return fusion.hybrid(*_legs(spark, d))["rows"].select("id", F.round("rrf", 9).alias("rrf"), "fts_rank", "semantic_rank", "fts_score", "semantic_distance")


@query
def fusion_overlap(spark, d):
    h, s = _legs(spark, d)
    return fusion.overlap(fusion.rrf(fusion.leg(h, fts.ranked(h), 200), fusion.leg(s, [F.asc("distance"), F.asc("id")], 200)))


@query
def hybrid_rerank(spark, d):
    """Full-text hits are read by the passage around their matches, others by the chunk that matched."""
    from pyspark.sql import Window

    words = index(spark, d).search(fts.parse("for was only", "match", "simple"))
    near = vector.search(chunks(spark, d), Q).withColumnRenamed("context_id", "id")
    rows = fusion.hybrid(words, near)["rows"].join(documents(spark, d), "id").join(near.select("id", "start_index", "end_index"), "id", "left")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*fusion.best_first())))  # at most 100 rows
    tree = fts.parse("for was only", "match", "simple")
    marked = F.when(F.col("fts_rank").isNotNull(), fts.highlight(F.col("text_content"), tree))
    passage = textops.rerank_text(F.col("text_content"), marked, F.col("start_index"), F.col("end_index"))
    return fusion.rerank(ranked, passage, fusion.lexical_scorer("for was only")).select("id", "rank", "rerank_score")


@query
def grep_files(spark, d):
    return textops.grep_files(textops.grep(documents(spark, d), "disgusting", case_sensitive=True))


@query
def grep_count(spark, d):
    return textops.grep_counts(textops.grep(documents(spark, d), r"\bthe th[a-z]+", is_regex=True, case_sensitive=True))


@query
def grep_content(spark, d):
    m = textops.grep(documents(spark, d), "idiot", context=1)
    return textops.grep_content(m, 100).select("id", "line_number", "line", "start", "end", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"), "truncated")


@query
def read_range(spark, d):
    r = documents(spark, d).select("id", textops.read_chars(F.col("text_content"), 10, 60).alias("r"))
    return r.select("id", "r.char_start", "r.char_end", "r.content", "r.line_start", "r.line_end")


@query
def line_range(spark, d):
    t = F.col("text_content")
    return documents(spark, d).select("id", textops.line_count(t).cast("bigint").alias("lines"), textops.read_lines(t, 2, 3).alias("content"))


def _sections(spark, d):
    return documents(spark, d).withColumn("text_content", F.concat(F.lit("# "), F.regexp_replace("text_content", "\n", "\n\n## ")))


@query
def outline_nodes(spark, d):
    """Outlines of the documents, each line made a section."""
    return textops.outline_nodes(_sections(spark, d))


@query
def outline_counts(spark, d):
    n = textops.outline_nodes(_sections(spark, d), max_depth=1)
    return n.groupBy("id").agg(F.count("*").alias("nodes"), F.max("char_end").cast("bigint").alias("n_chars"))


@query
def chunk_text(spark, d):
    return textops.chunk_rows(documents(spark, d)).select("id", "chunk_index", "start_index", "end_index")


@query
def passage_windows(spark, d):
    return _marked(spark, d).select("id", textops.passage_column(F.col("text_content"), F.col("highlighted")).alias("passage"))


@query
def uuid7_ids(spark, d):
    e = events(spark, d)
    return e.select("id", tx.uuid7(F.col("created_at"), F.col("id")).alias("uuid")).select("id", F.length("uuid").alias("digits"), F.substring("uuid", 13, 1).alias("version"), F.conv(F.substring("uuid", 1, 12), 16, 10).cast("bigint").alias("millis"))


#: Stores that have been written to, by session and folder.
WRITTEN: dict[tuple[str, str], Store] = {}


def _letters(texts: list[str]) -> list[list[float]]:
    """An encoder that needs no model: counts of four kinds of characters."""
    return [[float(sum(map(t.count, k))) for k in ("aeiou", "nrst", " ,.", "0123456789")] for t in texts]


def written(spark, d) -> Store:
    """A store of the documents with chunks and index, in which German ones were then revised, those of one source deleted, and all turns of conversations stored."""
    key = (spark.sparkContext.applicationId, d)
    if key not in WRITTEN:
        store = Store(spark, f"{shared_dir(spark)}/written-{len(WRITTEN)}-{uuid.uuid4().hex}")
        store.init()
        tools = Tools(store, "simple", generation.Makers(_letters, "letters"))
        docs = table(spark, d, "documents").withColumn("id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
        turns = chats(spark, d).withColumn("id", F.concat(F.lit("c"), "id"))

        def rows(of: DataFrame, text: str) -> DataFrame:
            null, at = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
            return of.select("id", F.col("id").alias("thread_id"), F.lit("user").alias("source"), F.lit("text").alias("content_type"), F.col(text).alias("text_content"), null.alias("metadata"), null.alias("summary"), null.alias("content_hash"), F.lit(1).cast("bigint").alias("version"), at.alias("created_at"), at.alias("updated_at"))

        tools.put_entries(rows(docs, "text"))
        tools.build_index()
        tools.update_context(docs.filter("lang = 'de'").select("id", F.concat("text", F.lit(" Revised, that with this.")).alias("text_content")))
        tools.delete_context(ids=docs.filter("source = 'src3'").select("id"))
        tools.put_entries(rows(turns, "text_content"))
        WRITTEN[key] = store
    return WRITTEN[key]


@query
def entries_after_writes(spark, d):
    e = written(spark, d).read("entries")
    return e.select("id", "version", "content_hash", F.length("text_content").cast("bigint").alias("n_chars"))


@query
def chunks_after_writes(spark, d):
    """What the chunks of each entry span, and the text that they were made from."""
    at = written(spark, d).snapshot()
    span = derived.current(at, "chunks").groupBy("context_id").agg(F.min("start_index").alias("first"), F.max("end_index").alias("last"))
    made = at.read("derivations").filter("kind = 'chunks'")
    return made.join(span, "context_id", "left").select(F.col("context_id").alias("id"), "content_hash", "first", "last")


@query
def fts_after_writes(spark, d):
    found = text_index.open_index(written(spark, d), "simple")
    return found.search(fts.parse("that with", "match", "simple")).select("id", F.round("score", 6).alias("score"))


#: Stores whose entries carry typed metadata columns, by session and folder.
SHREDDED: dict[tuple[str, str], Store] = {}


def shredded(spark, d) -> Store:
    """A store of typed() whose key v has columns; one half is written before the key is declared, the other after it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in SHREDDED:
        store = Store(spark, f"{shared_dir(spark)}/shredded-{len(SHREDDED)}-{uuid.uuid4().hex}")
        store.init()
        null, at = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
        rows = typed(spark, d).select(
            F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("thread_id"), F.lit("user").alias("source"), F.lit("text").alias("content_type"), F.lit("text").alias("text_content"), "metadata",
            null.alias("summary"), null.alias("content_hash"), F.lit(1).cast("bigint").alias("version"), at.alias("created_at"), at.alias("updated_at"),
        )
        early = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
        Tools(store, "simple").put_entries(rows.filter(early))
        index_metadata(store, {"v": "string"})
        Tools(store, "simple").put_entries(rows.filter(~early))
        SHREDDED[key] = store
    return SHREDDED[key]


@query
def meta_columns_matrix(spark, d):
    """The matrix of meta_typed_matrix on typed columns."""
    e = shredded(spark, d).snapshot().read("entries", typed=True)
    return e.select(F.col("id").cast("bigint").alias("id"), *[F.coalesce(metadata_columns.predicate("v", op, v), F.lit(False)).alias(n) for n, op, v in MATRIX])


@query
def meta_columns_search(spark, d):
    """A filtered search by two conditions on typed columns, which the scan takes."""
    conditions = [{"key": "v", "operator": "gt", "value": 100}, {"key": "v", "operator": "lte", "value": 5000.5}]
    found = filters.apply_filters(shredded(spark, d).snapshot().read("entries", typed=True), metadata_filters=conditions)
    return found.select(F.col("id").cast("bigint").alias("id"), "metadata")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
