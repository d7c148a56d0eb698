"""Postings are made where a text is read: no word is shuffled alone, and none is stemmed twice in a batch."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import fts
from corvane.sources import commits, text_index
from corvane.sources.store import Store

TEXTS = ["Die Häuser, das Haus; die Haeuser", None, "", "haus " * 7 + "ende", "...", "Houses housed a house", "haus"]


def test_each_distinct_word_is_stemmed_once():
    asked = Counter()

    def cut(w):
        asked[w] += 1
        return w[:4]

    got = tx.stemmed(pa.array(["house", "houses", "house", "a", "houses"] * 1000), cut)
    assert got.to_pylist() == ["hous", "hous", "hous", "a", "hous"] * 1000 and asked == {"house": 1, "houses": 1, "a": 1}
    assert got.dictionary.to_pylist() == ["hous", "a"]
    assert tx.stemmed(pa.array([], pa.string()), cut).to_pylist() == []


@pytest.mark.parametrize("most", [1, 500_000])
@pytest.mark.parametrize("language", ["simple", "german", "english"])
def test_postings(spark, monkeypatch, language, most):
    """Against a plain loop; a batch is cut into runs of words between texts, with the same rows."""
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text_content string").repartition(1)
    b = d.toArrow().combine_chunks().to_batches()[0]
    cut = tx.stemmer(language)
    own = {i: [(cut or str)(w) for w, _, _ in fts.tokenize(t or "", tx.plain(language))] for i, t in zip(*(b.column(c).to_pylist() for c in ("id", "text_content")), strict=True)}
    want = sorted((w, i, len(ws), ws.count(w), [k for k, x in enumerate(ws) if x == w]) for i, ws in own.items() for w in set(ws))
    monkeypatch.setattr(fts, "WORDS", most)  # of the functions that travel by value
    p = fts.postings(d, language=language)
    assert sorted((r["term"], r["doc"], r["dl"], r["tf"], r["positions"]) for r in p.collect()) == want
    assert "Exchange hash" not in p._jdf.queryExecution().executedPlan().toString()


def test_slices():
    ids, ts = pa.array(["a", "b", "c", "d"]), pa.array([["x", "y", "x"], [], ["y"], ["z", "x"]], pa.list_(pa.string()))
    whole = pa.RecordBatch.from_arrays([ids, ts], names=["doc", "ts"])
    order = lambda rows: sorted(rows, key=lambda r: (r["doc"], r["positions"]))
    rows = order(fts._counted(whole, None, 4).to_pylist())
    assert rows == order([r for k in range(4) for r in fts._counted(whole.slice(k, 1), None, 4).to_pylist()])
    assert [(r["doc"], r["term"], r["dl"], r["tf"], r["positions"]) for r in rows] == [("a", "x", 3, 2, [0, 2]), ("a", "y", 3, 1, [1]), ("c", "y", 1, 1, [0]), ("d", "z", 2, 1, [0]), ("d", "x", 2, 1, [1])]


@pytest.mark.parametrize(("block", "spread"), [(2, 1), (500_000, 3)])
def test_postings_travel_in_blocks(spark, monkeypatch, block, spread):
    """The index has the rows of postings(), with whole buckets in order; what is shuffled are blocks."""
    monkeypatch.setattr(text_index, "BLOCK", block)
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS * 3)], "id string, text_content string")
    rows, _ = text_index.tables(d, "german", spread=spread, segment=4)
    key = lambda r: (r["term"], r["doc"], r["bucket"], r["dl"], r["tf"], r["positions"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, fts.postings(d, language="german").collect()))
    assert {r["seg"] for r in rows.collect()} == {4} and rows.columns == ["doc", "term", "dl", "tf", "positions", "bucket", "seg"]
    got = [[(r["bucket"], r["term"], r["doc"]) for r in part] for part in rows.rdd.glom().collect()]
    assert all(p == sorted(p) for p in got)
    assert "Exchange hashpartitioning(deal" in rows._jdf.queryExecution().executedPlan().toString()
    assert text_index.tables(d.limit(0), "german")[0].collect() == []


def test_buckets_are_those_of_searches(spark):
    d = spark.createDataFrame([(1, "Straße été 東京 a b c d e f")], "id int, text_content string")
    rows = fts.postings(d, language="german")
    assert rows.filter(rows.bucket != text_index.bucket(rows.term)).isEmpty() and rows.count() == 9


def test_an_index_dealt_otherwise_counts_as_none(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    text_index.build(st, spark.createDataFrame([(1, "one")], "id int, text_content string"), "simple")
    assert text_index.open_index(st, "simple")
    st.commit(lambda tx: tx.state["tables"]["fts_postings"].pop("hash"))
    assert text_index.open_index(st, "simple") is None


def test_tokens_are_counted_as_they_are_made(spark):
    texts = [(None,), ("",), ("İstanbul ÀÉ o'clock",), ("á b ǅ ß 東京 １２",), ("x-y_z  1,2",)]
    d = spark.createDataFrame(texts, "t string")
    assert d.filter(tx.token_count(F.col("t")) != F.size(tx.tokens(F.col("t")))).isEmpty()
    assert d.filter(tx.token_count(F.col("t")) != F.size(tx.tokens(F.col("t"), False))).isEmpty()


def test_blocks_are_small(spark):
    """Documents and terms of a block travel once, positions as steps: under four bytes a posting, of all columns."""
    b = spark.createDataFrame([(f"d{i:012}", " ".join(f"w{(i * j) % 97}" for j in range(200))) for i in range(300)], "id string, text_content string").repartition(1)
    own = fts.words(b, "id", "text_content", "simple").toArrow().combine_chunks().to_batches()
    made = list(fts.counted("simple", 4)(own))
    blocks = list(text_index.packed(made))
    n = sum(x.num_rows for x in made)
    assert sum(len(x) for x in blocks[0].column("block").to_pylist()) < 4 * n
    key = lambda rows: sorted((r["doc"], r["term"], r["dl"], r["positions"], r["bucket"]) for r in rows)
    assert key(r for x in text_index.unpacked(blocks) for r in x.to_pylist()) == key(r for x in made for r in x.to_pylist())


def test_a_large_bucket_becomes_several_tasks(spark):
    """What one task sorts is bounded by Spark's advisory size, not by a bucket's share of the input."""
    d = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 9973}" for j in range(100))) for i in range(800)], "id int, text_content string").repartition(8)
    with commits.setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k"):
        rows, _ = text_index.tables(d, "english", buckets=1)
        parts = [p for p in rows.rdd.glom().collect() if p]
    assert len(parts) > 2 and max(map(len, parts)) < sum(map(len, parts)) / 2
    assert all([(r["term"], r["doc"]) for r in p] == sorted((r["term"], r["doc"]) for r in p) for p in parts)
    key = lambda r: (r["term"], r["doc"], r["dl"], r["tf"], r["positions"])
    assert sorted(key(r) for p in parts for r in p) == sorted(map(key, fts.postings(d, language="english").collect()))


@pytest.mark.parametrize(("own", "seen"), [(None, "500"), ("7", "7"), ("0", "500")])
def test_postings_are_written_by_few_rows_at_a_time(spark, tmp_path, monkeypatch, own, seen):
    key, write, at = "spark.sql.execution.arrow.maxRecordsPerBatch", commits.Transaction.write, {}

    def spy(tx, name, *args, **options):
        at[name] = spark.conf.get(key, None)
        write(tx, name, *args, **options)

    monkeypatch.setattr(commits.Transaction, "write", spy)
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, own) if own else spark.conf.unset(key)
        st = Store(spark, str(tmp_path))
        text_index.build(st, spark.createDataFrame([(1, "one")], "id int, text_content string"), "simple")
        assert at["fts_postings"] == seen and at["fts_lengths"] == own == spark.conf.get(key, None)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
