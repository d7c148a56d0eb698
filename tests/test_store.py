"""The store's tools end to end, statistics, dedup, fusion, grep, streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.api import Tools
from corvane.operators import dml, fusion, scan, stats, textops
from corvane.sources import store as S
from corvane.streaming import feed

AT = dt.datetime(2024, 1, 1)


def rows(spark, data):
    return spark.createDataFrame([(t, s, x, m, tags, img, AT + dt.timedelta(seconds=i)) for i, (t, s, x, m, tags, img) in enumerate(data)], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>, created_at timestamp")


def test_tools(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    bad = tools.store_context(rows(spark, [
        ("t1", "user", "# One\nhello world\n## Two\nmore", '{"k":1}', [" X ", "x", "y"], None), ("t1", "user", "# One\nhello world\n## Two\nmore", None, [], None), ("t1", "agent", "answer words", None, [], ["aGVsbG8="]),
        ("t2", "user", "other", '{"k":"A"}', ["y"], None), ("t2", "robot", "bad source", None, [], None),
    ]), atomic=False)
    assert [r["error"] for r in bad.collect()] == ["source is neither user nor agent"]
    e = st.read("entries")
    assert e.count() == 3 and e.agg(F.max("version")).first()[0] == 2
    assert [r["content_type"] for r in e.orderBy("created_at").collect()] == ["text", "multimodal", "text"]
    found = tools.search_context(tags=["Y"], metadata_filters=[{"key": "k", "operator": "eq", "value": "a"}])
    assert [r["thread_id"] for r in found["rows"].collect()] == ["t2"] and found["stats"]["filters_applied"] == 2
    assert tools.search_context(start_date="2024-02-01", end_date="2024-01-01")["validation_errors"]
    assert tools.search_context(limit=500)["clamped_limit"] == 100
    first = e.filter("thread_id = 't1' and source = 'user'").first()
    assert scan.resolve_prefix(e, first["id"][:31]) == first["id"]
    assert tools.read_context_range(first["id"], node_id="one/two")["content"] == "## Two\nmore"
    assert tools.read_context_range(first["id"], lines=(2, 2))["content"] == "hello world"
    assert [r["node_id"] for r in tools.navigate_context(first["id"]).collect()] == ["root", "one", "one/two"]
    assert tools.fts_search_context("hello", highlight=True)["rows"].first()["highlighted"].count("<mark>") == 1
    assert tools.grep_context("HELLO")["rows"].count() == 1 and tools.list_threads().count() == 2
    got = tools.get_context_by_ids([first["id"]]).first()
    assert got["tags"] == ["x", "y"]
    conflicts = tools.update_context(spark.createDataFrame([(first["id"], "s", 9)], "id string, summary string, expected_version bigint"))
    assert conflicts == [first["id"]]
    assert tools.update_context(spark.createDataFrame([(first["id"], '{"k":null,"z":2}')], "id string, patch string")) == []
    assert st.read("entries").filter(F.col("id") == first["id"]).first()["metadata"] == '{"z":2}'
    vec = spark.createDataFrame([(first["id"], 0, 0, 5, [1.0, 0.0]), (first["id"], 1, 5, 9, [0.0, 1.0])], st.read("chunks").schema)
    st.write("chunks", vec)
    near = tools.semantic_search_context([0.0, 0.9])["rows"].first()
    assert (near["start_index"], round(near["distance"], 3)) == (5, 0.1)
    assert "error" in tools.semantic_search_context([1.0])
    assert tools.hybrid_search_context("hello", [0.0, 1.0])["rows"].first()["id"] == first["id"]
    assert tools.delete_context(thread_ids=["t1"]) == 2 and st.read("tags").count() == 1 and st.read("chunks").count() == 0
    assert tools.get_statistics()["totals"].first()["total_entries"] == 1


def test_copy_rewrites_references(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    t = {n: st.read(n) for n in ("entries", "tags")}
    e = spark.createDataFrame([(i, "t", "user", "text", "x", m, None, None, 1, AT, AT) for i, m in (("1", None), ("2", '{"references":{"context_ids":[1,"2"]},"n":1}'))], t["entries"].schema)
    out = S.copy_store({"entries": e, "tags": spark.createDataFrame([("1", "a")], t["tags"].schema)})
    got = {r["text_content"] + str(r["metadata"] is None): r for r in out["entries"].collect()}
    ids = {r["old_id"]: r["new_id"] for r in S.id_map(e).collect()}
    assert ids["1"] in got["xFalse"]["metadata"] and ids["2"] in got["xFalse"]["metadata"] and '"n": 1' in got["xFalse"]["metadata"]
    assert out["tags"].first()["context_entry_id"] == ids["1"]


def test_dedup_and_statistics(spark):
    data = [("1", "t", "user", "a"), ("2", "t", "user", "a"), ("3", "t", "agent", "a"), ("4", "t", "user", "a"), ("5", "u", "user", "a")]
    e = spark.createDataFrame([(i, t, s, "text", x, f'{{"n":{i}}}' if i != "2" else None, None, None, 1, AT, AT) for i, t, s, x in data], "id string, thread_id string, source string, content_type string, text_content string, metadata string, summary string, content_hash string, version bigint, created_at timestamp, updated_at timestamp")
    got = sorted((r["id"], r["version"], r["metadata"]) for r in dml.fold_duplicates(e).collect())
    assert got == [("1", 2, '{"n":1}'), ("3", 1, '{"n":3}'), ("4", 1, '{"n":4}'), ("5", 1, '{"n":5}')]
    assert dml.would_fold(e, "t", "user", "a").first()["id"] == "4" and dml.would_fold(e, "t", "agent", "a").isEmpty()
    assert stats.average_per(e.limit(0), "thread_id").first()[0] == 0.0 and stats.summary_coverage(e).first()["coverage"] == 0.0


def test_fusion(spark):
    f = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0)], "id string, score double")
    s = spark.createDataFrame([("b", 0.1), ("d", 0.2)], "id string, distance double")
    out = fusion.hybrid(f, s)["rows"].collect()
    assert out[0]["id"] == "b" and abs(out[0]["rrf"] - (1 / 63 + 1 / 61)) < 1e-12
    assert fusion.hybrid(f, None)["warnings"] and fusion.hybrid(None, None)["error"]
    broken = fusion.rerank(fusion.leg(s, [F.asc("distance")], 10), F.col("id"), lambda t: 1 / 0)
    assert [r["id"] for r in broken.collect()] == ["b", "d"]


def test_grep(spark):
    d = spark.createDataFrame([("a", "TODO one\r\nTODO two\nx\ny"), ("b", "a.b\naxb"), ("c", None)], "id string, text_content string")
    m = textops.grep(d, "^TODO", is_regex=True, context=1).orderBy("start").collect()
    assert [(r["line_number"], r["line"], r["start"], list(r["before"]), list(r["after"])) for r in m] == [(1, "TODO one", 0, [], ["TODO two"]), (2, "TODO two", 10, ["TODO one"], ["x"])]
    assert textops.grep(d, "a.b").count() == 1 and textops.grep(d, "a.b", is_regex=True).count() == 2
    assert textops.grep(d, "one\r\nTODO").count() == 0
    assert [r["truncated"] for r in textops.grep_content(textops.grep(d, "TODO"), 1).collect()] == [True]


def test_paging(spark):
    e = spark.createDataFrame([(f"{i:02}", "x" * 10) for i in range(30)], "id string, text_content string")
    p = scan.keyset_pages(e, "20", 5).orderBy(F.desc("id")).collect()
    assert [r["id"] for r in p] == ["19", "18", "17", "16", "15"] and all(r["truncated"] for r in p)
    assert scan.keyset_pages(e, None, 100, 25).count() == 3
    assert scan.ranked_page(e, [F.asc("id")], 10, 100).count() == 0
    t = spark.createDataFrame([("a " * 200,), ("short",), ("b" * 400,)], "t string")
    got = [r[0] for r in t.select(scan.truncated(F.col("t"))).collect()]
    assert got[0] == ("a " * 200)[:300].rstrip() + "..." and got[1] == "short" and got[2] == "b" * 300 + "..."


def test_stream(spark, tmp_path):
    st = S.Store(spark, str(tmp_path / "store"))
    st.init()
    src = spark.createDataFrame([("1", "t", "user", "text", "a", None, None, None, 1, AT, AT), ("2", "t", "user", "text", "a", None, None, None, 1, AT, AT)], st.read("entries").schema)
    src.write.parquet(str(tmp_path / "in"))
    q = feed.merge_into(feed.read_feed(spark, str(tmp_path / "in")), st, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert st.read("entries").count() == 1
    q = feed.counts(feed.read_feed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("c").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("c").first()["n"] == 2


def test_repeats_keep_their_satellites(spark, tmp_path):
    """A repeat folds into the thread's newest entry with its tags; older history stays as it is; a failed table write loses nothing."""
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    one = lambda *d: tools.store_context(rows(spark, d))
    one(("t", "user", "a", None, ["x", "y"], None), ("t", "user", "b", None, [], ["iVBORw0KGgo="]))
    one(("t", "user", "b", '{"n":1}', ["z"], None), ("t", "user", "a", None, ["w"], None), ("t", "user", "a", None, [], None))
    e = st.read("entries").orderBy("id").collect()
    assert [(r["text_content"], r["version"]) for r in e] == [("a", 1), ("b", 2), ("a", 2)] and e[1]["metadata"] == '{"n":1}'
    by = {r["id"]: i for i, r in enumerate(e)}
    assert sorted((by[r["context_entry_id"]], r["tag"]) for r in st.read("tags").collect()) == [(0, "x"), (0, "y"), (1, "z"), (2, "w")]
    assert [(by[r["context_entry_id"]], r["mime_type"]) for r in st.read("images").collect()] == [(1, "image/png")]
    one(("t", "user", "a", None, ["v"], None))
    assert sorted((by[r["context_entry_id"]], r["tag"]) for r in st.read("tags").collect()) == [(0, "x"), (0, "y"), (1, "z"), (2, "v")]
    try:
        st.write("entries", st.read("entries").withColumn("text_content", F.raise_error(F.lit("no"))))
    except Exception:  # noqa: BLE001
        pass
    assert st.read("entries").count() == 3
    assert tools.update_context(spark.createDataFrame([(e[0]["id"], ["Q"])], "id string, tags array<string>")) == []
    assert [r["tag"] for r in st.read("tags").filter(F.col("context_entry_id") == e[0]["id"]).collect()] == ["q"]


def test_patch_obeys_the_version(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    tools.store_context(rows(spark, [("t", "user", "a", '{"k":{"x":1,"y":2}}', [], None)]))
    i = st.read("entries").first()["id"]
    assert tools.update_context(spark.createDataFrame([(i, '{"k":null}', 7)], "id string, patch string, expected_version bigint")) == [i]
    assert st.read("entries").first()["metadata"] == '{"k":{"x":1,"y":2}}'
    assert tools.update_context(spark.createDataFrame([(i, '{"k":{"x":null},"z":1}', 1)], "id string, patch string, expected_version bigint")) == []
    r = st.read("entries").first()
    assert r["metadata"] == '{"k":{"y":2},"z":1}' and r["version"] == 2
    out = dml.touch(st.read("entries"), st.read("entries").select("id"), F.lit("multimodal")).first()
    assert out["content_type"] == "multimodal" and out["version"] == 2 and out["updated_at"] > r["updated_at"]


def test_chunks_take_the_place_of_former_ones(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    tools.store_context(rows(spark, [("t", "user", "words " * 100, None, [], None), ("u", "user", "other", None, [], None)]))
    encoder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    S.store_chunks(st, S.chunked(st.read("entries"), encoder, 200, 20), "m")
    n = st.read("chunks").groupBy("context_id").count().orderBy("count").collect()
    assert [r["count"] for r in n] == [1, 4]
    S.store_chunks(st, S.chunked(st.read("entries").filter("thread_id = 't'"), encoder, 1000, 20), "m")
    assert sorted(r["count"] for r in st.read("chunks").groupBy("context_id").count().collect()) == [1, 1]
    assert {r["chunk_count"] for r in st.read("embedding_metadata").collect()} == {1}
    with pytest.raises(ValueError, match="dimension"):
        S.store_chunks(st, st.read("chunks").withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "m")
    tools.store_index_nodes(textops.outline_nodes(st.read("entries")).select(F.col("id").alias("context_id"), "node_id", "level", "ordinal", "title", F.lit("s").alias("node_summary"), "char_start", "char_end"))
    tools.store_index_nodes(st.read("index_nodes").limit(1).withColumn("node_summary", F.lit("new")))
    assert sorted(r["node_summary"] for r in st.read("index_nodes").collect()) == ["new", "s"]
    assert {r["has_chunks"] for r in S.chunks_exist(st, st.read("entries").select("id")).collect()} == {True}


def test_search_reads_the_index(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    tools.store_context(rows(spark, [(f"t{i}", "user", f"hello number{i} runs", None, [], None) for i in range(5)]))
    before = [r["id"] for r in tools.fts_search_context("hello running")["rows"].collect()]
    tools.build_index()
    assert tools.get_statistics()["fts"].first()["coverage"] == 100.0
    assert [r["id"] for r in tools.fts_search_context("hello running")["rows"].collect()] == before and len(before) == 5
    tools.build_index("simple")
    assert tools.fts_search_context("running")["rows"].count() == 0 and tools.fts_search_context("runs")["rows"].count() == 5
    tools.store_context(rows(spark, [("t9", "user", "hello late runs", None, [], None)]))
    assert tools._index() is not None and tools.fts_search_context("runs")["rows"].count() == 6
    assert "validation_errors" in tools.hybrid_search_context("a", None, metadata_filters=[{"key": "k", "operator": "no"}])


def test_what_cannot_be_stored(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    bad = tools.store_context(rows(spark, [("t", "user", "a\0b", None, [], None), ("t", "user", "b", "{x", [], None), ("t", "user", "c", '{"k":NaN}', [], None), ("t", "user", "d", "[1]", [], None), ("t", "user", "# A\nx\n## B\ny\n# C", '{"k":1}', [], None)]), atomic=False)
    assert sorted(r["error"] for r in bad.collect()) == ["metadata isn't a JSON object"] * 3 + ["text holds a NUL"]
    e = st.read("entries")
    tools.store_index_nodes(S.summarised_nodes(e, lambda t: f"s{len(t)}\0", least_chars=5))
    tree = tools.navigation_tree(e.first()["id"])
    assert [(x["node_id"], x["node_summary"], [y["node_id"] for y in x["children"]]) for x in tree["children"]] == [("a", "s13", ["a/b"]), ("c", None, [])]


def test_split_threads(spark):
    """Runs over ranges of a thread are those over the whole thread."""
    import random

    rng = random.Random(3)
    data = [(f"{i:04}", rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice(["user", None]), rng.choice(["a", "b"]) if i % 90 > 60 else "a") for i in range(600)]
    e = spark.createDataFrame(data, "id string, thread_id string, source string, text_content string")
    whole, parts = (sorted((r["id"], r["run"]) for r in dml.adjacent_runs(e, split=x).collect()) for x in (False, True))
    assert len(whole) == 600 and whole == parts and max(n for _, n in whole) > 20
