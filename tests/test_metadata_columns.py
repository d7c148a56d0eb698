"""Typed metadata columns: the same rows as conditions on the JSON, in the scan; declared, dropped and checked."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from corvane.api import Tools
from corvane.functions import metadata as M
from corvane.functions import metadata_columns as C
from corvane.sources.store import Store, index_metadata

from .test_metadata import STORED, VALUES


def test_names():
    keys = ["a", "A", "a.b", "a-b", "a_b", "a_db", "_a", "aB", "a__b", "a_d.b"]
    made = [C.name_of(k, "kind").lower() for k in keys]
    assert len(set(made)) == len(keys) and all(n.replace("_", "").isalnum() for n in made)
    assert C.declared("status, priority:integer,done:boolean,") == {"status": "string", "priority": "integer", "done": "boolean"}
    for bad in ("a:date", "a b", "a..b:string"):
        with pytest.raises(M.FilterError):
            C.declared(bad)


def test_all_operators(spark, tmp_path):
    """Every operator, value and stored value: columns read back from Parquet against the JSON."""
    rows = [(i, None if s is ... else json.dumps({"k": s, "O-p": {"q": s}})) for i, s in enumerate([*STORED, 2**70, -(2**63), 2**63 - 1, 1e300])] + [(90, "{}"), (91, "not json"), (92, "[]")]
    C.shred(spark.createDataFrame(rows, "i int, metadata string"), ["k", "O-p.q"]).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert C.bare(df).columns == ["i", "metadata"] and C.shred(df, []).columns == ["i", "metadata"] and C.shred(df, ["k"]).columns == df.columns[:8]
    cases = []
    for op, sens in itertools.product(M.OPERATORS, (False, True)):
        if op in ("exists", "not_exists", "is_null", "is_not_null"):
            cases.append((op, None, sens))
        elif op in ("in", "not_in"):
            cases += [(op, x, sens) for x in (["A", 5, True], [0.1, "é", 2**53], [False], [-(2**63), 1e300])]
        else:
            texts, order = op in ("contains", "starts_with", "ends_with"), op in ("gt", "gte", "lt", "lte")
            cases += [(op, v, sens) for v in [*VALUES, 1e300, -1e300, 2**63 - 1] if not (texts and not isinstance(v, str)) and not (order and isinstance(v, bool))]
    for key, asked in (("k", cases), ("O-p.q", cases[::7])):
        for part in range(0, len(asked), 40):
            some = asked[part : part + 40]
            want = df.select("i", *[M.predicate(F.col("metadata"), key, *c).alias(f"c{j}") for j, c in enumerate(some)]).orderBy("i").collect()
            got = df.select("i", *[F.coalesce(C.predicate(key, *c), F.lit(False)).alias(f"c{j}") for j, c in enumerate(some)]).orderBy("i").collect()
            for j, c in enumerate(some):
                assert [r[j + 1] for r in got] == [r[j + 1] for r in want], (key, c)
    with pytest.raises(M.FilterError):
        C.predicate("k", "in", [])


def test_misfits(spark):
    values = ["1", "-7", "2147483648", "1.5", "true", '"5"', '"x"', "null", "[1]", '{"a":1}', '"off"', '"0x1F"']
    df = spark.createDataFrame([(i, f'{{"k":{v}}}') for i, v in enumerate(values)] + [(50, "{}"), (51, None)], "i int, m string").orderBy("i")
    bad = {k: [r[0] for r in df.filter(C.misfit(F.col("m"), "k", k)).collect()] for k in C.KINDS}
    assert bad == {"string": [], "integer": [2, 3, 4, 6, 8, 9, 10, 11], "number": [4, 6, 8, 9, 10], "boolean": [1, 2, 3, 5, 6, 8, 9, 11]}


def opened(spark, path):
    st = Store(spark, str(path), buckets=4)
    st.init()
    return st, Tools(st, "simple")


def put(spark, tools, data, atomic=True):
    rows = spark.createDataFrame([(t, "user", x, m, None, None) for t, x, m in data], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>")
    return tools.store_context(rows, atomic)


def test_store(spark, tmp_path):
    """Columns follow writes, updates and deletions; the scan gets the comparison; other keys are read from the JSON."""
    st, tools = opened(spark, tmp_path)
    put(spark, tools, [(f"t{i}", f"text {i}", json.dumps({"n": i, "s": f"S{i % 3}", "o": i})) for i in range(40)])
    assert index_metadata(st, {"n": "integer", "s": "string"}) == {"missing": ["n", "s"], "extra": []}
    put(spark, tools, [("u", "more", '{"n": 39, "o": 1}')])
    found = lambda *fs: sorted(r["text_content"] for r in tools.search_context(limit=100, metadata_filters=list(fs))["rows"].collect())
    assert found({"key": "n", "operator": "gte", "value": 38}) == ["more", "text 38", "text 39"]
    assert found({"key": "n", "operator": "gte", "value": 30}, {"key": "s", "operator": "eq", "value": "s1"}, {"key": "o", "operator": "lt", "value": 35}) == ["text 31", "text 34"]
    rows = tools.search_context(metadata_filters=[{"key": "n", "operator": "gt", "value": 37}, {"key": "s", "operator": "starts_with", "value": "S"}])["rows"]
    assert rows.columns == st.read("entries").columns
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = rows._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(_meta_whole_n,37)" in pushed and "StringStartsWith(_meta_low_s,s)" in pushed and "parse_json" not in plan.split("== Physical Plan ==")[1]
    one = tools.search_context(metadata_filters=[{"key": "n", "operator": "eq", "value": 38}])["rows"].first()["id"]
    tools.update_context(spark.createDataFrame([(one, '{"n": 7000}')], "id string, patch string"))
    assert found({"key": "n", "operator": "gte", "value": 39}) == ["more", "text 38", "text 39"] and found({"key": "n", "operator": "eq", "value": 38}) == []
    with pytest.raises(ValueError, match="n is no integer"):
        tools.update_context(spark.createDataFrame([(one, '{"n": "x"}')], "id string, patch string"))
    tools.delete_context(ids=spark.createDataFrame([(one,)], "id string"))
    assert found({"key": "n", "operator": "gt", "value": 39}) == []
    assert [r["error"] for r in put(spark, tools, [("v", "bad", '{"n": 1.5}')]).collect()] == ["metadata n is no integer"]


def test_modes(spark, tmp_path):
    st, tools = opened(spark, tmp_path)
    put(spark, tools, [("a", "one", '{"x": 1, "y": "b"}'), ("b", "two", '{"x": "word"}')])
    with pytest.raises(ValueError, match="1 entries have a x that is no integer"):
        index_metadata(st, {"x": "integer"})
    with pytest.raises(ValueError, match="missing"):
        index_metadata(st, {"y": "string"}, "strict")
    with pytest.raises(ValueError, match="no mode"):
        index_metadata(st, {}, "never")
    assert st.snapshot().typed == {} and index_metadata(st, {"y": "string"}, "warn")["missing"] == ["y"] and st.snapshot().typed == {}
    index_metadata(st, {"y": "string"})
    assert index_metadata(st, {"x": "string"}) == {"missing": ["x"], "extra": ["y"]} and set(st.snapshot().typed) == {"x", "y"}
    assert index_metadata(st, {"x": "string"}, "auto")["extra"] == ["y"] and set(st.snapshot().typed) == {"x"}
    before = st.snapshot().number
    assert index_metadata(st, {"x": "string"}, "strict") == {"missing": [], "extra": []} and st.read("entries").count() == 2
    assert st.snapshot().number - before <= 1
    assert [r["text_content"] for r in tools.search_context(metadata={"x": "word"})["rows"].collect()] == ["two"]
