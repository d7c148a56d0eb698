"""Entries that change or go are noted as void; their neighbours' files stay, and no text is shuffled to find them."""

import datetime as dt

from corvane.api import Tools
from corvane.sources import commits
from corvane.sources import store as S

AT = dt.datetime(2024, 1, 1)


def test_writes_leave_other_rows_where_they_are(spark, tmp_path):
    """Against plain dictionaries; more than a word of 64 rows to a file."""
    st = S.Store(spark, str(tmp_path), buckets=2)
    st.init()
    tools = Tools(st)
    rows = lambda ns: spark.createDataFrame([(f"{i:04}", f"t{i}", "user", "text", f"text {i}", None, None, None, 1, AT, AT) for i in ns], S.TABLES["entries"])
    tools.put_entries(rows(range(400)))
    want, first = {f"{i:04}": f"text {i}" for i in range(400)}, st.snapshot()
    have = lambda: {r["id"]: r["text_content"] for r in st.read("entries").collect()}
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "entries").rglob("*.parquet")}
    had = files()
    gone = [f"{i:04}" for i in range(0, 400, 7)]
    assert tools.delete_context(ids=gone) == len(gone)
    want = {k: v for k, v in want.items() if k not in gone}
    assert have() == want and files() == had and st.snapshot().parts("entries") == first.parts("entries")
    tools.update_context(spark.createDataFrame([("0001", "new"), ("0007", "gone already")], "id string, text_content string"))
    want["0001"] = "new"
    assert have() == want and files().items() > had.items()
    assert st.read("entries").filter("id = '0001'").first()["version"] == 2 and first.read("entries").count() == 400  # an old snapshot has all
    plan = st.read("entries")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    more = [f"{i:04}" for i in range(400) if i % 7 and i % 3]
    tools.delete_context(ids=more)  # more than half are void by now, so the buckets are written anew
    want = {k: v for k, v in want.items() if k not in more}
    assert have() == want and not {tuple(p) for p in st.snapshot().parts("entries")} & {tuple(p) for p in first.parts("entries")}
    assert st.read("entries_void").isEmpty()


def test_parts_of_a_bucket_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "PARTS", 2)
    st = S.Store(spark, str(tmp_path), buckets=1)
    st.init()
    for i in range(4):
        st.commit(lambda t, i=i: t.exchange("entries", t.spots("entries", spark.createDataFrame([(f"{i - 1}",)], "id string")), spark.createDataFrame([(f"{i}", "t", "user", "text", "x", None, None, None, 1, AT, AT)], S.TABLES["entries"])))
        assert [r["id"] for r in st.read("entries").collect()] == [f"{i}"] and len(st.snapshot().parts("entries")) <= 2


def test_a_commit_leaves_no_shuffle_files(spark, tmp_path):
    st = S.Store(spark, str(tmp_path))
    before, seen = spark.conf.get(commits.SWEPT), []
    st.commit(lambda t: seen.append(spark.conf.get(commits.SWEPT)))
    assert seen == ["true"] and spark.conf.get(commits.SWEPT) == before
