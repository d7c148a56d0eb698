"""Limits that report what they leave out: grep's time, deep pages, failing legs, summaries."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corvane.api import Tools
from corvane.operators import filters, fusion, quant, scan, textops
from corvane.sources import generation
from corvane.sources import store as S

AT = dt.datetime(2024, 1, 1)
BAD = "a" * 40 + "b"


def test_grep_shares_one_deadline_over_lines(spark):
    """A pattern that backtracks on each of many lines takes its time once for the entry, which is reported."""
    d = spark.createDataFrame([("slow", "\n".join([BAD] * 50)), ("fast", "aaa\nx"), ("none", "y")], "id string, text_content string").coalesce(1)
    m = textops.grep(d, r"^(a|aa)+$", is_regex=True, timeout=0.5)
    began = time.time()
    rows = m.collect()
    assert time.time() - began < 15
    assert {r["id"] for r in rows if r["timed_out"]} == {"slow"} and [r["line"] for r in rows if not r["timed_out"]] == ["aaa"]
    assert [r["id"] for r in textops.timed_out(m).collect()] == ["slow"]
    m = textops.grep(d, r"^(a|aa)+$", is_regex=True, timeout=5, total=0.5)  # what the task doesn't come to is reported, too
    assert {r["id"] for r in textops.timed_out(m).collect()} == {"slow", "fast", "none"}
    m = textops.grep(d, "aaa", timeout=5, total=60)
    assert textops.timed_out(m).count() == 0 and textops.grep_counts(m).filter("id = 'slow'").first()["match_count"] == 50 * 13


def test_deep_pages_are_refused(spark):
    e = spark.createDataFrame([("a", AT)], "id string, created_at timestamp")
    assert scan.page(e, scan.newest_first(), 5, 1_000_000).count() == 0
    for limit, offset in ((5, 1_000_001), (5, -1), (0, 0)):
        with pytest.raises(filters.InvalidFilter):
            scan.page(e, scan.newest_first(), limit, offset)
        assert scan.search_context(e, limit=limit, offset=offset)["validation_errors"]


def test_a_leg_that_fails_leaves_the_other(spark, tmp_path):
    st = S.Store(spark, str(tmp_path), buckets=2)
    st.init()
    tools = Tools(st, "simple", generation.Makers(lambda ts: [[float(len(t)), 1.0] for t in ts]))
    tools.put_entries(spark.createDataFrame([(i, i, "user", "text", f"alpha {i}", None, None, None, 1, AT, AT) for i in "abc"], S.TABLES["entries"]))
    ok = tools.hybrid_search_context("alpha", [7.0, 1.0])
    assert ok["search_modes_used"] == ["fts", "semantic"] and "warnings" not in ok and ok["rows"].count() == 3
    with pytest.raises(ValueError):
        quant.search(st.read("chunks_compressed"), [1.0], quant.Quantizer(2))
    for f in (tmp_path / "chunks").rglob("*.parquet"):
        f.write_bytes(b"not a table")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    half = tools.hybrid_search_context("alpha", [7.0, 1.0])
    assert half["search_modes_used"] == ["fts"] and half["rows"].count() == 3
    assert half["warnings"][0].startswith("semantic search failed (") and len(half["warnings"][0]) > 60
    for f in (tmp_path / "entries").rglob("*.parquet"):
        f.write_bytes(b"not a table")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    both = tools.hybrid_search_context("alpha", [7.0, 1.0])
    assert both["error"].startswith("both searches failed") and "fts:" in both["error"] and "semantic:" in both["error"]
    assert fusion.together({}, 5) == {}


def test_summaries_go_to_the_shallowest_then_longest(spark):
    text = "# A\n" + "".join(f"## S{i}\n{'w' * (10 + i)}\n### T{i}\n{'v' * 200}\n" for i in range(6))
    e = spark.createDataFrame([("e", text)], "id string, text_content string")
    got = S.summarised_nodes(e, lambda t: "s", least_chars=12, most=4).filter("node_summary IS NOT NULL").select("title").collect()
    assert sorted(r["title"] for r in got) == ["A", "S3", "S4", "S5"]
    assert S.summarised_nodes(e, lambda t: "s", least_chars=12).filter(F.col("node_summary").isNotNull()).count() == 13
