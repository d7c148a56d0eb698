"""Reranking by the passage around the matches or the matched chunk."""

from pyspark.sql import functions as F

from corvane.api import Tools
from corvane.operators import fusion
from corvane.sources.store import Store


def test_matches_beyond_the_head_count(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    filler = "nothing here to see. " * 300
    texts = [filler + "zebra crossing " + filler, filler + "zebra " + filler]
    tools.store_context(spark.createDataFrame([(f"t{i}", "user", t, None, [], None) for i, t in enumerate(texts)], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>"))
    ids = {r["thread_id"]: r["id"] for r in st.read("entries").collect()}
    at = len(filler)
    st.write("chunks", spark.createDataFrame([(ids["t0"], 0, 0, 90, [9.0, 9.0]), (ids["t1"], 0, at, at + 5, [1.0, 0.0])], st.read("chunks").schema))
    score = fusion.lexical_scorer("zebra crossing")
    got = {r["id"]: r["rerank_score"] for r in tools.hybrid_search_context("zebra crossing", [1.0, 0.0], scorer=score)["rows"].collect()}
    assert got[ids["t0"]] > 1 and got[ids["t1"]] == score("zebra")
    only = tools.hybrid_search_context("zebra crossing", None, scorer=score)["rows"]
    assert only.filter(F.col("id") == ids["t0"]).first()["rerank_score"] > 1
