"""Hybrid search of four or more words takes documents with any of them."""

from corvane.api import Tools
from corvane.operators import fts
from corvane.sources.store import Store


def test_some_of_many_words_are_enough(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    texts = ["red green blue", "red green blue black", "other", "black"]
    tools.store_context(spark.createDataFrame([(f"t{i}", "user", t, None, [], None) for i, t in enumerate(texts)], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>"))
    thread = {r["id"]: r["thread_id"] for r in st.read("entries").collect()}
    found = lambda q: sorted(thread[r["id"]] for r in tools.hybrid_search_context(q, None)["rows"].collect())
    assert found("red green blue black") == ["t0", "t1", "t3"] and found("red green blue") == ["t0", "t1"]


def test_parsed_tree(spark):
    d = spark.createDataFrame([(1, "for you"), (2, "with that"), (3, "none")], "id long, text_content string")
    assert sorted(r["id"] for r in fts.search(d, fts.hybrid_query("for was only that with", language="simple"), language="simple").collect()) == [1, 2]
