"""Every version conflict of a large update is returned."""

from corvane.api import Tools
from corvane.sources.store import Store


def test_more_than_a_page_of_conflicts(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    st.init()
    tools = Tools(st)
    tools.store_context(spark.createDataFrame([(f"t{i}", "user", f"text {i}", None, [], None) for i in range(130)], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>"))
    ids = sorted(r["id"] for r in st.read("entries").collect())
    assert sorted(tools.update_context(spark.createDataFrame([(i, "s", 9) for i in ids], "id string, summary string, expected_version bigint"))) == ids and len(ids) == 130
