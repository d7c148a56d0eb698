"""Outlines, chunks, passages, stems, quantizer, merge patch, full-text grammar."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import chunking, outline, passages
from corvane.functions import text as tx
from corvane.operators import fts, quant
from corvane.sources import text_index
from corvane.sources.store import Store


def test_outline():
    t = "intro\n# Setup\ntext\n## Install\n```\n# not a heading\n```\n## Notes\n## Notes\n# Root\nTitle\nover two\n===\n- item\n---\n    code\n---\n## ###\n"
    ids = [(x["node_id"], x["level"], x["title"]) for x in outline.outline(t)]
    assert ids == [("root", 0, ""), ("setup", 1, "Setup"), ("setup/install", 2, "Install"), ("setup/notes", 2, "Notes"), ("setup/notes-2", 2, "Notes"), ("root-2", 1, "Root"), ("title-over-two", 1, "Title over two"), ("title-over-two/section", 2, "")]
    assert outline.span_of(t, "setup") == (6, t.index("# Root"))
    folded = outline.outline(t, max_depth=1)
    assert [x["node_id"] for x in folded] == ["root", "setup", "root-2", "title-over-two"] and folded[1]["char_end"] == t.index("# Root")
    assert [x["title"] for x in outline.outline("```\n# open fence\n")][1:] == ["open fence"]
    assert len(outline.outline("")) == 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(10, 60))
def test_chunks_cover(text, size):
    got = chunking.chunks(text, size, size // 5)
    assert got and [c[0] for c in got] == list(range(len(got)))
    for _, a, z, c in got:
        assert text[a:z] == c
        assert len(c) <= max(size, len(text) if len(got) == 1 else size)
    joined = set().union(*(range(a, z) for _, a, z, _ in got))
    assert all(i in joined for i, ch in enumerate(text) if ch in "ab")


def test_passages():
    text = "Start. " + "x" * 3000 + " Middle match here. " + "y" * 3000 + " End <mark>literal</mark>."
    at = text.index("match")
    marked = text[:at] + "<mark>match</mark>" + text[at + 5 :]
    assert passages.regions(marked, text) == [(at, at + 5)]
    p = passages.passage(text, marked)
    assert "match" in p and "<mark>" not in p and len(p) <= passages.MAX_PASSAGE + 3
    assert passages.passage("abc", None) == "abc" and passages.regions("x<mark>y", "xy") == []
    assert passages.coalesce([(0, 100), (150, 250), (90, 120)], 100) == [(0, 250)]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: tx.stem(w) for w in pairs} == pairs


def test_merge_patch(spark):
    cases = [('{"a":1}', '{"b":2}'), ('{"a":1}', '{"a":null}'), ('{"a":{"b":{"c":1,"d":2}}}', '{"a":{"b":{"c":null}}}'), ('{"a":[1]}', '{"a":{"x":1}}'), (None, '{"a":{"b":null}}'), ('{"a":1}', None)]
    want = [{"a": 1, "b": 2}, {}, {"a": {"b": {"d": 2}}}, {"a": {"x": 1}}, {"a": {}}, {"a": 1}]
    got = [json.loads(r[0]) for r in spark.createDataFrame(cases, "t string, p string").select(tx.merge_patch("t", "p")).collect()]
    assert got == want


@pytest.mark.parametrize(("bits", "mse"), [(2, 0.1175), (3, 0.03454), (4, 0.009497)])
def test_distortion(bits, mse):
    rng = np.random.default_rng(1)
    q = quant.Quantizer(128, bits, "mse")
    x = rng.normal(size=(300, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    err = np.mean([np.sum((q.decode(q.encode(v)) - v) ** 2) for v in x])
    assert abs(err - mse) < 0.06 * mse


def test_inner_products_and_recall():
    rng = np.random.default_rng(2)
    q = quant.Quantizer(128, 4, "ip")
    x = rng.normal(size=(600, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    payloads = [q.encode(v) for v in x]
    for _ in range(10):
        v = rng.normal(size=128)
        near = v / np.linalg.norm(v)
        planted = [q.encode((lambda z: z / np.linalg.norm(z))(near + 0.1 * rng.normal(size=128) / np.sqrt(128))) for _ in range(5)]
        d = q.distances(payloads + planted, near)
        assert set(np.argsort(d)[:5]) == set(range(600, 605))
    est = -q.distances(payloads, x[0])
    assert abs(np.mean(est[1:] - x[1:] @ x[0])) < 0.01
    with pytest.raises(ValueError, match="recorded"):
        quant.Quantizer(128, 3, "mse").decode(payloads[0])


def test_grammar():
    p = lambda q, m="match", lang="simple": fts.parse(q, m, lang)
    assert p("hello world") == fts.Node("and", (fts.Leaf(("hello",)), fts.Leaf(("world",))))
    assert p("full-text") == fts.Leaf(("full", "text")) and p('cat"dog') == p("cat dog")
    assert p("cat and dog", lang="english") == p("cat dog", lang="english") and p("and") is not None and p("and or", lang="english") is None
    assert p("full-text", "prefix") == fts.Node("and", (fts.Leaf(("full",), True), fts.Leaf(("text",), True)))
    assert p('a AND (b OR "c d") NOT e', "boolean").op == "not" or p('a AND (b OR "c d") NOT e', "boolean").op == "and"
    assert p("(a OR", "boolean") == p("(a OR") and p("  ") is None
    assert fts.cover_density([[0], [1]]) == pytest.approx(0.1) and fts.cover_density([[0], [3]]) == pytest.approx(0.1 / 3)


def test_search_ties_and_highlight(spark):
    d = spark.createDataFrame([("b", "same words here"), ("c", "same words here"), ("a", "same words here"), ("d", "Résumé thing"), ("e", None)], "id string, text_content string")
    h = fts.search(d, "same words", "phrase", "simple")
    assert [r["id"] for r in h.orderBy(*fts.ranked(h)).collect()] == ["c", "b", "a"]
    assert [r["id"] for r in fts.search(d, "resume", "match", "simple").collect()] == ["d"]
    assert fts.search(d, "and", "match", "english").count() == 0
    got = d.filter("id = 'd'").select(fts.highlight(F.col("text_content"), fts.parse("resume", "match", "simple"))).first()[0]
    assert got == "<mark>Résumé</mark> thing"


@pytest.mark.parametrize("language", ["simple", "english"])
def test_index_gives_what_the_texts_give(spark, tmp_path, language):
    texts = ["same words here", "same words here", "words same", "Résumé thing the things", None, "", "the same thing the same", "full-text search of the words", "wordy worded words"]
    d = spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)], "id string, text_content string")
    st = Store(spark, str(tmp_path))
    text_index.build(st, d, language)
    index = text_index.open_index(st, language)
    assert text_index.open_index(st, "simple" if language == "english" else "english") is None
    for q, mode in (("same words", "match"), ("same words", "phrase"), ("wor th", "prefix"), ('"the same" OR (words AND NOT here)', "boolean"), ('"same wo"*', "boolean"), ("full-text", "match"), ("absent", "match"), ("the the", "match"), ("", "match")):
        a, b = (sorted((r["id"], round(r["score"], 9)) for r in h.collect()) for h in (fts.search(d, q, mode, language), index.search(fts.parse(q, mode, language))))
        assert a == b, (q, mode)
    plan = index.search(fts.parse("same words", "match", language))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
