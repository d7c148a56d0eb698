"""Writes: all tables in one commit, files of touched buckets only, what is made from texts and the index in step."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.api import Tools
from corvane.operators import fts, quant
from corvane.sources import commits, derived, generation, text_index
from corvane.sources import store as S
from corvane.streaming import feed

AT = dt.datetime(2024, 1, 1)
ENCODE = lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]
MAKERS = generation.Makers(ENCODE, "m", lambda t: f"about {t[:9]}", 60, 5, 10)


def entries(spark, data):
    """(id, thread, text) as rows of the table."""
    return spark.createDataFrame([(i, t, "user", "text", x, None, None, None, 1, AT, AT) for i, t, x in data], S.TABLES["entries"])


def opened(spark, path, **kw):
    st = S.Store(spark, str(path), buckets=4)
    st.init()
    return st, Tools(st, **kw)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def in_step(st, makers=MAKERS):
    """Chunks, compressed chunks, metadata and nodes are those that the entries' texts give now."""
    at = st.snapshot()
    e = at.read("entries")
    cols = ["context_id", "chunk_index", "start_index", "end_index", "embedding"]
    want = sorted(map(tuple, S.chunked(e, makers.encoder, makers.size, makers.overlap).select(cols).collect()))
    assert sorted(map(tuple, at.read("chunks").select(cols).collect())) == want
    assert sorted(map(tuple, derived.current(at, "chunks").select(cols).collect())) == want
    assert sorted(r["context_id"] for r in at.read("embedding_metadata").collect()) == sorted({r[0] for r in want})
    if (row := at.read("compression").first()) is not None:
        q = quant.Quantizer(row["dim"], row["bits"], row["variant"], row["seed"])
        made = {(r["context_id"], r["chunk_index"]): bytes(r["payload"]) for r in at.read("chunks_compressed").collect()}
        assert made == {(r[0], r[1]): q.encode_many([r[4]])[0] for r in want}
    nodes = S.summarised_nodes(e, makers.summariser, least_chars=makers.least_chars).collect()
    assert sorted(map(str, at.read("index_nodes").collect())) == sorted(map(str, nodes))


def test_made_with_the_writes(spark, tmp_path):
    st, tools = opened(spark, tmp_path, makers=MAKERS)
    S.compress_store(st, quant.Quantizer(2, 4, "mse"))
    tools.put_entries(entries(spark, [("a", "t", "# One\n" + "first words " * 20), ("b", "t", "short"), ("c", "u", "# Two\nother words")]))
    in_step(st)
    before = {r["context_id"]: r["updated_at"] for r in st.read("embedding_metadata").collect()}
    assert tools.update_context(spark.createDataFrame([("a", "# New\nwholly different text"), ("b", "short")], "id string, text_content string")) == []
    in_step(st)
    after = {r["context_id"]: r["updated_at"] for r in st.read("embedding_metadata").collect()}
    assert {i for i in after if after[i] != before[i]} == {"a"}  # b's text is what it was
    near = tools.semantic_search_context([26.0, 1.0], limit=3)["rows"].filter("id = 'a'").first()
    assert near["matched"] == "# New\nwholly different text"
    assert tools.delete_context(ids=["c"]) == 1
    in_step(st)
    assert sorted({r["context_id"] for r in st.read("derivations").collect()}) == ["a", "b"]


def test_made_afterwards(spark, tmp_path, monkeypatch):
    """Without makers an update leaves nothing stale behind; regenerate() makes what is due, only that, and can be run again."""
    st, tools = opened(spark, tmp_path)
    tools.put_entries(entries(spark, [(x, x, f"# {x}\n" + f"words of {x} " * 9) for x in "abcd"]))
    later = Tools(st, makers=MAKERS)
    assert later.regenerate() == {"chunks": 4, "nodes": 4}
    in_step(st)
    tools.update_context(spark.createDataFrame([("b", "# b\nquite another")], "id string, text_content string"))
    assert sorted({r["context_id"] for r in st.read("chunks").collect()}) == ["a", "c", "d"]
    assert ids(derived.due(st.snapshot(), "chunks")) == ["b"] and later.regenerate() == {"chunks": 1, "nodes": 1} and later.regenerate() == {"chunks": 0, "nodes": 0}
    in_step(st)
    # entries that something else has rewritten: what is stale isn't read, and is found
    st.write("entries", st.read("entries").withColumn("text_content", F.when(F.col("id") == "c", "rewritten elsewhere").otherwise(F.col("text_content"))).withColumn("content_hash", F.sha2("text_content", 256)).filter("id != 'd'"))
    at = st.snapshot()
    assert sorted(r[0] for r in derived.stale(at, "chunks").collect()) == ["c", "d"]
    assert sorted({r["context_id"] for r in derived.current(at, "chunks").collect()}) == ["a", "b"]
    assert later.regenerate() == {"chunks": 1, "nodes": 1}
    in_step(st)
    monkeypatch.setattr(generation, "make", lambda *a: 1 / 0)
    tools.update_context(spark.createDataFrame([("a", "fails")], "id string, text_content string"))
    seen = st.snapshot().number
    with pytest.raises(ZeroDivisionError):
        later.regenerate()
    assert st.snapshot().number == seen
    monkeypatch.undo()
    later.regenerate()
    in_step(st)


def test_a_commit_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """A failure at any write of a commit shows the old state, and leaves no files."""
    st, tools = opened(spark, tmp_path, makers=MAKERS)
    rows = lambda *d: spark.createDataFrame([(t, "user", x, None, ["tag"], ["iVBORw0KGgo="], AT) for t, x in d], "thread_id string, source string, text_content string, metadata string, tags array<string>, images array<string>, created_at timestamp")
    tools.store_context(rows(("t", "one")))
    tools.build_index()
    state = lambda: {n: sorted(map(str, st.read(n).drop("embedding").collect())) for n in ("entries", "tags", "images", "chunks", "derivations", "fts_totals", "fts_postings")}
    files = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet"))
    before, had, write = state(), files(), commits.Transaction.write
    for n in (0, 2, 5, 8, 99):
        left = [n]

        def broken(self, *a, left=left, **kw):
            if not left[0]:
                raise OSError("disk")
            left[0] -= 1
            return write(self, *a, **kw)

        monkeypatch.setattr(commits.Transaction, "write", broken)
        try:
            tools.store_context(rows(("t", "two"), ("u", "three")))
        except OSError:
            assert n < 99 and state() == before and files() == had
        else:
            assert n == 99
        finally:
            monkeypatch.undo()
    assert st.read("entries").count() == 3 and st.read("tags").count() == 3 and tools.fts_search_context("three")["rows"].count() == 1


def test_two_writers(spark, tmp_path):
    """The one that comes second starts again from what the first wrote; readers keep the state that they began with."""
    st, tools = opened(spark, tmp_path)
    other = Tools(S.Store(spark, str(tmp_path)))
    tools.put_entries(entries(spark, [("a", "t", "one")]))
    pinned = st.snapshot()
    runs = []

    def slow(tx):
        runs.append(tx.number)
        own = tx.read("entries")
        if len(runs) == 1:
            other.put_entries(entries(spark, [("b", "u", "two")]))
        tx.write("entries", own.withColumn("summary", F.lit("seen")))

    st.commit(slow)
    assert len(runs) == 2 and {(r["id"], r["summary"]) for r in st.read("entries").collect()} == {("a", "seen"), ("b", "seen")}
    assert ids(pinned.read("entries")) == ["a"]
    tx = commits.Transaction(st.snapshot())
    st.commit(lambda t: t.write("tags", spark.createDataFrame([("a", "x")], S.TABLES["tags"])))
    with pytest.raises(commits.Conflict):
        tx.publish()
    for i in range(6):
        st.commit(lambda t, i=i: t.write("tags", spark.createDataFrame([("a", str(i))], S.TABLES["tags"])))
    assert len(list((tmp_path / "_commits").glob("*.json"))) == commits.KEPT and len(list((tmp_path / "tags").iterdir())) == commits.KEPT
    assert not list((tmp_path / "_staged").glob("*"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    st, tools = opened(spark, tmp_path)
    tools.put_entries(entries(spark, [(f"{i:03}", f"t{i}", f"text {i}") for i in range(80)]))
    tools.store.write("tags", st.read("entries").select(F.col("id").alias("context_entry_id"), F.lit("x").alias("tag")))
    before = st.snapshot()
    tools.put_entries(entries(spark, [("900", "t7", "one more")]))
    after = st.snapshot()
    changed = lambda n: [b for p, b in after.parts(n) if [p, b] not in before.parts(n)]
    assert len(before.parts("entries")) == 4 and len(changed("entries")) == 1 and changed("tags") == []
    assert st.read("entries").count() == 81
    tools.update_context(spark.createDataFrame([("005", "s")], "id string, summary string"))
    before, after = after, st.snapshot()
    assert len(changed("entries")) == 1
    tools.delete_context(ids=["005"])
    before, after = after, st.snapshot()
    assert len(changed("tags")) == 1 and st.read("tags").count() == 79 and st.read("entries").count() == 80


def test_index_follows_random_writes(spark, tmp_path):
    """After any writes, merged or not, the index gives what one built anew gives."""
    st, tools = opened(spark, tmp_path / "a", language="simple")
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
    tools.put_entries(entries(spark, [(f"{i:03}", f"t{i % 7}", text()) for i in range(40)]))
    tools.build_index()
    alive, n = {f"{i:03}" for i in range(40)} & set(ids(st.read("entries"))), 40
    queries = ["alpha", "alpha beta", '"beta gamma"', "gam*", "delta NOT eps"]

    def same():
        found = tools._index()
        got = {q: sorted((x["id"], round(x["score"], 9)) for x in found.search(fts.parse(q, "boolean", "simple")).collect()) for q in queries}
        e = st.read("entries")
        want = {q: sorted((x["id"], round(x["score"], 9)) for x in fts.search(e, q, "boolean", "simple").collect()) for q in queries}
        assert got == want
        cover = lambda df: sorted((x["id"], round(x["score"], 9)) for x in df.collect())
        assert cover(found.cover_rank("alpha beta")) == cover(fts.cover_rank(e, "alpha beta"))
        assert ids(found.lengths) == ids(e)

    for step in range(9):
        kind = r.choice(["insert", "update", "delete"])
        if kind == "insert":
            tools.put_entries(entries(spark, [(f"{i:03}", f"t{i % 7}", text()) for i in range(n, n + 5)]))
            n += 5
        elif kind == "update":
            tools.update_context(spark.createDataFrame([(i, text()) for i in r.sample(sorted(alive), 4)], "id string, text_content string"))
        else:
            tools.delete_context(ids=r.sample(sorted(alive), 3))
        alive = set(ids(st.read("entries")))
        if step in (3, 8):
            same()
    tools.merge_index()
    assert len(st.snapshot().parts("fts_postings")) == 2
    same()
    tools.update_context(spark.createDataFrame([(i, "alpha beta gamma") for i in sorted(alive)[:6]], "id string, text_content string"))
    same()
    tools.merge_index(whole=True)
    assert len(st.snapshot().parts("fts_postings")) == 1 and not st.snapshot().exists("fts_gone")
    tools.delete_context(ids=sorted(alive)[:2])
    same()


def test_stream_keeps_all_in_step(spark, tmp_path):
    st, tools = opened(spark, tmp_path / "store", language="simple", makers=MAKERS)
    tools.put_entries(entries(spark, [("1", "t", "alpha beta")]))
    tools.build_index()
    entries(spark, [("2", "t", "alpha beta"), ("3", "t", "alpha gamma " * 9), ("1", "t", "an id that is there")]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feed.merge_into(feed.read_feed(spark, str(tmp_path / "in")), st, str(tmp_path / "ck"), tools).trigger(availableNow=True).start().awaitTermination()
    assert [(r["id"], r["version"]) for r in st.read("entries").orderBy("id").collect()] == [("1", 2), ("3", 1)]
    assert ids(tools.fts_search_context("alpha")["rows"]) == ["1", "3"]
    in_step(st)


def test_images_and_refusals(spark, tmp_path):
    st, tools = opened(spark, tmp_path)
    tools.put_entries(entries(spark, [("a", "t", "one"), ("b", "t", "two")]))
    change = lambda data, schema: tools.update_context(spark.createDataFrame(data, schema))
    png, jpeg = "iVBORw0KGgo=", "/9j/4AAQ"
    change([("a", [png, jpeg]), ("b", None)], "id string, images array<string>")
    kinds = lambda: {r["id"]: r["content_type"] for r in st.read("entries").collect()}
    assert kinds() == {"a": "multimodal", "b": "text"}
    assert [(r["position"], r["mime_type"]) for r in st.read("images").orderBy("position").collect()] == [(0, "image/png"), (1, "image/jpeg")]
    change([("a", [jpeg])], "id string, images array<string>")
    assert [r["mime_type"] for r in st.read("images").collect()] == ["image/jpeg"]
    change([("a", [])], "id string, images array<string>")
    assert kinds()["a"] == "text" and st.read("images").count() == 0
    for data, schema, why in (
        ([("a", "{}", "{}")], "id string, metadata string, patch string", "metadata and patch"), ([("a", "x\0")], "id string, text_content string", "NUL"), ([("a", " ")], "id string, text_content string", "empty"),
        ([("a", ["no base64!"])], "id string, images array<string>", "base64"), ([("a", "[1]")], "id string, metadata string", "JSON object"), ([("a", ["x" * 200])], "id string, tags array<string>", "too long"),
    ):
        with pytest.raises(ValueError, match=why):
            change(data, schema)
    change([("a", "{}", None), ("b", None, '{"k":1}')], "id string, metadata string, patch string")
    assert {r["id"]: r["metadata"] for r in st.read("entries").collect()} == {"a": "{}", "b": '{"k":1}'}


def test_an_index_over_texts_gives_the_same(spark, tmp_path):
    st, _ = opened(spark, tmp_path)
    docs = entries(spark, [("a", "t", "alpha beta"), ("b", "t", None), ("c", "t", "")])
    text_index.build(st, docs, "simple")
    assert [r["id"] for r in text_index.open_index(st, "simple").search(fts.parse("alpha", "match", "simple")).collect()] == ["a"]
