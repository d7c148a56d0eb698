"""The pipeline's stages, each against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from corvane.llm import mixing  # noqa: E402
from tests.llm import test_suffix, test_superminhash, test_winnow  # noqa: E402


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    shared, item = prose(80), prose(14)
    rows = [(i, prose(rng.randint(30, 120)), "en", f"src{i % 4}", 0) for i in range(160)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "src1", 0) for i in range(15)]
    rows += [(300 + i, prose(40) + " " + shared + " " + prose(30), "de", "src2", 0) for i in range(6)]
    rows += [(400 + i, prose(30) + " " + item + " " + prose(30), "fr", "src3", 0) for i in range(5)]
    rows += [(500 + i, prose(50).upper().replace(" ", "!! "), "en", "src0", 0) for i in range(60)]
    rows += [(600, None, None, None, None), (601, "", "en", "src0", 0), (5, rows[5][1], "en", "src1", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int(i < 500), 0) for i, *_ in rows if i is not None and i < 600 and i != 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, item, shared


def test_stages(spark, made):
    d, item, shared = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    q = pipeline.drop_low_quality(spark, docs, d)
    ids = {r[0] for r in rows(q)}
    assert q.columns == names and len([i for i in ids if i is not None and i < 500]) >= 180 and len([i for i in ids if i and 500 <= i < 600]) <= 6
    q = q.filter("doc_id < 500 or doc_id >= 600")
    before = rows(q)
    near = pipeline.drop_near_duplicates(spark, q, d)
    want = {(i, t) for i, t in before if (i, i) in {(a, c) for a, _, c in test_superminhash.brute(before, 5)}}
    assert near.columns == names and set(rows(near)) == want and near.count() == len(want)
    before = rows(near)
    cut = pipeline.cut_repeats(spark, near, d)
    left = {i: t for i, t in rows(cut)}
    removed = {i: b[1] for (i, _), b in zip(before, test_suffix.brute([t for _, t in before]), strict=True)}
    for i, t in before:
        if not removed[i]:
            assert left[i] == t
        elif i in left:
            assert len((t or "").encode()) - len(left[i].encode()) == removed[i]
    assert not any(shared in (t or "") for t in left.values()) and {r["n_chars"] == len(r["text"]) for r in cut.filter("text is not null").collect()} == {True}
    before = rows(cut)
    clean = pipeline.drop_contaminated(spark, cut, d)
    want = {i for i, _, n, _ in test_winnow.brute(before, [(1, item)]) if not n}
    assert {i for i, _ in rows(clean)} == want and not any(400 <= i < 500 for i in want)
    last = pipeline.mix_sources(spark, clean, d)
    assert last.columns == names and set(rows(last)) == set(rows(mixing.mix_documents(clean).filter("mix_kept").select(*names)))
    tokens = lambda df: df.agg(F.sum(mixing.tokens(F.col("text")))).first()[0]
    assert abs(tokens(last) / tokens(clean) - 0.5) < 0.02


def test_run(spark, made):
    out = pipeline.run(spark, made[0])
    assert out.count() > 60 and len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_empty_and_odd_columns(spark, made, tmp_path):
    """No rows, repeated rows, and columns named like the stages' own."""
    d, _, _ = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs
    for c in ("key", "kept", "score", "kept_id", "kept_key", "mix_kept", "mix_dim0", "text_key", "component_id", "spans"):
        odd = odd.withColumn(c, F.lit(c))
    wide = odd.unionAll(odd)
    for _, f in pipeline.STAGES:
        assert f(spark, odd.limit(0), d).count() == 0
        wide = f(spark, wide, d).persist()
        assert wide.columns == odd.columns
    assert wide.select("key", "kept", "score", "mix_dim0").distinct().collect() == [("key", "kept", "score", "mix_dim0")]
    near = pipeline.drop_near_duplicates(spark, odd.unionAll(odd), d)
    assert sorted(map(str, near.select(docs.columns).collect())) == sorted(map(str, pipeline.drop_near_duplicates(spark, docs, d).collect()))
