"""Quality and toxicity: held-out accuracy on made texts, folding, edge cases."""

import random

import numpy as np
import pytest

from corvane.llm import quality, toxicity


def texts(seed=1, n=260):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(15, 90))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zorgle", "Z0RGLE", "zоrgle", "zorgling", "stüpid"])
        t = " ".join(words) + "."
        if bad:
            t = rng.choice([lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", "%%% "), lambda s: " ".join([s.split()[0]] * 40)])(t)
        rows.append((i, t, int(not bad), int(toxic)))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, stats string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows = texts()
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels, train=~quality.held_out())
    out = quality.score(docs, model).select("doc_id", "score", quality.held_out().alias("h"), "stats").collect()
    want = {r[0]: r[2] for r in rows}
    held = [(r["score"] >= 0.3) == want[r["doc_id"]] for r in out if r["h"]]
    assert len(held) > 30 and np.mean(held) > 0.9 and all(0 <= r["score"] <= 1 for r in out)


def test_quality_edges(spark):
    docs, labels = frames(spark, texts(n=30))
    assert quality.fit(docs, labels.limit(0)).predict(np.zeros((1, quality.N_STATS)))[0] == 0.5
    one = quality.fit(docs, labels.filter("quality = 1"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 200_000), (1, None)], "doc_id long, text string")
    assert [r["score"] for r in quality.score(odd, one).collect()] == [1.0] * 4
    assert quality.score(docs.limit(0), one).count() == 0
    x, y = quality.isotonic(np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 0.0]), np.ones(3))
    assert x.tolist() == [1.5, 3.0] and y.tolist() == [0.5, 1.0]


def test_toxicity(spark):
    rows = [(r[0], r[1], 1, r[3]) for r in texts(2, 400) if r[2]]
    docs, labels = frames(spark, rows)
    lex = toxicity.fit(docs, labels, train=~quality.held_out(folds=3, fold=1))
    out = toxicity.score(docs, lex).select("doc_id", "score", quality.held_out(folds=3, fold=1).alias("h")).collect()
    want = {r[0]: r[3] for r in rows}
    held = [(r["score"] >= 0.7) == bool(want[r["doc_id"]]) for r in out if r["h"]]
    assert len(held) > 40 and np.mean(held) > 0.93


def test_folding():
    assert toxicity.fold("ІDІ0T") == toxicity.fold("idiot") == " idiot ".replace("l", "i")
    assert toxicity.fold("MÖRÔN") == " moron " and toxicity.fold(None) == "  " and toxicity.fold("st́upid") == " stupid "
    auto = toxicity.Lexicon(toxicity.seeds()).automaton()
    assert toxicity.matches(auto, toxicity.fold("a $tup1d idea, l0ser"))[1] == 2
    assert toxicity.matches(auto, toxicity.fold("empty the trash can"))[1] == 0
    assert toxicity.matches(auto, toxicity.fold("trash, and the trash can"))[1] == 1
    assert toxicity.measures(auto, "idiot")[1] > toxicity.measures(auto, "idiot " + "word " * 500)[1]


def test_toxicity_edges(spark):
    docs, labels = frames(spark, texts(n=30))
    lex = toxicity.fit(docs, labels.limit(0))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "ok " * 200_000), (3, "you idiot"), (3, "you idiot")], "doc_id long, text string")
    got = [r["score"] for r in toxicity.score(odd, lex).collect()]
    assert got[0] == got[1] < 0.5 and got[3] == got[4] > 0.7
    assert toxicity.score(docs.limit(0), lex).count() == 0


def test_quality_against_plain_fit(spark):
    """The same model fitted on one matrix, without Spark: equal scores."""
    rows = texts(7)
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels)
    stats = np.array([quality.statistics(r[1]) for r in rows], np.float32).astype(np.float64)
    y = np.array([float(r[2]) for r in rows])
    folds = np.array([r["f"] for r in labels.orderBy("doc_id").selectExpr("cast(pmod(xxhash64(doc_id), 5) as int) f").collect()])
    spread = stats.std(0)
    x = np.clip((stats - stats.mean(0)) / np.where(spread > 1e-9, spread, 1.0), -6, 6)
    z = np.hstack([np.ones((len(x), 1)), np.sqrt(2 / 192) * np.cos(x @ model.proj + model.phase)])
    solve = lambda a, b: np.linalg.solve(a.T @ a + 1e-2 * len(a) / 193 * np.eye(193), a.T @ b)
    out = np.empty(len(y))
    for f in range(5):
        out[folds == f] = z[folds == f] @ solve(z[folds != f], y[folds != f])
    places = np.unique(np.round(out, 4))
    sums = [(p, y[np.round(out, 4) == p].mean(), (np.round(out, 4) == p).sum()) for p in places]
    knots, values = quality.isotonic(*map(np.array, zip(*sums, strict=True)))
    raw = z @ solve(z, y)
    want = np.clip(0.998 * np.interp(raw, knots, values) + 0.002 * np.clip(raw, 0, 1), 0, 1)
    got = np.array([r["score"] for r in quality.score(docs, model).orderBy("doc_id").collect()])
    assert np.abs(got - want).max() < 0.02 and np.mean(np.abs(got - want) < 1e-3) > 0.97  # knots are rounded, so a step may move


def test_toxicity_against_plain_search(spark):
    """Weights, matches and scores by substring search over every place, without the automaton and without Spark."""
    rows = [(r[0], r[1], 1, r[3]) for r in texts(5, 200) if r[2]] + [(1000, "a zorgle in the trash can, you clown fish " * 3, 1, 0), (1001, None, 1, None)]
    docs, labels = frames(spark, rows)
    lex = toxicity.fit(docs, labels)
    known = {(r[1], r[3]) for r in rows if r[3] is not None}
    bad, good = ([toxicity.entries_of(t) for t, y in known if y == k] for k in (1, 0))
    odds = {}
    for e in set().union(*bad):
        b, g = sum(e in x for x in bad), sum(e in x for x in good)
        o = np.log((b + 0.5) / (len(bad) + 1)) - np.log((g + 0.5) / (len(good) + 1))
        if b >= 3 and o >= 3.0:
            odds[e] = (o, b)
    weights = toxicity.seeds()
    for e, (o, b) in odds.items():
        stems = [odds[x] for x in odds if e != x and e.startswith(x) and len(x) >= 5]
        if not stems or (b < 0.9 * max(x[1] for x in stems) and o > max(x[0] for x in stems) + 1):
            weights[e] = max(weights.get(e, 0), o)
    assert weights.keys() == lex.weights.keys() and all(abs(weights[e] - lex.weights[e]) < 1e-9 for e in weights) and len(weights) > len(toxicity.SEEDS)

    def plain(t):
        f, best, spared = toxicity.fold(t), {}, set()
        for x in toxicity.EXCEPTIONS:
            for i in range(len(f)):
                if f.startswith(toxicity.fold(x), i):
                    spared.update(range(i, i + len(toxicity.fold(x)) - 1))
        for i in range(len(f)):
            for e, w in weights.items():
                if f.startswith(e, i) and i not in spared:
                    best[i] = max(best.get(i, 0), w)
        total = sum(best.values())
        a = lex.bias + lex.slopes[0] * np.log1p(total) + lex.slopes[1] * total / np.sqrt(f.count(" ") + 21)
        return 1 / (1 + np.exp(-a))

    for r in toxicity.score(docs, lex).collect():
        assert abs(r["score"] - plain(r["text"])) < 1e-9


def test_clashing_columns(spark):
    docs, labels = frames(spark, texts(n=12))
    for fit, score in ((quality.fit, quality.score), (toxicity.fit, toxicity.score)):
        model = fit(docs, labels)
        with pytest.raises(ValueError, match="clash"):
            score(docs.withColumnRenamed("stats", "Score"), model)
        assert score(docs, model, column="other").columns == [*docs.columns, "other"]
