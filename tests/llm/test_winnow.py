"""Winnowing against brute force over all windows."""

import random
import re

from corvane.llm import winnow


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def brute(docs, items, window=10):
    own = {i: words(t) for i, t in items}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, b in own.items():
            m = min(len(b), window)
            wins = {tuple(b[s : s + m]) for s in range(len(b) - m + 1)} if m else set()
            for s in range(len(w) - m + 1):
                if m and tuple(w[s : s + m]) in wins:
                    hit.update(range(s, s + m))
                    found.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, spans int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in winnow.decontaminate(d, b).collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ü9"]
    items = [(i, ", ".join(rng.choices(vocab, k=k))) for i, k in enumerate([14, 30, 10, 3, 9, 1, 6, 12])] + [(50, None), (51, ""), (52, "!!"), (53, "w1 W1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            src = words(rng.choice(items[:8])[1])
            a = rng.randint(0, max(0, len(src) - 9))
            parts.append("--".join(x.upper() if x.isascii() else x for x in src[a : a + rng.randint(5, 14)]))
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "w1 " * 3000), (5, docs[5][1]), (None, docs[6][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, ())]


def test_no_python_in_plan(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    plan = winnow.decontaminate(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_long_text_that_is_an_item(spark):
    """Every window of a long text matches, across the stretches that are looked up together; a stray word in it breaks ten."""
    import random

    r = random.Random(4)
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    broken = [*w[:1020], "stray", *w[1021:]]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(broken)), (3, " ".join(w[3000:3009]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w)), (8, " ".join(w[1019:1031]))], "item_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"]) for x in winnow.digest(winnow.decontaminate(docs, items)).collect()}
    assert got == {1: (5000, 5000, 2), 2: (5000, 4999, 2), 3: (9, 0, 0)}


def test_fingerprints_of_every_length(spark):
    """A window's fingerprint is the least hash of its k-grams, for all lengths, with the arrays of a text and no slice for each window."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    texts = [" ".join(r.choices("abcdefg", k=k)) for k in (1, 2, 5, 9, 10, 11, 40)]
    df = spark.createDataFrame([(t.split(" "),) for t in texts], "w array<string>")
    for m in range(1, 13):
        k = min(5, m)
        got = df.select("w", winnow._grams(F.col("w"), k).alias("g")).filter(F.size("w") >= m).select("g", winnow._lows(F.col("g"), m, k).alias("v"))
        rows = got.collect()
        assert len(rows) == sum(len(t.split(" ")) >= m for t in texts)
        for g, v in rows:
            assert v == [min(g[i : i + m - k + 1]) for i in range(len(g) - (m - k))]
    # grams of equal words have equal hashes, those of other words or another order don't
    for k in range(1, 8):
        grams = [(tuple(w[i : i + k]), h) for w, g in df.filter(F.size("w") >= k).select("w", winnow._grams(F.col("w"), k)).collect() for i, h in enumerate(g)]
        assert len({h for _, h in grams}) == len({x for x, _ in grams}) == len(set(grams))


def test_letters_beyond_ascii(spark):
    """Fingerprints fold all letters, windows only A-Z: what differs in other letters is found by its fingerprint, but is no hit."""
    item = "ὈΔΥΣΣΕΎΣ Σ ΑΣ.Α İstanbul Kelvin ÉTÉ ẞ Ǆ one TWO three"
    docs = [(1, item), (2, item.replace("TWO", "two").replace(".", "-'")), (3, item.lower()), (4, item.replace("É", "é")), (5, "ΑΣ'Σ " + item + ":Α"), (6, item.replace("K", "K"))]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])
    assert [r[2] > 0 for r in run(spark, docs, [(1, item)])] == [True, True, False, False, True, False]
