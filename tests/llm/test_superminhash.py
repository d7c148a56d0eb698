"""Near-duplicate groups against brute force; signatures; components."""

import random
import re

import numpy as np
import pytest

from corvane.llm import superminhash as S


def shingles(t, k=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k=2):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(rng, families=14):
    rows, n = [], 0
    for _ in range(families):
        base = [f"t{rng.randint(0, 3000)}" for _ in range(rng.choice([1, 2, 8, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"u{rng.randint(0, 9**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("rounds", [1, 2])
def test_brute_force(spark, rounds):
    rng = random.Random(3)
    rows = corpus(rng) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "oNE"), (3, "t1 t2"), (3, "t1 t2"), (None, "lonely words here"), (9005, "w x y z " * 30_000), (9006, "w x y z " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.near_duplicates(df, size=2, rounds=rounds).collect()), key=str)
    assert got == brute(rows)


def test_colliding_words():
    """Words whose letters follow the Thue-Morse sequence and its opposite, alike for any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    assert len(np.unique(S.word_hashes(f"{a} {b}".encode()))) == 2


@pytest.mark.parametrize(("block", "crowd"), [(7, 16), (1000, 0), (3, 0)])
def test_blocks_and_crowds(spark, monkeypatch, block, crowd):
    """Buckets larger than a block, and blocks in which pairs give way to the exact join."""
    rng = random.Random(15)
    rows = []
    for f in range(4):  # families near the threshold on both sides
        base = [f"b{f}x{i}" for i in range(100)]
        for i in range(25):
            w = list(base)
            for j in rng.sample(range(100), rng.randint(1, 9)):
                w[j] = f"z{rng.randint(0, 9**7)}"
            rows.append((f * 100 + i, " ".join(w)))
    inner, residue = S._candidates, S._residue
    monkeypatch.setattr(S, "_candidates", lambda left, nodes, percent: inner(left, nodes, percent, block=block, crowd=crowd))
    monkeypatch.setattr(S, "_residue", lambda left, texts, size, percent: residue(left, texts, size, percent, block=block))
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1, rounds=1).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 1)


def test_common_passage(spark):
    """Many documents with one passage and little else in common: no star can settle their buckets."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, passage + " " + " ".join(f"q{rng.randint(0, 9**7)}" for _ in range(60))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.near_duplicates(df, size=2).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(1)
    err = []
    for _ in range(200):
        x = rng.integers(1, 2**62, 120).astype(np.uint64)
        a, b = np.unique(x[:100]), np.unique(x[20:])
        err.append((S.signature(a) == S.signature(b)).mean() - 80 / 120)
    assert abs(np.mean(err)) < 0.01 and np.var(err) < 0.9 * (2 / 3) * (1 / 3) / 128  # below that of independent hashes
    one = S.signature(np.array([7], np.uint64))
    assert sorted(one >> 32) == list(range(128))  # an element holds every rank once
    assert np.array_equal(S.word_hashes(b"ab  cd\nab"), S.word_hashes(b"ab cd ab")) and len(S.word_hashes(b"")) == 0


def test_blocks_of_long_texts(monkeypatch):
    t = ("some words here and there " * 200).encode()
    whole = S.word_hashes(t)
    monkeypatch.setattr(S, "BLOCK", 37)
    assert np.array_equal(S.word_hashes(t), whole)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in S.components(df).collect()}
    assert got == {r["node"]: r["root"] for r in S.components(df, one_task=3).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_near_miss_does_not_hide_a_link(spark):
    """Of two linked nodes, the one with the larger overlap with x is no link and the other is; the star's centre decides nothing."""
    span = lambda p, a, b: " ".join(f"{p}{i}" for i in range(a, b))
    for p in (f"w{i}x" for i in range(200)):
        texts = [span(p, 0, 100), span(p, 0, 127), span(p, 3, 110)]
        sets = [S.shingle_set(t, 1) for t in texts]
        with np.errstate(over="ignore"):
            keys = [np.array([S.mix(s).sum(dtype=S.U), S.mix(s ^ S._GOLD).sum(dtype=S.U)]).tobytes() for s in sets]
        if keys[1] == min(keys) and len({S.signature(s, 1)[0] for s in sets}) == 1:
            break
    else:
        raise AssertionError("no such words")
    assert brute(list(enumerate(texts)), 1) == [(0, 100, 0), (1, 127, 0), (2, 107, 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.near_duplicates(df, size=1, bands=1, rows=1, rounds=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["links"]) for r in got) == [(0, 100, 0, 1), (1, 127, 0, 1), (2, 107, 0, 2)]
