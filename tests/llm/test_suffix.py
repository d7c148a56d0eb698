"""Repeated strings against brute force; the sorter; spans and characters."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import suffix


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, h int")
    got = suffix.digest(df, suffix.repeated_spans(df, **options)).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60), prose(90), prose(45)]
    texts = [prose(rng.randint(1, 80)) + rng.choice(["", *shared]) + prose(rng.randint(0, 60)) + rng.choice(["", *shared]) for _ in range(40)]
    base = texts[0]
    for _ in range(6):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return [*texts, texts[3], texts[3], None, "", "short", "ab" * 400, "abc" * 300, "x" * 199, "x" * 200, shared[1] + shared[1]]


def test_brute_force(spark):
    texts = corpus(1)
    assert run(spark, texts) == brute(texts)


@pytest.mark.parametrize("most", [1, 3])
def test_crowded_anchors(spark, most):
    """Anchors are split down to single offsets; the result is that of one task."""
    rng = random.Random(4)
    line = "a very common line of more than thirty-two bytes"
    texts = corpus(2) + [f"{rng.random()}" * 9 + line + f"{rng.random()}" * 9 for _ in range(12)]
    texts += [f"{i}" * 150 + texts[0][50:330] + f"{i * 7}" * 150 for i in range(8)]
    assert run(spark, texts, max_group=most) == brute(texts)


def test_blocks(monkeypatch):
    text = " ".join(corpus(3)[:20]).encode()
    whole = suffix.anchors(text, 200, 32)
    monkeypatch.setattr(suffix, "BLOCK", 97)
    parts = suffix.anchors(text, 200, 32)
    spread = lambda x: [p for p, n in zip(x[0], x[2], strict=True) for _ in range(n)]
    assert spread(whole) == spread(parts) and sum(whole[2]) == len(text) - 199


def test_no_repeats_and_empty(spark):
    assert run(spark, ["a" * 10, "b" * 10]) == brute(["a" * 10, "b" * 10])
    assert run(spark, []) == []


def test_sorter():
    rng = random.Random(7)
    for _ in range(1500):
        base = bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 20, 60, 120])))
        ss = []
        for _ in range(rng.randint(1, 30)):
            t = bytearray(base[: rng.randint(0, len(base))] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 5))))
            if t and rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(b"abc")
            ss.append(bytes(t))
        order, lcp = suffix.deep_shallow(ss, 0, rng.choice([8, 16, 32]), rng.choice([1, 4, 8]))
        v = [ss[i] for i in order]
        assert sorted(order) == list(range(len(ss))) and v == sorted(ss)
        assert all(lcp[j] == suffix.common_prefix(v[j - 1], v[j]) for j in range(1, len(v)))


def test_large_groups():
    rng = random.Random(8)
    core = bytes(rng.choice(b"abcd") for _ in range(60))
    frags = list({bytes(rng.choice(b"ab") for _ in range(3)) + core[:20] + core[20:] + bytes(rng.choice(b"ab") for _ in range(3)) for _ in range(60)})
    at, count, length = [23] * len(frags), [7] * len(frags), 60
    got = suffix.repeated_windows(frags, at, count, [1] * len(frags), length)
    seen = Counter(f[i : i + length] for f in frags for i in range(7))
    assert len(frags) > 24 and [list(g) for g in got] == [[seen[f[i : i + length]] > 1 for i in range(7)] for f in frags]


def test_characters():
    raw = "aé😀b".encode()
    assert suffix.whole_characters(raw, [2, 5]) == [] or suffix.cut_out(raw, suffix.whole_characters(raw, [2, 5])).decode()
    for a in range(len(raw)):
        for z in range(a, len(raw) + 1):
            suffix.cut_out(raw, suffix.whole_characters(raw, [a, z])).decode()


def test_common_fragments_are_gathered(spark):
    """A row for each fragment and 32 of its occurrences in a task; counts, the least occurrence and what wants an answer stay whole."""
    passage = " ".join(f"word{i * i}" for i in range(90))
    texts = [f"{i} " * 60 + passage + f" {i * 7}" * 60 for i in range(100)]
    rows = [(i, t, list(range(len(suffix.anchors(t.encode(), 200, 32)[0]))), 1 + i % 2) for i, t in enumerate(texts)]
    hit = spark.createDataFrame(rows, "rid long, text string, at array<int>, w int").repartition(1)
    got = suffix._spots(hit, 200, 32).collect()
    want: dict = {}
    for rid, t, at, w in rows:
        p, s, n, h = (x.tolist() for x in suffix.anchors(t.encode(), 200, 32))
        for i in at:
            want.setdefault((h[i], *suffix._content(t.encode()[s[i] : s[i] + n[i] + 199])), []).append((rid, s[i], n[i], p[i], w))
    most = max(map(len, want.values()))
    assert most == 100 and len(got) == sum(max(1, -(-sum(x[4] == 1 for x in xs) // 32)) for xs in want.values()) < sum(map(len, want.values())) / 2
    for key, xs in want.items():
        own = [r for r in got if (r["h"], r["f"], r["g"]) == key]
        assert sum(r["w"] for r in own) == sum(x[4] for x in xs) and min((r["rid"], r["s"], r["n"], r["p"]) for r in own) == min(x[:4] for x in xs)
        assert sorted(tuple(y) for r in own for y in r["xs"]) == sorted((x[0], x[1], x[1] + x[2] - 1) for x in xs if x[4] == 1) and all(len(r["xs"]) <= 32 for r in own)


def test_a_passage_of_all_texts(spark):
    passage = " ".join(f"word{i * i}" for i in range(90))
    texts = [f"{i} " * 60 + passage + f" {i * 7}" * 60 for i in range(80)] + [passage, passage, passage * 2]
    assert run(spark, texts) == brute(texts) == run(spark, texts, max_group=7)


def test_answers_are_rows_of_texts(spark):
    """A passage of several fragments gives a row for each text that has it, so twice the texts give twice the rows."""
    passage = " ".join(f"word{i * i}" for i in range(90))
    made = []
    for size in (50, 100):
        rows, want = [], {}
        for i in range(size):
            t = f"{i} " * 60 + passage + f" {i * 7}" * 60
            p, s, n, h = (x.tolist() for x in suffix.anchors(t.encode(), 200, 32))
            at = [j for j in range(len(p)) if s[j] >= t.index("word0") and s[j] + n[j] + 199 <= t.index(passage) + len(passage)]
            rows.append((i, t, at, 1))
            want[i] = (s[at[0]], s[at[-1]] + n[at[-1]] - 1)
            assert len(at) > 3
        spots = suffix._spots(spark.createDataFrame(rows, "rid long, text string, at array<int>, w int").repartition(3), 200, 32)
        many = spots.groupBy("h", "f", "g").agg({"w": "sum"}).filter("`sum(w)` > 1").select("h", "f", "g")
        got = suffix._answered(spots, many).collect()
        assert {r["rid"]: (r["s"], r["e"]) for r in got} == want
        made.append(len(got))
    assert made == [50, 100]
