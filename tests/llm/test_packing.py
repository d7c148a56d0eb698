"""Packing: ids, cuts of least cost against all choices, and the invariants of the table."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SLOW.encode_special_tokens = True
ENCODER = packing.Encoder()


def slow(text):
    return SLOW.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aé ß\t\n\r'sldve.,!?1½0–…“”€ \x0b\x0cŽɏ~_-", max_size=80))
def test_ids(text):
    assert ENCODER.encode(text).tolist() == slow(text)
    assert packing.odd(text) == bool(packing.ODD.search(text))


def test_ids_of_long_texts():
    for text in ("word's  end.\n\n" * 20_000, "x" * 50_000, " " * 50_000 + "a", "<|endoftext|> is text", "ünï–cödé… " * 3000, "日本語の文。" * 500):
        assert ENCODER.encode(text).tolist() == slow(text)


def padding(n, size):
    return 0 if n & (n - 1) == 0 else size - n


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_cuts_cost_the_least(data):
    size = data.draw(st.sampled_from([8, 16, 12]))
    at = np.cumsum([0, *data.draw(st.lists(st.integers(1, size), min_size=1, max_size=40))])
    pay = np.array([float(x) for x in data.draw(st.lists(st.integers(0, 5), min_size=len(at), max_size=len(at)))])
    short, late = data.draw(st.integers(0, 9)), data.draw(st.integers(0, int(at[-1])))

    def price(a, b):
        n = int(at[b] - at[a])
        full = size - n
        return pay[b] + (min(short, full) if at[a] >= late and n & (n - 1) == 0 and n < size else full)

    cost = [0.0]
    for i in range(1, len(at)):
        cost.append(min(cost[j] + price(j, i) for j in range(i) if at[i] - at[j] <= size))
    cuts = packing.best_cuts(at, pay, size, short, late)
    assert cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert sum(price(a, b) for a, b in zip(cuts, cuts[1:], strict=False)) == cost[-1]


def check(rows, docs, size=1024, end=0):
    """rows of the digest against the documents: every id once, windows gapless and within size. Padding and number of tokens."""
    ids = {i: np.array([*slow(t or ""), end], "<u4") for i, t in docs}
    per_doc, per_window = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        per_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert set(per_doc) == set(ids)
    for i, parts in per_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[i])
    pad, order = 0, []
    for _, parts in sorted(per_window.items()):
        at = 0
        for offset, n, i in sorted(parts):
            assert offset == at
            at += n
            order.append(i)
        assert at <= size
        pad += padding(at, size)
    assert order == sorted(order)  # documents keep their order
    return pad, sum(map(len, ids.values()))


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnlé") for _ in range(r.randint(1, 9)))
    return [(i * 3 - 40, " ".join(word() + r.choice(["", "", "", ".", "!\n", ","]) for _ in range(r.choice([1, 20, 200, 800])))) for i in range(n)]


def test_table(spark):
    docs = [*corpus(300, 1), (10_000, None), (10_001, ""), (10_002, "no stop anywhere " * 9000), (10_003, "x" * 40_000), (10_004, "Short. " * 9000), (-1000, "first")]
    df = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, start int").repartition(4)
    pad, total = check(packing.digest(packing.pack(df)).collect(), docs)
    assert pad < 0.02 * total  # every range leaves a window that isn't full
    small = docs[:60]
    df = spark.createDataFrame([(str(10_000 + i), t) for i, t in small], "name string, body string").coalesce(1)
    rows = packing.digest(packing.pack(df, doc="name", text="body", size=100, end=7)).collect()
    check(rows, [(str(10_000 + i), t) for i, t in small], size=100, end=7)


def test_blocks_join(spark, monkeypatch):
    """Many blocks in a stream give whole windows, and hardly more padding than one."""
    docs = corpus(200, 2)

    def run(block):
        monkeypatch.setattr(packing, "BLOCK", block)
        stream, out = packing._Stream(256, ENCODER, 0, 1.0, 8.0, 64.0), []
        for i, t in docs:
            stream.add(i, t)
            if stream.held >= packing.BLOCK:
                out += stream.pieces(False)
        out += stream.pieces(True)
        rows = [{"doc_id": k, "start": s, "length": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes()), "doc_tokens": n, "sequence_id": w, "offset": o} for k, s, x, n, w, o in out]
        return check(rows, docs, size=256)

    one, many = run(10**9), run(40_000)
    assert one[0] <= many[0] <= one[0] + 0.01 * one[1]


def test_repeated_ids_nulls_and_empty(spark):
    df = spark.createDataFrame([(5, "same text here."), (5, "same text here."), (5, "other"), (None, "no id"), (None, None)], "doc_id long, text string")
    rows = packing.digest(packing.pack(df)).collect()
    want = sorted((i, len(slow(t)) + 1) for i, t in ((5, "same text here."), (5, "same text here."), (5, "other"), (-1, "no id"), (-1, "")))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
    out = packing.digest(packing.pack(df.limit(0)))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
