"""Spelling variants: words, near words, forms and roots against plain code."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import spelling


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in near.items()}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_words(spark):
    rows = [
        (1, "Straßenbahn straßenbahn STRASSENBAHN überall ÜBERALL x1abcdefgh2"), (1, "Straßenbahn straßenbahn"), (None, "nothing nothing"), (None, None), (2, ""), (3, "short words onl"), (4, "a" * 5000 + " " + "a" * 5000),
        *[(i, "Variant variants variantes ÀÈÌÒÙàè×÷ àèìòùàè×÷") for i in range(100)], (5, "don't-stop Hyphenated-hyphenated_Hyphenated"),
    ]
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, word int")
    got = {r["word"]: r["n"] for r in spelling.words(df).collect()}
    assert got == plain_words(rows)
    assert len(got) > 8


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abc", 2), ("aàÿz", 3)])
def test_variants(spark, letters, seed):
    r = random.Random(seed)
    n = {"".join(r.choice(letters) for _ in range(r.choice((7, 7, 8, 8, 9, 10)))): r.choice((2, 2, 3, 20, 20, 31, 200, 310, 3100)) for _ in range(250)}
    n |= {"q" * 300: 2, "q" * 301: 20, "q" * 150 + "x" + "q" * 149: 250, "lonely" * 3: 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = sorted(map(tuple, spelling.digest(spelling.variants(df)).collect()))
    want = plain_variants(n)
    assert got == want
    assert any(root != w for w, form, root, *_ in want)


def test_long_chain_ties_and_empty(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000, "aacbbbb": 200_000, "zzzzzzz": 3, "yzzzzzz": 30, "zyzzzzz": 30}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted(map(tuple, spelling.digest(spelling.variants(df)).collect()))
    assert got == plain_variants(n)
    assert {r[0]: r[2] for r in got}["aaaaaaa"] == "aabbbbb" and {r[0]: r[1] for r in got}["zzzzzzz"] == "yzzzzzz"
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.words(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_keys_are_linear_and_exact():
    texts = ["abcdefg", "abxdefg", "abdefg", "aabbccdd", "g" * 200_000]
    of, pos, first, a, b, wa, wb = spelling._keys(texts)
    key = {(texts[t], p): (int(x), int(y)) for t, p, x, y in zip(of[:28], pos, a, b, strict=False)}
    own = {t: (int(x), int(y)) for t, x, y in zip(texts, wa, wb, strict=True)}
    assert key["abcdefg", 2] == key["abxdefg", 2] == own["abdefg"]
    assert len({key["abcdefg", p] for p in range(7)}) == 7
    assert [p for t, p, f in zip(of, pos, first, strict=True) if t == 3 and f] == [0, 2, 4, 6]
    assert len(np.unique(a[of == 4])) == 1 and first[of == 4].sum() == 1
