"""Fill-in-middle: masks against a pattern, the table against plain code, exact restoring."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract, read off word by word."""
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return doc_id, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1f\x85\xa0 aé€😀<P>SM", max_size=60))
def test_masks(text):
    raw = text.encode()
    ends = fim.token_ends(raw)
    want = [len(text[: m.end()].encode()) - 1 for m in TOKEN.finditer(text)]
    assert ends.bit_count() == len(want)
    assert [fim.select(ends, r + 1) for r in range(len(want))] == want


TEXTS = [None, "", " ", "\n\t ", "one", "one two  three\n", "  lead", "a <P> b", "<S>", "<<M>>", "<M", "é ü € 😀  x", "same text here", "same text here", "x" * 70_000 + " y" * 70_000, " " * 50_000, "<P x> <S y"]


def test_table(spark):
    random.seed(5)
    data = [(i, t) for i in range(60) for t in (random.choice(TEXTS), TEXTS[i % len(TEXTS)])] + [(None, "no id at all"), (-7, "negative id"), (2**62, "large id")]
    df = spark.createDataFrame([(t, i, "k") for i, t in data], "text string, doc_id long, n string")  # a column that a digest names, too
    out = fim.fill_in_middle(df)
    assert out.columns[:3] == ["text", "doc_id", "n"]
    got = sorted(map(tuple, fim.digest(out).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t in data), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restored_text(spark):
    df = spark.createDataFrame([(i, f"word{i}  and <P <S M> more\n{'z ' * i}") for i in range(200)], "doc_id long, text string")
    for marks in (("<P>", "<S>", "<M>"), ("[pre.]", "[suf*]", "[mid|]")):
        out = fim.fill_in_middle(df, seed=7, rate=100, sentinels=marks)
        bad = out.filter(~(fim.restored(out.fim_output, out.fim_form, marks) == out.text))
        assert out.filter("fim_form != 'plain'").count() == 200 and bad.count() == 0


def test_other_keys_and_refusals(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", None)], "name string, body string")
    assert [r["fim_tokens"] for r in fim.fill_in_middle(df, doc="name", text="body").orderBy("name").collect()] == [0, 3]
    assert fim.fill_in_middle(df.limit(0), doc="name", text="body").count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df.withColumnRenamed("name", "FIM_form"), doc="FIM_form", text="body")
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("x", "axb", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, doc="name", text="body", sentinels=marks)
