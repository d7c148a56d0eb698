"""Revisits against a brute-force as-of join; record parsing; URLs."""

import datetime as dt
import gzip
import random

from pyspark.sql import functions as F

from corvane.llm import warc

SCHEMA = warc.CAPTURE + ", c string, t int"


def canon(spark, urls):
    return [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]


def test_urls(spark):
    same = ["http://www.Ex.com/A/", "https://ex.com:443/A", "//EX.com/A#top", "https://ex.com/A?utm_source=x&ref=1", " http://ex.com/A "]
    assert set(canon(spark, same)) == {"ex.com/A"}
    assert canon(spark, ["http://e.com?b=2&a=1", "http://e.com/?a=1&&b=2", "http://e.com/a", "plain", "", None]) == ["e.com?a=1&b=2", "e.com?a=1&b=2", "e.com/a", "plain", "", None]


def test_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.com/"] * 3 + [f"http://s{rng.randint(0, 20)}.com/x", None])
        at = None if rng.random() < 0.02 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 150))
        kind = rng.choice(["response", "revisit", "request"])
        h = rng.choice([None, {}, {"etag": rng.choice(['"a"', 'W/"a"', '"b"'])}, {"last-modified": rng.choice(["x", "y"]), "server": "s"}, {"etag": '"a"', "cache-control": str(i), "content-type": "q"}])
        rows.append((f"r{i:04}", url, at, kind, rng.choice([200, 200, 404] if kind == "response" else [200, 304, 304]), h, rng.choice([b"body%d" % i, b"body%d" % i, None]), "x", 1))
    rows += rows[:40]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r["record_id"], r["status"], r["response_id"], dict(r["headers"]), r["body"] and bytes(r["body"])) for r in got.collect()), key=str)
    full = [r for r in rows if r[3] == "response" and r[4] == 200 and r[6] is not None and r[1] and r[2]]
    want = []
    for r in rows:
        if r[3] != "revisit":
            continue
        new = r[5] or {}
        best = max((f for f in full if f[1] == r[1] and r[2] and f[2] < r[2]), key=lambda f: (f[2], f[0]), default=None)
        status, headers, body = "missing", new, None
        if best:
            old = best[5] or {}
            tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
            same = tag(old) == tag(new) if tag(old) and tag(new) else old["last-modified"] == new["last-modified"] if "last-modified" in old and "last-modified" in new else None
            status = "unvalidated" if same is None else "resolved" if same else "mismatch"
            if r[4] == 200:
                status, body = "identical", best[6]
            elif same:
                headers, body = old | {k: v for k, v in new.items() if k in warc.PERMITTED}, best[6]
        want.append((r[0], status, best and best[0], headers, body))
    assert got == sorted(want, key=str) and {w[1] for w in want} == {"missing", "unvalidated", "resolved", "mismatch", "identical"}


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files(spark, tmp_path):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a.com/", "WARC-Date": "2024-01-01T00:00:00Z"}
    first = warc.write_record(head, b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nVary: x\r\nVary: y\r\n\r\nWARC/ in the body")
    again = warc.write_record(head | {"WARC-Type": "revisit", "WARC-Record-ID": "<2>", "WARC-Date": "2024-01-02T00:00:00Z"}, b"HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nExpires: now\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.write_record({"WARC-Type": "warcinfo"}, b"")) + gzip.compress(first))
    (tmp_path / "b.warc").write_bytes(again + first[:40])
    r = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()
    assert len(r) == 1 and r[0]["status"] == "resolved" and bytes(r[0]["body"]) == b"WARC/ in the body"
    assert dict(r[0]["headers"]) == {"etag": 'W/"a"', "vary": "x, y", "expires": "now"}


def test_damaged_files(spark, tmp_path):
    """Cut and changed gzip files give what can be read and a row that says so."""
    head = {"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a.com/", "WARC-Date": "2024-01-01T00:00:00Z"}
    one = warc.write_record(head, b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(1).randbytes(4000))
    two = warc.write_record(head | {"WARC-Record-ID": "<2>"}, b"HTTP/1.1 200 OK\r\n\r\nx")
    whole = gzip.compress(one) + gzip.compress(two)
    changed = bytearray(whole)
    changed[len(gzip.compress(one)) + 14] ^= 0xFF
    for name, raw in {"a": whole, "b": whole[:-9], "c": bytes(changed), "d": whole[:30], "e": b"\x1f\x8b", "f": b"", "g": whole + b"junk", "h": gzip.compress(one)[:-4]}.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(raw)
    rng = random.Random(2)
    for _ in range(200):
        bad = bytearray(whole)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        list(warc.captures_of(bytes(bad[: rng.randrange(1, len(bad))])))
    got = warc.read_warc(spark, str(tmp_path)).groupBy("kind").count().collect()
    assert {r["kind"] for r in got} == {"response", "damaged"}
    assert {r["kind"]: r["count"] for r in got}["damaged"] == 6
    assert [r["record_id"] for r in warc.captures_of(whole)] == ["<1>", "<2>"]


def test_header_names(spark):
    """Names match in any case; of two that differ in case only, the first in order of spelling counts."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("r", "http://a.com", at(0), "response", 200, {"ETag": '"1"', "etag": '"2"', "Content-Type": "t", "Age": "1"}, b"b", "c", 1),
        ("v", "http://a.com/", at(1), "revisit", 304, {"ETAG": 'W/"1"', "AGE": "2", "X-Cache": "HIT"}, None, "c", 1),
    ]
    r = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["status"] == "resolved" and r["headers"] == {"etag": 'W/"1"', "age": "2", "content-type": "t"}
