"""TIFF: round trips through every codec and layout, damaged files, null and empty rows."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import tiff


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(codec, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 5, (50, 37)).astype(np.uint8), rng.integers(0, 70, (1, 1, 3)).astype(np.uint8), rng.integers(0, 900, (33, 20, 2)).astype(np.uint16), np.zeros((200, 150), np.uint8)]
    raw = tiff.write_tiff(pages, codec, predictor, rows_per_strip=7, tile=tile, order=order)
    got = tiff.read_pages(raw)
    assert [g["page"] for g in got] == [0, 1, 2, 3] and not any("error" in g for g in got)
    for p, g in zip(pages, got, strict=True):
        assert g["pixels"] == p.astype(p.dtype.newbyteorder("<")).tobytes()
        assert (g["height"], g["width"], g["samples"]) == (p.shape[0], p.shape[1], p.shape[2] if p.ndim == 3 else 1)


def test_lzw_long_and_packbits():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 9000, rng.integers(0, 256, 20_000).astype(np.uint8).tobytes(), bytes(range(256)) * 40):
        assert tiff.un_lzw(tiff.to_lzw(data)) == data
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_bits(bytes([128, 0xFE, 7, 2, 1, 2, 3])) == bytes([7, 7, 7, 1, 2, 3])


def test_float_predictor_and_planes():
    x = np.random.default_rng(5).normal(size=(3, 8)).astype(np.float32)
    planes = np.ascontiguousarray(x.astype(">f4").view(np.uint8).reshape(3, 8, 4).transpose(0, 2, 1)).reshape(3, 32)
    stored = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
    assert tiff.undo_predictor(stored, 3, 8, 1, 32, "<").tobytes() == x.astype("<f4").tobytes()


def test_damaged():
    good = tiff.write_tiff([np.ones((4, 4), np.uint8)])
    assert tiff.read_pages(None)[0]["error"] and tiff.read_pages(b"")[0]["error"] and tiff.read_pages(b"II*\0")[0]["error"]
    cut = tiff.read_pages(good[:12])
    assert "error" in cut[-1]
    loop = bytearray(good)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", loop, 4)[0])
    pages = tiff.read_pages(bytes(loop))
    assert pages[0]["pixels"] == b"\1" * 16 and "loop" in pages[1]["error"]


def test_query_rows(spark):
    long = "äb c" * 50_000
    rows = [(1, "x" * 64, 5), (2, None, 5), (3, "", 5), (4, long, 5), (4, long, 5), (None, "ÿ", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    files = tiff.text_images(docs).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    out = tiff.digest(tiff.tiff_pages(files)).collect()
    assert len(out) == 6
    for r in out:
        text = next((t or "" for i, t, _ in rows if i == r["doc_id"]), "").encode()
        payload = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in out if r["doc_id"] == 4}) == 1
    assert tiff.tiff_pages(files.limit(0)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        tiff.tiff_pages(files.withColumn("width", F.lit(1)))


def by_hand(order, entries, blocks=b"", following=0):
    """A file of one directory at byte 8 whose entries are given as (tag, kind, count, packed value or offset)."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v.ljust(4, b"\0") for t, k, n, v in entries) + struct.pack(order + "I", following)
    return head + body + blocks


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("codec", "data", "want"), [
    (1, b"abcdef", b"abcdef"),
    (32773, b"\x02abc\xfed", b"abcddd"),  # a literal run of three, a repeat of three
    (5, bytes([0x80, 0x10, 0x60, 0x50, 0x22, 0x0C, 0x34, 0x10, 0x10]), b"AABBBB"),
    (8, zlib.compress(b"abcdef"), b"abcdef"),
])
def test_files_assembled_by_hand(order, codec, data, want):
    """Not made by the module's writer."""
    if codec == 5:  # 256 65 258 ... packed by hand below, as 9-bit codes
        codes = [256, 65, 65, 66, 260, 66, 257]
        bits = "".join(f"{c:09b}" for c in codes)
        data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    s, i = (lambda x: struct.pack(order + "H", x)), (lambda x: struct.pack(order + "I", x))
    at = 8 + 2 + 9 * 12 + 4
    raw = by_hand(order, [(256, 3, 1, s(3)), (257, 3, 1, s(2)), (258, 3, 1, s(8)), (259, 3, 1, s(codec)), (262, 3, 1, s(1)), (273, 4, 1, i(at)), (277, 3, 1, s(1)), (278, 3, 1, s(2)), (279, 4, 1, i(len(data)))], data)
    got = tiff.read_pages(raw)
    assert len(got) == 1 and got[0].get("error") is None and got[0]["pixels"] == want, got


def test_known_codes():
    """The worked example of the specification's LZW section: 7 7 7 8 8 7 7 6 6 ."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.un_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_nothing_raises():
    """Files with changed, cut and repeated bytes give rows."""
    rng = np.random.default_rng(4)
    s, i = (lambda x: struct.pack("<H", x)), (lambda x: struct.pack("<I", x))
    for odd in ([(256, 3, 0, b"")], [(256, 3, 1, s(3)), (257, 3, 1, s(2)), (278, 3, 1, s(0)), (273, 4, 1, i(8)), (279, 4, 1, i(6))], [(256, 4, 1, i(2**32 - 1)), (257, 4, 1, i(2**32 - 1)), (258, 3, 1, s(64)), (273, 4, 1, i(8)), (279, 4, 1, i(6))],
                [(256, 3, 1, s(3)), (257, 3, 1, s(2)), (322, 3, 1, s(0)), (323, 3, 1, s(16)), (324, 4, 1, i(8)), (325, 4, 1, i(6))], [(256, 3, 1, s(3)), (257, 3, 1, s(2)), (277, 3, 1, s(0)), (284, 3, 1, s(2)), (273, 4, 1, i(8)), (279, 4, 1, i(6))]):
        assert all("error" in p or p["pixels"] == b"" for p in tiff.read_pages(by_hand("<", odd, b"x" * 50)))
    for codec in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        good = tiff.write_tiff([rng.integers(0, 9, (20, 30)).astype(np.uint8), rng.integers(0, 9, (5, 6, 3)).astype(np.uint16)], codec, 2, 7, (16, 16) if codec == tiff.LZW else None)
        for _ in range(400):
            bad = bytearray(good)
            for _ in range(rng.integers(1, 6)):
                bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
            bad = bytes(bad[: rng.integers(1, len(bad) + 1)] if rng.random() < 0.3 else bad)
            assert all(("error" in p) != ("pixels" in p) for p in tiff.read_pages(bad))
    bomb = tiff.write_tiff([np.zeros((64, 64), np.uint8)], tiff.DEFLATE, 1)
    assert tiff.decode_block(zlib.compress(b"\0" * 10_000_000), tiff.DEFLATE, 4096) == b"\0" * 4096 and tiff.read_pages(bomb)[0]["pixels"] == b"\0" * 4096


def test_text_files_use_every_layout():
    seen = set()
    for i in range(300):
        raw = (f"text {i} " * (1 + i % 7 * 300)).encode()
        pages = tiff.read_pages(tiff.text_file(raw, rows_per_page=100))
        assert b"".join(p["pixels"] for p in pages) == raw.ljust(-(-len(raw) // 64) * 64, b"\0") and tiff.text_file(raw) == tiff.text_file(bytes(raw))
        seen.add((pages[0]["compression"], pages[0]["predictor"], len(pages) > 1))
    assert {(c, p, m) for c, p in (("none", 1), ("packbits", 1), ("lzw", 1), ("lzw", 2), ("deflate", 1), ("deflate", 2)) for m in (True, False)} <= seen


def test_a_large_page_is_held_once_or_twice():
    """A small file that unfolds to the largest page allowed, 256 MB, stays below 1 GB; a larger one is an error row."""
    import subprocess
    import sys

    code = """
import resource, zlib, numpy as np
from corvane.llm import tiff
def file(w, h):
    rows = 1024
    strips = [zlib.compress(bytes(w * min(rows, h - y)), 9) for y in range(0, h, rows)]
    raw, at = bytearray(b"II" + (42).to_bytes(2, "little") + bytes(4)), []
    for s in strips:
        at.append(len(raw)); raw += s
    put = lambda xs: b"".join(x.to_bytes(4, "little") for x in xs)
    a = len(raw); raw += put(at); n = len(raw); raw += put(map(len, strips))
    tags = [(256, w), (257, h), (258, 8), (259, 8), (273, (len(at), a)), (277, 1), (278, rows), (279, (len(at), n))]
    raw[4:8] = len(raw).to_bytes(4, "little")
    raw += len(tags).to_bytes(2, "little")
    for t, v in tags:
        c, v = v if isinstance(v, tuple) else (1, v)
        raw += t.to_bytes(2, "little") + (4).to_bytes(2, "little") + c.to_bytes(4, "little") + v.to_bytes(4, "little")
    return bytes(raw + bytes(4))
p = tiff.read_pages(file(16384, 16384))[0]
assert len(p["pixels"]) == 1 << 28 and tiff.page_feature(p["pixels"], 16384).startswith("mean=0.000;std=0.000;")
assert "too large" in tiff.read_pages(file(16384, 16385))[0]["error"]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1000


def test_features_of_any_size():
    r = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 5), (3, 64), (100, 64), (9, 8), (50, 300)):
        x = r.integers(0, 256, (h, w)).astype(np.uint8)
        got = tiff.page_feature(x.tobytes(), w)
        assert got.startswith(f"mean={x.mean():.3f};std={x.std():.3f};dhash=") and len(got.split("=")[-1]) == 16
