"""TIFF: image directories, strips and tiles to one row per page, and back.

The reader walks the chain of image directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate data in strips or tiles, undoes
horizontal and floating-point predictors and joins separate planes. The writer
stores 8- or 16-bit samples with any of these codecs.

Defined results: a null or empty file, and one that is no TIFF, gives one row
with page null and the reason in error; a page that can't be decoded gives a
row with its number and error; pages before it are kept; no damaged file raises; repeated rows
are decoded each; an empty table gives an empty result; other columns of the input are kept beside the page's, and
clashing names are refused. Pixels are rows of samples, little-endian. A block is decoded up to the size
that its page states, so that a small file can't unfold to any size.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

#: Fixed values of the format: field types (bytes each, code for struct) and tags.
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS, STRIP_N, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
PHOTOMETRIC, TILE_W, TILE_H, TILE_AT, TILE_N, FORMAT = 262, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CODEC = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}

PAGE = "page int, width int, height int, samples int, bits int, compression string, predictor int, pixels binary, feature string, error string"


#: Decoded bytes of one block and of one page at most.
MAX_BLOCK, MAX_PIXELS = 1 << 28, 1 << 28
#: Bytes of pixels after which decoded pages are given on.
HELD = 32 << 20
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def unpack_bits(data: bytes, limit: int = MAX_BLOCK) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in [*_RUN.finditer(row), None]:
        end = m.start() if m else len(row)
        while at < end:
            n = min(128, end - at)
            out.append(n - 1)
            out += row[at : at + n]
            at += n
        if m:
            out += bytes([257 - len(m.group()), row[end]])
            at = m.end()
    return bytes(out)


def un_lzw(data: bytes, limit: int = MAX_BLOCK) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends; widths grow one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    bits = held = pos = size = 0
    width, before = 9, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = base.copy()
    while size < limit:
        while bits < width:
            if pos >= len(data):
                return b"".join(out)
            held = (held << 8 | data[pos]) & 0xFFFFFF
            pos += 1
            bits += 8
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = base.copy(), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        size += len(word)
        if before:
            table.append(before + word[:1])
        before = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256, 9)
    table, word, size, width = {bytes([i]): i for i in range(256)}, b"", 258, 9
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = size
        size += 1
        word = c
        if size > 4093:
            put(table[word], 12)
            put(256, 12)
            table, word, size, width = {bytes([i]): i for i in range(256)}, b"", 258, 9
        else:
            width = min(12, max(9, size.bit_length()))
    if word:
        put(table[word], width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decode_block(data: bytes, codec: int, limit: int = MAX_BLOCK) -> bytes:
    """At least the first `limit` bytes of a block, if it has them."""
    if codec == NONE:
        return data
    if codec in (DEFLATE, DEFLATE_OLD):
        z = zlib.decompressobj()
        out = z.decompress(data, limit)
        if not z.eof and len(out) < limit:
            raise ValueError("deflate data is cut off")
        return out
    if codec == PACKBITS:
        return unpack_bits(data, limit)
    if codec == LZW:
        return un_lzw(data, limit)
    raise ValueError(f"compression {codec} isn't known")


def undo_predictor(raw: bytes, predictor: int, width: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Bytes of a block as rows of width * samples values."""
    if bits not in (8, 16, 32, 64):
        if predictor != 1:
            raise ValueError(f"predictor {predictor} with {bits} bits")
        row = (width * samples * bits + 7) // 8
        return np.frombuffer(raw, np.uint8, len(raw) // row * row).reshape(-1, row)
    size = bits // 8
    per_row = width * samples
    rows = len(raw) // (per_row * size)
    if predictor == 3:
        flat = np.cumsum(np.frombuffer(raw, np.uint8, rows * per_row * size).reshape(rows, per_row * size // samples, samples), axis=1, dtype=np.uint8).reshape(rows, size, per_row)
        big = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, per_row)
        return big.astype(f"{order}u{size}")
    x = np.frombuffer(raw, f"{order}u{size}", rows * per_row).reshape(rows, width, samples)
    if predictor == 2:
        x = np.cumsum(x, axis=1, dtype=f"u{size}").astype(f"{order}u{size}")
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't known")
    return x.reshape(rows, per_row)


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] not in (42, 43):
        raise ValueError("no TIFF header")
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        start, entry, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
        tags = {}
        for i in range(n):
            p = start + i * entry
            tag, kind = struct.unpack_from(order + "HH", raw, p)
            count = struct.unpack_from(order + ("Q" if big else "I"), raw, p + 4)[0]
            if kind in FIELD:
                size, code = FIELD[kind]
                v = p + entry - inline
                if size * count > inline:
                    v = struct.unpack_from(order + ("Q" if big else "I"), raw, v)[0]
                if v + size * count > len(raw):
                    raise ValueError(f"tag {tag} lies outside the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, v)
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, start + n * entry)[0]


def _page(raw: bytes, order: str, tags: dict[int, tuple]) -> dict:
    one = lambda t, d: (tags.get(t) or (d,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    codec, predictor, planes = one(COMPRESSION, 1), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    info = {"width": width, "height": height, "samples": samples, "bits": bits, "compression": CODEC.get(codec, str(codec)), "predictor": predictor}
    if min(width, height) < 0 or samples < 1 or bits < 1 or len(set(tags.get(BITS, ()))) > 1:
        raise ValueError("sizes or samples aren't valid")
    if not width or not height:
        return info | {"pixels": b""}
    per = samples // planes
    tiled = TILE_AT in tags
    bw, bh = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (width, min(one(ROWS, height), height))
    if bw < 1 or bh < 1:
        raise ValueError("blocks have no size")
    need = bh * ((bw * per * bits + 7) // 8)
    if need > MAX_BLOCK or height * ((width * samples * bits + 7) // 8) > MAX_PIXELS:
        raise ValueError("page is too large")
    across, down = -(-width // bw), -(-height // bh)
    at, size = (tags.get(TILE_AT, ()), tags.get(TILE_N, ())) if tiled else (tags.get(STRIP_AT, ()), tags.get(STRIP_N, ()))
    if not size and codec == NONE:
        size = (need,) * len(at)
    if min(len(at), len(size)) < across * down * planes:
        raise ValueError("blocks are missing")
    # whole bytes go to their place as they are decoded, so that a page is held once; other depths fill rows of blocks
    whole = bits in (8, 16, 32, 64)
    page: np.ndarray | None = None
    lines: list[np.ndarray] = []
    for plane in range(planes):
        for y in range(down):
            h, row = min(bh, height - y * bh), []
            for x in range(across):
                b = (plane * down + y) * across + x
                if min(at[b], size[b]) < 0 or at[b] + size[b] > len(raw):
                    raise ValueError(f"block {b} lies outside the file")
                block = undo_predictor(decode_block(raw[at[b] : at[b] + size[b]], codec, need)[:need], predictor, bw, per, bits, order)
                if len(block) < h:
                    raise ValueError(f"block {b} is short")
                if not whole:
                    row.append(block[:h])
                    continue
                if page is None:
                    page = np.empty((height, width, samples), block.dtype.newbyteorder("<"))
                part = block[:h].reshape(h, bw, per)[:, : width - x * bw]
                page[y * bh : y * bh + h, x * bw : x * bw + part.shape[1], plane : plane + per] = part
            if not whole:
                lines.append(row[0] if across == 1 else np.hstack(row))
    if not whole:
        made = np.vstack(lines).reshape(planes, height, -1)
        page = made[0] if planes == 1 else np.stack(list(made), axis=-1).reshape(height, -1)
    return info | {"pixels": page.tobytes()}


def pages_of(raw: bytes | None) -> Iterator[dict]:
    """One dict per page, decoded as it is asked for; a dict with error where something can't be read."""
    n = 0
    try:
        for order, tags in _directories(raw or b""):
            try:
                page = _page(raw, order, tags)
            except (ValueError, LookupError, ArithmeticError, TypeError, MemoryError, struct.error, zlib.error) as e:
                page = {"error": f"{type(e).__name__}: {e}"}
            yield {"page": n} | page
            n += 1
    except (ValueError, ArithmeticError, MemoryError, struct.error) as e:
        yield {"error": f"{type(e).__name__}: {e}"}


def read_pages(raw: bytes | None) -> list[dict]:
    return list(pages_of(raw))


def write_tiff(pages: list[np.ndarray], codec: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """Pages (height, width) or (height, width, samples) of uint8 or uint16 as a TIFF file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        x = page if page.ndim == 3 else page[:, :, None]
        h, w, samples = x.shape
        bw, bh = tile or (w, min(rows_per_strip, max(h, 1)))
        at, size = [], []
        for y in range(0, h, bh):
            for c in range(0, w, bw):
                b = x[y : y + bh, c : c + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
                rows = b.astype(b.dtype.newbyteorder(order)).reshape(len(b), -1)
                data = rows.tobytes()
                if codec == DEFLATE:
                    data = zlib.compress(data, level)
                elif codec == LZW:
                    data = to_lzw(data)
                elif codec == PACKBITS:
                    data = b"".join(pack_bits(r.tobytes()) for r in rows)
                at.append(len(out))
                size.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        n = x.dtype.itemsize * 8
        fields: list[tuple[int, int, tuple]] = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (n,) * samples), (COMPRESSION, 3, (codec,)), (PHOTOMETRIC, 3, (2 if samples == 3 else 1,)), (SAMPLES, 3, (samples,)), (PREDICTOR, 3, (predictor,))]
        fields += [(TILE_W, 4, (bw,)), (TILE_H, 4, (bh,)), (TILE_AT, 4, tuple(at)), (TILE_N, 4, tuple(size))] if tile else [(STRIP_AT, 4, tuple(at)), (ROWS, 4, (bh,)), (STRIP_N, 4, tuple(size))]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD[kind][1]}", *values)
            if len(data) > 4:
                where = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def page_feature(pixels: bytes, width: int) -> str:
    """Mean, spread and a 64-bit difference hash over an 8 x 9 grid of means; sums are taken in place, a part at a time."""
    flat = np.frombuffer(pixels, np.uint8)
    counts = np.zeros(256, np.int64)
    for at in range(0, len(flat), 1 << 18):
        counts += np.bincount(flat[at : at + (1 << 18)], minlength=256)
    levels = np.arange(256)
    mean = float((counts * levels).sum()) / len(flat)
    std = float(np.sqrt((counts * (levels - mean) ** 2).sum() / len(flat)))
    x = flat.reshape(-1, width)
    rows, cols = (np.linspace(0, n, k).astype(int) for n, k in ((len(x), 9), (width, 10)))
    cell = np.zeros((8, 9))
    for i in range(8):
        lo, hi = min(rows[i], len(x) - 1), max(rows[i + 1], rows[i] + 1)
        for j in range(9):
            a, z = min(cols[j], width - 1), max(cols[j + 1], cols[j] + 1)
            part = x[lo:hi, a:z]
            cell[i, j] = int(part.sum(dtype=np.int64)) / part.size
    mark = np.packbits(cell[:, 1:] > cell[:, :-1]).tobytes().hex()
    return f"mean={mean:.3f};std={std:.3f};dhash={mark}"


def tiff_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each file, with the other columns of files."""
    rest = [f for f in files.schema.fields if f.name != media]
    schema = T.StructType([*rest, *T._parse_datatype_string(PAGE).fields])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError(f"columns clash with those of a page: {sorted(x for x in schema.names if schema.names.count(x) > 1)}")
    kinds = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.string(), "predictor": pa.int32(), "pixels": pa.binary(), "feature": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, media)):
            rows, of, held = [], [], 0

            def batch() -> pa.RecordBatch:
                made = [pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()]
                out = pa.RecordBatch.from_arrays([*(b.column(f.name).take(pa.array(of, pa.int64())) for f in rest), *made], names=schema.names)
                rows.clear()
                of.clear()
                return out

            for i, raw in enumerate(b.column(media)):
                for p in pages_of(raw.as_py()):  # a page is given on before the next one is decoded, once they come to some size
                    if p.get("bits") == 8 and p["pixels"]:
                        p["feature"] = page_feature(p["pixels"], p["width"] * p["samples"])
                    rows.append(p)
                    of.append(i)
                    held += len(p.get("pixels") or b"")
                    if held > HELD:
                        yield batch()
                        held = 0
            if rows:
                yield batch()

    return files.mapInArrow(run, schema)


def text_file(raw: bytes, width: int = 64, rows_per_page: int = 1024) -> bytes:
    """Bytes, padded with zeros to full rows, as 8-bit samples of a TIFF file.

    Codec, predictor, strips or tiles and byte order follow from a checksum of the bytes, so that equal bytes give equal files
    and many texts use all of them; every rows_per_page rows are a page.
    """
    draw = zlib.crc32(raw)
    rows = np.frombuffer(raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0"), np.uint8).reshape(-1, width)
    codec = (LZW, PACKBITS, PACKBITS, NONE, *[DEFLATE] * 12)[draw % 16]
    predictor = 2 if codec in (LZW, DEFLATE) and draw >> 4 & 1 else 1
    tile = (32, 32) if draw >> 5 & 3 == 0 else None
    pages = [rows[at : at + rows_per_page] for at in range(0, len(rows), rows_per_page)]
    return write_tiff(pages, codec, predictor, (16, 64, 256, 1024)[draw >> 7 & 3], tile, "<" if draw >> 9 & 1 else ">")


def text_images(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 64) -> DataFrame:
    """Each whole text as a TIFF file, see text_file(): doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text"):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                media = [text_file(x, width) for x in raws]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], *T._parse_datatype_string("n_bytes long, media binary").fields]))


def digest(pages: DataFrame) -> DataFrame:
    """A row per file with digests of all its pages' pixels read back; null digests if a page has an error.

    pages has doc_id, n_bytes, media_bytes, media_sha256 and a page's columns, as tiff_pages() gives them: the pages
    of a file follow each other within a partition, so that none is shuffled.
    """
    own = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        rows: list[dict] = []

        def close() -> None:
            if head is not None:
                ok = head.pop("ok")
                h, tail, features, n = (head.pop(k) for k in ("h", "tail", "features", "n"))
                rows.append(head | {"payload_bytes": n if ok else None, "payload_sha256": h.hexdigest() if ok else None, "tail_crc32": zlib.crc32(tail) if ok else None, "feature": f"pages={len(features)};" + "|".join(features) if ok else None})

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
            rows.clear()
            return b

        for b in batches:
            schema = pa.schema([pa.field(c, b.schema.field(c).type) for c in own] + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
            for *names, page, pixels, feature in zip(*(b.column(c).to_pylist() for c in (*own, "page", "pixels", "feature")), strict=True):
                if not page:
                    close()
                    head = dict(zip(own, names, strict=True)) | {"h": hashlib.sha256(), "tail": b"", "features": [], "n": 0, "ok": True}
                if pixels is None:
                    head["ok"] = False
                    continue
                head["h"].update(pixels)
                head["n"] += len(pixels)
                head["tail"] = (head["tail"] + pixels[-64:])[-64:]
                head["features"].append(feature)
            if rows:
                yield batch()
        close()
        if rows:
            yield batch()

    src = pages.select(*own, "page", "pixels", "feature")
    made = src.mapInArrow(run, T.StructType([*[src.schema[c] for c in own], *T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string").fields]))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
