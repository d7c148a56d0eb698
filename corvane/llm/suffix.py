"""Exact removal of repeated byte strings by anchored suffix sorting.

A window is a string of `length` bytes; a byte is removed if a window that also
starts anywhere else covers it. Every window has one anchor: the leftmost
smallest of its k-gram hashes. Equal windows have equal anchors at equal
offsets, so only suffixes that start at anchors need sorting, to the right and,
reversed, to the left, and only among occurrences of one anchor:

1. Texts that occur more than once are repeated whole. Each distinct text stands
   for its copies from here on.
2. Anchors of all texts are counted by hash. Windows of an anchor that occurs
   once are unique and leave.
3. The bytes of all windows of an anchor are its fragment. Fragments are counted; one
   that occurs again has all its windows repeated, and one row stands for it.
4. The distinct fragments of an anchor are sorted by deep-shallow sorting: multikey
   quicksort to a shallow depth, then a blind trie for each group that still
   shares a prefix. Common prefixes to the right and left of the anchor tell
   which windows two fragments share. Only fragments that occur once want an answer.
5. An anchor with more than max_group distinct fragments is split: the offsets that
   its windows can have are halved, and in each half fragments part by the bytes
   that all windows of these offsets hold. The parts are counted and sorted like anchors, or
   halved again; at one offset a part is a single window, so the halving ends.

No task sorts more than max_group fragments, whatever an anchor's share of all rows, and the
result doesn't depend on max_group. Fragments are compared by 128-bit cryptographic
hashes where they are counted and by their bytes where they are sorted.

Defined results: null text counts as empty; texts shorter than a window lose
nothing; repeated documents are copies of each other and lose every byte that a
window covers; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, text_key
from .superminhash import U, mix

BLOCK = 1 << 19
_BYTE = np.random.default_rng(20170616).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size, x, U)])) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Arrays (p, s, n, h): anchor position, first window, number of windows, hash of the k-gram."""
    w, parts = length - k + 1, []
    for a in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = np.frombuffer(raw, np.uint8, min(len(raw), a + BLOCK + length - 1) - a, a)
        power, inverse = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U(0)], np.cumsum(_BYTE[part] * power[: len(part)])])
            v = mix((sums[k:] - sums[:-k]) * inverse[: len(part) - k + 1])
            low = (v >> U(20) << U(20)) | np.arange(len(v), dtype=U)
            step = 1
            while step * 2 <= w:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if step < w:
                low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
            at = (low & U(0xFFFFF)).astype(np.int64)
            s = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            n = np.diff(np.concatenate([s, [len(at)]]))
        parts.append((at[s] + a, s + a, n, v[at[s]].astype(np.int64)))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids", "leaves")

    def __init__(self, depth: int, kids: dict, leaves: list):
        self.depth, self.kids, self.leaves = depth, kids, leaves


def blind_trie(strings: list[bytes], items: list[int]) -> tuple[list[int], list[int]]:
    """Sorted items and the common prefix of each with the one before.

    Nodes keep only a branching depth and characters; a string descends
    blindly to some leaf, is compared with it once, and is hung in where they part.
    """
    root = _Node(len(strings[items[0]]), {}, [items[0]])
    for i in items[1:]:
        s, node = strings[i], root
        while node.kids:
            node = node.kids.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.kids.values()))
        t = strings[node.leaves[0]]
        n = common_prefix(s, t)
        if n == len(s) == len(t):
            node.leaves.append(i)
            continue
        above, node = None, root
        while node.kids and node.depth < n:
            above, node = node, node.kids[s[node.depth]]
        leaf = _Node(len(s), {}, [i])
        key = lambda x, d=n: x[d] if d < len(x) else -1
        if node.kids and node.depth == n:
            node.kids[key(s)] = leaf
            continue
        split = _Node(n, {key(t): node, key(s): leaf}, [])
        if above is None:
            root = split
        else:
            above.kids[s[above.depth]] = split
    order, lcp, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if node.kids:
            kids = [node.kids[c] for c in sorted(node.kids)]
            stack.extend((x, node.depth if j else before) for j, x in reversed(list(enumerate(kids))))
        else:
            order += node.leaves
            lcp += [before] + [node.depth] * (len(node.leaves) - 1)
    return order, lcp


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = 32, step: int = 8) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with the one before it (0 for the first).

    The first `known` bytes are equal in all. Multikey quicksort compares `step`
    bytes at a time down to `shallow` bytes further; what is still equal then goes to blind tries.
    """
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), known)]
    while stack:
        items, d = stack.pop()
        if len(items) == 1:
            more, inner = items, [0]
        elif d >= known + shallow:
            more, inner = blind_trie(strings, items)
        else:
            keys = {i: strings[i][d : d + step] for i in items}
            pivot = sorted((keys[items[0]], keys[items[len(items) // 2]], keys[items[-1]]))[1]
            less, same, greater = [], [], []
            for i in items:
                c = keys[i]
                (same if c == pivot else less if c < pivot else greater).append(i)
            if greater:
                stack.append((greater, d))
            if len(pivot) < step:  # these strings end here, all alike
                if less:
                    stack.append((same, known + shallow))
                    stack.append((less, d))
                    continue
                more, inner = blind_trie(strings, same)
            else:
                stack.append((same, d + step))
                if less:
                    stack.append((less, d))
                continue
        if order:
            inner[0] = common_prefix(strings[order[-1]], strings[more[0]])
        order += more
        lcp += inner
    return order, lcp


def repeated_windows(frags: list[bytes], at: list[int], count: list[int], copies: list[int], length: int) -> list[np.ndarray]:
    """For the distinct fragments of one anchor: which of its windows (by start) are repeated.

    A fragment has its anchor at byte `at` and `count` windows, of offsets at..at-count+1 before the anchor.
    """
    n = len(frags)
    out = [np.full(c, m > 1) for c, m in zip(count, copies, strict=True)]
    if n == 1:
        return out
    right, rl = deep_shallow([x[a:] for x, a in zip(frags, at, strict=True)], shallow=64)
    left, ll = deep_shallow([x[:a][::-1] for x, a in zip(frags, at, strict=True)])
    if n <= 24:
        rp, lp = [0] * n, [0] * n
        for j, i in enumerate(right):
            rp[i] = j
        for j, i in enumerate(left):
            lp[i] = j
        for i in range(n):
            for j in range(i):
                a, b = sorted((rp[i], rp[j]))
                r = min(rl[a + 1 : b + 1])
                a, b = sorted((lp[i], lp[j]))
                hi = min(min(ll[a + 1 : b + 1]), at[i], at[j])
                lo = max(length - r, at[i] - count[i] + 1, at[j] - count[j] + 1)
                if lo <= hi:
                    out[i][at[i] - hi : at[i] - lo + 1] = True
                    out[j][at[j] - hi : at[j] - lo + 1] = True
        return out
    at_, count_ = np.array(at), np.array(count)
    rl_, ll_, weight = np.array(rl), np.array(ll), np.array(copies)
    right_, left_ = np.array(right), np.array(left)
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int((at_ - count_ + 1).min()), int(at_.max()) + 1):
        rc[right_] = np.cumsum(rl_ < length - o)
        lc[left_] = np.cumsum(ll_ < o)
        own = np.flatnonzero((at_ >= o) & (at_ - count_ + 1 <= o))
        _, cls, size = np.unique(rc[own] * (n + 1) + lc[own], return_inverse=True, return_counts=True)
        for i in own[(size[cls] > 1) | (weight[own] > 1)]:
            out[i][at[i] - o] = True
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Flat list of first and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.column_stack([edge[::2], edge[1::2] - 1]).ravel().tolist()


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds.values())], names=list(kinds))


#: Occurrences of a fragment that make a row.
PIECE = 32
#: A fragment as a task has it, with how often it has it: anchor, hash of the fragment's bytes, weight (1 for an occurrence that wants an answer; 2 for one that
#: stands for several) and the least occurrence: text, first window, number of windows, anchor position. b: the block of texts that a task has gathered, named by one of them; a text is in one block only.
#: xs: windows of the occurrences that want an answer.
SPOT = {"h": pa.int64(), "f": pa.int64(), "g": pa.int64(), "w": pa.int64(), "rid": pa.int64(), "s": pa.int32(), "n": pa.int32(), "p": pa.int32(), "b": pa.int64()}
SPOT_DDL = "h long, f long, g long, w long, rid long, s int, n int, p int, b long, xs array<struct<rid: long, s: int, e: int>>"


def _gathered(rows: list[tuple]) -> pa.RecordBatch:
    """Occurrences (h, f, g, rid, s, n, p, w) with a row for each PIECE of a fragment's: what is common in the texts of a task isn't joined once a text."""
    own: list[list] = []
    last: dict[tuple, list] = {}
    for h, f, g, rid, s, n, p, w in rows:
        x = last.get((h, f, g))
        if x is None or len(x[2]) == PIECE:
            x = last[h, f, g] = [0, (rid, s, n, p), [], (h, f, g)]
            own.append(x)
        x[0] += w
        x[1] = min(x[1], (rid, s, n, p))
        if w == 1:
            x[2].append((rid, s, s + n - 1))
    flat = [y for x in own for y in x[2]]
    kinds = {"rid": pa.int64(), "s": pa.int32(), "e": pa.int32()}
    each = pa.StructArray.from_arrays([pa.array([y[j] for y in flat], k) for j, k in enumerate(kinds.values())], names=list(kinds))
    xs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[2]) for x in own)]), pa.int32()), each)
    b = _batch([(*x[3], x[0], *x[1], rows[0][3]) for x in own], **SPOT)
    return pa.RecordBatch.from_arrays([*b.columns, xs], names=[*SPOT, "xs"])


def _content(piece: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(piece, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _spots(hit: DataFrame, length: int, k: int) -> DataFrame:
    """The fragments of repeated anchors, with their occurrences; hit: rid, text, at (numbers of anchors), w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, t, at, w in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "at", "w")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                p, s, n, h = (x.tolist() for x in anchors(raw, length, k))
                rows += [(h[i], *_content(raw[s[i] : s[i] + n[i] - 1 + length]), rid, s[i], n[i], p[i], w) for i in at]
                if len(rows) > 20_000:
                    yield _gathered(rows)
                    rows = []
            yield _gathered(rows)

    return hit.select("rid", "text", "at", "w").mapInArrow(run, SPOT_DDL)


def _answered(spots: DataFrame, many: DataFrame) -> DataFrame:
    """(rid, s, e): ranges of windows whose fragments are in many (each once), neighbours in one. The answers of a block of texts meet as they were
    gathered and become rows of their texts there, so that a passage of several fragments isn't dealt to its texts fragment by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("xs"):
                rid, s, e = (x.to_numpy(zero_copy_only=False) for x in block.values.flatten().flatten())
                order = np.lexsort((s, rid))
                rid, s, e = rid[order], s[order], e[order]
                new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (s[1:] > e[:-1] + 1)])  # a text's fragments have no window in common
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(s)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(s[first]), pa.array(e[last])], names=["rid", "s", "e"])

    own = spots.filter(F.size("xs") > 0).join(many, ["h", "f", "g"]).groupBy("b").agg(F.collect_list("xs").alias("xs"))
    return own.select("xs").mapInArrow(run, "rid long, s int, e int")


def _with_text(spots: DataFrame, texts: DataFrame) -> DataFrame:
    """rid, text, xs: the spots of each text, so that a text travels once."""
    return spots.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "n", "p", "lone")).alias("xs")).join(texts, "rid").select("rid", "text", "xs")


def _sorted(spots: DataFrame, texts: DataFrame, length: int, k: int) -> DataFrame:
    """(rid, s, e): ranges of windows of lone fragments that are repeated; groups of h being complete within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"h": pa.int64(), "at": pa.int32(), "n": pa.int32(), "frag": pa.binary(), "lone": pa.bool_(), "rid": pa.int64(), "s": pa.int32()}
        for b in batches:
            rows = []
            for rid, t, xs in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "xs")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                rows += [(x["h"], x["p"] - x["s"], x["n"], raw[x["s"] : x["s"] + x["n"] - 1 + length], x["lone"], rid, x["s"]) for x in xs]
                if len(rows) > 20_000:
                    yield _batch(rows, **kinds)
                    rows = []
            yield _batch(rows, **kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        done: list[tuple] = []
        kinds = {"rid": pa.int64(), "s": pa.int32(), "e": pa.int32()}

        def flush() -> None:
            if rows:
                found = repeated_windows([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [1 if r[4] else 2 for r in rows], length)
                for r, flags in zip(rows, found, strict=True):
                    if r[4]:
                        x = _runs(flags)
                        done.extend((r[5], r[6] + x[j], r[6] + x[j + 1]) for j in range(0, len(x), 2))
                rows.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    flush()
                rows.append(r)
            if len(done) > 20_000:
                yield _batch(done, **kinds)
                done.clear()
        flush()
        yield _batch(done, **kinds)

    frags = _with_text(spots, texts).mapInArrow(cut, "h long, at int, n int, frag binary, lone boolean, rid long, s int")
    return frags.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(run, "rid long, s int, e int")


def _split(spots: DataFrame, texts: DataFrame, length: int, k: int, width: int) -> DataFrame:
    """The spots anew, a row for each range of `width` offsets that their windows have; those of one range and one anchor part by the bytes all its windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, t, xs in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "xs")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for x in xs:
                    p, first, last = x["p"], x["p"] - x["s"] - x["n"] + 1, x["p"] - x["s"]
                    for a in range(first // width * width, last + 1, width):
                        z = min(a + width - 1, length - k)
                        lo, hi = max(a, first), min(z, last)
                        own = hashlib.blake2b(b"%d %d %d " % (x["h"], width, a) + raw[p - a : p + length - z], digest_size=8).digest()
                        s, n = p - hi, hi - lo + 1
                        rows.append((int.from_bytes(own, "little", signed=True), *_content(raw[s : s + n - 1 + length]), rid, s, n, p, 1 if x["lone"] else 2))
                if len(rows) > 20_000:
                    yield _gathered(rows)
                    rows = []
            yield _gathered(rows)

    return _with_text(spots, texts).mapInArrow(run, SPOT_DDL)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 200, k: int = 32, max_group: int = 1000) -> DataFrame:
    """(text_key, text, spans) of each distinct text with repeated bytes; spans: flat array of first byte and end of the runs, merged and in order.

    max_group bounds what one task sorts at a time; the result is the same for any.
    """
    with scratch(docs.sparkSession):
        return materialize(_spans(docs, text, length, k, max_group), outer=True)


def _spans(docs: DataFrame, text: str, length: int, k: int, max_group: int) -> DataFrame:
    long_enough = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [anchors(t.encode("utf-8", "surrogatepass"), length, k)[3] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(hs, pa.list_(pa.int64()))], names=["text_key", "hs"])

    made = long_enough.mapInArrow(find, "text_key binary, hs array<long>").groupBy("text_key").agg(F.first("hs").alias("hs"), F.count("*").alias("copies"))
    made = materialize(made.select(F.monotonically_increasing_id().alias("rid"), "text_key", "hs", F.least("copies", F.lit(2)).cast("int").alias("w")))
    each = made.select("rid", "w", F.posexplode("hs").alias("i", "h"))
    again = materialize(each.groupBy("h").agg(F.sum("w").alias("c")).filter("c > 1").select("h"))
    spots = each.select("h", "rid", "i").join(again, "h").groupBy("rid").agg(F.collect_list("i").alias("at"))
    texts = long_enough.groupBy("text_key").agg(F.first("text").alias("text"))
    hit = materialize(texts.join(made.select("rid", "text_key", "w").join(spots, "rid"), "text_key"))

    found = []
    own, width = hit.select("rid", "text"), length - k + 1
    now = materialize(_spots(hit, length, k))
    while True:
        parts = now.groupBy("h", "f", "g").agg(F.sum("w").alias("c"), F.min(F.struct("rid", "s", "n", "p")).alias("o"))
        parts = materialize(parts.select("h", "f", "g", "c", "o.*"))
        many = parts.filter("c > 1").select("h", "f", "g")
        found.append(materialize(_answered(now, many)))
        keys = parts.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("lone")).filter("kinds > 1 and lone > 0")
        keys = materialize(keys.select("h", "kinds"))
        need = materialize(parts.join(keys, "h").select("h", "rid", "s", "n", "p", (F.col("c") == 1).alias("lone"), "kinds"))
        found.append(materialize(_sorted(need.filter(F.col("kinds") <= max_group), own, length, k)))
        crowded = need.filter(F.col("kinds") > max_group)
        if width == 1 or crowded.isEmpty():
            break
        width = (width + 1) // 2
        now = materialize(_split(crowded, own, length, k, width))
    runs = found[0]
    for x in found[1:]:
        runs = runs.unionAll(x)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, w, xs in zip(*(b.column(c).to_pylist() for c in ("text", "w", "xs")), strict=True):
                spans: list[int] = [0, len(t.encode("utf-8", "surrogatepass"))] if w > 1 else []
                for a, z in sorted((x["s"], x["e"]) for x in xs or ()):
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], z + length)
                    else:
                        spans += [a, z + length]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("text_key"), b.column("text"), pa.array(out, pa.list_(pa.int64()))], names=["text_key", "text", "spans"])

    per_text = runs.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("xs"))
    full = hit.select("rid", "text_key", "text", "w").join(per_text, "rid", "left").filter("w > 1 or xs is not null")
    return full.select("text_key", "text", "w", "xs").mapInArrow(merge, "text_key binary, text string, spans array<long>")


def cut_out(raw: bytes, spans: list[int]) -> bytes:
    """raw without its spans."""
    at, keep = 0, []
    for i in range(0, len(spans), 2):
        keep.append(raw[at : spans[i]])
        at = spans[i + 1]
    return b"".join([*keep, raw[at:]])


def whole_characters(raw: bytes, spans: list[int]) -> list[int]:
    """spans moved inwards to the bounds of UTF-8 characters, emptied ones left out."""
    out = []
    for i in range(0, len(spans), 2):
        a, z = spans[i], spans[i + 1]
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out += [a, z]
    return out


def cut_texts(found: DataFrame) -> DataFrame:
    """(text_key): each text of repeated_spans() without its spans, cut at whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                kept.append(cut_out(raw, whole_characters(raw, s)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(kept, pa.string())], names=["text_key", "kept"])

    return found.mapInArrow(run, "text_key binary, kept string")


def digest(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                rows.append((sum(s[1::2]) - sum(s[::2]), len(s) // 2, hashlib.sha256(cut_out(t.encode("utf-8", "surrogatepass"), s)).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("text_key"), *[pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["text_key", "r", "s", "h"])

    cut = found.mapInArrow(run, "text_key binary, r long, s long, h string")
    whole = F.coalesce(F.col(text), F.lit(""))
    all_docs = docs.select(F.col(doc).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("own"))
    return all_docs.join(cut, "text_key", "left").select("doc_id", "n_bytes", F.coalesce("r", F.lit(0)).alias("n_removed"), F.coalesce("s", F.lit(0)).alias("n_spans"), F.coalesce("h", "own").alias("kept_sha256"))
