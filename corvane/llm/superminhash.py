"""Near-duplicate groups by SuperMinHash.

Per document: the set of its word shingles, and a signature in which every
element holds one random permutation of the slots; a slot keeps the smallest
rank-plus-fraction it is given. The ranks of an element are all different,
which lowers the variance against independent hashes, and the ranks are dealt
level by level, stopping once no higher rank can lower any slot.

Documents with equal sets are one node. Nodes that agree in a whole band share
a bucket. Buckets are searched by stars, never by all pairs: each member is compared with a
centre (the smallest key, then one drawn per bucket). A comparison of a star passes a filter on size
and signature, then is decided on the full sets, read from the whole texts. Verified links are
grouped by union-find: within partitions first, then by star contraction across them.

Members of buckets that then still hold several components are compared by their signatures, blocks of a bucket
against each other in numpy; pairs of different components that pass the filter are decided
on the full sets. Where nearly all members of a block would pass, it emits its members instead of pairs, and these are joined exactly, by
prefix filtering: shingles that only one component of them holds can't link; a member most of
whose shingles are such leaves. The others meet at their rarest remaining shingles, as many as any
similar set must share one of, and are compared there on the full sets. How rare a shingle is, and whether several
components hold it, is known by slots of its hash: shingles of a slot count together, which any order of shingles that
all members share allows, so only prefixes leave a task. One link per member and other component leaves a comparison.

Guarantee: candidates are found with probability 1 - (1 - s^rows)^bands (s = 0.8:
all but 5e-8); a candidate is lost only if its signatures agree in less than percent - 20 of
100 slots (below 1e-7 at s = 0.8). Sets are compared by 64-bit hashes of shingles, made from
cryptographic hashes of the words.

Defined results: null text counts as empty; documents without words link
with nothing; repeated documents are linked as equal texts; a null id never names a component
unless all ids in it are null; other columns of the input are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, text_key

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0d]")
BLOCK = 1 << 20


class _Words(dict):
    """Hashes of words; forgets all when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return v


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of each word, in order. Works in blocks, so that memory stays near the text's size."""
    out, a = [], 0
    while a < len(raw):
        b = min(len(raw), a + BLOCK)
        if b < len(raw):
            m = _NEXT_SPACE.search(raw, b)
            b = m.start() if m else len(raw)
        words = raw[a:b].split()
        out.append(np.fromiter(map(_WORDS.__getitem__, words), U, len(words)))
        a = b
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; fewer words count as one run; no words, none."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(size, len(h))
    total = np.full(len(h) - k + 1, U(k), U)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = mix(total + h[i : len(h) - k + 1 + i] * (_GOLD * U(2 * i + 1) | U(1)))
    return np.unique(total)


def signature(elements: np.ndarray, slots: int = 128) -> np.ndarray:
    """SuperMinHash signature: for each slot (rank << 32) + fraction, smallest over the elements."""
    best = np.full(slots, np.iinfo(np.int64).max, np.int64)
    rows, perm = np.arange(len(elements)), None
    for rank in range(slots):
        with np.errstate(over="ignore"):
            draw = mix(elements + U(rank + 1) * _GOLD)
        pick = rank + ((draw & U(0xFFFFFFFF)) * U(slots - rank) >> U(32)).astype(np.int64)
        value = (rank << 32) + (draw >> U(32)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            slot = perm[rows, pick]
            perm[rows, pick] = perm[:, rank]
        np.minimum.at(best, slot, value)
        if best.max() < (rank + 1) << 32:
            break  # a later rank can't lower any slot
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
            perm[rows, pick] = 0
    return best


def sketch(docs: DataFrame, doc: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (128-bit key of the set, null if empty), bands, sig (a byte per slot)."""
    slots = bands * rows
    salt = mix(np.arange(1, bands + 1, dtype=U) * _GOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, keys, sig = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                if not len(s):
                    node.append(None), keys.append([]), sig.append(None)
                    continue
                with np.errstate(over="ignore"):
                    key = np.array([mix(s).sum(dtype=U), mix(s ^ _GOLD).sum(dtype=U)])
                    m = signature(s, slots)
                    v = mix(m.astype(U)).reshape(bands, rows)
                    band = salt.copy()
                    for i in range(rows):
                        band = mix(band + v[:, i] * (_GOLD * U(2 * i + 1) | U(1)))
                node.append(key.tobytes())
                keys.append(band.astype(np.int64))
                sig.append((v.ravel() & U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "node", "bands", "sig"],
            )

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"))
    return src.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, node binary, bands array<long>, sig binary")


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 100_000) -> DataFrame:
    """(node, root) of every node on an edge; root is the smallest node of its component.

    Once no more than one_task edges are left, one task's union-find ends the contraction; the result is the same for any.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], batch_type) for i in (0, 1)], names=["v", "r"])

    kind = edges.schema[a].dataType.simpleString()
    batch_type = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind]
    spark = edges.sparkSession
    paths: list[str] = []
    now = materialize(edges.select(a, b).mapInArrow(local, f"v {kind}, r {kind}"), paths)
    state = None
    while True:
        if now.limit(one_task + 1).count() <= one_task:
            fresh = []
            now = materialize(now.coalesce(1).mapInArrow(local, f"v {kind}, r {kind}"), fresh)
            discard(spark, paths)
            paths = fresh
            break
        both = now.unionAll(now.select(F.col("r").alias("v"), F.col("v").alias("r")))
        low = both.groupBy("v").agg(F.min("r").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.filter(F.col("r") > F.col("v")).join(low, "v").select(F.col("r").alias("v"), F.col("low").alias("r")).filter("v != r").distinct()
        low = large.groupBy("v").agg(F.min("r").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("r").alias("v"), F.col("low").alias("r")), F.struct(F.col("v").alias("v"), F.col("low").alias("r")))).alias("e"))
        fresh: list[str] = []
        now = materialize(small.select("e.v", "e.r").filter("v != r").distinct(), fresh)
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "r").cast("decimal(38,0)"))).first())
        discard(spark, paths)
        paths = fresh
        if state == was:
            break
    out = materialize(now.select(F.col("v").alias("node"), F.col("r").alias("root")).unionAll(now.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct()))
    discard(spark, paths)
    return out


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; nodes has n and sig, texts the whole texts."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sig = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1) for c in ("sa", "sb")]
                ok = _close(sig[0], b.column("na").to_numpy(), sig[1], b.column("nb").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a binary, b binary")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            ok = []
            for k, x, y in zip(b.column("b").to_pylist(), b.column("tb").to_pylist(), b.column("ta").to_pylist(), strict=True):
                if k != last:  # rows of one centre follow each other
                    last, held = k, shingle_set(x, size)
                other = shingle_set(y, size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    text = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}"))
    return close.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(same, "a binary, b binary")


def _close(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures (last axis) and sizes allow the similarity; only then sets are looked at."""
    return ((sa == sb).mean(axis=-1) >= (percent - 20) / 100) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _candidates(left: DataFrame, nodes: DataFrame, percent: int, block: int = 1000, crowd: int = 16) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, differ in root and pass the filter; (a, null) for the members of a block with more than `crowd` such pairs a member.

    left: (band, node, members, root).
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = left.join(nodes.select("node", "n_shingles", "sig"), "node").withColumn("k", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = own.select("band", "node", "root", "n_shingles", "sig", "k", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    dealt = dealt.select("band", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "root", "n_shingles", "sig")

    def near(rows: list[tuple]) -> set[tuple]:
        ids: dict[bytes, int] = {}
        root = np.array([ids.setdefault(r[5], len(ids)) for r in rows])
        if len(ids) < 2:
            return set()
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1)
        n, k = np.array([r[6] for r in rows]), np.array([r[3] for r in rows])
        found: set[tuple] = set()
        for at in range(0, len(rows), 64):
            x = slice(at, at + 64)
            ok = (root[x, None] != root[None]) & (np.arange(len(rows))[x, None] < np.arange(len(rows))[None])
            if rows[0][1] != rows[0][2]:
                ok &= k[x, None] != k[None]
            a, b = np.nonzero(ok)
            a += at
            fits = _close(sig[a], n[a], sig[b], n[b], percent)
            found.update((max(rows[i][4], rows[j][4]), min(rows[i][4], rows[j][4])) for i, j in zip(a[fits], b[fits], strict=True))
            if len(found) > crowd * len(rows):
                return {(r[4], None) for r in rows}
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple] = set()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.binary()) for c in (0, 1)], names=["a", "b"])
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:3] != r[:3]:
                    found |= near(group)
                    group.clear()
                group.append(r)
            if len(found) > 20_000:
                yield batch()
                found.clear()
        found |= near(group) if group else set()
        yield batch()

    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a binary, b binary").distinct()


def _compare(rows: list[tuple], percent: int) -> Iterator[tuple]:
    """Links of members outside the commonest root with others; rows: (.., i, j, k, node, root, set) of one pair of blocks."""
    ids: dict[bytes, int] = {}
    root = np.array([ids.setdefault(r[5], len(ids)) for r in rows])
    if len(ids) < 2:
        return
    sets = [np.frombuffer(r[6], U) for r in rows]
    k, n = np.array([r[3] for r in rows]), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(rows), dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    main = np.bincount(root).argmax()
    for x in np.flatnonzero(root != main):
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        runs = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        ok = (100 * both >= percent * (n[x] + n - both)) & (root != root[x])
        if rows[x][1] != rows[x][2]:
            ok &= k != k[x]
        best: dict[int, int] = {}
        for y in np.flatnonzero(ok):
            if both[y] > both[best.get(root[y], y)] or root[y] not in best:
                best[root[y]] = y
        for y in best.values():
            yield rows[x][4], rows[y][4]


#: Counters of shingles by hash; a bound of what the driver and each task hold of them, 2 MB a column.
SLOTS = 1 << 18


def _slots(x: np.ndarray) -> np.ndarray:
    return x & (SLOTS - 1)


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return (flat[i:j] for i, j in zip(at, at[1:], strict=False))


def _residue(left: DataFrame, texts: DataFrame, size: int, percent: int, block: int = 500) -> DataFrame:
    """Links (a, b) of the nodes of left that differ in root: for each node at most one per other root and comparison.

    left: (node, root), each node once. An exact join by prefix filtering, see the module.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size).astype(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "root", "set"])

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of each slot, and the least and greatest root among them, of one task."""
        m, low, high = np.zeros(SLOTS, np.int64), np.full(SLOTS, 2**63 - 1), np.full(SLOTS, -(2**63))
        for b in batches:
            for root, x in zip(b.column("root").to_pylist(), _arrays(b.column("set")), strict=True):
                at = _slots(x)
                np.add.at(m, at, 1)
                r = int.from_bytes(root[:8], "little", signed=True)
                low[at], high[at] = np.minimum(low[at], r), np.maximum(high[at], r)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in (m, low, high))], names=["slot", "m", "low", "high"])

    own = materialize(left.join(texts, "node").select("node", "root", "text").mapInArrow(hashes, "node binary, root binary, set array<long>"))
    # dealt out evenly: the members of a few blocks may stand in a few files
    even = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = even.mapInArrow(counters, "slot long, m long, low long, high long").groupBy("slot").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = np.zeros(SLOTS, np.int64)
    for r in total.filter("low != high").select("slot", "m").toLocalIterator():  # at most SLOTS rows
        held[r["slot"]] = r["m"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first n - least + 1 elements of each set, elements of rare slots first; those of slots that one root holds count before all and can't meet another root."""
        for b in batches:
            nodes, roots, found = b.column("node").to_pylist(), b.column("root").to_pylist(), []
            for x in _arrays(b.column("set")):
                m = held[_slots(x)]
                least, kept = -(-percent * len(x) // 100), x[m > 0]
                order = np.lexsort((kept, m[m > 0]))
                found.append(kept[order[: max(0, len(kept) - least + 1)]])
            each = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in each], pa.binary()) for c in (nodes, roots)] + [pa.array(np.concatenate(found) if found else [], pa.int64())], names=["node", "root", "e"])

    meet = materialize(even.mapInArrow(prefixes, "node binary, root binary, e long"))
    shared = materialize(meet.groupBy("e").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("e", "m"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = meet.join(shared, "e").select("node", "root", "e", "m").join(own.select("node", "set"), "node").withColumn("k", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.select("e", "node", "root", "set", "k", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")).select("e", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "root", "set")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            sets = b.column("set")
            flat, at = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_pylist()
            for i, r in enumerate(zip(*(c.to_pylist() for c in b.columns[:6]), strict=True)):
                yield *r, flat[at[i] : at[i + 1]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple] = set()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.binary()) for c in (0, 1)], names=["a", "b"])
        for r in pack(batches):
            if group and group[0][:3] != r[:3]:
                found.update((max(p), min(p)) for p in _compare(group, percent))
                group.clear()
                if len(found) > 20_000:
                    yield batch()
                    found.clear()
            group.append(r)
        if group:
            found.update((max(p), min(p)) for p in _compare(group, percent))
        yield batch()

    cols = ["e", "i", "j", "k", "node", "root", "set"]
    return dealt.select(*cols).repartition("e", "i", "j").sortWithinPartitions("e", "i", "j").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id (smallest id of the group), links (verified links of its set found)."""
    with scratch(docs.sparkSession):
        return materialize(_groups(docs, doc, text, size, percent, bands, rows, rounds), outer=True)


def _groups(docs: DataFrame, doc: str, text: str, size: int, percent: int, bands: int, rows: int, rounds: int) -> DataFrame:
    sketches = materialize(sketch(docs, doc, text, size, bands, rows))
    nodes = materialize(sketches.filter("node is not null").select("node", "n_shingles", "bands", "sig", "text_key").dropDuplicates(["node"]))
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members")).filter("low != high")
    shared = materialize(shared.select("band", "low", "members"))  # so that the join's skewed partitions can be split
    buckets = materialize(spread.join(shared, "band"))
    named = materialize(buckets.select("node").distinct().join(nodes.select("node", "text_key"), "node"))
    once = docs.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).groupBy("text_key").agg(F.first("text").alias("text"))
    texts = materialize(once.join(named, "text_key").select("node", "text"))

    sized = nodes.select("node", "n_shingles", "sig")
    star = buckets.filter("node != low").select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b")).distinct()
    tested = materialize(star)
    links = materialize(_verify(tested, sized, texts, size, percent))
    roots = components(links)
    left = buckets.filter("members > 2").select("band", "node", "members")
    for r in range(1, rounds + 1):
        known = materialize(left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        draw = F.xxhash64("node", "band", F.lit(r))
        open_ = known.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("node", draw).alias("centre"), F.min_by("root", draw).alias("centre_root")).filter("r0 != r1")
        open_ = materialize(open_.drop("r0", "r1"))
        left = materialize(known.join(open_, "band"))
        if r < rounds:
            pairs = left.filter("root != centre_root").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
        else:
            near = materialize(_candidates(left.select("band", "node", "members", "root"), sized, percent))
            pairs = near.filter("b is not null")
        left = left.select("band", "node", "members")
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tested = tested.unionAll(pairs)
            links = links.unionAll(materialize(_verify(pairs, sized, texts, size, percent)))
            roots = components(links)
    dense = near.filter("b is null").select(F.col("a").alias("node")).distinct()
    if not dense.isEmpty():
        dense = dense.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        links = links.unionAll(materialize(_residue(dense, texts, size, percent).distinct()))
        roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of_set = sketches.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low_id"))
    of_set = of_set.join(roots, "node", "left").join(degree, "node", "left").select("node", "low_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    of_set = materialize(of_set)
    lowest = of_set.groupBy("root").agg(F.min("low_id").alias("component_id"))
    groups = materialize(of_set.join(lowest, "root").select("node", "component_id", "links"))
    out = sketches.select("doc_id", "text_key", "n_shingles", "node").join(groups, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
