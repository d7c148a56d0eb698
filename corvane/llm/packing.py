"""Documents packed into fixed windows in their order, cut by dynamic programming.

Documents are ordered by range, and each range of them is one stream of tokens. The cuts between windows are chosen among
ends of documents, ends of sentences and, within longer stretches without either, every STRIDE-th token: the sum of
padding and of penalties for cuts inside documents and sentences is the least that any choice of these cuts has. With
cost[b] = penalty[b] + min over a of cost[a] + padding(b - a), the minimum over the last `size` tokens of
cost[a] + a comes from a monotone queue, so a cut costs constant time. Lengths that are powers of two take no
padding; they are further transitions among the last SHORT windows of a stream, at a charge of their own, as it is only there that
much padding can be spared.

A stream is solved in blocks of about BLOCK tokens: all windows but the last few of a block are final, and the tokens of those
begin the next block. Memory is that of a block and of the longest document. Only the last window of a range is
ended by the dealing itself, so how many windows are not full depends on the number of ranges, not of documents.

Identifiers are those of the `tokenizers` library. Texts whose characters are all of the plain set below are
encoded by tiktoken from the same vocabulary, which gives the same ids in a sixth of the time; the tests compare them.
Strings of special tokens are ordinary text.

Defined results: null text counts as empty and is its end token alone; rows with one id are documents of their own, in the order of
a hash of their texts; null ids come first; other columns are ignored; an empty table gives an empty result. A
document is encoded by one task, so it has to fit in its memory.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

BLOCK, TAIL, STRIDE, SHORT = 1 << 19, 16, 32, 4
#: Characters on which both encoders are known to agree.
ODD = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞€]")
#: Bytes of plain characters only, where they are valid UTF-8: what is left without them decides whether to look closer.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


def odd(text: str) -> bool:
    """Whether a text has other characters than the plain set."""
    return bool(text.encode("utf-8", "surrogatepass").translate(None, _PLAIN)) and ODD.search(text) is not None



@functools.cache
def _loaded(path: str | None, ranks: str | None) -> tuple:
    """Both encoders, and by token: whether it ends with a stop, ends with a line, begins with white space. Once a process."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    kinds = np.zeros((3, max(table.values()) + 2), bool)
    for token, i in table.items():
        kinds[0, i] = token.rstrip(b"\"')").endswith((b".", b"!", b"?", "…".encode()))
        kinds[1, i], kinds[2, i] = token.endswith(b"\n"), token[:1] in b" \t\n\r"
    return slow, fast, kinds


class Encoder:
    """Token ids of texts by a byte-level BPE, from two files of one vocabulary."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        self.path, self.ranks = path, ranks

    def encode(self, text: str) -> np.ndarray:
        slow, fast, _ = _loaded(self.path, self.ranks)
        ids = slow.encode(text, add_special_tokens=False).ids if odd(text) else fast.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions after the tokens that end a line, or a sentence: a stop before white space."""
        stops, lines, spaces = _loaded(self.path, self.ranks)[2]
        at = np.minimum(ids, len(stops) - 1)
        return np.flatnonzero(lines[at[:-1]] | stops[at[:-1]] & spaces[at[1:]]) + 1


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int, short: float = 0.0, short_from: int = 0) -> list[int]:
    """Indexes into `at` of the cuts of least cost, from the first to the last of `at`, which rises by at most `size` a step.

    From position short_from on, a window of less than `size` tokens, but a power of two, may cost `short` instead of its padding.
    """
    n = len(at)
    low = np.searchsorted(at, at - size).tolist()
    exact: dict[int, list[int]] = {}
    base = int(np.searchsorted(at, short_from))
    late, step = at[base:], 1
    while step < size and len(late):
        j = np.searchsorted(late, late - step)
        for i in np.flatnonzero(late[j] == late - step).tolist():
            exact.setdefault(base + i, []).append(base + int(j[i]))
        step *= 2
    pos, pay = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    where, keys, head = [0], [float(pos[0])], 0  # the queue: positions and their cost[a] + a, both rising
    for i in range(1, n):
        first = low[i]
        while where[head] < first:
            head += 1
        p, j = pos[i], where[head]
        c = keys[head] + size - p
        if i in exact:
            for e in exact[i]:
                if cost[e] + short < c:
                    c, j = cost[e] + short, e
        cost[i], back[i] = c + pay[i], j
        k = c + pay[i] + p
        while len(keys) > head and keys[-1] > k:
            keys.pop()
            where.pop()
        keys.append(k)
        where.append(i)
    out, i = [n - 1], n - 1
    while i:
        i = back[i]
        out.append(i)
    return out[::-1]


def _candidates(ends: np.ndarray, sentences: np.ndarray, total: int, stride: int, by_sentence: float, inside: float) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts 0 .. total and their penalties."""
    kind = np.zeros(total + 1, np.int8)
    kind[sentences] = 1
    kind[ends] = 2
    kind[0] = 2
    at = np.flatnonzero(kind)
    gap = np.diff(at)
    more = (gap - 1) // stride  # inner cuts of each gap
    first = np.repeat(at[:-1], more)
    inner = first + stride * (1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more))
    kind[inner] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0.0, by_sentence, 0.0, inside])[kind[at]]


class _Stream:
    """Tokens of consecutive documents that no final window holds yet."""

    def __init__(self, size: int, encoder: Encoder, end: int, by_sentence: float, inside: float, short: float):
        self.size, self.encoder, self.end, self.costs, self.short = size, encoder, end, (by_sentence, inside), short
        self.docs: list[tuple[object, np.ndarray, np.ndarray, int]] = []  # key, ids, sentence ends, tokens already given out
        self.held, self.made = 0, 0

    def add(self, key: object, text: str) -> None:
        ids = np.append(self.encoder.encode(text), np.uint32(self.end))
        self.docs.append((key, ids, self.encoder.sentence_ends(ids[:-1]), 0))
        self.held += len(ids)

    def pieces(self, last: bool) -> Iterator[tuple[object, int, np.ndarray, int, int, int]]:
        """(key, start, ids, tokens of the document, window, offset) of the windows that are final."""
        if not self.docs:
            return
        left = np.array([len(ids) - done for _, ids, _, done in self.docs])
        ends = np.cumsum(left)
        starts = ends - left
        sentences = np.concatenate([s[s > done] - done + a for (_, _, s, done), a in zip(self.docs, starts.tolist(), strict=True)])
        at, pay = _candidates(ends, sentences, self.held, min(STRIDE, self.size), *self.costs)
        cuts = at[best_cuts(at, pay, self.size, self.short, max(0, self.held - SHORT * self.size) if last else self.held)]
        if not last:
            cuts = cuts[: max(1, int(np.searchsorted(cuts, self.held - TAIL * self.size, "right")))]
        edges = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        of = np.searchsorted(ends, edges[:-1], "right")
        for a, b, w, d in zip(edges[:-1].tolist(), edges[1:].tolist(), window.tolist(), of.tolist(), strict=True):
            key, ids, _, done = self.docs[d]
            start = a - int(starts[d]) + done
            yield key, start, ids[start : start + b - a], len(ids), self.made + w, a - int(cuts[w])
        self.made += len(cuts) - 1
        gone = int(np.searchsorted(ends, cuts[-1], "right"))
        rest = self.docs[gone:]
        if rest:
            key, ids, s, done = rest[0]
            rest[0] = (key, ids, s, done + int(cuts[-1] - starts[gone]))
        self.docs, self.held = rest, self.held - int(cuts[-1])


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 1024, encoder: Encoder | None = None, end: int = 0, by_sentence: float = 1.0, inside: float = 8.0, short: float = 64.0) -> DataFrame:
    """Pieces of the documents: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are those of its text and the token `end`. by_sentence and inside are the penalties of
    cuts after a sentence within a document and within a sentence, short is the charge for a short window without padding,
    all in tokens of padding. Sequences are numbered in the
    order of the documents, with gaps between ranges.
    """
    encoder = encoder or Encoder()
    kind = docs.schema[doc].dataType
    rows = docs.select(F.col(doc).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["key", "hash", "row"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in (("start", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(size, encoder, end, by_sentence, inside, short)
        base = TaskContext.get().partitionId() << 33
        key_type: list[pa.DataType] = []

        def emitted(last: bool) -> Iterator[pa.RecordBatch]:
            rows = list(stream.pieces(last))
            for i in range(0, len(rows), 4096):
                key, start, ids, total, window, offset = zip(*rows[i : i + 4096], strict=True)
                parts = [pa.array(key, key_type[0]), pa.array(start, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array([base + w for w in window], pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(parts, names=schema.names)

        for b in (s for whole in batches for s in by_bytes(whole, "text")):
            key_type[:] = [b.schema.field("key").type]
            for k, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                stream.add(k, t.as_py())
                if stream.held >= BLOCK:
                    yield from emitted(False)
        if key_type:
            yield from emitted(True)

    return dealt.mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
