"""Fill-in-middle transformation by bit-parallel masks held in big integers.

A text's UTF-8 bytes become masks with a bit for each byte: bytes.translate maps a class of bytes to
the digit 1, and int() reads the digits as a binary number. Shifted boolean operations
mark the last byte of each token (white space and the word after it, or white space at
the end), bit_count gives the number of tokens, and the byte after the r-th token is found by halving the
mask again and again, so that all halves together are no longer than twice the text. White space is ASCII,
hence no byte of a longer character is taken for it, and cuts never split a character.

Cuts and form of a document follow from a hash of seed and id alone. A document is
transformed where it stands; no row is moved, and one text at a time is held besides its masks.

Defined results: null text counts as empty; an empty text, or one that holds a sentinel, stays plain; a null
id counts as an empty string; equal ids get equal draws, also where texts differ; columns of the input stay as they are,
and one with the name of a result is refused; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, refuse_clash

SPACES = b"\t\n\x0b\x0c\r "
SENTINELS = ("<P>", "<S>", "<M>")
_WORD = bytes(b"01"[b not in SPACES] for b in range(256))
_CHAR = bytes(b"01"[not 0x80 <= b < 0xC0] for b in range(256))


def mask(raw: bytes, digits: bytes) -> int:
    """Bit i is on if digits has a 1 for byte i of raw."""
    return int(raw[::-1].translate(digits) or b"0", 2)


def token_ends(raw: bytes) -> int:
    """The mask of the last byte of each token."""
    word = mask(raw, _WORD)
    ends = word & ~(word >> 1)
    return ends | 1 << len(raw) - 1 if raw else 0


def select(bits: int, rank: int) -> int:
    """Position of the on bit with this rank, from 1."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank <= n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the hash of seed and key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def transform(text: str, key: str, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output) of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = token_ends(raw)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(seed, key)
    marks = [s.encode() for s in sentinels]
    if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, text
    few, many = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = select(ends, few) + 1 if few else 0
    b = select(ends, many) + 1 if many else 0
    chars = mask(raw, _CHAR)
    to_a, to_b = ((chars & ((1 << x) - 1)).bit_count() for x in (a, b))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return n, form, to_a, to_b - to_a, out.decode("utf-8", "surrogatepass")


def fill_in_middle(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with fim_tokens, fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars and fim_output.

    rate percent of the documents are cut, spm percent of these with the suffix first.
    No sentinel may contain another or overlap with one, so that restored() is exact.
    """
    if len({s for s in sentinels if s}) < 3 or any((a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in sentinels for b in sentinels):
        raise ValueError("sentinels have to be three strings that can't overlap")
    added = {"fim_tokens": "long", "fim_form": "string", "fim_prefix_chars": "long", "fim_middle_chars": "long", "fim_output": "string"}
    refuse_clash(docs, *added, "fim_key_")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in by_bytes(whole, text)):
            keep = b.select([c for c in b.schema.names if c != "fim_key_"])
            texts, keys = b.column(text), b.column("fim_key_")
            rows = [transform(t.as_py() or "", k.as_py() or "", seed, rate, spm, sentinels) for t, k in zip(texts, keys, strict=True)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*keep.columns, *made], names=[*keep.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType() if k == "long" else T.StringType()) for c, k in added.items()]])
    return docs.withColumn("fim_key_", F.col(doc).cast("string")).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    quote = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in s) for s in sentinels)
    part = F.split(output, quote, -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(out: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row for each document: token count, form, lengths, and hashes of the output and of the text restored from it."""
    return out.select(
        F.col(doc).alias("doc_id"), F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )
