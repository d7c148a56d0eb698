"""Quantized vectors: random rotation, Lloyd-Max codebooks, sign sketches, packed payloads, compressed search.

mse: the rotated unit vector is coded coordinate by coordinate. ip: the same with one
bit less, plus the signs of a random projection of the residual, which makes
inner products unbiased.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import best_chunks

MAGIC = b"CVQ1"


@functools.lru_cache(8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix from a seeded Gaussian one, signs fixed."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@functools.lru_cache(8)
def sketch_matrix(dim: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed + 1)).standard_normal((dim, dim))


@functools.lru_cache(8)
def codebook(bits: int) -> np.ndarray:
    """Lloyd-Max levels for a standard normal variable, by fixed-point iteration."""
    n = 2**bits
    pdf = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))
    levels = np.linspace(-2, 2, n) if n > 2 else np.array([-0.8, 0.8])
    for _ in range(3000):
        edge = np.concatenate([[-40.0], (levels[1:] + levels[:-1]) / 2, [40.0]])
        levels = (pdf(edge[:-1]) - pdf(edge[1:])) / (cdf(edge[1:]) - cdf(edge[:-1]))
    return levels


def _pack_rows(codes: np.ndarray, bits: int) -> np.ndarray:
    """Little-endian packing of the small integers of each row."""
    return np.packbits(((codes[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    return (np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits) << np.arange(bits)).sum(1)


@dataclasses.dataclass(frozen=True)
class Quantizer:
    dim: int
    bits: int = 4
    variant: str = "ip"
    seed: int = 42

    def __post_init__(self):
        if self.variant not in ("mse", "ip") or not 2 <= self.bits <= 4 or self.dim < 1 or self.seed < 0:
            raise ValueError("variant mse or ip, 2 to 4 bits, positive dimension, seed from 0")

    @property
    def code_bits(self) -> int:
        return self.bits - (self.variant == "ip")

    def fingerprint(self) -> str:
        """Identifies the rotation; a store keeps it, as it depends on the linear algebra library."""
        return hashlib.sha256(rotation(self.dim, self.seed).astype("<f8").tobytes()).hexdigest()

    def warm_up(self) -> None:
        """Make the matrices and the codebook, which the first call would."""
        rotation(self.dim, self.seed), codebook(self.code_bits)
        if self.variant == "ip":
            sketch_matrix(self.dim, self.seed)

    def encode(self, x: np.ndarray) -> bytes:
        return self.encode_many(np.asarray(x, np.float64)[None])[0]

    def encode_many(self, x: np.ndarray) -> list[bytes]:
        """A payload for each row; one matrix product rotates all."""
        x = np.asarray(x, np.float64)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors have {x.shape[1:]} values, not {self.dim}")
        norms = np.linalg.norm(x, axis=1)
        y = (x / np.where(norms > 0, norms, 1.0)[:, None]) @ rotation(self.dim, self.seed).T
        levels = codebook(self.code_bits) / math.sqrt(self.dim)
        codes = np.searchsorted((levels[1:] + levels[:-1]) / 2, y)
        packed = _pack_rows(codes, self.code_bits)
        heads = [MAGIC + struct.pack("<BBHf", self.bits, self.variant == "ip", self.dim, n) for n in norms]
        if self.variant == "mse":
            return [h + p.tobytes() for h, p in zip(heads, packed, strict=True)]
        rest = y - levels[codes]
        signs = _pack_rows(rest @ sketch_matrix(self.dim, self.seed).T >= 0, 1)
        return [h + p.tobytes() + struct.pack("<f", r) + s.tobytes() for h, p, r, s in zip(heads, packed, np.linalg.norm(rest, axis=1), signs, strict=True)]

    def _parts(self, raw: bytes) -> tuple[float, np.ndarray, float, np.ndarray | None]:
        bits, ip, dim, norm = struct.unpack_from("<BBHf", raw, 4)
        if raw[:4] != MAGIC or (bits, bool(ip), dim) != (self.bits, self.variant == "ip", self.dim):
            raise ValueError("payload isn't of the recorded kind")
        n = (dim * self.code_bits + 7) // 8
        y = codebook(self.code_bits)[unpack(raw[12 : 12 + n], self.code_bits, dim)] / math.sqrt(dim)
        if not ip:
            return norm, y, 0.0, None
        return norm, y, struct.unpack_from("<f", raw, 12 + n)[0], unpack(raw[16 + n :], 1, dim) * 2 - 1

    def decode(self, raw: bytes) -> np.ndarray:
        return self.decode_many([raw])[0]

    def decode_many(self, payloads: list[bytes]) -> np.ndarray:
        parts = [self._parts(p) for p in payloads]
        norms, y = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]).reshape(len(parts), self.dim)
        if self.variant == "ip":
            signs = np.array([p[3] for p in parts]).reshape(len(parts), self.dim)
            y = y + math.sqrt(math.pi / 2) / self.dim * np.array([p[2] for p in parts])[:, None] * (signs @ sketch_matrix(self.dim, self.seed))
        return norms[:, None] * (y @ rotation(self.dim, self.seed))

    def distances(self, payloads: list[bytes], q: np.ndarray) -> np.ndarray:
        """ip: minus the estimated inner product; mse: L2 to the decoded vector. One matrix product for all."""
        parts = [self._parts(p) for p in payloads]
        norms, ys = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]).reshape(len(parts), self.dim)
        rq = rotation(self.dim, self.seed) @ np.asarray(q, np.float64)
        if self.variant == "mse":
            return np.sqrt((((norms[:, None] * ys) - rq) ** 2).sum(1))
        signs = np.array([p[3] for p in parts]).reshape(len(parts), self.dim)
        rests = np.array([p[2] for p in parts])
        return -norms * (ys @ rq + math.sqrt(math.pi / 2) / self.dim * rests * (signs @ (sketch_matrix(self.dim, self.seed) @ rq)))


def compress(chunks: DataFrame, quantizer: Quantizer, column: str = "embedding") -> DataFrame:
    """chunks with payload instead of the vector."""
    rest = [c for c in chunks.columns if c != column]
    schema = chunks.select(*rest, F.lit(None).cast("binary").alias("payload")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(quantizer.encode_many(np.array(b.column(column).to_pylist(), np.float64)) if len(b) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], names=schema.names)

    return chunks.mapInArrow(run, schema)


def decompress(compressed: DataFrame, quantizer: Quantizer) -> DataFrame:
    rest = [c for c in compressed.columns if c != "payload"]
    schema = compressed.select(*rest, F.lit(None).cast("array<float>").alias("embedding")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(list(quantizer.decode_many(b.column("payload").to_pylist()).astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], names=schema.names)

    return compressed.mapInArrow(run, schema)


def search(compressed: DataFrame, q: list[float], quantizer: Quantizer, entries: DataFrame | None = None, entry: str = "context_id") -> DataFrame:
    """Nearest entries by estimated distance, best chunk each."""
    if len(q) != quantizer.dim:
        raise ValueError(f"the query has {len(q)} dimensions, the payloads {quantizer.dim}")
    if entries is not None:
        compressed = compressed.join(entries.select(F.col("id").alias(entry)), entry, "left_semi")
    vector = np.asarray(q, np.float64)
    cols = [entry, "start_index", "end_index", "payload"]
    schema = compressed.select(*cols[:3], F.lit(0.0).alias("distance")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = quantizer.distances(b.column("payload").to_pylist(), vector) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols[:3]), pa.array(d, pa.float64())], names=schema.names)

    return best_chunks(compressed.select(*cols).mapInArrow(run, schema), entry)
