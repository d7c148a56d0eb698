"""Exact k-nearest neighbours over chunk embeddings, best chunk per entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def query_column(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dimension(chunks: DataFrame, column: str = "embedding") -> int | None:
    r = chunks.select(F.size(column)).limit(1).collect()
    return r[0][0] if r else None


def distances(chunks: DataFrame, q: list[float], column: str = "embedding", check: bool = True) -> DataFrame:
    """chunks with distance; the query's dimension must be the stored one."""
    if check and (d := dimension(chunks, column)) not in (None, len(q)):
        raise ValueError(f"query has {len(q)} dimensions, the index {d}")
    return chunks.withColumn("distance", l2(F.transform(column, lambda x: x.cast("double")), query_column(q)))


def best_chunks(scored: DataFrame, entry: str = "context_id") -> DataFrame:
    """The nearest chunk of each entry, ties by start; a hash aggregate, not a window sort."""
    return scored.groupBy(entry).agg(F.min(F.struct("distance", "start_index", "end_index")).alias("b")).select(entry, "b.distance", "b.start_index", "b.end_index")


def search(chunks: DataFrame, q: list[float], entries: DataFrame | None = None, entry: str = "context_id") -> DataFrame:
    """Nearest entries: filter first, all distances, best chunk; order by nearest()."""
    if entries is not None:
        chunks = chunks.join(entries.select(F.col("id").alias(entry)), entry, "left_semi")
    return best_chunks(distances(chunks, q), entry)


def nearest(entry: str = "context_id") -> list[Column]:
    return [F.asc("distance"), F.asc(entry)]


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Vectors as matrices of up to `block` rows: keys, dim, m."""
    kind = rows.schema[key].dataType
    of = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), block):
                part = b.slice(at, block)
                m = np.array(part.column("v").to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("k").to_pylist()], pa.list_(of)), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["keys", "dim", "m"])

    src = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    return src.mapInArrow(run, T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("dim", T.IntegerType()), T.StructField("m", T.BinaryType())]))


def search_many(chunks: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", entry: str = "context_id", block: int = 256) -> DataFrame:
    """k nearest entries of each query, best first.

    Queries and chunks meet as blocks of vectors: one matrix product gives the distances of two blocks, of
    which the k best entries of each query leave with their exact distances. Merging these is
    exact, as an entry among the k nearest is so in the block of its nearest chunk.
    """
    q = _packed(queries, query_id, vector, block).select(F.col("keys").alias("qk"), F.col("dim").alias("qd"), F.col("m").alias("q"))
    pairs = _packed(chunks, entry, "embedding", block).crossJoin(q)
    kinds = [queries.schema[query_id].dataType, chunks.schema[entry].dataType]
    arrow = [to_arrow_type(x) for x in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                keys, dim, m, qk, qd, q = (b.column(c)[i].as_py() for c in ("keys", "dim", "m", "qk", "qd", "q"))
                if dim != qd:
                    raise ValueError(f"queries have {qd} dimensions, chunks {dim}")
                x, y = np.frombuffer(m).reshape(-1, dim), np.frombuffer(q).reshape(-1, dim)
                names = sorted(set(keys))
                place = {e: j for j, e in enumerate(names)}
                of = np.array([place[e] for e in keys])
                order = np.argsort(of, kind="stable")
                heads = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1])
                near = (y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (y @ x.T)
                best = np.minimum.reduceat(near[:, order], heads, axis=1)  # by entry
                spare = min(len(names), k + 8)  # products are rounded; the exact distances decide
                take = np.argpartition(best, spare - 1, axis=1)[:, :spare]
                out = []
                for r in range(len(y)):
                    edge = best[r, take[r]].max() + 1e-9 * (1 + np.abs(near[r]).max())
                    found = []
                    for j in np.flatnonzero(best[r] <= edge):
                        rows = order[heads[j] : heads[j + 1] if j + 1 < len(heads) else None]
                        found.append((float(np.sqrt(((x[rows] - y[r]) ** 2).sum(1).min())), names[j]))
                    out += [(qk[r], e, d) for d, e in sorted(found)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((*arrow, pa.float64()))], names=[query_id, entry, "distance"])

    found = pairs.mapInArrow(run, T.StructType([T.StructField(query_id, kinds[0]), T.StructField(entry, kinds[1]), T.StructField("distance", T.DoubleType())]))
    best = found.groupBy(query_id, entry).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(query_id).orderBy("distance", entry)  # over k rows of each block of chunks
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "rank", entry, "distance")
