"""Chunks, vectors, compressed vectors and node summaries, made with the writes that need them or afterwards."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import derived
from .commits import Transaction
from .store import Store, chunked, put_chunks, summarised_nodes


@dataclasses.dataclass(frozen=True)
class Makers:
    """Who makes what: without an encoder no chunks, without a summariser no nodes."""

    encoder: Callable[[list[str]], list[list[float]]] | None = None
    model: str = "encoder"
    summariser: Callable[[str], str] | None = None
    size: int = 1500
    overlap: int = 150
    least_chars: int = 500

    def kinds(self) -> list[str]:
        return [k for k, f in (("chunks", self.encoder), ("nodes", self.summariser)) if f]


def make(tx: Transaction, entries: DataFrame, makers: Makers, kinds: list[str] | None = None) -> None:
    """Make the kinds for these entries, in place of what they had, and record from which texts."""
    kinds = makers.kinds() if kinds is None else kinds
    if "chunks" in kinds:
        put_chunks(tx, tx.stage(chunked(entries, makers.encoder, makers.size, makers.overlap)), makers.model)
    if "nodes" in kinds:
        tx.upsert("index_nodes", tx.stage(summarised_nodes(entries, makers.summariser, least_chars=makers.least_chars)), of=entries.select(F.col("id").alias("context_id")))
    derived.record(tx, kinds, entries)


def regenerate(store: Store, makers: Makers) -> dict[str, int]:
    """Make what is missing or stale, and nothing else; the number of entries by kind. Safe to run again after a failure."""

    def body(tx: Transaction) -> dict[str, int]:
        out, gone_of = {}, []
        for kind in makers.kinds():
            gone = tx.stage(derived.stale(tx, kind).select(F.col("context_id").alias("id")))
            tx.delete_of(gone, derived.KINDS[kind])
            todo = tx.stage(derived.due(tx, kind))
            out[kind] = todo.count()
            if out[kind]:
                make(tx, todo, makers, [kind])
            gone_of.append(gone)
        for gone in gone_of:  # of entries that are gone
            tx.delete_of(tx.stage(gone.join(tx.read("entries").select("id"), "id", "left_anti")), ("derivations",))
        return out

    return store.commit(body)  # type: ignore[return-value]
