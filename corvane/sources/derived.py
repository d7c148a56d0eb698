"""What hangs off an entry's text, and which text it was made from.

Chunks with their vectors, and index nodes, are made from an entry's text. The table of derivations holds, for each
entry and kind, the hash of that text. Where it isn't the entry's hash any more, what was made is stale:
it is never read together with the new text, and only such entries are made again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .commits import Snapshot, Transaction

#: Tables that each kind fills.
KINDS = {"chunks": ("chunks", "embedding_metadata", "chunks_compressed"), "nodes": ("index_nodes",)}


def hashes(entries: DataFrame) -> DataFrame:
    """(context_id, current): the hash of each entry's text; the text is read only where no hash is stored."""
    return entries.select(F.col("id").alias("context_id"), F.coalesce("content_hash", content_hash(F.col("text_content"))).alias("current"))


def record(tx: Transaction, kinds: list[str], entries: DataFrame) -> None:
    """The kinds count as made from the texts of these entries."""
    new = tx.stage(hashes(entries).select("context_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col("current").alias("content_hash")))
    touched = tx.touched("derivations", new)
    own = tx.read("derivations", touched)
    tx.write("derivations", own.join(new, ["context_id", "kind"], "left_anti").select(own.columns).unionByName(new), touched)


def stale(at: Snapshot, kind: str) -> DataFrame:
    """(context_id) of what was made from another text than the entry's, or for an entry that is gone."""
    made = at.read("derivations").filter(F.col("kind") == kind)
    now = hashes(at.read("entries"))
    return made.join(now, "context_id", "left").filter(F.col("current").isNull() | (F.col("current") != F.col("content_hash"))).select("context_id")


def current(at: Snapshot, name: str) -> DataFrame:
    """A table of satellites without what is stale."""
    kind = next(k for k, names in KINDS.items() if name in names)
    return at.read(name).join(stale(at, kind), "context_id", "left_anti")


def due(at: Snapshot, kind: str) -> DataFrame:
    """Entries for which the kind has not been made from their text as it is."""
    e = at.read("entries")
    made = at.read("derivations").filter(F.col("kind") == kind).select("context_id", F.col("content_hash").alias("current"))
    return e.join(hashes(e).join(made, ["context_id", "current"], "left_anti").select(F.col("context_id").alias("id")), "id", "left_semi")


def forget(tx: Transaction, ids: DataFrame) -> None:
    """Delete all that was made for ids (a column id)."""
    tx.delete_of(ids, [n for names in KINDS.values() for n in names] + ["derivations"])
