"""The sixteen tools of the entry store as batch calls on a Store."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import outline
from .functions.metadata_columns import misfit
from .functions.text import content_hash, uuid7
from .operators import dml, filters, fts, fusion, quant, scan, stats, textops, vector
from .operators.filters import normalised_tags
from .schema import ENTRIES, RANK_DEPTH
from .sources import derived, generation, text_index
from .sources.commits import Transaction
from .sources.store import Store


class Tools:
    """makers, if given, make chunks, vectors and node summaries in the commit of each write. Reads see one commit."""

    def __init__(self, store: Store, language: str = "english", makers: generation.Makers | None = None):
        self.store, self.language, self.makers = store, language, makers or generation.Makers()

    def _entries(self) -> DataFrame:
        return self.store.read("entries")

    # writes
    def store_context(self, rows: DataFrame, atomic: bool = True) -> DataFrame:
        """Store rows (thread_id, source, text_content, metadata, tags, images; created_at optional); gives the failures.

        A row equal to the newest of its thread and source updates that one, and its tags and images, if it has any,
        take the place of the former. One pass serves one row or many, and one commit all tables: after a failure
        none has changed.
        """
        good, bad = dml.accepted(rows, atomic, self.store.snapshot().typed)
        good = good.withColumn("created_at", F.current_timestamp() if "created_at" not in rows.columns else F.coalesce("created_at", F.current_timestamp()))
        good = good.withColumn("id", uuid7(F.col("created_at"), F.col("thread_id"), F.col("source"), F.col("text_content"), F.monotonically_increasing_id()))
        good = good.select("id", "thread_id", "source", "content_type", "text_content", "metadata", "content_hash", "created_at", "tags", F.coalesce("images", F.array().cast("array<string>")).alias("images"))
        self.store.commit(lambda tx: self._put(tx, tx.stage(good)))
        return bad

    store_context_batch = store_context

    def put_entries(self, entries: DataFrame) -> None:
        """Store entries that have ids (columns of the table; tags and images as in store_context, if any), those whose ids are there already left out."""

        def body(tx: Transaction) -> None:
            own = entries.withColumn("content_hash", F.coalesce("content_hash", content_hash(F.col("text_content"))))
            for c in ("tags", "images"):
                own = own if c in own.columns else own.withColumn(c, F.array().cast("array<string>"))
            there = tx.parts("entries")  # without any, no text is shuffled
            self._put(tx, tx.stage(own.join(tx.read("entries").select("id"), "id", "left_anti") if there else own))

        self.store.commit(body)

    def _put(self, tx: Transaction, good: DataFrame) -> None:
        default = {"summary": F.lit(None).cast("string"), "version": F.lit(1).cast("bigint"), "updated_at": F.col("created_at")}
        new = good.select(*[F.col(c) if c in good.columns else default[c].alias(c) for c in ENTRIES.names])
        threads = new.select("thread_id").distinct()
        newest = tx.read("entries", tx.touched("entries", new)).select("thread_id", "id").join(threads, "thread_id", "left_semi").groupBy("thread_id").agg(F.max("id").alias("id"))
        at = tx.spots("entries", newest)
        entries, kept = dml.fold_new(tx.at("entries", at), new)
        kept = tx.stage(kept)
        tx.exchange("entries", at, entries)
        last = lambda c: good.filter(F.size(c) > 0).select(F.col("id").alias("new_id"), c).join(kept, "new_id").groupBy("id").agg(F.max_by(c, "new_id").alias("x"))
        tx.upsert("tags", tx.stage(last("tags").select(F.col("id").alias("context_entry_id"), F.explode("x").alias("tag"))))
        self._images(tx, last("images").withColumnRenamed("x", "images"))
        self._follow(tx, kept.filter("new_id = id").select("id"), fresh=True)

    def _images(self, tx: Transaction, given: DataFrame) -> None:
        """Images (id, images: base64) in place of those of their entries."""
        images = given.select(F.col("id").alias("context_entry_id"), F.posexplode("images").alias("position", "i")).withColumn("image_data", dml.decoded_image(F.col("i")))
        images = images.withColumn("mime_type", dml.image_type(F.col("image_data"))).withColumn("image_metadata", F.lit(None).cast("string")).drop("i")
        tx.upsert("images", tx.stage(images), of=given.select(F.col("id").alias("context_entry_id")))

    def _follow(self, tx: Transaction, ids: DataFrame, fresh: bool = False) -> None:
        """The texts of ids are new, or others than before: what was made from the old ones goes, what is made at writes is made."""
        if not fresh:
            derived.forget(tx, ids)
        entries = None
        if self.makers.kinds() or tx.exists("fts_totals"):
            entries = tx.stage(tx.at("entries", tx.spots("entries", ids)))
        if self.makers.kinds():
            generation.make(tx, entries, self.makers)
        text_index.follow(tx, ids, entries)

    def update_context(self, changes: DataFrame) -> list[str]:
        """Apply changes (see dml.update; patch merges into metadata); ids that conflict, of which nothing changes.

        tags and images (base64), if given, replace those of the entry, an empty list removes all, null none; images decide the content type.
        Metadata and a patch of it in one change are refused, and so is what couldn't be stored. What was made from a text that changes goes or is made again, in the same commit.
        """
        if errors := dml.refused(changes):
            raise ValueError("; ".join(errors))

        def body(tx: Transaction) -> list[str]:
            asked = tx.stage(changes)
            at = tx.spots("entries", asked)
            own = tx.at("entries", at)
            typed = asked
            if "images" in asked.columns:
                typed = asked.drop("content_type").withColumn("content_type", F.when(F.col("images").isNotNull(), F.when(F.size("images") > 0, "multimodal").otherwise("text")))
            out, conflicts = dml.update(own, typed)
            ids = [r["id"] for r in conflicts.select("id").collect()]  # of the caller's changes
            done = tx.stage(asked.join(conflicts, "id", "left_anti").join(own.select("id"), "id", "left_semi"))
            altered = None
            if "text_content" in asked.columns:
                before = derived.hashes(own)
                after = done.filter("text_content is not null").select(F.col("id").alias("context_id"), content_hash(F.col("text_content")).alias("new"))
                altered = tx.stage(after.join(before, "context_id").filter("new != current").select(F.col("context_id").alias("id")))
            changed = [k for k in tx.typed if "metadata" in asked.columns or "patch" in asked.columns]
            for k in changed:
                if not out.join(asked.select("id"), "id", "left_semi").filter(misfit(F.col("metadata"), k, tx.typed[k])).isEmpty():
                    raise ValueError(f"metadata {k} is no {tx.typed[k]}")
            tx.exchange("entries", at, out)
            if "tags" in asked.columns:
                given = done.filter("tags is not null").select(F.col("id").alias("context_entry_id"), normalised_tags(F.col("tags")).alias("tags"))
                tx.upsert("tags", given.select("context_entry_id", F.explode("tags").alias("tag")), of=given)
            if "images" in asked.columns:
                self._images(tx, done.filter("images is not null"))
            if altered is not None:
                self._follow(tx, altered)
            return ids

        return self.store.commit(body)  # type: ignore[return-value]

    update_context_batch = update_context

    def delete_context(self, **criteria) -> int:
        """Delete by criteria of dml.matching(), in all tables that hold something of it; the number of entries."""

        def body(tx: Transaction) -> int:
            doomed = tx.stage(dml.matching(tx.read("entries"), **criteria))
            n = doomed.count()
            if n:
                derived.forget(tx, doomed)
                tx.delete_of(doomed, ("tags", "images", "entries"))
                text_index.follow(tx, doomed)
            return n

        return self.store.commit(body)  # type: ignore[return-value]

    delete_context_batch = delete_context

    def regenerate(self) -> dict[str, int]:
        """Make what is missing or stale of what the makers make; see generation.regenerate."""
        return generation.regenerate(self.store, self.makers)

    def store_index_nodes(self, nodes: DataFrame) -> None:
        """Nodes (columns of index_nodes) take the place of their entries' former ones."""

        def body(tx: Transaction) -> None:
            staged = tx.stage(nodes)
            tx.upsert("index_nodes", staged)
            derived.record(tx, ["nodes"], tx.read("entries").join(staged.select(F.col("context_id").alias("id")).distinct(), "id", "left_semi"))

        self.store.commit(body)

    # the full-text index
    def build_index(self, language: str | None = None) -> None:
        """Build or rebuild the index; another language becomes that of the tools. Without an index searches read the texts."""
        self.language = language or self.language
        text_index.build(self.store, self._entries(), self.language)

    def _index(self) -> text_index.TextIndex | None:
        return text_index.open_index(self.store, self.language)

    def merge_index(self, whole: bool = False) -> None:
        """Merge the segments of the index, all but the first or all."""
        self.store.commit(lambda tx: text_index.merge(tx, whole))

    # reads
    def get_context_by_ids(self, ids: Iterable[str], include_images: bool = False) -> DataFrame:
        e = scan.by_ids(self._entries(), ids)
        return e.join(scan.tags_of(e, self.store.read("tags")), "id", "left").join(scan.images_of(e, self.store.read("images"), include_images), "id", "left").orderBy(*scan.newest_first())

    def search_context(self, **conditions) -> dict:
        return scan.search_context(self.store.snapshot().read("entries", typed=True), self.store.read("tags"), **conditions)

    def _kept(self, conditions: Mapping) -> DataFrame:
        return filters.apply_filters(self.store.snapshot().read("entries", typed=True), self.store.read("tags"), **conditions)

    def fts_search_context(self, query: str, mode: str = "match", limit: int = 10, offset: int = 0, highlight: bool = False, **conditions) -> dict:
        try:
            tree = fts.parse(query, mode, self.language)
            hits = self._words(tree, self._kept(conditions) if conditions else None)
        except (fts.QueryError, filters.InvalidFilter) as e:
            return {"rows": self._entries().limit(0), "error": "validation failed", "validation_errors": [str(e)]}
        page = scan.ranked_page(hits, fts.ranked(hits), limit, offset).join(self._entries(), "id").orderBy(*fts.ranked(hits))
        if highlight:
            page = page.withColumn("highlighted", fts.highlight(F.col("text_content"), tree, self.language))
        return {"rows": page, "stats": {"filters_applied": filters.filters_applied(**conditions), "rank_depth_limit": RANK_DEPTH}}

    def _words(self, tree: fts.Leaf | fts.Node | None, keep: DataFrame | None) -> DataFrame:
        if index := self._index():
            return index.search(tree, keep=keep)
        return fts.search(self._entries(), tree, language=self.language, keep=keep)

    def _nearest(self, q: list[float], conditions: Mapping, quantizer: quant.Quantizer | None) -> DataFrame:
        kept = self._kept(conditions) if conditions else None
        at = self.store.snapshot()
        if quantizer:
            recorded = at.read("compression").first()
            if recorded is not None and recorded["codebook_fingerprint"] != quantizer.fingerprint():
                raise ValueError("the quantizer isn't the one that made the payloads")
            return quant.search(derived.current(at, "chunks_compressed"), q, quantizer, kept)
        return vector.search(derived.current(at, "chunks"), q, kept)

    def semantic_search_context(self, q: list[float], limit: int = 10, offset: int = 0, quantizer: quant.Quantizer | None = None, **conditions) -> dict:
        """By the query's embedding, which the caller's encoder has made."""
        try:
            hits = self._nearest(q, conditions, quantizer)
        except (ValueError, filters.InvalidFilter) as e:
            return {"rows": self._entries().limit(0), "error": "validation failed", "validation_errors": [str(e)]}
        page = scan.ranked_page(hits, vector.nearest(), limit, offset).withColumnRenamed("context_id", "id").join(self._entries(), "id")
        page = page.withColumn("matched", F.substring("text_content", F.col("start_index") + 1, F.col("end_index") - F.col("start_index")))
        return {"rows": page.orderBy("distance", "id"), "stats": {"filters_applied": filters.filters_applied(**conditions), "rank_depth_limit": RANK_DEPTH}}

    def hybrid_search_context(self, query: str, q: list[float] | None, limit: int = 10, offset: int = 0, k: int = 60, scorer=None, **conditions) -> dict:
        try:
            kept = self._kept(conditions) if conditions else None
            tree = fts.hybrid_query(query, language=self.language)
        except (fts.QueryError, filters.InvalidFilter) as e:
            return {"rows": self._entries().limit(0), "error": "validation failed", "validation_errors": [str(e)]}
        near_of = lambda: vector.search(derived.current(self.store.snapshot(), "chunks"), q, kept).withColumnRenamed("context_id", "id")
        legs = {"fts": (lambda: self._words(tree, kept), [F.desc("score"), F.desc("id")]), "semantic": (near_of, [F.asc("distance"), F.asc("id")])}
        wanted = {n: x for n, x in legs.items() if (query.strip() if n == "fts" else q)}
        got = fusion.together(wanted, RANK_DEPTH * 2)
        why = {n: w for n, (_, w) in got.items() if w} | {n: "not asked for" for n in legs if n not in wanted}
        near = got.get("semantic", (None,))[0]
        out = fusion.hybrid(got.get("fts", (None,))[0], near, k, why=why)
        if out["rows"] is None:
            return out | {"rows": self._entries().limit(0)}
        rows = out["rows"]
        if scorer:
            from pyspark.sql import Window

            ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*fusion.best_first()))).join(self._entries().select("id", "text_content"), "id")  # at most the ranked depth
            start, end = None, None
            if near is not None:
                ranked = ranked.join(near.select("id", "start_index", "end_index"), "id", "left")
                start, end = F.col("start_index"), F.col("end_index")
            marked = F.when(F.col("fts_rank").isNotNull(), fts.highlight(F.col("text_content"), tree, self.language))
            rows = fusion.rerank(ranked, textops.rerank_text(F.col("text_content"), marked, start, end), scorer).drop("start_index", "end_index")
            return out | {"rows": rows.offset(offset).limit(limit)}
        return out | {"rows": scan.ranked_page(rows, fusion.best_first(), limit, offset)}

    def grep_context(self, pattern: str, output: str = "content", max_results: int = 100, is_regex: bool = False, case_sensitive: bool = False, context: int = 0, timeout: float = 5.0, total: float | None = None, **conditions) -> dict:
        """rows by the output mode, and timed_out: the ids of the entries that weren't searched to their end."""
        m = textops.grep(self._kept(conditions) if conditions else self._entries(), pattern, is_regex, case_sensitive, context, timeout, total)
        made = {"content": lambda: textops.grep_content(m, max_results), "count": lambda: textops.grep_counts(m), "files_with_matches": lambda: textops.grep_files(m)}
        return {"rows": made[output](), "timed_out": textops.timed_out(m)}

    def navigate_context(self, entry_id: str, max_depth: int = 6) -> DataFrame:
        """The outline of an entry with stored summaries; the root's is the entry's. navigation_tree() nests it."""
        own = self._entries().filter(F.col("id") == entry_id)
        rows = textops.navigate(textops.outline_nodes(own, max_depth), derived.current(self.store.snapshot(), "index_nodes").filter(F.col("context_id") == entry_id))
        rows = rows.join(own.select("id", "summary"), "id")
        return rows.withColumn("node_summary", F.when(F.col("node_id") == outline.ROOT, F.col("summary")).otherwise(F.col("node_summary"))).drop("summary").orderBy("char_start", "level")

    def navigation_tree(self, entry_id: str, max_depth: int = 6) -> dict | None:
        return textops.nested([r.asDict() for r in self.navigate_context(entry_id, max_depth).collect()])  # the nodes of one entry

    def read_context_range(self, entry_id: str, chars: tuple[int, int] | None = None, lines: tuple[int, int] | None = None, node_id: str | None = None) -> dict | None:
        """Exactly one of chars, lines and node_id."""
        if sum(x is not None for x in (chars, lines, node_id)) != 1:
            raise ValueError("give exactly one of chars, lines and node_id")
        own = self._entries().filter(F.col("id") == entry_id)
        if lines:
            r = own.select(textops.read_lines(F.col("text_content"), *lines).alias("content")).first()
            return r and r.asDict()
        if node_id:
            t = own.select("text_content").first()
            chars = t and outline.span_of(t[0], node_id)
            if not chars:
                return None
        r = own.select(textops.read_chars(F.col("text_content"), *chars).alias("r")).first()
        return r and r["r"].asDict()

    def list_threads(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return stats.thread_list(self._entries(), limit, offset)

    def get_statistics(self) -> dict:
        meta, e = self.store.read("embedding_metadata"), self._entries()
        out = stats.statistics(e, self.store.read("tags"), self.store.read("images"))
        index = self._index()
        return out | {
            "embeddings": stats.embedding_stats(e, meta), "models": meta.select("model_name", "dimensions").distinct(), "compressed": stats.payload_bytes(self.store.read("chunks_compressed")),
            "fts": stats.fts_coverage(e, index.lengths if index else None), "fts_language": self.language if index else None, "nodes": self.store.read("index_nodes").agg(F.count("*").alias("total_nodes"), F.countDistinct("context_id").alias("entries_with_nodes")),
        }
