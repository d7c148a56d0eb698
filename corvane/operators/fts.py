"""Full-text search: match, prefix, phrase and boolean queries, BM25, cover density, highlighting.

A query is parsed on the driver into a small tree; each leaf becomes a count
over a document's token array. search() reads whole texts, where no index exists: one scan that leaves
a row of counts per document, one one-row aggregate and a top-k. postings() builds the inverted
index; sources/text_index.py stores it and searches it, with the same results.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import plain, stemmed, stemmer, terms, tokenize, tokens
from ..schema import MAX_QUERY_CHARS

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words whose postings are made together; a longer text is taken alone.
WORDS = 200_000
#: Nine of the languages have a stemmer, English among them; the others compare words without accents, as "simple" does.
#: Languages whose search drops and, or, not.
STOPWORD_LANGUAGES = {"english", "hindi", "russian"}
LANGUAGES = (
    "simple", "arabic", "armenian", "basque", "catalan", "danish", "dutch", "english", "finnish", "french", "german", "greek", "hindi", "hungarian", "indonesian", "irish", "italian", "lithuanian",
    "nepali", "norwegian", "portuguese", "romanian", "russian", "serbian", "spanish", "swedish", "tamil", "turkish", "yiddish",
)


@dataclasses.dataclass(frozen=True)
class Leaf:
    """A term, a phrase (several words) or a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclasses.dataclass(frozen=True)
class Node:
    op: str  # and, or, not (left without right)
    kids: tuple


class QueryError(ValueError):
    pass


def _leaf(text: str, prefix: bool, language: str) -> Leaf | None:
    ws, cut = tuple(t for t, _, _ in tokenize(text, plain(language))), stemmer(language)
    if cut:
        ws = tuple(w if prefix and i == len(ws) - 1 else cut(w) for i, w in enumerate(ws))
    return Leaf(ws, prefix) if ws else None


def _all(leaves: list) -> Leaf | Node | None:
    leaves = [x for x in leaves if x]
    return None if not leaves else leaves[0] if len(leaves) == 1 else Node("and", tuple(leaves))


def parse(query: str, mode: str = "match", language: str = "english") -> Leaf | Node | None:
    """The query's tree; None matches nothing."""
    if len(query) > MAX_QUERY_CHARS:
        raise QueryError("query too long")
    if "\0" in query or any(0xD800 <= ord(c) <= 0xDFFF for c in query):
        raise QueryError("query holds a NUL or a lone surrogate")
    if language.lower() not in LANGUAGES:
        raise QueryError(f"language {language!r} isn't known")
    drop = language.lower() in STOPWORD_LANGUAGES
    if mode == "phrase":
        return _leaf(query, False, language)
    if mode == "boolean":
        try:
            return _Grammar(query, language).whole()
        except QueryError:
            mode = "match"
    out = []
    for tok in re.findall(r'"[^"]*"|\S+', query):
        if len(tok) >= 2 and tok[0] == tok[-1] == '"':
            out.append(_leaf(tok, mode == "prefix", language))
            continue
        for part in tok.rstrip("*").split('"') if mode == "prefix" else tok.split('"'):
            for w in part.replace("-", " ").split() if mode == "prefix" else [part.replace("-", " ").strip()]:
                if w and not (drop and w.lower() in ("and", "or", "not")):
                    out.append(_leaf(w, mode == "prefix", language))
    return _all(out)


class _Grammar:
    """or < and (also implicit) < not < atom; operators in capitals."""

    def __init__(self, query: str, language: str):
        self.toks = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+|"', query)
        self.at, self.language = 0, language

    def peek(self) -> str | None:
        return self.toks[self.at] if self.at < len(self.toks) else None

    def whole(self) -> Leaf | Node | None:
        if not self.toks:
            return None
        out = self.either()
        if self.peek() is not None:
            raise QueryError("trailing input")
        return out

    def either(self):
        kids = [self.both()]
        while self.peek() == "OR":
            self.at += 1
            kids.append(self.both())
        return kids[0] if len(kids) == 1 else Node("or", tuple(kids))

    def both(self):
        kids = [self.without()]
        while (t := self.peek()) is not None and t not in ("OR", ")", "NOT"):
            if t == "AND":
                self.at += 1
            kids.append(self.without())
        return kids[0] if len(kids) == 1 else Node("and", tuple(kids))

    def without(self):
        out = self.atom()
        while self.peek() == "NOT":
            self.at += 1
            out = Node("not", (out, self.atom()))
        return out

    def atom(self):
        t = self.peek()
        self.at += 1
        if t == "(":
            out = self.either()
            if self.peek() != ")":
                raise QueryError("missing )")
            self.at += 1
            return out
        if t is None or t in (")", "AND", "OR", "NOT", '"') or (t[0] != '"' and re.search(r"[^\w*]", t)):
            raise QueryError(f"unexpected {t!r}")
        leaf = _leaf(t, t.endswith("*"), self.language)
        if leaf is None:
            raise QueryError("empty term")
        return leaf


def leaves(tree: Leaf | Node | None) -> list[Leaf]:
    """Leaves that count for ranking: not those below a NOT's right side."""
    if tree is None or isinstance(tree, Leaf):
        return [tree] if tree else []
    kids = tree.kids[:1] if tree.op == "not" else tree.kids
    return list(dict.fromkeys(x for k in kids for x in leaves(k)))


def count(toks: Column, leaf: Leaf) -> Column:
    """Occurrences of a leaf in an array of tokens."""
    same = lambda t, i: t.startswith(leaf.words[i]) if leaf.prefix and i == len(leaf.words) - 1 else t == leaf.words[i]
    if len(leaf.words) == 1:
        return F.size(F.filter(toks, lambda t: same(t, 0)))
    n = len(leaf.words)

    def here(_: Column, i: Column) -> Column:
        cond = F.coalesce(same(F.get(toks, i), 0), F.lit(False))
        for k in range(1, n):
            cond = cond & F.coalesce(same(F.get(toks, i + k), k), F.lit(False))
        return cond

    return F.size(F.filter(toks, here))


def matches(tree: Leaf | Node, n: dict[Leaf, Column]) -> Column:
    if isinstance(tree, Leaf):
        return n[tree] > 0
    kids = [matches(k, n) for k in tree.kids]
    if tree.op == "not":
        return kids[0] & ~kids[1]
    out = kids[0]
    for k in kids[1:]:
        out = out & k if tree.op == "and" else out | k
    return out


def every_leaf(tree: Leaf | Node) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else list(dict.fromkeys(x for k in tree.kids for x in every_leaf(k)))


def bm25(every: list[Leaf], ranked: list[Leaf]) -> Column:
    """The score from n<i> of every leaf, dl, and docs, avgdl and df<i> of the ranked ones."""
    score = F.lit(0.0)
    for i, x in enumerate(ranked):
        tf = F.col(f"n{every.index(x)}").cast("double")
        idf = F.greatest(F.ln((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return score


def search(docs: DataFrame, query: str | Leaf | Node | None, mode: str = "match", language: str = "english", doc: str = "id", text: str = "text_content", keep: DataFrame | None = None) -> DataFrame:
    """(id, score) of the matching documents, score by BM25 over the whole corpus; keep, a table of ids, filters after that. query may be parsed already."""
    schema = f"{doc} {docs.schema[doc].dataType.simpleString()}, score double"
    tree = parse(query, mode, language) if isinstance(query, str) else query
    if tree is None:
        return docs.sparkSession.createDataFrame([], schema)
    every, ranked = every_leaf(tree), leaves(tree)
    # the array goes through a lambda, so that it is built once per row
    counted = docs.select(doc, F.transform(F.array(terms(F.col(text), language)), lambda t: F.struct(F.size(t).alias("dl"), *[count(t, x).alias(f"n{i}") for i, x in enumerate(every)]))[0].alias("c")).select(doc, "c.*")
    total = counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"n{every.index(x)}") > 0).alias(f"df{i}") for i, x in enumerate(ranked)])
    hit = counted.filter(matches(tree, {x: F.col(f"n{i}") for i, x in enumerate(every)}))
    if keep is not None:
        hit = hit.join(keep.select(doc), doc, "left_semi")
    return hit.crossJoin(F.broadcast(total)).select(doc, bm25(every, ranked).alias("score"))  # total is one row


def ranked(hits: DataFrame, doc: str = "id") -> list[Column]:
    return [F.desc("score"), F.desc(doc)]


def postings(docs: DataFrame, doc: str = "id", text: str = "text_content", language: str = "simple", buckets: int = 64) -> DataFrame:
    """Inverted index: doc, term, dl, tf, positions, bucket; meant to be written partitioned by bucket.

    The terms of a text are counted where it is read, so nothing is shuffled here. Rows of docs with one id give rows of their own, which searches add up.
    """
    t = words(docs, doc, text, language)
    return t.mapInArrow(counted(language, buckets), f"doc {t.schema['doc'].dataType.simpleString()}, term string, dl int, tf int, positions array<int>, bucket int")


def words(docs: DataFrame, doc: str, text: str, language: str) -> DataFrame:
    """doc, and ts: the words of its text, unstemmed."""
    return docs.select(F.col(doc).alias("doc"), tokens(F.col(text), plain(language)).alias("ts"))


def counted(language: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes the rows of postings() of batches of words()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = stemmer(language)
        for b in batches:
            ends = b.column("ts").offsets.to_numpy().astype(np.int64)
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS, "right")) - 1)
                yield _counted(b.slice(start, end - start), cut, buckets)
                start = end

    return run


def _counted(b: pa.RecordBatch, cut: Callable[[str], str] | None, buckets: int) -> pa.RecordBatch:
    """A row per term of each row (doc, ts), with its positions in order."""
    ends = b.column("ts").offsets.to_numpy().astype(np.int64)
    dl, first = np.diff(ends), ends[:-1] - ends[0]
    words = stemmed(b.column("ts").flatten(), cut)
    bucket = pa.array([zlib.crc32(w.encode()) % buckets for w in words.dictionary.to_pylist()], pa.int32())
    row = np.repeat(np.arange(b.num_rows), dl)
    key = words.indices.to_numpy().astype(np.int64) * (b.num_rows + 1) + row  # rows of a term stand together, which a shuffle compresses well
    order = np.argsort(key, kind="stable")  # positions of a term stay in order
    key = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    of, starts = row[order[heads]], np.concatenate([heads, [len(key)]])
    positions = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(order - first[row[order]], pa.int32()))
    term = words.indices.take(pa.array(order[heads]))
    columns = [b.column("doc").take(pa.array(of)), words.dictionary.take(term), pa.array(dl[of], pa.int32()), pa.array(np.diff(starts), pa.int32()), positions, bucket.take(term)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "term", "dl", "tf", "positions", "bucket"])


def highlight(text: Column, tree: Leaf | Node | None, language: str = "simple") -> Column:
    """The whole text with <mark> around what the leaves match; for the rows of a page."""
    want = leaves(tree)
    bare = plain(language)

    def one(t: str | None) -> str | None:
        if not t or not want:
            return t
        toks, cut = tokenize(t, bare), stemmer(language) or str
        words = [cut(w) for w, _, _ in toks]
        marked: list[list[int]] = []
        i = 0
        while i < len(toks):
            n = max((len(x.words) for x in want if len(x.words) <= len(words) - i and all(words[i + k] == w or (x.prefix and k == len(x.words) - 1 and toks[i + k][0].startswith(w)) for k, w in enumerate(x.words))), default=0)
            if n:
                marked.append([toks[i][1], toks[i + n - 1][2]])
            i += max(1, n)
        out, at = [], 0
        for a, b in marked:
            out += [t[at:a], "<mark>", t[a:b], "</mark>"]
            at = b
        return "".join([*out, t[at:]])

    @pandas_udf("string")
    def run(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in col:
            yield s.map(one)

    return run(text)


def cover_density(positions: list[list[int]], weight: float = 0.1) -> float:
    """Sum over minimal covers of all terms: weight over 1 plus the other words inside (Clarke, Cormack and Tudhope)."""
    marks = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    last, out, before = [-1] * len(positions), 0.0, -1
    for p, i in marks:
        last[i] = p
        start = min(last)
        if start > before:
            out += weight / (1 + p - start - (len(positions) - 1)) if p - start >= len(positions) - 1 else weight
            before = start
    return out


def _positions(toks: Column, word: str) -> Column:
    return F.array_compact(F.transform(toks, lambda w, i: F.when(w == word, i)))


def words_of(query: str, language: str = "simple") -> list[Leaf]:
    """The words of a query, those of phrases too, once each."""
    return list(dict.fromkeys(Leaf((w,)) for x in leaves(parse(query, "match", language)) for w in x.words))


def by_cover(positions: DataFrame, doc: str = "id") -> DataFrame:
    """(id, score) of the rows (id, ps: positions of each word) where each word occurs."""

    @pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda ps: cover_density([list(p) for p in ps]))

    return positions.filter(F.forall("ps", lambda p: F.size(p) > 0)).select(doc, run("ps").alias("score"))


def cover_rank(docs: DataFrame, query: str, doc: str = "id", text: str = "text_content", language: str = "simple") -> DataFrame:
    """(id, score) of documents with all words, those of phrases too, by cover density. An index gives the same without reading texts."""
    pos = docs.select(doc, F.transform(F.array(terms(F.col(text), language)), lambda t: F.array(*[_positions(t, x.words[0]) for x in words_of(query, language)]))[0].alias("ps"))
    return by_cover(pos, doc)


def hybrid_query(query: str, threshold: int = 4, language: str = "english") -> Leaf | Node | None:
    """Four or more significant words: any of them; fewer: all."""
    tree = parse(query, "match", language)
    kids = leaves(tree)
    significant = [x for x in kids if len("".join(x.words)) > 1]
    return Node("or", tuple(significant)) if len(significant) >= threshold else tree
