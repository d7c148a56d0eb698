"""Text functions: tokens, stems, lines, ids, merge patches."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from .stemming import SNOWBALL

WORD = r"[\p{L}\p{N}]+"
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]

_TO_PLAIN = str.maketrans("".join(_ACCENTED), "".join(_PLAIN))


def tokens(text: Column, plain: bool = True) -> Column:
    """Runs of letters and digits, lower-cased, without Latin accents if plain."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.translate(low, "".join(_ACCENTED), "".join(_PLAIN)) if plain else low, F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens() there are, which are not made; accents, which are on letters, don't count."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD))


def tokenize(text: str, plain: bool = True) -> list[tuple[str, int, int]]:
    """The same on the driver or in a worker: (token, start, end) in code points."""
    out, start = [], None
    for i, c in enumerate(text + " "):
        if unicodedata.category(c)[0] in "LN":
            start = i if start is None else start
        elif start is not None:
            low = text[start:i].lower()
            out.append((low.translate(_TO_PLAIN) if plain else low, start, i))
            start = None
    return out


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if a and not b)


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 of the published algorithm (Porter 1980).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@functools.lru_cache(200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and any(_vowel(w, i) for i in range(len(w) - 2)):
        w, again = w[:-2], True
    elif w.endswith("ing") and any(_vowel(w, i) for i in range(len(w) - 3)):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def plain(language: str) -> bool:
    """Whether the terms of a language are words without accents: all but those that a Snowball algorithm stems."""
    return language.lower() not in SNOWBALL


def stemmer(language: str) -> Callable[[str], str] | None:
    """What stems the words of a language; None where words stay as they are."""
    return stem if language.lower() == "english" else SNOWBALL.get(language.lower())


def stemmed(words: pa.Array, cut: Callable[[str], str] | None) -> pa.DictionaryArray:
    """Words as numbers of their distinct stems; each distinct word is stemmed once, and no other becomes a Python object."""
    found = words.dictionary_encode()
    if cut is None:
        return found
    stems = pa.array([cut(w) for w in found.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return pa.DictionaryArray.from_arrays(stems.indices.take(found.indices), stems.dictionary)


def terms(text: Column, language: str) -> Column:
    """The words of a text as searches in a language compare them: stems where the language has a stemmer, else tokens."""
    words = tokens(text, plain(language))
    if stemmer(language) is None:
        return words

    @arrow_udf(T.ArrayType(T.StringType()))
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = stemmer(language)
        for ws in batches:
            flat, ends = stemmed(ws.flatten(), cut), ws.offsets.to_numpy()
            yield pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), flat.dictionary.take(flat.indices))

    return stems(words)


def terms_by_row(text: Column, language: Column) -> Column:
    """Terms (word, stem) of texts, each in the language that its row names; words of other languages or of none are their own stems."""
    low = F.lower(language)
    words = F.when(F.coalesce(low.isin(*SNOWBALL), F.lit(False)), tokens(text, False)).otherwise(tokens(text))

    @pandas_udf(T.ArrayType(T.StringType()))
    def stems(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ws, names in batches:
            cuts = [stemmer(n) if isinstance(n, str) else None for n in names]
            yield pd.Series([[cut(x) for x in a] if cut else a for a, cut in zip(ws, cuts, strict=True)])

    return F.arrays_zip(words.alias("word"), stems(words, low).alias("stem"))


def storable(text: Column) -> Column:
    """Whether every store can hold a text: no NUL."""
    return ~F.contains(text, F.lit("\0"))


def repaired(text: Column) -> Column:
    """A generated text without the characters that a store can't hold."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def storable_metadata(metadata: Column) -> Column:
    """Whether metadata is null or a JSON object without NUL; NaN and infinities are no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(metadata))
    return metadata.isNull() | (F.coalesce(kind.startswith("OBJECT"), F.lit(False)) & ~F.contains(metadata, F.lit("\\u0000")) & ~F.contains(metadata, F.lit("\0")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fold_merge(target: object, patch: object) -> object:
    """Merge patch: null deletes, objects recurse, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = fold_merge(out.get(k), v)
    return out


@pandas_udf(T.StringType())
def merge_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patch of two JSON texts; keys sorted; null patch leaves the target."""

    def one(t: str | None, p: str | None) -> str | None:
        if p is None:
            return t
        try:
            old = json.loads(t) if t else {}
        except ValueError:
            old = {}
        return json.dumps(fold_merge(old, json.loads(p)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(t, p) for t, p in zip(target, patch, strict=True)])


def uuid7(at: Column, *parts: Column) -> Column:
    """Time-ordered 32-digit id: 48 bits of milliseconds, then version, variant and bits of a hash of the parts."""
    tail = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    variant = F.substring(F.lit("89ab"), 1 + F.conv(F.substring(tail, 4, 1), 16, 10).cast("int") % 4, F.lit(1))
    return F.concat(F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0"), F.lit("7"), F.substring(tail, 1, 3), variant, F.substring(tail, 5, 15))
