"""Metadata keys as typed columns beside the JSON, and predicates on them that reach a Parquet scan.

A key becomes six columns: the JSON type of its value, and the value as text, as text with ASCII letters in lower case, as
a 64-bit integer, as a double where it is no integer, and as a boolean; all but one of the five are null. The conditions are
those of functions/metadata.py, value by value, but they are bare comparisons of columns, so that Catalyst pushes them into the
scan and statistics skip row groups; no JSON is parsed. A condition may be null where that one is false: use it to
filter, or under coalesce.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metadata as meta

PREFIX = "_meta"
PARTS = {"kind": T.StringType(), "text": T.StringType(), "low": T.StringType(), "whole": T.LongType(), "real": T.DoubleType(), "flag": T.BooleanType()}
#: What a key may be declared as; arrays and objects have no columns of their own, but the type of their value.
KINDS = ("string", "integer", "number", "boolean")


def name_of(key: str, part: str) -> str:
    """Column of a part of a key; the name is plain letters, whatever the key holds, and differs for keys that differ in case."""
    return f"{PREFIX}_{part}_" + "".join({"_": "__", ".": "_d", "-": "_h"}.get(c, "_u" + c.lower() if c.isupper() else c) for c in key)


def fields(keys: Iterable[str]) -> list[T.StructField]:
    return [T.StructField(name_of(k, p), t) for k in keys for p, t in PARTS.items()]


def bare(df: DataFrame) -> DataFrame:
    """df without these columns."""
    return df.drop(*[c for c in df.columns if c.startswith(f"{PREFIX}_")])


def _found(metadata: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(metadata), meta.path_of(key), "variant")


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer").otherwise("number")


def _parts(v: Column) -> Column:
    k, get = _kind(v), lambda t: F.try_variant_get(v, "$", t)
    text = F.when(k == "string", get("string"))
    values = {"kind": k, "text": text, "low": meta.fold(text), "whole": F.when(k == "integer", get("bigint")), "real": F.when(k == "number", get("double")), "flag": F.when(k == "boolean", get("boolean"))}
    return F.struct(*[values[p].alias(p) for p in PARTS])


def shred(df: DataFrame, keys: Iterable[str], metadata: str = "metadata") -> DataFrame:
    """df with the columns of keys, in place of any that it has."""
    keys = list(keys)
    if not keys:
        return bare(df)
    # through lambdas, so that the JSON and each value are read once a row
    parsed = F.transform(F.array(F.try_parse_json(F.col(metadata))), lambda j: F.struct(*[F.transform(F.array(F.try_variant_get(j, meta.path_of(k), "variant")), _parts)[0].alias(f"k{i}") for i, k in enumerate(keys)]))[0]
    with_all = bare(df).withColumn(PREFIX, parsed)
    return with_all.select(*bare(df).columns, *[F.col(f"{PREFIX}.k{i}.{p}").alias(name_of(k, p)) for i, k in enumerate(keys) for p in PARTS])


def misfit(metadata: Column, key: str, kind: str) -> Column:
    """Whether the value of a key can't be what the key is declared as; missing and null values always can."""
    if kind not in KINDS:
        raise meta.FilterError(f"a key is one of {', '.join(KINDS)}, not {kind!r}")

    def one(v: Column) -> Column:
        k = _kind(v)
        none = k.isNull() | (k == "null")
        return F.when(none | F.lit(kind == "string"), False).when(k.isin("array", "object"), True).otherwise(~meta.index_type_ok(F.try_variant_get(v, "$", "string"), kind))

    return F.transform(F.array(_found(metadata, key)), one)[0]


def predicate(key: str, operator: str, value: object = None, case_sensitive: bool = False, metadata: Column | None = None) -> Column:
    """The condition of metadata.predicate() on the columns of a key. Elements of arrays are looked up in the JSON, of rows that hold an array only."""
    plain = meta.predicate(F.col("metadata") if metadata is None else metadata, key, operator, value, case_sensitive)  # checks the arguments
    col = {p: F.col(name_of(key, p)) for p in PARTS}
    kind = col["kind"]
    if operator in ("exists", "is_not_null"):
        return kind.isNotNull() & (kind != "null")
    if operator == "not_exists":
        return kind.isNull() | (kind == "null")
    if operator == "is_null":
        return kind == "null"
    if operator == "array_contains":
        return (kind == "array") & plain
    own, same = (col["text"], str) if case_sensitive else (col["low"], lambda s: s.translate(str.maketrans(meta.UPPER, meta.LOWER)))
    if operator in ("in", "not_in"):
        tests = []
        if flags := [x for x in value if isinstance(x, bool)]:
            tests.append(col["flag"].isin(flags))
        if words := [same(x) for x in value if isinstance(x, str)]:
            tests.append(own.isin(words))
        if numbers := [x for x in value if isinstance(x, (int, float)) and not isinstance(x, bool)]:
            if whole := [int(x) for x in numbers if meta.INT_MIN <= x <= meta.INT_MAX and x == int(x)]:
                tests.append(col["whole"].isin(whole))
            tests.append(col["real"].isin([float(x) for x in numbers]))
        if operator == "in":
            return reduce(Column.__or__, tests)
        return kind.isNotNull() & (kind != "null") & ~reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests])
    if isinstance(value, bool):
        return meta._compare(col["flag"], operator, F.lit(value))
    if isinstance(value, (int, float)):
        return _whole(col["whole"], operator, value) | meta._compare(col["real"], operator, F.lit(float(value)))
    if operator in ("gt", "gte", "lt", "lte"):
        return meta._compare(col["text"], operator, F.lit(value))
    if operator in ("eq", "ne"):
        return meta._compare(own, operator, F.lit(same(value)))
    return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[operator](own, F.lit(same(value)))


def _whole(c: Column, op: str, x: int | float) -> Column:
    """Comparison of integers with any number, as one between integers."""
    if isinstance(x, float) and not x.is_integer():
        if op in ("eq", "ne"):
            return c.isNotNull() if op == "ne" else F.lit(False)
        op, x = ("gte", math.ceil(x)) if op in ("gt", "gte") else ("lte", math.floor(x))
    x = int(x)
    if meta.INT_MIN <= x <= meta.INT_MAX:
        return meta._compare(c, op, F.lit(x).cast("bigint"))
    return c.isNotNull() if op in (("lt", "lte", "ne") if x > 0 else ("gt", "gte", "ne")) else F.lit(False)


def declared(text: str) -> Mapping[str, str]:
    """Keys and kinds of a text like "status,priority:integer"."""
    out = {}
    for item in filter(None, (x.strip() for x in text.split(","))):
        key, _, kind = item.partition(":")
        meta.path_of(key.strip())
        if (kind := kind.strip() or "string") not in KINDS:
            raise meta.FilterError(f"a key is one of {', '.join(KINDS)}, not {kind!r}")
        out[key.strip()] = kind
    return out
