"""Typed predicates on JSON metadata, compiled to Columns over VARIANT.

A predicate looks at the stored value's JSON type first, so that "5" never equals
5, true never equals 1, and JSON null differs from a missing key. String
comparison folds ASCII letters only, unless case_sensitive. Integers compare
exactly: a fractional bound is moved to the next integer instead of casting
the stored integer to double.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_FILTERS, MAX_IN_LIST

OPERATORS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "exists", "not_exists", "contains", "starts_with", "ends_with", "is_null", "is_not_null", "array_contains",
)
KEY = re.compile(r"[A-Za-z0-9_.-]+\Z")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INT_MIN, INT_MAX = -(2**63), 2**63 - 1


class FilterError(ValueError):
    """A filter that can't be compiled; reported as data by the search operators."""


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def path_of(key: str) -> str:
    parts = key.split(".")
    if not KEY.match(key) or "" in parts or any(p.isdigit() for p in parts[1:]):
        raise FilterError(f"invalid metadata key: {key!r}")
    return "$" + "".join(f'["{p}"]' for p in parts)


def check_value(v: object) -> None:
    if isinstance(v, bool) or v is None:
        return
    if isinstance(v, int) and not INT_MIN <= v <= INT_MAX:
        raise FilterError("integer outside 64 bits")
    if isinstance(v, float) and not math.isfinite(v):
        raise FilterError("number isn't finite")
    if isinstance(v, str) and ("\0" in v or any(0xD800 <= ord(c) <= 0xDFFF for c in v)):
        raise FilterError("string holds a NUL or a lone surrogate")


class _Value:
    """A stored value: its variant, its type name, typed reads."""

    def __init__(self, v: Column):
        self.v, self.kind = v, F.schema_of_variant(v)

    def string(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.v, "$", "string"))

    def boolean(self) -> Column:
        return F.when(self.kind == "BOOLEAN", F.try_variant_get(self.v, "$", "boolean"))

    def present(self) -> Column:
        return self.v.isNotNull() & ~F.coalesce(F.is_variant_null(self.v), F.lit(False))

    def number(self, op: str, x: int | float) -> Column:
        """Comparison with a number; null unless the stored value is one."""
        whole = F.try_variant_get(self.v, "$", "bigint")
        real = F.try_variant_get(self.v, "$", "double")
        return F.when(self.kind == "BIGINT", _with_integer(whole, op, x)).when(self.kind.startswith("DECIMAL") | self.kind.isin("DOUBLE", "FLOAT"), _compare(real, op, F.lit(float(x))))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def _with_integer(c: Column, op: str, x: int | float) -> Column:
    known = lambda b: F.when(c.isNotNull(), F.lit(b))
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    if isinstance(x, float):
        if op in ("eq", "ne"):
            return known(op == "ne")
        op, x = ("gte", math.ceil(x)) if op in ("gt", "gte") else ("lte", math.floor(x))
    if x > INT_MAX:
        return known(op in ("lt", "lte", "ne"))
    if x < INT_MIN:
        return known(op in ("gt", "gte", "ne"))
    return _compare(c, op, F.lit(x).cast("bigint"))


def _equals(s: _Value, x: object, sensitive: bool, op: str = "eq") -> Column:
    if isinstance(x, bool):
        return _compare(s.boolean(), op, F.lit(x))
    if isinstance(x, (int, float)):
        return s.number(op, x)
    return _compare(s.string(), op, F.lit(x)) if sensitive else _compare(fold(s.string()), op, fold(F.lit(x)))


def _listed(s: _Value, xs: list, sensitive: bool) -> Column:
    """Equality with any of xs, as _equals() has it; a membership test for each kind of value."""
    out = F.lit(False)
    if flags := [x for x in xs if isinstance(x, bool)]:
        out = out | F.coalesce(s.boolean().isin(flags), F.lit(False))
    if words := [x for x in xs if isinstance(x, str)]:
        own = s.string() if sensitive else fold(s.string())
        out = out | F.coalesce(own.isin([F.lit(x) if sensitive else fold(F.lit(x)) for x in words]), F.lit(False))
    if numbers := [x for x in xs if isinstance(x, (int, float)) and not isinstance(x, bool)]:
        whole = [int(x) for x in numbers if INT_MIN <= x <= INT_MAX and x == int(x)]
        is_whole = (s.kind == "BIGINT") & F.try_variant_get(s.v, "$", "bigint").isin(whole) if whole else F.lit(False)
        is_real = (s.kind.startswith("DECIMAL") | s.kind.isin("DOUBLE", "FLOAT")) & F.try_variant_get(s.v, "$", "double").isin([float(x) for x in numbers])
        out = out | F.coalesce(is_whole, F.lit(False)) | F.coalesce(is_real, F.lit(False))
    return out


def predicate(metadata: Column, key: str, operator: str, value: object = None, case_sensitive: bool = False) -> Column:
    """A boolean Column, never null; the metadata is parsed once a row."""
    if operator not in OPERATORS:
        raise FilterError(f"unknown operator: {operator!r}")
    for x in value if isinstance(value, (list, tuple)) else [value]:
        check_value(x)
    found = F.try_variant_get(F.try_parse_json(metadata), path_of(key), "variant")
    return F.coalesce(F.transform(F.array(found), lambda v: _holds(_Value(v), operator, value, case_sensitive))[0], F.lit(False))


def _holds(s: _Value, operator: str, value: object, case_sensitive: bool) -> Column:
    if operator in ("exists", "is_not_null"):
        out = s.present()
    elif operator == "not_exists":
        out = ~s.present()
    elif operator == "is_null":
        out = F.is_variant_null(s.v)
    elif operator in ("in", "not_in"):
        if not isinstance(value, (list, tuple)) or not 1 <= len(value) <= MAX_IN_LIST or any(x is None or isinstance(x, (list, dict)) for x in value):
            raise FilterError(f"{operator} takes a list of 1 to {MAX_IN_LIST} strings, numbers or booleans")
        out = _listed(s, list(value), case_sensitive)
        out = s.present() & ~out if operator == "not_in" else out
    elif value is None or isinstance(value, (list, dict, tuple)):
        raise FilterError(f"{operator} takes a string, number or boolean")
    elif operator in ("eq", "ne"):
        out = _equals(s, value, case_sensitive, operator)
    elif operator in ("gt", "gte", "lt", "lte"):
        if isinstance(value, bool):
            raise FilterError(f"{operator} takes no boolean")
        out = _compare(s.string(), operator, F.lit(value)) if isinstance(value, str) else s.number(operator, value)
    elif operator == "array_contains":
        items = F.when(s.kind.startswith("ARRAY"), F.try_variant_get(s.v, "$", "array<variant>"))
        out = F.exists(items, lambda e: F.coalesce(_equals(_Value(e), value, case_sensitive), F.lit(False)))
    else:
        if not isinstance(value, str):
            raise FilterError(f"{operator} takes a string")
        a, b = (s.string(), F.lit(value)) if case_sensitive else (fold(s.string()), fold(F.lit(value)))
        out = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[operator](a, b)
    return out


def simple_equality(metadata: Column, wanted: Mapping[str, object]) -> list[Column]:
    """{key: value}: equality, case-sensitive for strings."""
    return [predicate(metadata, k, "eq", v, case_sensitive=True) for k, v in wanted.items()]


def compile_filters(metadata: Column, filters: Iterable[Mapping], wanted: Mapping[str, object] | None = None, use_and: bool = True, test: Callable[..., Column] | None = None) -> tuple[Column | None, list[str]]:
    """The joined condition (None if there is none) and the validation errors. test makes the condition of a filter: predicate(), if none is given."""
    test = test or functools.partial(predicate, metadata)
    filters, errors, parts = list(filters), [], []
    if len(filters) > MAX_FILTERS or len(wanted or {}) > MAX_FILTERS:
        return None, [f"at most {MAX_FILTERS} metadata filters"]
    try:
        parts += [test(k, "eq", v, True) for k, v in (wanted or {}).items()]
    except FilterError as e:
        errors.append(str(e))
    for f in filters:
        try:
            parts.append(test(f["key"], f.get("operator", "eq"), f.get("value"), bool(f.get("case_sensitive", False))))
        except (FilterError, KeyError) as e:
            errors.append(str(e))
    if errors or not parts:
        return None, errors
    return reduce(Column.__and__ if use_and else Column.__or__, parts), []


def index_type_ok(value: Column, kind: str) -> Column:
    """Whether a metadata value, as text, suits a typed index: string, integer (32 bits), number, boolean."""
    v = F.trim(value)
    if kind == "integer":
        return F.coalesce(v.try_cast("int").isNotNull() & F.rlike(v, F.lit(r"^[+-]?\d+$")), F.lit(False))
    if kind == "number":
        return F.coalesce(F.rlike(v, F.lit(r"^[+-]?(\d[\d_]*(\.[\d_]*)?|\.\d[\d_]*)([eE][+-]?\d+)?$|^0[xX][0-9a-fA-F_]+$")), F.lit(False))
    if kind == "boolean":
        return F.lower(v).isin("true", "false", "t", "f", "yes", "no", "on", "off", "1", "0")
    return value.isNotNull()
