"""Metadata predicates against a plain Python model of their semantics."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import metadata as M

STORED = [1, 1.5, -3, 0.1, 2**53 + 1, 2**53, True, False, "", "a", "A", "É", "5", 5, "a%b_c", [1, "a", True], ["A", 5, 1.5], {"b": 1}, None, ...]
VALUES = ["a", "A", "É", "5", 5, 1.5, 0.1, 2**53, 2**53 + 1, float(2**53), True, False, 0, -2.5, ""]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def same_kind(s, v):
    if isinstance(v, bool):
        return isinstance(s, bool)
    if isinstance(v, (int, float)):
        return isinstance(s, (int, float)) and not isinstance(s, bool)
    return isinstance(s, str)


def model(s, op, v, sensitive):
    present = s is not ... and s is not None
    f = (lambda x: x) if sensitive else (lambda x: low(x) if isinstance(x, str) else x)
    if op in ("exists", "is_not_null"):
        return present
    if op == "not_exists":
        return not present
    if op == "is_null":
        return s is None
    if op == "in":
        return any(same_kind(s, x) and f(s) == f(x) for x in v) if present else False
    if op == "not_in":
        return present and not model(s, "in", v, sensitive)
    if op == "array_contains":
        return isinstance(s, list) and any(same_kind(e, v) and f(e) == f(v) for e in s)
    if not present or not same_kind(s, v):
        return False
    if op in ("gt", "gte", "lt", "lte"):
        a, b = (s.encode(), v.encode()) if isinstance(v, str) else (s, v)
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    if op in ("eq", "ne"):
        return (f(s) == f(v)) == (op == "eq")
    return {"contains": f(v) in f(s), "starts_with": f(s).startswith(f(v)), "ends_with": f(s).endswith(f(v))}[op]


def test_all_operators(spark):
    rows = [(i, None if s is ... else json.dumps({"k": s, "o-p": {"q": s}})) for i, s in enumerate(STORED)] + [(len(STORED), "{}"), (len(STORED) + 1, "not json")]
    stored = [*STORED, ..., ...]
    df = spark.createDataFrame(rows, "i int, m string")
    cases = []
    for op, sens in itertools.product(M.OPERATORS, (False, True)):
        if op in ("exists", "not_exists", "is_null", "is_not_null"):
            cases.append((op, None, sens))
        elif op in ("in", "not_in"):
            cases += [(op, ["A", 5, True], sens), (op, [0.1, "é", 2**53], sens)]
        else:
            for v in VALUES:
                if (op in ("contains", "starts_with", "ends_with") and not isinstance(v, str)) or (op in ("gt", "gte", "lt", "lte") and isinstance(v, bool)):
                    continue
                cases.append((op, v, sens))
    for path in ("k", "o-p.q"):
        cols = [M.predicate(F.col("m"), path, *c).alias(f"c{j}") for j, c in enumerate(cases)]
        for part in range(0, len(cases), 60):
            got = {r["i"]: r for r in df.select("i", *cols[part : part + 60]).collect()}
            for j, c in enumerate(cases[part : part + 60]):
                for i, s in enumerate(stored):
                    assert got[i][f"c{part + j}"] == model(s, *c), (path, c, s)


def test_rejections():
    for key in ("", "a..b", "a b", "a.0", "a.b.3"):
        with pytest.raises(M.FilterError):
            M.path_of(key)
    for v in (2**63, float("nan"), "a\0", "\ud800"):
        with pytest.raises(M.FilterError):
            M.check_value(v)


def test_errors_are_collected(spark):
    cond, errors = M.compile_filters(F.col("m"), [{"key": "k", "operator": "regex", "value": "x"}, {"key": "k", "operator": "in", "value": []}, {"key": "k", "operator": "gt", "value": True}])
    assert cond is None and len(errors) == 3


def test_index_types(spark):
    df = spark.createDataFrame([("1",), ("-7",), ("2147483648",), ("1.5",), ("0x1F",), ("1_000",), ("true",), ("x",), (None,)], "v string")
    got = [tuple(r) for r in df.select(*[M.index_type_ok(F.col("v"), k) for k in ("string", "integer", "number", "boolean")]).collect()]
    assert [r[0] for r in got] == [True] * 8 + [False]
    assert [r[1] for r in got] == [True, True, False, False, False, False, False, False, False]
    assert [r[2] for r in got] == [True, True, True, True, True, True, False, False, False]
    assert [bool(r[3]) for r in got] == [True, False, False, False, False, False, True, False, False]
