"""From expressions of a query to typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KqlCompileError, KqlEvalError
from . import tree as t
from . import values as V
from .values import Val, common, elements, equal, literal, null, of_column, text

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

WINDOWS = ("row_number", "prev", "next", "row_cumsum")


@dataclass
class Context:
    """What a query is compiled with. lets: the values of scalar lets."""

    spark: SparkSession
    options: Any
    lets: dict[str, Val] = field(default_factory=dict)
    window: Callable[[t.Call, Mapping[str, Val]], Val] | None = None


def compile_expr(context: Context, e: t.Expr, columns: Mapping[str, Val]) -> Val:
    """The value of an expression over `columns`; a name that is neither column nor let is null."""
    go = lambda x: compile_expr(context, x, columns)
    if isinstance(e, t.Lit):
        return literal(e.value, e.kind)
    if isinstance(e, t.Col):
        return columns.get(e.name) or context.lets.get(e.name) or null()
    if isinstance(e, t.Member):
        return V.member(go(e.of), go(e.key))
    if isinstance(e, t.Unary):
        of = go(e.of)
        if e.op == "-":
            return V.negative(of)
        return Val(~V.as_bool(of), "bool") if of.kind in ("bool", "dynamic") else Val(F.when(of.col.isNotNull(), True), "bool") if of.kind != "null" else null("bool")
    if isinstance(e, t.Items):
        return _listed([go(x) for x in e.items])
    if isinstance(e, t.Binary):
        return _binary(context, e, go)
    if isinstance(e, t.Call):
        return _call(context, e, columns, go)
    raise KqlCompileError(f"unknown expression {e!r}")


def _listed(items: list[Val]) -> Val:
    same = common(items)
    one = next((v for v in same if v.kind != "null"), None)
    if one is None:
        return V.array(F.array(*[v.col for v in same]), V.SPARK["string"])
    if one.kind == "timespan":
        return V.array(F.array(*[V.as_variant(v) for v in same]), V.SPARK["dynamic"])
    return V.array(F.array(*[v.col for v in same]), one.native or V.SPARK[one.kind])


def _call(context: Context, e: t.Call, columns: Mapping[str, Val], go) -> Val:
    from ..functions import FUNCTIONS

    if context.window and e.name in WINDOWS:
        return context.window(e, columns)
    if e.name == "columnifexists":
        return _column_if_exists(context, e, columns, go)
    build = FUNCTIONS.get(e.name)
    if build is None:
        raise KqlCompileError(f"unknown function {e.name!r}", *e.at)
    args = [go(a) for a in e.args]
    try:
        return build(context, *args)
    except TypeError as problem:
        if "argument" not in str(problem):
            raise
        if context.options.strict_types:
            raise KqlEvalError(f"{e.name}: {problem}") from problem
        return null()


def _column_if_exists(context: Context, e: t.Call, columns: Mapping[str, Val], go) -> Val:
    if len(e.args) != 2:
        raise KqlCompileError("columnifexists takes a name and a default", *e.at)
    name, default = go(e.args[0]), go(e.args[1])
    if name.constant:
        return columns.get(str(name.lit), default)
    # A name that differs by row: the columns of the default's kind, chosen by name.
    out: Any = F
    for column, value in columns.items():
        if value.kind == default.kind and value.native == default.native:
            out = out.when(text(name) == column, value.col)
    return Val(out.otherwise(default.col) if out is not F else default.col, default.kind, default.native)


def _has(a: Column, needle: Val, exact: bool) -> Column:
    """Whether a word stands in a text, between ends or anything but ASCII letters and digits."""
    flags = "" if exact else "(?iu)"
    edges = ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])")
    if needle.constant:
        word = constant_text(needle)
        if not word:
            return F.lit(False)
        found = a.rlike(flags + edges[0] + V.quote(word) + edges[1])
        quick = (a if exact else F.lower(a)).contains(word if exact else word.lower())
        return quick & found if word.isascii() else found
    word = text(needle)
    return (word != "") & F.rlike(a, F.concat(F.lit(flags + edges[0]), V.quoted(word), F.lit(edges[1])))


def constant_text(v: Val) -> str:
    """The text of a constant."""
    if v.lit is None:
        return ""
    if isinstance(v.lit, bool):
        return "true" if v.lit else "false"
    return str(v.lit)


def _terms(context: Context, e: t.Expr, go) -> list[Val] | Val:
    """The members of a list as written, or a value that may be an array."""
    if isinstance(e, t.Items):
        return [go(x) for x in e.items]
    return go(e)


def _has_several(a: Column, terms: list[Val] | Val, all_: bool) -> Column:
    if isinstance(terms, list):
        tests = [_has(a, x, False) for x in terms if x.kind != "null"]
        if not tests:
            return F.lit(False)
        out = tests[0]
        for test in tests[1:]:
            out = out & test if all_ else out | test
        return out
    found = elements(terms)
    if terms.kind != "dynamic" or found is None:
        return _has(a, terms, False) if terms.kind != "null" else F.lit(False)
    words = F.filter(F.transform(found[0], lambda x: V.to_text(of_column(x, found[1]))), lambda x: x.isNotNull())
    test = lambda x: _has(a, Val(x, "string"), False)
    inside = (F.forall if all_ else F.exists)(words, test) & (F.size(words) > 0)
    single = _has(a, terms, False) if terms.variant else F.lit(False)
    return F.when(found[0].isNotNull(), inside).otherwise(F.coalesce(single, F.lit(False)))


def _in(a: Val, terms: list[Val] | Val) -> Column:
    if isinstance(terms, list):
        fixed = [x for x in terms if x.constant and x.lit is not None]
        if len(fixed) == len(terms) and a.kind in ("string", "long") and all(x.kind == a.kind for x in terms):
            return F.coalesce(a.col.isin([x.lit for x in terms]), F.lit(False))
        out = F.lit(False)
        for x in terms:
            out = out | equal(a, x)
        return out
    found = elements(terms) if terms.kind == "dynamic" else None
    if found is None:
        return equal(a, terms)
    inside = F.exists(found[0], lambda x: equal(a, of_column(x, found[1])))
    return F.coalesce(F.when(found[0].isNotNull(), inside).otherwise(equal(a, terms)), F.lit(False))


def _binary(context: Context, e: t.Binary, go) -> Val:
    op = e.op
    if op in ("and", "or"):
        a, b = V.as_bool(go(e.left)), V.as_bool(go(e.right))
        return Val(a & b if op == "and" else a | b, "bool")
    if op in ("+", "-", "*", "/", "%"):
        return V.arithmetic(op, go(e.left), go(e.right))
    left = go(e.left)
    negated, name = op.startswith("!") and op not in ("!=", "!~"), op.lstrip("!")
    if op in ("has_any", "has_all"):
        return Val(_has_several(text(left), _terms(context, e.right, go), op == "has_all"), "bool")
    if name == "in":
        inside = _in(left, _terms(context, e.right, go))
        return Val(~inside if negated else inside, "bool")
    right = go(e.right)
    if op in ("==", "!="):
        same = equal(left, right)
        return Val(~same if op == "!=" else same, "bool")
    if op in V.ORDERS:
        return Val(V.ordered(op, left, right), "bool")
    if op == "matches":
        return _matches(context, left, right)
    a, b = text(left), text(right)
    if op in ("=~", "!~"):
        same = F.lower(a) == F.lower(b)
        return Val(~same if op == "!~" else same, "bool")
    exact = name.endswith("_cs")
    name = name.removesuffix("_cs")
    if name == "has":
        found = _has(a, right, exact)
    else:
        x, y = (a, b) if exact else (F.lower(a), F.lower(b))
        found = {"contains": x.contains, "startswith": x.startswith, "endswith": x.endswith}[name](y)
    return Val(~found if negated else found, "bool")


def _matches(context: Context, left: Val, right: Val) -> Val:
    if right.constant:
        pattern = V.java_regex(context.spark, constant_text(right))
        return null("bool") if pattern is None else Val(text(left).rlike(pattern), "bool")
    return Val(_found()(text(left), text(right)), "bool")


@lru_cache(maxsize=1)
def _found():
    """Whether a pattern of its row is in a text, null for an invalid one: patterns of a column are only known row by row, so Python says."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        known: dict[str, re.Pattern | None] = {}
        out = []
        for whole, pattern in zip(texts.to_pylist(), patterns.to_pylist(), strict=True):
            if pattern not in known:
                try:
                    known[pattern] = re.compile(pattern)
                except re.error:
                    known[pattern] = None
            out.append(None if known[pattern] is None else known[pattern].search(whole) is not None)
        return pa.array(out, pa.bool_())

    return run
