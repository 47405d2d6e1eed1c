"""Conversions, conditions and types."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from ..plans.values import Val, common, null, text, truth
from .registry import register


@register("tostring")
def tostring(context, v: Val) -> Val:
    return Val(text(v), "string")


@register("toint", "tolong")
def tolong(context, v: Val) -> Val:
    return Val(V.to_long(v), "long")


@register("toreal", "todouble")
def toreal(context, v: Val) -> Val:
    return Val(V.to_real(v), "real")


@register("tobool")
def tobool(context, v: Val) -> Val:
    return Val(V.to_bool(v), "bool")


@register("todatetime")
def todatetime(context, v: Val) -> Val:
    return Val(V.to_datetime(v), "datetime")


@register("totimespan")
def totimespan(context, v: Val) -> Val:
    return Val(V.to_timespan(v), "timespan")


@register("toguid")
def toguid(context, v: Val) -> Val:
    return Val(V.to_guid(v), "string")


@register("todecimal")
def todecimal(context, v: Val) -> Val:
    return Val(V.to_decimal(v), "decimal")


@register("tohex")
def tohex(context, v: Val) -> Val:
    return Val(F.lower(F.hex(V.to_long(v))), "string")


@register("todynamic", "parse_json")
def parse_json(context, v: Val) -> Val:
    return V.to_dynamic(v)


@register("iff", "iif")
def iff(context, test: Val, yes: Val, no: Val) -> Val:
    a, b = common([yes, no])
    chosen = a if a.kind != "null" else b
    return Val(F.when(truth(test), a.col).otherwise(b.col), chosen.kind, chosen.native)


@register("case")
def case(context, *args: Val) -> Val:
    tests, results = list(args[:-1:2]), list(args[1::2])
    if len(args) % 2:
        results.append(args[-1])
    else:
        tests = list(args[::2])
        results.append(null())
    results = common(results)
    chosen = next((r for r in results if r.kind != "null"), results[-1])
    out = F
    for test, result in zip(tests, results, strict=False):
        out = out.when(truth(test), result.col)
    return Val(out.otherwise(results[-1].col) if tests else results[-1].col, chosen.kind, chosen.native)


@register("coalesce")
def coalesce(context, *args: Val) -> Val:
    some = [a for a in args if a.kind != "null"]
    if not some:
        return null()
    values = common(some)
    full = []
    for a, v in zip(some, values, strict=True):
        content = a.col if a.kind == "string" else V.text_of(a.col) if a.variant else None
        full.append(v.col if content is None else F.when(content.isNull() | (content != ""), v.col))
    return Val(F.coalesce(*full), values[0].kind, values[0].native)


def _extreme(args: tuple[Val, ...], most: bool) -> Val:
    some = [a for a in args if a.kind != "null"]
    if not some:
        return null()
    values = common(some)
    if values[0].kind == "dynamic":
        keyed = [F.when(v.col.isNotNull(), F.struct(*V.sort_columns(v), V.to_text(v))) for v in values]
        best = F.greatest(*keyed) if most else F.least(*keyed)
        if len(values) < 2:
            return values[0]
        out = F
        for v, k in zip(values, keyed, strict=True):
            out = out.when(k == best, v.col)
        return Val(out.otherwise(None), "dynamic")
    columns = [v.col for v in values]
    return Val(columns[0] if len(columns) == 1 else F.greatest(*columns) if most else F.least(*columns), values[0].kind)


@register("max_of")
def max_of(context, *args: Val) -> Val:
    return _extreme(args, True)


@register("min_of")
def min_of(context, *args: Val) -> Val:
    return _extreme(args, False)


@register("isnull")
def isnull(context, v: Val) -> Val:
    return Val(v.col.isNull(), "bool")


@register("isnotnull")
def isnotnull(context, v: Val) -> Val:
    return Val(v.col.isNotNull(), "bool")


@register("gettype")
def gettype(context, v: Val) -> Val:
    if v.variant:
        shape = V.shape(v.col)
        kind = F.when(shape.rlike("INT$"), "long").when(V.is_number(v.col), "real").when(shape == "BOOLEAN", "bool").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "dynamic").otherwise("string")
    else:
        kind = F.lit({"long": "long", "real": "real", "bool": "bool", "dynamic": "array" if isinstance(v.native, T.ArrayType) else "dynamic"}.get(v.kind, "string"))
    return Val(F.when(v.col.isNull(), "null").otherwise(kind), "string")


@register("isascii")
def isascii(context, v: Val) -> Val:
    s = v.col if v.kind == "string" else V.text_of(v.col) if v.variant else F.lit(None).cast("string")
    return Val(F.coalesce(s.rlike(r"^[\x00-\x7F]*\z"), F.lit(False)), "bool")
