"""Numbers and bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import NUMERIC, SPARK, Val, null, number_of, text_of, to_long, to_real
from .registry import batched, register


def number(v: Val) -> Val:
    """A number, or the real that text reads as; null for anything else, bools included."""
    if v.kind in NUMERIC:
        return v
    if v.kind == "string":
        return Val(to_real(v), "real")
    if v.variant:
        return Val(F.coalesce(number_of(v.col), to_real(Val(text_of(v.col), "string"))), "real")
    return null("real")


def real(v: Val) -> Column:
    return to_real(number(v))


def long(col: Column) -> Val:
    return Val(F.when(~F.isnan(col.cast("double")), col.try_cast("long")), "long")


@register("abs")
def absolute(context, x: Val) -> Val:
    n = number(x)
    return Val(F.abs(n.col), n.kind)


@register("ceiling")
def ceiling(context, x: Val) -> Val:
    n = number(x)
    return n if n.kind == "long" else long(F.ceil(n.col))


@register("floor", "bin")
def floor(context, x: Val, step: Val | None = None) -> Val:
    n = number(x)
    if step is None:
        return n if n.kind == "long" else long(F.floor(n.col))
    by = number(step)
    if n.kind == by.kind == "long":
        down = F.try_mod(F.try_mod(n.col, by.col) + by.col, by.col)
        return Val(n.col - down, "long")
    steps = F.floor(F.try_divide(to_real(n), to_real(by)))
    return Val((steps * by.col).cast("long"), "long") if by.kind == "long" else Val(steps * to_real(by), "real")


@register("round")
def rounded(context, x: Val, places: Val | None = None) -> Val:
    n = number(x)
    if places is None:
        return n if n.kind == "long" else long(F.bround(n.col, 0))
    if not places.constant or places.lit is None:
        return null("real")
    return Val(F.bround(n.col, int(places.lit)).cast(SPARK[n.kind]), n.kind)


@register("sign")
def sign(context, x: Val) -> Val:
    n = number(x).col
    return Val(F.when(n > 0, 1).when(n < 0, -1).when(n == 0, 0).cast("long"), "long")


@register("pow")
def power(context, a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    made = F.pow(to_real(x), to_real(y))
    if x.kind == y.kind == "long":
        if y.constant and y.lit is not None and y.lit < 0:
            return Val(made, "real")
        return long(made)
    return Val(made, "real")


def _real(name: str, build, domain=None) -> None:
    @register(name)
    def made(context, x: Val) -> Val:
        n = real(x)
        out = build(n)
        return Val(F.when(domain(n), out) if domain else out, "real")


_finite = lambda n: F.abs(n) < float("inf")
for _name, _build, _domain in (
    ("sqrt", F.sqrt, lambda n: n >= 0), ("exp", F.exp, lambda n: n < 709.79), ("exp2", lambda n: F.pow(F.lit(2.0), n), lambda n: n < 1024), ("exp10", lambda n: F.pow(F.lit(10.0), n), lambda n: n < 308.3),
    ("log", F.ln, lambda n: n > 0), ("log2", F.log2, lambda n: n > 0), ("log10", F.log10, lambda n: n > 0),
    ("sin", F.sin, _finite), ("cos", F.cos, _finite), ("tan", F.tan, _finite), ("asin", F.asin, lambda n: F.abs(n) <= 1), ("acos", F.acos, lambda n: F.abs(n) <= 1), ("atan", F.atan, None),
    ("degrees", lambda n: n * (180.0 / math.pi), None), ("radians", lambda n: n * (math.pi / 180.0), None),
    ("gamma", lambda n: batched(math.gamma, "double")(n), None), ("log_gamma", lambda n: batched(math.lgamma, "double")(n), None),
):
    _real(_name, _build, _domain)


def _is(name: str, test) -> None:
    @register(name)
    def made(context, x: Val) -> Val:
        if x.variant:
            return Val(F.coalesce(test(number_of(x.col)), F.lit(False)), "bool")
        return Val(F.coalesce(test(to_real(x)), F.lit(False)) if x.kind in NUMERIC else F.lit(False), "bool")


_is("isnan", F.isnan)
_is("isinf", lambda n: F.abs(n) == float("inf"))
_is("isfinite", lambda n: (F.abs(n) < float("inf")) & ~F.isnan(n))


@register("atan2")
def atan2(context, y: Val, x: Val) -> Val:
    return Val(F.atan2(real(y), real(x)), "real")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps: no more than the logarithm of the smaller number to the golden ratio, and a few."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    enough = (F.log(F.least(F.abs(a), F.abs(b)).cast("double") + 1) * 2.0781 + 4).cast("int")
    return F.aggregate(F.sequence(F.lit(1), enough), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), step, lambda s: s["a"])


@register("gcd")
def gcd(context, a: Val, b: Val) -> Val:
    return Val(_gcd(to_long(a), to_long(b)), "long")


@register("lcm")
def lcm(context, a: Val, b: Val) -> Val:
    x, y = to_long(a), to_long(b)
    shared = _gcd(x, y)
    return Val(F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise(F.abs(F.try_multiply((x / F.when(shared != 0, shared)).cast("long"), y))), "long")


def _bits(name: str, build) -> None:
    @register(name)
    def made(context, a: Val, b: Val) -> Val:
        return Val(build(to_long(a), to_long(b)), "long")


_bits("binary_and", lambda a, b: a.bitwiseAND(b))
_bits("binary_or", lambda a, b: a.bitwiseOR(b))
_bits("binary_xor", lambda a, b: a.bitwiseXOR(b))
_bits("binary_shift_left", lambda a, b: F.when(b >= 0, F.when(b > 63, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, b.cast("int")))))
_bits("binary_shift_right", lambda a, b: F.when(b >= 0, F.call_function("shiftright", a, F.least(b, F.lit(63)).cast("int"))))


@register("binary_not")
def binary_not(context, a: Val) -> Val:
    return Val(F.bitwise_not(to_long(a)), "long")
