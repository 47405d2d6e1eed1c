"""Operators that order rows, take some of them, or number them."""

from __future__ import annotations

import random
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import KqlCompileError
from ..plans import tree as t
from ..plans import values as V
from ..plans.expressions import compile_expr
from ..plans.frame import Frame, field_of, fresh
from ..plans.values import Val
from ..sources import constant


def sort(low, frame: Frame, op: t.Sort) -> Frame:
    """Stable: equal rows keep their order. Nothing moves until an operator or the caller needs the order."""
    added, order = {}, []
    for e, down in op.keys:
        for col in V.sort_columns(low.value(e, frame)):
            name = fresh("key")
            added[name] = col
            order.append((name, down))
    frame = replace(frame.with_columns(added), order=(*order, *frame.order))
    return frame if op.n is None else first_rows(frame, op.n)


def first_rows(frame: Frame, n: int) -> Frame:
    if not frame.scope:
        return replace(frame, df=(frame.df.orderBy(*frame.sorting()) if frame.order else frame.df).limit(n))
    place = fresh("place")
    numbered = frame.with_columns({place: F.row_number().over(frame.window())})
    return numbered.where(F.col(place) <= n)


def take(low, frame: Frame, op: t.Take) -> Frame:
    return first_rows(frame, op.n)


def sample(low, frame: Frame, op: t.Sample) -> Frame:
    """Of a whole table the rows with the least random numbers; of a row-set with a seed the numbers that Python's generator draws."""
    seed = low.context.options.random_seed
    if not frame.scope:
        chance = fresh("chance")
        shown = [F.col(f.name).alias(f"c{i}") for i, f in enumerate(frame.fields.values())]  # names of our own differ from one compilation to the next
        draw = F.rand() if seed is None else F.xxhash64(F.lit(seed), *[F.to_json(F.struct(*shown)) if shown else F.lit(0)])
        drawn = frame.with_columns({chance: draw})
        return replace(drawn, df=drawn.df.orderBy(chance).limit(op.n))
    if seed is None:
        place = fresh("place")
        numbered = frame.with_columns({place: F.row_number().over(Window.partitionBy(*frame.scope).orderBy(F.rand()))})
        return numbered.where(F.col(place) <= op.n)
    n = op.n

    @F.arrow_udf("array<int>")
    def drawn_places(counts: pa.Array) -> pa.Array:
        draw = lambda m: list(range(m)) if n >= m else random.Random(seed).sample(range(m), n)
        return pa.array([draw(m) for m in counts.to_pylist()], pa.list_(pa.int32()))

    place, many = fresh("place"), fresh("rows")
    numbered = frame.with_columns({place: F.row_number().over(frame.window()) - 1, many: F.count(F.lit(1)).over(Window.partitionBy(*frame.scope)).cast("long")})
    chosen = fresh("drawn")
    numbered = numbered.with_columns({chosen: drawn_places(F.col(many))})
    return numbered.where(F.array_contains(F.col(chosen), F.col(place)))


def sample_distinct(low, frame: Frame, op: t.SampleDistinct) -> Frame:
    from .aggregation import distinct

    return sample(low, distinct(low, frame, t.Distinct((op.name,))), t.Sample(op.n))


def serialize(low, frame: Frame, op: t.Serialize) -> Frame:
    """Assignments in turn; window functions run over the row-set in its order."""
    for name, e in op.items:
        frame = _windowed(low, frame, name, e)
    return frame


def _windowed(low, frame: Frame, name: str, e: t.Expr) -> Frame:
    added: dict = {}
    over = frame.window()

    def segment(test: t.Expr):
        """A column that counts the rows at which `test` restarts, the first row aside."""
        flag, part = fresh("flag"), fresh("part")
        restart = V.truth(compile_expr(inner, test, columns)) & (F.row_number().over(over) > 1)
        added[flag] = F.when(restart, 1).otherwise(0)
        added[part] = F.sum(F.col(flag)).over(over.rowsBetween(Window.unboundedPreceding, 0))
        return part

    def fixed(x: t.Expr, default):
        got, _ = constant(inner, x)
        return default if got is None else got

    def window(call: t.Call, columns) -> Val:
        args = call.args
        if call.name == "row_number":
            start = int(fixed(args[0], 1)) if args else 1
            spec = frame.window(segment(args[1])) if len(args) > 1 else over
            return Val((F.row_number().over(spec) - 1 + start).cast("long"), "long")
        if not args:
            raise KqlCompileError(f"{call.name} needs an argument", *call.at)
        v = compile_expr(inner, args[0], columns)
        if call.name == "row_cumsum":
            whole = v.kind == "long" or v.kind == "bool"
            number = V.to_long(v) if whole else F.coalesce(V.number_of(v.col)) if v.variant else V.to_real(v) if v.kind in V.NUMERIC else F.lit(0.0)
            spec = frame.window(segment(args[1])) if len(args) > 1 else over
            total = F.sum(F.coalesce(number, F.lit(0).cast("long" if whole else "double"))).over(spec.rowsBetween(Window.unboundedPreceding, 0))
            return Val(total, "long" if whole else "real")
        away = int(fixed(args[1], 1)) if len(args) > 1 else 1
        away = away if call.name == "prev" else -away
        default = compile_expr(inner, args[2], {}) if len(args) > 2 else V.null()
        a, b = V.common([v, default])
        one = a if a.kind != "null" else b
        held = fresh("value")
        added[held] = F.struct(a.col.alias("v"))  # a struct, so that a null value isn't taken for a row that isn't there
        moved = F.lag(F.col(held), away).over(over) if away >= 0 else F.lead(F.col(held), -away).over(over)
        return Val(F.when(moved.isNull(), b.col).otherwise(moved["v"]), one.kind, one.native)

    inner = replace(low.context, window=None)
    outer = replace(low.context, window=window)
    columns = frame.columns()
    v = compile_expr(outer, e, columns)
    for hidden, col in added.items():
        frame = frame.with_columns({hidden: col})
    f = field_of(v)
    return replace(frame.with_columns({f.name: v.col}), fields={**frame.fields, name: f})
