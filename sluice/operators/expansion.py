"""Operators that make several rows of one: mv-expand and mv-apply."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import tree as t
from ..plans import values as V
from ..plans.frame import Field, Frame, fresh
from ..plans.values import Val


def as_array(v: Val) -> tuple[Column, T.DataType]:
    """What a value expands to: the elements of an array, a bag of each pair of a bag, any other value itself, of null nothing."""
    if v.array:
        return F.coalesce(v.col, F.array().cast(v.native)), v.native.elementType
    none = F.array().cast("array<variant>")
    single = lambda m: F.transform(F.map_entries(m), lambda e: F.to_variant_object(F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    if v.variant:
        items = F.transform(v.col.try_cast("array<variant>"), V.plain)
        return F.coalesce(items, single(V.bag(v)), F.when(v.col.isNotNull(), F.array(v.col)), none), T.VariantType()
    if v.kind == "dynamic":
        return F.coalesce(single(V.bag(v)), none), T.VariantType()
    kind = V.SPARK[v.kind]
    return F.when(v.col.isNotNull(), F.array(v.col)).otherwise(F.array().cast(T.ArrayType(kind))), kind


def _arrays(low, frame: Frame, columns: tuple[tuple[str, t.Expr | None], ...]) -> list[tuple[str, Column, T.DataType, bool]]:
    """For each column its name, array, type of elements and whether they are timespans."""
    known, out = frame.columns(), []
    for name, e in columns:
        v = known.get(name, V.null("string")) if e is None else low.value(e, frame, known)
        array, kind = as_array(v)
        out.append((name, array, kind, v.kind == "timespan"))
    return out


def exploded(frame: Frame, arrays: list[tuple[str, Column, T.DataType, bool]], limit: int | None) -> tuple[Frame, dict[str, Field], str]:
    """(frame, fields, place): a row for each place of any of the arrays; shorter ones give null."""
    place, item = fresh("at"), fresh("item")
    if len(arrays) == 1:
        items = arrays[0][1]
    else:
        held = {fresh("list"): a for _, a, _, _ in arrays}
        frame = frame.with_columns(held)
        items = F.arrays_zip(*held)
    items = items if limit is None else F.slice(items, 1, limit)
    df = frame.df.select("*", F.posexplode(items).alias(place, item))
    fields = {}
    if len(arrays) == 1:
        name, _, kind, span = arrays[0]
        fields[name] = Field(item, kind, span)
    else:
        parts = {}
        for (name, _, kind, span), source in zip(arrays, held, strict=True):
            fields[name] = Field(fresh(), kind, span)
            parts[fields[name].name] = F.col(item)[source]
        df = df.withColumns(parts)
    out = replace(frame, df=df, order=(*frame.order, (place, False)), small=False)
    return out, fields, place


def expand(low, frame: Frame, op: t.Expand) -> Frame:
    frame, fields, place = exploded(frame, _arrays(low, frame, op.columns), op.limit)
    frame = replace(frame, fields={**frame.fields, **fields})
    return frame if op.index is None else frame.with_values({op.index: Val(F.col(place).cast("long"), "long")})


def apply(low, frame: Frame, op: t.Apply) -> Frame:
    """The steps run on the elements of each row's arrays; their rows are put beside what is left of the row."""
    gone = {name for name, _ in op.columns} | {e.name for _, e in op.columns if isinstance(e, t.Col)}
    base = {k: f for k, f in frame.fields.items() if k not in gone}
    arrays = _arrays(low, frame, op.columns)
    steps = list(op.ops)
    if isinstance(steps[0], t.Summarize) and not steps[0].keys and len(arrays) == 1:
        made = folded(low, frame, arrays[0], steps[0])
        if made is not None:
            size, values = made
            out = replace(frame, fields=base).with_values(values).where(size > 0)
            return _rest(low, out, base, steps[1:])
    if isinstance(steps[0], t.Count):
        size = F.size(arrays[0][1]) if len(arrays) == 1 else F.greatest(*[F.size(a) for _, a, _, _ in arrays])
        out = replace(frame, fields=base).with_values({"Count": Val(size.cast("long"), "long")})
        return _rest(low, out, base, steps[1:])
    if len(arrays) == 1 and (made := topped(low, frame, base, arrays[0], steps)) is not None:
        return made
    row = fresh("row")
    frame = frame.with_columns({row: F.monotonically_increasing_id()})
    outer = frame
    order = tuple(c for c, _ in frame.order)
    inner, fields, _ = exploded(replace(frame, order=()), arrays, None)
    carried = tuple(dict.fromkeys([*frame.carry, *order, *(f.name for f in base.values())]))
    inner = replace(inner, fields=fields, scope=(*frame.scope, row), carry=carried)
    done = low.inner().steps(inner, tuple(steps))
    where = dict(zip(carried, done.carry, strict=True))
    kept = {k: replace(f, name=where[f.name]) for k, f in base.items()}
    own = {c: (where[c], down) for c, down in outer.order}
    return replace(done, fields={**kept, **done.fields}, scope=done.scope[:-1], carry=tuple(where[c] for c in frame.carry), order=(*own.values(), *done.order))


def _rest(low, frame: Frame, base: dict[str, Field], steps: list[t.Op]) -> Frame:
    """Further steps on the one row that each row has become, as its own row-set."""
    if not steps:
        return frame
    row = fresh("row")
    frame = frame.with_columns({row: F.monotonically_increasing_id()})
    order = tuple(c for c, _ in frame.order)
    carried = tuple(dict.fromkeys([*frame.carry, *order, *(f.name for f in base.values())]))
    inner = replace(frame, fields={k: f for k, f in frame.fields.items() if k not in base}, scope=(*frame.scope, row), carry=carried, order=())
    done = low.inner().steps(inner, tuple(steps))
    where = dict(zip(carried, done.carry, strict=True))
    kept = {k: replace(f, name=where[f.name]) for k, f in base.items()}
    return replace(done, fields={**kept, **done.fields}, scope=done.scope[:-1], carry=tuple(where[c] for c in frame.carry), order=(*((where[c], d) for c, d in frame.order), *done.order))


def topped(low, frame: Frame, base: dict[str, Field], array: tuple[str, Column, T.DataType, bool], steps: list[t.Op]) -> Frame | None:
    """`extend … | top n by …` of a row's elements, as a sort of the array before it is expanded; None where the steps aren't of that form.

    The rows keep their places, so nothing is shuffled. Keys that fall must be whole numbers; other keys rise."""
    name, items, kind, span = array
    n = next((i for i, op in enumerate(steps) if not isinstance(op, t.Extend)), len(steps))
    if span or n == len(steps) or not isinstance(steps[n], t.Sort) or steps[n].n is None or any(not isinstance(op, (t.Extend, t.Where, t.Project, t.Arrange, t.Rename)) for op in steps[n + 1 :]):
        return None
    fits = True

    def keys(x: Column, i: Column) -> Column:
        nonlocal fits
        seen, out = {name: V.of_column(x, kind)}, []
        for op in steps[:n]:
            for new, e in op.items:
                seen = {**seen, new: low.value(e, None, seen)}
        for e, down in steps[n].keys:
            v = low.value(e, None, seen)
            fits = fits and (not down or v.kind == "long")
            out += [v.col.isNull(), F.bitwise_not(v.col)] if down and v.kind == "long" else V.sort_columns(v)
        return F.struct(*[c.alias(f"k{j}") for j, c in enumerate(out)], i.alias("i"))

    held = fresh("list")
    frame = frame.with_columns({held: items})
    sorted_ = F.sort_array(F.transform(F.col(held), keys))  # by the structs' own order, which needs no comparing lambda
    if not fits:
        return None
    best = F.transform(F.slice(sorted_, 1, steps[n].n), lambda s: F.get(F.col(held), s["i"]))
    inner, fields, place = exploded(replace(frame, order=()), [(name, best, kind, span)], None)
    done = low.inner().steps(replace(inner, fields=fields), (*steps[:n], *steps[n + 1 :]))
    return replace(done, fields={**base, **done.fields}, order=(*frame.order, (place, False)))


def expand_summarized(low, frame: Frame, op: t.Expand, after: t.Summarize) -> Frame | None:
    """`mv-expand x | summarize … by …` where each row is a row-set of its own and the keys are other columns: a fold of the array. None where it isn't one."""
    if len(op.columns) != 1 or op.index is not None:
        return None
    ((name, items, kind, span),) = _arrays(low, frame, op.columns)
    if any(not isinstance(e, t.Col) or e.name == name or e.name not in frame.fields for _, e in after.keys):
        return None
    held = fresh("list")
    wide = frame.with_columns({held: items if op.limit is None else F.slice(items, 1, op.limit)})
    made = folded(low, wide, (name, F.col(held), kind, span), after, frame.columns())
    if made is None:
        return None
    size, values = made
    return replace(wide, fields={new: frame.fields[e.name] for new, e in after.keys}).with_values(values).where(size > 0)


def folded(low, frame: Frame, array: tuple[str, Column, T.DataType, bool], op: t.Summarize, known: dict[str, Val] | None = None) -> tuple[Column, dict[str, Val]] | None:
    """(size, values) of aggregates over the elements of an array, without making rows of them; None if one can't be had so. known: other columns."""
    name, items, kind, span = array
    if span:
        return None
    values = {}
    for out, call in op.aggs:
        v = _fold(low, name, items, kind, call, known or {})
        if v is None:
            return None
        values[out] = v
    return F.size(items), values


def _fold(low, name: str, items: Column, kind: T.DataType, call: t.Expr, known: dict[str, Val]) -> Val | None:
    if not isinstance(call, t.Call) or call.name not in ("count", "countif", "sum", "avg", "min", "max", "dcount", "make_list", "any", "take_any"):
        return None
    if call.name == "count":
        return Val(F.size(items).cast("long"), "long")
    if len(call.args) != 1:
        return None
    each = lambda x: low.value(call.args[0], None, {**known, name: V.of_column(x, kind)})
    sort = each(F.lit(None).cast(kind))
    if call.name == "countif":
        return Val(F.size(F.filter(items, lambda x: V.truth(each(x)))).cast("long"), "long")
    if call.name == "dcount":
        distinct = F.array_distinct(F.transform(items, lambda x: V.canonical(each(x))))
        return Val(F.size(F.filter(distinct, lambda x: x.isNotNull())).cast("long"), "long")
    if sort.kind not in ("long", "real", "string", "datetime", "bool") or sort.kind == "bool" and call.name not in ("make_list", "any", "take_any"):
        return None
    some = F.filter(F.transform(items, lambda x: each(x).col), lambda x: x.isNotNull())
    if call.name == "make_list":
        return V.array(some, V.SPARK[sort.kind])
    if call.name in ("any", "take_any"):
        return Val(F.get(some, F.lit(0)), sort.kind)
    if call.name in ("min", "max"):
        return Val(F.array_min(some) if call.name == "min" else F.array_max(some), sort.kind)
    if sort.kind not in ("long", "real"):
        return None
    zero = F.lit(0).cast("long") if sort.kind == "long" else F.lit(0.0)
    total = F.aggregate(some, zero, lambda a, x: a + x)
    if call.name == "sum":
        return Val(F.when(F.size(some) > 0, total), sort.kind)
    return Val(F.when(F.size(some) > 0, total.cast("double") / F.size(some)), "real")
