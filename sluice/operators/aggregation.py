"""Operators that group rows: summarize, distinct, count, getschema, make-series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KqlCompileError
from ..plans import tree as t
from ..plans import values as V
from ..plans.frame import Field, Frame, field_of, fresh
from ..plans.values import Val
from ..sources import constant

#: Bins of a series at most.
BINS = 10_000_000
AGGREGATES = ("count", "countif", "sum", "sumif", "avg", "avgif", "min", "max", "dcount", "make_list", "make_set", "any", "take_any")


def _sum(v: Val) -> Val:
    if v.kind in ("long", "bool"):
        return Val(F.sum(V.to_long(v)), "long")
    if v.kind == "real":
        return Val(F.sum(v.col), "real")
    if v.variant:
        n = V.number_of(v.col)
        whole = F.count_if(n.isNotNull() & ~V.shape(v.col).rlike("INT$")) == 0
        longs = F.sum(F.when(n.isNotNull(), F.try_variant_get(v.col, "$", "long")))
        return Val(F.when(F.count(n) > 0, F.when(whole, longs.cast("variant")).otherwise(F.sum(n).cast("variant"))), "dynamic")
    return Val(F.max(F.lit(None).cast("long")), "long")  # neither texts nor decimals are numbers here


def _average(v: Val) -> Val:
    if v.kind in ("long", "real", "bool"):
        return Val(F.avg(V.to_real(v)), "real")
    return Val(F.avg(V.number_of(v.col)), "real") if v.variant else Val(F.max(F.lit(None).cast("double")), "real")


def aggregate(low, frame: Frame, call: t.Expr, columns: dict[str, Val]) -> Val:
    """An aggregate over groups of a rising frame."""
    if not isinstance(call, t.Call) or call.name not in AGGREGATES:
        raise KqlCompileError(f"an aggregate function is needed here, not {getattr(call, 'name', type(call).__name__)!r}", *(call.at if isinstance(call, t.Call) else (None, None)))
    name = call.name
    if name == "count":
        return Val(F.count(F.lit(1)), "long")
    need = 2 if name in ("sumif", "avgif") else 1
    if len(call.args) < need:
        raise KqlCompileError(f"{name} needs {need} arguments", *call.at)
    v = low.value(call.args[0], frame, columns)
    if name == "countif":
        return Val(F.count_if(V.truth(v)), "long")
    if name in ("sumif", "avgif"):
        test = V.truth(low.value(call.args[1], frame, columns))
        some = replace(v, col=F.when(test, v.col), lit=V.MISSING)
        return _sum(some) if name == "sumif" else _average(some)
    if name == "sum":
        return _sum(v)
    if name == "avg":
        return _average(v)
    if name == "dcount":
        return Val(F.count_distinct(V.canonical(v)), "long")
    if name in ("min", "max"):
        if v.kind == "dynamic":
            keys = F.when(v.col.isNotNull(), F.struct(*V.sort_columns(v)))
            return replace(v, col=(F.min_by if name == "min" else F.max_by)(v.col, keys))
        return Val(F.min(v.col) if name == "min" else F.max(v.col), v.kind)
    if name in ("any", "take_any"):
        if frame.order:
            return replace(v, col=F.min_by(v.col, F.when(v.col.isNotNull(), frame.place())), lit=V.MISSING)
        return replace(v, col=F.any_value(v.col, True), lit=V.MISSING)
    return _collected(frame, v, distinct=name == "make_set")


def _collected(frame: Frame, v: Val, distinct: bool) -> Val:
    """The non-null values in the order of the rows."""
    if v.kind == "null":
        return V.array(F.collect_list(v.col), T.StringType())
    as_text = v.kind == "dynamic"
    item = V.canonical(v) if as_text else V.as_variant(v).cast("string") if v.kind == "timespan" else v.col
    if frame.order:
        listed = F.array_sort(F.collect_list(F.when(v.col.isNotNull(), F.struct(*[F.col(c) for c, _ in frame.order], item.alias("item")))))
        listed = F.transform(listed, lambda s: s["item"])
    else:
        listed = F.collect_list(F.when(v.col.isNotNull(), item))
    if distinct:
        listed = F.array_distinct(listed)
    if as_text:
        return V.array(F.transform(listed, lambda s: F.parse_json(s)), T.VariantType())
    return V.array(listed, T.StringType() if v.kind == "timespan" else V.SPARK[v.kind])


def grouped(low, frame: Frame, keys: dict[str, Val], aggregates: Callable[[Frame, dict[str, Val]], dict[str, Val]], empty: bool = False) -> Frame:
    """Rows by keys within the row-set; groups stand in the order of their first rows.

    Of a whole table the order of groups is given up where keeping it would need all rows in one place. Without rows there are no
    groups, or with `empty` and in a whole table without keys one."""
    if any(down for _, down in frame.order):
        frame = replace(frame, order=()) if not frame.scope and not _needs_order(low) else frame.rising()
    values, by, carried = {}, [], []
    for v in keys.values():
        name = fresh("key")
        by.append(name)
        values[name] = V.canonical(v)
        if v.kind == "dynamic":
            original = fresh("key")
            values[original] = v.col
            carried.append(original)
        else:
            carried.append(None)
    keyed = frame.with_columns(values)
    made = aggregates(keyed, keyed.columns())
    fields: dict[str, Field] = {}
    aggs: list[Column] = []
    for (name, v), key, original in zip(keys.items(), by, carried, strict=True):
        f = field_of(v, key if original is None else fresh())
        fields[name] = f
        if original is not None:
            aggs.append(F.first(F.col(original)).alias(f.name))
    for name, v in made.items():
        fields[name] = field_of(v)
        aggs.append(v.col.alias(fields[name].name))
    order: tuple = ()
    if frame.order:
        place = fresh("place")
        aggs.append(F.min(keyed.place()).alias(place))
        order = ((place, False),)
    aggs += [F.first(F.col(c)).alias(c) for c in frame.carry]
    columns = [*frame.scope, *by]
    if not aggs:
        df = keyed.df.select(*columns).distinct()
    elif columns or empty:
        df = keyed.df.groupBy(*columns).agg(*aggs)
    else:
        rows = fresh("rows")
        df = keyed.df.agg(F.count(F.lit(1)).alias(rows), *aggs).where(F.col(rows) > 0)
    return Frame(df, fields, frame.scope, order, frame.carry)


def _needs_order(low) -> bool:
    """Whether the aggregates at hand depend on the order of rows."""
    return getattr(low, "ordered_aggregates", False)


def summarize(low, frame: Frame, op: t.Summarize) -> Frame:
    columns = frame.columns()
    keys = {name: low.value(e, frame, columns) for name, e in op.keys}
    low.ordered_aggregates = any(isinstance(e, t.Call) and e.name in ("make_list", "make_set", "any", "take_any") for _, e in op.aggs)
    try:
        return grouped(low, frame, keys, lambda f, c: {name: aggregate(low, f, e, c) for name, e in op.aggs})
    finally:
        low.ordered_aggregates = False


def distinct(low, frame: Frame, op: t.Distinct) -> Frame:
    columns = frame.columns()
    return grouped(low, frame, {n: columns.get(n, V.null("string")) for n in op.names}, lambda f, c: {})


def count(low, frame: Frame, op: t.Count, empty: bool = False) -> Frame:
    return grouped(low, frame, {}, lambda f, c: {"Count": Val(F.count(F.lit(1)), "long")}, empty)


#: What getschema calls the kinds of values.
TYPE_NAMES = {"string": "string", "long": "long", "real": "real", "bool": "bool", "datetime": "datetime", "timespan": "timespan", "decimal": "decimal", "dynamic": "dynamic", "null": "string"}


def getschema(low, frame: Frame, op: t.GetSchema) -> Frame:
    """A row for each column; the type is that of its first value that isn't null, or string."""
    frame = frame.rising() if frame.scope else replace(frame, order=())
    rows = []
    for i, (name, v) in enumerate(frame.columns().items()):
        if v.variant:
            shape = V.shape(v.col)
            kind = F.when(shape.rlike("INT$"), "long").when(V.is_number(v.col), "real").when(shape == "BOOLEAN", "bool").when(shape.rlike("^(ARRAY|OBJECT)"), "dynamic").otherwise("string")
            kind = F.when(v.col.isNotNull(), kind)
            kind = F.min_by(kind, F.when(v.col.isNotNull(), frame.place())) if frame.order else F.any_value(kind, True)
        else:
            kind = F.when(F.count(v.col) > 0, TYPE_NAMES[v.kind])
        rows.append(F.struct(F.lit(name).alias("n"), F.lit(i).cast("long").alias("i"), F.coalesce(kind, F.lit("string")).alias("t")))
    listed, row = fresh("rows"), fresh("row")
    if not rows:
        return replace(frame, df=frame.df.where(F.lit(False)))
    many = fresh("many")
    aggs = [F.array(*rows).alias(listed), F.count(F.lit(1)).alias(many), *[F.first(F.col(c)).alias(c) for c in frame.carry]]
    df = frame.df.groupBy(*frame.scope).agg(*aggs).where(F.col(many) > 0)
    df = df.select(*frame.scope, *frame.carry, F.explode(listed).alias(row))
    names = {"ColumnName": ("n", T.StringType()), "ColumnOrdinal": ("i", T.LongType()), "ColumnType": ("t", T.StringType())}
    fields = {k: Field(fresh(), kind) for k, (_, kind) in names.items()}
    df = df.withColumns({fields[k].name: F.col(row)[part] for k, (part, _) in names.items()})
    return Frame(df, fields, frame.scope, ((fields["ColumnOrdinal"].name, False),), frame.carry)


def make_series(low, frame: Frame, op: t.MakeSeries) -> Frame:
    """An array of an aggregate over the bins [a, b) of an axis, one row for each group; ends that aren't given are those of the row-set."""
    context = low.context
    bounds = {k: constant(context, e) if e is not None else (None, "null") for k, e in (("start", op.start), ("stop", op.stop), ("step", op.step))}
    step, step_kind = bounds["step"]
    if not step:
        raise KqlCompileError("make-series needs a step other than zero")
    axis = frame.columns().get(op.axis, V.null())
    dates = axis.kind == "datetime"
    whole = step_kind == "long" and all(k in ("long", "null") for _, k in bounds.values())
    to = (lambda v: F.unix_micros(V.to_datetime(v))) if dates else (lambda v: v.col) if axis.kind == "timespan" else V.to_real
    at, edge = fresh("axis"), F.lit(step).cast("long" if dates or axis.kind == "timespan" else "double")

    def end(name: str) -> Column | None:
        value, kind = bounds[name]
        if value is None:
            return None
        return to(V.literal(value, kind)) if not dates or kind != "datetime" else F.unix_micros(F.lit(value).cast("timestamp")) if not isinstance(value, int) else F.lit(value).cast("long")

    columns = frame.columns()
    keys = {name: low.value(e, frame, columns) for name, e in op.keys}
    frame = frame.with_columns({at: to(axis)})
    low_, high = fresh("low"), fresh("high")
    start, stop = end("start"), end("stop")
    floor = lambda c: F.floor(c / edge) * edge
    if start is None or stop is None:
        if frame.scope:
            over = Window.partitionBy(*frame.scope)
            frame = frame.with_columns({low_: F.min(F.col(at)).over(over), high: F.max(F.col(at)).over(over)})
        else:  # one row of ends, joined to all others
            ends = frame.df.agg(F.min(at).alias(low_), F.max(at).alias(high))
            frame = replace(frame, df=frame.df.join(F.broadcast(ends)))
        start = floor(F.col(low_)) if start is None else start
        stop = floor(F.col(high)) + edge if stop is None else stop
    first, bins, place = fresh("first"), fresh("bins"), fresh("bin")
    frame = frame.with_columns({first: start})
    size = F.ceil((stop - F.col(first)) / edge).cast("long")
    frame = frame.with_columns({bins: F.when(size > BINS, F.raise_error(F.lit(f"a series of over {BINS} bins"))).when(size.isNotNull(), F.greatest(size, F.lit(0).cast("long"))).cast("int")})
    index = F.floor((F.col(at) - F.col(first)) / edge)
    frame = frame.with_columns({place: F.when(index.between(0, F.col(bins) - 1), index).cast("int")})
    frame = frame.where(F.col(bins).isNotNull())
    inner = {**keys, place: Val(F.col(place).cast("long"), "long"), first: Val(F.col(first), "long"), bins: Val(F.col(bins), "long")}
    inner[first] = replace(inner[first], kind="long" if dates or axis.kind == "timespan" else "real")
    binned = grouped(low, frame, inner, lambda f, c: {name: aggregate(low, f, e, c) for name, e, _ in op.aggs})
    values = binned.columns()
    own = {k: values[k] for k in keys}
    there = values[place].col

    def filled(found: Column, many: Column, default: Column) -> Column:
        at = lambda i: F.when(F.map_contains_key(found, i), F.try_element_at(found, i)).otherwise(default)
        return F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), at)

    def series(f: Frame, c: dict[str, Val]) -> dict[str, Val]:
        origin, many = F.first(c[first].col), F.first(c[bins].col).cast("int")
        edges = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: origin + i * edge)
        kind: T.DataType = T.DoubleType()
        if dates:
            edges, kind = F.transform(edges, lambda x: F.timestamp_micros(x)), T.TimestampType()
        elif whole:
            edges, kind = F.transform(edges, lambda x: x.cast("long")), T.LongType()
        cut = lambda items: F.slice(items, F.lit(1), many)
        out = {op.axis: V.array(cut(edges), kind)}
        for name, _, default in op.aggs:
            v = c[name]
            fallback = low.value(default, f, {}) if default is not None else V.literal(0, "long")
            a, b = V.common([v, fallback])
            one = a if a.kind != "null" else b
            entries = F.collect_list(F.when(there.isNotNull(), F.struct(there.cast("int").alias("k"), a.col.alias("v"))))
            found = F.map_from_entries(entries)
            out[name] = V.array(cut(filled(found, many, b.col)), one.native or V.SPARK[one.kind])
        return out

    return grouped(low, binned, own, series)
