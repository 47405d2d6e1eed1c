"""Arrays, sets and bags."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from ..plans.values import Val, array, as_variant, bag, canonical, elements, equal, joined, null, of_column, plain, text, to_long, to_text
from .registry import batched, json_of, register

VARIANT = T.VariantType()
SIMPLE = (T.StringType, T.NumericType, T.BooleanType, T.TimestampType, T.DateType, T.TimestampNTZType)


def simple(v: Val) -> bool:
    """Whether a value is an array of Spark's own scalars, which Spark can compare."""
    return v.array and isinstance(v.native.elementType, SIMPLE)


def as_json(v: Val) -> Column | None:
    """The elements as JSON text, by which dynamic elements are compared."""
    found = elements(v)
    if found is None:
        return None
    return F.transform(found[0], lambda x: F.coalesce(canonical(Val(as_variant(of_column(x, found[1])), "dynamic")), F.lit("null")))


def of_json(col: Column) -> Val:
    return array(F.transform(col, lambda x: plain(F.parse_json(x))), VARIANT)


def alike(parts: tuple[Val, ...]) -> bool:
    return all(simple(p) for p in parts) and len({str(p.native) for p in parts}) == 1


@register("pack")
def pack(context, *args: Val) -> Val:
    pairs = [F.struct(text(k).alias("k"), as_variant(v).alias("v")) for k, v in zip(args[::2], args[1::2], strict=False)]
    if not pairs:
        return Val(F.parse_json(F.lit("{}")), "dynamic")
    listed = F.array(*pairs)
    # The last of equal keys counts.
    kept = F.filter(listed, lambda x, i: ~F.exists(F.slice(listed, i + 2, len(pairs)), lambda y: y["k"] == x["k"])) if len(pairs) > 1 else listed
    return Val(F.to_variant_object(F.map_from_entries(kept)), "dynamic")


@register("pack_array")
def pack_array(context, *args: Val) -> Val:
    if not args:
        return array(F.array().cast("array<variant>"), VARIANT)
    kinds = {a.kind for a in args}
    if len(kinds) == 1 and args[0].kind not in ("dynamic", "null", "timespan"):
        return array(F.array(*[a.col for a in args]), V.SPARK[args[0].kind])
    return array(F.array(*[as_variant(a) for a in args]), VARIANT)


@register("array_length")
def array_length(context, v: Val) -> Val:
    if v.kind == "string":
        return Val(F.char_length(v.col).cast("long"), "long")
    found = elements(v)
    if found is None:
        return null("long")
    n = F.when(found[0].isNotNull(), F.size(found[0]))
    return Val((F.coalesce(n, F.char_length(V.text_of(v.col))) if v.variant else n).cast("long"), "long")


@register("array_concat")
def array_concat(context, *args: Val) -> Val:
    return joined(list(args))


@register("array_index_of")
def array_index_of(context, items: Val, x: Val) -> Val:
    found = elements(items)
    if found is None:
        return null("long")
    places = F.transform(found[0], lambda e, i: F.when(equal(of_column(e, found[1]), x), i))
    return Val(F.when(found[0].isNotNull(), F.coalesce(F.get(F.filter(places, lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))).cast("long"), "long")


def _sliced(items: Column, start: Column, stop: Column) -> Column:
    """Python's items[start:stop]."""
    n = F.size(items)
    a = F.greatest(F.lit(0), F.least(n, F.when(start < 0, start + n).otherwise(start)))
    b = F.greatest(F.lit(0), F.least(n, F.when(stop < 0, stop + n).otherwise(stop)))
    return F.slice(items, a + 1, F.greatest(F.lit(0), b - a))


@register("array_slice")
def array_slice(context, items: Val, start: Val, end: Val) -> Val:
    found = elements(items)
    if found is None:
        return null("dynamic")
    return array(_sliced(found[0], to_long(start).cast("int"), to_long(end).cast("int") + 1), found[1])


@register("array_split")
def array_split(context, items: Val, at: Val) -> Val:
    found = elements(items)
    if found is None:
        return null("dynamic")
    places = elements(at)
    cuts = F.transform(places[0], lambda x: to_long(of_column(x, places[1])).cast("int")) if places and at.kind == "dynamic" else F.array(to_long(at).cast("int"))
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(found[0])))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: _sliced(found[0], F.element_at(edges, i), F.element_at(edges, i + 1)))
    return array(parts, T.ArrayType(found[1]))


def _sorted(items: Val) -> Val:
    """Nulls last; numbers by size, mixed kinds by text."""
    if simple(items):
        return Val(F.array_sort(items.col), "dynamic", items.native)
    found = elements(items)
    if found is None:
        return null("dynamic")
    values = F.transform(found[0], lambda x: as_variant(of_column(x, found[1])))
    numbers = F.forall(values, lambda x: x.isNull() | V.is_number(x))
    keyed = F.transform(values, lambda x: F.struct(x.isNull().alias("n"), F.when(numbers, V.number_of(x)).alias("d"), F.when(~numbers, to_text(Val(x, "dynamic"))).alias("s"), F.coalesce(F.to_json(x), F.lit("null")).alias("j")))
    return of_json(F.transform(F.array_sort(keyed), lambda s: s["j"]))


@register("array_sort_asc")
def array_sort_asc(context, items: Val) -> Val:
    return _sorted(items)


@register("array_sort_desc")
def array_sort_desc(context, items: Val) -> Val:
    out = _sorted(items)
    return out if out.native is None else Val(F.reverse(out.col), "dynamic", out.native)


@register("array_reverse")
def array_reverse(context, items: Val) -> Val:
    found = elements(items)
    return null("dynamic") if found is None else array(F.reverse(found[0]), found[1])


@register("array_sum")
def array_sum(context, items: Val) -> Val:
    found = elements(items)
    if found is None:
        return null("long")
    element = of_column(F.lit(None).cast(found[1]), found[1])
    if element.kind == "long":
        return Val(F.aggregate(found[0], F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0))), "long")
    if element.kind in ("real", "decimal"):
        return Val(F.aggregate(found[0], F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), "real")
    if not element.variant:
        return Val(F.when(found[0].isNotNull(), F.lit(0).cast("long")), "long")
    whole = F.forall(found[0], lambda x: ~V.is_number(x) | V.shape(x).rlike("INT$") | x.isNull())
    longs = F.aggregate(found[0], F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.when(V.is_number(x), F.try_variant_get(x, "$", "long")), F.lit(0)))
    reals = F.aggregate(found[0], F.lit(0.0), lambda a, x: a + F.coalesce(V.number_of(x), F.lit(0.0)))
    return Val(F.when(found[0].isNotNull(), F.when(whole, longs.cast("variant")).otherwise(reals.cast("variant"))), "dynamic")


def _rotated(items: Val, by: Column) -> Val:
    found = elements(items)
    if found is None:
        return null("dynamic")
    n = F.size(found[0])
    k = F.pmod(by, F.greatest(n, F.lit(1)))
    return array(F.when(n > 0, F.concat(F.slice(found[0], k + 1, n), F.slice(found[0], F.lit(1), k))).otherwise(found[0]), found[1])


@register("array_rotate_left")
def array_rotate_left(context, items: Val, n: Val) -> Val:
    return _rotated(items, to_long(n).cast("int"))


@register("array_rotate_right")
def array_rotate_right(context, items: Val, n: Val) -> Val:
    return _rotated(items, -to_long(n).cast("int"))


@register("bag_keys")
def bag_keys(context, v: Val) -> Val:
    if isinstance(v.native, T.StructType):
        return array(F.when(v.col.isNotNull(), F.array(*[F.lit(n) for n in v.native.names])), T.StringType())
    found = bag(v)
    return null("dynamic") if found is None else array(F.map_keys(found), T.StringType())


def _empty() -> Column:
    return F.create_map().cast("map<string,variant>")


def _not_in(found: Column, known: Column) -> Column:
    return F.map_filter(F.coalesce(found, _empty()), lambda k, _: ~F.array_contains(known, k))


@register("bag_merge")
def bag_merge(context, *bags: Val) -> Val:
    merged = _empty()
    for b in bags:
        if (found := bag(b)) is not None:
            merged = F.map_concat(merged, _not_in(found, F.map_keys(merged)))
    return Val(F.to_variant_object(merged), "dynamic")


@register("bag_remove_keys")
def bag_remove_keys(context, v: Val, keys: Val) -> Val:
    found, gone = bag(v), elements(keys)
    if found is None or gone is None:
        return v
    names = F.coalesce(F.transform(gone[0], lambda x: text(of_column(x, gone[1]))), F.array().cast("array<string>"))
    kept = F.to_variant_object(F.map_filter(found, lambda k, _: ~F.array_contains(names, k)))
    return Val(F.when(found.isNotNull(), kept).otherwise(as_variant(v)), "dynamic")


@register("set_union")
def set_union(context, *parts: Val) -> Val:
    if alike(parts):
        none = F.array().cast(parts[0].native)
        return Val(F.array_distinct(F.concat(*[F.coalesce(p.col, none) for p in parts])), "dynamic", parts[0].native)
    lists = [F.coalesce(x, F.array().cast("array<string>")) for p in parts if (x := as_json(p)) is not None]
    return of_json(F.array_distinct(F.concat(*lists))) if lists else array(F.array().cast("array<variant>"), VARIANT)


@register("set_intersect")
def set_intersect(context, first: Val, *rest: Val) -> Val:
    parts = (first, *rest)
    own = as_json(first)
    if own is None:
        return null("dynamic")
    if alike(parts):
        out = F.array_distinct(first.col)
        for r in rest:
            out = F.when(r.col.isNotNull(), F.array_intersect(out, r.col)).otherwise(out)
        return Val(out, "dynamic", first.native)
    out = F.array_distinct(own)
    for r in rest:
        if (other := as_json(r)) is not None:
            out = F.when(other.isNotNull(), F.array_intersect(out, other)).otherwise(out)
    return of_json(out)


@register("set_difference")
def set_difference(context, first: Val, *rest: Val) -> Val:
    parts = (first, *rest)
    own = as_json(first)
    if own is None:
        return null("dynamic")
    if alike(parts):
        out = F.array_distinct(first.col)
        for r in rest:
            out = F.array_except(out, F.coalesce(r.col, F.array().cast(r.native)))
        return Val(out, "dynamic", first.native)
    out = F.array_distinct(own)
    for r in rest:
        if (other := as_json(r)) is not None:
            out = F.array_except(out, F.coalesce(other, F.array().cast("array<string>")))
    return of_json(out)


def _element(node: ElementTree.Element):
    """Attributes as @name, children by name (a list if a name repeats), text beside them as #text; a leaf is its text, or null if empty."""
    out: dict = {f"@{k}": v for k, v in node.attrib.items()}
    for child in node:
        value = _element(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    content = (node.text or "").strip()
    if not out:
        return content or None
    return out | {"#text": content} if content else out


def _xml(s: str) -> str:
    root = ElementTree.fromstring(s)
    return json.dumps({root.tag: _element(root)})


@register("parse_xml")
def parse_xml(context, v: Val) -> Val:
    if v.kind == "dynamic" and not v.variant:
        return v
    return json_of(batched(_xml, "string")(to_text(v)))
