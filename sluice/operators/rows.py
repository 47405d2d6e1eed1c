"""Operators that see one row at a time: filters, projections, parsing."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KqlEvalError
from ..plans import tree as t
from ..plans import values as V
from ..plans.frame import Frame, field_of
from ..plans.values import Val

#: Keys that are looked up in bags at most: each becomes a column.
KEYS = 10_000

def where(low, frame: Frame, op: t.Where) -> Frame:
    return frame.where(V.truth(low.value(op.test, frame)))


def extend(low, frame: Frame, op: t.Extend) -> Frame:
    for name, e in op.items:
        if isinstance(e, t.Col) and e.name in frame.fields:
            frame = replace(frame, fields={**frame.fields, name: frame.fields[e.name]})
        else:
            frame = frame.with_values({name: low.value(e, frame)})
    return frame


def project(low, frame: Frame, op: t.Project) -> Frame:
    """Every expression sees the columns as they came in; a bare name that is no column is null, even if a let has that name."""
    columns, fields, made = frame.columns(), {}, {}
    for name, e in op.items:
        source = name if e is None else e.name if isinstance(e, t.Col) else None
        if source in frame.fields:
            fields[name] = frame.fields[source]
        else:
            v = V.null("string") if e is None else low.value(e, frame, columns)
            fields[name] = field_of(v)
            made[fields[name].name] = v.col
    return replace(frame.with_columns(made), fields=fields)


def arrange(low, frame: Frame, op: t.Arrange) -> Frame:
    names = op.names
    if op.how == "away":
        order = [n for n in frame.fields if n not in names]
    elif op.how == "keep":
        order = [n for n in frame.fields if n in names]
    else:
        first = [n for n in dict.fromkeys(names) if n in frame.fields]
        order = first + [n for n in frame.fields if n not in first]
    return replace(frame, fields={n: frame.fields[n] for n in order})


def rename(low, frame: Frame, op: t.Rename) -> Frame:
    fields = dict(frame.fields)
    for new, old in op.pairs:
        if old in fields:
            moved = fields.pop(old)
            fields.pop(new, None)
            fields[new] = moved
    return replace(frame, fields=fields)


#: How `parse` reads the text of a column; other types leave it as text.
PARSED = {"int": "long", "long": "long", "real": "real", "double": "real", "decimal": "real", "datetime": "datetime", "date": "datetime", "bool": "bool", "boolean": "bool"}


def _pattern(low, op: t.Parse) -> tuple[str | None, list[tuple[str, str | None, int]]]:
    """The pattern in Java's dialect (None if invalid) and each column's name, type and group."""
    by_regex = op.kind == "regex"
    segments = [s for s in op.segments if by_regex or s[0] != "star"]
    out, columns, group = "", [], 0
    last = max((i for i, s in enumerate(segments) if s[0] == "column"), default=-1)
    for i, segment in enumerate(segments):
        if segment[0] == "text":
            out += segment[1] if by_regex else V.quote(segment[1])
            if by_regex:
                try:
                    group += re.compile(segment[1]).groups
                except re.error:
                    return None, [(s[1], s[2], 0) for s in segments if s[0] == "column"]
        elif segment[0] == "star":
            out += ".*?"
        else:
            group += 1
            columns.append((segment[1], segment[2], group))
            if by_regex:
                out += "(.*)" if i == last else "(.*?)"
            elif i + 1 == len(segments):
                out += "(.*)"
            else:
                out += "(.*?)" if segments[i + 1][0] == "text" else "()"
    if not by_regex:
        return ("(?s)^" if segments and segments[0][0] == "column" else "(?s)") + out, columns
    return V.java_regex(low.context.spark, "(?s)" + out), columns


def parse(low, frame: Frame, op: t.Parse) -> Frame:
    """The pattern may match anywhere. Rows without a match get nulls, or are dropped by parse-where."""
    whole = V.text(low.value(op.of, frame))
    pattern, columns = _pattern(low, op)
    if pattern is None:
        empty = frame.with_values({name: V.convert(V.null("string"), PARSED.get(kind or "", "string")) for name, kind, _ in columns})
        return empty.where(F.lit(False)) if op.only_matching else empty
    hit = whole.rlike(pattern)
    values = {}
    for name, kind, group in columns:
        got = Val(F.when(hit, F.regexp_extract(whole, pattern, group)), "string")
        values[name] = V.convert(got, PARSED[kind]) if kind in PARSED else got
    frame = frame.with_values(values) if values else frame
    return frame.where(hit) if op.only_matching else frame


def parse_kv(low, frame: Frame, op: t.ParseKv) -> Frame:
    """Keys and values are trimmed; of equal keys the last counts; a key that isn't there gives null."""
    options = dict(op.options)
    between, inside, quotes = options.get("pair_delimiter", " "), options.get("kv_delimiter", "="), options.get("quote", "")
    whole = V.text(low.value(op.of, frame))
    pairs = F.filter(F.split(whole, V.quote(between), -1), lambda p: p.contains(inside))

    def cut(p):
        at = F.call_function("locate", F.lit(inside), p)
        value = F.trim(F.substr(p, at + len(inside), F.char_length(p) + 1))
        return F.struct(F.trim(F.substr(p, F.lit(1), at - 1)).alias("k"), (F.btrim(value, F.lit(quotes)) if quotes else value).alias("v"))

    listed = F.transform(pairs, cut)
    last = lambda name: F.try_element_at(F.filter(listed, lambda s: s["k"] == F.lit(name)), F.lit(-1))["v"]
    return frame.with_values({name: V.convert(Val(last(name), "string"), PARSED.get(kind, kind)) for name, kind in op.columns})


def bag_unpack(low, frame: Frame, op: t.BagUnpack) -> Frame:
    """One column for each key that any row's bag has; which keys there are is looked up in the data, unless declared."""
    f = frame.fields.get(op.name)
    if f is None:
        return frame
    rest = replace(frame, fields={k: x for k, x in frame.fields.items() if k != op.name})
    v = f.value()
    if isinstance(v.native, T.StructType):
        members = [(n, Val(F.lit(n), "string", lit=n)) for n in v.native.names]
        return rest.with_values({op.prefix + n: V.member(v, key) for n, key in members})
    found = V.bag(v)
    if found is None:
        return rest
    if op.name in low.bag_keys:
        keys = low.bag_keys[op.name]
    elif low.dry or frame.df.isStreaming:
        keys = ()
    else:
        keys = sorted(r[0] for r in frame.df.select(F.explode(F.map_keys(found)).alias("k")).distinct().limit(KEYS + 1).collect())
        if len(keys) > KEYS:
            raise KqlEvalError(f"the bags of {op.name!r} have over {KEYS} keys; name those that are wanted by bag_keys")
    return rest.with_values({op.prefix + k: V.member(v, V.literal(k, "string")) for k in keys})
