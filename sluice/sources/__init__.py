"""Tables that a query states itself: datatable, externaldata and range."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KqlCompileError, KqlUnsupportedError
from ..plans import tree as t
from ..plans import values as V
from ..plans.expressions import Context, compile_expr
from ..plans.frame import Field, Frame, field_of, fresh

#: No range has more rows.
RANGE_ROWS = 10_000_000
DELIMITERS = {"csv": ",", "tsv": "\t", "scsv": ";", "psv": "|"}
LINES = ("txt", "raw")
JSON_LINES = ("multijson", "jsonl", "json-lines")


def table(context: Context, node: t.DataTable | t.ExternalData | t.Range) -> Frame:
    """A constant table as a frame in the order of its rows."""
    if isinstance(node, t.DataTable):
        return _datatable(context, node)
    return _range(context, node) if isinstance(node, t.Range) else _external(context, node)


def _datatable(context: Context, node: t.DataTable) -> Frame:
    width = len(node.columns)
    if len(node.values) % width:
        raise KqlCompileError(f"{len(node.values)} values don't fill rows of {width} columns", *node.at)
    place = fresh("row")
    fields = {name: field_of(V.convert(V.null("string"), kind)) for name, kind in node.columns}
    rows = []
    for at in range(0, len(node.values), width):
        values = [V.convert(compile_expr(context, e, {}), kind) for e, (_, kind) in zip(node.values[at : at + width], node.columns, strict=True)]
        cells = [v.col.cast(f.type).alias(f.name) for v, f in zip(values, fields.values(), strict=True)]
        rows.append(F.struct(F.lit(at // width).alias(place), *cells))
    schema = T.StructType([T.StructField(place, T.IntegerType()), *(T.StructField(f.name, f.type) for f in fields.values())])
    if not rows:
        return Frame(context.spark.createDataFrame([], schema), fields, order=((place, False),), small=True)
    df = context.spark.range(1).select(F.inline(F.array(*rows)))
    return Frame(df, fields, order=((place, False),), small=True)


def constant(context: Context, e: t.Expr):
    """(value, kind) of a constant expression, worked out by Spark."""
    v = compile_expr(context, e, {})
    if v.constant:
        return v.lit, v.kind
    got = context.spark.range(1).select(v.col.cast("string") if v.kind == "decimal" else F.unix_micros(v.col) if v.kind == "datetime" else v.col).first()[0]
    return got, v.kind


def _range(context: Context, node: t.Range) -> Frame:
    (start, kind), (stop, stop_kind), (step, step_kind) = (constant(context, e) for e in (node.start, node.stop, node.step))
    if start is None or stop is None or not step:
        raise KqlCompileError("a range needs two ends and a step other than zero", *node.at)
    dates = kind == stop_kind == "datetime" and step_kind == "timespan"
    spans = kind == stop_kind == step_kind == "timespan"
    if not dates and not spans and not all(k in V.NUMERIC for k in (kind, stop_kind, step_kind)):
        raise KqlCompileError("a range goes over numbers, or over dates by a timespan", *node.at)
    n = max(0, int((stop - start) // step) + 1)
    if n > RANGE_ROWS:
        raise KqlCompileError(f"a range of {n} rows is over {RANGE_ROWS}", *node.at)
    index = fresh("row")
    at = F.col(index) * F.lit(step) + F.lit(start)
    real = "real" in (kind, step_kind)
    value = V.Val(F.timestamp_micros(at), "datetime") if dates else V.Val(at.cast("long"), "timespan") if spans else V.Val(at.cast("double" if real else "long"), "real" if real else "long")
    f = field_of(value)
    df = context.spark.range(n).withColumnRenamed("id", index).withColumn(f.name, value.col)
    return Frame(df, {node.name: f}, order=((index, False),), small=n <= 10_000)


def _external(context: Context, node: t.ExternalData) -> Frame:
    kind = dict(node.options).get("format", "csv").lower()
    known = (*DELIMITERS, *LINES, "json", *JSON_LINES)
    if kind not in known:
        raise KqlUnsupportedError(f"externaldata doesn't read the format {kind!r}", *node.at)
    paths = []
    for uri in node.uris:
        path = uri.removeprefix("file://")
        if "://" in path:
            raise KqlUnsupportedError(f"externaldata reads local files only, not {uri!r}", *node.at)
        if not os.path.exists(path):
            raise KqlCompileError(f"there is no file {path!r}", *node.at)
        paths.append(f"file://{os.path.abspath(path)}")
    place, out = fresh("row"), None
    for i, path in enumerate(paths):
        part = _read(context, path, kind, [name for name, _ in node.columns]).select(F.lit(i).alias("file"), "*")
        out = part if out is None else out.unionByName(part)
    fields: dict[str, Field] = {}
    picked = [F.struct("file", F.monotonically_increasing_id()).alias(place)]
    for name, declared in node.columns:
        source = out.schema[name].dataType
        v = V.convert(V.of_column(F.col(f"`{name}`"), source), declared)
        fields[name] = field_of(v)
        picked.append(v.col.alias(fields[name].name))
    return Frame(out.select(*picked), fields, order=((place, False),))


def _read(context: Context, path: str, kind: str, names: list[str]):
    spark = context.spark
    if kind in LINES:
        lines = spark.read.text(path).where(F.length(F.regexp_replace("value", r"\r$", "")) > 0)
        return lines.select(F.regexp_replace("value", r"\r$", "").alias(names[0]), *[F.lit(None).cast("string").alias(n) for n in names[1:]])
    if kind in DELIMITERS:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.schema(schema).option("sep", DELIMITERS[kind]).option("header", False).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    if kind == "json":
        whole = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
        rows = whole.select(F.explode(F.coalesce(F.col("v").try_cast("array<variant>"), F.array("v"))).alias("v"))
    else:
        rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("v"))
    return rows.select(*[V.plain(F.try_variant_get("v", V.path(n), "variant")).alias(n) for n in names])
