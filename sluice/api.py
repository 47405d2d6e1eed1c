"""Compiled queries over DataFrames, streams and single records."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import KqlEvalError, KqlUnsupportedError
from .functions import user_function
from .operators import Lowering
from .operators.lowering import is_row_wise, uses_source_again
from .plans import tree as t
from .plans import values as V
from .plans.expressions import Context, compile_expr
from .plans.frame import Frame, fresh, of_dataframe, shown
from .plans.parser import parse
from .sources import table

Record = dict[str, Any]


@dataclass(frozen=True)
class Options:
    """now: the time that now() tells; strict_types: failing functions end the query; random_seed: for sample and sample-distinct."""

    now: datetime | None = None
    strict_types: bool = False
    random_seed: int | None = None


class Schema:
    """Types that columns of the input are converted to first; what can't be converted is null, columns that aren't there are left out."""

    def __init__(self, columns: Mapping[str, str] | None = None) -> None:
        self.columns = dict(columns or {})

    def spark(self) -> T.StructType:
        """The schema of the converted columns."""
        return T.StructType([T.StructField(k, V.SPARK[V.convert(V.null("string"), kind).kind] if V.KINDS.get(kind) != "timespan" else T.DayTimeIntervalType()) for k, kind in self.columns.items()])


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Query:
    """A query that has been checked and can be applied again and again.

    tables: DataFrames by the names under which `join`, `union` and `lookup` may use them. bag_keys: for a
    column of `bag_unpack`, the keys that it has, so that they need not be looked up in the data."""

    def __init__(self, source: str, schema: Schema | None = None, options: Options | None = None, tables: Mapping[str, DataFrame] | None = None, bag_keys: Mapping[str, Iterable[str]] | None = None) -> None:
        self.source, self.schema, self.options = source, schema, options or Options()
        self.tree = parse(source)
        self.tables = dict(tables or {})
        self.bag_keys = {k: tuple(v) for k, v in (bag_keys or {}).items()}
        self._lets: tuple[SparkSession, dict, dict] | None = None
        spark = session()
        empty = spark.range(0).select(F.lit(0).alias("one")).drop("one")
        self._lowered(empty, "record", None, dry=True)

    # --- DataFrames

    def apply(self, df: DataFrame, scope: str = "record", record_key: str | None = None, ordered: bool = False) -> DataFrame:
        """The rows of the query over `df`.

        scope "record": every row of `df` is a row-set of its own, so aggregates, orders and joins never
        cross records; "table": `df` is one table. record_key: a column that is unique to each record, which spares
        the input being stored where the query reads it more than once. ordered: sorted by record and row."""
        if df.isStreaming and not (scope == "record" and is_row_wise(self.tree)):
            raise KqlUnsupportedError("on a stream only record scope and operators that see one row at a time run as they are; use sluice.streaming.start")
        if scope == "record" and record_key is None and not df.isStreaming and uses_source_again(self.tree):
            df = _checkpointed(df)  # ids must be the same at each reading
        return self._lowered(df, scope, record_key).output(ordered)

    def _lowered(self, df: DataFrame, scope: str, record_key: str | None, dry: bool = False) -> Frame:
        if scope not in ("record", "table"):
            raise ValueError("scope is 'record' or 'table'")
        spark = df.sparkSession
        lets, constants = self._bindings(spark)
        context = Context(spark, self.options, lets)
        frame = of_dataframe(df)
        for name, kind in (self.schema.columns if self.schema else {}).items():
            if name in frame.fields:
                frame = frame.with_values({name: V.convert(frame.fields[name].value(), kind)})
        if scope == "record":
            record = fresh("record")
            if record_key is not None:
                frame = frame.with_columns({record: F.col(frame.fields[record_key].name)})
            else:
                frame = frame.with_columns({record: F.monotonically_increasing_id()}) if not (df.isStreaming) else frame
            frame = replace(frame, scope=() if df.isStreaming else (record,))
        if record_key == ORDINAL:
            frame = replace(frame, fields={k: f for k, f in frame.fields.items() if k != ORDINAL})
        low = Lowering(context, frame, constants, self.bag_keys, dry)
        return low.body(self.tree.body)

    def _bindings(self, spark: SparkSession) -> tuple[dict, dict]:
        """Scalar lets in turn, then tables."""
        if self._lets and self._lets[0] is spark:
            return self._lets[1:]
        context = Context(spark, self.options)
        for name, e in self.tree.lets:
            if isinstance(e, t.Expr):
                context.lets[name] = compile_expr(context, e, {})
        tables = {name: of_dataframe(df) for name, df in self.tables.items()}
        for name, e in self.tree.lets:
            if not isinstance(e, t.Expr):
                tables[name] = table(context, e)
        self._lets = (spark, context.lets, tables)
        return self._lets[1:]

    # --- records

    def transform_many(self, records: Iterable[Record]) -> list[Record]:
        """The rows of several records, in their order, by one Spark job."""
        rows = list(records)
        if not rows:
            return []
        df = records_frame(session(), rows)
        frame = self._lowered(df, "record", ORDINAL)
        ordered = frame.df.orderBy(*[F.col(c) for c in frame.scope], *frame.sorting())
        try:
            got = ordered.select(*[_portable(f.value(), shown(f)).alias(f"c{i}") for i, f in enumerate(frame.fields.values())]).collect()
        except Exception as e:
            if "PythonException" in type(e).__name__ or "a series of over" in str(e):
                raise KqlEvalError(str(e)) from e
            raise
        return [{k: _plain(x) for k, x in zip(frame.fields, row, strict=True)} for row in got]

    def transform(self, record: Record) -> list[Record]:
        """The rows of one record."""
        return self.transform_many([record])

    def match(self, record: Record) -> Record | None:
        """The one row of a record, or None."""
        rows = self.transform(record)
        if len(rows) > 1:
            raise KqlEvalError(f"{len(rows)} rows where one is expected")
        return rows[0] if rows else None

    def stream(self, records: Iterable[Record], batch: int = 1) -> Iterator[Record]:
        """The rows of each record, as records come; `batch` of them go through Spark at a time."""
        held: list[Record] = []
        for record in records:
            held.append(record)
            if len(held) >= batch:
                yield from self.transform_many(held)
                held = []
        yield from self.transform_many(held)


def compile(source: str, schema: Schema | None = None, options: Options | None = None, tables: Mapping[str, DataFrame] | None = None, bag_keys: Mapping[str, Iterable[str]] | None = None) -> Query:  # noqa: A001
    """Checks a query once and returns it, ready to be applied."""
    return Query(source, schema, options, tables, bag_keys)


class Node:
    """Standing queries over one input."""

    def __init__(self, options: Options | None = None) -> None:
        self._options = options
        self.queries: dict[str, Query] = {}

    def add(self, name: str, source: str, schema: Schema | None = None, tables: Mapping[str, DataFrame] | None = None) -> None:
        """Adds a query, in the place of any other of that name."""
        self.queries[name] = compile(source, schema, self._options, tables)

    def remove(self, name: str) -> None:
        self.queries.pop(name, None)

    def push(self, record: Record) -> Iterator[tuple[str, Record]]:
        """(name, row) of each query over one record, in the order in which they were added."""
        for name, query in list(self.queries.items()):
            for row in query.transform(record):
                yield name, row

    def apply(self, df: DataFrame, scope: str = "record", record_key: str | None = None) -> dict[str, DataFrame]:
        """The rows of each query over one DataFrame."""
        return {name: query.apply(df, scope, record_key) for name, query in self.queries.items()}


def function(name: str, returns: str = "dynamic"):
    """Registers a Python function for queries that are compiled later."""
    return user_function(name, returns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only on one machine, if there is none, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="sluice-"))
    return context.getCheckpointDir()


def _checkpointed(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder, which no lost executor takes with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# --- records to columns and back

ORDINAL = "__ordinal"


def _kind(values: list[Any]) -> str:
    """The kind of a column of Python values; dynamic if they are of several."""
    kinds = set()
    for v in values:
        if v is None:
            continue
        kinds.add("bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "real" if isinstance(v, float) else "string" if isinstance(v, str) else "decimal" if isinstance(v, Decimal) else "datetime" if isinstance(v, (datetime, date)) else "timespan" if isinstance(v, timedelta) else "dynamic")
    if not kinds:
        return "null"
    if kinds == {"long", "real"}:
        return "real"
    if "long" in kinds and any(isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 1 << 63 for v in values):
        return "dynamic"
    return kinds.pop() if len(kinds) == 1 else "dynamic"


def records_frame(spark: SparkSession, records: list[Record]) -> DataFrame:
    """A DataFrame of records; lists, dicts and columns of mixed kinds are VARIANT."""
    names = list(dict.fromkeys(k for r in records for k in r))
    kinds = {n: _kind([r.get(n) for r in records]) for n in names}
    types = {"dynamic": T.StringType(), "null": T.StringType(), "timespan": T.DayTimeIntervalType(), "decimal": V.DECIMAL}

    def cell(v: Any, kind: str) -> Any:
        if v is None:
            return None
        if kind == "dynamic":
            return json.dumps(v, default=str)
        if kind == "datetime":
            v = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
            return v if v.tzinfo else v.replace(tzinfo=timezone.utc)
        return float(v) if kind == "real" else v

    schema = T.StructType([T.StructField(ORDINAL, T.LongType()), *(T.StructField(f"f{i}", types.get(kinds[n], V.SPARK.get(kinds[n]))) for i, n in enumerate(names))])
    df = spark.createDataFrame([(i, *(cell(r.get(n), kinds[n]) for n in names)) for i, r in enumerate(records)], schema)
    columns = [F.parse_json(f"f{i}") if kinds[n] == "dynamic" else F.col(f"f{i}") for i, n in enumerate(names)]
    return df.select(F.col(ORDINAL), *columns).toDF(ORDINAL, *names)


def _portable(v: V.Val, col: Column) -> Column:
    """JSON text for dynamic values, else the column."""
    return F.concat(F.lit("\0"), V.canonical(v)) if v.kind == "dynamic" else col


def _plain(x: Any) -> Any:
    if isinstance(x, str) and x.startswith("\0"):
        return json.loads(x[1:])
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x
    return x.asDict(True) if isinstance(x, Row) else x


__all__ = ["Node", "Options", "Query", "Schema", "compile", "function"]
