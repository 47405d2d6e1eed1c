"""From a syntax tree to a frame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import functions as F

from ..plans import tree as t
from ..plans.expressions import Context, compile_expr
from ..plans.frame import Frame, fresh
from ..plans.values import Val
from ..sources import table
from . import aggregation, expansion, joins, ordering, rows

OPERATORS = {
    t.Where: rows.where, t.Extend: rows.extend, t.Project: rows.project, t.Arrange: rows.arrange, t.Rename: rows.rename, t.Parse: rows.parse, t.ParseKv: rows.parse_kv, t.BagUnpack: rows.bag_unpack,
    t.Lookup: joins.lookup, t.Join: joins.join, t.Union: joins.union, t.As: joins.as_, t.Fork: joins.fork, t.Case: joins.case, t.Partition: joins.partition,
    t.Summarize: aggregation.summarize, t.Distinct: aggregation.distinct, t.Count: aggregation.count, t.GetSchema: aggregation.getschema, t.MakeSeries: aggregation.make_series,
    t.Sort: ordering.sort, t.Take: ordering.take, t.Sample: ordering.sample, t.SampleDistinct: ordering.sample_distinct, t.Serialize: ordering.serialize,
    t.Expand: expansion.expand, t.Apply: expansion.apply,
}
#: Operators that keep no more than a row at a time and so run on a stream as they are.
ROW_OPERATORS = (t.Where, t.Extend, t.Project, t.Arrange, t.Rename, t.Parse, t.ParseKv, t.BagUnpack, t.Expand, t.Lookup)
#: Of these, those that make no row of nothing and not more than one of one.
SINGLE = tuple(x for x in ROW_OPERATORS if x is not t.Expand)


class Lowering:
    """Lowers one query. origin: what `source` stands for; tables: constant ones by name; named: rows kept by `as` and `fork`.

    dry: the query is only checked, against no data."""

    def __init__(self, context: Context, origin: Frame | None, tables: Mapping[str, Frame], bag_keys: Mapping[str, tuple[str, ...]] | None = None, dry: bool = False) -> None:
        self.context, self.origin, self.tables, self.bag_keys, self.dry = context, origin, dict(tables), dict(bag_keys or {}), dry
        self.named: dict[str, Frame] = {}

    def value(self, e: t.Expr, frame: Frame | None, columns: Mapping[str, Val] | None = None) -> Val:
        return compile_expr(self.context, e, frame.columns() if columns is None else columns)

    def table(self, name: str) -> Frame | None:
        return self.tables.get(name)

    def inner(self) -> Lowering:
        """For the steps inside another operator: names kept outside aren't seen, nor the other way round."""
        return Lowering(self.context, self.origin, self.tables, self.bag_keys, self.dry)

    def steps(self, frame: Frame, ops: tuple[t.Op, ...]) -> Frame:
        single = frame is self.origin and bool(frame.scope)  # whether each row is a row-set of its own
        for i, op in enumerate(ops):
            after = ops[i + 1] if i + 1 < len(ops) else None
            if single and isinstance(op, t.Expand) and isinstance(after, t.Summarize) and (made := expansion.expand_summarized(self, frame, op, after)) is not None:
                return self.steps(made, ops[i + 2 :])
            single = single and isinstance(op, SINGLE)
            frame = OPERATORS[type(op)](self, frame, op)
        return frame

    def body(self, body: t.Body) -> Frame:
        """A query or one inside it, with names of its own."""
        low = self.inner()
        frame, ops = low.head(body)
        return low.steps(frame, ops)

    def head(self, body: t.Body) -> tuple[Frame, tuple[t.Op, ...]]:
        if body.head == "source":
            return self.origin, body.ops
        if isinstance(body.head, t.Print):
            frame = Frame(self.context.spark.range(1).select(F.lit(0).alias(fresh("one"))), {}, small=True)
            columns: dict[str, Val] = {}
            frame = frame.with_values({name: self.value(e, None, columns) for name, e in body.head.items})
        else:
            frame = table(self.context, body.head)
        # The first row of a constant head is what `source` stands for inside it.
        first = body.ops[:1]
        frame = self.for_each_record(frame)
        self.origin = replace(frame, df=ordering.first_rows(frame, 1).df) if any(_mentions_source(op) for op in body.ops) else self.origin
        if first and isinstance(first[0], t.Count):
            return self._counted(frame), body.ops[1:]
        return frame, body.ops

    def for_each_record(self, frame: Frame) -> Frame:
        """A constant table once for each record, in record scope."""
        if self.origin is None or not self.origin.scope:
            return frame
        return joins.over_scopes(self.origin, frame.renamed(), single=True)

    def _counted(self, frame: Frame) -> Frame:
        """The count of a constant head, which is 0 and not nothing if it is empty."""
        if not frame.scope:
            return aggregation.count(self, frame, t.Count(), empty=True)
        records = replace(self.origin, fields={}, order=())
        name = fresh("s")
        found = aggregation.count(self, frame, t.Count())
        counts = found.df.select(F.col(found.scope[0]).alias(name), F.col(found.fields["Count"].name))
        df = records.df.select(*records.scope).distinct().join(counts, F.col(records.scope[0]) == F.col(name), "left")
        whole = Frame(df, {}, records.scope)
        return whole.with_values({"Count": Val(F.coalesce(F.col(found.fields["Count"].name), F.lit(0).cast("long")), "long")})


def _mentions_source(op: t.Op) -> bool:
    return isinstance(op, t.Union) and (None in op.operands or any(isinstance(x, t.Body) and x.head == "source" for x in op.operands)) or isinstance(op, t.Join) and isinstance(op.right, t.Body) and op.right.head == "source"


def uses_source_again(query: t.Query) -> bool:
    """Whether the input is read more than once: by a subquery, or by a name for rows of it."""

    def inside(ops) -> bool:
        for op in ops:
            if _mentions_source(op) or isinstance(op, (t.As, t.Fork, t.Case)):
                return True
            if isinstance(op, (t.Partition, t.Apply)) and inside(op.ops):
                return True
            if isinstance(op, (t.Join, t.Union)):
                return True
        return False

    return inside(query.body.ops) or query.body.head != "source"


def is_row_wise(query: t.Query) -> bool:
    """Whether a query keeps no more than one row at a time."""
    return query.body.head == "source" and all(isinstance(op, ROW_OPERATORS) for op in query.body.ops)
