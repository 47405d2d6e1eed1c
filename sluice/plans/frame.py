"""Tables while a query is lowered: a DataFrame with columns of our own naming, the visible names, a scope and an order.

Spark compares column names without case and allows each once; queries do neither. So every column gets a fresh name in the
DataFrame, and `fields` maps what a query calls it. The scope lists the columns that bound a row-set: in record scope the
record's id, with `partition` and `mv-apply` a column more; in table scope none. Grouping, windows and joins add the
scope to their keys. The order of rows is a list of columns too; nothing is sorted before an operator needs it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .values import Val

_numbers = itertools.count()


def fresh(hint: str = "c") -> str:
    return f"{hint}_{next(_numbers)}"


@dataclass(frozen=True)
class Field:
    """A column of a frame. span: it holds a timespan, in microseconds."""

    name: str
    type: T.DataType
    span: bool = False

    def value(self) -> Val:
        return Val(F.col(self.name), "timespan") if self.span else V.of_column(F.col(self.name), self.type)


@dataclass(frozen=True)
class Frame:
    """carry: columns that are the same all over a row-set and outlive grouping. small: the rows are few and constant."""

    df: DataFrame
    fields: Mapping[str, Field]
    scope: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    carry: tuple[str, ...] = ()
    small: bool = False

    def columns(self) -> dict[str, Val]:
        return {k: f.value() for k, f in self.fields.items()}

    def hidden(self) -> list[str]:
        return [*self.scope, *(c for c, _ in self.order), *self.carry]

    def kept(self) -> DataFrame:
        """The DataFrame with nothing but what the frame knows."""
        return self.df.select(*dict.fromkeys([*self.hidden(), *(f.name for f in self.fields.values())]))

    def where(self, test: Column) -> Frame:
        return replace(self, df=self.df.where(test))

    def with_values(self, values: Mapping[str, Val]) -> Frame:
        """Adds or replaces visible columns; a column that is replaced keeps its place."""
        fields, added = dict(self.fields), {}
        for name, v in values.items():
            f = field_of(v)
            fields[name] = f
            added[f.name] = v.col
        return replace(self, df=self.df.withColumns(added) if added else self.df, fields=fields)

    def with_columns(self, columns: Mapping[str, Column]) -> Frame:
        return replace(self, df=self.df.withColumns(dict(columns))) if columns else self

    def sorting(self) -> list[Column]:
        return [F.col(c).desc() if down else F.col(c).asc() for c, down in self.order]

    def window(self, *more: str) -> WindowSpec:
        """Over a row-set, in order."""
        by = [*self.scope, *more]
        return Window.partitionBy(*by).orderBy(*(self.sorting() or [F.lit(0)]))

    def rising(self) -> Frame:
        """The same order by ascending columns only, which a struct of them can stand for."""
        if not any(down for _, down in self.order):
            return self
        place = fresh("place")
        return replace(self.with_columns({place: F.row_number().over(self.window())}), order=((place, False),))

    def place(self) -> Column:
        """One comparable value of the order; only of a rising frame."""
        return F.struct(*[F.col(c) for c, _ in self.order])

    def renamed(self) -> Frame:
        """The frame with fresh names for all its columns, to be joined to another."""
        used = list(dict.fromkeys([*self.hidden(), *(f.name for f in self.fields.values())]))
        names = {c: fresh("r") for c in used}
        df = self.df.select(*[F.col(c).alias(n) for c, n in names.items()])
        fields = {k: replace(f, name=names[f.name]) for k, f in self.fields.items()}
        return replace(self, df=df, fields=fields, scope=tuple(names[c] for c in self.scope), order=tuple((names[c], d) for c, d in self.order), carry=tuple(names[c] for c in self.carry))

    def output(self, ordered: bool = False) -> DataFrame:
        """The visible columns by their own names."""
        df = self.df.orderBy(*[F.col(c) for c in self.scope], *self.sorting()) if ordered and (self.scope or self.order) else self.df
        return df.select(*[shown(f).alias(k) for k, f in self.fields.items()])


def shown(f: Field) -> Column:
    if not f.span:
        return F.col(f.name)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(f.name) / F.lit(1_000_000)).cast("decimal(18,6)"))


def field_of(v: Val, name: str | None = None) -> Field:
    return Field(name or fresh(), v.native or V.SPARK[v.kind], v.kind == "timespan")


def of_dataframe(df: DataFrame, extra: Iterable[Column] = ()) -> Frame:
    """A frame of a DataFrame's columns; `extra` are kept under the names that they have."""
    fields = {}
    picked = []
    for i, f in enumerate(df.schema.fields):
        name = fresh()
        fields[f.name] = Field(name, f.dataType)
        picked.append((i, name))
    plain = df.toDF(*[n for _, n in picked])
    return Frame(plain.select("*", *extra) if extra else plain, fields)
