"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    """kind: string long real bool timespan null; a timespan's value is in microseconds."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    at: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Member(Expr):
    of: Expr
    key: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Items(Expr):
    items: tuple[Expr, ...]


Named = tuple[str, Expr]


@dataclass(frozen=True)
class Op:
    pass


@dataclass(frozen=True)
class Where(Op):
    test: Expr


@dataclass(frozen=True)
class Extend(Op):
    items: tuple[Named, ...]


@dataclass(frozen=True)
class Project(Op):
    """An item without an expression is a bare column."""

    items: tuple[tuple[str, Expr | None], ...]


@dataclass(frozen=True)
class Arrange(Op):
    """how: away keep reorder."""

    how: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Rename(Op):
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Parse(Op):
    """segments: ("text", s), ("star",) or ("column", name, type or None)."""

    of: Expr
    kind: str
    segments: tuple[tuple, ...]
    only_matching: bool


@dataclass(frozen=True)
class ParseKv(Op):
    of: Expr
    columns: tuple[tuple[str, str], ...]
    options: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class BagUnpack(Op):
    name: str
    prefix: str


@dataclass(frozen=True)
class Lookup(Op):
    table: str
    kind: str
    keys: tuple[tuple[str, str], ...]
    at: tuple[int, int]


@dataclass(frozen=True)
class Join(Op):
    right: str | Body
    kind: str
    keys: tuple[tuple[str, str], ...]
    at: tuple[int, int]


@dataclass(frozen=True)
class Union(Op):
    """operands: table names, bodies, or None for the source."""

    kind: str
    operands: tuple[Any, ...]


@dataclass(frozen=True)
class As(Op):
    name: str


@dataclass(frozen=True)
class Fork(Op):
    branches: tuple[tuple[str | None, tuple[Op, ...]], ...]


@dataclass(frozen=True)
class Case(Op):
    arms: tuple[tuple[Expr, tuple[Op, ...]], ...]
    default: tuple[Op, ...]


@dataclass(frozen=True)
class Partition(Op):
    by: str
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class GetSchema(Op):
    pass


@dataclass(frozen=True)
class Count(Op):
    pass


@dataclass(frozen=True)
class Sample(Op):
    n: int


@dataclass(frozen=True)
class SampleDistinct(Op):
    n: int
    name: str


@dataclass(frozen=True)
class Serialize(Op):
    items: tuple[Named, ...]


@dataclass(frozen=True)
class Expand(Op):
    columns: tuple[tuple[str, Expr | None], ...]
    index: str | None
    limit: int | None


@dataclass(frozen=True)
class Apply(Op):
    columns: tuple[tuple[str, Expr | None], ...]
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class MakeSeries(Op):
    """aggs: (name, call, default or None)."""

    aggs: tuple[tuple[str, Expr, Expr | None], ...]
    axis: str
    start: Expr | None
    stop: Expr | None
    step: Expr
    keys: tuple[Named, ...]


@dataclass(frozen=True)
class Summarize(Op):
    aggs: tuple[Named, ...]
    keys: tuple[Named, ...]


@dataclass(frozen=True)
class Sort(Op):
    """keys: (expression, whether descending); n keeps the first rows."""

    keys: tuple[tuple[Expr, bool], ...]
    n: int | None = None


@dataclass(frozen=True)
class Distinct(Op):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Take(Op):
    n: int


@dataclass(frozen=True)
class DataTable:
    columns: tuple[tuple[str, str], ...]
    values: tuple[Expr, ...]
    at: tuple[int, int]


@dataclass(frozen=True)
class ExternalData:
    columns: tuple[tuple[str, str], ...]
    uris: tuple[str, ...]
    options: tuple[tuple[str, str], ...]
    at: tuple[int, int]


@dataclass(frozen=True)
class Range:
    name: str
    start: Expr
    stop: Expr
    step: Expr
    at: tuple[int, int]


@dataclass(frozen=True)
class Print:
    items: tuple[Named, ...]


@dataclass(frozen=True)
class Body:
    """head: "source", Print, DataTable, ExternalData or Range."""

    head: Any
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class Query:
    lets: tuple[tuple[str, Any], ...]
    body: Body
