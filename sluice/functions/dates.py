"""Dates and spans of time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import Val, null, text, to_datetime, to_long, to_real
from .registry import register

DAY = 86_400_000_000
#: Microseconds of the parts of a date that have a fixed length.
PARTS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY, "week": 7 * DAY}
ADDED = ("second", "minute", "hour", "day", "week")


def datetime(col: Column) -> Val:
    return Val(col, "datetime")


def _part(name: str, *aliases: str):
    def build(context, d: Val) -> Val:
        return Val(getattr(F, name)(to_datetime(d)).cast("long"), "long")

    register(*aliases)(build)


for _name, _aliases in (("year", ("getyear",)), ("month", ("getmonth", "monthofyear")), ("dayofmonth", ("dayofmonth",)), ("hour", ("hourofday",)), ("dayofyear", ("dayofyear",)), ("weekofyear", ("weekofyear", "week_of_year"))):
    _part(_name, *_aliases)


@register("dayofweek")
def dayofweek(context, d: Val) -> Val:
    return Val((F.dayofweek(to_datetime(d)) - 1).cast("long") * DAY, "timespan")


def _start(unit: str, d: Val) -> Column:
    return F.date_trunc(unit, to_datetime(d))


def _edge(unit: str, months: int) -> None:
    @register(f"startof{unit}")
    def start(context, d: Val) -> Val:
        return datetime(_start(unit, d))

    @register(f"endof{unit}")
    def end(context, d: Val) -> Val:
        first = _start(unit, d)
        after = F.add_months(first, months).cast("timestamp") if months else F.timestamp_micros(F.unix_micros(first) + DAY)
        return datetime(F.timestamp_micros(F.unix_micros(after) - 1))


for _unit, _months in (("day", 0), ("month", 1), ("year", 12)):
    _edge(_unit, _months)


@register("datetime_add")
def datetime_add(context, part: Val, n: Val, d: Val) -> Val:
    at, by = to_datetime(d), to_long(n)
    unit = F.lower(text(part))
    out = F
    for name in ADDED:
        out = out.when(unit == name, F.timestamp_micros(F.unix_micros(at) + by * PARTS[name]))
    months = F.when(unit == "month", by).when(unit == "year", by * 12)
    whole = F.year(at) * 12 + F.month(at) - 1 + months
    year, month = F.floor(whole / 12), F.pmod(whole, F.lit(12)) + 1
    moved = F.try_make_timestamp(years=year.cast("int"), months=month.cast("int"), days=F.dayofmonth(at), hours=F.hour(at), mins=F.minute(at), secs=(F.second(at) + F.pmod(F.unix_micros(at), F.lit(1_000_000)) / F.lit(1_000_000)).cast("decimal(8,6)"))
    return datetime(out.when(year.between(1, 9999), moved))


@register("datetime_diff")
def datetime_diff(context, part: Val, a: Val, b: Val) -> Val:
    x, y, unit = to_datetime(a), to_datetime(b), F.lower(text(part))
    gap = F.unix_micros(x) - F.unix_micros(y)
    out = F
    for name in ADDED:
        out = out.when(unit == name, F.floor(gap.cast("decimal(20,0)") / PARTS[name]))
    years = F.year(x) - F.year(y)
    return Val(out.when(unit == "month", years * 12 + F.month(x) - F.month(y)).when(unit == "year", years).cast("long"), "long")


@register("datetime_part")
def datetime_part(context, part: Val, d: Val) -> Val:
    at, unit = to_datetime(d), F.lower(text(part))
    out = F
    for name, get in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second), ("dayofyear", F.dayofyear), ("weekofyear", F.weekofyear), ("week_of_year", F.weekofyear)):
        out = out.when(unit == name, get(at))
    return Val(out.otherwise(None).cast("long"), "long")


@register("format_datetime")
def format_datetime(context, d: Val, form: Val) -> Val:
    at, out = to_datetime(d), text(form)
    if form.constant and form.lit:  # one pattern, with everything but the known letters quoted
        parts = re.split("(yyyy|MM|dd|HH|mm|ss)", str(form.lit))
        shown = "".join(x if i % 2 else "'" + x.replace("'", "''") + "'" if x else "" for i, x in enumerate(parts))
        return Val(F.date_format(at, shown), "string")
    for name in ("yyyy", "MM", "dd", "HH", "mm", "ss"):
        out = F.replace(out, F.lit(name), F.date_format(at, name))
    return Val(F.when(at.isNotNull(), out), "string")


@register("make_datetime")
def make_datetime(context, y: Val, m: Val, d: Val, h: Val | None = None, mi: Val | None = None, s: Val | None = None) -> Val:
    whole = lambda v: F.lit(0) if v is None else to_long(v).cast("int")
    year, sec = whole(y), whole(s)
    made = F.try_make_timestamp(years=year, months=whole(m), days=whole(d), hours=whole(h), mins=whole(mi), secs=sec.cast("decimal(8,6)"))
    return datetime(F.when(year.between(1, 9999) & sec.between(0, 59), made))


@register("make_timespan")
def make_timespan(context, h: Val, m: Val, s: Val | None = None) -> Val:
    total = to_real(h) * 3600 + to_real(m) * 60 + (F.lit(0.0) if s is None else to_real(s))
    return Val(F.round(total * 1_000_000).cast("long"), "timespan")


def _unix(unit: str, micros: int) -> None:
    @register(f"unixtime_{unit}_todatetime")
    def build(context, n: Val) -> Val:
        return datetime(F.timestamp_micros(F.round(to_real(n) * micros).cast("long") if n.kind != "long" else n.col * micros))


for _unit, _micros in (("seconds", 1_000_000), ("milliseconds", 1_000), ("microseconds", 1)):
    _unix(_unit, _micros)


@register("now")
def now(context) -> Val:
    at = context.options.now
    return datetime(F.current_timestamp() if at is None else F.lit(at).cast("timestamp"))


@register("ago")
def ago(context, span: Val) -> Val:
    if span.kind != "timespan":
        return null("datetime")
    return datetime(F.timestamp_micros(F.unix_micros(now(context).col) - span.col))
