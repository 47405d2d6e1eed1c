"""Typed column expressions: the kinds of values, their conversions, comparisons and arithmetic.

A value's kind is known when a query is compiled: string long real decimal bool datetime timespan dynamic null. A timespan is held in
microseconds. A dynamic value is a VARIANT, or an array, struct or map of Spark where the data already is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING: Any = object()
NUMERIC = ("long", "real", "decimal")
DECIMAL = T.DecimalType(38, 18)
SPARK = {"string": T.StringType(), "long": T.LongType(), "real": T.DoubleType(), "decimal": DECIMAL, "bool": T.BooleanType(), "datetime": T.TimestampType(), "timespan": T.LongType(), "dynamic": T.VariantType(), "null": T.StringType()}
#: Names of types in queries.
KINDS = {"string": "string", "int": "long", "long": "long", "real": "real", "double": "real", "decimal": "decimal", "bool": "bool", "boolean": "bool", "datetime": "datetime", "date": "datetime", "timespan": "timespan", "time": "timespan", "guid": "guid", "dynamic": "dynamic"}
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
ISO = r"^\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.]\d{1,9})?)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?\s*$"


@dataclass(frozen=True)
class Val:
    """native: the Spark type of a dynamic value that isn't a VARIANT. lit: the constant that the value is."""

    col: Column
    kind: str
    native: T.DataType | None = None
    lit: Any = MISSING

    @property
    def constant(self) -> bool:
        return self.lit is not MISSING

    @property
    def array(self) -> bool:
        return isinstance(self.native, T.ArrayType)

    @property
    def variant(self) -> bool:
        return self.kind == "dynamic" and self.native is None


def null(kind: str = "null") -> Val:
    return Val(F.lit(None).cast(SPARK[kind]), kind, lit=None)


def literal(value: Any, kind: str) -> Val:
    if value is None:
        return null()
    return Val(F.lit(value).cast(SPARK[kind]), kind, lit=value)


def of_column(col: Column, kind: T.DataType) -> Val:
    """The value of a column of a Spark type."""
    if isinstance(kind, T.LongType):
        return Val(col, "long")
    if isinstance(kind, T.IntegralType):
        return Val(col.cast("long"), "long")
    if isinstance(kind, T.DoubleType):
        return Val(col, "real")
    if isinstance(kind, T.FloatType):
        return Val(col.cast("double"), "real")
    if isinstance(kind, T.DecimalType):
        return Val(col.cast(DECIMAL), "decimal")
    if isinstance(kind, T.BooleanType):
        return Val(col, "bool")
    if isinstance(kind, T.TimestampType):
        return Val(col, "datetime")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return Val(col.cast("timestamp"), "datetime")
    if isinstance(kind, T.DayTimeIntervalType):
        parts = ((86_400_000_000, "DAY"), (3_600_000_000, "HOUR"), (60_000_000, "MINUTE"), (1_000_000, "SECOND"))
        full = col.cast(T.DayTimeIntervalType(0, 3))
        return Val(sum((F.extract(F.lit(p), full).cast("decimal(20,6)") * n for n, p in parts), F.lit(0)).cast("long"), "timespan")
    if isinstance(kind, T.VariantType):
        return Val(F.when(~F.is_variant_null(col), col), "dynamic")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return Val(col, "dynamic", kind)
    if isinstance(kind, T.NullType):
        return null()
    return Val(col.cast("string"), "string")


# --- variants


def shape(v: Column) -> Column:
    """The type name of a variant's value."""
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    return shape(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")


def number_of(v: Column) -> Column:
    """The number that a variant is, else null."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def text_of(v: Column) -> Column:
    """The string that a variant is, else null."""
    return F.when(shape(v) == "STRING", F.try_variant_get(v, "$", "string"))


def once(column: Column, build) -> Column:
    """What `build` makes of a column whose value is computed once, however often it is used: parsing a document is dear."""
    return F.transform(F.array(column), build)[0]


def plain(v: Column) -> Column:
    """A variant without JSON's null."""
    return once(v, lambda x: F.when(~F.is_variant_null(x), x))


def as_variant(v: Val) -> Column:
    if v.variant:
        return v.col
    if v.kind == "dynamic":
        return F.to_variant_object(v.col)
    if v.kind == "null":
        return F.lit(None).cast("variant")
    if v.kind == "timespan":
        return to_text(v).cast("variant")
    return v.col.cast("variant")


def canonical(v: Val) -> Column:
    """What equal values have in common, of a type that can be grouped, joined and sorted by."""
    if v.variant:
        return F.to_json(v.col)
    if v.kind == "dynamic":
        return F.to_json(F.to_variant_object(v.col))
    return v.col


def elements(v: Val) -> tuple[Column, T.DataType] | None:
    """The array that a value is (null if it isn't one) and the type of its elements; None if it can't be one."""
    if v.array:
        return v.col, v.native.elementType
    if v.variant:
        return F.transform(v.col.try_cast("array<variant>"), plain), T.VariantType()
    return None


def array(col: Column, element: T.DataType) -> Val:
    return Val(col, "dynamic", T.ArrayType(element))


def bag(v: Val) -> Column | None:
    """A map from string to variant, null if the value isn't a bag; None if it can't be one."""
    if v.variant:
        return v.col.try_cast("map<string,variant>")
    if isinstance(v.native, (T.StructType, T.MapType)):
        return F.to_variant_object(v.col).try_cast("map<string,variant>")
    return None


def path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def member(v: Val, key: Val) -> Val:
    """An element by number (from the end if negative) or a member by name; null for whatever isn't there."""
    if v.kind != "dynamic" or key.kind == "null":
        return null()
    by_number = key.kind in ("long", "real")
    if v.variant:
        if by_number:
            return Val(plain(_at(v.col.try_cast("array<variant>"), key)), "dynamic")
        if key.constant:
            return Val(plain(F.try_variant_get(v.col, path(str(key.lit)), "variant")), "dynamic")
        return Val(plain(F.try_element_at(v.col.try_cast("map<string,variant>"), to_text(key))), "dynamic")
    if v.array:
        return of_column(_at(v.col, key), v.native.elementType) if by_number else null()
    if isinstance(v.native, T.MapType):
        return of_column(F.try_element_at(v.col, to_text(key)), v.native.valueType) if isinstance(v.native.keyType, T.StringType) else null()
    name = str(key.lit) if key.constant else None
    if name in v.native.names:
        return of_column(v.col.getField(name), v.native[name].dataType)
    return null() if name is not None else member(Val(F.to_variant_object(v.col), "dynamic"), key)


def _at(items: Column, key: Val) -> Column:
    if key.constant:
        return F.try_element_at(items, F.lit(int(key.lit) + (key.lit >= 0)))
    i = key.col.cast("int")
    return F.try_element_at(items, F.when(i >= 0, i + 1).otherwise(i))


# --- conversions; null for what can't be converted


def to_text(v: Val) -> Column:
    """Text of a value; null stays null."""
    if v.kind == "string":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast("string")
    if v.kind == "real":
        whole = (v.col == F.floor(v.col).cast("double")) & (F.abs(v.col) < 1e16)
        other = F.regexp_replace(F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"\.0E", "E"), "E(?=[0-9])", "e+"), "E-([0-9])$", "e-0$1")
        small = (F.abs(v.col) >= 1e-4) & (F.abs(v.col) < 1e16)
        shown = F.when(F.isnan(v.col), "nan").when(F.abs(v.col) == float("inf"), F.when(v.col > 0, "inf").otherwise("-inf"))
        plain_ = F.regexp_replace(F.regexp_replace(v.col.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return shown.when(whole, F.concat(F.format_string("%.0f", v.col), F.lit(".0"))).when(small & v.col.cast("string").contains("E"), plain_).otherwise(F.regexp_replace(other, "E-", "e-"))
    if v.kind == "decimal":
        return F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if v.kind == "datetime":
        micros = F.pmod(F.unix_micros(v.col), F.lit(1_000_000))
        return F.concat(F.date_format(v.col, "yyyy-MM-dd HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))
    if v.kind == "timespan":
        days = F.floor(v.col / F.lit(86_400_000_000)).cast("long")
        rest = v.col - days * F.lit(86_400_000_000)
        second, micro = F.floor(rest / 1_000_000).cast("long"), rest % 1_000_000
        clock = F.format_string("%d:%02d:%02d", F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60)
        day = F.when(days != 0, F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "))).otherwise("")
        return F.when(v.col.isNotNull(), F.concat(day, clock, F.when(micro > 0, F.format_string(".%06d", micro)).otherwise("")))
    if v.variant:
        return F.coalesce(F.try_variant_get(v.col, "$", "string"), F.to_json(v.col))
    if v.kind == "dynamic":
        return F.to_json(F.to_variant_object(v.col))
    return v.col.cast("string")


def text(v: Val) -> Column:
    """Text of a value; null is the empty text."""
    if v.kind == "string" and v.constant:
        return v.col
    return F.coalesce(to_text(v), F.lit(""))


def _double_of_text(s: Column) -> Column:
    special = F.lower(F.trim(s))
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double")).when(special.rlike("^[+-]?(inf|infinity|nan)$"), F.when(special.contains("nan"), float("nan")).when(special.startswith("-"), float("-inf")).otherwise(float("inf")))


def to_real(v: Val) -> Column:
    if v.kind in ("long", "decimal", "bool"):
        return v.col.cast("double") if v.kind != "bool" else v.col.cast("int").cast("double")
    if v.kind == "real":
        return v.col
    if v.kind == "string":
        return _double_of_text(v.col)
    if v.variant:
        return once(v.col, lambda x: F.coalesce(number_of(x), _double_of_text(text_of(x)), F.when(shape(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int").cast("double"))))
    return F.lit(None).cast("double")


def to_long(v: Val) -> Column:
    if v.kind == "long":
        return v.col
    if v.kind == "bool":
        return v.col.cast("long")
    if v.kind == "null":
        return F.lit(None).cast("long")
    cut = lambda x: F.when(~F.isnan(x), x.try_cast("long"))
    if not v.variant:
        return cut(to_real(v))
    return once(v.col, lambda x: F.coalesce(F.when(shape(x).rlike("INT$"), F.try_variant_get(x, "$", "long")), once(to_real(Val(x, "dynamic")), cut)))


def to_bool(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        return v.col != 0
    if v.kind == "string" or v.variant:
        s = F.lower(F.trim(v.col if v.kind == "string" else F.try_variant_get(v.col, "$", "string")))
        known = F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)
        return known if v.kind == "string" else F.coalesce(known, number_of(v.col) != 0)
    return F.lit(None).cast("boolean")


def to_datetime(v: Val) -> Column:
    if v.kind == "datetime":
        return v.col
    if v.kind == "string" or v.variant:
        s = v.col if v.kind == "string" else F.when(shape(v.col).rlike("^(STRING|TIMESTAMP|DATE)"), F.try_variant_get(v.col, "$", "string"))
        return F.when(s.rlike(ISO), F.trim(s).try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def to_timespan(v: Val) -> Column:
    """Microseconds; text is a number and one of d h m s ms, or a number of days."""
    if v.kind == "timespan":
        return v.col
    if v.kind in NUMERIC:
        return F.round(v.col.cast("double") * 86_400_000_000).cast("long")
    if v.kind == "string" or v.variant:
        s = F.lower(F.trim(v.col if v.kind == "string" else F.try_variant_get(v.col, "$", "string")))
        form = r"^(-?\d+(?:\.\d+)?)\s*(ms|d|h|m|s)?$"
        number = F.regexp_extract(s, form, 1).try_cast("double")
        unit = F.regexp_extract(s, form, 2)
        factor = F.when(unit == "h", 3_600_000_000).when(unit == "m", 60_000_000).when(unit == "s", 1_000_000).when(unit == "ms", 1_000).otherwise(86_400_000_000)
        return F.when(s.rlike(form), F.round(number * factor).cast("long"))
    return F.lit(None).cast("long")


def to_guid(v: Val) -> Column:
    digits = F.lower(F.regexp_replace(F.regexp_replace(to_text(v), r"^\s*(urn:)?(uuid:)?", ""), "[-{}]", ""))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def to_decimal(v: Val) -> Column:
    if v.kind == "decimal":
        return v.col
    if v.kind in ("long", "real"):
        return (v.col if v.kind == "long" else v.col.cast("string")).try_cast(DECIMAL)
    if v.kind == "string" or v.variant:
        return F.trim(v.col if v.kind == "string" else F.try_variant_get(v.col, "$", "string")).try_cast(DECIMAL)
    return F.lit(None).cast(DECIMAL)


def to_dynamic(v: Val) -> Val:
    """Parsed JSON; containers as they are."""
    if v.kind == "dynamic":
        if v.variant:
            return Val(F.when(shape(v.col) == "STRING", plain(F.try_parse_json(text_of(v.col)))).otherwise(v.col), "dynamic")
        return v
    if v.kind == "null":
        return null("dynamic")
    if v.kind == "string":
        return Val(plain(F.try_parse_json(v.col)), "dynamic")
    return Val(as_variant(v), "dynamic")


def convert(v: Val, kind: str) -> Val:
    """To a type by its name in queries; unknown names leave the value as it is."""
    to = KINDS.get(kind.lower(), "")
    if to == "dynamic":
        return to_dynamic(v)
    if to == "guid":
        return Val(to_guid(v), "string")
    simple = {"string": to_text, "long": to_long, "real": to_real, "decimal": to_decimal, "bool": to_bool, "datetime": to_datetime, "timespan": to_timespan}
    return Val(simple[to](v), to) if to else v


# --- truth


def as_bool(v: Val) -> Column:
    """For `and`, `or`: what isn't a bool is false, null stays null."""
    if v.kind == "bool":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    if v.variant:
        return F.when(v.col.isNotNull(), F.coalesce(F.when(shape(v.col) == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean")), F.lit(False)))
    return F.when(v.col.isNotNull(), False)


def truth(v: Val) -> Column:
    """For filters and conditions, which take null for false; left as it is, it can be pushed into a scan."""
    return as_bool(v)


# --- comparison and arithmetic


def _pair(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Both sides in one comparable type, or None if their kinds don't compare."""
    kinds = {a.kind, b.kind}
    if kinds <= {"long", "real", "decimal", "bool"} and kinds != {"bool"}:
        if "real" in kinds:
            return to_real(a), to_real(b)
        return (to_decimal(a), to_decimal(b)) if "decimal" in kinds else (to_long(a), to_long(b))
    if len(kinds) == 1 and a.kind not in ("dynamic", "null"):
        return a.col, b.col
    return None


def _from_variant(v: Val, kind: str) -> Val | None:
    """A variant read as a kind, null if it is of another; None if no variant can be of that kind."""
    if kind in NUMERIC or kind == "real":
        return Val(number_of(v.col), "real")
    if kind == "string":
        return Val(text_of(v.col), "string")
    if kind == "bool":
        return Val(F.when(shape(v.col) == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean")), "bool")
    return None


def equal(a: Val, b: Val) -> Column:
    """Null equals null and nothing else."""
    if a.kind == "null" or b.kind == "null":
        return a.col.isNull() & b.col.isNull()
    if a.kind == b.kind == "dynamic":
        if a.variant and b.variant:
            numbers = number_of(a.col), number_of(b.col)
            return F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), numbers[0] == numbers[1]).otherwise(canonical(a).eqNullSafe(canonical(b)))
        return canonical(a).eqNullSafe(canonical(b))
    if a.variant or b.variant:
        v, other = (a, b) if a.variant else (b, a)
        if (read := _from_variant(v, other.kind)) and (pair := _pair(read, other)):
            return F.when(v.col.isNull() | other.col.isNull(), v.col.isNull() & other.col.isNull()).otherwise(F.coalesce(pair[0] == pair[1], F.lit(False)))
    if pair := _pair(a, b):
        return pair[0].eqNullSafe(pair[1])
    return a.col.isNull() & b.col.isNull()


ORDERS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def ordered(op: str, a: Val, b: Val) -> Column:
    """Null unless both sides have values that compare."""
    compare = lambda x, y: getattr(x, ORDERS[op])(y)
    if a.variant and b.variant:
        return F.coalesce(compare(number_of(a.col), number_of(b.col)), compare(text_of(a.col), text_of(b.col)))
    if a.variant and (read := _from_variant(a, b.kind)):
        a = read
    elif b.variant and (read := _from_variant(b, a.kind)):
        b = read
    pair = _pair(a, b)
    return compare(*pair) if pair else F.lit(None).cast("boolean")


def _python_mod(a: Column, b: Column) -> Column:
    return F.try_mod(F.try_mod(a, b) + b, b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Null in, null out; a result that doesn't exist or kinds that don't fit give null."""
    kinds = (a.kind, b.kind)
    if "null" in kinds:
        return null()
    if op == "+" and "string" in kinds:
        return Val(F.concat(to_text(a), to_text(b)), "string")
    if op == "+" and (a.array or b.array) and (x := elements(a)) and (y := elements(b)):
        return joined([a, b])
    if "dynamic" in kinds:
        return _variant_arithmetic(op, a, b)
    if kinds == ("datetime", "timespan") and op in "+-":
        shift = b.col if op == "+" else -b.col
        return Val(F.timestamp_micros(F.unix_micros(a.col) + shift), "datetime")
    if kinds == ("timespan", "datetime") and op == "+":
        return arithmetic(op, b, a)
    if kinds == ("datetime", "datetime") and op == "-":
        return Val(F.unix_micros(a.col) - F.unix_micros(b.col), "timespan")
    if kinds == ("timespan", "timespan"):
        if op in "+-":
            return Val(F.try_add(a.col, b.col) if op == "+" else F.try_subtract(a.col, b.col), "timespan")
        return Val(F.try_divide(a.col.cast("double"), b.col.cast("double")), "real") if op == "/" else Val(_python_mod(a.col, b.col), "timespan") if op == "%" else null()
    if "timespan" in kinds and op in "*/" and (a if a.kind != "timespan" else b).kind in NUMERIC and not (op == "/" and b.kind == "timespan"):
        span, n = (a, b) if a.kind == "timespan" else (b, a)
        by = to_real(n)
        return Val(F.round(span.col * by if op == "*" else F.try_divide(span.col.cast("double"), by)).cast("long"), "timespan")
    if not all(k in (*NUMERIC, "bool") for k in kinds):
        return null()
    if op == "/":
        return Val(F.try_divide(to_real(a), to_real(b)), "real")
    kind = "real" if "real" in kinds else "decimal" if "decimal" in kinds else "long"
    to = {"real": to_real, "decimal": to_decimal, "long": to_long}[kind]
    x, y = to(a), to(b)
    if op == "%":
        return Val(F.try_mod(F.try_mod(x, y) + y, y), kind)
    return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y).cast(SPARK[kind]), kind)


def _variant_arithmetic(op: str, a: Val, b: Val) -> Val:
    """Whole numbers stay whole; two texts or a text and a number are joined by `+`."""
    if any(v.kind not in ("dynamic", "bool", *NUMERIC) or v.kind == "dynamic" and not v.variant for v in (a, b)):
        other = a if a.kind != "dynamic" else b
        if other.kind == "timespan" and op in "*/" and (a.variant or b.variant):
            read = lambda v: Val(number_of(v.col), "real") if v.variant else v
            return arithmetic(op, read(a), read(b))
        return null()
    whole = [shape(v.col).rlike("INT$") if v.variant else F.lit(v.kind == "long") for v in (a, b)]
    real = [Val(number_of(v.col), "real") if v.variant else v for v in (a, b)]
    longs = [Val(F.try_variant_get(v.col, "$", "long"), "long") if v.variant else Val(to_long(v), "long") for v in (a, b)]
    if op == "/":
        return arithmetic(op, *real)
    of_reals = arithmetic(op, Val(to_real(real[0]), "real"), Val(to_real(real[1]), "real")).col.cast("variant")
    out = F.when(whole[0] & whole[1], arithmetic(op, *longs).col.cast("variant")).otherwise(of_reals)
    if op == "+":
        either = F.coalesce(*[text_of(v.col).isNotNull() if v.variant else F.lit(False) for v in (a,)], F.lit(False)) | F.coalesce(*[text_of(v.col).isNotNull() if v.variant else F.lit(False) for v in (b,)], F.lit(False))
        out = F.when(either, F.concat(to_text(a), to_text(b)).cast("variant")).otherwise(out)
    return Val(out, "dynamic")


def negative(v: Val) -> Val:
    if v.kind in (*NUMERIC, "timespan"):
        return Val(-v.col, v.kind)
    if v.kind == "bool":
        return Val(-to_long(v), "long")
    if v.variant:
        return _variant_arithmetic("-", Val(F.lit(0).cast("long"), "long"), v)
    return null()


def variants(v: Val) -> Column:
    """The elements of an array as variants."""
    return F.transform(v.col, lambda x: as_variant(of_column(x, v.native.elementType)))


def joined(parts: list[Val]) -> Val:
    """One array of the elements of several; a part that is no array is one element, null none."""
    kinds = {str(p.native.elementType) for p in parts if p.array}
    if len(kinds) == 1 and all(p.array for p in parts):
        none = F.array().cast(parts[0].native)
        return Val(F.concat(*[F.coalesce(p.col, none) for p in parts]), "dynamic", parts[0].native)
    none = F.array().cast("array<variant>")
    lists = []
    for p in parts:
        if p.array:
            lists.append(F.coalesce(variants(p), none))
        elif p.variant:
            lists.append(F.coalesce(F.transform(p.col.try_cast("array<variant>"), plain), F.when(p.col.isNotNull(), F.array(p.col)), none))
        elif p.kind != "null":
            lists.append(F.when(p.col.isNotNull(), F.array(as_variant(p))).otherwise(none))
    return array(F.concat(*lists) if lists else none, T.VariantType())


def common(values: list[Val]) -> list[Val]:
    """Values in one kind, so that they can be branches of one expression."""
    kinds = {v.kind for v in values if v.kind != "null"}
    if not kinds:
        return values
    natives = {str(v.native) for v in values if v.kind == "dynamic"}
    if len(kinds) == 1 and (kinds != {"dynamic"} or len(natives) == 1):
        one = next(v for v in values if v.kind != "null")
        kind = one.native or SPARK[one.kind]
        return [Val(F.lit(None).cast(kind), one.kind, one.native, lit=None) if v.kind == "null" else v for v in values]
    if kinds <= set(NUMERIC):
        to, kind = (to_real, "real") if "real" in kinds else (to_decimal, "decimal")
        return [null(kind) if v.kind == "null" else Val(to(v), kind) for v in values]
    return [Val(as_variant(v), "dynamic") for v in values]


#: One to three columns by which values of a kind sort: numbers, then texts, dates, timespans, the rest.
def sort_columns(v: Val) -> list[Column]:
    if v.kind == "bool":
        return [v.col.cast("int")]
    if v.variant:
        bucket = F.when(v.col.isNull(), None).when(is_number(v.col) | (shape(v.col) == "BOOLEAN"), 0).when(shape(v.col) == "STRING", 1).otherwise(4)
        return [bucket, to_real(Val(F.when(bucket == 0, v.col), "dynamic")), F.when(bucket > 0, to_text(v))]
    return [canonical(v)]


# --- regular expressions


def java_regex(spark: Any, pattern: str) -> str | None:
    """A pattern of Python's in Java's dialect; None if it is no pattern."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    turned = re.sub(r"\(\?P<([A-Za-z0-9]+)>", r"(?<\1>", pattern)
    turned = re.sub(r"\(\?P<(\w+)>", "(", turned)
    turned = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", turned)
    turned = turned.replace(r"\Z", r"\z")
    try:
        spark._jvm.java.util.regex.Pattern.compile(turned)
    except Exception:
        return None
    return turned


def quoted(needle: Column) -> Column:
    """A column of literal text as a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def quote(needle: str) -> str:
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
