"""Functions of text."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import Val, array, elements, java_regex, member, null, of_column, quote, quoted, text, to_long, to_text
from .registry import batched, json_of, register

STRING = T.StringType()


def string(col: Column) -> Val:
    return Val(col, "string")


def long(col: Column) -> Val:
    return Val(col.cast("long"), "long")


def pattern(context, p: Val) -> str | Column | None:
    """A pattern for Java: text if constant, None if invalid."""
    if p.constant:
        return java_regex(context.spark, str(p.lit))
    return text(p)


@register("strcat")
def strcat(context, *parts: Val) -> Val:
    return string(F.concat(*[text(p) for p in parts]) if parts else F.lit(""))


@register("strcat_delim")
def strcat_delim(context, delim: Val, *parts: Val) -> Val:
    pieces = [x for p in parts for x in (text(delim), text(p))][1:]
    return string(F.concat(*pieces) if pieces else F.lit(""))


def texts(v: Val) -> Column | None:
    """The elements of an array as text, null as the empty text."""
    found = elements(v)
    return None if found is None else F.transform(found[0], lambda x: text(of_column(x, found[1])))


@register("strcat_array")
def strcat_array(context, items: Val, delim: Val) -> Val:
    found = texts(items)
    if found is None:
        return null("string")
    if delim.constant and delim.kind != "null":
        return string(F.array_join(found, str(delim.lit)))
    return string(F.when(F.size(found) == 0, F.lit("")).otherwise(F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), lambda a, x: F.concat(a, text(delim), x))))


@register("strlen")
def strlen(context, s: Val) -> Val:
    return long(F.char_length(to_text(s)))


@register("toupper")
def toupper(context, s: Val) -> Val:
    return string(F.upper(text(s)))


@register("tolower")
def tolower(context, s: Val) -> Val:
    return string(F.lower(text(s)))


@register("substring")
def substring(context, s: Val, start: Val, length: Val | None = None) -> Val:
    whole, at = text(s), to_long(start).cast("int")
    at = F.when(at < 0, F.greatest(F.lit(0), F.char_length(whole) + at)).otherwise(at)
    n = F.char_length(whole) if length is None else F.greatest(F.lit(0), to_long(length).cast("int"))
    return string(F.substr(whole, at + 1, n))


@register("split")
def split(context, s: Val, delim: Val, index: Val | None = None) -> Val:
    if delim.constant:
        parts = F.split(text(s), quote(str(delim.lit or "")), -1) if delim.lit else F.lit(None).cast("array<string>")
    else:
        parts = F.when(text(delim) != "", F.split(text(s), quoted(text(delim)), -1))
    found = array(parts, STRING)
    return found if index is None else member(found, index if index.kind == "long" else Val(to_long(index), "long"))


@register("replace", "replace_string")
def replace(context, s: Val, old: Val, new: Val) -> Val:
    whole, a, b = text(s), text(old), text(new)
    each = F.concat(b, F.regexp_replace(whole, F.lit("(?s)(.)"), F.concat(F.lit("$1"), F.regexp_replace(b, F.lit(r"([\\$])"), F.lit(r"\\$1")))))
    return string(F.when(a == "", each).otherwise(F.replace(whole, a, b)))


def rewrite(new: Val) -> Column:
    """Back-references \\1 as Java's $1."""
    return F.regexp_replace(F.regexp_replace(text(new), F.lit(r"\$"), F.lit(r"\\\$")), F.lit(r"\\(?:g<)?(\d+)>?"), F.lit(r"\$$1"))


@register("replace_regex")
def replace_regex(context, s: Val, p: Val, new: Val) -> Val:
    found = pattern(context, p)
    if found is None:
        return null("string")
    return string(F.regexp_replace(text(s), found if isinstance(found, Column) else F.lit(found), rewrite(new)))


@register("extract")
def extract(context, p: Val, group: Val, s: Val) -> Val:
    found = pattern(context, p)
    if found is None:
        return null("string")
    found = found if isinstance(found, Column) else F.lit(found)
    if group.constant and p.constant and int(group.lit or 0) > re.compile(str(p.lit)).groups:
        return null("string")
    whole = text(s)
    got = F.call_function("regexp_extract", whole, found, F.lit(int(group.lit)) if group.constant else to_long(group).cast("int"))
    # An unset group is null, an empty one is not: only a match in which the group takes part counts.
    return string(F.when(F.rlike(whole, found), got if not (group.constant and int(group.lit)) else F.when((got != "") | F.lit(_always_set(str(p.lit) if p.constant else "", int(group.lit))), got)))


def _always_set(p: str, group: int) -> bool:
    """Whether a group is part of every match: no alternative and nothing optional is around it."""
    try:
        parsed = re._parser.parse(p)
    except Exception:
        return True

    def sure(items) -> bool:
        for op, arg in items:
            name = str(op)
            if name == "SUBPATTERN" and (arg[0] == group or sure(arg[-1])):
                return True
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 and sure(arg[2]):
                return True
        return False

    return sure(parsed)


@register("extract_all")
def extract_all(context, p: Val, s: Val) -> Val:
    found = pattern(context, p)
    if found is None or isinstance(found, Column):
        return null("dynamic")
    groups = re.compile(str(p.lit)).groups
    every = [F.regexp_extract_all(text(s), F.lit(found), F.lit(i)) for i in (range(1, groups + 1) if groups > 1 else [groups])]
    if groups < 2:
        return array(every[0], STRING)
    rows = F.transform(F.sequence(F.lit(1), F.size(every[0])), lambda i: F.array(*[F.try_element_at(e, i) for e in every]))
    return array(F.when(F.size(every[0]) > 0, rows).otherwise(F.array().cast("array<array<string>>")), T.ArrayType(STRING))


@register("indexof")
def indexof(context, s: Val, x: Val) -> Val:
    return long(F.call_function("locate", text(x), text(s)) - 1)


@register("indexof_regex")
def indexof_regex(context, s: Val, p: Val, start: Val | None = None) -> Val:
    found = pattern(context, p)
    if found is None:
        return null("long")
    found = found if isinstance(found, Column) else F.lit(found)
    at = F.lit(0) if start is None else F.greatest(F.lit(0), to_long(start).cast("int"))
    rest = F.substr(to_text(s), at + 1, F.greatest(F.char_length(to_text(s)), F.lit(1)))
    # The text before the match, by its length; regexp_instr counts in the same units.
    place = F.char_length(F.call_function("regexp_extract", rest, F.concat(F.lit("(?s)^(.*?)(?:"), found, F.lit(")")), F.lit(1)))
    return long(F.when(to_text(s).isNull(), -1).when(F.rlike(rest, found), place + at).otherwise(-1))


@register("countof")
def countof(context, s: Val, x: Val) -> Val:
    whole, part = text(s), text(x)
    gone = F.char_length(whole) - F.char_length(F.replace(whole, part, F.lit("")))
    return long(F.when(part == "", F.char_length(whole) + 1).otherwise(gone / F.char_length(part)))


@register("isempty")
def isempty(context, v: Val) -> Val:
    return Val(text(v) == "", "bool")


@register("isnotempty")
def isnotempty(context, v: Val) -> Val:
    return Val(text(v) != "", "bool")


def _trim(context, p: Val, s: Val, start: bool, end: bool) -> Val:
    found = pattern(context, p)
    if found is None:
        return null("string")
    found = found if isinstance(found, Column) else F.lit(found)
    out = text(s)
    if start:
        out = F.regexp_replace(out, F.concat(F.lit("^(?:"), found, F.lit(")+")), F.lit(""))
    if end:
        out = F.regexp_replace(out, F.concat(F.lit("(?:"), found, F.lit(")+$")), F.lit(""))
    return string(out)


@register("trim")
def trim(context, p: Val, s: Val) -> Val:
    return _trim(context, p, s, True, True)


@register("trim_start")
def trim_start(context, p: Val, s: Val) -> Val:
    return _trim(context, p, s, True, False)


@register("trim_end")
def trim_end(context, p: Val, s: Val) -> Val:
    return _trim(context, p, s, False, True)


@register("reverse")
def reverse(context, v: Val) -> Val:
    if v.array:
        return Val(F.reverse(v.col), "dynamic", v.native)
    if v.variant:
        items = F.reverse(v.col.try_cast("array<variant>"))
        return Val(F.when(items.isNotNull(), F.to_variant_object(items)).when(v.col.isNotNull(), F.reverse(to_text(v)).cast("variant")), "dynamic")
    return string(F.reverse(to_text(v)))


@register("strcmp")
def strcmp(context, a: Val, b: Val) -> Val:
    x, y = text(a), text(b)
    return long(F.when(x < y, -1).when(x > y, 1).otherwise(0))


@register("translate")
def translate(context, old: Val, new: Val, s: Val) -> Val:
    if not (old.constant and new.constant):
        return string(F.call_function("translate", text(s), text(old), text(new)))
    a, b = str(old.lit or ""), str(new.lit or "")
    table = {c: b[i] if i < len(b) else "" for i, c in enumerate(a)}  # the last of equal letters counts
    kept = [c for c in table if table[c]]
    gone = [c for c in table if not table[c]]
    return string(F.translate(text(s), "".join(kept + gone), "".join(table[c] for c in kept)))


@register("parse_csv")
def parse_csv(context, s: Val) -> Val:
    first = batched(lambda x: json.dumps(next(csv.reader(io.StringIO(x or "")), [])), "string")
    found = json_of(F.coalesce(first(to_text(s)), F.lit("[]")))
    return found


@register("base64_encodestring", "base64_encode_tostring")
def base64_encode(context, s: Val) -> Val:
    return string(F.regexp_replace(F.base64(F.encode(text(s), "UTF-8")), F.lit(r"\s"), F.lit("")))


@register("base64_decodestring", "base64_decode_tostring")
def base64_decode(context, s: Val) -> Val:
    raw = F.try_to_binary(text(s), F.lit("base64"))
    return string(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")))
