"""Operators over several tables: lookup, join, union and the branching ones."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KqlCompileError
from ..plans import tree as t
from ..plans import values as V
from ..plans.frame import Field, Frame, field_of, fresh
from ..plans.values import Val

#: Kinds of joins and their other names.
KINDS = ("innerunique", "inner", "leftouter", "rightouter", "fullouter", "leftsemi", "leftanti", "rightsemi", "rightanti")
ALIASES = {"leftouterunique": "leftouter", "anti": "leftanti", "leftantisemi": "leftanti", "rightantisemi": "rightanti"}


def _tagged(v: Val) -> Column:
    """Text by which values of different kinds can be told apart and equal ones found."""
    if v.variant:
        number = V.number_of(v.col)
        return F.when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string"))).otherwise(F.concat(F.lit("j"), F.to_json(v.col)))
    if v.kind in ("long", "real", "decimal"):
        return F.concat(F.lit("n"), V.to_real(v).cast("string"))
    return F.concat(F.lit("j" if v.kind in ("string", "bool", "dynamic") else v.kind), F.to_json(V.as_variant(v)))


def matching(a: Val, b: Val) -> tuple[Column, Column]:
    """Both keys in one type that Spark can join by."""
    if a.kind == b.kind and not a.variant and not b.variant and a.kind not in ("dynamic", "null"):
        return a.col, b.col
    if {a.kind, b.kind} <= {"long", "real", "decimal"}:
        return V.to_real(a), V.to_real(b)
    return _tagged(a), _tagged(b)


def _keyed(left: Frame, right: Frame, keys: tuple[tuple[str, str], ...]) -> tuple[Frame, Frame, list[tuple[str, str]]]:
    """The frames with columns for their keys, and the names of each pair."""
    a, b = left.columns(), right.columns()
    pairs, add = [], ({}, {})
    for x, y in keys:
        one, other = matching(a.get(x, V.null("string")), b.get(y, V.null("string")))
        names = fresh("key"), fresh("key")
        add[0][names[0]], add[1][names[1]] = one, other
        pairs.append(names)
    return left.with_columns(add[0]), right.with_columns(add[1]), pairs


def _condition(pairs: list[tuple[str, str]], left: Frame, right: Frame) -> Column:
    out = None
    for a, b in zip(left.scope, right.scope, strict=False):
        test = F.col(a).eqNullSafe(F.col(b))
        out = test if out is None else out & test
    for a, b in pairs:
        test = F.col(a).eqNullSafe(F.col(b))
        out = test if out is None else out & test
    return out


def over_scopes(left: Frame, right: Frame, single: bool = False) -> Frame:
    """A table once for each row-set of `left`, which is what an outer join or a union with it makes in record scope. single: each has one row.

    Only a constant table is broadcast by hint."""
    names = [*left.scope, *left.carry]
    renamed = {c: fresh("s") for c in names}
    live = left.df.groupBy(*left.scope).agg(*[F.first(c).alias(c) for c in left.carry]) if left.carry else left.df.select(*left.scope) if single else left.df.select(*left.scope).distinct()
    live = live.select(*[F.col(c).alias(renamed[c]) for c in names])
    df = live.crossJoin(F.broadcast(right.kept()) if right.small else right.kept())
    return replace(right, df=df, scope=tuple(renamed[c] for c in left.scope), carry=tuple(renamed[c] for c in left.carry))


def live(left: Frame, other: Frame) -> Frame:
    """The rows of `other` whose row-set still has rows in `left`."""
    if not left.scope:
        return other
    if not other.scope:
        return over_scopes(left, other)
    names = [fresh("s") for _ in left.scope]
    sets = left.df.select(*[F.col(c).alias(n) for c, n in zip(left.scope, names, strict=True)]).distinct()
    test = None
    for a, b in zip(other.scope, names, strict=False):
        same = F.col(a).eqNullSafe(F.col(b))
        test = same if test is None else test & same
    if len(other.scope) < len(names):  # inside `partition` or `mv-apply` the same rows are there for each of its row-sets
        return replace(other, df=other.df.join(sets, test), scope=tuple(names))
    return replace(other, df=other.df.join(sets, test, "left_semi"))


def _matched(left: Frame, right: Frame, keys: tuple[tuple[str, str], ...]) -> Frame:
    """The rows of a table that match a row of a row-set, for each row-set: a join of the table with the row-sets' different keys."""
    left, right, pairs = _keyed(left, right, keys)
    names = {c: fresh("s") for c in (*left.scope, *left.carry)}
    by = [*left.scope, *(a for a, _ in pairs)]
    sets = left.df.groupBy(*by).agg(*[F.first(c).alias(c) for c in left.carry]) if left.carry else left.df.select(*by).distinct()
    sets = sets.select(*[F.col(c).alias(n) for c, n in names.items()], *(a for a, _ in pairs))
    df = (F.broadcast(right.df) if right.small else right.df).join(sets, _condition(pairs, replace(left, scope=()), replace(right, scope=())))
    return replace(right, df=df, scope=tuple(names[c] for c in left.scope), carry=tuple(names[c] for c in left.carry), small=False)


def _first_of_keys(frame: Frame, names: list[str]) -> Frame:
    """The first row of each key of a row-set."""
    if not frame.order:
        return replace(frame, df=frame.df.dropDuplicates([*frame.scope, *names]))
    place = fresh("place")
    numbered = frame.with_columns({place: F.row_number().over(frame.window(*names))})
    return numbered.where(F.col(place) == 1)


def lookup(low, frame: Frame, op: t.Lookup) -> Frame:
    """The first row of the table for each key; its other columns replace those of the row on a hit."""
    table = low.table(op.table)
    if table is None:
        raise KqlCompileError(f"unknown table {op.table!r}", *op.at)
    right = table.renamed()
    own = {y for _, y in op.keys}
    left, right, pairs = _keyed(frame, right, op.keys)
    right = _first_of_keys(right, [b for _, b in pairs])
    hit = fresh("hit")
    right = right.with_columns({hit: F.lit(True)})
    picked = [hit, *(b for _, b in pairs), *(f.name for k, f in right.fields.items() if k not in own)]
    side = right.df.select(*dict.fromkeys(picked))
    inner = op.kind == "inner"
    df = left.df.join(F.broadcast(side) if table.small else side, _condition(pairs, replace(left, scope=()), replace(right, scope=())), "inner" if inner else "left")
    out = replace(left, df=df)
    values = {}
    for name, f in right.fields.items():
        if name in own:
            continue
        new = f.value()
        if name in frame.fields:
            a, b = V.common([new, frame.fields[name].value()])
            one = a if a.kind != "null" else b
            values[name] = Val(F.when(F.col(hit), a.col).otherwise(b.col), one.kind, one.native)
        else:
            values[name] = new
    return out.with_values(values)


def _right(low, frame: Frame, operand) -> Frame | None:
    if isinstance(operand, t.Body):
        return low.body(operand)
    if operand is None:
        return low.origin
    return low.table(operand) or low.named.get(operand)


def join(low, frame: Frame, op: t.Join) -> Frame:
    """Equal keys only, null equal to null. The columns of the left, then those of the right, names taken numbered."""
    kind = ALIASES.get(op.kind, op.kind)
    if kind not in KINDS:
        raise KqlCompileError(f"unknown kind of join {op.kind!r}", *op.at)
    right = _right(low, frame, op.right)
    if right is None:
        raise KqlCompileError(f"unknown table {op.right!r}", *op.at)
    right = right.renamed()
    if frame.scope and not right.scope and kind == "rightsemi":
        return _matched(frame, right, op.keys)
    if frame.scope and not right.scope and kind in ("rightouter", "fullouter", "rightanti"):
        right = over_scopes(frame, right)
    elif frame.scope and right.scope and kind in ("rightouter", "fullouter", "rightanti"):
        right = live(frame, right)
    left, right, pairs = _keyed(frame, right, op.keys)
    if kind in ("rightsemi", "rightanti"):
        sets = left.df.select(*left.scope, *(a for a, _ in pairs))
        return replace(right, df=right.df.join(sets, _condition(pairs, left, right), "left_semi" if kind == "rightsemi" else "left_anti"), small=False)
    other = right.df.select(*dict.fromkeys([*right.hidden(), *(b for _, b in pairs), *(f.name for f in right.fields.values())]))
    other = F.broadcast(other) if right.small and kind not in ("rightouter", "fullouter") else other
    test = _condition(pairs, left, right)
    if kind in ("leftsemi", "leftanti"):
        return replace(left, df=left.df.join(other, test, "left_semi" if kind == "leftsemi" else "left_anti"), small=False)
    if kind == "innerunique":
        left = _first_of_keys(left, [a for a, _ in pairs])
    mark = fresh("mark")
    outer = kind in ("rightouter", "fullouter")
    if outer:
        left = left.with_columns({mark: F.lit(0)})
    how = {"innerunique": "inner", "inner": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "full"}[kind]
    df = left.df.join(other, test, how)
    fields = dict(left.fields)
    for name, f in right.fields.items():
        free, n = name, 0
        while free in fields:
            n += 1
            free = f"{name}{n}"
        fields[free] = f
    out = Frame(df, fields, left.scope, (*left.order, *right.order), left.carry)
    if not outer:
        return out
    # Rows without a left side stand last, in the order of the right.
    unmatched = fresh("unmatched")
    added = {unmatched: F.when(F.col(mark).isNull(), 1).otherwise(0)}
    scope, carry = [], []
    for a, b in zip(left.scope, right.scope, strict=False):
        scope.append(fresh("s"))
        added[scope[-1]] = F.coalesce(F.col(a), F.col(b))
    for a, b in zip(left.carry, right.carry or left.carry, strict=False):
        carry.append(fresh("s"))
        added[carry[-1]] = F.coalesce(F.col(a), F.col(b))
    return replace(out.with_columns(added), scope=tuple(scope), carry=tuple(carry), order=((unmatched, False), *out.order))


def stacked(low, frames: list[Frame], inner: bool = False) -> Frame:
    """All rows of several frames of one scope, in turn; columns are those of all, filled with nulls, or with `inner` the common ones."""
    names = list(dict.fromkeys(n for f in frames for n in f.fields))
    if inner:
        names = [n for n in names if all(n in f.fields for f in frames)]
    branch = fresh("branch")
    scope = [fresh("s") for _ in frames[0].scope]
    carry = [fresh("s") for _ in frames[0].carry]
    columns = [f.columns() for f in frames]
    fields: dict[str, Field] = {}
    picked: list[list[Column]] = [[F.lit(i).alias(branch)] for i in range(len(frames))]
    for i, f in enumerate(frames):
        picked[i] += [F.col(c).alias(n) for c, n in zip((*f.scope, *f.carry), (*scope, *carry), strict=True)]
    for name in names:
        kept = [f.fields.get(name) for f in frames]
        types = {(str(k.type), k.span) for k in kept if k}
        if len(types) == 1:  # as they are, whatever Spark's type
            one = next(k for k in kept if k)
            fields[name] = replace(one, name=fresh())
            for i, k in enumerate(kept):
                picked[i].append((F.col(k.name) if k else F.lit(None).cast(one.type)).alias(fields[name].name))
            continue
        values = V.common([c.get(name, V.null()) for c in columns])
        fields[name] = field_of(next((v for v in values if v.kind != "null"), values[0]))
        for i, v in enumerate(values):
            picked[i].append(v.col.cast(fields[name].type).alias(fields[name].name))
    order: list[tuple[str, bool]] = [(branch, False)]
    for i, f in enumerate(frames):
        for c, down in f.order:
            name, kind = fresh("key"), f.df.schema[c].dataType
            order.append((name, down))
            for j in range(len(frames)):
                picked[j].append((F.col(c) if i == j else F.lit(None).cast(kind)).alias(name))
    df = None
    for f, p in zip(frames, picked, strict=True):
        part = f.df.select(*p)
        df = part if df is None else df.unionByName(part)
    return Frame(df, fields, tuple(scope), tuple(order), tuple(carry))


def union(low, frame: Frame, op: t.Union) -> Frame:
    parts = [frame]
    for operand in op.operands:
        other = _right(low, frame, operand)
        if other is None:
            raise KqlCompileError(f"unknown table {operand!r}")
        parts.append(live(frame, other.renamed()))
    if frame.carry:
        parts = [_carrying(parts[0], p) for p in parts]
    return stacked(low, parts, op.kind == "inner")


def _carrying(frame: Frame, other: Frame) -> Frame:
    """`other` with the carried columns of the row-sets of `frame`."""
    if len(other.carry) == len(frame.carry):
        return other
    names = {c: fresh("s") for c in (*frame.scope, *frame.carry)}
    sets = frame.df.groupBy(*frame.scope).agg(*[F.first(c).alias(c) for c in frame.carry]).select(*[F.col(c).alias(n) for c, n in names.items()])
    test = None
    for a, b in zip(other.scope, frame.scope, strict=True):
        same = F.col(a).eqNullSafe(F.col(names[b]))
        test = same if test is None else test & same
    return replace(other, df=other.df.join(sets, test), carry=tuple(names[c] for c in frame.carry))


def as_(low, frame: Frame, op: t.As) -> Frame:
    low.named[op.name] = frame
    return frame


def fork(low, frame: Frame, op: t.Fork) -> Frame:
    """Each branch is kept under its name; the rows go on as they came."""
    for i, (name, ops) in enumerate(op.branches, 1):
        low.named[name or f"Fork{i}"] = low.inner().steps(frame, ops)
    return frame


def case(low, frame: Frame, op: t.Case) -> Frame:
    """Each row goes to the branch of the first condition that is true of it, or to the last one."""
    route = fresh("route")
    columns = frame.columns()
    way = F
    for i, (test, _) in enumerate(op.arms):
        way = way.when(V.truth(low.value(test, frame, columns)), i)
    frame = frame.with_columns({route: way.otherwise(len(op.arms))})
    branches = [*(ops for _, ops in op.arms), op.default]
    return stacked(low, [low.inner().steps(frame.where(F.col(route) == i), ops) for i, ops in enumerate(branches)])


def partition(low, frame: Frame, op: t.Partition) -> Frame:
    """The steps run apart for each value of a column, in the order in which values first appear."""
    v = frame.columns().get(op.by, V.null("string"))
    key = fresh("part")
    frame = frame.with_columns({key: V.canonical(v)})
    group: tuple = ()
    if frame.scope and frame.order:
        from pyspark.sql import Window

        frame = frame.rising()
        first = fresh("first")
        frame = frame.with_columns({first: F.min(frame.place()).over(Window.partitionBy(*frame.scope, key))})
        frame = replace(frame, carry=(*frame.carry, first))
    done = low.inner().steps(replace(frame, scope=(*frame.scope, key)), op.ops)
    carry = done.carry
    if len(carry) > len(frame.carry) - 1 and frame.scope and frame.order:
        group, carry = ((carry[-1], False),), carry[:-1]
    return replace(done, scope=done.scope[:-1], carry=carry, order=(*group, *done.order))
