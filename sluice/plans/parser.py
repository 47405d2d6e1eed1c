"""From query text to a syntax tree: a regular-expression lexer and a recursive-descent parser."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import KqlCompileError, KqlUnsupportedError
from . import tree as t

#: The language's words.
HEADS = ("source", "print", "let", "datatable", "externaldata", "range")
DASHED = ("project-away", "project-keep", "project-reorder", "project-rename", "parse-where", "parse-kv", "mv-expand", "mv-apply", "make-series", "sample-distinct", "top-nested")
STRING_OPS = ("has", "has_cs", "has_any", "has_all", "contains", "contains_cs", "startswith", "startswith_cs", "endswith", "endswith_cs", "in")
DEFERRED = ("scan", "top-nested")
#: Microseconds of the units of a timespan.
UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "microsecond": 1, "tick": 0.1}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
    |(?P<timespan>\d+(?:\.\d+)?(?:ms|microseconds?|ticks?|[dhms])\b)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<name>(?:%s)\b|[a-zA-Z_][a-zA-Z0-9_]*)
    |(?P<op>!(?:%s)\b|==|!=|<=|>=|=~|!~|[-+*/%%<>=|(),.:;\[\]])"""
    % ("|".join(DASHED), "|".join(sorted(STRING_OPS, key=len, reverse=True))),
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    col: int


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise KqlCompileError(f"unexpected {text[at]!r}", line, at - start + 1)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, at - start + 1))
        if "\n" in m[0]:
            line += m[0].count("\n")
            start = at + m[0].rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", line, at - start + 1)]


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens = tokens(text)
        self.at = 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def error(self, what: str) -> KqlCompileError:
        return KqlCompileError(f"{what}, not {self.now.text or 'the end'!r}", self.now.line, self.now.col)

    def place(self) -> tuple[int, int]:
        return self.now.line, self.now.col

    def is_(self, *texts: str) -> bool:
        return self.now.kind in ("op", "name") and self.now.text in texts

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.accept(text):
            raise self.error(f"{text!r} is needed here")

    def name(self) -> str:
        if self.now.kind != "name" or "-" in self.now.text:
            raise self.error("a name is needed here")
        return self.take().text

    def string(self) -> str:
        if self.now.kind != "string":
            raise self.error("a string is needed here")
        return unquoted(self.take().text)

    def whole(self) -> int:
        if self.now.kind != "number":
            raise self.error("a number is needed here")
        return int(float(self.take().text))

    def many(self, one):
        out = [one()]
        while self.accept(","):
            out.append(one())
        return tuple(out)

    # --- statements

    def query(self) -> t.Query:
        if not self.is_(*HEADS):
            raise self.error(f"a query starts with one of {', '.join(HEADS)}")
        lets = []
        while self.accept("let"):
            name = self.name()
            self.need("=")
            lets.append((name, self.table() if self.is_table() else self.expr()))
            self.need(";")
        body = self.body()
        if self.now.kind != "end":
            raise self.error("'|' or the end is needed here")
        return t.Query(tuple(lets), body)

    def is_table(self) -> bool:
        after = self.ahead()
        return self.is_("datatable", "externaldata") and after.text == "(" or self.is_("range") and after.kind == "name" and self.ahead(2).text == "from"

    def body(self) -> t.Body:
        if self.accept("source"):
            head = "source"
        elif self.accept("print"):
            items = self.many(lambda: (self.assigned_name(), self.expr()))
            head = t.Print(tuple((name or f"print_{i}", e) for i, (name, e) in enumerate(items)))
        elif self.is_table():
            head = self.table()
        else:
            raise self.error("a source is needed here")
        ops = []
        while self.accept("|"):
            ops.append(self.operator())
        return t.Body(head, tuple(ops))

    def assigned_name(self) -> str | None:
        if self.now.kind == "name" and self.ahead().text == "=" and self.ahead().kind == "op":
            name = self.name()
            self.need("=")
            return name
        return None

    def assignment(self) -> t.Named:
        name = self.assigned_name()
        if name is None:
            raise self.error("'name =' is needed here")
        return name, self.expr()

    def table(self):
        at = self.place()
        if self.accept("range"):
            name = self.name()
            self.need("from")
            start = self.expr()
            self.need("to")
            stop = self.expr()
            self.need("step")
            return t.Range(name, start, stop, self.expr(), at)
        kind = self.take().text
        self.need("(")
        columns = self.many(self.declared)
        self.need(")")
        self.need("[")
        if kind == "datatable":
            values = []
            while not self.is_("]"):
                values.append(self.expr())
                if not self.accept(","):
                    break
            self.need("]")
            return t.DataTable(columns, tuple(values), at)
        uris = [self.string()]
        while self.accept(","):
            if self.is_("]"):
                break
            uris.append(self.string())
        self.need("]")
        options: tuple = ()
        if self.accept("with"):
            self.need("(")
            options = self.many(self.option)
            self.need(")")
        return t.ExternalData(columns, tuple(uris), options, at)

    def declared(self) -> tuple[str, str]:
        name = self.name()
        self.need(":")
        return name, self.name()

    def option(self) -> tuple[str, str]:
        name = self.name()
        self.need("=")
        return name, self.string() if self.now.kind == "string" else self.name()

    # --- operators

    def pipeline(self) -> tuple[t.Op, ...]:
        self.need("(")
        ops = [self.operator()]
        while self.accept("|"):
            ops.append(self.operator())
        self.need(")")
        return tuple(ops)

    def operator(self) -> t.Op:
        token = self.now
        if token.kind != "name":
            raise self.error("an operator is needed here")
        if token.text.lower() in DEFERRED:
            raise KqlUnsupportedError(f"the operator {token.text!r} isn't supported", token.line, token.col)
        method = OPERATORS.get(token.text)
        if not method:
            raise KqlCompileError(f"unknown operator {token.text!r}", token.line, token.col)
        self.take()
        return method(self, token)

    def kind(self, default: str) -> str:
        if self.is_("kind") and self.ahead().text == "=":
            self.take()
            self.take()
            return self.name()
        return default

    def key(self) -> tuple[str, str]:
        left = self.name()
        if self.now.kind == "op" and self.now.text in ("==", "!=", "<", ">", "<=", ">=", "=~", "!~"):
            if not self.accept("=="):
                raise self.error("keys are compared by '=='")
            return left, self.name()
        return left, left

    def keys(self) -> tuple[tuple[str, str], ...]:
        self.need("on")
        return self.many(self.key)

    def op_where(self, _: Token) -> t.Op:
        return t.Where(self.expr())

    def op_extend(self, _: Token) -> t.Op:
        return t.Extend(self.many(self.assignment))

    def op_project(self, _: Token) -> t.Op:
        def item():
            name = self.assigned_name()
            return (name, self.expr()) if name else (self.name(), None)

        return t.Project(self.many(item))

    def op_arrange(self, token: Token) -> t.Op:
        return t.Arrange(token.text.split("-")[1], self.many(self.name))

    def op_rename(self, _: Token) -> t.Op:
        def pair():
            new = self.name()
            self.need("=")
            return new, self.name()

        return t.Rename(self.many(pair))

    def op_parse(self, token: Token) -> t.Op:
        kind = self.kind("simple")
        of = self.expr()
        self.need("with")
        segments = []
        while True:
            if self.now.kind == "string":
                segments.append(("text", self.string()))
            elif self.accept("*"):
                segments.append(("star",))
            elif self.now.kind == "name":
                name = self.name()
                segments.append(("column", name, self.name() if self.accept(":") else None))
            else:
                break
        if not segments:
            raise self.error("a pattern is needed here")
        return t.Parse(of, kind, tuple(segments), token.text == "parse-where")

    def op_parse_kv(self, _: Token) -> t.Op:
        of = self.expr()
        self.need("as")
        self.need("(")
        columns = self.many(self.declared)
        self.need(")")
        self.need("with")
        self.need("(")
        options = self.many(self.option)
        self.need(")")
        return t.ParseKv(of, columns, options)

    def op_evaluate(self, _: Token) -> t.Op:
        self.need("bag_unpack")
        self.need("(")
        name = self.name()
        prefix = self.string() if self.accept(",") else ""
        self.need(")")
        return t.BagUnpack(name, prefix)

    def op_lookup(self, token: Token) -> t.Op:
        kind = self.kind("leftouter")
        return t.Lookup(self.name(), kind, self.keys(), (token.line, token.col))

    def op_join(self, token: Token) -> t.Op:
        kind = self.kind("innerunique")
        if self.accept("("):
            right: str | t.Body = self.body()
            self.need(")")
        else:
            right = self.name()
        return t.Join(right, kind, self.keys(), (token.line, token.col))

    def op_union(self, _: Token) -> t.Op:
        def operand():
            if self.accept("("):
                body = self.body()
                self.need(")")
                return body
            return None if self.accept("source") else self.name()

        kind = self.kind("outer")
        return t.Union(kind, self.many(operand))

    def op_as(self, _: Token) -> t.Op:
        return t.As(self.name())

    def op_fork(self, _: Token) -> t.Op:
        branches = []
        while self.is_("(") or self.now.kind == "name" and self.ahead().text == "=":
            branches.append((self.assigned_name(), self.pipeline()))
        if not branches:
            raise self.error("a branch is needed here")
        return t.Fork(tuple(branches))

    def starts_pipeline(self) -> bool:
        after = self.ahead()
        return self.is_("(") and after.kind == "name" and after.text in OPERATORS and not (self.ahead(2).kind == "op" and self.ahead(2).text not in ("(", ")"))

    def op_case(self, _: Token) -> t.Op:
        self.need("(")
        arms: list = []
        while not self.starts_pipeline():
            test = self.expr()
            self.need(",")
            arms.append((test, self.pipeline()))
            self.need(",")
        if not arms:
            raise self.error("a condition is needed here")
        default = self.pipeline()
        self.need(")")
        return t.Case(tuple(arms), default)

    def op_partition(self, _: Token) -> t.Op:
        self.need("by")
        return t.Partition(self.name(), self.pipeline())

    def op_getschema(self, _: Token) -> t.Op:
        return t.GetSchema()

    def op_count(self, _: Token) -> t.Op:
        return t.Count()

    def op_sample(self, _: Token) -> t.Op:
        return t.Sample(self.whole())

    def op_sample_distinct(self, _: Token) -> t.Op:
        n = self.whole()
        self.need("of")
        return t.SampleDistinct(n, self.name())

    def op_serialize(self, _: Token) -> t.Op:
        return t.Serialize(self.many(self.assignment) if self.now.kind == "name" else ())

    def expanded(self) -> tuple[str, t.Expr | None]:
        name = self.name()
        return name, self.expr() if self.accept("=") else None

    def op_expand(self, _: Token) -> t.Op:
        index = None
        if self.is_("with_itemindex") and self.ahead().text == "=":
            self.take()
            self.take()
            index = self.name()
        columns = self.many(self.expanded)
        return t.Expand(columns, index, self.whole() if self.accept("limit") else None)

    def op_apply(self, _: Token) -> t.Op:
        columns = self.many(self.expanded)
        self.need("on")
        return t.Apply(columns, self.pipeline())

    def op_make_series(self, _: Token) -> t.Op:
        def agg():
            name, call = self.assignment()
            default = None
            if self.accept("default"):
                self.need("=")
                default = self.expr()
            return name, call, default

        aggs = () if self.is_("on") else self.many(agg)
        self.need("on")
        axis = self.name()
        start = self.expr() if self.accept("from") else None
        stop = self.expr() if self.accept("to") else None
        self.need("step")
        step = self.expr()
        return t.MakeSeries(aggs, axis, start, stop, step, self.named_keys() if self.accept("by") else ())

    def named_keys(self) -> tuple[t.Named, ...]:
        found = self.many(lambda: (self.assigned_name(), self.expr()))
        return tuple((name or (e.name if isinstance(e, t.Col) else f"Col{i}"), e) for i, (name, e) in enumerate(found, 1))

    def op_summarize(self, _: Token) -> t.Op:
        def agg():
            name, e = self.assigned_name(), self.expr()
            if name is None:
                first = e.args[0] if isinstance(e, t.Call) and e.args else None
                name = f"{e.name}_{first.name if isinstance(first, t.Col) else ''}" if isinstance(e, t.Call) else "agg_"
            return name, e

        aggs = () if self.is_("by", "|", ")") or self.now.kind == "end" else self.many(agg)
        return t.Summarize(aggs, self.named_keys() if self.accept("by") else ())

    def sort_key(self) -> tuple[t.Expr, bool]:
        e = self.expr()
        return e, not self.accept("asc") and (self.accept("desc") or True)

    def op_sort(self, _: Token) -> t.Op:
        self.need("by")
        return t.Sort(self.many(self.sort_key))

    def op_top(self, _: Token) -> t.Op:
        n = self.whole()
        self.need("by")
        return t.Sort(self.many(self.sort_key), n)

    def op_distinct(self, _: Token) -> t.Op:
        return t.Distinct(self.many(self.name))

    def op_take(self, _: Token) -> t.Op:
        return t.Take(self.whole())

    # --- expressions, from the weakest binding on

    def expr(self) -> t.Expr:
        left = self.conjunction()
        while self.accept("or"):
            left = t.Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> t.Expr:
        left = self.negation()
        while self.accept("and"):
            left = t.Binary("and", left, self.negation())
        return left

    def negation(self) -> t.Expr:
        return t.Unary("not", self.negation()) if self.accept("not") else self.comparison()

    def comparison(self) -> t.Expr:
        left = self.sum()
        token = self.now
        if self.accept("==", "!=", "<", "<=", ">", ">=", "=~", "!~"):
            return t.Binary(token.text, left, self.sum())
        if token.kind in ("name", "op") and token.text.lstrip("!") in STRING_OPS:
            if token.text in ("!has_any", "!has_all"):
                raise self.error("another comparison is needed here")
            self.take()
            return t.Binary(token.text, left, self.sum())
        if self.is_("matches") and self.ahead().text == "regex":
            self.take()
            self.take()
            return t.Binary("matches", left, self.sum())
        return left

    def sum(self) -> t.Expr:
        left = self.product()
        while self.is_("+", "-"):
            left = t.Binary(self.take().text, left, self.product())
        return left

    def product(self) -> t.Expr:
        left = self.unary()
        while self.is_("*", "/", "%"):
            left = t.Binary(self.take().text, left, self.unary())
        return left

    def unary(self) -> t.Expr:
        if self.accept("-"):
            of = self.unary()
            return t.Lit(-of.value, of.kind) if isinstance(of, t.Lit) and of.kind in ("long", "real", "timespan") else t.Unary("-", of)
        return self.postfix()

    def postfix(self) -> t.Expr:
        of = self.atom()
        while True:
            if self.accept("."):
                of = t.Member(of, t.Lit(self.name(), "string"))
            elif self.accept("["):
                of = t.Member(of, self.expr())
                self.need("]")
            else:
                return of

    def atom(self) -> t.Expr:
        token = self.now
        if token.kind == "number":
            self.take()
            real = any(c in token.text for c in ".eE")
            return t.Lit(float(token.text) if real else int(token.text), "real" if real else "long")
        if token.kind == "timespan":
            self.take()
            number, unit = re.fullmatch(r"([\d.]+)([a-z]+)", token.text).groups()
            unit = unit if unit in UNITS else unit.rstrip("s")
            return t.Lit(round(float(number) * UNITS[unit]), "timespan")
        if token.kind == "string":
            return t.Lit(self.string(), "string")
        if self.accept("("):
            items = self.many(self.expr)
            self.need(")")
            return items[0] if len(items) == 1 else t.Items(items)
        if token.kind == "name" and "-" not in token.text:
            self.take()
            if token.text in ("true", "false"):
                return t.Lit(token.text == "true", "bool")
            if token.text == "null":
                return t.Lit(None, "null")
            if self.accept("("):
                args = () if self.is_(")") else self.many(self.expr)
                self.need(")")
                return t.Call(token.text.lower(), args, (token.line, token.col))
            return t.Col(token.text)
        raise self.error("an expression is needed here")


OPERATORS = {
    "where": Parser.op_where, "filter": Parser.op_where, "extend": Parser.op_extend, "project": Parser.op_project,
    "project-away": Parser.op_arrange, "project-keep": Parser.op_arrange, "project-reorder": Parser.op_arrange, "project-rename": Parser.op_rename,
    "parse": Parser.op_parse, "parse-where": Parser.op_parse, "parse-kv": Parser.op_parse_kv, "evaluate": Parser.op_evaluate,
    "lookup": Parser.op_lookup, "join": Parser.op_join, "union": Parser.op_union, "as": Parser.op_as, "fork": Parser.op_fork, "case": Parser.op_case,
    "partition": Parser.op_partition, "getschema": Parser.op_getschema, "count": Parser.op_count, "sample": Parser.op_sample, "sample-distinct": Parser.op_sample_distinct,
    "serialize": Parser.op_serialize, "mv-expand": Parser.op_expand, "mvexpand": Parser.op_expand, "mv-apply": Parser.op_apply, "make-series": Parser.op_make_series,
    "summarize": Parser.op_summarize, "sort": Parser.op_sort, "order": Parser.op_sort, "top": Parser.op_top, "distinct": Parser.op_distinct, "take": Parser.op_take, "limit": Parser.op_take,
}


def parse(text: str) -> t.Query:
    """The syntax tree of a query; KqlCompileError tells what is wrong and where."""
    return Parser(text).query()
