"""The registry of scalar functions, and functions written in Python."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import KINDS, SPARK, Val, convert, plain, to_text

#: name -> builder(context, *values) -> value
FUNCTIONS: dict[str, Callable[..., Val]] = {}


def register(*names: str):
    def keep(builder):
        for name in names:
            FUNCTIONS[name.lower()] = builder
        return builder

    return keep


def batched(function: Callable[[Any], Any], returns: str):
    """A Python function of one text as a column function that works on Arrow batches; errors give null."""

    def safe(x: Any) -> Any:
        try:
            return function(x)
        except Exception:
            return None

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([safe(x) for x in values.to_pylist()], {"string": pa.string(), "double": pa.float64()}[returns])

    return run


def json_of(column: Column) -> Val:
    """JSON text as a dynamic value."""
    return Val(plain(F.try_parse_json(column)), "dynamic")


def _rendered(value: Any) -> Any:
    return value if isinstance(value, (str, int, float, bool, list, dict, type(None))) else str(value)


def user_function(name: str, returns: str = "dynamic"):
    """Registers a Python function under `name` (any case) for queries compiled later; a built-in of that name is hidden.

    It gets plain Python values. `returns` names the kind of its result; a dynamic result may be anything that JSON can say.
    An exception gives null, or ends the query with `strict_types`."""

    def keep(function: Callable[..., Any]) -> Callable[..., Any]:
        def build(context, *args: Val) -> Val:
            strict = context.options.strict_types
            kinds = [a.kind for a in args]

            @F.arrow_udf("string")
            def run(*columns: pa.Array) -> pa.Array:
                out = []
                for row in zip(*(c.to_pylist() for c in columns), strict=True):
                    try:
                        values = [x if x is None or kinds[i] in ("string", "datetime", "null") else json.loads(x) for i, x in enumerate(row)]
                        out.append(json.dumps(function(*values[: len(kinds)]), default=_rendered))
                    except Exception as e:
                        if strict:
                            raise ValueError(f"the function {name} failed: {e}") from e
                        out.append(None)
                return pa.array(out, pa.string())

            passed = [a.col if a.kind in ("string", "null") else F.to_json(a.col) if a.variant else to_text(a) for a in args]
            value = json_of(run(*(passed or [F.lit("0")])))
            kind = KINDS.get(returns, returns)
            return value if kind not in SPARK or kind == "dynamic" else convert(value, returns)

        FUNCTIONS[name.lower()] = build
        return function

    return keep
