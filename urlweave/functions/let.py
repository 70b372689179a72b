"""Small helpers for column expressions.

A Python function that uses a Column argument twice puts the whole expression into the plan twice. ``let`` and ``lets``
bind a value to a lambda variable instead, so that expressions stay small and are worked out once for a row. A
Python UDF can stand in a bound value, but not in a body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def lets(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of named values that are worked out once."""
    return let(F.struct(*(v.alias(n) for n, v in values.items())), lambda s: body(**{n: s[n] for n in values}))


def require(ok: Column, code: str, value: Column) -> Column:
    """``value`` where ``ok``; an error that names the code where not; null where ``ok`` is null."""
    return F.when(ok, value).when(~ok, F.raise_error(F.lit(code)))


def after_first(text: Column, sep: str) -> Column:
    """What follows the first ``sep``; "" without one."""

    def body(x: Column) -> Column:
        at = F.instr(x, sep)
        return F.when(at > 0, F.substring(x, at + len(sep), F.length(x))).when(at == 0, F.lit(""))

    return let(text, body)


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))
