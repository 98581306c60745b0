"""Name a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used several times inside conditional branches is otherwise generated, and run, once
    per use; long chains then also outgrow the size limit of generated code.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
