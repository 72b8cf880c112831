"""Evaluate a sub-expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    A column used inside a lambda is otherwise computed again for every element, and Spark may also copy it
    into a filter that it pushes down. A lambda variable is bound once, wherever the expression ends up.
    """
    return F.transform(F.array(value), body)[0]
