"""Small helpers for building larger column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A one-element ``transform`` binds the value, so a regex is not run again
    for each mention, and inside ``coalesce`` / ``when`` it stays lazy.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(values: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """First kept element of an array, NULL when there is none."""
    return F.get(F.filter(values, keep or (lambda v: v.isNotNull())), F.lit(0))


def found(text: Column, regex: str | Column, group: int | Column = 1) -> Column:
    """First capture of ``regex``, a pattern or a column of patterns; NULL (not an empty string) on a miss."""
    # Bound, as NULLIF names its argument twice and so would match twice.
    return let(F.call_function("regexp_extract", text, F.lit(regex), F.lit(group)), lambda hit: F.when(hit != "", hit))


def settle(rows: DataFrame) -> DataFrame:
    """Finish the columns here, so that no later filter copies their expressions.

    A generator over a one-element array returns the same rows; predicates and
    projections above it then work on plain columns.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expressions a builder makes, per application and arguments.

    An expression only names its columns, so it can serve any number of plans;
    building the larger ones anew takes hundreds of calls into the JVM.
    """
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def expression(*args) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return expression
