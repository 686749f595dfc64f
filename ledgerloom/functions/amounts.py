"""Three amount readings that differ on purpose: extracted, contract and ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.binding import let
from ledgerloom.schemas import AMOUNT

_PLAIN_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _exact(text: Column) -> Column:
    """Decimal reading of a plain number, NULL for anything else or beyond 20 whole digits."""
    return let(text, lambda t: F.when(t.rlike(_PLAIN_NUMBER), t.try_cast("decimal(38,18)")))


def _drop(text: Column, *marks: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def _comma_is_last(text: Column) -> Column:
    backwards = F.reverse(text)
    return F.instr(backwards, ",") < F.instr(backwards, ".")


def _tail_length(text: Column, mark: str) -> Column:
    return F.length(F.substring_index(text, mark, -1))


def latam_amount(raw: Column) -> Column:
    """Printed amount to decimal(20,2), half-even; NULL when unreadable.

    With both separators the rightmost is the decimal one. A lone comma is
    decimal only before exactly two digits; a lone dot is a thousands mark
    before three or more.
    """

    def read(text: Column) -> Column:
        comma, dot = text.contains(","), text.contains(".")
        decimal_comma = F.replace(_drop(text, "."), F.lit(","), F.lit("."))
        two_after_comma = F.concat(
            _drop(F.left(text, F.length(text) - 3), ","), F.lit("."), F.right(text, F.lit(2))
        )
        plain = (
            F.when(comma & dot, F.when(_comma_is_last(text), decimal_comma).otherwise(_drop(text, ",")))
            .when(comma, F.when(_tail_length(text, ",") == 2, two_after_comma).otherwise(_drop(text, ",")))
            .when(dot & (_tail_length(text, ".") >= 3), _drop(text, "."))
            .otherwise(text)
        )
        return F.bround(_exact(plain), 2).try_cast(AMOUNT)

    return let(_drop(F.trim(raw), "$", " ", "COP", "USD"), read)


def contract_amount(raw: Column) -> Column:
    """Contract reading: every comma is a dot, empty is zero; NULL when invalid."""
    text = F.replace(_drop(F.trim(raw), " "), F.lit(","), F.lit("."))
    zero = F.lit("0")
    return _exact(let(text, lambda t: F.when(t != "", t).otherwise(zero))).try_cast("decimal(30,10)")


def ledger_money(raw: Column) -> Column:
    """Ledger reading: non-negative money, half-up; a missing amount is 0.00.

    NULL marks a rejected amount (empty, sign only, not a number, negative).
    """

    def read(text: Column) -> Column:
        both = text.contains(",") & text.contains(".")
        plain = (
            F.when(both & _comma_is_last(text), F.replace(_drop(text, "."), F.lit(","), F.lit(".")))
            .when(both, _drop(text, ","))
            .otherwise(F.replace(text, F.lit(","), F.lit(".")))
        )
        return let(_exact(plain), lambda value: F.when(value >= 0, F.round(value, 2).try_cast(AMOUNT)))

    return F.when(raw.isNull(), F.lit("0.00").cast(AMOUNT)).otherwise(
        let(_drop(F.trim(raw), " ", "\u00a0"), read)
    )
