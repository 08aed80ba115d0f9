"""Range and conditional aggregates of worksheets over columns of any size (A1 to A10)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.numbers import parse_number

_CRITERION = re.compile(r"(<>|<=|>=|=|<|>)?(.*)$", re.DOTALL)


def criterion(value: Column, condition: str, numeric: bool = True) -> Column:
    """A10: ``value`` against a condition such as ``>=10`` or ``<>paid``, parsed when the plan is made.

    Numbers are compared where both sides are numbers, else texts without case; no wildcards; null is blank.
    """
    op, rhs = _CRITERION.match(condition).groups()
    rhs_number = None
    try:
        rhs_number = float(rhs.replace(" ", "").replace(",", ".")) if rhs.strip() else None
    except ValueError:
        pass

    def holds(a: Column, b: Column) -> Column:
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op or "="]

    as_text = holds(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit(rhs.lower()))
    if rhs_number is None:
        return as_text
    if numeric:
        return F.when(value.isNull(), as_text).otherwise(holds(value.cast("double"), F.lit(rhs_number)))
    number = parse_number(value)
    return F.when(number.isNotNull() & (F.trim(value) != ""), holds(number, F.lit(rhs_number))).otherwise(as_text)


def sheet_sum(v: Column) -> Column:
    """A1: the sum of the numbers; 0 if there are none."""
    return F.coalesce(F.sum(v), F.lit(0.0))


def sheet_average(v: Column) -> Column:
    """A2: null (``#DIV/0!``) if there are none."""
    return F.avg(v)


def sheet_min(v: Column) -> Column:
    """A3: 0 if there are none."""
    return F.coalesce(F.min(v), F.lit(0.0))


def sheet_max(v: Column) -> Column:
    """A3: 0 if there are none."""
    return F.coalesce(F.max(v), F.lit(0.0))


def count_numbers(v: Column) -> Column:
    """A4."""
    return F.count(v)


def count_filled(text: Column) -> Column:
    """A5, COUNTA."""
    return F.count_if(F.coalesce(text, F.lit("")) != "")


def count_blank(text: Column) -> Column:
    """A5, COUNTBLANK."""
    return F.count_if(F.coalesce(text, F.lit("")) == "")


def all_true(v: Column) -> Column:
    """True over nothing; blanks are false."""
    return F.coalesce(F.every(F.coalesce(v, F.lit(False))), F.lit(True))


def any_true(v: Column) -> Column:
    """False over nothing."""
    return F.coalesce(F.some(F.coalesce(v, F.lit(False))), F.lit(False))


def sum_if(tested: Column, condition: str, summed: Column, numeric: bool = True) -> Column:
    """A7."""
    return F.coalesce(F.sum(F.when(criterion(tested, condition, numeric), summed)), F.lit(0.0))


def count_if(tested: Column, condition: str, numeric: bool = True) -> Column:
    """Blanks never count."""
    filled = tested.isNotNull() & (tested.cast("string") != "")
    return F.count_if(filled & criterion(tested, condition, numeric))


def average_if(tested: Column, condition: str, averaged: Column, numeric: bool = True) -> Column:
    """Null (``#DIV/0!``) if nothing matches."""
    return F.avg(F.when(criterion(tested, condition, numeric), averaged))


def gathered(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The ``values`` of each key in order, such as the marks of a page; null values are left out.

    A key's values come together in one row, so keys must be as fine as pages are.
    """
    one = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), one))), lambda s: s["v"]).alias("values"))


AGGREGATES: dict[str, Callable[[Column], Column]] = {"SUM": sheet_sum, "AVERAGE": sheet_average, "MIN": sheet_min, "MAX": sheet_max, "COUNT": count_numbers, "COUNTA": count_filled}


def auto_function(name: str, first_cell: Column, last_cell: Column) -> Column:
    """Q21: the formula written below a selection."""
    return F.concat(F.lit(f"{name.upper()}("), first_cell, F.lit(":"), last_cell, F.lit(")"))
