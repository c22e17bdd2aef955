"""Comparison and date helpers over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a comparison; a plain cast would also take ' 5' and '5d'.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """The number that a string column holds, NULL for other text."""
    return F.when(c.rlike(NUMBER), c.cast("double"))


def compared(a: Column, b: Column, op: str) -> Column:
    """``a op b``, as numbers if both are numbers, else by bytes; NULL counts as false in a filter."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), ops[op](x, y)).otherwise(ops[op](a, b))


def live(at: Column, start: Column, end: Column) -> Column:
    """Whether a date is in the closed window [start, end]; NULL ends are open."""
    return (start.isNull() | compared(at, start, ">=")) & (end.isNull() | compared(at, end, "<="))


def windows_overlap(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Whether two half-open truth windows overlap; NULL ends are open."""
    apart = F.coalesce(compared(a_until, b_from, "<="), F.lit(False)) | F.coalesce(compared(b_until, a_from, "<="), F.lit(False))
    return ~apart


def date_floor(d: Column) -> Column:
    """The first day that a partial date denotes."""
    return F.when(F.length(d) == 4, F.concat(d, F.lit("-01-01"))).when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d)


def date_ceil(d: Column) -> Column:
    """A bound from above of a partial date; months end on -31, which only ever is compared as text."""
    return F.when(F.length(d) == 4, F.concat(d, F.lit("-12-31"))).when(F.length(d) == 7, F.concat(d, F.lit("-31"))).otherwise(d)


def in_window(d: Column, start: Column, end: Column) -> Column:
    """Whether the interval of a partial date overlaps that of a window with partial bounds."""
    return (date_ceil(d) >= date_floor(start)) & (date_floor(d) <= date_ceil(end))


def shifted(d: Column, years: Column, months: Column, days: Column) -> Column:
    """A DATE moved by calendar units that overflow rather than clamp: 31 January plus a month is 3 March."""
    first = F.add_months(F.trunc(d, "MM"), (years * 12 + months).cast("int"))
    return F.date_add(first, (F.dayofmonth(d) - 1 + days).cast("int"))


def sort_keys(c: Column, descending: bool = False) -> list[Column]:
    """Order for one declared key: absent last either way, numbers by value before other text by bytes.

    Mixed comparison of numbers and text isn't transitive, so numbers stand together; this is a total order.
    """
    n = number(c)
    keys = [c.isNull().asc()]
    if descending:
        return [*keys, n.isNull().desc(), n.desc_nulls_last(), c.desc_nulls_last()]
    return [*keys, n.isNull().asc(), n.asc_nulls_last(), c.asc_nulls_last()]
