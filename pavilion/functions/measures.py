"""Mergeable, order-independent measures.

Float sums depend on task order, so a re-run after a lost executor could give
another last digit (and another row at a LIMIT tie). Rates are therefore summed
as whole units of eight decimals, wide enough that no sum overflows, and means
are one division of two exact integers. A rate that is no finite number, or is
10**10 or more, counts as missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, functions as F

FIXED_SCALE = 100_000_000
_LARGEST = 10.0**10  # rates beyond are no rates


def fixed(value: Column) -> Column:
    """Rate in whole units of 1 / FIXED_SCALE, as a decimal; NULL when not finite or too large."""
    units = F.floor(value.cast("double") * FIXED_SCALE + F.lit(0.5))
    return F.when(F.abs(value.cast("double")) < _LARGEST, units).cast("decimal(20,0)")


def fixed_value(total: Column) -> Column:
    return total.cast("double") / F.lit(FIXED_SCALE)


def mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n.cast("double"))


def fixed_mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), (n * FIXED_SCALE).cast("double"))


def half_up(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den (whole, not negative) rounded half up, by integer arithmetic; NULL when den is 0."""
    shift = 10**digits
    num, den = num.cast("decimal(28,0)"), den.cast("decimal(28,0)")
    units = F.call_function("div", num * F.lit(2 * shift) + den, F.nullif(den, F.lit(0)) * F.lit(2))
    return F.when(den != 0, (units.cast("double") / F.lit(shift)).cast(f"decimal(10,{digits})"))


def percent(part: Column, whole: Column) -> Column:
    return half_up(part * F.lit(100), whole)


def mean2(total: Column, n: Column) -> Column:
    """Mean as DECIMAL(10,2)."""
    return half_up(total, n)


def fixed_mean2(total: Column, n: Column) -> Column:
    return half_up(total, n * FIXED_SCALE)


def population_stddev(n: Column, total: Column, squares: Column) -> Column:
    """Exact moments (long n, sum, sum of squares) to population standard deviation."""
    wide = lambda c: c.cast("decimal(19,0)")
    spread = wide(n) * wide(squares) - wide(total) * wide(total)
    return F.try_divide(F.sqrt(spread.cast("double")), n.cast("double"))


@dataclass(frozen=True)
class Measure:
    """An aggregate with a partial form and a merge form."""

    name: str
    how: str
    of: Column | None = None

    def partial(self) -> Column:
        agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.how]
        return agg(F.lit(1) if self.of is None else self.of).alias(self.name)

    def merge(self) -> Column:
        agg = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[self.how]
        return agg(self.name).alias(self.name)


def rows(name: str) -> Measure:
    return Measure(name, "count")


def counted(name: str, of: Column) -> Measure:
    return Measure(name, "count", of)


def total(name: str, of: Column) -> Measure:
    return Measure(name, "sum", of)


def largest(name: str, of: Column) -> Measure:
    return Measure(name, "max", of)


def smallest(name: str, of: Column) -> Measure:
    return Measure(name, "min", of)


def mean_of(col: str) -> list[Measure]:
    """Sum and non-null count of a long column: ``<col>_sum``, ``<col>_n``."""
    return [total(f"{col}_sum", F.col(col)), counted(f"{col}_n", F.col(col))]


def rate_of(col: str) -> list[Measure]:
    """Same for a rate column, in fixed point."""
    return [total(f"{col}_sum", fixed(F.col(col))), counted(f"{col}_n", F.col(col))]


def new_match(*keys: str, match: str = "match_id") -> Column:
    """1 on one row of each match of the keys, else 0: its sum counts matches without a hash table of them.

    The rows are sorted by match and keys, which can spill; after a join by match they need no further shuffle.
    """
    place = F.row_number().over(Window.partitionBy(match, *keys).orderBy(match))
    return flag(place == 1)


def flag(cond: Column) -> Column:
    """1 when the condition is true, 0 when false or unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")
