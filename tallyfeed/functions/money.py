"""Integer money: the one division, and int64 limits, for columns and for plain integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MAX, INT64_MIN = (1 << 63) - 1, -(1 << 63)


def fits(x: int) -> bool:
    return INT64_MIN <= x <= INT64_MAX


def relieve(total_cost: int, sold: int, held: int) -> int:
    """total_cost * sold / held, half to even. 0 <= sold <= held and held > 0 are the caller's to keep."""
    if held <= 0 or not 0 <= sold <= held or total_cost < 0:
        raise ValueError(f"relieve({total_cost}, {sold}, {held})")
    q, r = divmod(total_cost * sold, held)
    return q + (2 * r > held or (2 * r == held and q % 2 == 1))


def relieve_column(total_cost: Column, sold: Column, held: Column) -> Column:
    """``relieve`` of bigint columns: exact in decimal(38,0), where no product of int64 values overflows."""
    x = total_cost.cast("decimal(19,0)") * sold.cast("decimal(19,0)")
    t = held.cast("decimal(38,0)")
    q, twice = F.call_function("div", x, t), 2 * (x % t)
    return (q + F.when(twice > t, 1).when(twice < t, 0).otherwise(F.pmod(q, F.lit(2)))).cast("bigint")
