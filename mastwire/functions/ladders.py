"""Lookups in short sorted lists: recharge cards, packages, advance denominations.

The lists are catalogue settings of a few entries, so each lookup is an expression over an
array literal: no join and no shuffle, whatever the number of subscribers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(value: Column, steps) -> Column:
    """The closest step, the smaller one on a tie; a missing value has none."""
    ranked = F.transform(
        literal_array(sorted(steps)), lambda s: F.struct(F.abs(value - s).alias("gap"), s.alias("step"))
    )
    return F.when(value.isNotNull(), F.array_min(ranked)["step"])


def largest_within(ceiling: Column, steps, otherwise: float = 0.0) -> Column:
    """The largest step not above the ceiling, else the fallback."""
    fitting = F.filter(literal_array(steps), lambda s: s <= ceiling)
    return F.coalesce(F.array_max(fitting), F.lit(float(otherwise)))


def dearest_affordable(amount: Column, priced: list[tuple[float, str]]) -> Column:
    """The id of the dearest package the amount pays for, or of the cheapest if none.

    Equal prices resolve to the last of them in id order, as a right-sided search does.
    """
    ladder = sorted(priced)
    entries = F.array(
        *[F.struct(F.lit(float(price)).alias("price"), F.lit(key).alias("key")) for price, key in ladder]
    )
    payable = F.filter(entries, lambda e: e["price"] <= amount)
    return F.coalesce(F.array_max(payable)["key"], F.lit(ladder[0][1]))


def interval_number(value: Column, cutoffs: list[float] | None, neutral: int = 3) -> Column:
    """1 + how many cutoffs lie strictly below the value; without cutoffs the neutral number."""
    if cutoffs is None:
        return F.lit(neutral)
    below = F.filter(literal_array(cutoffs), lambda c: c < value)
    return F.when(value.isNotNull(), F.size(below) + 1)
