"""Global order at scale: ranks, running totals and exact quantiles without a one-task sort.

A window without a partition pulls every row into one task. Here rows are placed by range,
so each partition holds one stretch of the order; partition totals (one row per partition)
give each stretch its offset, and only the local part of the sum runs inside a partition.
Ties are split by the later sort keys, so one very common value cannot fill a partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.session import materialize

PART = "_part"


def placed_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned by the order and stored, with the stretch they belong to.

    The range bounds come from a sample, so the placement is stored before it is used twice.
    """
    stretches = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(stretches, *order)
    return materialize(placed.withColumn(PART, F.spark_partition_id()))


def with_running(
    df: DataFrame,
    order: list[Column],
    rank: str | None = "rank",
    sums: dict[str, Column] | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """Add the 1-based global rank and running totals (through the row) in the given order.

    The order must end in a unique key. Totals should be whole numbers or decimals.
    """
    sums = dict(sums or {})
    if rank:
        sums[rank] = F.lit(1).cast("bigint")
    placed = placed_in_order(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), order)
    totals = placed.groupBy(PART).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per stretch: this window sees as many rows as there are partitions.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(PART),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    local = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(local) for n in sums})
    out = out.join(F.broadcast(offsets), PART)
    out = out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums})
    drop = [f"{p}{n}" for n in sums for p in ("_v_", "_l_", "_o_")]
    return out.drop(*drop, *([] if keep_part else [PART]))


def quantiles_by(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], count: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, for groups of any size.

    Equal values are counted first (combined before the shuffle); the counts are then put in
    one global order, so a group holding a third of all rows is spread over many tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = with_running(
        counts, [*[F.col(k).asc() for k in by], F.col(value).asc()], None, {"_cum": F.col("_n")}
    )
    first = run.groupBy(*by).agg(
        F.min(F.col("_cum") - F.col("_n")).alias("_start"), F.sum("_n").alias("_total")
    )
    if not by:
        edges = first.first()
        total = edges["_total"] or 0
        joined = run.withColumns({"_start": F.lit(0), "_total": F.lit(total)})
    else:
        joined = run.join(null_safe(first, by), null_safe_on(run, by)).drop(*[f"_r_{k}" for k in by])
    low = F.col("_cum") - F.col("_n") - F.col("_start")
    high = F.col("_cum") - F.col("_start")
    picks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(
                F.max(F.when((index >= low) & (index < high), F.col(value))).alias(f"_{name}_{side}")
            )
    picked = joined.groupBy(*by).agg(*picks, F.max("_total").alias("_total"))
    out = [
        (
            F.col(f"_{n}_lo")
            + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))
            * ((F.col("_total") - 1) * F.lit(float(p)) - F.floor((F.col("_total") - 1) * F.lit(float(p))))
        ).alias(n)
        for n, p in probs.items()
    ]
    if count:
        out.append(F.col("_total").alias(count))
    return picked.select(*by, *out)


def null_safe(right: DataFrame, keys: list[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def null_safe_on(left: DataFrame, keys: list[str]) -> Column:
    """Join condition under which a missing key meets a missing key, as pandas groups do."""
    out = None
    for k in keys:
        term = left[k].eqNullSafe(F.col(f"_r_{k}"))
        out = term if out is None else out & term
    return out


def quantile_values(df: DataFrame, value: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of a whole column as numbers to freeze; a few rows reach the driver."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = quantiles_by(df, [], value, names).first()
    return [None if row is None else row[n] for n in names]


def share_size(share: float, total: int) -> int:
    """How many of the total a share means: rounded half to even, at least one."""
    return max(int(round(share * total)), 1)


def floor_index(ratio: float, total: int) -> int:
    return int(math.floor(ratio * total))
