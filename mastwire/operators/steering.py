"""Congestion scoring and traffic steering between towers of one cluster."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.functions.numeric import clip, half_even
from mastwire.functions.text import name_letters
from mastwire.session import materialize

MIN_CAPACITY = 15.0
CONGESTED = ("CRITICAL", "HIGH")


def capacity_ceilings(history: DataFrame) -> DataFrame:
    """95th percentile of users per tower, never below the floor.

    A tower has one row per day, so the exact percentile state is bounded by days.
    """
    peak = F.percentile("users", F.lit(0.95))
    return history.groupBy("tower").agg(F.greatest(peak, F.lit(MIN_CAPACITY)).alias("capacity_95th"))


def with_own_ceiling(history: DataFrame) -> DataFrame:
    """The same ceiling beside every day of the tower, so that the history is read once."""
    peak = F.percentile("users", F.lit(0.95)).over(Window.partitionBy("tower"))
    return history.withColumn("capacity_95th", F.greatest(peak, F.lit(MIN_CAPACITY)))


def congestion_tier(risk: Column, download: Column) -> Column:
    return (
        F.when((risk >= 80.0) & (download < 5.0), "CRITICAL")
        .when((risk >= 70.0) & (download < 8.0), "HIGH")
        .when(risk >= 60.0, "MODERATE")
        .otherwise("NORMAL")
    )


def _opened(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, wherever they are used afterwards."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def congestion_scores(forecast: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """Load, headroom, a 0-100 congestion risk and its tier for every tower and day.

    Without `capacity` the rows bring their ceiling in `capacity_95th`. Load and risk are opened from
    an array: as plain columns their roundings would be repeated in every later condition on the tier.
    """
    out = forecast if capacity is None else forecast.join(capacity, "tower", "left")
    users, cap = F.col("users"), F.col("capacity_95th")
    out = _opened(out, {"load_factor": half_even(users / cap, 3), "headroom": half_even(cap - users, 2)})
    risk = (
        0.50 * clip(F.col("load_factor") * 100.0, 0, 100)
        + 0.40 * clip((15.0 - F.col("download")) / 15.0 * 100.0, 0, 100)
        + 0.10 * clip(F.col("drop_rate") / 2.0 * 100.0, 0, 100)
    )
    out = _opened(out, {"risk": half_even(risk, 1)})
    return out.withColumn("category", congestion_tier(F.col("risk"), F.col("download")))


def with_cluster(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the original tower name and its naming cluster; unmapped towers keep a missing one.

    The map has one row per physical tower. It is left to the planner whether to broadcast
    it, by its measured size.
    """
    named = mapping.select("tower", "original_name", name_letters(F.col("original_name"), "OTHER").alias("cluster"))
    return df.join(named, "tower", "left")


def cluster_capacity(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.count_distinct("tower").alias("total_towers"),
        half_even(F.avg("users"), 2).alias("avg_users_per_tower"),
        half_even(F.max("users"), 2).alias("peak_tower_users"),
        half_even(F.avg("download"), 2).alias("avg_speed_mbps"),
        half_even(F.avg("risk"), 2).alias("avg_congestion_risk"),
        half_even(F.sum("headroom"), 2).alias("total_cluster_headroom"),
    )


OFFLOAD_SCHEMA = (
    "date date, cluster string, donor string, donor_category string, donor_risk double, "
    "donor_users double, donor_speed double, acceptor string, acceptor_speed double, "
    "acceptor_headroom double, shifted bigint"
)


def _steer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hand out headroom in rows sorted by day and cluster, acceptors before donors.

    Acceptors wait in a heap by headroom x speed; one below four users of headroom never
    returns, because headroom only falls. Donors pass by in their order and are not kept.
    """
    names = [field.split()[0] for field in OFFLOAD_SCHEMA.split(", ")]
    unit, heap, left, speed = None, [], {}, {}
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            if (row.date, row.cluster) != unit:
                unit, heap, left, speed = (row.date, row.cluster), [], {}, {}
            if row.is_acceptor:
                left[row.tower], speed[row.tower] = row.headroom, row.download
                heapq.heappush(heap, (-row.headroom * row.download, row.tower))
            elif heap:
                _, best = heapq.heappop(heap)
                room = left[best]
                shifted = max(int(min(row.users * 0.25, room * 0.40)), 3)
                found.append((row.date, row.cluster, row.tower, row.category, row.risk, row.users,
                              row.download, best, speed[best], room, shifted))
                left[best] = room - shifted
                if left[best] >= 4.0:
                    heapq.heappush(heap, (-left[best] * speed[best], best))
        yield pd.DataFrame(found, columns=names)


def offload_plan(scored: DataFrame) -> DataFrame:
    """Recommended handover offsets: congested towers to neighbours with headroom.

    Headroom is shared only inside a cluster on one day, so that pair is the whole unit of
    work: at most one row per tower of the cluster. Only donors and acceptors travel, once;
    a cluster-day without both passes by without a result. In a large cluster-day the task
    streams its rows and keeps the acceptors with headroom left, a few numbers each.
    """
    donor = F.col("category").isin(*CONGESTED)
    acceptor = (
        F.col("category").isin("NORMAL", "MODERATE")
        & (F.col("load_factor") < 0.70)
        & (F.col("headroom") >= 5.0)
        & (F.col("download") >= 8.0)
        & (F.col("availability") >= 95.0)
    )
    active = scored.withColumns(
        {"is_donor": F.coalesce(donor, F.lit(False)), "is_acceptor": F.coalesce(acceptor, F.lit(False))}
    ).where((F.col("is_donor") | F.col("is_acceptor")) & F.col("cluster").isNotNull())
    needed = active.select(
        "date", "cluster", "tower", "category", "risk", "users", "download", "headroom", "is_donor", "is_acceptor"
    )
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = needed.repartition(tasks, "date", "cluster").sortWithinPartitions(
        "date", "cluster", F.col("is_acceptor").desc(), F.col("risk").desc(), "download", "tower"
    )
    plan = ordered.mapInPandas(_steer, OFFLOAD_SCHEMA)
    shifted, users, speed = F.col("shifted"), F.col("donor_users"), F.col("donor_speed")
    step = F.when(shifted >= 10, 3).when(shifted >= 6, 2).otherwise(1)
    after = half_even(speed * (users / F.greatest(users - shifted, F.lit(1.0))), 2)
    return plan.withColumns(
        {
            "priority": F.when(shifted >= 10, "HIGH").when(shifted >= 6, "MEDIUM").otherwise("LOW"),
            "action": F.concat(
                F.lit("Configure Cell Individual Offset (CIO) +"), step.cast("string"),
                F.lit(" dB Handover Offset towards "), F.col("acceptor"),
            ),
            "donor_speed_after": after,
            "qoe_boost_pct": half_even((after - speed) / speed * 100, 1),
        }
    )


def steering_summary(alerts: DataFrame, plan: DataFrame) -> DataFrame:
    """Window bounds, alerted towers and counts by tier and priority, overall and latest day.

    The alerts are read several times, so they are kept; the plan is counted in one pass.
    """
    alerts = materialize(alerts.select("date", "tower", "category"))
    latest = alerts.agg(F.max("date")).scalar()
    side = alerts.withColumn("_today", F.col("date") == latest).agg(
        F.min("date").alias("window_start"),
        F.max("date").alias("window_end"),
        F.count_distinct("tower").alias("towers_with_alerts"),
        *[F.count_if(F.col("category") == c).alias(f"alerts_{c.lower()}") for c in CONGESTED],
        *[
            F.count_if(F.col("_today") & (F.col("category") == c)).alias(f"latest_{c.lower()}")
            for c in CONGESTED
        ],
    )
    counts = plan.withColumn("_today", F.col("date") == latest).agg(
        *[F.count_if(F.col("priority") == p).alias(f"plans_{p.lower()}") for p in ("HIGH", "MEDIUM", "LOW")],
        F.count_if("_today").alias("latest_plans"),
    )
    # One row on each side.
    return side.crossJoin(counts)


def latest_recommendations(rows: DataFrame, priority: str | None = None, limit: int = 100) -> DataFrame:
    """The latest day's rows, riskiest first, with the total that matched."""
    today = rows.where(F.col("date") == rows.agg(F.max("date")).scalar())
    if priority:
        today = today.where(F.col("priority") == priority)
    total = today.agg(F.count("*")).scalar()
    return today.orderBy(F.col("risk").desc(), F.col("tower")).limit(limit).withColumn("total", total)
