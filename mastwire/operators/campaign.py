"""Campaign review: proposals, appended decisions, released rows and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.functions.keys import row_hash
from mastwire.operators.retention import NO_OFFER

DECISIONS = ("approved", "rejected")


def snapshot_problems(rows: DataFrame) -> DataFrame:
    """Proposal rows that contradict themselves, with the reason."""
    status, offer = F.col("status"), F.col("recommended_offer_id")
    ineligible = (status == "proposed") & (
        F.col("holdout") | ~F.col("risk_band").isin("medium", "high")
        | (F.col("expected_cost_lyd") <= 0) | (F.col("expected_net_value_lyd") <= 0)
    )
    problem = (
        F.when(~status.isin("proposed", "no_offer"), "reviewed status in a snapshot")
        .when((status == "no_offer") != (offer == NO_OFFER), "status and offer disagree")
        .when(ineligible, "ineligible proposal")
    )
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("subscriber_id", "problem")


def review_problems(events: DataFrame, rows: DataFrame, campaign_id: str) -> DataFrame:
    """Review events that may not be applied: wrong campaign, no reviewer, repeated, not pending.

    Repeats are counted by aggregation on the subscriber, then joined back only to events.
    """
    repeated = events.groupBy("subscriber_id").agg(F.count("*").alias("_times"))
    pending = rows.where(F.col("status") == "proposed").select("subscriber_id", F.lit(True).alias("_pending"))
    joined = events.join(repeated, "subscriber_id", "left").join(pending, "subscriber_id", "left")
    problem = (
        F.when(F.col("campaign_id") != campaign_id, "another campaign")
        .when(~F.col("decision").isin(*DECISIONS), "unknown decision")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no reviewer")
        .when(F.col("_times") > 1, "resolved more than once")
        .when(F.col("_pending").isNull(), "not a pending proposal")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("subscriber_id", "problem")


def reviewed_rows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Proposals with the decision, reviewer, time and note of their review, where there is one."""
    review = events.select(
        "subscriber_id", "decision", "reviewer", "reviewed_at", F.col("note").alias("review_note")
    )
    joined = rows.join(review, "subscriber_id", "left")
    return joined.withColumn("status", F.coalesce("decision", "status")).drop("decision")


def released(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "approved")


def released_offers(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Approved rows whose offer is still sold, with its price."""
    offers = catalogue.select(F.col("offer_id").alias("recommended_offer_id"), "price_lyd")
    return released(rows).join(offers, "recommended_offer_id")


def withheld(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Approvals whose offer left the catalogue, counted per offer."""
    offers = catalogue.select(F.col("offer_id").alias("recommended_offer_id"))
    gone = released(rows).join(offers, "recommended_offer_id", "left_anti")
    return gone.groupBy("recommended_offer_id").agg(F.count("*").alias("withheld"))


def fingerprint(rows: DataFrame, columns: list[str], key: str = "snapshot") -> DataFrame:
    """One order-independent digest of a snapshot: the row count and sums of all eight words of the row hashes.

    Nothing is gathered in one place; equal snapshots agree in any row order and partitioning.
    The row hashes depend on the key, so rows cannot be made to measure without it.
    """
    hashed = rows.select(row_hash(*[F.col(c) for c in columns], key=key).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    total = hashed.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)])
    parts = [F.col(c).cast("string") for c in ("n", *(f"w{i}" for i in range(8)))]
    return total.select("n", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def with_open_orders(alerts: DataFrame, orders: DataFrame) -> DataFrame:
    """Alerts with whether a work order is open for the tower."""
    open_towers = orders.where(F.col("state") == "open").select("tower").distinct()
    marked = open_towers.withColumn("_open", F.lit(True))
    return alerts.join(marked, "tower", "left").withColumn(
        "has_open_order", F.coalesce("_open", F.lit(False))
    ).drop("_open")


def compare_snapshots(before: DataFrame, after: DataFrame, key: str, value: str, fixed: list[str]) -> DataFrame:
    """Counts of shared, added and removed keys, changed values and broken fixed columns."""
    old = before.select(key, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in [value, *fixed]])
    new = after.select(key, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in [value, *fixed]])
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    delta = F.col(f"a_{value}") - F.col(f"b_{value}")
    broken = F.lit(False)
    for c in fixed:
        broken = broken | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return old.join(new, key, "full").agg(
        F.count_if(both).alias("shared"),
        F.count_if(F.col("_b").isNull()).alias("added"),
        F.count_if(F.col("_a").isNull()).alias("removed"),
        F.count_if(both & (delta != 0)).alias("changed"),
        F.avg(F.when(both, delta)).alias("mean_delta"),
        F.count_if(both & broken).alias("fixed_columns_changed"),
    )


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on both lists, only the first and only the second, from one full join."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
        F.count_if(F.col("_a").isNull()).alias("added"),
        F.count_if(F.col("_b").isNull()).alias("removed"),
    )


def summary_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """Named one-number frames as rows (id, value, available); a missing one stays a row."""
    rows = None
    for name, frame in parts.items():
        value = frame.columns[0]
        row = frame.agg(F.max(F.col(value).cast("double")).alias("value")).select(
            F.lit(name).alias("id"), "value", F.col("value").isNotNull().alias("available")
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
