"""Radio inventories: validation, deduplication, audits, measured service and site groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.functions.numeric import finite, is_true, rate_if
from mastwire.operators.geo import METRES_PER_DEGREE, _max_lat, haversine
from mastwire.operators.ordered import quantiles_by
from mastwire.operators.panel import keep_last
from mastwire.session import materialize

IDENTITY = ["radio", "mcc", "net", "area", "cell"]
RADIOS = ("GSM", "UMTS", "LTE", "CDMA", "NR")


def _whole(name: str) -> Column:
    c = F.col(name)
    return finite(c) & is_true(c >= 0) & is_true(c % 1 == 0)


def validate_cells(df: DataFrame, as_of: Column, country: int = 606) -> DataFrame:
    """Cell rows with reason codes, timestamp plausibility and review eligibility."""
    reasons = {
        "unknown_radio": ~F.col("radio").isin(*RADIOS),
        "invalid_identity": ~(_whole("mcc") & _whole("net") & _whole("area") & _whole("cell")),
        "other_country": ~is_true(F.col("mcc") == country),
        "invalid_coordinate": ~(is_true(F.col("lat").between(-90, 90)) & is_true(F.col("lon").between(-180, 180))),
    }
    codes = [F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in reasons.items()]
    out = df.withColumn("rejection_reason", F.concat_ws(";", *codes))
    now = F.unix_seconds(as_of)
    age = (now - F.col("updated")) / 86400.0
    plausible = is_true((F.col("created") > 0) & (F.col("updated") >= F.col("created")) & (F.col("updated") <= now))
    enough = is_true(F.col("samples") >= 2) & is_true(F.col("samples") % 1 == 0)
    return out.withColumns(
        {"timestamp_valid": plausible, "age_days": age, "review_eligible": plausible & enough & is_true(age.between(0, 730))}
    )


def latest_cells(valid: DataFrame, tie: str) -> DataFrame:
    """One row per identity: valid times first, then latest update, then most samples."""
    order = [
        F.col("timestamp_valid").cast("int"), F.coalesce(F.col("updated"), F.lit(float("-inf"))),
        F.coalesce(F.col("samples"), F.lit(float("-inf"))), F.col(tie),
    ]
    return keep_last(valid, IDENTITY, order)


def measurement_eligible(dbm: Column, accuracy: Column, neighbouring: Column) -> Column:
    return (
        is_true(dbm.between(-150, -20)) & is_true(accuracy.between(0, 100)) & ~is_true(neighbouring)
    )


def deduplicate_radios(df: DataFrame) -> DataFrame:
    """One row per (technology, region, site): location medians, spans and distinct lists.

    Sets of channels and bands are combined before the shuffle and stay small, since distinct ones
    are few. Medians come from counts of equal values in one global order, so a site with a third of all
    observations fills no task.
    """
    keys = ["rat", "region_id", "site_id"]
    out = df.groupBy(*keys).agg(
        F.count("*").alias("observation_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("band")).alias("bands"),
        F.sum("bandwidth").alias("listed_mhz"),
    )
    carriers = F.greatest(F.size("channels"), F.lit(1))
    by_default = (
        F.when(F.col("rat") == "LTE", F.when(F.col("bands") == F.array(F.lit(20)), 10.0).otherwise(20.0))
        .when(F.col("rat") == "UMTS", 5.0 * carriers)
        .otherwise(0.4 * carriers)
    )
    out = out.withColumns(
        {
            "total_bandwidth_mhz": F.bround(F.coalesce("listed_mhz", by_default), 1),
            "active_days": F.bround((F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400_000_000, 1),
        }
    )
    for c in ("longitude", "latitude"):
        out = out.join(quantiles_by(df, keys, c, {c: 0.5}), keys)
    return out


def latest_bandwidth(df: DataFrame) -> DataFrame:
    """The latest listing of each radio against the naive sum over repeats."""
    return df.groupBy("rat", "region_id", "site_id").agg(
        F.max_by("bandwidth", F.struct("ts", "event_id")).alias("latest_mhz"), F.sum("bandwidth").alias("naive_mhz")
    )


def colliding_keys(df: DataFrame, legacy: list[str], scope: list[str]) -> DataFrame:
    """Legacy keys that cover more than one network."""
    pairs = df.select(*legacy, *scope).distinct()
    return pairs.groupBy(*legacy).agg(F.count("*").alias("networks")).where(F.col("networks") > 1)


SERVICE_KEYS = ["mcc", "mnc", "net_type", "area_x", "area_y"]


def with_blocks(df: DataFrame, block: float, per_area: int) -> DataFrame:
    """Grid block and the larger area it belongs to."""
    x, y = F.floor(F.col("lon") / block), F.floor(F.col("lat") / block)
    return df.withColumns(
        {"block_x": x, "block_y": y, "area_x": F.floor(x / per_area), "area_y": F.floor(y / per_area)}
    )


def block_medians(df: DataFrame) -> DataFrame:
    """Median signal per day, device and block, so that standing still does not count twice."""
    return quantiles_by(df, [*SERVICE_KEYS, "day", "device", "block_x", "block_y"], "dbm", {"dbm": 0.5}, "samples")


def service_summary(df: DataFrame) -> DataFrame:
    """Block-weighted signal level per network, technology and area."""
    blocks = materialize(block_medians(df))
    levels = quantiles_by(blocks, SERVICE_KEYS, "dbm", {"median_dbm": 0.5, "p10_dbm": 0.1, "p90_dbm": 0.9})
    counts = blocks.groupBy(*SERVICE_KEYS).agg(
        F.sum("samples").alias("sample_count"), F.count_distinct("day").alias("day_count"),
        F.count_distinct("device").alias("device_count"), F.count_distinct("block_x", "block_y").alias("block_count"),
    )
    return counts.join(levels, SERVICE_KEYS)


def later_day_baseline(train: DataFrame, later: DataFrame) -> DataFrame:
    """Area medians of training days against block medians of later days: coverage, MAE, bias."""
    predicted = service_summary(train).select(*SERVICE_KEYS, F.col("median_dbm").alias("prediction"))
    scored = block_medians(later).join(predicted, SERVICE_KEYS, "left")
    error = F.col("prediction") - F.col("dbm")
    return scored.groupBy("net_type").agg(
        F.count("*").alias("holdout_blocks"), F.count("prediction").alias("matched_blocks"),
        F.bround(rate_if(F.col("prediction").isNotNull()) * 100, 2).alias("coverage_pct"),
        F.avg(F.abs(error)).alias("mae_db"), F.avg(error).alias("bias_db"),
    )


def choose_pilot(readings: DataFrame, supported: DataFrame | None = None, samples=20, blocks=3, cells=2) -> DataFrame:
    """The best-measured area that passes every threshold, and how many areas pass.

    `supported` lists areas (area_x, area_y) with a trusted site reference nearby; they come
    first, then days, blocks and cells decide.
    """
    identity = F.struct("mcc", "mnc", "net_type", "lac", "cell_id")
    areas = readings.groupBy("area_x", "area_y").agg(
        F.count("*").alias("samples"), F.count_distinct(F.struct("block_x", "block_y")).alias("blocks"),
        F.count_distinct("day").alias("days"), F.count_distinct(identity).alias("cells"),
    )
    able = areas.where((F.col("samples") >= samples) & (F.col("blocks") >= blocks) & (F.col("cells") >= cells))
    near = F.lit(False)
    if supported is not None:
        able = able.join(supported.distinct().withColumn("_near", F.lit(True)), ["area_x", "area_y"], "left")
        near = F.coalesce("_near", F.lit(False))
    able = able.withColumn("has_reference", near).drop("_near")
    passing = able.agg(F.count("*")).scalar()
    order = [F.col(c).desc() for c in ("has_reference", "days", "blocks", "cells")]
    return able.orderBy(*order, "area_x", "area_y").limit(1).withColumn("qualifying_areas", passing)


def distance_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares fit of signal on log10 distance per cell."""
    x, y = F.log10("distance_m"), F.col("dbm")
    return df.where(F.col("distance_m") > 0).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def connected_sites(points: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Components of points linked by hops of at most the radius: (key, component).

    Points in one cell narrower than radius/sqrt(2) are all linked, so cells are the nodes and
    no pairs inside a cell are listed. Two cells are linked when their closest points are in
    reach, found by comparing the places of neighbouring cells. Labels spread by
    taking the smallest of the neighbours' and jumping to the label's own label, so rounds
    grow with the logarithm of the longest chain.
    """


    step = radius_m / 1.4143 / METRES_PER_DEGREE


    stretch = 1.0 / math.cos(math.radians(min(_max_lat(points), 85.0)))
    cell = F.struct(F.floor(F.col("lon") / step).alias("x"), F.floor(F.col("lat") / step).alias("y"))
    placed = materialize(points.select(key, "lon", "lat", cell.alias("cell")))
    places = placed.select("lon", "lat", "cell").distinct()
    boxes = places.groupBy("cell").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    rx, ry = math.ceil(1.4143 * stretch), math.ceil(1.4143)
    ahead = [(i, j) for i in range(-rx, rx + 1) for j in range(-ry, ry + 1) if (i, j) > (0, 0)]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead])
    reach = boxes.withColumn("_at", F.explode(around)).select(
        F.col("cell").alias("a"), F.struct((F.col("cell.x") + F.col("_at.i")).alias("x"), (F.col("cell.y") + F.col("_at.j")).alias("y")).alias("b")
    )
    linked = reach.join(boxes.select(F.col("cell").alias("b")), "b")
    left = places.select(F.col("cell").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    right = places.select(F.col("cell").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    gap = haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    # Cells are a few tens of metres wide, so they hold few distinct locations.
    edges = linked.join(left, "a").join(right, "b").where(gap <= radius_m).select("a", "b").distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(boxes.select("cell", F.col("cell").alias("label")))
    while True:
        seen = edges.join(labels.withColumnRenamed("cell", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nxt = labels.join(seen.withColumnRenamed("a", "cell"), "cell", "left").select(
            "cell", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = labels.select(F.col("cell").alias("label"), F.col("label").alias("further"))
        nxt = nxt.join(jump, "label", "left").select("cell", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        nxt = materialize(nxt)
        labels = nxt.select("cell", "label")
        if not nxt.where(F.col("old") != F.col("label")).take(1):
            break
    members = placed.join(labels, "cell")
    names = members.groupBy("label").agg(F.min(key).alias("component"))
    return members.join(names, "label").select(key, "lon", "lat", "component")


def identity_matches(measured: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Measured identities against assets: matched once, ambiguous or missing."""
    mine = measured.groupBy(*keys).agg(F.count("*").alias("samples"))
    theirs = assets.groupBy(*keys).agg(F.count("*").alias("assets"))
    joined = mine.join(theirs, keys, "left")
    n = F.coalesce("assets", F.lit(0))
    return joined.agg(
        F.count("*").alias("identities"), F.count_if(n == 1).alias("matched_once"), F.count_if(n > 1).alias("ambiguous"),
        F.count_if(n == 0).alias("missing"),
    )


def readiness(df: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """Valid counts per engineering column, rows complete in all, and columns missing everywhere."""
    flags = {n: is_true(c) for n, c in valid.items()}
    complete = None
    for c in flags.values():
        complete = c if complete is None else complete & c
    return df.agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(f"valid_{n}") for n, c in flags.items()], F.count_if(complete).alias("complete_rows")
    )
