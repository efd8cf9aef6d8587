"""Context for candidate sites: land cover, buildings, services, evidence and class rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.functions.numeric import half_even, once, settled
from mastwire.operators.geo import assign_areas, nearest, polygon_area_m2, radius_sums, tasks
from mastwire.session import materialize


def class_shares(pixels: DataFrame, cell: list[str], kind: str, area: str, classes: list) -> DataFrame:
    """Share of each land-cover class per cell, the largest class and whether review is needed."""
    totals = [F.sum(F.when(F.col(kind) == c, F.col(area)).otherwise(0.0)).alias(f"class_{c}") for c in classes]
    out = pixels.groupBy(*cell).agg(F.sum(area).alias("_all"), *totals)
    shares = {f"class_{c}": F.col(f"class_{c}") / F.col("_all") for c in classes}
    out = out.withColumns(shares)
    best = F.greatest(*[F.struct(F.col(f"class_{c}").alias("share"), F.lit(-i).alias("i"), F.lit(str(c)).alias("name")) for i, c in enumerate(classes)])
    return out.withColumn("dominant_class", best["name"]).drop("_all")


def building_density(buildings: DataFrame, cell: list[str], cell_km2: float) -> DataFrame:
    """Buildings, density, footprint and built-up share per cell."""
    return buildings.groupBy(*cell).agg(
        F.count("*").alias("buildings"), (F.count("*") / cell_km2).alias("per_km2"),
        F.sum("area_m2").alias("footprint_m2"), (F.sum("area_m2") / (cell_km2 * 1e6)).alias("built_up_share"),
    )


def largest_per_cell(buildings: DataFrame, cell: list[str], key: str, k: int = 5, min_m2: float = 150.0) -> DataFrame:
    """The k largest footprints per cell; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(*cell).orderBy(F.col("area_m2").desc(), F.col(key))
    able = buildings.where(F.col("area_m2") >= min_m2)
    return able.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def interior_point(ring: Column) -> Column:
    """A point inside a ring of (lon, lat) pairs: the middle of its widest stretch at half its height."""

    def crossings(r: Column, y: Column) -> Column:
        following = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        at = F.zip_with(r, following, lambda a, b: F.when(
            (a["lat"] > y) != (b["lat"] > y), a["lon"] + (y - a["lat"]) * (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])))
        return F.array_sort(F.array_compact(at))

    def widest(crossed: Column, y: Column) -> Column:
        # Crossings pair up from the left: inside between the first and second, the third and fourth, ...
        stretches = F.transform(F.sequence(F.lit(1), F.size(crossed), F.lit(2)), lambda i: F.struct(
            (F.element_at(crossed, i + 1) - F.element_at(crossed, i)).alias("wide"),
            ((F.element_at(crossed, i + 1) + F.element_at(crossed, i)) / 2).alias("lon"), y.alias("lat")))
        return F.when(F.size(crossed) >= 2, F.array_max(stretches))

    def inside(r: Column) -> Column:
        return once((F.array_min(r["lat"]) + F.array_max(r["lat"])) / 2, lambda y: once(crossings(r, y), lambda c: widest(c, y)))

    return once(ring, inside)


def shortlisted_footprints(
    buildings: DataFrame, areas: DataFrame, edges: DataFrame, step: float, k: int = 5, min_m2: float = 150.0
) -> DataFrame:
    """The k largest footprints of each area, every footprint once and in one area only.

    Buildings are (source, line, ring), areas (area, priority), edges the areas' outlines. A
    footprint is known by a digest of its corners (1e-7 degrees), so copies from other sources go
    and the first by source and line stays. It belongs to the area of the smallest priority that
    holds its interior point, so areas may overlap and no footprint counts twice. Footprints
    outside all areas, below ``min_m2``, or with a missing or flat outline are not listed; the
    rank limit is applied before the shuffle.
    """
    corners = F.transform("ring", lambda p: F.concat_ws(" ", *[F.round(p[c] * 1e7).cast("bigint").cast("string") for c in ("lon", "lat")]))
    # Outlines are dealt out before the work on them: a file of short rows is read by few tasks.
    rings = buildings.where(F.col("ring").isNotNull() & (F.size("ring") >= 3)).repartition(tasks(buildings), "source", "line")
    figures = F.struct(polygon_area_m2(F.col("ring")).alias("area_m2"), interior_point(F.col("ring")).alias("_at"))
    # Opened from an array, the figures are computed once; as conditions they would move below the shuffle.
    large = F.explode(F.filter(F.array(figures), lambda f: (f["area_m2"] >= min_m2) & f["_at"].isNotNull()))
    solid = rings.select("source", "line", "ring", large.alias("f")).select(
        "source", "line", "f.*", F.substring(F.sha2(F.array_join(corners, ","), 256), 1, 20).alias("building_id"))
    distinct = solid.groupBy("building_id").agg(F.min(F.struct("source", "line", "area_m2", F.col("_at.lon").alias("lon"), F.col("_at.lat").alias("lat"))).alias("b"))
    distinct = materialize(distinct.select("building_id", "b.*"))
    ranked = edges.join(areas.select("area", "priority"), "area").withColumn("area", F.struct("priority", "area"))
    inside = distinct.join(assign_areas(distinct, ranked, step), ["lon", "lat"]).select(
        "building_id", "source", "line", "area_m2", "lon", "lat", "area.area", "area.priority")
    return largest_per_cell(inside, ["area"], "building_id", k, min_m2)


def category_counts(rows: DataFrame, cell: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows per cell and per category; a row may belong to several categories."""
    return rows.groupBy(*cell).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in rules.items()])


def family_distances(points: DataFrame, features: DataFrame, families: dict[str, Column]) -> DataFrame:
    """Nearest feature of every family per point location."""
    out = points.select("lon", "lat").distinct()
    for name, test in families.items():
        hit = nearest(out, features.where(test)).withColumnRenamed("distance_m", f"dist_{name}_m")
        out = out.join(hit, ["lon", "lat"], "left")
    return out


def measurement_support(points: DataFrame, readings: DataFrame) -> DataFrame:
    """Nearest reading and readings within 1 and 5 km of every point location."""
    near = nearest(points, readings).withColumnRenamed("distance_m", "nearest_reading_m")
    counts = radius_sums(points, readings, [1000.0, 5000.0], {"readings": F.lit(1)})
    return near.join(counts, ["lon", "lat"], "left").fillna(0, ["readings_1000", "readings_5000"])


def with_regional_factor(df: DataFrame, factors: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """Regional factors by place, neutral where the place is unknown."""
    out = df.join(factors, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(neutral)) for c, neutral in columns.items()})


def site_rollup(radios: DataFrame, site: str, generation: Column) -> DataFrame:
    """One row per physical site: its technologies, newest generation, owners and totals."""
    kinds = F.array_join(F.sort_array(F.collect_set("rat")), ",")
    return radios.groupBy(site).agg(
        kinds.alias("technologies"), F.max(generation).alias("max_generation"), F.count("*").alias("radios"),
        F.sum("bandwidth").alias("bandwidth_mhz"), F.max("ts").alias("last_seen"),
    )


def identity_request(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Measured identities with how often and on how many days they were seen."""
    return readings.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_distinct("day").alias("days"))


# --- Earlier customer rules ---------------------------------------------------------------

# yes/no services counted per customer.
SERVICES = (
    "phone_service", "multiple_lines", "internet_service", "online_security", "online_backup", "device_protection_plan",
    "premium_tech_support", "streaming_tv", "streaming_movies", "streaming_music", "unlimited_data",
)


def household_features(df: DataFrame) -> DataFrame:
    """Service counts, bundles, bill shock, refunds, loyalty flags and tenure cohort.

    Services are booleans; columns the table lacks contribute nothing.
    """
    has = {c: F.coalesce(F.col(c), F.lit(False)) for c in SERVICES if c in df.columns}
    held = [c.cast("int") for c in has.values()]
    count = sum(held[1:], held[0]) if held else F.lit(0)

    def bundle(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & has[n]
        return out.cast("int")

    months = F.col("tenure_months")
    return df.withColumns(
        {
            "total_services": count,
            "has_security_bundle": bundle("online_security", "premium_tech_support"),
            "has_streaming_bundle": bundle("streaming_tv", "streaming_movies", "streaming_music"),
            "is_month_to_month": (F.col("contract") == "Month-to-Month").cast("int"),
            "has_extra_data_charges": (F.col("extra_data_charges") > 0).cast("int"),
            "extra_data_ratio": F.col("extra_data_charges") / (F.col("total_charges") + 1e-5),
            "has_refunds": (F.col("refunds") > 0).cast("int"),
            "is_heavy_data_user": (F.col("gb_download") >= 50).cast("int"),
            "charge_per_service": F.col("monthly_charge") / (count + 1),
            "tenure_cohort": F.when(months.between(0, 12) | ((months > -1) & (months < 0)), "0-12m")
            .when((months > 12) & (months <= 24), "13-24m")
            .when((months > 24) & (months <= 48), "25-48m")
            .when((months > 48) & (months <= 100), "49m+"),
        }
    )


def discount_offers(df: DataFrame, acceptance: float = 0.75) -> DataFrame:
    """Discount tier per customer, its yearly cost, expected saving and return, and notes."""
    p, charge = F.col("churn_probability"), F.col("monthly_charge")
    large = (F.col("total_revenue") >= 2500.0) | (charge >= 75.0)
    tier = (
        F.when((p >= 0.60) & large, "VIP_SAVE").when(p >= 0.60, "STANDARD_SAVE")
        .when((p >= 0.35) & (F.col("contract") == "Month-to-Month"), "PROACTIVE_SAVE")
        .when(p >= 0.35, "LOYALTY_COURTESY").otherwise("NO_DISCOUNT")
    )
    # Discount per tier in percent.
    percent = {"VIP_SAVE": 20, "STANDARD_SAVE": 15, "PROACTIVE_SAVE": 12, "LOYALTY_COURTESY": 5, "NO_DISCOUNT": 0}
    table = F.create_map(*[F.lit(x) for pair in percent.items() for x in pair])
    out = df.withColumn("retention_tier", tier).withColumn("discount_pct", F.element_at(table, F.col("retention_tier")))
    pct, yearly = F.col("discount_pct"), charge * 12
    cost, saved = yearly * pct / 100.0, yearly * p * acceptance
    gain = F.when(pct > 0, saved - cost).otherwise(0.0)
    gb, internet = F.col("gb_download"), F.col("internet_type")
    notes = [
        F.when(F.col("current_offer") == "Offer E", "migrate_from_offer_e"),
        F.when(F.col("extra_data_charges") > 0, "bill_shock"),
        F.when(F.col("refunds") > 0, "service_friction"),
        F.when((internet == "Fiber Optic") & ~F.col("premium_tech_support"), "fiber_without_support"),
        F.when(gb >= 50, "heavy_data_user").when((gb < 10) & (internet != "No internet service"), "low_data_user"),
    ]
    return out.withColumns(
        {
            "risk_level": F.when(p >= 0.6, "High").when(p >= 0.35, "Medium").otherwise("Low"),
            "new_monthly_charge": half_even(settled(charge * (1 - pct / 100.0)), 2),
            "annual_discount_cost": half_even(settled(cost), 2),
            "expected_saved_revenue": half_even(settled(saved), 2),
            "net_retention_gain": half_even(settled(gain), 2),
            "roi_pct": half_even(settled(F.when(cost > 0, gain / cost * 100.0).otherwise(0.0)), 1),
            "notes": F.concat_ws(";", *notes),
        }
    )
