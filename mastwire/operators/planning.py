"""Site planning: eligibility with every reason, scores, reason codes and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.functions.numeric import clip, finite, half_even, is_true
from mastwire.operators.ordered import quantiles_by

# Planning constraints.
MIN_GAP_M, MIN_PEOPLE, MAX_ROAD_M, SEPARATION_M = 3000.0, 300.0, 4000.0, 2500.0
REQUIRED = (
    "population_sum_5km", "dist_to_nearest_site_m", "dist_to_nearest_road_m", "elevation_m",
    "elevation_prominence_3km", "terrain_slope_deg",
)
EVIDENCE = {
    "inside_libya": "outside_libya",
    "population_data_available": "incomplete_population",
    "terrain_data_available": "incomplete_terrain",
    "worldcover_data_available": "missing_landcover",
}


def rejection_rules(min_gap=MIN_GAP_M, min_people=MIN_PEOPLE, max_road=MAX_ROAD_M) -> dict[str, Column]:
    """Every reason a candidate is rejected, in reporting order."""
    rules = {code: ~is_true(F.col(flag)) for flag, code in EVIDENCE.items()}
    rules["observed_water"] = is_true(F.col("worldcover_is_water"))
    rules |= {f"missing_{c}": ~finite(F.col(c)) for c in REQUIRED}
    rules["below_population_threshold"] = is_true(F.col("population_sum_5km") < min_people)
    rules["too_close_to_known_site"] = is_true(F.col("dist_to_nearest_site_m") < min_gap)
    rules["too_far_from_road"] = is_true(F.col("dist_to_nearest_road_m") > max_road)
    for c in ("population_sum_5km", "dist_to_nearest_site_m", "dist_to_nearest_road_m", "terrain_slope_deg"):
        rules[f"invalid_{c}"] = is_true(F.col(c) < 0)
    return rules


def evaluate_eligibility(df: DataFrame, **limits) -> DataFrame:
    """Keep rejected candidates, with every reason that applies."""
    codes = [F.when(bad, F.lit(code)) for code, bad in rejection_rules(**limits).items()]
    out = df.withColumn("rejection_reasons", F.concat_ws(";", *codes))
    return out.withColumn("eligible", F.col("rejection_reasons") == "")


def strictly_eligible(require_landcover: bool = True) -> Column:
    """One condition for recommendations, with the standard limits."""
    tests = [is_true(F.col(c)) for c in ("inside_libya", "population_data_available", "terrain_data_available")]
    tests += [finite(F.col(c)) for c in REQUIRED]
    tests += [
        F.col("dist_to_nearest_site_m") >= MIN_GAP_M,
        F.col("population_sum_5km") >= MIN_PEOPLE,
        F.col("dist_to_nearest_road_m") <= MAX_ROAD_M,
    ]
    if require_landcover:
        tests += [is_true(F.col("worldcover_data_available")), ~is_true(F.col("worldcover_is_water"))]
    return is_true(reduce(lambda a, b: a & b, tests))


def score_candidates(df: DataFrame, weights=(0.40, 0.30, 0.20, 0.10)) -> DataFrame:
    """Fixed explainable priority: demand, gap to known sites, road access and terrain."""
    import math

    demand = clip(F.log1p("population_sum_5km") / math.log1p(100_000.0), 0, 1)
    gap = clip((F.col("dist_to_nearest_site_m") - 3000.0) / 17_000.0, 0, 1)
    road = 1.0 - clip(F.col("dist_to_nearest_road_m") / 4000.0, 0, 1)
    slope = 1.0 - clip(F.col("terrain_slope_deg") / 15.0, 0, 1)
    prominence = clip((F.col("elevation_prominence_3km") + 50.0) / 100.0, 0, 1)
    parts = {
        "demand_component": demand,
        "known_site_gap_component": gap,
        "road_access_component": road,
        "terrain_component": 0.5 * slope + 0.5 * prominence,
    }
    total = reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in zip(weights, parts.values())])
    return df.withColumns(
        {**{n: half_even(c, 4) for n, c in parts.items()}, "planning_priority_score": half_even(100.0 * total, 4)}
    )


def with_reason_codes(df: DataFrame) -> DataFrame:
    """Why a candidate is proposed, or why it is not."""
    review = {
        "opencellid_review_required": "near_recent_opencellid_observation",
        "worldcover_review_required": "mixed_or_coastal_landcover_review",
        "osm_building_review_required": "mapped_building_context_missing_review",
    }
    codes = [
        F.when(F.col("population_sum_5km") >= 10_000, "high_population_catchment"),
        F.when(F.col("dist_to_nearest_site_m") >= 10_000, "large_known_site_gap"),
        F.when(F.col("dist_to_nearest_road_m") <= 1000, "good_road_access"),
        F.when((F.col("elevation_prominence_3km") >= 20) & (F.col("terrain_slope_deg") <= 10), "terrain_advantage"),
        *[F.when(is_true(F.col(c)), code) for c, code in review.items() if c in df.columns],
    ]
    said = F.concat_ws(";", *codes)
    good = F.when(said == "", "meets_minimum_planning_constraints").otherwise(said)
    return df.withColumn(
        "reason_codes",
        F.when(F.col("eligible"), good).otherwise(F.concat(F.lit("ineligible;"), F.col("rejection_reasons"))),
    )


def equipment_tier() -> Column:
    """Equipment class of a site; the first rule that fits wins."""
    density, mhz = F.col("population_density_1km"), F.col("total_bandwidth_mhz")
    micro = (F.col("primary_tower_type") == "MICRO") | ((density > 2500) & (F.col("dist_to_nearest_site_m") < 250))
    urban = (density >= 1200) | (mhz >= 40.0) | (F.col("total_carrier_count") >= 3)
    suburban = (density >= 150) | (mhz >= 20.0) | (F.col("dist_to_nearest_road_m") < 500)
    return (
        F.when(is_true(micro), "Micro_Cell_Hotspot")
        .when(is_true(urban), "Urban_HighCapacity_Macro")
        .when(is_true(suburban), "Suburban_Standard_Macro")
        .otherwise("Rural_Coverage_Macro")
    )


def population_class(density_1km: Column) -> Column:
    return (
        F.when(density_1km >= 1000.0, "Urban_High_Density")
        .when(density_1km >= 100.0, "Suburban_Medium_Density")
        .when(density_1km >= 5.0, "Rural_Low_Density")
        .otherwise("Remote_Desert")
    )


def road_class(metres: Column) -> Column:
    return (
        F.when(metres <= 250.0, "Highway_Corridor")
        .when(metres <= 1000.0, "Road_Adjacent")
        .when(metres <= 5000.0, "Moderate_Access")
        .otherwise("Remote_OffRoad")
    )


def coverage_isolated(nearest_site_m: Column) -> Column:
    return is_true(nearest_site_m > 5000.0).cast("int")


def clipped_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled between its 2nd and 98th percentile; neutral 0.5 where it says nothing."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    limits = {r["column"]: r for r in quantiles_by(long, ["column"], "value", {"low": 0.02, "high": 0.98}).collect()}
    out = df
    for c in columns:
        q = limits.get(c)
        if q is None or q["high"] <= q["low"]:
            out = out.withColumn(f"{c}_scaled", F.lit(0.5))
            continue
        scaled = clip((F.col(c) - q["low"]) / (q["high"] - q["low"]), 0, 1)
        out = out.withColumn(f"{c}_scaled", F.coalesce(scaled, F.lit(0.5)))
    return out


def combined_priority(need: Column, probability: Column) -> Column:
    return need * (0.75 + 0.5 * probability)


def mask_unscorable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells worth scoring, and counts of what was masked (uninhabited only when not water)."""
    water = F.coalesce(F.col("landcover_water_pct"), F.lit(0.0)) >= 50.0
    empty = is_true((F.col("population_sum_5km") <= 0) & (F.col("dist_to_nearest_road_m") > 3000.0))
    counts = df.agg(
        F.count_if(water).alias("water_hexes"), F.count_if(empty & ~water).alias("uninhabited_hexes"),
        F.count_if(~water & ~empty).alias("scorable"),
    )
    return df.where(~water & ~empty), counts


def bandwidth_per_thousand(mhz: Column, people_3km: Column) -> Column:
    return half_even(mhz / (people_3km / 1000.0 + 1.0), 3)


def earlier_site_score(suitability: Column, people_5km: Column, gap_m: Column, regional: Column) -> tuple[Column, Column]:
    """(geospatial, deployment) priority: suitability x people on a log scale x clipped gap x regional factor."""
    people = F.log10(F.greatest(people_5km, F.lit(10.0)))
    base = half_even(suitability * people * clip(gap_m / 5000.0, 0.5, 2.0), 2)
    return base, half_even(base * regional, 2)
