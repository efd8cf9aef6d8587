"""Where to expand: need scores of places, weakest measured areas, shortlists and asset audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.functions.numeric import clip, half_even, settled
from mastwire.operators.ordered import quantiles_by
from mastwire.operators.planning import clipped_scale

# Weights of the four parts of need, and what a place without any site adds to its gap.
NEED_WEIGHTS = {"population": 0.35, "buildings": 0.25, "gap": 0.25, "land_use": 0.15}
NO_SITE_BONUS = 0.15
# The columns that each part reads; a part whose columns are all empty has no weight.
NEED_COLUMNS = {
    "population": ("population_density_1km", "population_sum_3km"),
    "buildings": ("building_density_per_km2", "built_up_ratio", "poi_count"),
    "gap": ("dist_to_nearest_site_m", "site_density_3km"),
    "land_use": ("landcover_builtup_pct", "landcover_bare_pct", "landcover_water_pct"),
}
MIN_READINGS = 5


def need_weights(df: DataFrame, weights: dict[str, float] | None = None) -> dict[str, float]:
    """The weights of the parts that have data, scaled to a sum of 1. One pass counts the values."""
    weights = dict(weights or NEED_WEIGHTS)
    columns = [c for names in NEED_COLUMNS.values() for c in names if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if columns else {}
    optional = ("buildings", "land_use")
    alive = {k: w for k, w in weights.items() if k not in optional or any(counts.get(c) for c in NEED_COLUMNS[k])}
    total = sum(alive.values())
    return {k: w / total for k, w in alive.items()} if total > 0 else weights


def _mean(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)


def need_scores(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each place with its four parts of need (0 to 1) and their weighted sum from 0 to 100.

    Columns are scaled between their 2nd and 98th percentile; a missing value, a constant column
    and a part without any column count as the neutral 0.5.
    """
    present = {k: [c for c in names if c in df.columns] for k, names in NEED_COLUMNS.items()}
    scaled = clipped_scale(df, [c for k in ("population", "buildings", "gap") for c in present[k]])
    neutral = F.lit(0.5)

    def part(name: str) -> Column:
        return _mean([F.col(f"{c}_scaled") for c in present[name]]) if present[name] else neutral

    far = F.col("dist_to_nearest_site_m_scaled") if "dist_to_nearest_site_m" in df.columns else neutral
    sparse = 1 - F.col("site_density_3km_scaled") if "site_density_3km" in df.columns else neutral
    gap = (far + sparse) / 2
    if "existing_sites_site_count" in df.columns:
        alone = F.coalesce("existing_sites_site_count", F.lit(0)) == 0
        gap = clip(gap + F.when(alone, NO_SITE_BONUS).otherwise(0.0), 0, 1)
    percent = {c: F.coalesce(F.col(c), F.lit(0.0)) / 100 if c in df.columns else F.lit(0.0) for c in NEED_COLUMNS["land_use"]}
    built, bare, water = percent.values()
    seen = F.coalesce(*[F.col(c) for c in present["land_use"]]).isNotNull() if present["land_use"] else F.lit(False)
    parts = {
        "population": part("population"), "buildings": part("buildings"), "gap": gap,
        "land_use": F.when(seen, clip(built - 0.5 * bare - water, 0, 1)).otherwise(0.5),
    }
    out = scaled.withColumns({f"{k}_need": v for k, v in parts.items()})
    used = need_weights(df, weights)
    total = reduce(lambda a, b: a + b, [F.col(f"{k}_need") * w for k, w in used.items()])
    extra = [c for c in out.columns if c.endswith("_scaled") and c not in df.columns]
    return out.withColumn("expansion_need_score", half_even(settled(total * 100), 2)).drop(*extra)


def service_group_totals(areas: DataFrame, keys: list[str], level: str, readings: str) -> DataFrame:
    """Per group: areas, readings, and the median of the areas' medians to one decimal."""
    counts = areas.groupBy(*keys).agg(F.count("*").alias("areas"), F.sum(readings).alias("readings"))
    middle = quantiles_by(areas, keys, level, {"middle": 0.5}).withColumn("median_of_area_medians", half_even(settled(F.col("middle")), 1))
    return counts.join(middle.select(*keys, "median_of_area_medians"), keys)


def weakest_areas(areas: DataFrame, level: str, readings: str, order: list[str], count: int = 5, least: int = MIN_READINGS) -> DataFrame:
    """The ``count`` areas of lowest level among those with enough readings; more readings first on a tie."""
    return areas.where(F.col(readings) >= least).orderBy(F.col(level).asc(), F.col(readings).desc(), *order).limit(count)


def shortlist(rows: DataFrame, rank: str, place: str, wanted: str | None, shown: int, figures: list[str]) -> DataFrame:
    """The best ranked rows whose place contains the text, whatever its case, and what the figures span.

    One row: how many match, how many are shown, and lowest and highest of every figure shown.
    """
    match = F.contains(F.lower(F.col(place)), F.lit(wanted.strip().lower())) if wanted else F.lit(True)
    found = rows.where(match)
    matched = found.agg(F.count("*")).scalar()
    spans = [f(c).alias(f"{n}_{c}") for c in figures for n, f in (("lowest", F.min), ("highest", F.max))]
    return found.orderBy(rank).limit(shown).agg(matched.alias("matched"), F.count("*").alias("shown"), *spans)


def key_audit(table: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows without a key, distinct keys, and keys that several rows have."""
    counts = table.groupBy(key).agg(F.count("*").alias("n"))
    none = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("without_key"),
        F.count_if(~none).alias("keys"), F.count_if(~none & (F.col("n") > 1)).alias("repeated_keys"),
    )


def reference_audit(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: child rows, those whose key no parent has, and the percentage that is linked."""
    known = parent.select(F.col(parent_key).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    # Keys are counted before the join, so a key that a third of the rows hold is one row in it.
    counts = child.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    joined = counts.join(known, F.col("_key") == F.col("_known"), "left")
    rows, lost = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0))
    return joined.agg(rows.alias("rows"), lost.alias("orphans"), half_even(settled((rows - lost) / F.nullif(rows, F.lit(0)) * 100), 2).alias("linked_pct"))


def range_audit(table: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: values outside its limits, missing values, and the percentage that is valid."""
    counts = table.agg(F.count("*").alias("n"), *[
        F.struct(F.count_if(F.col(c).isNull()).alias("missing"), F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("outside")).alias(c)
        for c, (low, high) in limits.items()
    ])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.missing").alias("missing"), F.col(f"{c}.outside").alias("outside"),
                                 half_even(settled((F.col("n") - F.col(f"{c}.missing") - F.col(f"{c}.outside")) / F.nullif(F.col("n"), F.lit(0)) * 100), 2)
                                 .alias("valid_pct")) for c in limits])
    return counts.select(F.inline(entries))
