"""Registered expansion queries: need scores, weakest areas, shortlists and asset audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.operators import expansion as X
from mastwire.operators import inventory as I
from mastwire.plans.adapters import view
from mastwire.plans.places import BLOCK_SQL, MEASURE_SQL, candidates, measured
from mastwire.plans.registry import query

EVEN = "CAST(round_even(CAST({x} AS DECIMAL(18, 8)), {d}) AS DOUBLE)"
PLACE_SQL = """p AS (SELECT candidate_id, abs(balance) AS density, CASE WHEN area % 5 <> 0 THEN abs(balance) * 3 + area END AS people,
     CAST(area AS DOUBLE) * 10 AS far, CAST(area % 7 AS DOUBLE) AS near, area % 4 AS sites, CASE WHEN area % 3 <> 0 THEN CAST(area AS DOUBLE) * 4 END AS built,
     CAST(area % 6 AS DOUBLE) * 5 AS bare, CAST(area % 2 AS DOUBLE) * 10 AS water FROM {v_candidates})"""


def places(spark, sf):
    area = F.col("area")
    return candidates(spark, sf).select(
        "candidate_id", F.abs("balance").alias("population_density_1km"),
        F.when(area % 5 != 0, F.abs("balance") * 3 + area).alias("population_sum_3km"),
        (area.cast("double") * 10).alias("dist_to_nearest_site_m"), (area % 7).cast("double").alias("site_density_3km"),
        (area % 4).alias("existing_sites_site_count"), F.when(area % 3 != 0, area.cast("double") * 4).alias("landcover_builtup_pct"),
        ((area % 6).cast("double") * 5).alias("landcover_bare_pct"), ((area % 2).cast("double") * 10).alias("landcover_water_pct"),
    )


def _scaled_sql(column: str) -> str:
    low, high = (f"(SELECT quantile_cont({column}, {q}) FROM p)" for q in (0.02, 0.98))
    return f"CASE WHEN {column} IS NULL THEN 0.5 ELSE least(greatest(({column} - {low}) / ({high} - {low}), 0), 1) END"


@query(
    "expansion_need_scores",
    f"""WITH {PLACE_SQL}, s AS (SELECT candidate_id, (({_scaled_sql('density')}) + ({_scaled_sql('people')})) / 2 AS population,
          least((({_scaled_sql('far')}) + 1 - ({_scaled_sql('near')})) / 2 + CASE WHEN sites = 0 THEN 0.15 ELSE 0 END, 1) AS gap,
          least(greatest(coalesce(built, 0) / 100 - 0.5 * bare / 100 - water / 100, 0), 1) AS land FROM p)
       SELECT candidate_id, round(population, 6) AS population_need, round(gap, 6) AS gap_need, round(land, 6) AS land_use_need,
         {EVEN.format(x='(population * 0.35 + gap * 0.25 + land * 0.15) / 0.75 * 100', d=2)} AS expansion_need_score FROM s""",
)
def expansion_need_scores(spark, sf):
    out = X.need_scores(places(spark, sf))  # no building columns: their weight goes to the other parts
    names = ["population_need", "gap_need", "land_use_need"]
    return out.select("candidate_id", *[F.round(n, 6).alias(n) for n in names], "expansion_need_score")


AREA_SQL = f"""{MEASURE_SQL}, b AS ({BLOCK_SQL.format(where="")}), a AS (SELECT mcc, mnc, net_type, area_x, area_y, CAST(sum(samples) AS BIGINT) AS readings,
     median(dbm) AS level FROM b GROUP BY 1, 2, 3, 4, 5)"""


def areas(spark, sf):
    return I.service_summary(measured(spark, sf)).withColumnsRenamed({"sample_count": "readings", "median_dbm": "level"})


@query(
    "service_group_totals",
    f"""WITH {AREA_SQL} SELECT mnc, net_type, count(*) AS areas, CAST(sum(readings) AS BIGINT) AS readings,
          {EVEN.format(x='median(level)', d=1)} AS median_of_area_medians FROM a GROUP BY 1, 2""",
)
def service_group_totals(spark, sf):
    return X.service_group_totals(areas(spark, sf), ["mnc", "net_type"], "level", "readings")


@query(
    "weakest_service_areas",
    f"""WITH {AREA_SQL} SELECT mnc, net_type, area_x, area_y, readings, round(level, 6) AS level FROM (SELECT *, round(level, 9) AS l FROM a) x
       WHERE readings >= 5 ORDER BY l, readings DESC, mcc, mnc, net_type, area_x, area_y LIMIT 10""",
)
def weakest_service_areas(spark, sf):
    rows = areas(spark, sf).withColumn("l", F.round("level", 9))
    out = X.weakest_areas(rows, "l", "readings", ["mcc", "mnc", "net_type", "area_x", "area_y"], 10)
    return out.select("mnc", "net_type", "area_x", "area_y", "readings", F.round("level", 6).alias("level"))


@query(
    "shortlist_ranges",
    """WITH m AS (SELECT * FROM {v_candidates} WHERE contains(lower(segment), 'build')), t AS (SELECT * FROM m ORDER BY balance DESC, candidate_id LIMIT 20)
       SELECT (SELECT count(*) FROM m) AS matched, count(*) AS shown, min(balance) AS lowest_balance, max(balance) AS highest_balance, min(lon) AS lowest_lon, max(lon) AS highest_lon FROM t""",
)
def shortlist_ranges(spark, sf):
    rows = candidates(spark, sf).withColumn("rank", F.struct((-F.col("balance")).alias("b"), "candidate_id"))
    return X.shortlist(rows, "rank", "segment", " BUILD ", 20, ["balance", "lon"])


@query(
    "asset_key_audit",
    """SELECT 'sites' AS "table", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS without_key, count(k) AS keys, count(*) FILTER (k IS NOT NULL AND n > 1) AS repeated_keys
         FROM (SELECT s_suppkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) x
       UNION ALL SELECT 'sectors', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT), count(k), count(*) FILTER (k IS NOT NULL AND n > 1) FROM (SELECT l_orderkey AS k, count(*) AS n FROM {lineitem} GROUP BY 1) y""",
)
def asset_key_audit(spark, sf):
    tables = {"sites": ("supplier", "s_suppkey"), "sectors": ("lineitem", "l_orderkey")}
    audits = [X.key_audit(spark.read.parquet(f"{sf}/{t}.parquet"), k).withColumn("table", F.lit(n)) for n, (t, k) in tables.items()]
    return reduce(DataFrame.unionByName, audits).select("table", "rows", "without_key", "keys", "repeated_keys")


@query(
    "asset_reference_audit",
    f"""SELECT count(*) AS rows, count(*) FILTER (s_suppkey IS NULL) AS orphans, {EVEN.format(x='count(s_suppkey) / count(*) * 100', d=2)} AS linked_pct
        FROM {{lineitem}} LEFT JOIN (SELECT s_suppkey FROM {{supplier}} WHERE s_nationkey % 4 <> 0) s ON s_suppkey = l_suppkey""",
)
def asset_reference_audit(spark, sf):
    sites = spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey % 4 <> 0")
    return X.reference_audit(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_suppkey", sites, "s_suppkey")


@query(
    "asset_range_audit",
    """SELECT 'lon' AS "column", count(*) FILTER (lon IS NULL) AS missing, count(*) FILTER (lon < 13.1 OR lon > 13.6) AS outside, """
    + EVEN.format(x="count(*) FILTER (lon BETWEEN 13.1 AND 13.6) / count(*) * 100", d=2)
    + """ AS valid_pct FROM {v_sites} UNION ALL SELECT 'balance', count(*) FILTER (balance IS NULL), count(*) FILTER (balance < 0 OR balance > 9000), """
    + EVEN.format(x="count(*) FILTER (balance BETWEEN 0 AND 9000) / count(*) * 100", d=2) + " FROM {v_sites}",
)
def asset_range_audit(spark, sf):
    return X.range_audit(view(spark, sf, "v_sites"), {"lon": (13.1, 13.6), "balance": (0.0, 9000.0)})
