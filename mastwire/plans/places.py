"""Registered planning queries: distance joins, eligibility, scores, inventories, measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastwire.operators import geo as D
from mastwire.operators import inventory as I
from mastwire.operators import planning as L
from mastwire.operators.contracts import replace_columns
from mastwire.plans.adapters import view
from mastwire.plans.network import rounded
from mastwire.plans.registry import query

HAV = (
    "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
    "* pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0)))"
)
CS = HAV.format(a="c", b="s")
PLAN_CHECKS = [
    ("NOT inside_libya", "outside_libya"), ("NOT population_data_available", "incomplete_population"),
    ("NOT terrain_data_available", "incomplete_terrain"), ("NOT worldcover_data_available", "missing_landcover"),
    ("worldcover_is_water", "observed_water"), ("population_sum_5km IS NULL", "missing_population_sum_5km"),
    ("population_sum_5km < 300", "below_population_threshold"), ("dist_to_nearest_site_m < 3000", "too_close_to_known_site"),
    ("dist_to_nearest_road_m > 4000", "too_far_from_road"), ("dist_to_nearest_road_m < 0", "invalid_dist_to_nearest_road_m"),
]
PLAN_SQL = f"""el AS (SELECT *, concat_ws(';', {", ".join(f"CASE WHEN {t} THEN '{c}' END" for t, c in PLAN_CHECKS)}) AS rejection_reasons FROM {{v_plan}}),
  sc AS (SELECT *, rejection_reasons = '' AS eligible, least(ln(1 + population_sum_5km) / ln(1 + 100000.0), 1) + 0 * population_sum_5km AS de,
     least(greatest((dist_to_nearest_site_m - 3000) / 17000, 0), 1) AS ga, 1 - least(greatest(dist_to_nearest_road_m / 4000, 0), 1) AS ro,
     0.5 * (1 - least(terrain_slope_deg / 15, 1)) + 0.5 * least(greatest((elevation_prominence_3km + 50) / 100, 0), 1) AS te FROM el)"""


def candidates(spark, sf):
    return view(spark, sf, "v_candidates")


def sites(spark, sf):
    return view(spark, sf, "v_sites")


@query(
    "candidate_site_context",
    f"""SELECT c.candidate_id, round(min({CS}), 3) AS dist_to_nearest_site_m, count(*) FILTER ({CS} <= 1000) AS site_density_1km,
          count(*) FILTER ({CS} <= 3000) AS site_density_3km, count(*) FILTER ({CS} <= 5000) AS site_density_5km, count(*) FILTER ({CS} <= 10000) AS site_density_10km,
          round(min({CS}) FILTER (has_network_a), 3) AS dist_has_network_a_m FROM {{v_candidates}} c CROSS JOIN {{v_sites}} s GROUP BY 1""",
)
def candidate_site_context(spark, sf):
    out = D.site_context(candidates(spark, sf).select("candidate_id", "lon", "lat"), sites(spark, sf), flags=("has_network_a",))
    return rounded(out.drop("lon", "lat"), "dist_to_nearest_site_m", "dist_has_network_a_m", digits=3)


@query(
    "nearest_other_site",
    f"""SELECT c.site_id, round(min({CS}), 3) AS distance_m FROM {{v_sites}} c JOIN {{v_sites}} s ON c.site_id <> s.site_id GROUP BY 1""",
)
def nearest_other_site(spark, sf):
    rows = sites(spark, sf)
    hit = D.nearest(rows, rows, others_only=True)
    return rounded(rows.select("site_id", "lon", "lat").join(hit, ["lon", "lat"]).select("site_id", "distance_m"), "distance_m", digits=3)


@query(
    "zonal_balance",
    f"""SELECT c.site_id, round(sum(CASE WHEN s.balance >= 0 THEN 1.0 ELSE 0 END) / count(*), 6) AS valid_fraction,
          CASE WHEN sum(CASE WHEN s.balance >= 0 THEN 1.0 ELSE 0 END) / count(*) >= 0.9 THEN round(sum(CASE WHEN s.balance >= 0 THEN s.balance ELSE 0 END), 2) END AS total
        FROM {{v_sites}} c JOIN {{v_candidates}} s ON {CS} <= 5000 GROUP BY 1""",
)
def zonal_balance(spark, sf):
    pixels = candidates(spark, sf).select(
        "lon", "lat", F.lit(1.0).alias("area"), F.when(F.col("balance") >= 0, F.col("balance")).alias("value")
    )
    places = sites(spark, sf).select("site_id", "lon", "lat")
    out = places.join(D.zonal_total(places, pixels, 5000.0, 0.9), ["lon", "lat"]).drop("lon", "lat")
    return rounded(rounded(out, "valid_fraction"), "total", digits=2)


@query(
    "area_assignment",
    """WITH x AS (SELECT c.candidate_id, e.area, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) AS n
          FROM {v_candidates} c CROSS JOIN {v_area_edges} e GROUP BY 1, 2)
       SELECT candidate_id, min(area) AS area FROM x WHERE n % 2 = 1 GROUP BY 1""",
)
def area_assignment(spark, sf):
    points = candidates(spark, sf).select("candidate_id", "lon", "lat")
    found = D.assign_areas(points, view(spark, sf, "v_area_edges"), 0.1)
    return points.join(found, ["lon", "lat"]).select("candidate_id", "area")


@query(
    "settlement_rings",
    """WITH r AS (SELECT site_id, radians(lon) AS x, radians(lat) AS y, ring_m / 6371008.8 AS d, radians(b) AS t, ring_m, CAST(b AS DOUBLE) AS bearing FROM {v_sites}
          CROSS JOIN (VALUES (1000.0), (3000.0)) AS k(ring_m) CROSS JOIN (VALUES (0), (90), (180), (270)) AS l(b)),
        p AS (SELECT *, asin(sin(y) * cos(d) + cos(y) * sin(d) * cos(t)) AS y2 FROM r)
       SELECT site_id, CAST(ring_m AS DOUBLE) AS ring_m, bearing, round(degrees(y2), 7) AS lat, round(degrees(x + atan2(sin(t) * sin(d) * cos(y), cos(d) - sin(y) * sin(y2))), 7) AS lon FROM p""",
)
def settlement_rings(spark, sf):
    out = D.settlement_rings(sites(spark, sf).select("site_id", "lon", "lat"), (1000, 3000), 4)
    return rounded(out, "lon", "lat", digits=7)


@query(
    "sites_per_cell",
    """SELECT CAST(floor(lon / 0.05) AS BIGINT) AS cx, CAST(floor(lat / 0.05) AS BIGINT) AS cy, count(*) AS sites, count(*) FILTER (has_network_a) AS network_a, round(avg(balance), 4) AS mean_balance
       FROM {v_sites} GROUP BY 1, 2""",
)
def sites_per_cell(spark, sf):
    x, y = D.grid_cell(F.col("lon"), F.col("lat"), 0.05)
    out = sites(spark, sf).groupBy(x.alias("cx"), y.alias("cy")).agg(
        F.count("*").alias("sites"), F.count_if("has_network_a").alias("network_a"), F.avg("balance").alias("mean_balance")
    )
    return rounded(out, "mean_balance", digits=4)


@query(
    "grid_terrain_slope",
    """WITH g AS (SELECT CAST(floor(lon / 0.02) AS BIGINT) AS px, CAST(floor(lat / 0.02) AS BIGINT) AS py, avg(balance) / 10 AS e FROM {v_candidates} GROUP BY 1, 2)
       SELECT g.px, g.py, g.e AS elevation, round(degrees(atan(sqrt(pow((a.e - b.e) / 4000.0, 2) + pow((c.e - d.e) / 4000.0, 2)))), 5) AS slope_deg
       FROM g LEFT JOIN g a ON a.px = g.px + 1 AND a.py = g.py LEFT JOIN g b ON b.px = g.px - 1 AND b.py = g.py
         LEFT JOIN g c ON c.px = g.px AND c.py = g.py + 1 LEFT JOIN g d ON d.px = g.px AND d.py = g.py - 1
       WHERE a.px IS NOT NULL OR b.px IS NOT NULL OR c.px IS NOT NULL OR d.px IS NOT NULL""",
)
def grid_terrain_slope(spark, sf):
    x, y = D.grid_cell(F.col("lon"), F.col("lat"), 0.02)
    pixels = candidates(spark, sf).groupBy(x.alias("px"), y.alias("py")).agg((F.avg("balance") / 10).alias("elevation"))
    return rounded(D.terrain(pixels, 2000.0), "slope_deg", digits=5)


@query(
    "candidate_eligibility",
    f"WITH {PLAN_SQL} SELECT candidate_id, rejection_reasons, eligible FROM sc",
)
def candidate_eligibility(spark, sf):
    return L.evaluate_eligibility(view(spark, sf, "v_plan")).select("candidate_id", "rejection_reasons", "eligible")


@query(
    "candidate_scores",
    f"""WITH {PLAN_SQL} SELECT candidate_id, round_even(de, 4) AS demand_component, round_even(ga, 4) AS known_site_gap_component, round_even(ro, 4) AS road_access_component,
          round_even(te, 4) AS terrain_component, round_even(100 * (0.4 * de + 0.3 * ga + 0.2 * ro + 0.1 * te), 4) AS planning_priority_score,
          CASE WHEN NOT eligible THEN concat('ineligible;', rejection_reasons) ELSE coalesce(nullif(concat_ws(';', CASE WHEN population_sum_5km >= 10000 THEN 'high_population_catchment' END,
            CASE WHEN dist_to_nearest_site_m >= 10000 THEN 'large_known_site_gap' END, CASE WHEN dist_to_nearest_road_m <= 1000 THEN 'good_road_access' END,
            CASE WHEN elevation_prominence_3km >= 20 AND terrain_slope_deg <= 10 THEN 'terrain_advantage' END), ''), 'meets_minimum_planning_constraints') END AS reason_codes FROM sc""",
)
def candidate_scores(spark, sf):
    out = L.with_reason_codes(L.score_candidates(L.evaluate_eligibility(view(spark, sf, "v_plan"))))
    return out.select(
        "candidate_id", "demand_component", "known_site_gap_component", "road_access_component", "terrain_component",
        "planning_priority_score", "reason_codes",
    )


@query(
    "candidate_strict_mask",
    f"WITH {PLAN_SQL} SELECT area, count(*) FILTER (eligible) AS eligible, count(*) AS candidates FROM sc JOIN (SELECT candidate_id AS k, area FROM {{v_candidates}}) ON k = candidate_id GROUP BY area",
)
def candidate_strict_mask(spark, sf):
    # A negative road distance is invalid in the ledger; the mask has no such test.
    rows = replace_columns(view(spark, sf, "v_plan"), candidates(spark, sf).select("candidate_id", "area"), "candidate_id")
    kept = L.strictly_eligible() & (F.col("dist_to_nearest_road_m") >= 0)
    return rows.groupBy("area").agg(F.count_if(kept).alias("eligible"), F.count("*").alias("candidates"))


@query("separated_shortlist")
def separated_shortlist(spark, sf):
    pool = L.score_candidates(L.evaluate_eligibility(view(spark, sf, "v_plan"))).where("eligible")
    return D.separated(pool, "candidate_id", "planning_priority_score", L.SEPARATION_M, 20)


@query(
    "clipped_scaling",
    """WITH q AS (SELECT quantile_cont(balance, 0.02) AS lo, quantile_cont(balance, 0.98) AS hi FROM {v_candidates})
       SELECT candidate_id, round(least(greatest((balance - lo) / (hi - lo), 0), 1), 6) AS balance_scaled, round(least(greatest((balance - lo) / (hi - lo), 0), 1) * (0.75 + 0.5 * area / 25), 6) AS priority FROM {v_candidates}, q""",
)
def clipped_scaling(spark, sf):
    out = L.clipped_scale(candidates(spark, sf), ["balance"])
    out = out.withColumn("priority", L.combined_priority(F.col("balance_scaled"), F.col("area") / 25))
    return rounded(out.select("candidate_id", "balance_scaled", "priority"), "balance_scaled", "priority")


# --- Inventories and measurements ---------------------------------------------------------


@query(
    "radio_deduplication",
    """WITH g AS (SELECT rat, region_id, site_id, count(*) AS observation_count, list_sort(list_distinct(list(channel))) AS channels, list_sort(list_distinct(list(band))) AS bands,
           sum(bandwidth) AS bw, median(longitude) AS lon, median(latitude) AS lat, min(ts) AS f, max(ts) AS l FROM {v_radio} GROUP BY 1, 2, 3)
       SELECT rat, region_id, site_id, observation_count, array_to_string(channels, ',') AS channels, array_to_string(bands, ',') AS bands,
         round_even(coalesce(bw, 0.4 * greatest(len(channels), 1)), 1) AS total_bandwidth_mhz, round(lon, 6) AS longitude, round(lat, 6) AS latitude,
         round_even((epoch_us(l) - epoch_us(f)) / 86400000000, 1) AS active_days FROM g""",
)
def radio_deduplication(spark, sf):
    out = I.deduplicate_radios(view(spark, sf, "v_radio")).withColumns(
        {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("channels", "bands")}
    )
    out = out.select(
        "rat", "region_id", "site_id", "observation_count", "channels", "bands", "total_bandwidth_mhz", "longitude", "latitude", "active_days"
    )
    return rounded(out, "longitude", "latitude")


@query(
    "radio_latest_bandwidth",
    """SELECT rat, region_id, site_id, arg_max(bandwidth, struct_pack(a := ts, b := event_id)) AS latest_mhz, round(sum(bandwidth), 4) AS naive_mhz FROM {v_radio} WHERE bandwidth IS NOT NULL GROUP BY 1, 2, 3""",
)
def radio_latest_bandwidth(spark, sf):
    return rounded(I.latest_bandwidth(view(spark, sf, "v_radio").where("bandwidth IS NOT NULL")), "naive_mhz", digits=4)


@query(
    "colliding_site_keys",
    "SELECT rat, region_id, count(DISTINCT site_id) AS networks FROM {v_radio} GROUP BY 1, 2 HAVING count(DISTINCT site_id) > 1",
)
def colliding_site_keys(spark, sf):
    return I.colliding_keys(view(spark, sf, "v_radio"), ["rat", "region_id"], ["site_id"])


CELLS_SQL = """vc AS (SELECT *, concat_ws(';', CASE WHEN radio NOT IN ('GSM', 'UMTS', 'LTE', 'CDMA', 'NR') THEN 'unknown_radio' END,
     CASE WHEN area IS NULL OR cell % 1 <> 0 THEN 'invalid_identity' END, CASE WHEN mcc <> 606 THEN 'other_country' END, CASE WHEN lat > 90 THEN 'invalid_coordinate' END) AS rejection_reason,
     created > 0 AND updated >= created AND updated <= 1730000000 AS timestamp_valid, (1730000000 - updated) / 86400.0 AS age_days FROM {v_cells}),
  ve AS (SELECT *, timestamp_valid AND samples >= 2 AND age_days BETWEEN 0 AND 730 AS review_eligible FROM vc)"""


def validated(spark, sf):
    return I.validate_cells(view(spark, sf, "v_cells"), F.timestamp_seconds(F.lit(1730000000)))


@query(
    "cell_rejection_ledger",
    f"WITH {CELLS_SQL} SELECT rejection_reason, timestamp_valid, review_eligible, count(*) AS rows FROM ve GROUP BY 1, 2, 3",
)
def cell_rejection_ledger(spark, sf):
    return validated(spark, sf).groupBy("rejection_reason", "timestamp_valid", "review_eligible").agg(F.count("*").alias("rows"))


@query(
    "cell_latest_records",
    f"""WITH {CELLS_SQL} SELECT radio, mcc, net, area, cell, event_id, updated, samples, review_eligible FROM ve WHERE rejection_reason = ''
        QUALIFY row_number() OVER (PARTITION BY radio, mcc, net, area, cell ORDER BY timestamp_valid DESC, updated DESC, samples DESC, event_id DESC) = 1""",
)
def cell_latest_records(spark, sf):
    out = I.latest_cells(validated(spark, sf).where("rejection_reason = ''"), "event_id")
    return out.select(*I.IDENTITY, "event_id", "updated", "samples", "review_eligible")


@query(
    "cell_engineering_readiness",
    """SELECT count(*) AS rows, count(*) FILTER (area IS NOT NULL) AS valid_area, count(*) FILTER (lat BETWEEN -90 AND 90) AS valid_lat, count(*) FILTER (samples >= 2) AS valid_samples,
         count(*) FILTER (area IS NOT NULL AND lat BETWEEN -90 AND 90 AND samples >= 2) AS complete_rows FROM {v_cells}""",
)
def cell_engineering_readiness(spark, sf):
    return I.readiness(
        view(spark, sf, "v_cells"),
        {"area": F.col("area").isNotNull(), "lat": F.col("lat").between(-90, 90), "samples": F.col("samples") >= 2},
    )


MEASURE_SQL = """mb AS (SELECT *, CAST(floor(lon / 0.01) AS BIGINT) AS block_x, CAST(floor(lat / 0.01) AS BIGINT) AS block_y,
     CAST(floor(floor(lon / 0.01) / 7) AS BIGINT) AS area_x, CAST(floor(floor(lat / 0.01) / 7) AS BIGINT) AS area_y FROM {v_measure})"""
BLOCK_SQL = "SELECT mcc, mnc, net_type, area_x, area_y, day, device, block_x, block_y, median(dbm) AS dbm, count(*) AS samples FROM mb {where} GROUP BY ALL"


def measured(spark, sf):
    return I.with_blocks(view(spark, sf, "v_measure"), 0.01, 7)


@query(
    "measured_service_summary",
    f"""WITH {MEASURE_SQL}, b AS ({BLOCK_SQL.format(where="")}) SELECT mcc, mnc, net_type, area_x, area_y, CAST(sum(samples) AS BIGINT) AS sample_count, count(DISTINCT day) AS day_count,
          count(DISTINCT device) AS device_count, count(DISTINCT (block_x, block_y)) AS block_count, round(median(dbm), 5) AS median_dbm, round(quantile_cont(dbm, 0.1), 5) AS p10_dbm, round(quantile_cont(dbm, 0.9), 5) AS p90_dbm
        FROM b GROUP BY 1, 2, 3, 4, 5""",
)
def measured_service_summary(spark, sf):
    return rounded(I.service_summary(measured(spark, sf)), "median_dbm", "p10_dbm", "p90_dbm", digits=5)


@query(
    "later_day_signal_baseline",
    f"""WITH {MEASURE_SQL}, b AS ({BLOCK_SQL.format(where="")}), p AS (SELECT mcc, mnc, net_type, area_x, area_y, median(dbm) AS prediction FROM b WHERE day < DATE '2024-01-21' GROUP BY 1, 2, 3, 4, 5)
        SELECT b.net_type, count(*) AS holdout_blocks, count(prediction) AS matched_blocks, round_even(100.0 * count(prediction) / count(*), 2) AS coverage_pct, round(avg(abs(prediction - dbm)), 5) AS mae_db, round(avg(prediction - dbm), 5) AS bias_db
        FROM b LEFT JOIN p USING (mcc, mnc, net_type, area_x, area_y) WHERE day >= DATE '2024-01-21' GROUP BY 1""",
)
def later_day_signal_baseline(spark, sf):
    rows, cut = measured(spark, sf), F.to_date(F.lit("2024-01-21"))
    out = I.later_day_baseline(rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut))
    return rounded(out, "mae_db", "bias_db", digits=5)


@query(
    "signal_distance_curve",
    """SELECT net_type, mnc, count(*) AS n, round(regr_slope(dbm, log10(value * 10)), 5) AS slope, round(regr_intercept(dbm, log10(value * 10)), 5) AS intercept FROM {v_measure} WHERE value > 0 GROUP BY 1, 2""",
)
def signal_distance_curve(spark, sf):
    rows = view(spark, sf, "v_measure").withColumn("distance_m", F.col("value") * 10)
    return rounded(I.distance_curve(rows, ["net_type", "mnc"]), "slope", "intercept", digits=5)


@query(
    "pilot_area",
    f"""WITH {MEASURE_SQL}, a AS (SELECT area_x, area_y, count(*) AS samples, count(DISTINCT (block_x, block_y)) AS blocks, count(DISTINCT day) AS days,
          count(DISTINCT (mcc, mnc, net_type, lac, cell_id)) AS cells, bool_or(mnc = 1) AS r FROM mb GROUP BY 1, 2), q AS (SELECT * FROM a WHERE samples >= 20 AND blocks >= 3 AND cells >= 2)
        SELECT area_x, area_y, samples, blocks, days, cells, r AS has_reference, (SELECT count(*) FROM q) AS qualifying_areas FROM q ORDER BY r DESC, days DESC, blocks DESC, cells DESC, area_x, area_y LIMIT 1""",
)
def pilot_area(spark, sf):
    rows = measured(spark, sf)
    return I.choose_pilot(rows, rows.where("mnc = 1").select("area_x", "area_y"))


@query(
    "identity_matches",
    """WITH m AS (SELECT DISTINCT mcc, mnc, lac, cell_id FROM {v_measure}), a AS (SELECT user_id AS cell_id, user_id % 50 AS lac, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1, 2)
       SELECT count(*) AS identities, count(*) FILTER (n = 1) AS matched_once, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS missing FROM m LEFT JOIN a USING (cell_id, lac)""",
)
def identity_matches(spark, sf):
    rows = view(spark, sf, "v_measure")
    assets = rows.where("net_type = 'purchase' AND value > 50")
    return I.identity_matches(rows, assets, ["mcc", "mnc", "lac", "cell_id"])


@query(
    "connected_site_groups",
    f"""WITH RECURSIVE e AS (SELECT a.candidate_id AS f, b.candidate_id AS t FROM {{v_candidates}} a JOIN {{v_candidates}} b
          ON a.candidate_id <> b.candidate_id AND abs(a.lat - b.lat) < 0.01 WHERE {HAV.format(a="a", b="b")} <= 400),
        reach AS (SELECT candidate_id AS f, candidate_id AS t FROM {{v_candidates}} UNION SELECT reach.f, e.t FROM reach JOIN e ON reach.t = e.f)
       SELECT f AS candidate_id, min(t) AS component FROM reach GROUP BY f""",
)
def connected_site_groups(spark, sf):
    return I.connected_sites(candidates(spark, sf).select("candidate_id", "lon", "lat"), "candidate_id", 400.0).select("candidate_id", "component")
