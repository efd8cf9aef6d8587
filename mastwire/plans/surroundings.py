"""Registered context queries: lines, land cover, buildings, services, support and site roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastwire.operators import campaign as G
from mastwire.operators import context as S
from mastwire.operators import geo as D
from mastwire.operators import network as N
from mastwire.operators import planning as L
from mastwire.plans.adapters import view
from mastwire.plans.network import ALERT_SQL, rounded, tower_kpi
from mastwire.plans.places import CS, candidates, sites
from mastwire.plans.registry import query
from mastwire.sources.readers import profile

SEGMENT_SQL = """seg AS (SELECT c.candidate_id, (x1 - lon) * cos(radians(lat)) * 111195.0802335329 AS ax, (y1 - lat) * 111195.0802335329 AS ay,
     (x2 - x1) * cos(radians(lat)) * 111195.0802335329 AS dx, (y2 - y1) * 111195.0802335329 AS dy FROM {v_candidates} c CROSS JOIN {v_roads}),
   tt AS (SELECT *, least(greatest(coalesce(-(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0), 0), 0), 1) AS t FROM seg)"""


@query(
    "nearest_road",
    f"WITH {SEGMENT_SQL} SELECT candidate_id, round(min(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)), 2) AS road_m FROM tt GROUP BY 1",
)
def nearest_road(spark, sf):
    points = candidates(spark, sf).select("candidate_id", "lon", "lat")
    near = D.nearest_line(points, view(spark, sf, "v_roads"))
    out = points.join(near, ["lon", "lat"]).select("candidate_id", F.col("distance_m").alias("road_m"))
    return rounded(out, "road_m", digits=2)


LINES = "CASE WHEN floor(least({a}, {b}) / 0.05) + 1 <= ceil(greatest({a}, {b}) / 0.05) - 1 THEN list_transform(range((floor(least({a}, {b}) / 0.05) + 1)::bigint, (ceil(greatest({a}, {b}) / 0.05))::bigint), lambda k: (k * 0.05::double - {a}) / ({b} - {a})) ELSE [] END"


@query(
    "road_length_by_cell",
    f"""WITH r AS (SELECT *, list_sort(list_distinct([0.0::double, 1.0::double] || {LINES.format(a="x1", b="x2")} || {LINES.format(a="y1", b="y2")})) AS cuts,
          2 * 6371008.8 * asin(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))) AS m FROM {{v_roads}}),
        p AS (SELECT x1, x2, y1, y2, m, cuts[i] AS a, cuts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(cuts))) AS i FROM r))
       SELECT CAST(floor((x1 + (x2 - x1) * (a + b) / 2) / 0.05) AS BIGINT) AS cx, CAST(floor((y1 + (y2 - y1) * (a + b) / 2) / 0.05) AS BIGINT) AS cy, round(sum(m * (b - a)), 3) AS metres FROM p GROUP BY 1, 2""",
)
def road_length_by_cell(spark, sf):
    return rounded(D.line_length_by_cell(view(spark, sf, "v_roads"), 0.05), "metres", digits=3)


@query(
    "area_or_nearest",
    """WITH x AS (SELECT c.candidate_id, e.area, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) AS n
          FROM {v_candidates} c CROSS JOIN {v_area_edges} e GROUP BY 1, 2),
        i AS (SELECT candidate_id, min(area) AS area FROM x WHERE n % 2 = 1 GROUP BY 1),
        f AS (SELECT c.candidate_id, e.area, (x1 - lon) * cos(radians(lat)) * k AS ax, (y1 - lat) * k AS ay, (x2 - x1) * cos(radians(lat)) * k AS dx, (y2 - y1) * k AS dy
          FROM {v_candidates} c CROSS JOIN {v_area_edges} e CROSS JOIN (SELECT 6371008.8 * pi() / 180 AS k) WHERE c.candidate_id NOT IN (SELECT candidate_id FROM i)),
        t AS (SELECT *, least(greatest(coalesce(-(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0), 0), 0), 1) AS t FROM f),
        d AS (SELECT candidate_id, area, round(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2), 3) AS d FROM t),
        n AS (SELECT candidate_id, arg_min(area, (d, area)) AS area, min(d) AS d FROM d GROUP BY 1)
       SELECT candidate_id, area, 'inside' AS way, 0.0::double AS distance_m FROM i UNION ALL SELECT candidate_id, area, 'nearest', round(d, 2) FROM n""",
)
def area_or_nearest(spark, sf):
    points = candidates(spark, sf).select("candidate_id", "lon", "lat")
    found = D.assign_or_nearest(points, view(spark, sf, "v_area_edges"), 0.1)
    return rounded(points.join(found, ["lon", "lat"]).drop("lon", "lat"), "distance_m", digits=2)


@query(
    "land_cover_shares",
    """WITH g AS (SELECT CAST(floor(lon / 0.1) AS BIGINT) AS cx, CAST(floor(lat / 0.1) AS BIGINT) AS cy, segment, count(*) AS n FROM {v_candidates} GROUP BY 1, 2, 3),
        s AS (SELECT cx, cy, sum(n) AS a, coalesce(sum(n) FILTER (segment = 'BUILDING'), 0) AS b, coalesce(sum(n) FILTER (segment = 'MACHINERY'), 0) AS m, coalesce(sum(n) FILTER (segment = 'HOUSEHOLD'), 0) AS h FROM g GROUP BY 1, 2)
       SELECT cx, cy, round(b / a, 6) AS "class_BUILDING", round(m / a, 6) AS "class_MACHINERY", round(h / a, 6) AS "class_HOUSEHOLD",
         CASE WHEN b >= m AND b >= h THEN 'BUILDING' WHEN m >= h THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS dominant_class FROM s""",
)
def land_cover_shares(spark, sf):
    x, y = D.grid_cell(F.col("lon"), F.col("lat"), 0.1)
    pixels = candidates(spark, sf).select(x.alias("cx"), y.alias("cy"), "segment", F.lit(1.0).alias("area_m2"))
    classes = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    out = S.class_shares(pixels, ["cx", "cy"], "segment", "area_m2", classes)
    return rounded(out, *[f"class_{c}" for c in classes])


@query(
    "building_density",
    """SELECT CAST(floor(lon / 0.05) AS BIGINT) AS cx, CAST(floor(lat / 0.05) AS BIGINT) AS cy, count(*) AS buildings, round(count(*) / 25.0, 6) AS per_km2,
         round(sum(abs(balance)), 3) AS footprint_m2, round(sum(abs(balance)) / 25e6, 8) AS built_up_share FROM {v_candidates} GROUP BY 1, 2""",
)
def building_density(spark, sf):
    x, y = D.grid_cell(F.col("lon"), F.col("lat"), 0.05)
    rows = candidates(spark, sf).select(x.alias("cx"), y.alias("cy"), F.abs("balance").alias("area_m2"))
    out = rounded(S.building_density(rows, ["cx", "cy"], 25.0), "per_km2")
    return rounded(rounded(out, "footprint_m2", digits=3), "built_up_share", digits=8)


@query(
    "largest_footprints",
    """SELECT candidate_id, CAST(area AS INT) AS area, row_number() OVER (PARTITION BY area ORDER BY abs(balance) DESC, candidate_id) AS rank FROM {v_candidates}
       WHERE abs(balance) >= 150 QUALIFY row_number() OVER (PARTITION BY area ORDER BY abs(balance) DESC, candidate_id) <= 5""",
)
def largest_footprints(spark, sf):
    rows = candidates(spark, sf).withColumn("area_m2", F.abs("balance"))
    return S.largest_per_cell(rows, ["area"], "candidate_id").select("candidate_id", "area", "rank")


CORNER = "CAST(CAST(round({x} * 1e7) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round({y} * 1e7) AS BIGINT) AS VARCHAR)"


@query(
    "shortlisted_footprints",
    f"""WITH m AS (SELECT *, (e - w) * cos(radians(s)) * k * (n - s) * k AS area_m2, (w + e) / 2 AS lon, (s + n) / 2 AS lat,
          substr(sha256({" || ',' || ".join(CORNER.format(x=x, y=y) for x, y in ("ws", "es", "en", "wn"))}), 1, 20) AS building_id
          FROM {{v_buildings}} CROSS JOIN (SELECT 6371008.8 * pi() / 180 AS k)),
        o AS (SELECT * FROM m WHERE area_m2 >= 150 QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY source, line) = 1),
        x AS (SELECT o.building_id, o.source, o.line, o.area_m2, a.area, (a.area * 3) % 25 AS priority,
            count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) AS crossed
          FROM o CROSS JOIN {{v_area_edges}} a GROUP BY ALL),
        f AS (SELECT * FROM x WHERE crossed % 2 = 1 QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY priority) = 1)
       SELECT building_id, source, line, area, priority, round(area_m2, 3) AS area_m2, CAST(row_number() OVER (PARTITION BY area ORDER BY area_m2 DESC, building_id) AS INT) AS rank
       FROM f QUALIFY rank <= 5""",
)
def shortlisted_footprints(spark, sf):
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(point("w", "s"), point("e", "s"), point("e", "n"), point("w", "n"))
    edges = view(spark, sf, "v_area_edges")
    areas = edges.select("area").distinct().withColumn("priority", F.col("area") * 3 % 25)
    out = S.shortlisted_footprints(view(spark, sf, "v_buildings").select("source", "line", ring.alias("ring")), areas, edges, 0.1)
    return rounded(out.drop("lon", "lat"), "area_m2", digits=3)


@query(
    "service_family_distances",
    f"""SELECT c.site_id, round(min({CS}) FILTER (segment = 'BUILDING'), 3) AS dist_building_m, round(min({CS}) FILTER (segment = 'MACHINERY'), 3) AS dist_machinery_m
        FROM {{v_sites}} c CROSS JOIN {{v_candidates}} s GROUP BY 1""",
)
def service_family_distances(spark, sf):
    points = sites(spark, sf).select("site_id", "lon", "lat")
    families = {"building": F.col("segment") == "BUILDING", "machinery": F.col("segment") == "MACHINERY"}
    out = points.join(S.family_distances(points, candidates(spark, sf), families), ["lon", "lat"]).drop("lon", "lat")
    return rounded(out, "dist_building_m", "dist_machinery_m", digits=3)


@query(
    "measurement_support",
    f"""SELECT c.candidate_id, round(min({CS}), 3) AS nearest_reading_m, CAST(coalesce(sum(n) FILTER ({CS} <= 1000), 0) AS BIGINT) AS readings_1000, CAST(coalesce(sum(n) FILTER ({CS} <= 5000), 0) AS BIGINT) AS readings_5000
        FROM {{v_candidates}} c CROSS JOIN (SELECT lon, lat, count(*) AS n FROM {{v_measure}} GROUP BY 1, 2) s GROUP BY 1""",
)
def measurement_support(spark, sf):
    points = candidates(spark, sf).select("candidate_id", "lon", "lat")
    out = points.join(S.measurement_support(points, view(spark, sf, "v_measure")), ["lon", "lat"]).drop("lon", "lat")
    return rounded(out, "nearest_reading_m", digits=3)


@query(
    "regional_factors",
    """WITH f AS (SELECT n_nationkey AS area, n_regionkey / 4.0 AS factor FROM nation WHERE n_regionkey > 0)
       SELECT candidate_id, round(coalesce(factor, 0.5), 4) AS factor FROM {v_candidates} c LEFT JOIN f ON f.area = c.area""",
)
def regional_factors(spark, sf):
    factors = view(spark, sf, "nation").where("n_regionkey > 0").select(
        F.col("n_nationkey").alias("area"), (F.col("n_regionkey") / 4).alias("factor")
    )
    out = S.with_regional_factor(candidates(spark, sf), factors, "area", {"factor": 0.5})
    return rounded(out.select("candidate_id", "factor"), "factor", digits=4)


@query(
    "site_rollup",
    """SELECT site_id, array_to_string(list_sort(list_distinct(list(rat))), ',') AS technologies, CAST(max(band) AS INT) AS max_generation, count(*) AS radios, round(sum(bandwidth), 4) AS bandwidth_mhz
       FROM {v_radio} GROUP BY 1""",
)
def site_rollup(spark, sf):
    out = S.site_rollup(view(spark, sf, "v_radio"), "site_id", F.col("band")).drop("last_seen")
    return rounded(out, "bandwidth_mhz", digits=4)


@query("operator_technology_counts", "SELECT rat, region_id, count(*) AS radios FROM {v_radio} GROUP BY 1, 2")
def operator_technology_counts(spark, sf):
    return view(spark, sf, "v_radio").groupBy("rat", "region_id").agg(F.count("*").alias("radios"))


@query("identity_data_request", "SELECT mcc, mnc, lac, cell_id, count(*) AS samples, count(DISTINCT day) AS days FROM {v_measure} GROUP BY 1, 2, 3, 4")
def identity_data_request(spark, sf):
    return S.identity_request(view(spark, sf, "v_measure"), ["mcc", "mnc", "lac", "cell_id"])


@query(
    "alerts_with_open_orders",
    f"""WITH {ALERT_SQL}, o AS (SELECT DISTINCT concat('TWR_', user_id) AS tower FROM events WHERE event_type = 'signup' AND value > 100)
        SELECT alerts.tower, level_rank, o.tower IS NOT NULL AS has_open_order FROM alerts LEFT JOIN o ON o.tower = alerts.tower""",
)
def alerts_with_open_orders(spark, sf):
    orders = view(spark, sf, "events").where("event_type = 'signup'").select(
        F.concat(F.lit("TWR_"), F.col("user_id").cast("string")).alias("tower"),
        F.when(F.col("value") > 100, "open").otherwise("closed").alias("state"),
    )
    return G.with_open_orders(N.tower_alerts(tower_kpi(spark, sf)), orders).select("tower", "level_rank", "has_open_order")


@query(
    "service_category_counts",
    """SELECT n_regionkey AS region, count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_acctbal > 5000) AS large FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def service_category_counts(spark, sf):
    rows = view(spark, sf, "customer").join(view(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.category_counts(
        rows.withColumnRenamed("n_regionkey", "region"), ["region"],
        {"building": F.col("c_mktsegment") == "BUILDING", "large": F.col("c_acctbal") > 5000},
    )


@query(
    "dataset_profile",
    """WITH l AS (SELECT 'users' AS c, users AS v FROM {v_tower_day} UNION ALL SELECT 'download', download FROM {v_tower_day} UNION ALL SELECT 'drop_rate', drop_rate FROM {v_tower_day})
       SELECT c AS "column", count(*) AS rows, 0.0 AS missing_share, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS min, round(quantile_cont(v, 0.25), 5) AS p25, round(median(v), 5) AS p50,
         round(quantile_cont(v, 0.75), 5) AS p75, round(max(v), 5) AS max, (SELECT min(date) FROM {v_tower_day}) AS first_day, (SELECT max(date) FROM {v_tower_day}) AS last_day FROM l GROUP BY 1""",
)
def dataset_profile(spark, sf):
    out = profile(view(spark, sf, "v_tower_day"), ["users", "download", "drop_rate"], "date")
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max", digits=5)


@query(
    "household_features",
    """SELECT customer_id, CAST(phone_service AS INT) + CAST(online_security AS INT) + CAST(premium_tech_support AS INT) + CAST(streaming_tv AS INT) + CAST(streaming_movies AS INT) + CAST(streaming_music AS INT) AS total_services,
         CAST(online_security AND premium_tech_support AS INT) AS has_security_bundle, CAST(streaming_tv AND streaming_movies AND streaming_music AS INT) AS has_streaming_bundle,
         round(extra_data_charges / (total_charges + 1e-5), 6) AS extra_data_ratio, CAST(gb_download >= 50 AS INT) AS is_heavy_data_user,
         CASE WHEN tenure_months <= 12 THEN '0-12m' WHEN tenure_months <= 24 THEN '13-24m' WHEN tenure_months <= 48 THEN '25-48m' ELSE '49m+' END AS tenure_cohort FROM {v_households}""",
)
def household_features(spark, sf):
    out = S.household_features(view(spark, sf, "v_households")).select(
        "customer_id", "total_services", "has_security_bundle", "has_streaming_bundle", "extra_data_ratio", "is_heavy_data_user", "tenure_cohort"
    )
    return rounded(out, "extra_data_ratio")


@query(
    "discount_offers",
    """WITH t AS (SELECT *, CASE WHEN churn_probability >= 0.6 AND (total_revenue >= 2500 OR monthly_charge >= 75) THEN 'VIP_SAVE' WHEN churn_probability >= 0.6 THEN 'STANDARD_SAVE'
            WHEN churn_probability >= 0.35 AND contract = 'Month-to-Month' THEN 'PROACTIVE_SAVE' WHEN churn_probability >= 0.35 THEN 'LOYALTY_COURTESY' ELSE 'NO_DISCOUNT' END AS retention_tier FROM {v_households}),
        d AS (SELECT *, CASE retention_tier WHEN 'VIP_SAVE' THEN 20 WHEN 'STANDARD_SAVE' THEN 15 WHEN 'PROACTIVE_SAVE' THEN 12 WHEN 'LOYALTY_COURTESY' THEN 5 ELSE 0 END AS discount_pct FROM t),
        c AS (SELECT *, monthly_charge * 12 * discount_pct / 100.0 AS cost, monthly_charge * 12 * churn_probability * 0.75 AS saved FROM d)
       SELECT customer_id, retention_tier, discount_pct, CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_level,
         CAST(round_even(CAST(monthly_charge * (1 - discount_pct / 100.0) AS DECIMAL(18, 8)), 2) AS DOUBLE) AS new_monthly_charge, CAST(round_even(CAST(cost AS DECIMAL(18, 8)), 2) AS DOUBLE) AS annual_discount_cost, CAST(round_even(CAST(saved AS DECIMAL(18, 8)), 2) AS DOUBLE) AS expected_saved_revenue,
         CAST(round_even(CAST(CASE WHEN discount_pct > 0 THEN saved - cost ELSE 0 END AS DECIMAL(18, 8)), 2) AS DOUBLE) AS net_retention_gain,
         CAST(round_even(CAST(CASE WHEN cost > 0 THEN (saved - cost) / cost * 100.0 ELSE 0 END AS DECIMAL(18, 8)), 1) AS DOUBLE) AS roi_pct,
         concat_ws(';', CASE WHEN current_offer = 'Offer E' THEN 'migrate_from_offer_e' END, CASE WHEN extra_data_charges > 0 THEN 'bill_shock' END, CASE WHEN refunds > 0 THEN 'service_friction' END,
           CASE WHEN internet_type = 'Fiber Optic' AND NOT premium_tech_support THEN 'fiber_without_support' END,
           CASE WHEN gb_download >= 50 THEN 'heavy_data_user' WHEN gb_download < 10 AND internet_type <> 'No internet service' THEN 'low_data_user' END) AS notes FROM c""",
)
def discount_offers(spark, sf):
    out = S.discount_offers(view(spark, sf, "v_households"))
    return out.select(
        "customer_id", "retention_tier", "discount_pct", "risk_level", "new_monthly_charge", "annual_discount_cost",
        "expected_saved_revenue", "net_retention_gain", "roi_pct", "notes",
    )


@query(
    "site_classes",
    """WITH b AS (SELECT candidate_id, abs(balance) / 3 AS density, area * 60.0 AS road, abs(balance) AS gap, area * 2.0 AS mhz, area % 4 AS carriers, CASE WHEN area = 3 THEN 'MICRO' ELSE 'MACRO' END AS kind FROM {v_candidates})
       SELECT candidate_id, CASE WHEN density >= 1000 THEN 'Urban_High_Density' WHEN density >= 100 THEN 'Suburban_Medium_Density' WHEN density >= 5 THEN 'Rural_Low_Density' ELSE 'Remote_Desert' END AS population_class,
         CASE WHEN road <= 250 THEN 'Highway_Corridor' WHEN road <= 1000 THEN 'Road_Adjacent' WHEN road <= 5000 THEN 'Moderate_Access' ELSE 'Remote_OffRoad' END AS road_class, CAST(gap > 5000 AS INT) AS is_isolated,
         CASE WHEN kind = 'MICRO' OR (density > 2500 AND gap < 250) THEN 'Micro_Cell_Hotspot' WHEN density >= 1200 OR mhz >= 40 OR carriers >= 3 THEN 'Urban_HighCapacity_Macro'
           WHEN density >= 150 OR mhz >= 20 OR road < 500 THEN 'Suburban_Standard_Macro' ELSE 'Rural_Coverage_Macro' END AS equipment_tier FROM b""",
)
def site_classes(spark, sf):
    rows = candidates(spark, sf).select(
        "candidate_id", (F.abs("balance") / 3).alias("population_density_1km"), (F.col("area") * 60.0).alias("dist_to_nearest_road_m"),
        F.abs("balance").alias("dist_to_nearest_site_m"), (F.col("area") * 2.0).alias("total_bandwidth_mhz"),
        (F.col("area") % 4).alias("total_carrier_count"), F.when(F.col("area") == 3, "MICRO").otherwise("MACRO").alias("primary_tower_type"),
    )
    return rows.select(
        "candidate_id", L.population_class(F.col("population_density_1km")).alias("population_class"),
        L.road_class(F.col("dist_to_nearest_road_m")).alias("road_class"),
        L.coverage_isolated(F.col("dist_to_nearest_site_m")).alias("is_isolated"), L.equipment_tier().alias("equipment_tier"),
    )
