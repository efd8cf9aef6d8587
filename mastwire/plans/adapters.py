"""Views that give the driver's tables a telecom shape.

Every view is one SELECT that Spark and DuckDB both run. Braces name a table or another
view. Whole tables are read: no view samples, caps or filters by id.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mastwire.operators.network import BAND_PREFIXES
from mastwire.operators.subscribers import BINARY, CHECKS, PRESENT, month_column

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

# Tower-name prefixes by nation, so that band rules and clusters have something to find: the rules'
# own prefixes in turn, and one that no rule knows.
NATIONS = 25
KNOWN_PREFIXES = [prefix for prefixes, _ in BAND_PREFIXES for prefix in prefixes] + ["OTHER"]
PREFIXES = ",".join(KNOWN_PREFIXES[i % len(KNOWN_PREFIXES)] for i in range(NATIONS))

VIEWS = {
    "v_tower_day": """
        SELECT concat('TWR_', l_suppkey) AS tower, CAST(l_shipdate AS DATE) AS date,
               sum(l_quantity) AS users,
               round(avg(l_extendedprice) / 5000, 10) AS download,
               round(avg(l_extendedprice) / 20000, 10) AS upload,
               round(avg(l_discount) * 20, 10) AS drop_rate,
               round(100 * (1 - avg(l_tax) / 2), 10) AS availability
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "v_tower_kpi": """
        SELECT tower, date, users AS connected_users, download AS dl_throughput_mbps,
               upload AS ul_throughput_mbps, drop_rate AS erab_drop_rate,
               availability AS availability_pct,
               round(100 - drop_rate / 2, 10) AS rrc_setup_sr,
               round(100 - (100 - availability) / 3, 10) AS erab_estab_sr,
               round(100 - drop_rate * 1.5, 10) AS handover_sr,
               round(1 - drop_rate / 60, 10) AS handover_intra_sr
        FROM {v_tower_day}""",
    "v_tower_map": f"""
        SELECT concat('TWR_', s_suppkey) AS tower,
               concat(split_part('{PREFIXES}', ',', CAST(s_nationkey + 1 AS INT)), '_', s_suppkey)
                   AS original_name
        FROM {{supplier}}""",
    "v_cell_day": """
        SELECT m.original_name AS name, t.* FROM {v_tower_kpi} t JOIN {v_tower_map} m ON t.tower = m.tower""",
    "v_traffic": """
        SELECT 'network' AS series, CAST(l_shipdate AS DATE) AS date,
               round(sum(l_extendedprice) / 1000, 2) AS volume
        FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)""",
    "v_scores": """
        SELECT d.doc_id AS id, l.quality AS y,
               CAST(round(0.3 * l.quality + 0.7 * ((d.doc_id * 7919) % 1009) / 1009.0, 6) AS DOUBLE) AS score
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "v_sites": """
        SELECT s_suppkey AS site_id, 13 + (s_suppkey * 7919 % 7000) / CAST(10000 AS DOUBLE) AS lon,
               CAST(32.6 AS DOUBLE) + (s_suppkey * 104729 % 3500) / CAST(10000 AS DOUBLE) AS lat,
               s_nationkey % 2 = 0 AS has_network_a, s_nationkey % 3 = 0 AS has_network_b,
               s_acctbal AS balance
        FROM {supplier}""",
    "v_candidates": """
        SELECT c_custkey AS candidate_id, 13 + (c_custkey * 7907 % 70000) / CAST(100000 AS DOUBLE) AS lon,
               CAST(32.6 AS DOUBLE) + (c_custkey * 104723 % 35000) / CAST(100000 AS DOUBLE) AS lat,
               c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS area
        FROM {customer}""",
    "v_measure": """
        SELECT event_id, CAST(ts AS DATE) AS day, user_id % 7 AS device, event_type AS net_type,
               606 AS mcc, user_id % 2 AS mnc, user_id % 50 AS lac, user_id AS cell_id,
               13 + (user_id * 7919 % 700) / CAST(1000 AS DOUBLE) AS lon,
               CAST(32.6 AS DOUBLE) + (user_id * 104729 % 350) / CAST(1000 AS DOUBLE) AS lat,
               round(-60 - value / 10, 3) AS dbm, value
        FROM {events}""",
    "v_radio": """
        SELECT event_id, event_type AS rat, CAST(user_id % 20 AS STRING) AS region_id,
               CAST(user_id AS STRING) AS site_id,
               13 + (user_id * 7919 % 700) / CAST(1000 AS DOUBLE) + value / 100000 AS longitude,
               CAST(32.6 AS DOUBLE) + (user_id * 104729 % 350) / CAST(1000 AS DOUBLE) + value / 100000 AS latitude,
               ts, CAST(event_id % 5 AS INT) AS channel, CAST(floor(value) % 3 AS INT) AS band,
               CASE WHEN value > 40 THEN floor(value) / CAST(8 AS DOUBLE) END AS bandwidth, value
        FROM {events}""",
}


def _subscriber_sql() -> str:
    """A wide subscriber export: three order years stand for the contract's three months.

    A subscriber without an order in a year has the voice and data blocks missing there.
    Lines are summed per order first, so orders are counted without a distinct count.
    """
    month_ends = {6: "2014-06-30", 7: "2014-07-31", 8: "2014-08-31"}
    years = {6: 1996, 7: 1997, 8: 1998}
    flags, statuses = ("R", "A", "N"), ("O", "F")
    per_order = ["sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS first_lines"] + [
        f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END) AS q_{f}{s}"
        for f in flags
        for s in statuses
    ]
    inner, outer = [], []
    for month, year in years.items():
        here = f"year(o_orderdate) = {year}"
        inner += [
            f"count(CASE WHEN {here} THEN 1 END) AS n_{month}",
            f"max(CASE WHEN {here} THEN o_orderdate END) AS d_{month}",
            f"max(CASE WHEN {here} THEN floor(o_totalprice / 1000) END) AS mx_{month}",
            f"sum(CASE WHEN {here} THEN first_lines * floor(o_totalprice / 1000) END) AS amt_{month}",
        ]
        for f in flags:
            for s in statuses:
                inner.append(f"sum(CASE WHEN {here} THEN q_{f}{s} END) AS q_{f}{s}_{month}")
        has = f"n_{month} > 0"
        parts = [f"q_{f}{s}_{month}" for f in flags for s in statuses]
        day = f"concat('2014-0{month}-', lpad(CAST(least(day(d_{month}), 30) AS STRING), 2, '0'))"
        for position, (base, checks) in enumerate(CHECKS.items()):
            name = month_column(base, month)
            usage = f"coalesce({parts[position % len(parts)]}, 0)"
            if base == "total_og_mou":
                sql = f"coalesce(q_RO_{month}, 0) + coalesce(q_RF_{month}, 0)"
            elif base == "total_ic_mou":
                sql = f"coalesce(q_AO_{month}, 0) + coalesce(q_AF_{month}, 0)"
            elif base == "vol_2g_mb":
                sql = f"coalesce(q_NO_{month}, 0) * 10"
            elif base == "vol_3g_mb":
                sql = f"coalesce(q_NF_{month}, 0) * 10"
            elif base == "total_rech_num":
                sql = f"CAST(coalesce(n_{month}, 0) AS DOUBLE)"
            elif base == "total_rech_amt":
                sql = f"coalesce(amt_{month}, 0)"
            elif base in ("max_rech_amt", "last_day_rch_amt"):
                sql = f"coalesce(mx_{month}, 0)"
            elif base == "arpu":
                sql = f"coalesce(amt_{month}, 0) / 2 - 20"
            elif base == "date_of_last_rech":
                sql = f"CASE WHEN {has} THEN {day} END"
            elif base == "last_date_of_month":
                sql = f"'{month_ends[month]}'"
            elif base == "date_of_last_rech_data":
                sql = f"CASE WHEN q_NO_{month} > 0 THEN {day} END"
            elif BINARY in checks:
                sql = f"CASE WHEN q_NO_{month} > 0 THEN CAST(n_{month} % 2 AS DOUBLE) END"
            elif base in ("total_rech_data", "count_rech_2g", "count_rech_3g"):
                sql = f"CASE WHEN q_NO_{month} > 0 THEN CAST(1 + n_{month} % 3 AS DOUBLE) END"
            elif base in ("max_rech_data", "av_rech_amt_data", "arpu_2g", "arpu_3g"):
                sql = f"CASE WHEN q_NO_{month} > 0 THEN q_NO_{month} / 2 END"
            elif base.startswith("monthly") or base.startswith("sachet"):
                sql = f"CAST(floor({usage} / 40) AS DOUBLE)"
            elif PRESENT not in checks:
                sql = f"CASE WHEN {has} THEN {usage} END"
            else:
                sql = usage
            outer.append(f"{sql} AS {name}")
    return f"""
        SELECT concat('S', c_custkey) AS id, CAST(180 + c_custkey * 37 % 4000 AS DOUBLE) AS aon,
               CASE WHEN coalesce(later, 0) = 0 THEN 1.0 ELSE 0.0 END AS churn_probability,
               {", ".join(outer)}
        FROM {{customer}} LEFT JOIN (
            SELECT o_custkey, sum(CASE WHEN year(o_orderdate) = 1999 THEN 1 ELSE 0 END) AS later,
                   {", ".join(inner)}
            FROM {{orders}} JOIN (
                SELECT l_orderkey, {", ".join(per_order)} FROM {{lineitem}} GROUP BY l_orderkey) AS lines
            ON o_orderkey = l_orderkey
            GROUP BY o_custkey) AS usage ON c_custkey = o_custkey"""


VIEWS["v_subscribers"] = _subscriber_sql()

# A catalogue with one offer per brand: its size does not depend on the size of the part table.
VIEWS["v_offers"] = """
        SELECT concat('OF_', n) AS offer_id, concat('Offer ', n) AS name_en, concat('عرض ', n) AS name_ar,
               CASE n % 3 WHEN 0 THEN 'Monthly offers' WHEN 1 THEN 'Daily offers' ELSE 'Weekly offers' END AS family_en,
               round(2 + mean_size / 4 + n % 7 * 3, 2) AS price_lyd,
               CAST(CASE n % 3 WHEN 0 THEN 720 WHEN 1 THEN 24 ELSE 168 END AS DOUBLE) AS validity_hours,
               CASE WHEN n % 4 = 0 OR n % 9 = 5 THEN NULL ELSE round(mean_size, 1) END AS data_gb,
               CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS data_unlimited,
               CASE WHEN n % 4 <> 0 AND n % 9 = 5 THEN 'none' WHEN n % 2 = 0 THEN 'stated' ELSE 'name' END AS volume_source,
               CAST(CASE WHEN n % 5 = 0 THEN 100 WHEN n % 9 = 5 THEN 12 END AS DOUBLE) AS voice_minutes,
               0 AS voice_unlimited, CAST(CASE WHEN n % 11 = 0 THEN 3 END AS DOUBLE) AS members,
               CASE WHEN n % 6 = 5 THEN '5G' END AS network,
               CAST(CASE WHEN n % 8 = 1 THEN 1 END AS DOUBLE) AS valid_from_hour,
               CAST(CASE WHEN n % 8 = 1 THEN 7 END AS DOUBLE) AS valid_to_hour
        FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS n, avg(p_size) AS mean_size
              FROM {part} GROUP BY p_brand) AS brands"""

VIEWS["v_decisions"] = """
        SELECT concat('S', c_custkey) AS subscriber_id,
               CASE WHEN status = 'scenario' THEN p END AS churn_probability,
               CASE status WHEN 'scenario' THEN CASE WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END
                    WHEN 'risk_unavailable' THEN 'unavailable' ELSE status END AS risk_band,
               CASE WHEN orders >= 14 THEN 'very_high' WHEN orders >= 11 THEN 'high' WHEN orders >= 9 THEN 'medium'
                    WHEN orders >= 6 THEN 'low' ELSE 'very_low' END AS value_tier,
               status AS value_status,
               CASE WHEN status = 'scenario' THEN round(spend / 1000, 2) END AS value_12m_base_lyd,
               CASE WHEN c_nationkey % 3 = 0 THEN 'PAYG' ELSE concat('OF_', 1 + c_nationkey % 25) END AS bundle_held,
               orders % 4 <> 1 AS uses_voice, orders % 3 <> 1 AS uses_data,
               round(coalesce(spend, 0) / 5000, 2) AS monthly_spend_lyd, c_mktsegment AS segment
        FROM (SELECT c.*, coalesce(n, 0) AS orders, spend,
                     round((c_custkey * 7919 % 1000) / 1000.0, 3) AS p,
                     CASE WHEN n IS NULL THEN 'already_silent' WHEN c_acctbal < -500 THEN 'risk_unavailable'
                          ELSE 'scenario' END AS status
              FROM {customer} c LEFT JOIN (
                  SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spend FROM {orders} GROUP BY o_custkey) o
              ON c_custkey = o_custkey) AS base"""

VIEWS["v_reviews"] = """
        SELECT concat('S', user_id) AS subscriber_id,
               CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'rejected' END AS decision,
               concat('reviewer ', user_id % 3) AS reviewer, ts AS reviewed_at, '' AS note, 'c1' AS campaign_id
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
              FROM {events} WHERE event_type IN ('purchase', 'error')) AS first_events WHERE i = 1"""

VIEWS["v_plan"] = """
        SELECT candidate_id, lon, lat, area <> 9 AS inside_libya, area % 11 <> 0 AS population_data_available,
               area % 13 <> 1 AS terrain_data_available, area % 7 <> 2 AS worldcover_data_available,
               segment = 'MACHINERY' AND area > 15 AS worldcover_is_water,
               CASE WHEN balance > 9500 THEN NULL ELSE abs(balance) * 12 END AS population_sum_5km,
               abs(balance) * 1.5 AS dist_to_nearest_site_m, area * 220 - CAST(100 AS DOUBLE) AS dist_to_nearest_road_m,
               balance / 20 AS elevation_m, balance / 100 - 20 AS elevation_prominence_3km,
               CAST(area % 20 AS DOUBLE) AS terrain_slope_deg
        FROM {v_candidates}"""

# One six-sided outline per nation; neighbours overlap.
VIEWS["v_area_edges"] = """
        SELECT n_nationkey AS area, x + 0.09 * cos(a * i) AS x1, y + 0.05 * sin(a * i) AS y1,
               x + 0.09 * cos(a * (i + 1)) AS x2, y + 0.05 * sin(a * (i + 1)) AS y2
        FROM (SELECT n_nationkey, 13.07 + (n_nationkey % 5) * CAST(0.14 AS DOUBLE) AS x, i, acos(-1) / 3 AS a,
                     32.63 + floor(n_nationkey / 5) * CAST(0.07 AS DOUBLE) AS y
              FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(i)) AS centres"""

# A rectangle for each customer; a second source repeats a seventh of them.
VIEWS["v_buildings"] = """
        SELECT v.source, candidate_id AS line, lon - d AS w, lat - d AS s, lon + d AS e, lat + d * CAST(0.8 AS DOUBLE) AS n
        FROM (SELECT *, sqrt(abs(balance)) / CAST(200000 AS DOUBLE) AS d FROM {v_candidates}) AS c
        CROSS JOIN (VALUES ('a'), ('b')) AS v(source) WHERE v.source = 'a' OR candidate_id % 7 = 0"""

VIEWS["v_cells"] = """
        SELECT event_id, CASE event_type WHEN 'view' THEN 'LTE' WHEN 'click' THEN 'UMTS' WHEN 'purchase' THEN 'GSM'
                    WHEN 'signup' THEN 'NR' ELSE 'WIFI' END AS radio,
               CAST(CASE WHEN value > 100 THEN 605 ELSE 606 END AS DOUBLE) AS mcc, CAST(user_id % 2 AS DOUBLE) AS net,
               CASE WHEN value < 1 THEN NULL ELSE CAST(user_id % 20 AS DOUBLE) END AS area,
               CAST(user_id AS DOUBLE) + CASE WHEN value BETWEEN 1 AND 2 THEN 0.5 ELSE 0 END AS cell,
               13 + value / 100 AS lon, CASE WHEN value > 90 THEN CAST(95 AS DOUBLE) ELSE 32 + value / 100 END AS lat,
               CAST(1600000000 + event_id % 1000 * 100000 AS DOUBLE) AS created,
               CAST(1600000000 + event_id % 1700 * 80000 AS DOUBLE) AS updated, floor(value / 4) AS samples
        FROM {events}"""

# Radios of two networks; half of them say nothing about theirs.
VIEWS["v_attribution"] = """
        SELECT event_id, 13 + (user_id * 7919 % 7000) / CAST(10000 AS DOUBLE) + floor(value) / 20000 AS lon,
               CAST(32.6 AS DOUBLE) + (user_id * 104729 % 3500) / CAST(10000 AS DOUBLE) + event_id % 7 / CAST(10000 AS DOUBLE) AS lat,
               CASE WHEN user_id % 5 = 0 THEN '0' WHEN user_id % 5 = 1 THEN '1' END AS mnc,
               CASE WHEN value > 95 THEN 'network_a' WHEN value > 90 THEN 'network_b' END AS stated,
               CAST(user_id % 20 AS STRING) AS region_id, CAST(event_id % 5 + 1396 AS INT) AS channel, event_id % 50 = 0 AS confirmed
        FROM {events}"""

# Straight roads between successive sites of a nation.
VIEWS["v_roads"] = """
        SELECT site_id AS road_id, lon AS x1, lat AS y1, x2, y2
        FROM (SELECT s.*, lead(lon) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS x2,
                     lead(lat) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS y2
              FROM {v_sites} s JOIN {supplier} ON s_suppkey = site_id) AS pairs
        WHERE x2 IS NOT NULL"""

VIEWS["v_households"] = """
        SELECT c_custkey AS customer_id, round((c_custkey * 7919 % 1000) / CAST(1000 AS DOUBLE), 3) AS churn_probability,
               abs(c_acctbal) / 90 AS monthly_charge, abs(c_acctbal) / 2 AS total_revenue,
               abs(c_acctbal) / 3 AS total_charges,
               CASE WHEN c_nationkey % 3 = 0 THEN 'Month-to-Month' ELSE 'One Year' END AS contract,
               CASE WHEN c_nationkey % 4 = 0 THEN 'Fiber Optic' WHEN c_nationkey % 4 = 1 THEN 'No internet service' ELSE 'Cable' END AS internet_type,
               CASE WHEN c_nationkey % 5 = 0 THEN 'Offer E' ELSE 'Offer A' END AS current_offer,
               CASE WHEN c_acctbal < 0 THEN -c_acctbal / 10 ELSE CAST(0 AS DOUBLE) END AS extra_data_charges,
               CASE WHEN c_acctbal > 9000 THEN CAST(15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS refunds,
               abs(c_acctbal) / 120 AS gb_download, c_custkey * 31 % 90 AS tenure_months,
               c_nationkey % 2 = 0 AS phone_service, c_nationkey % 3 = 0 AS online_security, c_acctbal > 4000 AS premium_tech_support,
               c_nationkey > 10 AS streaming_tv, c_nationkey > 12 AS streaming_movies, c_acctbal > 1000 AS streaming_music
        FROM {customer}"""

_NAME = re.compile(r"\{([a-z]\w*)\}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Lines of the order table for one task of the tower panel.
LINES_PER_TASK = 200_000


def line_tasks(spark: SparkSession, folder: str) -> int:
    """Tasks for the tower panel: they grow with the lines, which the files' footers count."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table(spark, folder, "lineitem").count() // LINES_PER_TASK))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or an adapter view as a DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    text = VIEWS[name]
    inputs = {n: view(spark, folder, n) for n in set(_NAME.findall(text))}
    if name == "v_tower_day":
        # Nearly every line is a tower's only one of its day: summing before the shuffle gains nothing
        # and fills a large hash table, so the lines themselves are dealt by tower and day.
        dated = inputs["lineitem"].withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
        inputs["lineitem"] = dated.repartition(line_tasks(spark, folder), "l_suppkey", "l_shipdate")
    return spark.sql(text, **inputs)


def tower_days(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Columns of the tower panel with a tower's days in one task, for windows by tower.

    A number of tasks is given because they would else be merged by their packed size, a small
    part of what the windows keep in memory.
    """
    return view(spark, folder, "v_tower_day").select("tower", "date", *columns).repartition(line_tasks(spark, folder), "tower")


@lru_cache(maxsize=None)
def needed(names: tuple[str, ...]) -> tuple[str, ...]:
    """The views behind the given ones, each after those it reads."""
    out: list[str] = []
    for name in names:
        if name in TABLES:
            continue
        for n in needed(tuple(dict.fromkeys(_NAME.findall(VIEWS[name])))) + (name,):
            if n not in out:
                out.append(n)
    return tuple(out)


def as_oracle(query: str) -> str:
    """An oracle query in which braces name views, with those views put in front as CTEs."""
    names = needed(tuple(dict.fromkeys(_NAME.findall(query))))
    ctes = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[n])})" for n in names]
    body = _NAME.sub(lambda m: m.group(1), query).strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
    if body.startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
