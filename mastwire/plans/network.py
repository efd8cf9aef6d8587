"""Registered network queries: panels, tower health, alerts, congestion and steering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mastwire.functions.calendar import calendar_features, harmonic_features, weekend, wave
from mastwire.functions.numeric import half_even, settled
from mastwire.operators import network as N
from mastwire.operators import panel as P
from mastwire.operators.models import TRANSIT
from mastwire.operators import steering as S
from mastwire.plans.adapters import line_tasks, tower_days, view
from mastwire.plans.registry import query

KEYS, DATE = ["tower"], "date"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def tower_kpi(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_tower_kpi")


def bands(spark: SparkSession, sf: str) -> DataFrame:
    # Cells are counted by name and day: a number of tasks that grows with the lines bounds one task's table of them.
    return N.band_panel(view(spark, sf, "v_cell_day").repartition(line_tasks(spark, sf), "date", "name"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    day = tower_days(spark, sf, "users", "download", "upload", "drop_rate", "availability")
    return S.with_cluster(S.congestion_scores(S.with_own_ceiling(day)), view(spark, sf, "v_tower_map"))


# SQL pieces shared by several oracles.
BAND_SQL = """
    CASE WHEN starts_with(name, 'NT') THEN 350
         WHEN regexp_matches(name, '^(SUR|TLILM|COW|VIP|TS|SBR)') THEN 400
         WHEN regexp_matches(name, '^(NSB|NSU)') THEN 1556
         WHEN regexp_matches(name, '^(ZWY|ZW|PH)') THEN 1700
         WHEN regexp_matches(name, '^(NZW|ZAW|TR|T|TI)') THEN 3500 ELSE 6200 END"""
BANDS_SQL = f"""bands AS (
    SELECT date, {BAND_SQL} AS band, avg(rrc_setup_sr) AS rrc_setup_sr, avg(erab_estab_sr) AS erab_estab_sr,
           avg(erab_drop_rate) AS erab_drop_rate, avg(handover_intra_sr) AS handover_intra_sr,
           avg(handover_sr) AS handover_sr, avg(availability_pct) AS availability_pct,
           avg(dl_throughput_mbps) AS dl_throughput_mbps, avg(ul_throughput_mbps) AS ul_throughput_mbps,
           avg(connected_users) AS connected_users, count(DISTINCT name) AS cells,
           86400.0 * count(DISTINCT name) * greatest(0.0, 1 - avg(availability_pct) / 100) AS downtime_sec
    FROM {{v_cell_day}} GROUP BY 1, 2)"""
SCORED_SQL = """cap AS (
    SELECT tower, greatest(quantile_cont(users, 0.95), 15.0) AS capacity_95th FROM {v_tower_day} GROUP BY tower),
  scored0 AS (
    SELECT d.*, c.capacity_95th, round_even(users / capacity_95th, 3) AS load_factor,
           round_even(capacity_95th - users, 2) AS headroom,
           upper(regexp_extract(m.original_name, '^([A-Za-z]+)', 1)) AS cluster, m.original_name
    FROM {v_tower_day} d JOIN cap c ON d.tower = c.tower LEFT JOIN {v_tower_map} m ON d.tower = m.tower),
  scored1 AS (
    SELECT *, round_even(0.5 * least(greatest(load_factor * 100, 0), 100)
                  + 0.4 * least(greatest((15.0 - download) / 15.0 * 100.0, 0), 100)
                  + 0.1 * least(greatest(drop_rate / 2.0 * 100.0, 0), 100), 1) AS risk FROM scored0),
  scored AS (
    SELECT *, CASE WHEN risk >= 80 AND download < 5 THEN 'CRITICAL' WHEN risk >= 70 AND download < 8 THEN 'HIGH'
                   WHEN risk >= 60 THEN 'MODERATE' ELSE 'NORMAL' END AS category FROM scored1)"""
PROFILE_SQL = """prof0 AS (
    SELECT tower, avg(rrc_setup_sr) AS rrc, min(rrc_setup_sr) AS rrc_min, stddev_samp(rrc_setup_sr) AS rrc_std,
           avg(erab_drop_rate) AS drp, max(erab_drop_rate) AS drp_max, avg(handover_sr) AS ho,
           avg(availability_pct) AS av, min(availability_pct) AS av_min, avg(dl_throughput_mbps) AS dl,
           stddev_samp(dl_throughput_mbps) AS dl_std, avg(ul_throughput_mbps) AS ul,
           avg(connected_users) AS us, max(connected_users) AS us_max, count(date) AS observation_days
    FROM {v_tower_kpi} GROUP BY tower),
  prof AS (
    SELECT *, CAST(rrc < 99.5 AS INT) + CAST(drp > 0.5 AS INT) + CAST(av < 95 AS INT) + CAST(ho < 97.5 AS INT) AS violations,
           round_even(0.25 * least(greatest((rrc - 95) / 5 * 100, 0), 100)
                    + 0.25 * least(greatest((2 - drp) / 2 * 100, 0), 100)
                    + 0.25 * least(greatest((av - 80) / 20 * 100, 0), 100)
                    + 0.25 * least(greatest(dl / 15 * 100, 0), 100), 2) AS health,
           av >= 90 AND (dl < 2 OR drp > 1 OR rrc < 98) AS sleeping
    FROM prof0)"""


@query(
    "congestion_by_cluster",
    f"""WITH {SCORED_SQL}
    SELECT cluster, count(DISTINCT tower) AS total_towers, round_even(avg(users), 2) AS avg_users_per_tower,
           round_even(max(users), 2) AS peak_tower_users, round_even(avg(download), 2) AS avg_speed_mbps,
           round_even(avg(risk), 2) AS avg_congestion_risk, round_even(sum(headroom), 2) AS total_cluster_headroom
    FROM scored WHERE cluster IS NOT NULL GROUP BY cluster""",
)
def congestion_by_cluster(spark, sf):
    return S.cluster_capacity(scored(spark, sf)).orderBy(F.col("avg_congestion_risk").desc(), "cluster")


@query(
    "capacity_ceilings",
    """SELECT tower, round(greatest(quantile_cont(users, 0.95), 15.0), 6) AS capacity_95th
       FROM {v_tower_day} GROUP BY tower""",
)
def capacity_ceilings(spark, sf):
    return rounded(S.capacity_ceilings(view(spark, sf, "v_tower_day")), "capacity_95th")


@query(
    "congestion_alerts",
    f"""WITH {SCORED_SQL} SELECT tower, date, users, load_factor, headroom, risk, category, cluster
        FROM scored WHERE category IN ('CRITICAL', 'HIGH')""",
)
def congestion_alerts(spark, sf):
    rows = scored(spark, sf).where(F.col("category").isin(*S.CONGESTED))
    return rows.select("tower", "date", "users", "load_factor", "headroom", "risk", "category", "cluster")


@query("steering_offload_plan")
def steering_offload_plan(spark, sf):
    return S.offload_plan(scored(spark, sf))


@query("steering_summary")
def steering_summary(spark, sf):
    rows = scored(spark, sf)
    alerts = rows.where(F.col("category").isin(*S.CONGESTED))
    return S.steering_summary(alerts, S.offload_plan(rows))


@query(
    "steering_latest_recommendations",
    f"""WITH {SCORED_SQL}, a AS (SELECT * FROM scored WHERE category IN ('CRITICAL', 'HIGH')),
      t AS (SELECT * FROM a WHERE date = (SELECT max(date) FROM a))
    SELECT tower, date, risk, category, (SELECT count(*) FROM t) AS total FROM t ORDER BY risk DESC, tower LIMIT 100""",
)
def steering_latest_recommendations(spark, sf):
    alerts = scored(spark, sf).where(F.col("category").isin(*S.CONGESTED))
    return S.latest_recommendations(alerts).select("tower", "date", "risk", "category", "total")


@query(
    "band_daily_panel",
    f"""WITH {BANDS_SQL} SELECT date, band, cells, round(rrc_setup_sr, 5) AS rrc_setup_sr,
          round(availability_pct, 5) AS availability_pct, round(connected_users, 5) AS connected_users,
          round(downtime_sec, 3) AS downtime_sec FROM bands""",
)
def band_daily_panel(spark, sf):
    out = bands(spark, sf).select(
        "date", "band", "cells", "rrc_setup_sr", "availability_pct", "connected_users", "downtime_sec"
    )
    out = rounded(out, "rrc_setup_sr", "availability_pct", "connected_users", digits=5)
    return rounded(out, "downtime_sec", digits=3)


@query(
    "network_daily_means",
    f"""WITH {BANDS_SQL} SELECT date, round(avg(availability_pct), 5) AS availability,
          round(avg(connected_users), 5) AS users, round(avg(downtime_sec), 3) AS downtime FROM bands GROUP BY date""",
)
def network_daily_means(spark, sf):
    out = N.network_daily(
        bands(spark, sf),
        {"availability": "availability_pct", "users": "connected_users", "downtime": "downtime_sec"},
    )
    return rounded(rounded(out, "availability", "users", digits=5), "downtime", digits=3)


@query(
    "band_kpi_status",
    f"""WITH {BANDS_SQL}, latest AS (
        SELECT * FROM bands QUALIFY row_number() OVER (PARTITION BY band ORDER BY date DESC) = 1),
      l AS (UNPIVOT (SELECT * EXCLUDE (cells) FROM latest) ON COLUMNS(* EXCLUDE (date, band)) INTO NAME kpi VALUE value),
      v AS (SELECT *, CASE WHEN kpi = 'downtime_sec' THEN value / CASE band WHEN 350 THEN 667 WHEN 400 THEN 9
              WHEN 1556 THEN 83 WHEN 1700 THEN 27 WHEN 3500 THEN 253 ELSE 28 END ELSE value END AS sla_value FROM l)
    SELECT band, date, kpi, round(value, 4) AS value, round(sla_value, 4) AS sla_value,
           CASE kpi WHEN 'rrc_setup_sr' THEN sla_value >= 99 WHEN 'erab_estab_sr' THEN sla_value >= 99
                WHEN 'erab_drop_rate' THEN sla_value <= 0.5 WHEN 'handover_intra_sr' THEN sla_value >= 0.98
                WHEN 'handover_sr' THEN sla_value >= 98 WHEN 'availability_pct' THEN sla_value >= 99.5
                WHEN 'dl_throughput_mbps' THEN sla_value >= 5 WHEN 'downtime_sec' THEN sla_value <= 3600
                ELSE sla_value >= 1 END AS sla_met FROM v""",
)
def band_kpi_status(spark, sf):
    return rounded(N.kpi_status(bands(spark, sf)), "value", "sla_value", digits=4)


@query(
    "kpi_bounds_long",
    """SELECT tower, date, kpi, CASE WHEN kpi = 'erab_drop_rate' THEN least(greatest(value, 0), 100)
              WHEN kpi = 'handover_intra_sr' THEN least(greatest(value, 0), 1) ELSE greatest(value, 0) END AS bounded
       FROM (SELECT tower, date, 'erab_drop_rate' AS kpi, erab_drop_rate * 60 AS value FROM {v_tower_kpi}
             UNION ALL SELECT tower, date, 'handover_intra_sr', handover_intra_sr * 1.01 FROM {v_tower_kpi}
             UNION ALL SELECT tower, date, 'dl_throughput_mbps', dl_throughput_mbps - 5 FROM {v_tower_kpi}) x""",
)
def kpi_bounds_long(spark, sf):
    raw = tower_kpi(spark, sf).select(
        "tower", "date", (F.col("erab_drop_rate") * 60).alias("erab_drop_rate"),
        (F.col("handover_intra_sr") * 1.01).alias("handover_intra_sr"),
        (F.col("dl_throughput_mbps") - 5).alias("dl_throughput_mbps"),
    )
    long = N.long_panel(raw, ["tower", "date"])
    return long.select(
        "tower", "date", "kpi", N.bounded_value(F.col("kpi"), F.col("value")).alias("bounded")
    )


@query(
    "tower_health_profile",
    f"""WITH {PROFILE_SQL} SELECT tower, observation_days, round(rrc, 5) AS rrc_setup_sr_mean,
          round(rrc_std, 5) AS rrc_setup_sr_std, round(drp_max, 5) AS erab_drop_rate_max,
          round(av_min, 5) AS availability_pct_min, round(dl_std, 5) AS dl_throughput_mbps_std,
          violations AS total_sla_violations, health AS health_index, sleeping AS is_sleeping_suspect,
          dense_rank() OVER (ORDER BY health) AS degradation_rank FROM prof""",
)
def tower_health_profile(spark, sf):
    profile = P.dense_ranked(N.tower_profile(tower_kpi(spark, sf)), "health_index", "degradation_rank")
    names = [
        "rrc_setup_sr_mean", "rrc_setup_sr_std", "erab_drop_rate_max", "availability_pct_min", "dl_throughput_mbps_std"
    ]
    out = profile.select(
        "tower", "observation_days", *names, "total_sla_violations", "health_index", "is_sleeping_suspect",
        "degradation_rank",
    )
    return rounded(out, *names, digits=5)


@query(
    "network_health_stats",
    f"""WITH {PROFILE_SQL} SELECT count(*) AS total_nodes, CAST(sum(observation_days) AS BIGINT) AS total_observations,
          round(avg(health), 4) AS mean_health_index, round(median(health), 4) AS median_health_index,
          count(*) FILTER (health >= 80) AS healthy_nodes_count,
          count(*) FILTER (health >= 60 AND health < 80) AS moderate_risk_count,
          count(*) FILTER (health < 60) AS severe_degraded_count, count(*) FILTER (sleeping) AS sleeping_suspects,
          count(*) FILTER (violations = 0) AS sla_compliant_nodes_count, count(*) FILTER (rrc < 99.5) AS rrc_breaches,
          count(*) FILTER (drp > 0.5) AS drop_rate_breaches, count(*) FILTER (av < 95) AS availability_breaches FROM prof""",
)
def network_health_stats(spark, sf):
    stats = N.health_stats(N.tower_profile(tower_kpi(spark, sf)))
    return rounded(stats, "mean_health_index", "median_health_index", digits=4)


@query(
    "tower_behaviour_features",
    """WITH b AS (SELECT tower, avg(connected_users) AS mu, quantile_cont(connected_users, 0.95) AS p95,
            stddev_samp(connected_users) AS sd, avg(dl_throughput_mbps) AS dl, quantile_cont(dl_throughput_mbps, 0.95) AS p95dl,
            count(DISTINCT date) AS total_days, count(*) FILTER (isodow(date) >= 6) AS wn,
            avg(connected_users) FILTER (isodow(date) >= 6) AS we, avg(connected_users) FILTER (isodow(date) < 6) AS wd
          FROM {v_tower_kpi} GROUP BY tower)
       SELECT tower, round(mu, 5) AS mean_users, round(p95, 5) AS p95_users, round(coalesce(sd, 0), 5) AS std_users, total_days,
          round(least(greatest((coalesce(we, 1.0) + 1e-4) / (coalesce(wd, 1.0) + 1e-4), 0.1), 5.0), 5) AS weekend_to_weekday_ratio,
          round(least(greatest(p95 / (mu + 1e-4), 1.0), 10.0), 5) AS user_burstiness,
          round(least(greatest(p95dl / (dl + 1e-4), 1.0), 10.0), 5) AS throughput_burstiness FROM b""",
)
def tower_behaviour_features(spark, sf):
    out = N.behaviour_features(tower_kpi(spark, sf))
    names = ["mean_users", "p95_users", "std_users", "weekend_to_weekday_ratio", "user_burstiness", "throughput_burstiness"]
    return rounded(out.select("tower", "total_days", *names), *names, digits=5)


@query(
    "summer_stress",
    """WITH s AS (SELECT tower, avg(dl_throughput_mbps) AS b_dl, avg(erab_drop_rate) AS b_dr, avg(connected_users) AS b_us,
            avg(availability_pct) AS b_av, avg(dl_throughput_mbps) FILTER (month(date) IN (6,7,8)) AS s_dl,
            avg(erab_drop_rate) FILTER (month(date) IN (6,7,8)) AS s_dr,
            avg(connected_users) FILTER (month(date) IN (6,7,8)) AS s_us,
            avg(availability_pct) FILTER (month(date) IN (6,7,8)) AS s_av
          FROM {v_tower_kpi} GROUP BY tower HAVING count(*) FILTER (month(date) IN (6,7,8)) > 0),
        d AS (SELECT *, round_even(s_dl - b_dl, 3) AS d_dl, round_even(s_dr - b_dr, 3) AS d_dr,
            round_even(s_av - b_av, 3) AS d_av, round_even(s_us - b_us, 3) AS d_us FROM s)
       SELECT tower, d_dl AS delta_dl_throughput_mbps, d_dr AS delta_drop_rate, d_av AS delta_availability_pct,
          d_us AS delta_connected_users, round_even(d_us / (b_us + 1e-4) * 100.0, 2) AS delta_users_pct,
          d_dl < -1.5 AND d_dr > 0.05 AS is_summer_throttled,
          round_even(d_us / (b_us + 1e-4) * 100.0, 2) > 30.0 AS is_summer_surge_hub, d_av < -3.0 AS is_summer_downtime_sensitive,
          round_even(least(greatest(d_dr / 0.5 * 40.0, 0), 40) + least(greatest(-d_av / 5.0 * 30.0, 0), 30)
                   + least(greatest(-d_dl / 5.0 * 30.0, 0), 30), 2) AS summer_stress_score FROM d""",
)
def summer_stress(spark, sf):
    out = N.seasonal_stress(tower_kpi(spark, sf), F.month("date").isin(6, 7, 8))
    return out.select(
        "tower", "delta_dl_throughput_mbps", "delta_drop_rate", "delta_availability_pct", "delta_connected_users",
        "delta_users_pct", "is_summer_throttled", "is_summer_surge_hub", "is_summer_downtime_sensitive",
        "summer_stress_score",
    )


ALERT_SQL = """mx AS (SELECT max(date) AS latest FROM {v_tower_kpi}),
  w AS (SELECT tower, bool_or(date = latest) AS reported, max(date) FILTER (date > latest - 7) AS last_seen,
      count(DISTINCT date) FILTER (date > latest - 7) AS days_reported,
      median(connected_users) FILTER (date < latest AND date >= latest - 28) AS usual,
      max(connected_users) FILTER (date = latest) AS users,
      max(availability_pct) FILTER (date = latest) AS av, max(erab_drop_rate) FILTER (date = latest) AS dr,
      max(rrc_setup_sr) FILTER (date = latest) AS rrc, max(erab_estab_sr) FILTER (date = latest) AS es,
      max(handover_sr) FILTER (date = latest) AS ho, max(dl_throughput_mbps) FILTER (date = latest) AS dl,
      count(*) FILTER (date > latest - 7 AND availability_pct < 95) AS m_av,
      count(*) FILTER (date > latest - 7 AND erab_drop_rate > 0.5) AS m_dr,
      count(*) FILTER (date > latest - 7 AND rrc_setup_sr < 99.5) AS m_rrc,
      count(*) FILTER (date > latest - 7 AND erab_estab_sr < 99.5) AS m_es,
      count(*) FILTER (date > latest - 7 AND handover_sr < 97.5) AS m_ho,
      count(*) FILTER (date > latest - 7 AND dl_throughput_mbps < 2) AS m_dl,
      avg(availability_pct) FILTER (date > latest - 7) AS a_av,
      avg(erab_drop_rate) FILTER (date > latest - 7) AS a_dr,
      avg(rrc_setup_sr) FILTER (date > latest - 7) AS a_rrc,
      avg(erab_estab_sr) FILTER (date > latest - 7) AS a_es,
      avg(handover_sr) FILTER (date > latest - 7) AS a_ho,
      avg(dl_throughput_mbps) FILTER (date > latest - 7) AS a_dl
    FROM {v_tower_kpi}, mx WHERE date > latest - 35 GROUP BY tower),
  p AS (
    SELECT tower, CASE WHEN av < 50 THEN 0 ELSE 2 END AS rk, av < 50 AS severe, m_av AS days, 'availability' AS kind FROM w WHERE av < 95
    UNION ALL SELECT tower, CASE WHEN dr > 1 THEN 1 ELSE 2 END, dr > 1, m_dr, 'drops' FROM w WHERE dr > 0.5
    UNION ALL SELECT tower, CASE WHEN rrc < 98 THEN 1 ELSE 2 END, rrc < 98, m_rrc, 'setup' FROM w WHERE rrc < 99.5
    UNION ALL SELECT tower, CASE WHEN es < 98 THEN 1 ELSE 2 END, es < 98, m_es, 'session' FROM w WHERE es < 99.5
    UNION ALL SELECT tower, CASE WHEN ho < 90 THEN 1 ELSE 2 END, ho < 90, m_ho, 'handover' FROM w WHERE ho < 97.5
    UNION ALL SELECT tower, 1, true, m_dl, 'download' FROM w WHERE dl < 2
    UNION ALL SELECT tower, 0, true, 0, 'sleeping' FROM w WHERE usual >= 5 AND av >= 95 AND users < 0.25 * usual
    UNION ALL SELECT tower, 2, false, 0, 'no_report' FROM w WHERE NOT reported AND last_seen IS NOT NULL),
  alerts AS (SELECT tower, min(rk) AS level_rank, count(*) FILTER (severe) AS severe_count, max(days) AS days_missed,
      count(*) AS problem_count FROM p GROUP BY tower)"""


@query(
    "tower_alerts",
    f"""WITH {ALERT_SQL} SELECT tower, CASE level_rank WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'warning' END AS level,
         upper(regexp_extract(tower, '^([A-Za-z]+)', 1)) AS name_group, level_rank, severe_count, days_missed, problem_count
       FROM alerts""",
)
def tower_alerts(spark, sf):
    alerts = N.tower_alerts(tower_kpi(spark, sf))
    return alerts.select("tower", "level", "name_group", "level_rank", "severe_count", "days_missed", "problem_count")


@query(
    "tower_alert_listing",
    f"""WITH {ALERT_SQL}, m AS (SELECT a.* FROM alerts a WHERE tower IN (SELECT tower FROM p WHERE kind = 'setup'))
       SELECT tower, level_rank, severe_count, days_missed, problem_count, (SELECT count(*) FROM m) AS matched,
         greatest((SELECT count(*) FROM m) - 20, 0) AS not_shown
       FROM m ORDER BY level_rank, severe_count DESC, days_missed DESC, problem_count DESC, tower LIMIT 20""",
)
def tower_alert_listing(spark, sf):
    rows = N.list_alerts(N.tower_alerts(tower_kpi(spark, sf)), kind="setup")
    return rows.select("tower", "level_rank", "severe_count", "days_missed", "problem_count", "matched", "not_shown")


@query(
    "tower_status",
    f"""WITH {ALERT_SQL} SELECT tower, reported, days_reported, round_even(usual, 2) AS usual_users, kpi, round_even(v, 2) AS value,
         CASE WHEN v IS NULL THEN 'not reported' WHEN severe THEN 'past severe limit' WHEN missed THEN 'missed target' ELSE 'ok' END AS status,
         days_missed, CAST(round_even(CAST(a AS DECIMAL(18, 8)), 2) AS DOUBLE) AS average_last_7 FROM (
         SELECT tower, reported, days_reported, usual, 'cell availability' AS kpi, av AS v, av < 50 AS severe, av < 95 AS missed, m_av AS days_missed, a_av AS a FROM w
         UNION ALL SELECT tower, reported, days_reported, usual, 'call drop rate', dr, dr > 1, dr > 0.5, m_dr, a_dr FROM w
         UNION ALL SELECT tower, reported, days_reported, usual, 'connection setup success', rrc, rrc < 98, rrc < 99.5, m_rrc, a_rrc FROM w
         UNION ALL SELECT tower, reported, days_reported, usual, 'data session setup success', es, es < 98, es < 99.5, m_es, a_es FROM w
         UNION ALL SELECT tower, reported, days_reported, usual, 'handover success', ho, ho < 90, ho < 97.5, m_ho, a_ho FROM w
         UNION ALL SELECT tower, reported, days_reported, usual, 'download speed', dl, dl < 2, false, m_dl, a_dl FROM w) x
       WHERE tower = 'TWR_7'""",
)
def tower_status(spark, sf):
    rows = tower_kpi(spark, sf)
    # The latest day is the whole panel's, so the lookup keeps every tower until then.
    latest = N.latest_day(rows)
    one = rows.where((F.col("tower") == "TWR_7") | ((F.col("date") == F.lit(latest)) & (F.col("tower") != "TWR_7")))
    return N.tower_status(one, "TWR_7").drop("position")


@query(
    "network_overview",
    """WITH n AS (SELECT date, avg(rrc_setup_sr) AS rrc, avg(erab_estab_sr) AS es, avg(erab_drop_rate) AS dr,
            avg(handover_sr) AS ho, avg(dl_throughput_mbps) AS dl FROM {v_tower_kpi} GROUP BY date),
        k AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM n),
        a AS (SELECT max(date) AS data_date, max(rrc) FILTER (b = 1) AS rrc, max(es) FILTER (b = 1) AS es,
            max(dr) FILTER (b = 1) AS dr, max(ho) FILTER (b = 1) AS ho, max(dl) FILTER (b = 1) AS dl,
            avg(rrc) AS arrc, avg(es) AS aes, avg(dr) AS adr, avg(ho) AS aho, avg(dl) AS adl FROM k WHERE b <= 7)
       SELECT data_date, 'connection setup success' AS kpi, round_even(rrc, 2) AS value, NOT rrc < 99.5 AS meets_target, round_even(arrc, 2) AS average_last_7 FROM a
       UNION ALL SELECT data_date, 'data session setup success', round_even(es, 2), NOT es < 99.5, round_even(aes, 2) FROM a
       UNION ALL SELECT data_date, 'call drop rate', round_even(dr, 2), NOT dr > 0.5, round_even(adr, 2) FROM a
       UNION ALL SELECT data_date, 'handover success', round_even(ho, 2), NOT ho < 97.5, round_even(aho, 2) FROM a
       UNION ALL SELECT data_date, 'download speed', round_even(dl, 2), NULL, round_even(adl, 2) FROM a""",
)
def network_overview(spark, sf):
    columns = [column for column, *_ in N.LIMITS if column != "availability_pct"]
    return N.network_overview(N.network_daily(tower_kpi(spark, sf), {c: c for c in columns}))


@query(
    "traffic_change",
    """WITH k AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM {v_traffic}),
        a AS (SELECT max(date) AS data_date, max(volume) FILTER (b = 1) AS v, avg(volume) FILTER (b > 1) AS p FROM k WHERE b <= 8)
       SELECT data_date, round_even(v, 0) AS volume, round_even(p, 0) AS average_previous_7_days,
              round_even((v / p - 1) * 100, 1) AS change_pct FROM a""",
)
def traffic_change(spark, sf):
    return N.traffic_change(view(spark, sf, "v_traffic"), "volume")


# --- Panels ------------------------------------------------------------------------------

ROLL = "PARTITION BY tower ORDER BY date ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING"
TF_SQL = """SELECT tower, date, users, lag(users,1) OVER o AS lag_1, lag(users,2) OVER o AS lag_2, lag(users,3) OVER o AS lag_3,
     lag(users,7) OVER o AS lag_7, lag(users,8) OVER o AS lag_8, lag(users,14) OVER o AS lag_14, lag(users,21) OVER o AS lag_21,
     lag(users,28) OVER o AS lag_28,
     CASE WHEN count(users) OVER w7 >= 3 THEN avg(users) OVER w7 END AS rolling_mean_7,
     coalesce(CASE WHEN count(users) OVER w14 >= 7 THEN stddev_samp(users) OVER w14 END, 0) AS rolling_std_14,
     CASE WHEN count(users) OVER w28 >= 14 THEN avg(users) OVER w28 END AS rolling_mean_28,
     CASE WHEN count(users) OVER w7 >= 3 THEN min(users) OVER w7 END AS rolling_min_7,
     CASE WHEN count(users) OVER w7 >= 3 THEN max(users) OVER w7 END AS rolling_max_7
   FROM {v_tower_day}
   WINDOW o AS (PARTITION BY tower ORDER BY date), w7 AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
     w14 AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
     w28 AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""


@query(
    "panel_time_features",
    f"""SELECT tower, date, lag_1, lag_3, lag_7, lag_28, round(rolling_mean_7, 5) AS rolling_mean_7,
         round(rolling_std_14, 5) AS rolling_std_14, round(rolling_mean_28, 5) AS rolling_mean_28, rolling_min_7, rolling_max_7,
         lag_1 - lag_2 AS diff_1, lag_1 - lag_8 AS diff_7, round(rolling_mean_7 / (rolling_mean_28 + 1e-6), 5) AS ratio_7_28
       FROM ({TF_SQL}) t WHERE lag_28 IS NOT NULL""",
)
def panel_time_features(spark, sf):
    out = P.time_features(view(spark, sf, "v_tower_day").select("tower", "date", "users"), KEYS, DATE, "users")
    names = ["rolling_mean_7", "rolling_std_14", "rolling_mean_28", "ratio_7_28"]
    out = out.select(
        "tower", "date", "lag_1", "lag_3", "lag_7", "lag_28", "rolling_min_7", "rolling_max_7", "diff_1", "diff_7", *names
    )
    return rounded(out, *names, digits=5)


CUT_SQL = """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
                 FROM (SELECT DISTINCT date FROM {v_tower_day}) x),
  cut AS (SELECT date AS cutoff FROM days WHERE i = CAST(floor(n * 0.7) AS BIGINT))"""


@query(
    "tower_kpi_features",
    f"""WITH {CUT_SQL}, tr AS (SELECT d.* FROM {{v_tower_day}} d, cut WHERE d.date < cutoff),
      st AS (SELECT tower, avg(users) AS m, coalesce(stddev_samp(users), 0) AS s FROM tr GROUP BY tower),
      f AS (SELECT tower, date, lag(users, 1) OVER o AS l1, lag(users, 7) OVER o AS l7, avg(users) OVER w7 AS m7,
              coalesce(stddev_samp(users) OVER w7, 0) AS s7, avg(users) OVER w14 AS m14 FROM {{v_tower_day}}
            WINDOW o AS (PARTITION BY tower ORDER BY date), w7 AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
              w14 AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
    SELECT f.tower, date, l1 AS users_lag_1, round(m7, 5) AS users_roll_mean_7, round(s7, 5) AS users_roll_std_7,
      round(m14, 5) AS users_roll_mean_14, l1 - l7 AS users_diff_1_7,
      round(coalesce(m, (SELECT avg(users) FROM tr)), 5) AS users_tower_mean, round(coalesce(s, 0), 5) AS users_tower_std
    FROM f LEFT JOIN st ON f.tower = st.tower""",
)
def tower_kpi_features(spark, sf):
    day = view(spark, sf, "v_tower_day").select("tower", "date", "users")
    out = P.kpi_features(day, KEYS, DATE, "users", "users", P.cutoff_date(day, DATE))
    names = ["users_roll_mean_7", "users_roll_std_7", "users_roll_mean_14", "users_tower_mean", "users_tower_std"]
    return rounded(out.select("tower", "date", "users_lag_1", "users_diff_1_7", *names), *names, digits=5)


@query(
    "panel_cutoff_split",
    f"""WITH {CUT_SQL} SELECT CASE WHEN date < cutoff THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
         min(date) AS first_day, max(date) AS last_day FROM {{v_tower_day}}, cut GROUP BY 1""",
)
def panel_cutoff_split(spark, sf):
    day = view(spark, sf, "v_tower_day")
    split = P.split_at(day, DATE, P.cutoff_date(day, DATE))
    return split.groupBy("split").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(
    "series_position_split",
    """WITH r AS (SELECT tower, date, row_number() OVER (PARTITION BY tower ORDER BY date) AS i, count(*) OVER (PARTITION BY tower) AS n FROM {v_tower_day}),
         s AS (SELECT *, round_even(n * 0.7, 0) AS tr0, round_even(n * 0.15, 0) AS va FROM r),
         u AS (SELECT *, CASE WHEN tr0 + va >= n THEN n - va - 1 ELSE tr0 END AS tr FROM s)
       SELECT tower, CASE WHEN i <= tr THEN 'train' WHEN i <= tr + va THEN 'validation' ELSE 'test' END AS split,
         count(*) AS rows, min(date) AS first_day, max(date) AS last_day FROM u GROUP BY 1, 2""",
)
def series_position_split(spark, sf):
    split = P.split_by_position(view(spark, sf, "v_tower_day"), KEYS, DATE)
    return split.groupBy("tower", "split").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(
    "band_lag_features",
    f"""WITH {BANDS_SQL}, f AS (SELECT band, date, lag(connected_users, 1) OVER o AS l1, lag(connected_users, 2) OVER o AS l2,
         lag(connected_users, 8) OVER o AS l8, lag(connected_users, 14) OVER o AS l14, avg(connected_users) OVER w AS m, stddev_samp(connected_users) OVER w AS s
       FROM bands WINDOW o AS (PARTITION BY band ORDER BY date), w AS (PARTITION BY band ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
      SELECT band, date, round(l1, 5) AS lag_1, round(l14, 5) AS lag_14, round(m, 5) AS rolling_mean_7, round(coalesce(s, 0), 5) AS rolling_std_7,
         round(l1 - l2, 5) AS diff_1, round(l1 - l8, 5) AS diff_7 FROM f""",
)
def band_lag_features(spark, sf):
    out = P.band_features(bands(spark, sf).select("band", "date", "connected_users"), ["band"], DATE, "connected_users")
    names = ["lag_1", "lag_14", "rolling_mean_7", "rolling_std_7", "diff_1", "diff_7"]
    return rounded(out.select("band", "date", *names), *names, digits=5)


@query(
    "band_autoregressive_features",
    f"""WITH {BANDS_SQL}, x AS (SELECT band, date, ln(1 + greatest(connected_users, 0)) AS y FROM bands),
       f AS (SELECT band, date, lag(y, 1) OVER o AS l1, lag(y, 7) OVER o AS l7, avg(y) OVER w AS m, coalesce(stddev_samp(y) OVER w, 0) AS s
         FROM x WINDOW o AS (PARTITION BY band ORDER BY date), w AS (PARTITION BY band ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
       SELECT band, date, round(coalesce(l1, first_value(l1 IGNORE NULLS) OVER a), 5) AS lag_1, round(coalesce(l7, first_value(l7 IGNORE NULLS) OVER a), 5) AS lag_7,
         round(coalesce(m, first_value(m IGNORE NULLS) OVER a), 5) AS roll_mean_7d, round(s, 5) AS roll_std_7d
       FROM f WINDOW a AS (PARTITION BY band ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def band_autoregressive_features(spark, sf):
    from mastwire.functions.numeric import to_log_scale

    logged = bands(spark, sf).select("band", "date", to_log_scale(F.col("connected_users")).alias("y"))
    out = P.autoregressive_features(logged, ["band"], DATE, "y").drop("y")
    return rounded(out, "lag_1", "lag_7", "roll_mean_7d", "roll_std_7d", digits=5)


GAPS_SQL = """g AS (SELECT tower, date, CASE WHEN erab_drop_rate > 0.3 THEN connected_users END AS users,
                  CASE WHEN availability_pct < 98 THEN availability_pct END AS av FROM {v_tower_kpi})"""


def _gappy(spark, sf):
    return tower_kpi(spark, sf).select(
        "tower", "date", F.when(F.col("erab_drop_rate") > 0.3, F.col("connected_users")).alias("users"),
        F.when(F.col("availability_pct") < 98, F.col("availability_pct")).alias("av"),
    )


@query(
    "panel_fill_both_ways",
    f"""WITH {GAPS_SQL} SELECT tower, date, coalesce(last_value(users IGNORE NULLS) OVER p, first_value(users IGNORE NULLS) OVER a) AS users,
         coalesce(last_value(av IGNORE NULLS) OVER p, first_value(av IGNORE NULLS) OVER a) AS av FROM g
       WINDOW p AS (PARTITION BY tower ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY tower ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def panel_fill_both_ways(spark, sf):
    return P.fill_both_ways(_gappy(spark, sf), KEYS, DATE, ["users", "av"])


@query(
    "panel_median_imputation",
    f"""WITH {GAPS_SQL}, k AS (SELECT tower, median(users) AS mu, median(av) AS ma FROM g GROUP BY tower),
         f AS (SELECT g.tower, date, coalesce(users, mu) AS users, coalesce(av, ma) AS av FROM g JOIN k ON g.tower = k.tower)
       SELECT tower, date, round(coalesce(users, (SELECT median(users) FROM f)), 5) AS users, round(coalesce(av, (SELECT median(av) FROM f)), 5) AS av FROM f""",
)
def panel_median_imputation(spark, sf):
    return rounded(P.impute_medians(_gappy(spark, sf), KEYS, ["users", "av"]), "users", "av", digits=5)


COMPLETE_SQL = """sp AS (SELECT tower, min(date) AS d0, max(date) AS d1 FROM {v_tower_day} GROUP BY tower),
  days AS (SELECT tower, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
  x AS (SELECT d.tower, d.date, t.users, t.tower IS NOT NULL AS is_observed, CASE WHEN t.users IS NOT NULL THEN d.date END AS kd
        FROM days d LEFT JOIN {v_tower_day} t ON d.tower = t.tower AND d.date = t.date),
  y AS (SELECT *, last_value(users IGNORE NULLS) OVER p AS v0, last_value(kd IGNORE NULLS) OVER p AS k0,
          first_value(users IGNORE NULLS) OVER a AS v1, first_value(kd IGNORE NULLS) OVER a AS k1 FROM x
        WINDOW p AS (PARTITION BY tower ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY tower ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  full_days AS (SELECT tower, date, is_observed, coalesce(users, v0 + (v1 - v0) * (date - k0) / nullif(k1 - k0, 0), v0) AS users FROM y)"""


@query(
    "panel_complete_calendar",
    f"WITH {COMPLETE_SQL} SELECT tower, date, is_observed, round(users, 5) AS users FROM full_days",
)
def panel_complete_calendar(spark, sf):
    day = tower_days(spark, sf, "users")
    return rounded(P.complete_calendar(day, KEYS, DATE, ["users"]), "users", digits=5)


@query(
    "panel_anomaly_repair",
    f"""WITH {COMPLETE_SQL}, t AS (SELECT tower, date, users, CASE WHEN count(users) OVER c >= 5 THEN avg(users) OVER c END AS tr FROM full_days
         WINDOW c AS (PARTITION BY tower ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
       e0 AS (SELECT *, coalesce(first_value(tr IGNORE NULLS) OVER a, last_value(tr IGNORE NULLS) OVER p) AS trend FROM t
         WINDOW p AS (PARTITION BY tower ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY tower ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
       e AS (SELECT tower, date, users, trend + avg(users) OVER (PARTITION BY tower, isodow(date)) - avg(users) OVER (PARTITION BY tower) AS expected FROM e0),
       s AS (SELECT tower, quantile_cont(users - expected, 0.75) - quantile_cont(users - expected, 0.25) AS iqr, stddev_samp(users - expected) AS sd FROM e GROUP BY tower),
       f AS (SELECT e.*, coalesce(abs((users - expected) / (CASE WHEN iqr > 0 THEN iqr / 1.349 ELSE sd END + 1e-6)) > 3.0, false) AS is_anomaly
         FROM e JOIN s ON e.tower = s.tower),
       n AS (SELECT *, lag(CASE WHEN NOT is_anomaly THEN users END, 7) OVER o AS b, lead(CASE WHEN NOT is_anomaly THEN users END, 7) OVER o AS c
         FROM f WINDOW o AS (PARTITION BY tower ORDER BY date))
    SELECT tower, date, round(users, 4) AS raw_value, is_anomaly,
      round(CASE WHEN is_anomaly THEN coalesce((coalesce(b, c) + coalesce(c, b)) / 2, expected) ELSE users END, 4) AS users FROM n""",
)
def panel_anomaly_repair(spark, sf):
    out = P.repair_anomalies(tower_days(spark, sf, "users"), KEYS, DATE, "users", 3.0, fill_days=True)
    return rounded(out.select("tower", "date", "raw_value", "is_anomaly", "users"), "raw_value", "users", digits=4)


@query(
    "weekday_median_baseline",
    """WITH r AS (SELECT tower, date, users, isodow(date) - 1 AS dow, row_number() OVER (PARTITION BY tower ORDER BY date DESC) AS b,
             count(*) OVER (PARTITION BY tower) AS n FROM {v_tower_day}),
        l AS (SELECT tower, coalesce(median(users) FILTER (n >= 14 AND b <= 14), median(users)) AS lvl FROM r GROUP BY tower),
        d AS (SELECT tower, dow, coalesce(median(users) FILTER (b <= 56), median(users)) AS m FROM r GROUP BY tower, dow)
       SELECT l.tower, CAST(k.dow AS INT) AS day_of_week, coalesce(m, lvl) AS prediction, lvl AS recent_level
       FROM l CROSS JOIN (SELECT unnest(range(7)) AS dow) k LEFT JOIN d ON d.tower = l.tower AND d.dow = k.dow""",
)
def weekday_median_baseline(spark, sf):
    return P.weekday_medians(view(spark, sf, "v_tower_day"), KEYS, DATE, "users")


@query(
    "seasonal_naive_forecast",
    """SELECT tower, date, users, lag(users, 7) OVER (PARTITION BY tower ORDER BY date) AS prediction,
         round(avg(users) OVER (PARTITION BY tower ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 5) AS smoothed FROM {v_tower_day}""",
)
def seasonal_naive_forecast(spark, sf):
    day = view(spark, sf, "v_tower_day").select("tower", "date", "users")
    out = P.seasonal_naive(day, KEYS, DATE, "users")
    return rounded(out.withColumn("smoothed", P.moving_average("users", KEYS, DATE)), "smoothed", digits=5)


@query(
    "calendar_features",
    """SELECT date, isodow(date) - 1 AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend, month(date) AS month, day(date) AS day_of_month,
         dayofyear(date) AS day_of_year, weekofyear(date) AS week_of_year, round(sin(2 * pi() * (isodow(date) - 1) / 7.0), 6) AS sin_dow,
         round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS cos_doy, CAST(isodow(date) IN (5, 6) AS INT) AS is_libya_weekend FROM {v_traffic}""",
)
def calendar_features_query(spark, sf):
    day = view(spark, sf, "v_traffic").select("date")
    out = day.withColumns(calendar_features(F.col("date"))).withColumn("is_libya_weekend", weekend(F.col("date"), (4, 5)))
    return rounded(out.drop("cos_dow", "sin_doy"), "sin_dow", "cos_doy")


@query(
    "harmonic_features",
    """WITH t AS (SELECT date, CAST(date - (SELECT min(date) FROM {v_traffic}) AS DOUBLE) AS t FROM {v_traffic})
       SELECT date, round((1 - exp(-0.4 * t / 365.25)) / 0.4, 6) AS trend_damped, round(sin(2 * pi() * 3 * t / 365.25), 5) AS annual_sin_k3,
         round(cos(2 * pi() * 2 * t / 7.0), 5) AS weekly_cos_k2, round(sin(2 * pi() * month(date) / 12.0), 6) AS month_sin,
         CASE WHEN isodow(date) BETWEEN 2 AND 4 THEN 1.0 ELSE 0.0 END AS midweek_peak,
         CASE WHEN (month(date), day(date)) IN ((1,1),(7,4),(12,24),(12,25),(12,31)) OR (month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25)
            OR (month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7) OR (month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28)
            THEN 1.0 ELSE 0.0 END AS is_holiday FROM t""",
)
def harmonic_features_query(spark, sf):
    day = view(spark, sf, "v_traffic").select("date")
    first = day.agg(F.min("date")).scalar()
    out = day.withColumns(harmonic_features(F.col("date"), first))
    out = out.select("date", "trend_damped", "annual_sin_k3", "weekly_cos_k2", "month_sin", "midweek_peak", "is_holiday")
    return rounded(rounded(out, "trend_damped", "month_sin"), "annual_sin_k3", "weekly_cos_k2", digits=5)


@query(
    "exogenous_join",
    f"""WITH {BANDS_SQL}, c AS (SELECT date, avg(availability_pct) AS availability, avg(connected_users) AS users FROM bands GROUP BY date),
       m AS (SELECT date, avg(dl_throughput_mbps) AS macro_dl, avg(erab_drop_rate) AS macro_drop FROM {{v_tower_kpi}} GROUP BY date)
     SELECT t.date, volume, round(macro_dl, 9) AS macro_dl, round(macro_drop, 9) AS macro_drop, round(availability, 9) AS availability,
       round(lag(users) OVER (ORDER BY t.date), 9) AS exo_users_lag1,
       round(CASE WHEN count(users) OVER w >= 3 THEN avg(users) OVER w END, 9) AS exo_users_roll7
     FROM {{v_traffic}} t JOIN m ON t.date = m.date JOIN c ON t.date = c.date WINDOW w AS (ORDER BY t.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def exogenous_join(spark, sf):
    macro = N.network_daily(tower_kpi(spark, sf), {"macro_dl": "dl_throughput_mbps", "macro_drop": "erab_drop_rate"})
    daily = N.network_daily(bands(spark, sf), {"availability": "availability_pct", "users": "connected_users"})
    out = N.exogenous_join(view(spark, sf, "v_traffic"), macro, daily)
    out = out.withColumns(
        {
            "exo_users_lag1": P.lagged("users", ["series"], DATE, (1,))["lag_1"],
            "exo_users_roll7": P.rolling("users", ["series"], DATE, 7, "mean", 3),
        }
    ).drop("series", "users")
    # The noise of the last digits goes, and nothing else.
    return rounded(out, "macro_dl", "macro_drop", "availability", "exo_users_lag1", "exo_users_roll7", digits=9)


@query(
    "kpi_correlations",
    """SELECT 'dl_throughput_mbps' AS "column", round(corr(connected_users, dl_throughput_mbps), 5) AS correlation FROM {v_tower_kpi}
       UNION ALL SELECT 'erab_drop_rate', round(corr(connected_users, erab_drop_rate), 5) FROM {v_tower_kpi}
       UNION ALL SELECT 'availability_pct', round(corr(connected_users, availability_pct), 5) FROM {v_tower_kpi}""",
)
def kpi_correlations(spark, sf):
    others = ["dl_throughput_mbps", "erab_drop_rate", "availability_pct"]
    out = N.correlations(tower_kpi(spark, sf), "connected_users", others)
    return rounded(out, "correlation", digits=5)


@query(
    "panel_key_overlap",
    """WITH a AS (SELECT DISTINCT tower, date FROM {v_tower_day} WHERE users > 40), b AS (SELECT DISTINCT tower, date FROM {v_tower_day} WHERE drop_rate > 1)
       SELECT count(*) AS subset_keys, count(b.tower) AS shared_keys, round(count(b.tower) / count(*), 6) AS shared_share
       FROM a LEFT JOIN b ON a.tower = b.tower AND a.date = b.date""",
)
def panel_key_overlap(spark, sf):
    day = view(spark, sf, "v_tower_day")
    out = N.key_overlap(day.where("users > 40"), day.where("drop_rate > 1"), ["tower", "date"])
    return rounded(out, "shared_share")


@query(
    "sla_compliance_by_tower",
    """SELECT tower, count(*) AS checked, count(*) FILTER (NOT ok) AS breaches FROM (
         SELECT tower, erab_drop_rate <= 0.5 AS ok FROM {v_tower_kpi} UNION ALL SELECT tower, availability_pct >= 99.5 FROM {v_tower_kpi}
         UNION ALL SELECT tower, dl_throughput_mbps >= 5 FROM {v_tower_kpi} UNION ALL SELECT tower, handover_sr >= 98 FROM {v_tower_kpi}) x GROUP BY tower""",
)
def sla_compliance_by_tower(spark, sf):
    keys = ("erab_drop_rate", "availability_pct", "dl_throughput_mbps", "handover_sr")
    long = N.long_panel(tower_kpi(spark, sf), ["tower"], keys)
    met = N.sla_met(F.col("kpi"), F.col("value"))
    return long.groupBy("tower").agg(F.count("*").alias("checked"), F.count_if(~met).alias("breaches"))


@query(
    "band_forecast_summary",
    f"""WITH {BANDS_SQL}, c AS (SELECT max(date) - 60 AS c FROM bands), h AS (SELECT band, avg(connected_users) AS m, arg_max(connected_users, date) AS l FROM bands, c WHERE date <= c.c GROUP BY band),
      f AS (SELECT band, avg(connected_users) AS m, min(connected_users) AS lo, max(connected_users) AS hi FROM bands, c WHERE date > c.c GROUP BY band)
     SELECT h.band, 'connected_users' AS kpi, round(h.m, 4) AS history_mean, round(f.m, 4) AS forecast_mean, round(lo, 4) AS forecast_min, round(hi, 4) AS forecast_max,
       round((f.m - l) * 100 / abs(l), 4) AS shift_pct FROM h JOIN f ON h.band = f.band""",
)
def band_forecast_summary(spark, sf):
    panel = N.long_panel(bands(spark, sf), ["band", "date"], ("connected_users",))
    cut = panel.agg(F.date_sub(F.max("date"), 60)).scalar()
    out = N.band_forecast_summary(panel.where(F.col("date") <= cut), panel.where(F.col("date") > cut)).drop("last_value")
    return rounded(out, "history_mean", "forecast_mean", "forecast_min", "forecast_max", "shift_pct", digits=4)


@query(
    "forecast_breach_days",
    f"""WITH {BANDS_SQL}, l AS (SELECT band, date, 'availability_pct' AS kpi, round(availability_pct, 9) >= 99.5 AS ok FROM bands
        UNION ALL SELECT band, date, 'erab_drop_rate', round(erab_drop_rate, 9) <= 0.5 FROM bands),
      r AS (SELECT *, row_number() OVER (PARTITION BY band, kpi ORDER BY date) AS h FROM l)
     SELECT band, kpi, count(*) AS forecast_days, count(*) FILTER (NOT ok) AS forecast_breach_days FROM r WHERE h <= 365 GROUP BY band, kpi""",
)
def forecast_breach_days(spark, sf):
    panel = N.long_panel(bands(spark, sf), ["band", "date"], ("availability_pct", "erab_drop_rate"))
    # Noise of the last digits goes, so the order of summation cannot move a mean over its target.
    return N.breach_days(panel.withColumn("value", F.round("value", 9)), 365)


@query(
    "synergy_exports",
    f"""WITH {PROFILE_SQL} SELECT 'antenna' AS target, tower, CAST(round_even(CAST(us / 10.0 + 10.0 / (dl + 0.1) + violations * 2.0 AS DECIMAL(18, 8)), 2) AS DOUBLE) AS weight FROM prof
         WHERE us >= 18 OR dl < 6 OR ho < 97
       UNION ALL SELECT 'churn', tower, CAST(round_even(CAST((100.0 - health) * 0.5 + drp * 30.0 + CAST(sleeping AS INT) * 20.0 AS DECIMAL(18, 8)), 2) AS DOUBLE) FROM prof
         WHERE health < 75 OR drp > 0.4 OR sleeping""",
)
def synergy_exports(spark, sf):
    # A tower's own averages name its persona here: poor handover is the transit corridor's mark.
    persona = F.when(settled(F.col("handover_sr_mean")) < 97.0, TRANSIT)
    profile = N.tower_profile(tower_kpi(spark, sf)).withColumns(
        {"operational_persona": persona, "is_sleeping_cell": F.col("is_sleeping_suspect")}
    )
    antenna = N.antenna_targets(profile).select(
        F.lit("antenna").alias("target"), "tower", F.col("antenna_recommendation_priority").alias("weight")
    )
    churn = N.churn_targets(profile).select(F.lit("churn").alias("target"), "tower", F.col("churn_risk_weight").alias("weight"))
    return antenna.unionByName(churn)


@query(
    "featured_towers",
    """SELECT tower, round(mean_users, 5) AS mean_users FROM (SELECT tower, avg(users) AS mean_users FROM {v_tower_day} GROUP BY tower) t
       WHERE tower IN ('TWR_3', 'TWR_5') OR tower IN (SELECT tower FROM (SELECT tower, avg(users) AS m FROM {v_tower_day} GROUP BY tower) x ORDER BY round(m, 9) DESC, tower LIMIT 30)""",
)
def featured_towers(spark, sf):
    means = view(spark, sf, "v_tower_day").groupBy("tower").agg(F.avg("users").alias("mean_users"))
    top = means.orderBy(F.round("mean_users", 9).desc(), "tower").limit(30)
    presets = means.where(F.col("tower").isin("TWR_3", "TWR_5"))
    return rounded(top.unionByName(presets).distinct(), "mean_users", digits=5)


@query(
    "actual_against_predicted_weeks",
    """WITH p AS (SELECT tower, date, users, lag(users, 7) OVER (PARTITION BY tower ORDER BY date) AS prediction FROM {v_tower_day})
       SELECT isoyear(date) AS iso_year, weekofyear(date) AS iso_week, count(*) AS rows, round(avg(users), 5) AS actual, round(avg(prediction), 5) AS predicted
       FROM p WHERE prediction IS NOT NULL GROUP BY 1, 2""",
)
def actual_against_predicted_weeks(spark, sf):
    out = P.seasonal_naive(view(spark, sf, "v_tower_day"), KEYS, DATE, "users").where("prediction IS NOT NULL")
    out = out.groupBy(
        F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("bigint").alias("iso_year"),
        F.weekofyear("date").cast("bigint").alias("iso_week"),
    ).agg(F.count("*").alias("rows"), F.avg("users").alias("actual"), F.avg("prediction").alias("predicted"))
    return rounded(out, "actual", "predicted", digits=5)
