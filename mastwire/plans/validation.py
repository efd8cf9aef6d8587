"""Registered queries on whole-group splits, hidden sites, changed assumptions and network attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastwire.functions.numeric import clip
from mastwire.operators import attribution as A
from mastwire.operators import planning as L
from mastwire.operators import validation as V
from mastwire.plans.adapters import view
from mastwire.plans.network import rounded
from mastwire.plans.places import HAV, PLAN_CHECKS, PLAN_SQL, candidates, sites
from mastwire.plans.registry import query

DRAW = "('0x' || substr(md5({}), 1, 12))::bigint"


@query(
    "grouped_hold_out",
    f"""WITH RECURSIVE g AS (SELECT CAST(area AS VARCHAR) AS area, count(*) AS n FROM {{v_candidates}} GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY {DRAW.format("'42:' || area")}, area) AS i, sum(n) OVER () AS total FROM g),
        r AS (SELECT 0::bigint AS i, 0::hugeint AS covered, ''::varchar AS area, false AS took
          UNION ALL SELECT o.i, covered + CASE WHEN covered < 0.2 * total AND covered + n <= floor(0.3 * total) THEN n ELSE 0 END, o.area,
            covered < 0.2 * total AND covered + n <= floor(0.3 * total) FROM r JOIN o ON o.i = r.i + 1)
       SELECT area, n AS rows, took AS held_out FROM r JOIN g USING (area)""",
)
def grouped_hold_out(spark, sf):
    return V.held_out_groups(candidates(spark, sf), "area")


FOLDS = """g AS (SELECT CAST(area AS VARCHAR) AS area, count(*) AS n FROM {v_candidates} GROUP BY 1),
  o AS (SELECT *, (row_number() OVER (ORDER BY n DESC, area) - 1) % 10 AS i FROM g), folds AS (SELECT area, n, CAST(CASE WHEN i < 5 THEN i ELSE 9 - i END AS INT) AS fold FROM o)"""


@query("grouped_folds", f"WITH {FOLDS} SELECT area, n AS rows, fold FROM folds")
def grouped_folds(spark, sf):
    return V.group_folds(candidates(spark, sf), "area")


@query(
    "grouped_fold_ranking",
    f"""WITH {FOLDS}, x AS (SELECT fold, candidate_id, balance AS score, segment = 'BUILDING' AS hit FROM {{v_candidates}} c JOIN folds f ON f.area = CAST(c.area AS VARCHAR)),
        r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk,
          row_number() OVER (PARTITION BY fold ORDER BY score DESC, candidate_id) AS i, count(*) OVER (PARTITION BY fold) AS n, count(*) FILTER (hit) OVER (PARTITION BY fold) AS p FROM x)
       SELECT fold, any_value(n) AS rows, any_value(p) AS positives,
         round((sum(rk) FILTER (hit) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * (any_value(n) - any_value(p))), 6) AS roc_auc,
         round(avg(hit::int) FILTER (i <= round_even(n * 0.1, 0)), 6) AS precision, round(count(*) FILTER (hit AND i <= round_even(n * 0.1, 0)) / any_value(p), 6) AS recall
       FROM r GROUP BY fold""",
)
def grouped_fold_ranking(spark, sf):
    rows = candidates(spark, sf).withColumns({"group": F.col("area").cast("string"), "hit": F.col("segment") == "BUILDING"})
    rows = rows.join(V.group_folds(rows, "group").select("group", "fold"), "group")
    top = V.caught_in_top(rows, ["fold"], "candidate_id", "balance", "hit", [0.1]).drop("share")
    return rounded(V.auc_by(rows, ["fold"], "balance", "hit").join(top, "fold"), "roc_auc", "precision", "recall")


SCORE = "round(0.6 * ln(1 + population) / 12 + 0.4 * least(greatest((coalesce(d, 50000) - 3000) / 17000, 0), 1) - 0.05 * least(coalesce(near, 0), 5), 9)"


@query(
    "known_site_recovery",
    f"""WITH cells AS (SELECT CAST(floor(lon / 0.05) * 100000 + floor(lat / 0.05) AS BIGINT) AS cell, floor(lon / 0.05) * 0.05 + 0.025 AS lon, floor(lat / 0.05) * 0.05 + 0.025 AS lat,
          sum(abs(balance)) AS population FROM {{v_candidates}} GROUP BY 1, 2, 3),
        placed AS (SELECT s.site_id, s.lon, s.lat, c.cell FROM {{v_sites}} s LEFT JOIN cells c ON c.cell = CAST(floor(s.lon / 0.05) * 100000 + floor(s.lat / 0.05) AS BIGINT)),
        marked AS (SELECT p.*, f.fold, cell IS NOT NULL AND {DRAW.format("'recovery:' || f.fold || ':' || site_id")} < 56294995342131 AS hidden FROM placed p CROSS JOIN (SELECT unnest(range(5)) AS fold) f),
        built AS (SELECT s.fold, c.cell, any_value(c.population) AS population, min({HAV.format(a="c", b="s")}) FILTER (NOT hidden) AS d,
          count(*) FILTER (NOT hidden AND {HAV.format(a="c", b="s")} <= 3000) AS near, max((s.cell = c.cell AND hidden)::int) AS lost, coalesce(count(*) FILTER (s.cell = c.cell AND NOT hidden), 0) AS here
          FROM cells c CROSS JOIN marked s GROUP BY 1, 2),
        rows AS (SELECT *, coalesce(lost, 0) AS hit, {SCORE} AS score FROM built),
        long AS (SELECT r.fold, v.view, b.ranked_by, r.cell, r.hit, CASE WHEN b.ranked_by = 'score' THEN score ELSE population END AS value
          FROM rows r JOIN (VALUES ('all'), ('unserved')) AS v(view) ON v.view = 'all' OR here = 0 CROSS JOIN (VALUES ('score'), ('baseline')) AS b(ranked_by)),
        ranked AS (SELECT *, rank() OVER (PARTITION BY fold, view, ranked_by ORDER BY value) + (count(*) OVER (PARTITION BY fold, view, ranked_by, value) - 1) / 2.0 AS rk,
          row_number() OVER (PARTITION BY fold, view, ranked_by ORDER BY value DESC, cell) AS i, count(*) OVER (PARTITION BY fold, view, ranked_by) AS n, sum(hit) OVER (PARTITION BY fold, view, ranked_by) AS p FROM long)
       SELECT CAST(fold AS INT) AS fold, view, ranked_by, any_value(n) AS rows, any_value(p)::bigint AS positives,
         CASE WHEN any_value(p) > 0 AND any_value(p) < any_value(n) THEN round((sum(rk) FILTER (hit = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * (any_value(n) - any_value(p))), 6) END AS roc_auc,
         CASE WHEN any_value(p) > 0 THEN round(sum(hit) FILTER (i <= greatest(round_even(n * 0.10, 0), 1)) / any_value(p), 6) END AS recall_top10,
         CASE WHEN any_value(p) > 0 THEN round(sum(hit) FILTER (i <= greatest(round_even(n * 0.25, 0), 1)) / any_value(p), 6) END AS recall_top25
       FROM ranked GROUP BY ALL""",
)
def known_site_recovery(spark, sf):
    x, y = F.floor(F.col("lon") / 0.05), F.floor(F.col("lat") / 0.05)
    key = (x * 100_000 + y).cast("bigint").alias("cell")
    cells = candidates(spark, sf).groupBy(key, (x * 0.05 + 0.025).alias("lon"), (y * 0.05 + 0.025).alias("lat")).agg(F.sum(F.abs("balance")).alias("population"))
    rows = sites(spark, sf).select("site_id", "lon", "lat", key).join(cells.select("cell", F.lit(1).alias("_in")), "cell", "left")
    rows = rows.select("site_id", "lon", "lat", F.when(F.col("_in") == 1, F.col("cell")).alias("cell"))

    def score(distance, density, here):
        return F.round(0.6 * F.log1p("population") / 12 + 0.4 * clip((distance - 3000) / 17_000, 0, 1) - 0.05 * F.least(density, F.lit(5)), 9)

    out = V.known_site_recovery(cells, rows, "cell", "site_id", score, "population")
    return rounded(out, "roc_auc", "recall_top10", "recall_top25")


PARTS = ["demand_component", "known_site_gap_component", "road_access_component", "terrain_component"]
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
SCENARIOS = V.changed_weights(PARTS, WEIGHTS)
TOTALS = ", ".join(
    f"({i}, '{s.name}', {s.factor}, {', '.join(repr(w / sum(s.weights)) + '::double' for w in s.weights)})" for i, s in enumerate(SCENARIOS))


@query(
    "ranking_stability",
    f"""WITH {PLAN_SQL}, pool AS (SELECT candidate_id, round_even(de, 4) AS de, round_even(ga, 4) AS ga, round_even(ro, 4) AS ro, round_even(te, 4) AS te FROM sc WHERE eligible),
        x AS (SELECT s.i, s.name, s.f, candidate_id, round(0.0::double + de * a + ga * b + ro * c + te * d, 10) AS score FROM pool CROSS JOIN (VALUES {TOTALS}) AS s(i, name, f, a, b, c, d)),
        r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY score) + (count(*) OVER (PARTITION BY i, score) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY i ORDER BY score DESC, candidate_id) AS n FROM x)
       SELECT r.name AS component, CAST(r.f AS DOUBLE) AS factor, round(corr(r.rk, b.rk), 6) AS spearman,
         round(count(*) FILTER (r.n <= 50 AND b.n <= 50) / (SELECT CAST(count(*) AS DOUBLE) FROM r WHERE i = 0 AND n <= 50), 6) AS top_overlap
       FROM r JOIN r b ON b.i = 0 AND b.candidate_id = r.candidate_id WHERE r.i > 0 GROUP BY 1, 2""",
)
def ranking_stability(spark, sf):
    pool = L.score_candidates(L.evaluate_eligibility(view(spark, sf, "v_plan"))).where("eligible")
    return rounded(V.ranking_stability(pool, "candidate_id", PARTS, SCENARIOS, 50), "spearman", "top_overlap")


CODES = "CASE WHEN " + " OR ".join(f"coalesce(({t}), false)" for t, _ in PLAN_CHECKS) + " THEN 0 ELSE 1 END"
REMOVALS = {"population_data_available": "population_sum_5km", "terrain_data_available": "elevation_m", "worldcover_data_available": None}


def _removed_sql(flag: str, field: str | None) -> str:
    blank = f"NOT hit AND {flag} AS {flag}" + (f", CASE WHEN NOT hit THEN {field} END AS {field}" if field else "")
    return f"""SELECT '{flag}' AS removed, count(*) FILTER (hit) AS affected, count(*) FILTER (ok) AS eligible, count(*) FILTER (hit AND ok) AS affected_eligible
      FROM (SELECT hit, {CODES} = 1 AND population_sum_5km IS NOT NULL AND elevation_m IS NOT NULL AS ok
            FROM (SELECT * REPLACE ({blank}) FROM (SELECT *, (row_number() OVER (ORDER BY candidate_id) - 1) % 10 = 0 AS hit FROM {{v_plan}})))"""


@query("missing_evidence_stress", " UNION ALL ".join(_removed_sql(*x) for x in REMOVALS.items()))
def missing_evidence_stress(spark, sf):
    return V.evidence_stress(view(spark, sf, "v_plan"), "candidate_id", REMOVALS)


CUTOFFS = {"min_gap": 3000.0, "min_people": 300.0, "max_road": 4000.0}


def _cutoff_sql(name: str, factor: float) -> str:
    v = CUTOFFS | {name: CUTOFFS[name] * factor}
    checks = CODES.replace("< 3000", f"< {v['min_gap']}").replace("< 300)", f"< {v['min_people']})").replace("> 4000", f"> {v['max_road']}")
    return f"SELECT '{name}' AS cutoff, {factor}::double AS factor, count(*) FILTER ({checks} = 1) AS eligible FROM {{v_plan}}"


@query("cutoff_sensitivity", " UNION ALL ".join(_cutoff_sql(n, f) for n in CUTOFFS for f in (0.5, 1.5)))
def cutoff_sensitivity(spark, sf):
    return V.cutoff_sensitivity(view(spark, sf, "v_plan"), CUTOFFS)


def _best_sql(step: float) -> str:
    return f"""SELECT lon, lat FROM (SELECT *, row_number() OVER (ORDER BY balance DESC, candidate_id) AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY floor(lon / {step}), floor(lat / {step}) ORDER BY balance DESC, candidate_id) AS i FROM {{v_candidates}}) WHERE i = 1) WHERE n <= 40"""


@query(
    "shortlist_proximity",
    f"""WITH a AS ({_best_sql(0.1)}), b AS ({_best_sql(0.05)}), d AS (SELECT a.lon, a.lat, min({HAV.format(a="a", b="b")}) AS d FROM a CROSS JOIN b GROUP BY 1, 2)
       SELECT count(*) AS picks, count(*) FILTER (d <= 2500) AS near_picks, round(quantile_cont(d, 0.5), 3) AS median_distance_m FROM d""",
)
def shortlist_proximity(spark, sf):
    def best(step):
        cell = [F.floor(F.col(c) / step).alias(f"_{c}") for c in ("lon", "lat")]
        picks = candidates(spark, sf).groupBy(*cell).agg(F.min(F.struct((-F.col("balance")).alias("b"), "candidate_id", "lon", "lat")).alias("p")).select("p.*")
        return picks.orderBy("b", "candidate_id").limit(40)

    return rounded(V.shortlist_proximity(best(0.1), best(0.05)), "median_distance_m", digits=3)


@query(
    "measurement_day_split",
    """WITH d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS i FROM (SELECT DISTINCT day FROM {v_measure}))
       SELECT CASE WHEN i <= 2 THEN 'holdout' ELSE 'training' END AS split, count(*) AS samples, count(DISTINCT day) AS days FROM {v_measure} JOIN d USING (day) GROUP BY 1""",
)
def measurement_day_split(spark, sf):
    rows = view(spark, sf, "v_measure")
    days = sorted(r.day for r in rows.select("day").distinct().collect())  # one row a day
    return V.declared_day_split(rows, "day", days[:-2], days[-2:]).groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("day").alias("days"))


# --- Networks --------------------------------------------------------------------------------

RULES = A.NetworkRules(
    codes={"0": "network_a", "1": "network_b"}, confirmed="network_b", regions={"network_b": A.LOW_REGIONS}, channels={"network_a": A.EXCLUSIVE_CHANNELS}, default="network_a")
KNOWN = f"""r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM {{v_attribution}}),
  donors AS (SELECT DISTINCT lon, lat, mnc = '0' OR stated = 'network_a' AS a, mnc = '1' OR stated = 'network_b' AS b FROM r WHERE mnc IN ('0', '1') OR stated IN ('network_a', 'network_b')),
  open AS (SELECT * FROM r WHERE NOT confirmed AND stated IS NULL AND mnc IS NULL),
  gaps AS (SELECT o.lon, o.lat, coalesce(min({HAV.format(a="o", b="d")}) FILTER (d.a), 1e9) AS da, coalesce(min({HAV.format(a="o", b="d")}) FILTER (d.b), 1e9) AS db
    FROM (SELECT DISTINCT lon, lat FROM open) o JOIN donors d ON abs(o.lat - d.lat) < 0.001 GROUP BY 1, 2),
  given AS (SELECT r.*, CASE WHEN confirmed THEN 'confirmed' WHEN stated IS NOT NULL THEN 'source_record' WHEN mnc IS NOT NULL THEN 'code'
      WHEN least(da, db) < 100 AND da <> db THEN 'nearby_site' WHEN region_id IN ('0', '1', '2', '3', '4', '5', '6', '8', '10', '14') THEN 'region'
      WHEN channel = 1400 THEN 'channel' ELSE 'default' END AS method, da, db FROM r LEFT JOIN gaps g ON g.lon = r.lon AND g.lat = r.lat),
  named AS (SELECT event_id, method, CASE method WHEN 'confirmed' THEN 'network_b' WHEN 'source_record' THEN stated WHEN 'code' THEN CASE mnc WHEN '0' THEN 'network_a' ELSE 'network_b' END
      WHEN 'nearby_site' THEN CASE WHEN da < db THEN 'network_a' ELSE 'network_b' END WHEN 'region' THEN 'network_b' ELSE 'network_a' END AS network FROM given)"""


@query("network_attribution", f"WITH {KNOWN} SELECT event_id, network, method, CASE network WHEN 'network_a' THEN '0' ELSE '1' END AS mnc FROM named")
def network_attribution(spark, sf):
    rows = view(spark, sf, "v_attribution").withColumn("channels", F.array("channel"))
    return A.attributed(rows, RULES).select("event_id", "network", "method", "mnc")


@query("network_attribution_methods", f"WITH {KNOWN} SELECT method, network, count(*) AS radios FROM named GROUP BY 1, 2")
def network_attribution_methods(spark, sf):
    rows = view(spark, sf, "v_attribution").withColumn("channels", F.array("channel"))
    return A.attributed(rows, RULES).groupBy("method", "network").agg(F.count("*").alias("radios"))
