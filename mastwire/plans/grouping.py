"""Registered queries on site groups, location spread, operators and neighbours of networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastwire.operators import grouping as G
from mastwire.operators import inventory as I
from mastwire.plans.adapters import view
from mastwire.plans.network import rounded
from mastwire.plans.places import HAV, candidates
from mastwire.plans.registry import query

GROUPED = f"""points AS (SELECT candidate_id AS c, ('0x' || substr(md5(candidate_id::varchar), 1, 12))::bigint AS k, lon, lat FROM {{v_candidates}}),
  near AS (SELECT a.k AS p, b.k AS q, round({HAV.format(a="a", b="b")}, 3) AS d FROM points a JOIN points b ON a.k <> b.k AND abs(a.lat - b.lat) < 0.03),
  t AS (SELECT p, q, p AS cp, q AS cq, d, 0 AS r FROM near WHERE d <= 2500
    UNION ALL (
      WITH sizes AS (SELECT cp AS c, count(DISTINCT p) AS n FROM t GROUP BY 1),
        gaps AS (SELECT cp, cq, max(d) AS d FROM t JOIN sizes x ON x.c = cp JOIN sizes y ON y.c = cq WHERE cp <> cq GROUP BY cp, cq HAVING count(*) = any_value(x.n * y.n)),
        closest AS (SELECT cp, cq FROM gaps QUALIFY row_number() OVER (PARTITION BY cp ORDER BY floor(d / 50), xor(cp, cq), least(cp, cq), greatest(cp, cq)) = 1),
        merges AS (SELECT a.cp AS gone, a.cq AS kept FROM closest a JOIN closest b ON a.cp = b.cq AND a.cq = b.cp WHERE a.cp > a.cq)
      SELECT p, q, coalesce(x.kept, cp), coalesce(y.kept, cq), d, r + 1 FROM t LEFT JOIN merges x ON x.gone = cp LEFT JOIN merges y ON y.gone = cq
      WHERE EXISTS (SELECT 1 FROM merges))),
  grouped AS (SELECT p AS k, any_value(cp) AS g FROM t WHERE r = (SELECT max(r) FROM t) GROUP BY p),
  placed AS (SELECT points.*, coalesce(g, k) AS g FROM points LEFT JOIN grouped USING (k)),
  pairs AS (SELECT a.g, a.k, sum({HAV.format(a="a", b="b")}) AS total, max({HAV.format(a="a", b="b")}) AS far FROM placed a JOIN placed b ON a.g = b.g GROUP BY a.g, a.k),
  named AS (SELECT p.g, substr(sha256(concat_ws(':', min(p.c)::varchar, count(*)::varchar, sum(p.k)::hugeint::varchar)), 1, 16) AS group_id,
      count(*) AS members, count(DISTINCT (lon, lat)) AS locations, max(far) AS diameter_m, arg_min(p.c, (round(total, 3), p.c)) AS medoid FROM placed p JOIN pairs ON pairs.k = p.k GROUP BY p.g)"""


@query("bounded_site_groups", f"WITH RECURSIVE {GROUPED} SELECT p.c AS candidate_id, group_id FROM placed p JOIN named USING (g)")
def bounded_site_groups(spark, sf):
    members, _ = G.bounded_groups(candidates(spark, sf).select("candidate_id", "lon", "lat"), "candidate_id", 2500.0)
    return members.select("candidate_id", "group_id")


@query(
    "site_group_medoids",
    f"""WITH RECURSIVE {GROUPED} SELECT group_id, members, locations, medoid AS medoid_candidate_id, m.lon, m.lat, round(diameter_m, 3) AS diameter_m
        FROM named JOIN points m ON m.c = medoid""",
)
def site_group_medoids(spark, sf):
    _, groups = G.bounded_groups(candidates(spark, sf).select("candidate_id", "lon", "lat"), "candidate_id", 2500.0)
    return rounded(groups, "diameter_m", digits=3)


@query(
    "site_chain_diameters",
    f"""WITH RECURSIVE e AS (SELECT a.candidate_id AS f, b.candidate_id AS t FROM {{v_candidates}} a JOIN {{v_candidates}} b
          ON a.candidate_id <> b.candidate_id AND abs(a.lat - b.lat) < 0.01 WHERE {HAV.format(a="a", b="b")} <= 600),
        reach AS (SELECT candidate_id AS f, candidate_id AS t FROM {{v_candidates}} UNION SELECT reach.f, e.t FROM reach JOIN e ON reach.t = e.f),
        m AS (SELECT f AS candidate_id, min(t) AS component FROM reach GROUP BY f), p AS (SELECT * FROM m JOIN {{v_candidates}} USING (candidate_id)),
        d AS (SELECT a.component, max({HAV.format(a="a", b="b")}) AS spread FROM p a JOIN p b ON a.component = b.component GROUP BY 1)
       SELECT component, count(*) AS points, count(DISTINCT (lon, lat)) AS locations, round(any_value(spread), 3) AS spread_m, any_value(spread) > 600 AS exceeds
       FROM p JOIN d USING (component) GROUP BY component""",
)
def site_chain_diameters(spark, sf):
    members = I.connected_sites(candidates(spark, sf).select("candidate_id", "lon", "lat"), "candidate_id", 600.0)
    return rounded(G.chain_audit(members, "component", 600.0), "spread_m", digits=3)


@query(
    "location_conflicts",
    f"""SELECT a.area, any_value(n) AS locations, round(max({HAV.format(a="a", b="b")}), 3) AS spread_m, CASE WHEN max({HAV.format(a="a", b="b")}) > 50000 THEN 'conflict' ELSE 'agree' END AS verdict
        FROM {{v_candidates}} a JOIN {{v_candidates}} b ON a.area = b.area
          JOIN (SELECT area, count(DISTINCT (lon, lat)) AS n FROM {{v_candidates}} GROUP BY 1) c ON c.area = a.area GROUP BY a.area""",
)
def location_conflicts(spark, sf):
    return rounded(G.conflicting_locations(candidates(spark, sf), ["area"], 50_000.0), "spread_m", digits=3)


ALTERNATIVES = """SELECT radio, CAST(area AS BIGINT) AS area, lon, lat, event_id AS alternative, samples >= 20 AS verified, created AS first_seen, updated AS last_seen
   FROM {v_cells} WHERE area IS NOT NULL AND lat < 90"""


@query(
    "location_reviews",
    f"""WITH x AS ({ALTERNATIVES}), g AS (SELECT radio, area, count(*) AS alternatives, count(*) FILTER (verified) AS verified,
          bool_and(first_seen <= last_seen AND last_seen <= 1700000000) AS ok, max(last_seen) AS l, max(last_seen) FILTER (verified) AS vl, max(alternative) FILTER (verified) AS va FROM x GROUP BY 1, 2),
        d AS (SELECT a.radio, a.area, max({HAV.format(a="a", b="b")}) AS far FROM x a JOIN x b ON a.radio = b.radio AND a.area = b.area GROUP BY 1, 2)
       SELECT g.radio, g.area, alternatives, verified, CASE WHEN ok AND verified = 1 AND vl >= l THEN 'preferred_for_review' ELSE 'unresolved' END AS status,
         CASE WHEN ok AND verified = 1 AND vl >= l THEN va END AS preferred_alternative, round(far, 2) AS spread_m
       FROM g JOIN d ON g.radio = d.radio AND g.area = d.area WHERE alternatives > 1""",
)
def location_reviews(spark, sf):
    rows = view(spark, sf, "v_cells").where("area IS NOT NULL AND lat < 90").select(
        "radio", F.col("area").cast("long").alias("area"), "lon", "lat", F.col("event_id").alias("alternative"), (F.col("samples") >= 20).alias("verified"),
        F.col("created").alias("first_seen"), F.col("updated").alias("last_seen"))
    return rounded(G.reviewed_locations(rows, ["radio", "area"], F.lit(1_700_000_000.0)), "spread_m", digits=2)
