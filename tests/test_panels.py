import datetime as dt
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mastwire.operators import network as N
from mastwire.operators import panel as P
from mastwire.operators import steering as S
from mastwire.operators.ordered import quantiles_by, with_running


def day(i):
    return dt.date(2025, 1, 1) + dt.timedelta(days=i)


def test_running_totals_and_quantiles_with_one_hot_value(spark):
    rng = random.Random(3)
    rows = [(i, 5 if i % 3 else rng.randint(0, 9), f"g{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int, g string")
    out = with_running(df, [F.col("v").desc(), F.col("id").asc()], "rank", {"total": F.col("v")}).collect()
    expected, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    got = {r["id"]: r for r in out}
    for rank, (i, v, _) in enumerate(expected, 1):
        total += v
        assert (got[i]["rank"], got[i]["total"]) == (rank, total)
    q = {r["g"]: r for r in quantiles_by(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}, "n").collect()}
    for g in ("g0", "g1"):
        values = [v for _, v, k in rows if k == g]
        assert q[g]["n"] == len(values)
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.93)):
            assert abs(q[g][name] - np.quantile(values, p)) < 1e-9


def test_calendar_completion_equals_pandas(spark):
    rows = [("a", day(i), v) for i, v in ((0, None), (1, 10.0), (4, 16.0), (5, None), (9, 6.0), (11, None))]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    out = P.complete_calendar(df, ["k"], "date", ["v"]).orderBy("date").collect()
    series = pd.Series([r[2] for r in rows], index=pd.to_datetime([r[1] for r in rows]), dtype=float)
    full = series.reindex(pd.date_range(day(0), day(11))).interpolate(method="time")
    assert len(out) == 12
    for r, want in zip(out, full):
        assert (r["v"] is None) == bool(np.isnan(want)) and (r["v"] is None or abs(r["v"] - want) < 1e-9)


def test_features_never_see_the_current_day(spark):
    rows = [("a", day(i), float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    changed = df.withColumn("v", F.when(F.col("date") == F.lit(day(59)), 1e6).otherwise(F.col("v")))
    a, b = [P.time_features(x, ["k"], "date", "v").drop("v").orderBy("date").collect() for x in (df, changed)]
    assert a == b and len(a) > 0
    c, d = [P.band_features(x, ["k"], "date", "v").drop("v").orderBy("date").collect() for x in (df, changed)]
    assert c == d


def test_splits_are_in_time_order(spark):
    rows = [(k, day(i), 1.0) for k, n in (("a", 20), ("b", 7), ("c", 3)) for i in range(n)]
    split = P.split_by_position(spark.createDataFrame(rows, "k string, date date, v double"), ["k"], "date")
    assert not P.split_violations(split, ["k"], "date").take(1)
    counts = {(r["k"], r["split"]): r["count"] for r in split.groupBy("k", "split").count().collect()}
    assert counts[("a", "train")] == 14 and counts[("a", "validation")] == 3 and counts[("b", "test")] == 1


def test_keep_last_is_stable(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, t int, id string")
    out = {r["k"]: r["id"] for r in P.keep_last(df, ["k"], [F.coalesce("t", F.lit(-1)), F.col("id")]).collect()}
    assert out == {"a": "z", "b": "w"}


ALERT = "tower string, date date, availability_pct double, erab_drop_rate double, rrc_setup_sr double, erab_estab_sr double, handover_sr double, dl_throughput_mbps double, connected_users double"


def test_alert_stories(spark):
    good = (100.0, 0.1, 100.0, 100.0, 100.0, 20.0, 40.0)
    rows = []
    for i in range(31):
        last = i == 30
        rows.append(("DOWN1", day(i), *((10.0, *good[1:]) if last else good)))
        rows.append(("SLEEP1", day(i), *((*good[:6], 2.0) if last else good)))
        rows.append(("DROPS1", day(i), *((100.0, 2.0, *good[2:]) if i > 27 else good)))
        rows.append(("WARN1", day(i), *((100.0, 0.1, 99.0, *good[3:]) if last else good)))
        rows.append(("FINE1", day(i), *good))
        if not last:
            rows.append(("GONE1", day(i), *good))
    alerts = N.tower_alerts(spark.createDataFrame(rows, ALERT))
    got = [(r["tower"], r["level"], r["kinds"]) for r in alerts.orderBy(*N.worst_first(alerts)).collect()]
    assert got == [
        ("DOWN1", "critical", "availability"), ("SLEEP1", "critical", "sleeping"), ("DROPS1", "major", "drops"),
        ("WARN1", "warning", "setup"), ("GONE1", "warning", "no_report"),
    ]


def test_steering_equals_the_day_by_day_loop(spark):
    rng = random.Random(4)
    rows = []
    for d in range(3):
        for t in range(60):
            donor = rng.random() < 0.3
            rows.append(
                (f"T{t:02d}", day(d), float(rng.randint(20, 90)), 3.0 if donor else float(rng.randint(8, 20)), 99.0,
                 "HIGH" if donor else "NORMAL", float(rng.randint(70, 95)), 0.5, float(rng.randint(3, 30)), "AB"[t % 2])
            )
    names = ["tower", "date", "users", "download", "availability", "category", "risk", "load_factor", "headroom", "cluster"]
    got = S.offload_plan(spark.createDataFrame(rows, names)).collect()
    want = []
    frame = pd.DataFrame(rows, columns=names)
    for (d, c), part in frame.groupby(["date", "cluster"]):
        room = {r.tower: [r.headroom, r.download] for r in part.itertuples() if r.category == "NORMAL" and r.headroom >= 5}
        donors = part[part.category == "HIGH"].sort_values(["risk", "download", "tower"], ascending=[False, True, True])
        for r in donors.itertuples():
            able = [(-h * s, t) for t, (h, s) in room.items() if h >= 4]
            if able:
                best = min(able)[1]
                moved = max(int(min(r.users * 0.25, room[best][0] * 0.4)), 3)
                room[best][0] -= moved
                want.append((d, c, r.tower, best, moved))
    assert sorted((r["date"], r["cluster"], r["donor"], r["acceptor"], r["shifted"]) for r in got) == sorted(want)


def test_bounds_sla_and_band_names(spark):
    df = spark.createDataFrame(
        [("TR_1", "erab_drop_rate", 120.0), ("T_2", "downtime_sec", -1.0), ("TS_3", "erab_drop_rate", 0.5), ("NT9", "other", 7.0)],
        "name string, kpi string, value double",
    )
    out = df.select(
        N.band_of_name(F.col("name")).alias("b"), N.bounded_value(F.col("kpi"), F.col("value")).alias("v"),
        N.sla_met(F.col("kpi"), F.col("value")).alias("ok"),
    ).collect()
    assert [tuple(r) for r in out] == [(3500, 100.0, False), (3500, 0.0, True), (400, 0.5, True), (350, 7.0, True)]


def test_means_on_a_target_do_not_hang_on_the_order_of_their_readings(spark):
    values = [99.815, 99.83, 99.25, 99.17, 99.23, 99.75, 99.185, 99.77, 99.53, 99.67, 99.47, 99.33]  # their sum in this order falls a hair short of the target
    columns = ("rrc_setup_sr", "erab_estab_sr", "erab_drop_rate", "handover_sr", "availability_pct", "dl_throughput_mbps", "ul_throughput_mbps", "connected_users")
    rows = [("T", day(150 + i), v, *([50.0] * (len(columns) - 1))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tower string, date date, " + ", ".join(f"{c} double" for c in columns)).coalesce(1)
    profile = N.tower_profile(df).first()
    assert profile["rrc_setup_sr_mean"] < 99.5 and not profile["sla_rrc_violation"]
    assert N.health_stats(N.tower_profile(df)).first()["rrc_breaches"] == 0


def test_repair_fills_days_itself_and_sorts_a_series_once(spark):
    rng = random.Random(5)
    rows = [(k, day(i), None if i % 17 == 3 else 50.0 + i % 7 + (300.0 if i == 40 else rng.random()))
            for k in "ab" for i in range(90) if rng.random() < 0.7 or i in (0, 40, 89)]
    df = spark.createDataFrame([*rows, ("one", day(3), 5.0), ("none", day(1), None)], "k string, date date, v double")
    in_one = P.repair_anomalies(df, ["k"], "date", "v", 3.0, fill_days=True)
    in_two = P.repair_anomalies(P.complete_calendar(df, ["k"], "date", ["v"]), ["k"], "date", "v", 3.0)
    got, want = ({(r["k"], r["date"]): r for r in x.collect()} for x in (in_one, in_two))
    assert got.keys() == want.keys() and got[("a", day(40))]["is_anomaly"]
    for at, row in got.items():
        for name in ("v", "raw_value", "expected", "is_anomaly"):
            a, b = row[name], want[at][name]
            assert a == b or abs(a - b) < 1e-9
    assert got[("none", day(1))]["v"] is None and got[("one", day(3))]["v"] == 5.0
    for plan in (in_one, P.complete_calendar(df, ["k"], "date", ["v"])):
        text = plan._jdf.queryExecution().sparkPlan().toString()
        assert text.count("Window [") <= 1


def test_tasks_of_the_tower_panel_grow_with_the_lines(spark, monkeypatch):
    from mastwire.plans import adapters as A

    folder = "/root/testdata/sf0.001"
    whole = {(r["tower"], r["date"]): r["users"] for r in A.tower_days(spark, folder, "users").collect()}
    few = A.tower_days(spark, folder, "users").rdd.getNumPartitions()
    monkeypatch.setattr(A, "LINES_PER_TASK", 200)
    many = A.tower_days(spark, folder, "users")
    assert many.rdd.getNumPartitions() >= 25 > few
    assert {(r["tower"], r["date"]): r["users"] for r in many.collect()} == whole
    parts = {(r["tower"], r["part"]) for r in many.select("tower", F.spark_partition_id().alias("part")).distinct().collect()}
    assert len(parts) == len({tower for tower, _ in whole})


def test_marks_are_kept_only_for_features_that_miss(spark):
    from mastwire.operators import models as D

    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    rows, features = D.with_found_gaps_marked(df, ["x", "y"])
    assert features == ["x", "y", "x_missing"]
    assert sorted((r["x"], r["y"], r["x_missing"]) for r in rows.collect()) == [(0.0, 3.0, 1.0), (1.0, 2.0, 0.0)]


def test_steering_computes_a_score_once_and_reads_the_panel_once(spark):
    from mastwire.plans import network as W

    rows = [("a", day(i), float(10 + i), 4.0, 1.0, 99.0) for i in range(20)]
    df = spark.createDataFrame(rows, "tower string, date date, users double, download double, drop_rate double, availability double")
    joined = S.congestion_scores(df, S.capacity_ceilings(df)).collect()
    alone = S.congestion_scores(S.with_own_ceiling(df)).collect()
    key = lambda r: r["date"]
    names = ("tower", "capacity_95th", "load_factor", "headroom", "risk", "category")
    assert [[r[n] for n in names] for r in sorted(joined, key=key)] == [[r[n] for n in names] for r in sorted(alone, key=key)]
    plan = S.offload_plan(W.scored(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bround") <= 6  # three figures of the scores, once each, and those of the plan itself
    assert plan.count("l_extendedprice#") and plan.count("Relation [l_orderkey") == 1


def test_clusters_compute_their_input_once(spark):
    from mastwire.operators import models as D

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.range(50).selectExpr("id * 1.0D AS x", "id % 7 * 1.0D AS y").mapInPandas(counted, "x double, y double")
    assert D.standardized(df, ["x", "y"]).count() == 50 and read.value == 50


def test_cells_are_counted_in_tasks_that_grow_with_the_lines(spark, monkeypatch):
    from mastwire.plans import adapters, network

    monkeypatch.setattr(adapters, "LINES_PER_TASK", 200)
    folder = "/root/testdata/sf0.001"
    n = adapters.line_tasks(spark, folder)
    plan = network.bands(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert n > 20 and re.search(rf"hashpartitioning\(date#\d+, name#\d+, {n}\)", plan)
    assert not re.search(r"hashpartitioning\(date#\d+, band#\d+, name#\d+", plan)


def test_network_means_pass_no_cells_through_a_fixed_number_of_tasks(spark, monkeypatch):
    import duckdb

    from mastwire.plans import adapters, network
    from mastwire.plans.registry import ORACLES

    monkeypatch.setattr(adapters, "LINES_PER_TASK", 200)
    folder = "/root/testdata/sf0.001"
    out = network.network_daily_means(spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", plan)]
    n = adapters.line_tasks(spark, folder)
    # Lines and cells go to tasks that grow with the lines, the rest are sums by day and band.
    assert n > 20 and sorted(k for k, tasks in dealt if tasks == n) == ["date, name", "l_suppkey, l_shipdate"]
    assert sorted(k for k, tasks in dealt if tasks != n) == ["date", "date, band"]
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(ORACLES["network_daily_means"]).fetchall()
    assert sorted(map(tuple, out.select("date", "availability", "users", "downtime").collect())) == sorted(want)
