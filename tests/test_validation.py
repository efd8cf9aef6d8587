import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mastwire.operators import attribution as A
from mastwire.operators import geo as D
from mastwire.operators import validation as V
from tests.test_grouping import distance


def test_hold_out_takes_whole_groups_and_skips_a_huge_one(spark):
    sizes = {"huge": 500, **{f"g{i}": 10 + i for i in range(30)}}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)] * 7, "town string")
    got = {r.town: r for r in V.held_out_groups(df, "town").collect()}
    total = df.count()
    assert {k: r.rows for k, r in got.items()} == {**sizes, "Unknown": 7}
    held = sum(r.rows for r in got.values() if r.held_out)
    assert not got["huge"].held_out and 0.2 * total <= held <= 0.3 * total
    assert V.held_out_groups(df.limit(0), "town").count() == 0


def test_folds_differ_by_at_most_the_largest_group(spark):
    rng = random.Random(1)
    sizes = {f"g{i}": rng.randint(1, 60) for i in range(47)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "town string")
    loads = [0] * 5
    rows = V.group_folds(df, "town").collect()
    for r in rows:
        loads[r.fold] += r.rows
    assert len(rows) == 47 and max(loads) - min(loads) <= max(sizes.values())


def auc(scores, labels):
    pos, neg = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_grouped_auc_and_recall(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 3}", i, float(rng.randint(0, 9)), int(rng.random() < 0.3)) for i in range(300)] + [("one", 1000 + i, 1.0, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "fold string, id long, score double, y int")
    got = {r.fold: r for r in V.auc_by(df, ["fold"], "score", "y").collect()}
    tops = {(r.fold, r.share): r for r in V.caught_in_top(df, ["fold"], "id", "score", "y", [0.1, 0.25]).collect()}
    for f in ("f0", "f1", "f2", "one"):
        own = [r for r in rows if r[0] == f]
        assert got[f].roc_auc == (pytest.approx(auc([r[2] for r in own], [r[3] for r in own])) if f != "one" else None)
        for share in (0.1, 0.25):
            n = max(1, round(len(own) * share))
            best = sorted(own, key=lambda r: (-r[2], r[1]))[:n]
            assert tops[f, share].recall == pytest.approx(sum(r[3] for r in best) / sum(r[3] for r in own))


def test_one_search_for_all_sets_equals_separate_searches(spark):
    rng = random.Random(3)
    points = [(13 + rng.random(), 32 + rng.random()) for _ in range(60)]
    places = [(i, 13 + rng.random() * 0.4, 32 + rng.random() * 0.4, rng.random() < 0.5, i < 2) for i in range(80)] + [(99, 20.0, 40.0, False, False)]
    sites = spark.createDataFrame(places, "id int, lon double, lat double, a boolean, b boolean")
    sets = {"a": F.col("a"), "b": F.col("b"), "none": F.lit(False)}
    got = {(r.lon, r.lat): r for r in D.nearest_in_sets(spark.createDataFrame(points, "lon double, lat double"), sites, sets).collect()}
    assert len(got) == 60
    for p in points:
        for at, name in ((3, "a"), (4, "b")):
            assert got[p][name] == pytest.approx(min(distance(p, s[1:3]) for s in places if s[at]), abs=1e-5)
        assert got[p]["none"] is None


def test_recovery_equals_rebuilt_distances(spark):
    rng = random.Random(4)
    cells = [(k, 13 + 0.05 * (k % 8), 32 + 0.05 * (k // 8), float(rng.randint(0, 9000))) for k in range(64)]
    sites = [(f"s{i}", 13 + rng.random() * 0.4, 32 + rng.random() * 0.4, rng.choice([*range(64), None])) for i in range(50)]
    c = spark.createDataFrame(cells, "cell long, lon double, lat double, population double")
    s = spark.createDataFrame(sites, "site string, lon double, lat double, cell long")
    score = lambda d, near, here: d / 1000 - near
    got = {(r.fold, r.view, r.ranked_by): r for r in V.known_site_recovery(c, s, "cell", "site", score, "population", folds=3).collect()}
    lost = {(r.site, k) for k in range(3) for r in s.where(V.hidden_in(k, "site") & F.col("cell").isNotNull()).collect()}
    assert lost
    for k in range(3):
        kept = [x for x in sites if (x[0], k) not in lost]
        labels = {cell[0]: int(any(x[3] == cell[0] and (x[0], k) in lost for x in sites)) for cell in cells}
        value = {cell[0]: min(distance(cell[1:3], x[1:3]) for x in kept) / 1000 - sum(distance(cell[1:3], x[1:3]) <= 3000 for x in kept) for cell in cells}
        for view in ("all", "unserved"):
            own = [x for x in cells if view == "all" or not any(y[3] == x[0] for y in kept)]
            for by, v in (("score", value), ("baseline", {x[0]: x[3] for x in cells})):
                expected = auc([v[x[0]] for x in own], [labels[x[0]] for x in own])
                r = got[k, view, by]
                assert r.rows == len(own) and (r.roc_auc == expected if expected is None else r.roc_auc == pytest.approx(expected))


def test_stability_equals_plain_ranks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((200, 2)), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    scenarios = V.changed_weights(["a", "b"], (0.6, 0.4))
    got = {(r.component, r.factor): r for r in V.ranking_stability(df, "id", ["a", "b"], scenarios, 20).collect()}
    import pandas as pd
    scores = [pd.Series(np.round(x @ (np.array(s.weights) / sum(s.weights)), 10)) for s in scenarios]
    tops = [set(sorted(range(200), key=lambda i: (-s[i], i))[:20]) for s in scores]
    assert len(got) == 4
    for s, v, top in zip(scenarios[1:], scores[1:], tops[1:]):
        assert got[s.name, s.factor].spearman == pytest.approx(v.rank().corr(scores[0].rank()))
        assert got[s.name, s.factor].top_overlap == pytest.approx(len(top & tops[0]) / 20)


def test_declared_days_must_be_the_observed_ones(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    assert {r.day: r.split for r in V.declared_day_split(df, "day", days[:2], days[2:]).collect()}[days[2]] == "holdout"
    for training, holdout in ((days[:1], days[2:]), (days[1:], days[:1]), (days, days[2:]), ([], days)):
        with pytest.raises(ValueError):
            V.declared_day_split(df, "day", training, holdout)


def test_attribution_follows_the_evidence_in_order(spark):
    m = 1 / 111_195  # a metre of latitude in degrees
    rows = [  # id, lon, lat, mnc, stated, region, channels, confirmed
        ("conf", 13.0, 32.0, "0", "network_a", "1", [1400], True), ("stated", 13.0, 32.1, None, "network_a", "1", [], False),
        ("code", 13.0, 32.2, "1", None, "99", [], False), ("near_b", 13.0, 32.2 + 90 * m, None, None, "99", [1400], False),
        ("far", 13.0, 32.2 + 110 * m, None, None, "99", [1400], False), ("nearer_a", 13.0, 32.1 + 20 * m, None, "odd", "1", [], None),
        ("b_too", 13.0, 32.1 + 70 * m, "1", None, "99", [], False), ("tie_a", 14.0, 33.0, "0", None, "99", [], False), ("tie_b", 14.0, 33.0, "1", None, "99", [], False),
        ("tied", 14.0, 33.0 + 5 * m, None, None, " 10 ", [], False), ("channel", 15.0, 30.0, "7", None, "99", [5, 1400], False),
        ("rest", 15.0, 30.0, None, None, None, None, False), ("nowhere", None, None, None, None, "2", [], False),
    ]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, mnc string, stated string, region_id string, channels array<int>, confirmed boolean")
    rules = A.NetworkRules({"0": "network_a", "1": "network_b"}, "network_b", {"network_b": A.LOW_REGIONS}, {"network_a": A.EXCLUSIVE_CHANNELS}, "network_a")
    got = {r.id: (r.network, r.method, r.mnc) for r in A.attributed(df, rules).collect()}
    a, b = ("network_a", "0"), ("network_b", "1")
    want = {"conf": (b, "confirmed"), "stated": (a, "source_record"), "code": (b, "code"), "near_b": (b, "nearby_site"), "far": (a, "channel"),
            "nearer_a": (a, "nearby_site"), "b_too": (b, "code"), "tie_a": (a, "code"), "tie_b": (b, "code"), "tied": (b, "region"),
            "channel": (a, "channel"), "rest": (a, "default"), "nowhere": (b, "region")}
    assert got == {k: (n, method, c) for k, ((n, c), method) in want.items()}
    assert A.attributed(df.limit(0), rules).count() == 0


def test_attribution_keeps_places_not_rows(spark, monkeypatch):
    from mastwire.operators import geo

    kept = []

    def recorded(df):
        kept.append((tuple(df.columns), df.count()))
        return df

    monkeypatch.setattr(A, "materialize", recorded)
    monkeypatch.setattr(geo, "materialize", recorded)
    rows = [(i, 13.0, 32.0 + i % 3 * 1e-4, "1" if i % 3 == 0 else None, None, None, None, False) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double, mnc string, stated string, region_id string, channels array<int>, confirmed boolean")
    got = A.attributed(df, A.NetworkRules({"0": "network_a", "1": "network_b"}, "network_b", default="network_a"))
    assert sorted((r.id, r.network, r.method) for r in got.collect()) == [
        (i, "network_b", "nearby_site" if i % 3 else "code") for i in range(30)]
    # One row a place, and after the only round no places are sought again: two tables at most for each network with a place.
    assert all("id" not in columns and n <= 3 for columns, n in kept) and len(kept) <= 4
