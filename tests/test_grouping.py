import hashlib
import math
import random

import numpy as np
import pytest

from mastwire.operators import grouping as G
from mastwire.operators.geo import EARTH_M


def distance(a, b):
    (x1, y1), (x2, y2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(h, 1)))


def complete_linkage(places, limit):
    """Merge the two closest groups, one after the other."""
    groups = [[p] for p in places]
    while True:
        pairs = [(max(distance(p, q) for p in a for q in b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        if not pairs or min(pairs)[0] > limit:
            return {frozenset(g) for g in groups}
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)


def test_groups_equal_the_sequential_merge(spark):
    rng = random.Random(11)
    for _ in range(2):
        places = [(13 + rng.random() * 0.003, 32.5 + rng.random() * 0.003) for _ in range(45)]
        rows = [(f"r{i}", *p) for i, p in enumerate(places)] + [(f"copy{i}", *places[0]) for i in range(40)]
        members, groups = G.bounded_groups(spark.createDataFrame(rows, "id string, lon double, lat double"), "id", 50.0, 1e-6)
        found = {}
        for r in members.collect():
            found.setdefault(r.group_id, set()).add((r.lon, r.lat))
        assert {frozenset(g) for g in found.values()} == complete_linkage(places, 50.0)
        weight = {p: 41 if p == places[0] else 1 for p in places}
        for g in groups.collect():
            own = found[g.group_id]
            assert g.diameter_m <= 50 and g.diameter_m == pytest.approx(max(distance(p, q) for p in own for q in own), abs=1e-5)
            sums = {p: sum(distance(p, q) * weight[q] for q in own) for p in own}
            assert sums[g.lon, g.lat] == pytest.approx(min(sums.values()), abs=1e-2) and g.members == sum(weight[p] for p in own)
        assert sum(g.members for g in groups.collect()) == len(rows)


def test_crowded_cells_stay_within_the_limit(spark, monkeypatch):
    monkeypatch.setattr(G, "PARTS", 4)
    rng = random.Random(2)
    rows = [(i, 13 + rng.random() * 0.0015, 32.5 + rng.random() * 0.0015) for i in range(1500)] + [(9999, None, 1.0)]
    members, groups = G.bounded_groups(spark.createDataFrame(rows, "id long, lon double, lat double"), "id", 50.0)
    held = {}
    for r in members.collect():
        held.setdefault(r.group_id, []).append((r.lon, r.lat))
    assert sum(map(len, held.values())) == 1500 and len(held) < 60
    assert all(distance(p, q) <= 50.001 for g in held.values() for p in g for q in g)
    assert groups.agg({"diameter_m": "max"}).first()[0] <= 50.001


def test_ids_follow_the_members_only(spark):
    rows = [("a", 13.0, 32.0), ("b", 13.0001, 32.0), ("c", 14.0, 32.0)]
    ids = [{r.id: r.group_id for r in G.bounded_groups(spark.createDataFrame(x, "id string, lon double, lat double"), "id", 50.0)[0].collect()}
           for x in (rows, rows[::-1])]
    assert ids[0] == ids[1] and ids[0]["a"] == ids[0]["b"] != ids[0]["c"]
    empty = spark.createDataFrame([], "id string, lon double, lat double")
    assert [x.count() for x in G.bounded_groups(empty, "id", 50.0)] == [0, 0]


def test_spread_equals_the_farthest_pair(spark):
    rng = random.Random(5)
    rows = [("hot", 13 + rng.gauss(0, 0.4), 32 + rng.gauss(0, 0.4)) for _ in range(3000)]
    rows += [(f"k{i}", rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(40) for _ in range(1 + i % 9)]
    rows += [("line", 10 + i / 10, 20.0) for i in range(50)] + [("one", 1.0, 2.0)] * 5 + [(None, 3.0, 4.0), (None, 3.0, 5.0), ("gone", None, 2.0)]
    rows += [("wide", -170.0, 10.0), ("wide", 10.0, 5.0), ("wide", 80.0, -60.0), ("wide", 81.0, -60.0)]
    got = {r.k: (r.locations, r.spread_m) for r in G.location_spread(spark.createDataFrame(rows, "k string, lon double, lat double"), ["k"]).collect()}
    own = {}
    for k, *p in rows:
        if None not in p:
            own.setdefault(k, set()).add(tuple(p))
    assert got.keys() == own.keys()
    for k, places in own.items():
        places = list(places)
        far = max((distance(p, q) for i, p in enumerate(places) for q in places[i:]), default=0)
        assert got[k][0] == len(places) and got[k][1] == pytest.approx(far, abs=1e-3), k


def test_review_prefers_one_verified_latest_alternative(spark):
    schema = "k string, alternative long, lon double, lat double, verified boolean, first_seen double, last_seen double"
    rows = [
        ("good", 1, 13.0, 32.0, True, 1.0, 9.0), ("good", 2, 13.5, 32.0, False, 1.0, 8.0),
        ("older", 1, 13.0, 32.0, True, 1.0, 7.0), ("older", 2, 13.5, 32.0, None, 1.0, 8.0),
        ("two", 1, 13.0, 32.0, True, 1.0, 9.0), ("two", 2, 13.5, 32.0, True, 1.0, 9.0),
        ("odd", 1, 13.0, 32.0, True, 1.0, 9.0), ("odd", 2, 13.5, 32.0, False, None, 8.0),
        ("late", 1, 13.0, 32.0, True, 1.0, 99.0), ("late", 2, 13.5, 32.0, False, 1.0, 8.0), ("single", 1, 13.0, 32.0, True, 1.0, 9.0),
    ]
    got = {r.k: r for r in G.reviewed_locations(spark.createDataFrame(rows, schema), ["k"], G.F.lit(50.0)).collect()}
    assert got.keys() == {"good", "older", "two", "odd", "late"}
    assert got["good"].preferred_alternative == 1 and got["good"].spread_m == pytest.approx(distance((13, 32), (13.5, 32)))
    assert all(got[k].status == "unresolved" and got[k].preferred_alternative is None for k in ("older", "two", "odd", "late"))


def test_closest_pairs_are_found_without_a_sort(spark, monkeypatch):
    """Names were four columns wide and the closest pair of each a sorted minimum: tens of millions of pairs took an hour."""
    rows = [(i, 13 + i * 0.00011, 32.5 + i % 3 * 0.0001) for i in range(60)]
    plans = []
    kept = G.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return kept(df)

    monkeypatch.setattr(G, "materialize", noted)
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    _, groups = G.bounded_groups(points, "id", 50.0)
    found = sorted(r.group_id for r in groups.collect())
    closest = [p for p in plans if "n#" in p and "rank" in p]
    assert closest and not any("SortAggregate" in p for p in closest)
    # Hashes that collide are told apart, and the wider rank gives the same groups.
    monkeypatch.setattr(G, "HASH_BITS", 0)
    assert sorted(r.group_id for r in G.bounded_groups(points, "id", 50.0)[1].collect()) == found


def merged_in_rounds(points, limit, step):
    """All pairs of groups in each round, every two that are each other's closest merge: the rounds of the SQL."""
    names = {int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16): (k, p) for k, p in points}
    groups = {n: [n] for n in names}
    gap = {(a, b): round(distance(names[a][1], names[b][1]), 3) for a in names for b in names}
    while True:
        closest = {}
        for a in groups:
            far = [(max(gap[p, q] for p in groups[a] for q in groups[b]), a ^ b, b) for b in groups if a != b]
            near = [(d // step, mix, b) for d, mix, b in far if d <= limit]
            if near:
                closest[a] = min(near)[2]
        pairs = [(a, b) for a, b in closest.items() if a < b and closest[b] == a]
        if not pairs:
            return {frozenset(names[n][0] for n in g) for g in groups.values()}
        for a, b in pairs:
            groups[a] += groups.pop(b)


def test_groups_do_not_depend_on_crowds_or_copies(spark, monkeypatch):
    """A cell of many places was joined in small parts first, and copies of a place merged before the first round."""
    monkeypatch.setattr(G, "PARTS", 2)
    rng = random.Random(4)
    places = [(13 + rng.random() * 0.0016, 32.5 + rng.random() * 0.0016) for _ in range(90)]
    points = [(i, p) for i, p in enumerate(places)] + [(100 + i, places[i % 11]) for i in range(40)]
    rows = spark.createDataFrame([(k, *p) for k, p in points], "id long, lon double, lat double")
    for step in (1.0, 25.0):
        held = {}
        for r in G.bounded_groups(rows, "id", 50.0, step)[0].collect():
            held.setdefault(r.group_id, set()).add(r.id)
        assert {frozenset(g) for g in held.values()} == merged_in_rounds(points, 50.0, step)


def test_least_mix_needs_no_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for held in (rng.choice(50, 20, replace=False), rng.integers(0, 2**50, 300), np.array([5, 9])):
        held = np.unique(held).astype(np.int64)
        asked = held[::2]
        assert (G._least_xor(held, asked) == [min(a ^ b for b in held if a != b) for a in asked]).all()
        assert (G._least_in(held[::-1].copy(), asked) == G._least_xor(held, asked)).all()
        monkeypatch.setattr(G, "CELLS", 1)
        assert (G._least_in(held[::-1].copy(), asked) == G._least_xor(held, asked)).all()
        monkeypatch.undo()
