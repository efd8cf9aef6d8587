import math
import random

import pytest
from pyspark.sql import functions as F

from mastwire.operators import geo as D
from mastwire.operators import inventory as I


def metres(a, b):
    (x1, y1), (x2, y2) = [(math.radians(p[0]), math.radians(p[1])) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * D.EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def clustered_points(seed, n):
    """A third of the points in one spot, a third in a dense patch, the rest spread out."""
    rng = random.Random(seed)
    out = [(13.2, 32.8)] * (n // 3)
    out += [(13.3 + rng.random() / 100, 32.9 + rng.random() / 100) for _ in range(n // 3)]
    return out + [(13 + rng.random(), 32.6 + rng.random() / 2) for _ in range(n - len(out))]


def test_radius_sums_and_nearest_equal_brute_force(spark):
    points, sites = clustered_points(1, 40), clustered_points(2, 90)
    p = spark.createDataFrame(points, "lon double, lat double")
    s = spark.createDataFrame(sites, "lon double, lat double")
    sums = {(r["lon"], r["lat"]): r for r in D.radius_sums(p, s, [1000.0, 5000.0], {"n": F.lit(1)}).collect()}
    near = {(r["lon"], r["lat"]): r["distance_m"] for r in D.nearest(p, s, start_m=500.0).collect()}
    assert set(near) == set(points)
    for point in set(points):
        gaps = [metres(point, q) for q in sites]
        assert abs(near[point] - min(gaps)) < 1e-3
        for r in (1000, 5000):
            got = sums[point][f"n_{r}"] if point in sums else 0
            assert got == sum(g <= r for g in gaps)


def test_nearest_other_skips_itself_but_not_its_copies(spark):
    sites = [(13.0, 32.6), (13.0, 32.6), (13.1, 32.7), (13.9, 33.0)]
    df = spark.createDataFrame(sites, "lon double, lat double")
    near = {(r["lon"], r["lat"]): r["distance_m"] for r in D.nearest(df, df, others_only=True).collect()}
    assert near[(13.0, 32.6)] == 0
    assert abs(near[(13.1, 32.7)] - metres(sites[2], sites[0])) < 1e-3
    assert abs(near[(13.9, 33.0)] - metres(sites[3], sites[2])) < 1e-3


def test_separated_selection_equals_the_greedy_loop(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [(i, round(rng.random(), 1), *p) for i, p in enumerate(clustered_points(seed, 150))]
        df = spark.createDataFrame(rows, "id int, score double, lon double, lat double")
        chosen = []
        for row in sorted(rows, key=lambda r: (-r[1], r[0])):
            if all(metres(row[2:], c[2:]) >= 2500 for c in chosen):
                chosen.append(row)
        got = {r["id"] for r in D.separated(df, "id", "score", 2500.0).collect()}
        assert got == {c[0] for c in chosen}
        top = [r["id"] for r in D.separated(df, "id", "score", 2500.0, 5).collect()]
        assert top == [c[0] for c in chosen[:5]]


def test_connected_sites_equal_union_find(spark):
    points = clustered_points(5, 120)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lon double, lat double")
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if metres(points[i], points[j]) <= 300:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["id"]: r["component"] for r in I.connected_sites(df, "id", 300.0).collect()}
    assert got == {i: root(i) for i in range(len(points))}


def test_point_in_polygon_keeps_the_first_area(spark):
    edges = []
    for area, (x, y) in {1: (0.0, 0.0), 2: (1.0, 0.0)}.items():
        ring = [(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)]
        edges += [(area, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    e = spark.createDataFrame(edges, "area int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (2.5, 0.5), (9.0, 9.0)], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["area"] for r in D.assign_areas(p, e, 0.7).collect()}
    assert got == {(0.5, 0.5): 1, (1.5, 1.5): 1, (2.5, 0.5): 2}


def test_zonal_total_is_unknown_when_data_are_missing(spark):
    pixels = [(13 + i / 100, 32.8, 2.0, None if i == 3 else 10.0) for i in range(6)]
    px = spark.createDataFrame(pixels, "lon double, lat double, area double, value double")
    p = spark.createDataFrame([(13.0, 32.8), (13.05, 32.8)], "lon double, lat double")
    got = {r["lon"]: r for r in D.zonal_total(p, px, 2000.0).collect()}
    assert got[13.0]["total"] == 60.0
    assert got[13.05]["total"] is None and abs(got[13.05]["valid_fraction"] - 2 / 3) < 1e-9


def test_line_lengths_are_cut_at_cell_borders(spark):
    rng = random.Random(8)
    lines = [(13 + rng.random() * 0.5, 32 + rng.random() * 0.5, 13 + rng.random() * 0.5, 32 + rng.random() * 0.5) for _ in range(25)]
    lines += [(13.01, 32.02, 13.02, 32.03), (13.0, 32.05, 13.3, 32.05), (13.1, 32.0, 13.1, 32.4), (13.2, 32.2, 13.2, 32.2), (-0.02, -0.02, 0.03, 0.01)]
    df = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    got = {(r.cx, r.cy): r.metres for r in D.line_length_by_cell(df, 0.05).collect()}
    want = {}
    for x1, y1, x2, y2 in lines:
        n = 4000
        for i in range(n):
            t = (i + 0.5) / n
            cell = math.floor((x1 + (x2 - x1) * t) / 0.05), math.floor((y1 + (y2 - y1) * t) / 0.05)
            want[cell] = want.get(cell, 0) + metres((x1, y1), (x2, y2)) / n
    assert sum(got.values()) == pytest.approx(sum(metres(x[:2], x[2:]) for x in lines))
    assert all(abs(got.get(c, 0) - want.get(c, 0)) < 60 for c in got.keys() | want.keys())


def test_points_outside_all_areas_get_the_nearest(spark):
    square = lambda a, x, y: [(a, x, y, x + 1, y), (a, x + 1, y, x + 1, y + 1), (a, x + 1, y + 1, x, y + 1), (a, x, y + 1, x, y)]
    edges = spark.createDataFrame([*square(1, 10.0, 0.0), *square(2, 12.0, 0.0)], "area int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(10.5, 0.5), (11.5, 0.5), (11.4, 0.2), (13.5, 0.5), (30.0, 0.5)], "lon double, lat double")
    got = {r.lon: (r.area, r.way, r.distance_m) for r in D.assign_or_nearest(points, edges, 0.25).collect()}
    assert got[10.5] == (1, "inside", 0.0) and got[11.5][:2] == (1, "nearest") and got[11.4][0] == 1 and got[13.5][0] == got[30.0][0] == 2
    assert got[13.5][2] == pytest.approx(metres((13.0, 0.5), (13.5, 0.5)), rel=1e-3)
    assert D.assign_or_nearest(points, edges.limit(0), 0.25).count() == 0
