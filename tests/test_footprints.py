import random

from pyspark.sql import functions as F

from mastwire.operators import context as S

RING = "array<struct<lon double, lat double>>"


def inside(ring, x, y):
    crossed = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        crossed += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return crossed % 2 == 1


def test_interior_point_lies_inside_any_outline(spark):
    rng = random.Random(5)
    comb = [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (8.0, 4.0), (8.0, 1.0), (3.0, 1.0), (3.0, 4.0), (2.0, 4.0), (2.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    rings = [comb, comb[::-1], [(x, -y) for x, y in comb]]
    for _ in range(40):  # heights of a jagged roof over a floor
        rings.append([(9.0, 0.0), (0.0, 0.0), *[(x, rng.uniform(0.1, 5)) for x in (0.0, *sorted(rng.uniform(0.1, 8.9) for _ in range(6)), 9.0)]])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"i int, ring {RING}")
    for r in df.select("i", S.interior_point(F.col("ring")).alias("p")).collect():
        assert inside(rings[r.i], r.p.lon, r.p.lat), rings[r.i]


def test_footprints_count_once_in_the_first_of_overlapping_areas(spark):
    def square(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]

    outlines = {1: square(0.0, 0.0, 0.1), 2: square(0.05, 0.0, 0.1), 3: square(1.0, 1.0, 0.1)}
    priority = {1: 2, 2: 1, 3: 3}
    rng = random.Random(2)
    rings = [square(rng.uniform(0, 0.2), rng.uniform(0, 0.1), rng.uniform(0.00005, 0.0004)) for _ in range(60)]
    rows = [("b" if i % 2 else "a", i, r) for i, r in enumerate(rings)]
    rows += [("c", 1000 + i, r) for i, r in enumerate(rings[:20])] + [("a", 2000, None), ("a", 2001, [(0.0, 0.0), (1.0, 0.0)]), ("a", 2002, [(0.01, 0.01)] * 4)]
    edges = [(a, *p, *q) for a, o in outlines.items() for p, q in zip(o, o[1:] + o[:1])]
    got = S.shortlisted_footprints(
        spark.createDataFrame(rows, f"source string, line int, ring {RING}"), spark.createDataFrame(list(priority.items()), "area int, priority int"),
        spark.createDataFrame(edges, "area int, x1 double, y1 double, x2 double, y2 double"), 0.05, k=5, min_m2=150.0).collect()
    want, metres = {}, 6_371_008.8 * 3.141592653589793 / 180
    for i, r in enumerate(rings):
        side = r[1][0] - r[0][0]
        x, y = r[0][0] + side / 2, r[0][1] + side / 2
        held = [a for a, o in outlines.items() if inside(o, x, y)]
        if held and (side * metres) ** 2 >= 150.01:
            want.setdefault(min(held, key=priority.get), []).append((-side, i))
    assert {(r.area, r["rank"], r.line) for r in got} == {(a, n + 1, i) for a, found in want.items() for n, (_, i) in enumerate(sorted(found)[:5])}
    assert len({r.building_id for r in got}) == len(got) and {r.area for r in got} == {1, 2}


def test_figures_of_an_outline_are_computed_once(spark):
    from mastwire.operators.geo import polygon_area_m2

    df = spark.createDataFrame([], f"ring {RING}").select(S.interior_point(F.col("ring")).alias("p"), polygon_area_m2(F.col("ring")).alias("a"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_min(") == plan.count("array_max(") - 1 == plan.count("array_sort(") == plan.count("COS(") == 1
