"""Distance joins on a grid: radius sums, nearest neighbour, separation, point in polygon.

Neither side is ever paired with all of the other. Sites are first summarised by fine grid
cell (count, sums and the box their points really span). A point meets the occupied cells of
its 3x3 coarse neighbourhood, at most a few hundred rows however dense an area is. A cell
wholly inside the radius adds its sums, one wholly outside adds nothing, and only cells that
the circle cuts are opened. Copies of one location form a box of no extent, which the circle
never cuts, so heavy duplication costs nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.functions.numeric import once
from mastwire.session import materialize

EARTH_M = 6_371_008.8
METRES_PER_DEGREE = EARTH_M * math.pi / 180.0
FINE_PER_COARSE = 8
SALTS = 8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean-radius sphere."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def offset_point(lon: Column, lat: Column, metres: Column, bearing: Column) -> tuple[Column, Column]:
    """The point at a distance and bearing (degrees from north)."""
    angle, turn, phi = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    lat2 = F.asin(F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(turn))
    lon2 = F.radians(lon) + F.atan2(
        F.sin(turn) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * F.sin(lat2)
    )
    return F.degrees(lon2), F.degrees(lat2)


def settlement_rings(places: DataFrame, radii, bearings: int = 8) -> DataFrame:
    """Candidate points on rings around each place."""
    around = places.withColumn("ring_m", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    around = around.withColumn("bearing", F.explode(F.array(*[F.lit(360.0 * i / bearings) for i in range(bearings)])))
    lon, lat = offset_point(F.col("lon"), F.col("lat"), F.col("ring_m"), F.col("bearing"))
    return around.withColumns({"lon": lon, "lat": lat})


def grid_cell(lon: Column, lat: Column, step: float, parent: int = 1) -> tuple[Column, Column]:
    """Square cell indexes at a step in degrees, or those of the parent `parent` times as wide."""
    x, y = F.floor(lon / step), F.floor(lat / step)
    return (x, y) if parent == 1 else (F.floor(x / parent), F.floor(y / parent))


def _steps(metres: float, max_lat: float) -> tuple[float, float]:
    """Cell sides in degrees that are at least the given length anywhere up to a latitude."""
    side = metres / METRES_PER_DEGREE * 1.001
    return side / math.cos(math.radians(min(max_lat, 89.0))), side


def _max_lat(points: DataFrame) -> float:
    return (points.agg(F.max(F.abs("lat"))).first()[0] or 0.0) + 1.0


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cells(sites: DataFrame, coarse: tuple[float, float], weights: dict[str, Column]) -> DataFrame:
    """Occupied fine cells with their sums and the box their points span."""
    fine = F.struct(
        F.floor(F.col("lon") / (coarse[0] / FINE_PER_COARSE)).alias("x"),
        F.floor(F.col("lat") / (coarse[1] / FINE_PER_COARSE)).alias("y"),
    )
    out = sites.groupBy(fine.alias("cell")).agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"),
        *[F.sum(c).alias(f"sum_{k}") for k, c in weights.items()],
    )
    return out.withColumns(
        {"cx": F.floor(F.col("cell.x") / FINE_PER_COARSE), "cy": F.floor(F.col("cell.y") / FINE_PER_COARSE)}
    )


def _near_cells(points: DataFrame, cells: DataFrame, coarse: tuple[float, float]) -> DataFrame:
    """Each point with the occupied cells of its neighbourhood and distance bounds to their box.

    The smaller, summarised side is repeated over salts so that a crowded neighbourhood of
    points is spread over several tasks.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # Points are small rows that multiply below: a fixed spread keeps them in many tasks, and
    # the later grouping by location needs no further shuffle.
    points = points.repartition(tasks(points), "lon", "lat")
    spread = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    reach = points.withColumns(
        {
            "salt": F.pmod(F.xxhash64("lon", "lat"), F.lit(SALTS)).cast("int"),
            "_at": F.explode(around),
        }
    ).withColumns(
        {
            "cx": F.floor(F.col("lon") / coarse[0]) + F.col("_at.i"),
            "cy": F.floor(F.col("lat") / coarse[1]) + F.col("_at.j"),
        }
    )
    pairs = reach.join(spread, ["cx", "cy", "salt"])
    lon, lat = F.col("lon"), F.col("lat")
    inside_lon = F.least(F.greatest(lon, F.col("w")), F.col("e"))
    inside_lat = F.least(F.greatest(lat, F.col("s")), F.col("n"))
    # The farthest corner lies on the box side farther in longitude, at either latitude.
    far_lon = F.when(F.abs(lon - F.col("w")) > F.abs(lon - F.col("e")), F.col("w")).otherwise(F.col("e"))
    low = haversine(lon, lat, inside_lon, inside_lat)
    high = F.greatest(haversine(lon, lat, far_lon, F.col("s")), haversine(lon, lat, far_lon, F.col("n")))
    one_place = (F.col("w") == F.col("e")) & (F.col("s") == F.col("n"))
    # A box is not exactly convex on a sphere, so its bounds carry a small margin.
    bounds = F.struct(
        F.when(one_place, low).otherwise(low * 0.999 - 0.01).alias("low"),
        F.when(one_place, low).otherwise(high * 1.001 + 0.01).alias("high"),
    )
    # Generated rather than projected, so later filters reuse the distances instead of
    # repeating the trigonometry in every condition.
    return pairs.withColumn("_b", F.explode(F.array(bounds))).select("*", "_b.low", "_b.high").drop("_at", "cx", "cy", "salt", "_b")


def _opened(pairs: DataFrame, sites: DataFrame, coarse: tuple[float, float], columns: list[str]) -> DataFrame:
    """The sites of the given cells, with the exact distance."""
    cell = F.struct(
        F.floor(F.col("lon") / (coarse[0] / FINE_PER_COARSE)).alias("x"),
        F.floor(F.col("lat") / (coarse[1] / FINE_PER_COARSE)).alias("y"),
    )
    inner = sites.select(cell.alias("cell"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), *columns)
    inner = inner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    outer = pairs.withColumn("salt", F.pmod(F.xxhash64("lon", "lat"), F.lit(SALTS)).cast("int"))
    return outer.join(inner, ["cell", "salt"]).withColumn(
        "distance_m", haversine(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat"))
    )


def radius_sums(
    points: DataFrame, sites: DataFrame, radii_m: list[float], weights: dict[str, Column], max_lat: float | None = None
) -> DataFrame:
    """Sums of site weights within each radius of every distinct point location, exactly.

    Columns are named weight_radius; a location with no site in reach is absent.
    """
    places = points.select("lon", "lat").distinct()
    coarse = _steps(max(radii_m), max_lat if max_lat is not None else _max_lat(places))
    own = sites.select("lon", "lat", *[c.alias(f"w_{k}") for k, c in weights.items()])
    located = own.groupBy("lon", "lat").agg(*[F.sum(f"w_{k}").alias(f"w_{k}") for k in weights])
    cells = _cells(located, coarse, {k: F.col(f"w_{k}") for k in weights})
    near = _near_cells(places, cells, coarse).where(F.col("low") <= max(radii_m))
    cut = F.lit(False)
    for r in radii_m:
        cut = cut | ((F.col("low") <= r) & (F.col("high") > r))
    whole = near.where(~cut).select(
        "lon", "lat", F.col("high").alias("distance_m"), *[F.col(f"sum_{k}").alias(f"w_{k}") for k in weights]
    )
    opened = _opened(near.where(cut).select("lon", "lat", "cell"), located, coarse, [f"w_{k}" for k in weights])
    both = whole.unionByName(opened.select("lon", "lat", "distance_m", *[f"w_{k}" for k in weights]))
    return both.groupBy("lon", "lat").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("distance_m") <= r, F.col(f"w_{k}"))), F.lit(0)).alias(f"{k}_{int(r)}")
            for k in weights
            for r in radii_m
        ]
    )


def nearest(
    points: DataFrame, sites: DataFrame, keep: list[str] | None = None, start_m: float = 2000.0, others_only: bool = False,
    within_m: float | None = None,
) -> DataFrame:
    """Distance to (and columns of) the nearest site for every distinct point location.

    The search starts in a small neighbourhood and widens fourfold for points whose best hit
    may not be the nearest. Of the cells met, only those that can beat the best upper bound
    are opened. `keep` names site columns to return; its order breaks exact ties. With
    `others_only` a site at the very same location does not count unless it has a copy. With
    `within_m` only hits up to that distance are sought, in one round; other locations are absent.
    """
    keep = keep or []
    if others_only:
        counted = sites.groupBy("lon", "lat").agg(F.count("*").alias("copies"))
        located, keep = counted, ["copies"]
    else:
        located = sites.groupBy("lon", "lat").agg(*([F.min(F.struct(*keep)).alias("site")] if keep else [F.count("*").alias("copies")]))
        keep = ["site"] if keep else ["copies"]
    located = materialize(located)
    open_points = points.select("lon", "lat").distinct()
    extent = located.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if extent[0] is None:
        none = open_points.withColumn("distance_m", F.lit(None).cast("double"))
        return none.where(F.lit(False)) if within_m else none
    max_lat = max(_max_lat(open_points), _max_lat(located))
    radius, found = within_m or start_m, None
    while True:
        coarse = _steps(radius, max_lat)
        cells = _cells(located, coarse, {"n": F.col("copies") if others_only else F.lit(1)})
        near = _near_cells(open_points, cells, coarse)
        # With self excluded, only a cell with another location or a copy bounds the distance.
        bound = F.when(F.col("sum_n") > 1, F.col("high")) if others_only else F.col("high")
        best = near.withColumn("_best", F.min(bound).over(Window.partitionBy("lon", "lat")))
        able = best.where(F.col("_best").isNull() | (F.col("low") <= F.col("_best")))
        hits = _opened(able.select("lon", "lat", "cell"), located, coarse, keep)
        if others_only:
            same = (F.col("lon") == F.col("s_lon")) & (F.col("lat") == F.col("s_lat"))
            hits = hits.where(~same | (F.col("copies") > 1))
        closest = hits.groupBy("lon", "lat").agg(F.min(F.struct("distance_m", *keep)).alias("hit"))
        whole = radius > METRES_PER_DEGREE * 360
        settled = closest if whole else closest.where(F.col("hit.distance_m") <= radius)
        settled = materialize(settled.select("lon", "lat", "hit.*"))
        found = settled if found is None else found.unionByName(settled)
        if whole or within_m:
            break
        open_points = materialize(open_points.join(settled, ["lon", "lat"], "left_anti"))
        if not open_points.take(1):
            break
        radius *= 4
    if keep == ["site"]:
        found = found.select("lon", "lat", "distance_m", "site.*")
    return found.drop("copies")


def nearest_in_sets(points: DataFrame, sites: DataFrame, sets: dict[str, Column], start_m: float = 2000.0) -> DataFrame:
    """Distance to the nearest site of each set, for every distinct point location, in one search.

    `sets` names conditions on a site. A cell bounds a set's distance only where it holds a site of
    that set, and a cell is opened if it can beat the bound of any set. A set without a site has no
    distance.
    """
    names = list(sets)
    located = materialize(sites.withColumns({f"w_{n}": c.cast("int") for n, c in sets.items()}).groupBy("lon", "lat").agg(
        *[F.max(f"w_{n}").alias(f"w_{n}") for n in names]))
    open_points = points.select("lon", "lat").distinct()
    some = located.agg(*[F.max(f"w_{n}").alias(n) for n in names]).first()
    sought = [n for n in names if some[n]]
    none = {n: F.lit(None).cast("double") for n in names if n not in sought}
    if not sought:
        return open_points.withColumns(none)
    max_lat = max(_max_lat(open_points), _max_lat(located))
    radius, found = start_m, None
    while True:
        coarse = _steps(radius, max_lat)
        near = _near_cells(open_points, _cells(located, coarse, {n: F.col(f"w_{n}") for n in sought}), coarse)
        place = Window.partitionBy("lon", "lat")
        near = near.withColumns({f"_best_{n}": F.min(F.when(F.col(f"sum_{n}") > 0, F.col("high"))).over(place) for n in sought})
        useful = F.lit(False)
        for n in sought:
            useful = useful | ((F.col(f"sum_{n}") > 0) & (F.col("low") <= F.col(f"_best_{n}")))
        hits = _opened(near.where(useful).select("lon", "lat", "cell"), located, coarse, [f"w_{n}" for n in sought])
        closest = hits.groupBy("lon", "lat").agg(*[F.min(F.when(F.col(f"w_{n}") > 0, F.col("distance_m"))).alias(n) for n in sought])
        whole = radius > METRES_PER_DEGREE * 360
        done = F.lit(True)
        for n in sought:
            done = done & F.coalesce(F.col(n) <= radius, F.lit(False))
        settled = materialize(closest if whole else closest.where(done))
        found = settled if found is None else found.unionByName(settled)
        open_points = materialize(open_points.join(settled, ["lon", "lat"], "left_anti"))
        if whole or not open_points.take(1):
            return found.withColumns(none) if none else found
        radius *= 4


def site_context(points: DataFrame, sites: DataFrame, radii_m=(1000.0, 3000.0, 5000.0, 10000.0), flags=()) -> DataFrame:
    """Nearest site, sites within radii and nearest site of each flagged subset, per point."""
    out = points.join(
        nearest(points, sites).withColumnRenamed("distance_m", "dist_to_nearest_site_m"), ["lon", "lat"], "left"
    )
    counts = radius_sums(points, sites, list(radii_m), {"sites": F.lit(1)})
    names = {f"sites_{int(r)}": f"site_density_{int(r / 1000)}km" for r in radii_m}
    out = out.join(counts.withColumnsRenamed(names), ["lon", "lat"], "left").fillna(0, list(names.values()))
    for flag in flags:
        hit = nearest(points, sites.where(F.col(flag)))
        out = out.join(hit.withColumnRenamed("distance_m", f"dist_{flag}_m"), ["lon", "lat"], "left")
    return out


def zonal_total(points: DataFrame, pixels: DataFrame, radius_m: float, min_valid: float = 0.99) -> DataFrame:
    """Density times area within a circle, known only when enough of the circle has data.

    Pixels carry lon, lat, area and value (missing where there is no data); a pixel belongs to
    the circle when its centre does.
    """
    area, value = F.col("area"), F.col("value")
    sums = radius_sums(
        points, pixels, [radius_m],
        {"total": F.coalesce(value * area, F.lit(0.0)), "valid": F.when(value.isNotNull(), area).otherwise(0.0), "all": area},
    )
    r = int(radius_m)
    fraction = F.try_divide(F.col(f"valid_{r}"), F.col(f"all_{r}"))
    return sums.select(
        "lon", "lat", fraction.alias("valid_fraction"), F.when(fraction >= min_valid, F.col(f"total_{r}")).alias("total")
    )


def separated(
    candidates: DataFrame, key: str, score: str, min_m: float, top_k: int | None = None
) -> DataFrame:
    """Best-first selection with a minimum distance, equal to the one-by-one greedy choice.

    In a cell whose diagonal is below the distance at most one candidate can be chosen, so per
    round only each cell's best undecided candidate is compared, with the points of at most
    25 cells: work grows with candidates times a constant. A leader with no better undecided
    point in reach is chosen; every point in reach of a chosen one is out. Rounds stop once
    enough chosen candidates outrank everything undecided.
    """
    undecided = materialize(
        candidates.where(F.col(score).isNotNull()).select(key, F.col(score).alias("score"), "lon", "lat")
    )
    lon_step, lat_step = _steps(min_m / math.sqrt(2) / 1.01, 0.0)
    # A cell is narrower in metres away from the equator, so its diagonal stays below min_m;
    # the reach in cells grows accordingly.
    stretch = 1.0 / math.cos(math.radians(min(_max_lat(undecided), 85.0)))
    reach_x, reach_y = math.ceil(min_m / (lon_step * METRES_PER_DEGREE) * stretch), math.ceil(
        min_m / (lat_step * METRES_PER_DEGREE)
    )
    around = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach_x, reach_x + 1) for j in range(-reach_y, reach_y + 1)]
    )
    placed = undecided.withColumns(
        {"cx": F.floor(F.col("lon") / lon_step), "cy": F.floor(F.col("lat") / lat_step)}
    )
    undecided, chosen = materialize(placed), None
    # Higher score first, then the smaller key: the struct order of (score, -rank) by key.
    while undecided.take(1):
        rank = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
        leaders = undecided.groupBy("cx", "cy").agg(F.min(F.struct(*rank_fields(key), "lon", "lat")).alias("l"))
        leaders = leaders.select(
            F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("l.s").alias("l_s"), F.col("l.k").alias("l_k"),
            F.col("l.lon").alias("l_lon"), F.col("l.lat").alias("l_lat"),
        )
        spread = leaders.withColumn("_at", F.explode(around)).withColumns(
            {"cx": F.col("lx") + F.col("_at.i"), "cy": F.col("ly") + F.col("_at.j")}
        ).drop("_at", "lx", "ly")
        near = undecided.join(spread, ["cx", "cy"]).where(
            haversine(F.col("lon"), F.col("lat"), F.col("l_lon"), F.col("l_lat")) < min_m
        )
        # Every leader meets itself; it is free when nothing in reach ranks before it.
        best_near = near.groupBy("l_s", "l_k", "l_lon", "l_lat").agg(F.min(rank).alias("best"))
        free = materialize(
            best_near.where((F.col("best.s") == F.col("l_s")) & (F.col("best.k") == F.col("l_k"))).drop("best")
        )
        picked = free.select(F.col("l_k").alias(key), (-F.col("l_s")).alias(score), F.col("l_lon").alias("lon"), F.col("l_lat").alias("lat"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        hit = near.join(free.select("l_k"), "l_k", "left_semi").select(key).distinct()
        undecided = materialize(undecided.join(hit, key, "left_anti"))
        if top_k is not None:
            top = chosen.orderBy(F.col(score).desc(), key).limit(top_k).select(score, key).collect()
            rest = undecided.agg(F.min(rank).alias("r")).first()["r"]
            last = top[-1] if top else None
            if len(top) >= top_k and (rest is None or (-last[score], last[key]) < (rest["s"], rest["k"])):
                break
    if chosen is None:
        return candidates.select(key, score, "lon", "lat").where(F.lit(False))
    return chosen if top_k is None else chosen.orderBy(F.col(score).desc(), key).limit(top_k)


def rank_fields(key: str) -> list[Column]:
    return [(-F.col("score")).alias("s"), F.col(key).alias("k")]


# --- Polygons ----------------------------------------------------------------------------


def assign_areas(points: DataFrame, edges: DataFrame, step: float) -> DataFrame:
    """The first area (by id) that contains each distinct location, by ray casting.

    Edges are rows (area, x1, y1, x2, y2). An area's outline is one value of its own; it is
    spread over the grid cells its box covers, so a point meets only nearby outlines.
    """
    outline = edges.groupBy("area").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
        F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"),
    )
    covered = outline.withColumn(
        "cx", F.explode(F.sequence(F.floor(F.col("w") / step), F.floor(F.col("e") / step)))
    ).withColumn("cy", F.explode(F.sequence(F.floor(F.col("s") / step), F.floor(F.col("n") / step))))
    places = points.select("lon", "lat").distinct().withColumns(
        {"cx": F.floor(F.col("lon") / step), "cy": F.floor(F.col("lat") / step)}
    )
    lon, lat = F.col("lon"), F.col("lat")
    boxed = places.join(covered, ["cx", "cy"]).where(lon.between(F.col("w"), F.col("e")) & lat.between(F.col("s"), F.col("n")))

    def crosses(e: Column) -> Column:
        above = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + F.try_divide((lat - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return above & (lon < at)

    inside = boxed.where(F.size(F.filter("edges", crosses)) % 2 == 1)
    return inside.groupBy("lon", "lat").agg(F.min("area").alias("area"))


def polygon_area_m2(ring: Column) -> Column:
    """Shoelace area of a ring of (lon, lat) pairs in local metres around its first vertex."""
    k = METRES_PER_DEGREE

    def flat(r: Column) -> Column:
        lon0, lat0 = r[0]["lon"], r[0]["lat"]
        return F.transform(
            r, lambda p: F.struct(((p["lon"] - lon0) * F.cos(F.radians(lat0)) * k).alias("x"), ((p["lat"] - lat0) * k).alias("y"))
        )

    def area(corners: Column) -> Column:
        nxt = F.concat(F.slice(corners, 2, F.size(corners) - 1), F.slice(corners, 1, 1))
        terms = F.zip_with(corners, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2

    return once(ring, lambda r: once(flat(r), area))


def terrain(pixels: DataFrame, cell_m: float) -> DataFrame:
    """Slope in degrees from the four neighbouring pixels of a (px, py, elevation) table."""
    near = None
    for name, dx, dy in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1)):
        moved = pixels.select(
            (F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.lit(name).alias("side"), "elevation"
        )
        near = moved if near is None else near.unionByName(moved)
    sides = near.groupBy("px", "py").agg(
        *[F.max(F.when(F.col("side") == n, F.col("elevation"))).alias(n) for n in ("e", "w", "n", "s")]
    )
    rise = F.sqrt(F.pow((F.col("e") - F.col("w")) / (2 * cell_m), F.lit(2.0)) + F.pow((F.col("n") - F.col("s")) / (2 * cell_m), F.lit(2.0)))
    return pixels.join(sides, ["px", "py"]).withColumn("slope_deg", F.degrees(F.atan(rise))).drop("e", "w", "n", "s")


# --- Lines -------------------------------------------------------------------------------


def segment_distance(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance in metres from a point to a segment, in local flat metres around the point."""
    kx, ky = F.cos(F.radians(lat)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)
    ax, ay, bx, by = (x1 - lon) * kx, (y1 - lat) * ky, (x2 - lon) * kx, (y2 - lat) * ky
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))


def line_pieces(segments: DataFrame, piece_m: float) -> DataFrame:
    """Segments cut into equal pieces no longer than the given length, keeping other columns."""
    length = haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    n = F.greatest(F.ceil(length * 1.01 / piece_m), F.lit(1)).cast("int")
    out = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dx, dy = (F.col("x2") - F.col("x1")) / F.col("_n"), (F.col("y2") - F.col("y1")) / F.col("_n")
    ends = {
        "x1": F.col("x1") + dx * F.col("_i"), "y1": F.col("y1") + dy * F.col("_i"),
        "x2": F.col("x1") + dx * (F.col("_i") + 1), "y2": F.col("y1") + dy * (F.col("_i") + 1),
    }
    return out.withColumns(ends).drop("_n", "_i")


def nearest_line(points: DataFrame, segments: DataFrame, start_m: float = 2000.0, keep: str | None = None) -> DataFrame:
    """Distance to the nearest segment for every distinct point location, and its column `keep`.

    With `keep` distances are compared in whole millimetres, ties going to its smallest value.

    Segments are cut to pieces shorter than a fine cell; a cell's box covers its whole pieces,
    so the same bounds apply as for sites, and a hit settles once no piece outside the
    neighbourhood can be nearer.
    """
    piece = start_m / FINE_PER_COARSE
    kept = [keep] if keep else []
    pieces = line_pieces(segments.select("x1", "y1", "x2", "y2", *kept).distinct(), piece)
    pieces = materialize(
        pieces.withColumns({"lon": (F.col("x1") + F.col("x2")) / 2, "lat": (F.col("y1") + F.col("y2")) / 2})
    )
    open_points = points.select("lon", "lat").distinct()
    if not pieces.take(1):
        none = open_points.where(F.lit(False)).withColumn("distance_m", F.lit(None).cast("double"))
        return none.withColumn(keep, F.lit(None).cast(segments.schema[keep].dataType)) if keep else none
    max_lat = max(_max_lat(open_points), _max_lat(pieces))
    radius, found = start_m, None
    while True:
        coarse = _steps(radius, max_lat)
        cell = F.struct(
            F.floor(F.col("lon") / (coarse[0] / FINE_PER_COARSE)).alias("x"),
            F.floor(F.col("lat") / (coarse[1] / FINE_PER_COARSE)).alias("y"),
        )
        cells = pieces.groupBy(cell.alias("cell")).agg(
            F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"),
            F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"),
        ).withColumns(
            {"cx": F.floor(F.col("cell.x") / FINE_PER_COARSE), "cy": F.floor(F.col("cell.y") / FINE_PER_COARSE)}
        )
        near = _near_cells(open_points, cells, coarse)
        best = near.withColumn("_best", F.min("high").over(Window.partitionBy("lon", "lat")))
        # Flat local metres differ slightly from the sphere, hence the wider margin.
        able = best.where(F.col("low") * 0.99 <= F.col("_best") * 1.01).select("lon", "lat", "cell")
        hits = _opened(able, pieces, coarse, ["x1", "y1", "x2", "y2", *kept]).withColumn(
            "distance_m", segment_distance(*[F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")])
        )
        if keep:
            closest = hits.groupBy("lon", "lat").agg(F.min(F.struct(F.round("distance_m", 3).alias("distance_m"), keep)).alias("hit")).select("lon", "lat", "hit.*")
        else:
            closest = hits.groupBy("lon", "lat").agg(F.min("distance_m").alias("distance_m"))
        whole = radius > METRES_PER_DEGREE * 360
        settled = materialize(closest if whole else closest.where(F.col("distance_m") <= (radius - piece) * 0.99))
        found = settled if found is None else found.unionByName(settled)
        open_points = materialize(open_points.join(settled, ["lon", "lat"], "left_anti"))
        if whole or not open_points.take(1):
            return found
        radius *= 4


def line_length_by_cell(segments: DataFrame, step: float) -> DataFrame:
    """Metres of line per grid cell: each segment is cut where it crosses a grid line.

    A piece counts with its share of the segment, so the cells add up to the length of all segments;
    a piece along a grid line belongs to the cell above or right of it.
    """
    def crossings(a: Column, b: Column) -> Column:
        low, high = F.floor(F.least(a, b) / step) + 1, F.ceil(F.greatest(a, b) / step) - 1
        lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: (k * step - a) / (b - a))

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings(x1, x2), crossings(y1, y2))))
    spans = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.get("_cuts", i - 1).alias("a"), F.get("_cuts", i).alias("b")))
    length = haversine(x1, y1, x2, y2)
    pieces = segments.select("x1", "y1", "x2", "y2", length.alias("_m"), cuts.alias("_cuts")).withColumn("_s", F.explode(spans))
    half = (F.col("_s.a") + F.col("_s.b")) / 2
    x, y = grid_cell(x1 + (x2 - x1) * half, y1 + (y2 - y1) * half, step)
    return pieces.groupBy(x.alias("cx"), y.alias("cy")).agg(F.sum(F.col("_m") * (F.col("_s.b") - F.col("_s.a"))).alias("metres"))


def assign_or_nearest(points: DataFrame, edges: DataFrame, step: float) -> DataFrame:
    """Each distinct location with the first area that contains it, or else the one with the nearest edge.

    `way` is `inside` or `nearest`; equally near areas (in whole millimetres) go to the smallest id.
    """
    places = points.select("lon", "lat").distinct()
    inside = materialize(assign_areas(places, edges, step))
    outside = materialize(places.join(inside, ["lon", "lat"], "left_anti"))
    fallback = nearest_line(outside, edges, keep="area").select("lon", "lat", "area", F.lit("nearest").alias("way"), "distance_m")
    return inside.select("lon", "lat", "area", F.lit("inside").alias("way"), F.lit(0.0).alias("distance_m")).unionByName(fallback)
