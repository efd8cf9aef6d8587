"""Groups of points with a bounded diameter, and the exact spread of a set of locations.

Grouping is complete linkage: two groups are as far apart as their farthest pair, and the closest
two merge as long as that is within the limit. In a round every two groups that are each other's
closest merge at once. A group meets the others of its cell and the eight around it in one task, as
the corners of its hull, which alone can be farthest; no list of pairs is kept or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.operators.geo import EARTH_M, _max_lat, _steps, haversine
from mastwire.session import materialize

#: A task compares the groups of this many places, squared, with all around them; a cell with more is dealt to several.
PARTS = 64
#: Bits of a point's name that come from the hash of its key.
HASH_BITS = 48
#: Distances, or pairs of names, that a task holds at a time.
CELLS = 1 << 20
CORNERS = "array<struct<lon:double,lat:double>>"
_CORNERS = pa.list_(pa.field("element", pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))


def _named(points: DataFrame, key: str) -> DataFrame:
    """Points with a name: a hash of the key (48 bits) in no spatial order; points of one hash are told apart by the bits above."""
    twin = F.row_number().over(Window.partitionBy("h").orderBy(key, "lon", "lat")) - 1
    named = points.select(key, "lon", "lat", _words(F.col(key)).cast("long").alias("h"))
    return named.select(key, "lon", "lat", (F.col("h") + F.shiftleft(twin.cast("long"), HASH_BITS)).alias("name"))


def _least_xor(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each number the least XOR with another of the sorted ones, of which it is one: bit by bit, without pairs."""
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(held))
    base, own = np.zeros(len(asked), np.int64), np.ones(len(asked), bool)
    for bit in range(62, -1, -1):
        middle = np.clip(np.searchsorted(held, base + (1 << bit)), low, high)
        one = (asked >> bit & 1).astype(bool)
        stays = np.where(one, high - middle, middle - low) - own > 0
        up = one == stays
        own &= stays
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        base += up.astype(np.int64) << bit
    return asked ^ base


def _least_in(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if len(held) * len(asked) > CELLS:
        return _least_xor(np.sort(held), asked)
    mixed = asked[:, None] ^ held
    mixed[mixed == 0] = np.iinfo(np.int64).max
    return mixed.min(axis=1)


def _closest_of(own: np.ndarray, name: np.ndarray, corner: np.ndarray, lon: np.ndarray, lat: np.ndarray, limit_m: float, step_m: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rank): the rows that are the task's own and have a group within the limit, and the closest one's name XOR their own.

    ``corner`` says where the corners of a row begin. Groups of one place that is the same are one stack of names, so copies cost no distances.
    """
    size = np.diff(corner)
    lone = np.where(size > 1, np.arange(len(name)), -1)
    order = np.lexsort((name, lat[corner[:-1]], lon[corner[:-1]], lone, ~own))
    key = np.stack((~own, lone, lon[corner[:-1]], lat[corner[:-1]]))[:, order]
    stack = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
    held = np.diff(stack, append=len(name))
    name, first = name[order], order[stack]
    wide = size[first]
    ends = np.cumsum(wide)
    at = np.arange(ends[-1]) + np.repeat(corner[first] - ends + wide, wide)
    x, y = np.radians(lon[at]), np.radians(lat[at])
    cos, starts = np.cos(y), ends - wide
    mine = int(np.count_nonzero(own[first]))
    rank = np.full(len(name), -1, np.int64)
    begin = 0
    while begin < mine:
        end = max(begin + 1, int(np.searchsorted(ends[:mine], starts[begin] + max(CELLS // len(x), 1), side="right")))
        a = slice(starts[begin], ends[end - 1])
        h = np.sin((y[a, None] - y) / 2) ** 2 + cos[a, None] * cos * np.sin((x[a, None] - x) / 2) ** 2
        h = np.maximum.reduceat(np.maximum.reduceat(h, starts, axis=1), starts[begin:end] - starts[begin], axis=0)
        gap = np.round(2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))), 3)
        steps = np.where(gap <= limit_m, np.floor(gap / step_m), np.inf)
        steps[np.arange(end - begin), np.arange(begin, end)] = np.where(held[begin:end] > 1, 0.0, np.inf)
        best = steps.min(axis=1)
        tied = (steps == best[:, None]) & np.isfinite(best)[:, None]
        for i in begin + np.flatnonzero(held[begin:end] > 1):
            near = np.concatenate([name[stack[j] : stack[j] + held[j]] for j in np.flatnonzero(tied[i - begin])])
            rank[stack[i] : stack[i] + held[i]] = _least_in(near, name[stack[i] : stack[i] + held[i]])
        tied[held[begin:end] > 1] = False
        i, j = np.nonzero(tied)
        if len(i):
            count = held[j]
            upto = np.cumsum(count)
            near = name[np.arange(upto[-1]) + np.repeat(stack[j] - upto + count, count)]
            asks = np.repeat(i, count)
            new = np.flatnonzero(np.diff(asks, prepend=-1))
            rank[stack[begin + asks[new]]] = np.minimum.reduceat(near ^ name[stack[begin + asks]], new)
        begin = end
    found = np.flatnonzero(rank >= 0)
    return order[found], rank[found]


def _with_closest(groups: DataFrame, crowd: DataFrame, limit_m: float, step_m: float) -> DataFrame:
    """Groups that have another within the limit, with ``rank``: the name of the closest one XOR their own."""
    around = F.array(*[F.struct((F.col("cx") + i).alias("tx"), (F.col("cy") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = groups.withColumn("_t", F.explode(around)).select("*", "_t.*").drop("_t").join(F.broadcast(crowd), ["tx", "ty"], "left")
    # The groups of a crowded cell are dealt by place; each of its tasks sees all of them.
    part = F.pmod(F.xxhash64(F.col("corners")[0]), F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    sent = sent.withColumn("own", (F.col("tx") == F.col("cx")) & (F.col("ty") == F.col("cy")) & (F.col("part") == part)).drop("parts")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own, name = rows["own"].to_numpy(), rows["name"].to_numpy()
        kept, rank = np.empty(0, np.int64), np.empty(0, np.int64)
        if own.any():
            lists = rows["corners"].chunk(0)
            corner, places = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            kept, rank = _closest_of(own, name, corner - corner[0], *(places.field(c).to_numpy() for c in ("lon", "lat")), limit_m, step_m)
        taken = rows.select(["name", "cx", "cy", "corners"]).take(pa.array(kept))
        return taken.set_column(3, "corners", taken["corners"].cast(_CORNERS)).append_column("rank", pa.array(rank))

    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(tasks, "tx", "ty", "part")
    return dealt.groupBy("tx", "ty", "part").applyInArrow(run, f"name long, cx long, cy long, corners {CORNERS}, rank long")


def _joined(found: DataFrame) -> DataFrame:
    """One row for two groups that are each other's closest, with the name that is ``gone``; the others as they were."""
    other = F.col("name").bitwiseXOR(F.col("rank"))
    pairs = found.groupBy(F.least("name", other).alias("into"), F.greatest("name", other).alias("out")).agg(
        F.count("*").alias("n"), F.min("name").alias("name"), F.max("name").alias("gone"), F.collect_list(F.struct("cx", "cy", "corners")).alias("of"))
    both = pairs.select("name", F.when(F.col("n") == 2, F.col("gone")).alias("gone"), F.col("of")[0]["cx"].alias("cx"), F.col("of")[0]["cy"].alias("cy"),
                        F.array_distinct(F.flatten(F.col("of.corners"))).alias("corners"))

    def cut(batches):
        for batch in filter(len, batches):
            lists = batch.column(4)
            ends, places = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten()
            lon, lat = (places.field(c).to_numpy() for c in ("lon", "lat"))
            joined = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) > 6)
            kept = np.ones(len(lon), bool)
            for i in np.flatnonzero(joined):
                s = slice(ends[i], ends[i + 1])
                kept[s] = False
                kept[ends[i] + hull(lon[s], lat[s])] = True
            offsets = np.concatenate(([0], np.cumsum(kept)))[ends].astype(np.int32)
            corners = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lon[kept]), pa.array(lat[kept])], ["lon", "lat"]), _CORNERS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], corners], names=batch.schema.names)

    return both.mapInArrow(cut, f"name long, gone long, cx long, cy long, corners {CORNERS}")


def _merged(named: DataFrame, limit_m: float, step_m: float) -> DataFrame:
    """(name, group) by complete linkage, for the points that have joined another one's group."""
    side_x, side_y = _steps(limit_m, _max_lat(named))
    cells = {"cx": F.floor(F.col("lon") / side_x).cast("long"), "cy": F.floor(F.col("lat") / side_y).cast("long")}
    placed = materialize(named.select("name", "lon", "lat").withColumns(cells))
    held = placed.select("cx", "cy", "lon", "lat").distinct().groupBy("cx", "cy").agg(F.count("*").alias("held")).where(F.col("held") > PARTS * PARTS)
    crowd = materialize(held.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.ceil(F.col("held") / (PARTS * PARTS)).cast("int").alias("parts")))
    groups = placed.select("name", "cx", "cy", F.array(F.struct("lon", "lat")).alias("corners"))
    gone, rounds = None, 0
    while True:
        state = materialize(_joined(_with_closest(groups, crowd, limit_m, step_m)))
        new = state.where("gone IS NOT NULL").select(F.col("gone").alias("name"), F.col("name").alias("group"))
        if new.isEmpty():
            break
        gone, rounds = new if gone is None else gone.unionByName(new), rounds + 1
        groups = state.select("name", "cx", "cy", "corners")
    if gone is None:
        return placed.select("name", F.col("name").alias("group")).limit(0)
    labels = materialize(gone)
    # A name is gone once, into one that may be gone later: each join doubles how far a label has come.
    for _ in range((rounds - 1).bit_length()):
        later = labels.select(F.col("name").alias("group"), F.col("group").alias("later"))
        labels = materialize(labels.join(later, "group", "left").select("name", F.coalesce("later", "group").alias("group")))
    return labels


def _words(key: Column) -> Column:
    """A number of 48 bits from a key's MD5; sums of them name a set whatever its order."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")


def bounded_groups(points: DataFrame, key: str, limit_m: float, step_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Complete-linkage groups of points: (key, lon, lat, group_id), and one row for each group.

    The closest groups merge first, compared in steps of ``step_m`` (a fiftieth of the limit where not
    given: a metre for 50 m). On a regular grid exact distances grow along its rows by a hair and
    would make each merge wait for the one before; equal steps let them happen together. Of equally
    close groups the mix of both names decides, which no chain of neighbours follows. A name is a hash
    of a point's key, a group has the least name of its points.

    A group row holds members, locations, the medoid's key and coordinates (the observed point
    with the least sum of distances to all members, ties to the smallest key) and the diameter.
    Its id is a hash of its members. Copies of a location are members of their own, but distances are
    computed between locations only. However crowded a cell is, all its locations are compared.
    Points without coordinates are left out.
    """
    points = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    named = materialize(_named(points, key))
    labels = _merged(named, limit_m, step_m or limit_m / 50)
    members = materialize(named.join(labels, "name", "left").select(key, "lon", "lat", F.coalesce("group", "name").alias("group")))
    placed = materialize(members.groupBy("group", "lon", "lat").agg(
        F.min(key).alias("first"), F.count("*").alias("rows"), F.sum(_words(F.col(key))).alias("words")))

    centres = placed.select("group", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("rows").alias("weight"))
    gap = haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    reached = placed.join(centres, "group").select("group", "lon", "lat", "first", "weight", gap.alias("gap")).groupBy("group", "lon", "lat", "first").agg(
        F.round(F.sum(F.col("gap") * F.col("weight")), 3).alias("_sum"), F.max("gap").alias("_far"))
    shape = reached.groupBy("group").agg(
        F.max("_far").alias("diameter_m"), F.min(F.struct("_sum", "first", "lon", "lat")).alias("medoid"))
    totals = placed.groupBy("group").agg(
        F.min("first").alias("_least"), F.sum("rows").alias("members"), F.count("*").alias("locations"), F.sum("words").alias("_words"))
    group_id = F.substring(F.sha2(F.concat_ws(":", F.col("_least").cast("string"), F.col("members").cast("string"), F.col("_words").cast("string")), 256), 1, 16)
    groups = materialize(totals.join(shape, "group").select(
        "group", group_id.alias("group_id"), "members", "locations", F.col("medoid.first").alias(f"medoid_{key}"),
        F.col("medoid.lon").alias("lon"), F.col("medoid.lat").alias("lat"), "diameter_m"))
    return members.join(groups.select("group", "group_id"), "group").drop("group"), groups.drop("group")


# --- Spread --------------------------------------------------------------------------------


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.column_stack((np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)))


def hull(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Indexes of the corners of the spherical hull; all, where the points do not fit in half a hemisphere.

    Great circles are straight in the gnomonic projection, so the plane's hull is the sphere's.
    """
    v = _unit(lon, lat)
    centre = v.mean(axis=0)
    norm = np.linalg.norm(centre)
    if len(lon) <= 3 or norm < 1e-9 or (v @ (centre / norm)).min() < 0.71:
        return np.arange(len(lon))
    centre /= norm
    east = np.cross([0.0, 0.0, 1.0] if abs(centre[2]) < 0.9 else [1.0, 0.0, 0.0], centre)
    east /= np.linalg.norm(east)
    depth = v @ centre
    x, y = v @ east / depth, v @ np.cross(centre, east) / depth
    at = np.arange(len(x))
    if len(x) > 64:
        # Points inside the octagon of the extreme ones are no corners.
        turns = np.arange(8) * np.pi / 4
        tips = np.unique([np.argmax(x * np.cos(t) + y * np.sin(t)) for t in turns])
        tips = tips[np.argsort(np.arctan2(y[tips] - y[tips].mean(), x[tips] - x[tips].mean()))]
        inside = np.ones(len(x), dtype=bool)
        for a, b in zip(tips, np.roll(tips, -1), strict=True):
            inside &= (x[b] - x[a]) * (y - y[a]) - (y[b] - y[a]) * (x - x[a]) > 0
        at = at[~inside]
    at = at[np.lexsort((y[at], x[at]))]

    def chain(order):
        out: list[int] = []
        for i in order:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    return np.unique(chain(at) + chain(at[::-1]))


def farthest(lon: np.ndarray, lat: np.ndarray) -> float:
    """Longest great-circle distance between two of the points, in blocks of rows."""
    best, x, y = 0.0, np.radians(lon), np.radians(lat)
    for start in range(0, len(x), 512):
        a, b = x[start : start + 512, None], y[start : start + 512, None]
        h = np.sin((y - b) / 2) ** 2 + np.cos(b) * np.cos(y) * np.sin((x - a) / 2) ** 2
        best = max(best, float(2 * EARTH_M * np.arcsin(np.sqrt(min(h.max(), 1.0)))))
    return best


def location_spread(df: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Distinct locations of an identity and the distance of its farthest pair, without listing pairs.

    Only corners of the hull can be farthest. Hulls merge: each batch of a task sends on its own
    corners, they meet in ``salts`` parts of an identity, then in one, so an identity with a
    third of all rows leaves a few corners a batch. Identities wider than a quarter of the globe keep
    all their distinct locations. Rows without coordinates are left out.
    """
    places = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(*keys, "lon", "lat").agg(F.lit(1).cast("long").alias("locations"))
    schema = places.schema

    def runs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        codes = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        return order, np.flatnonzero(np.diff(codes[order], prepend=-1, append=len(codes)))

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        order, bounds = runs(rows)
        lon, lat, n = (rows[c].to_numpy() for c in ("lon", "lat", "locations"))
        kept, held = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[a:b]
            own = at if b - a <= 3 else at[hull(lon[at], lat[at])]
            kept.append(own)
            held.append(np.concatenate(([n[at].sum()], np.zeros(len(own) - 1, dtype=np.int64))))
        return rows.iloc[np.concatenate(kept)].assign(locations=np.concatenate(held))

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield corners(rows[names])

    def spreads(rows: pd.DataFrame) -> pd.DataFrame:
        order, bounds = runs(rows)
        lon, lat = rows["lon"].to_numpy()[order], rows["lat"].to_numpy()[order]
        far = [farthest(lon[a:b], lat[a:b]) if b - a > 1 else 0.0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        held = np.add.reduceat(rows["locations"].to_numpy()[order], bounds[:-1])
        return rows.iloc[order[bounds[:-1]]][keys].assign(locations=held, spread_m=far)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by identity; the last one of a batch waits for its further rows, as corners."""
        waiting = None
        for rows in batches:
            if not len(rows):
                continue
            rows = corners(rows if waiting is None else pd.concat([waiting, rows]))
            order, bounds = runs(rows)
            waiting, rows = rows.iloc[order[bounds[-2] :]], rows.iloc[order[: bounds[-2]]]
            if len(rows):
                yield spreads(rows)
        if waiting is not None:
            yield spreads(waiting)

    names = [f.name for f in schema]
    part = F.pmod(F.xxhash64("lon", "lat"), F.lit(salts)).alias("part")
    partial = places.mapInPandas(partly, schema).select("*", part).repartition(*keys, "part").mapInPandas(partly, schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keys)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(measured, fields + ", locations long, spread_m double")


def conflicting_locations(df: DataFrame, keys: list[str], limit_m: float) -> DataFrame:
    """Whether an identity's locations are farther apart than the limit."""
    return location_spread(df, keys).withColumn("verdict", F.when(F.col("spread_m") > limit_m, "conflict").otherwise("agree"))


def reviewed_locations(alternatives: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """One decision for each identity with several alternatives: the one to prefer in a review, or none.

    An alternative (lon, lat, verified, first_seen, last_seen and its number ``alternative``) is preferred
    when it is the only verified one, every alternative's times are plausible (first not after last, last not
    after ``as_of``) and none was seen later.
    """
    sound = F.coalesce((F.col("first_seen") <= F.col("last_seen")) & (F.col("last_seen") <= as_of), F.lit(False))
    verified = F.coalesce(F.col("verified"), F.lit(False))
    out = alternatives.groupBy(*keys).agg(
        F.count("*").alias("alternatives"), F.count_if(verified).alias("verified"), F.bool_and(sound).alias("_sound"),
        F.max("last_seen").alias("_last"), F.max(F.when(verified, F.col("last_seen"))).alias("_verified_last"),
        F.max(F.when(verified, F.col("alternative"))).alias("_alternative"),
    ).where(F.col("alternatives") > 1)
    preferred = F.col("_sound") & (F.col("verified") == 1) & (F.col("_verified_last") >= F.col("_last"))
    out = out.withColumn("status", F.when(preferred, "preferred_for_review").otherwise("unresolved")).withColumn(
        "preferred_alternative", F.when(preferred, F.col("_alternative")))
    return out.join(location_spread(alternatives, keys).select(*keys, "spread_m"), keys, "left").drop("_sound", "_last", "_verified_last", "_alternative")


def chain_audit(members: DataFrame, component: str, limit_m: float) -> DataFrame:
    """Points, diameter and whether a chain of near points has grown beyond the limit, for each component."""
    size = members.groupBy(component).agg(F.count("*").alias("points"))
    return size.join(location_spread(members, [component]), component).withColumn("exceeds", F.col("spread_m") > limit_m)
