"""The network of each radio by the best evidence there is, with the evidence named."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.operators.geo import nearest
from mastwire.session import materialize

# Region codes and radio channels that only one network uses.
LOW_REGIONS = ("0", "1", "2", "3", "4", "5", "6", "8", "10", "14")
EXCLUSIVE_CHANNELS = (1400,)


@dataclass(frozen=True)
class NetworkRules:
    """Networks by code, the one that a confirmed import belongs to, what only one of them uses, and the rest."""

    codes: dict[str, str]
    confirmed: str
    regions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    channels: dict[str, tuple[int, ...]] = field(default_factory=dict)
    default: str = ""
    within_m: float = 100.0


def _first(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, name in reversed(pairs):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def attributed(radios: DataFrame, rules: NetworkRules) -> DataFrame:
    """Every row with `network`, `method` and the network's own code in `mnc`.

    The first evidence that says something decides: `confirmed` import, network stated by the
    `source_record`, `code`, a `nearby_site` within ``within_m`` of one network and nearer than any other's,
    `region` code, `channel`, and `default` for the rest, so the rows per method add up to the input.
    Only places of rows that are still open search for a neighbour, once for each network, among the distinct
    places whose network is stated or coded; a place that is equally near to two networks stays open.

    Needs lon, lat, mnc, stated, region_id (strings), channels (array of int) and confirmed.
    """
    names = list(dict.fromkeys(rules.codes.values()))
    stated = F.when(F.col("stated").isin(*names), F.col("stated"))
    coded = _first([(F.col("mnc") == code, name) for code, name in rules.codes.items()])
    rows = radios.withColumns({"_stated": stated, "_coded": coded, "_sure": F.coalesce("confirmed", F.lit(False))}).withColumn(
        "_open", F.expr("NOT _sure AND _stated IS NULL AND _coded IS NULL AND lon IS NOT NULL AND lat IS NOT NULL"))
    # Places are kept, not rows: which are open, and for which networks their rows speak.
    # A row can speak for two networks, one stated and one coded.
    says = [F.coalesce((F.col("_stated") == name) | (F.col("_coded") == name), F.lit(False)) for name in names]
    spots = materialize(rows.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("lon", "lat").agg(
        F.bool_or("_open").alias("_open"), *[F.bool_or(c).alias(f"_own{i}") for i, c in enumerate(says)]))
    places = spots.where("_open").select("lon", "lat")
    found = places
    for i in range(len(names)):
        hit = nearest(places, spots.where(f"_own{i}").select("lon", "lat"), within_m=rules.within_m)
        found = found.join(hit.withColumnRenamed("distance_m", f"_d{i}"), ["lon", "lat"], "left")
    gaps = [F.when(F.col(f"_d{i}") < rules.within_m, F.col(f"_d{i}")) for i in range(len(names))]
    low = F.array_min(F.array(*gaps))
    alone = F.size(F.filter(F.array(*gaps), lambda d: d == low)) == 1
    beside = F.when(low.isNotNull() & alone, _first([(g == low, n) for g, n in zip(gaps, names, strict=True)]))
    found = found.select("lon", "lat", beside.alias("_beside")).where("_beside IS NOT NULL")
    # The other rows are decided without a neighbour and are not shuffled.
    sided = rows.where("_open").join(found, ["lon", "lat"], "left")
    rows = sided.unionByName(rows.where("NOT _open").withColumn("_beside", F.lit(None).cast("string")))

    region = _first([(F.trim("region_id").isin(*codes), name) for name, codes in rules.regions.items()])
    channel = _first([(F.arrays_overlap("channels", F.array(*[F.lit(c) for c in listed])), name) for name, listed in rules.channels.items()])
    evidence = {
        "confirmed": F.when(F.col("_sure"), F.lit(rules.confirmed)), "source_record": F.col("_stated"), "code": F.col("_coded"),
        "nearby_site": F.col("_beside"), "region": region, "channel": channel, "default": F.lit(rules.default),
    }
    code = _first([(F.col("network") == name, c) for c, name in rules.codes.items()])
    return (rows.withColumns({"network": F.coalesce(*evidence.values()), "method": F.coalesce(*[F.when(c.isNotNull(), m) for m, c in evidence.items()])})
            .withColumn("mnc", code).drop("_stated", "_coded", "_sure", "_open", "_beside"))
