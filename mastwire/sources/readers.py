"""Readers: explicit schemas, opaque ids, and forgiving casts that never stop a job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mastwire.functions.calendar import parse_date
from mastwire.operators.subscribers import MONTHS, export_schema

# Raw telemetry headers and the KPI they carry.
KPI_HEADERS = {
    "RRC Setup Success Rate": "rrc_setup_sr",
    "E-RAB Establishment Success Rate": "erab_estab_sr",
    "E-RAB Drop Rate": "erab_drop_rate",
    "Handover Success Rate ( 4G Intra System)": "handover_intra_sr",
    "Handover Success Rate": "handover_sr",
    "4G Cell Av. (%)": "availability_pct",
    "E-UTRAN IP Throughput UE DL": "dl_throughput_mbps",
    "E-UTRAN IP Throughput UE UL": "ul_throughput_mbps",
    "Avg RRC Connected users": "connected_users",
    "pmCellDowntimeMan": "downtime_sec",
}
# The columns of a public cell export, in file order.
CELL_COLUMNS = (
    "radio mcc net area cell unit lon lat range samples changeable created updated averageSignal"
).split()


def read_subscribers(spark: SparkSession, path: str, months=MONTHS, labeled: bool = True) -> DataFrame:
    """The subscriber export by header; ids stay text, so leading zeros and "NA" survive.

    Columns outside the contract are ignored and only contract columns are parsed.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000")
    out = []
    for field in export_schema(months, labeled):
        if field.name not in raw.columns:
            continue
        text = F.when(F.trim(F.col(f"`{field.name}`")) != "", F.col(f"`{field.name}`"))
        out.append((text if isinstance(field.dataType, T.StringType) else text.try_cast("double")).alias(field.name))
    return raw.select(*out)


def number(text: Column) -> Column:
    """A number written with thousands commas, quotes or spaces; anything else is missing."""
    return F.trim(F.regexp_replace(text, '[",]', "")).try_cast("double")


def map_headers(headers: list[str], wanted: dict[str, str] = KPI_HEADERS) -> dict[str, str]:
    """Raw header to KPI: an exact match (any case) first, then a contained name, each header once."""
    found: dict[str, str] = {}
    taken: set[str] = set()
    for fits in (lambda h, name: h == name, lambda h, name: name in h):
        for name, key in wanted.items():
            if key in taken:
                continue
            for header in headers:
                clean = header.strip().strip('"').strip().lower()
                if header not in found and fits(clean, name.lower()):
                    found[header] = key
                    taken.add(key)
                    break
    return found


def read_kpis(spark: SparkSession, path: str, name_column: str | None = None) -> DataFrame:
    """Daily KPI files with vendor headers, as date, optional entity name and KPI doubles."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
    dates = [c for c in raw.columns if "date" in c.lower()]
    if not dates:
        raise ValueError("No date column among the headers.")
    date = parse_date(F.trim(F.col(f"`{dates[0]}`")), "M/d/yy", "yyyy-MM-dd", "M/d/yyyy")
    columns = [date.alias("date")]
    if name_column:
        columns.append(F.trim(F.col(f"`{name_column}`")).alias("name"))
    columns += [number(F.col(f"`{h}`")).alias(k) for h, k in map_headers(raw.columns).items()]
    return raw.select(*columns)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A cell export with or without a header line: text first, then numbers where they parse."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CELL_COLUMNS])
    raw = spark.read.csv(path, header=False, schema=schema).where(F.lower(F.trim("radio")) != "radio")
    return raw.select(
        F.upper(F.trim("radio")).alias("radio"), *[F.trim(F.col(c)).try_cast("double").alias(c) for c in CELL_COLUMNS[1:]]
    )


def read_with_provenance(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every file of a folder, each row with the file it came from."""
    raw = spark.read.csv(path, header=True, inferSchema=False, **options)
    return raw.select("*", F.col("_metadata.file_name").alias("source_file"))


RADIO_PAYLOAD = (
    "channels array<int>, bandNumbers array<int>, bandwidths array<double>, visible boolean, "
    "firstSeenMs bigint, lastSeenMs bigint, attributes map<string,string>"
)


def read_radio_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw radio records as JSON lines; lists stay lists and are cleaned of impossible entries."""
    raw = spark.read.text(path).select(
        F.from_json("value", f"rat string, region_id string, site_id string, mcc string, mnc string, latitude double, longitude double, {RADIO_PAYLOAD}").alias("r")
    )
    has = lambda part: F.exists(F.map_keys("attributes"), lambda k: k.contains(part))
    return raw.select("r.*").withColumns(
        {
            "channels": F.filter("channels", lambda c: c > 0),
            "bands": F.filter("bandNumbers", lambda b: b > 0),
            "has_timing_advance": F.coalesce(has("LOC_TA"), F.lit(False)),
        }
    ).drop("bandNumbers")


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Building outlines from JSON lines (plain or gzipped): one row for each polygon of a building.

    part counts a building's polygons from 0; ring is the outer ring, holes are the inner ones,
    and (lon, lat) is the ring's mean point. Other geometries have no outline and give no row.
    """
    rows = spark.read.schema("id string, geometry struct<type:string, coordinates:string>").json(path)
    polygon, text = "array<array<array<double>>>", F.col("geometry.coordinates")
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, polygon))).when(
        F.col("geometry.type") == "MultiPolygon", F.from_json(text, f"array<{polygon}>")
    )
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rows = rows.select("id", F.posexplode(polygons).alias("part", "rings")).where(F.size("rings") > 0)
    rows = rows.select(
        "id", "part", points(F.col("rings")[0]).alias("ring"),
        F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), points).alias("holes"),
    )
    mean = lambda f: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[f]) / F.size("ring")
    return rows.withColumns({"lon": mean("lon"), "lat": mean("lat")})


def source_checks(spark: SparkSession, folder: str, lock: DataFrame) -> DataFrame:
    """Every declared file against its recorded SHA-256: ok, changed, missing or undeclared.

    The lock has file (its path below the folder), sha256, group and required. Files are hashed
    where they are read, and files of one name in different folders are different files.
    """
    below = rf"\Q{folder.rstrip('/').removeprefix('file://')}\E/+(.*)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.regexp_extract("path", below, 1).alias("file"), F.sha2("content", 256).alias("found")
    )
    state = (
        F.when(F.col("sha256").isNull(), "undeclared").when(F.col("found").isNull(), "missing")
        .when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    )
    return lock.join(files, "file", "full").withColumn("state", state)


def require_sources(checks: DataFrame) -> list[str]:
    """Refuse when a required file is missing or changed; return the optional groups to disable."""
    bad = checks.where(F.col("state").isin("missing", "changed")).select("file", "state", "group", "required").collect()
    refused = [f"{r['file']}: {r['state']}" for r in bad if r["required"]]
    if refused:
        raise ValueError("Required inputs do not match their lock: " + ", ".join(sorted(refused)))
    return sorted({r["group"] for r in bad})


def profile(df: DataFrame, columns: list[str], date: str | None = None) -> DataFrame:
    """Per numeric column: rows, missing share, quartiles and spread; exact at any size."""
    from mastwire.operators.ordered import quantiles_by

    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    stats = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.avg(F.col("value").isNull().cast("double")).alias("missing_share"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    probs = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
    out = stats.join(quantiles_by(long, ["column"], "value", probs), "column", "left")
    if date is None:
        return out
    span = df.agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    return out.withColumns({c: span.select(c).scalar() for c in ("first_day", "last_day")})


def safe_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")
