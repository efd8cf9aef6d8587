"""Writers for stage results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """Training frames by split, so reading one split reads only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def feature_lines(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON point feature per row, as text lines."""
    properties = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")
    )
    return df.select(F.to_json(feature).alias("value"))


def series_documents(df: DataFrame, keys: list[str], date: str, values: dict[str, Column]) -> DataFrame:
    """One JSON document per series with its records in date order; a series has one row per day."""
    record = F.struct(F.date_format(date, "yyyy-MM-dd").alias("date"), *[c.alias(n) for n, c in values.items()])
    data = F.sort_array(F.collect_list(record)).alias("data")
    return df.groupBy(*keys).agg(data).select(*keys, F.to_json(F.struct(*keys, "data")).alias("document"))
