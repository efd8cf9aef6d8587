"""Stable hashes: lotteries, pseudonyms, candidate ids and snapshot fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SALT = 16


def lottery(identity: Column, seed) -> Column:
    """A number in [0, 1) that depends only on the seed and the id, not on row order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), identity), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0


def pseudonym(identity: Column, salt: str) -> Column:
    if len(salt) < MIN_SALT:
        raise ValueError(f"The salt must have at least {MIN_SALT} characters.")
    return F.sha2(F.concat(F.lit(salt), identity), 256)


def candidate_id(lat: Column, lon: Column, source: Column) -> Column:
    text = F.format_string("%.6f|%.6f|%s", lat, lon, source)
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(text, 256), 1, 12))


def row_hash(*columns: Column, key: str = "") -> Column:
    """One hash per row under a key. Each value stands after its length, and a missing one has none,
    so no value can be read as another, as two, or as missing."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(F.lit(f"{key}|"), *parts), 256)
