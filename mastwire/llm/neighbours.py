"""Nearest vectors by inner product through cross-polytope hashing.

Directions are hashed, so one long vector does not crowd the others. Each table turns the sphere
by three signed Hadamard transforms and files a vector under its nearest signed axis; a query
looks under its several nearest axes. Vectors much longer than most win at wide angles, which
hashing misses: these are at most a tenth and every query meets all of them. What a query meets
is scored exactly, block by block, and only a block's best leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mastwire.llm.store import saved

TABLES = 8
PROBES = 24
#: Vectors of one bucket that one task compares with as many queries.
BLOCK = 4096
TIE = 1e-9
#: Vectors longer than this quantile of the norms by more than the margin are compared with every query.
LONG = 0.9
MARGIN = 1.05


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def width(dimension: int) -> int:
    """Axes of a table: the power of two that holds one dimension more."""
    return 1 << int(dimension).bit_length()


def turned(vectors: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of every row."""
    signs = np.random.default_rng([20, table]).choice([-1.0, 1.0], size=(3, vectors.shape[1]))
    for s in signs:
        vectors = _hadamard(vectors * s)
    return vectors


def directions(vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vectors), width(vectors.shape[1])))
    out[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return out


def axes(turned_: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest signed axes of every row: 2 i for the positive and 2 i + 1 for the negative one."""
    both = np.stack((turned_, -turned_), axis=2).reshape(len(turned_), -1)
    n = min(n, both.shape[1])
    if n == 1:
        return both.argmax(axis=1)[:, None]
    return np.argpartition(-both, n - 1, axis=1)[:, :n]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, kind, norm, vec) of the rows that take part; kind is the same for equal vectors."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    rows = rows.where(F.size("x") == (most.d if most else 0))

    def run(batches):
        for batch in filter(len, batches):
            lists = batch.column(1)
            x = lists.flatten().to_numpy().reshape(len(batch), -1) + 0.0  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.linalg.norm(x, axis=1))],
                names=["vec_id", "vec", "norm"])

    packed = rows.mapInArrow(run, "vec_id long, vec binary, norm double")
    return packed.withColumn("kind", F.xxhash64("vec"))


def _filed(kinds: DataFrame, tables: int, probes: int, with_vectors: bool) -> DataFrame:
    """Rows (table, axis, asks, kind, least, vec): every vector once a table, a query under each of its axes.

    The long vectors and every query stand once in one more table, under one axis.
    """

    def run(batches):
        for batch in filter(len, batches):
            all_ = directions(_matrix(batch.column("vec")))
            asks, far = (np.flatnonzero(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "long"))
            near = np.setdiff1d(np.arange(len(all_)), far)
            for t in range(tables + 1):
                if t < tables:
                    turned_ = turned(all_, t)
                    held, own = near, axes(turned_[near], 1)[:, 0]
                    looked = axes(turned_[asks], probes)
                else:
                    held, own, looked = far, np.zeros(len(far), np.int64), np.zeros((len(asks), 1), np.int64)
                row = np.concatenate((held, np.repeat(asks, looked.shape[1])))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), t, np.int32)), pa.array(np.concatenate((own, looked.ravel())).astype(np.int32)),
                     pa.array(np.arange(len(row)) >= len(held)), taken.column("kind"), taken.column("least"),
                     taken.column("vec") if with_vectors else pa.nulls(len(row), pa.binary())],
                    names=["table", "axis", "asks", "kind", "least", "vec"])

    return kinds.select("kind", "least", "asks", "vec", "long").mapInArrow(
        run, "table int, axis int, asks boolean, kind long, least long, vec binary")


def best_in_block(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
    """(query, vector, score): each query's k best, ties to the smaller ``least``; scores summed alike in every block."""
    rough = queries @ vectors.T
    k = min(k, len(vectors))
    floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    q, v = np.nonzero(rough >= (floor - TIE * np.maximum(1.0, np.abs(floor)))[:, None])
    score = (queries[q] * vectors[v]).sum(axis=1)
    order = np.lexsort((least[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], score[place < k]


def _scored(met: DataFrame, k: int) -> DataFrame:
    """(query, kind, least, score) from groups of a block of vectors and a block of queries."""

    def run(key, block):
        asks = block.column("asks").to_numpy()
        kind, least = block.column("kind").to_numpy(), block.column("least").to_numpy()
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(q) and len(v):
            vec = _matrix(block.column("vec"))
            i, j, score = best_in_block(vec[q], vec[v], least[v], k)
            i, j = q[i], v[j]
        else:
            i = j = np.empty(0, np.int64)
            score = np.empty(0)
        return pa.table({"query": kind[i], "kind": kind[j], "least": least[j], "score": score})

    return met.groupBy("table", "axis", "block", "query_block").applyInArrow(
        run, "query long, kind long, least long, score double")


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Buckets cut to blocks: a vector goes to its block for every block of queries, a query the other way."""
    rows = rows.join(F.broadcast(sizes), ["table", "axis"])
    own = lambda n: F.pmod(F.xxhash64("kind"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    return rows.withColumn("block", F.explode(F.when(F.col("asks"), every("blocks")).otherwise(F.array(own("blocks"))))).withColumn(
        "query_block", F.explode(F.when(F.col("asks"), F.array(own("query_blocks"))).otherwise(every("query_blocks"))))


def _first_of_kind(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest vec_id of every kind: first in lots of it, then over the lots, so no lot is large."""
    lots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("kind", "vec_id").distinct().withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(lots)))
    for by in (["kind", "lot"], ["kind"]):
        dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k)
    return dealt.select("kind", "vec_id")


def _lists(scored: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query, nearest): for each asked kind the k best (score, vec_id), by its k best kinds and their members."""
    once = scored.groupBy("query", "kind").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    best = once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("place") <= k)
    rows = best.join(members, "kind").withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)
    return rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("nearest"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: int = PROBES,
            id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides.

    Vectors that are null, zero, of another length than most, or hold a null or non-finite
    component take no part, nor do rows without an id; repeated rows are one. Equal vectors are
    searched once and told apart at the end, by id. A query that meets fewer than k in its
    buckets is compared with all vectors, in blocks. Other columns are not read.
    """
    spark = vectors.sparkSession
    usable = saved(_usable(vectors, id_column, column))
    kinds = saved(usable.groupBy("kind").agg(
        F.min("vec_id").alias("least"), F.max(F.col("vec_id") % every == 0).alias("asks"), F.first("vec").alias("vec"), F.first("norm").alias("norm")))
    usual = kinds.agg(F.percentile_approx("norm", LONG, 1000)).first()[0] or 1.0
    filed = kinds.withColumn("long", F.col("norm") > usual * MARGIN)
    counts = _filed(filed, tables, probes, False).groupBy("table", "axis").agg(
        F.sum((~F.col("asks")).cast("int")).alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).where("n > 0 and q > 0").toPandas()
    # One row for each axis of each table: bounded by the tables and the dimension.
    up = lambda n: (-(-n // BLOCK)).astype("int32")
    sizes = spark.createDataFrame(
        pd.DataFrame({"table": counts["table"].astype("int32"), "axis": counts["axis"].astype("int32"),
                      "blocks": up(counts["n"]), "query_blocks": up(counts["q"])}), "table int, axis int, blocks int, query_blocks int")
    scored = _scored(_blocks(_filed(filed, tables, probes, True), sizes), k + 1)
    members = saved(_first_of_kind(usable, k + 1))
    lists = saved(_lists(scored, members, k + 1))
    total = usable.select("vec_id").distinct().count()
    short = kinds.where("asks").join(lists.where(F.size("nearest") >= min(k + 1, total)), F.col("kind") == F.col("query"), "left_anti")
    short = saved(short.select("kind", "least", "asks", "vec"))
    asked = short.count()
    if asked:
        n = kinds.count()
        whole = spark.createDataFrame([(0, 0, -(-n // BLOCK), -(-asked // BLOCK))], "table int, axis int, blocks int, query_blocks int")
        all_ = kinds.select("kind", "least", F.lit(False).alias("asks"), "vec").unionByName(short)
        met = _blocks(all_.select(F.lit(0).alias("table"), F.lit(0).alias("axis"), "asks", "kind", "least", "vec"), whole)
        lists = lists.join(short, F.col("query") == F.col("kind"), "left_anti").unionByName(_lists(_scored(met, k + 1), members, k + 1))
    queries = usable.where(F.col("vec_id") % every == 0).select(F.col("kind").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    others = F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(saved(lists), "query").select("query_id", F.posexplode(others).alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "found.vec_id", "found.score")
