"""Bytes covered by long strings that start elsewhere too, by groups of anchors, cells and strings.

Not prefix doubling: nothing is ranked or sorted. Ranking every byte of a corpus would shuffle many
times its size in each round, so positions go in groups that hashes tell apart. The smallest hash of the
16-byte grams in the first WINDOW bytes of a string is its anchor, the same in every copy of the
string, and all strings of one anchor hold the CORE bytes from the anchor on. The first round keeps
the anchors whose core occurs again, the second the runs of up to CELL strings of such an anchor
whose common bytes occur again, the third single strings. A run whose bytes all repeat is settled as
a whole in each round. Every string is decided in one of the rounds, so none is lost. Texts are shuffled
only where a filter of fixed size says that a round or the result needs them.
Every join is asked to merge: Spark sizes a table by its file and does not count what an explode adds, so it
would send single strings, up to CELL times what it expects, through the driver to all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.llm.filters import holds, marked, passing
from mastwire.llm.store import saved
from mastwire.llm.text import Texts, texts

LENGTH = 400
GRAM = 16
STRETCH = 1 << 20
_ORDER = np.random.default_rng(400).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


class Shape:
    """Lengths that follow from the length of the strings."""

    def __init__(self, length: int):
        self.length = length
        self.window = max(1, min(256, length * 16 // 25, length - GRAM + 1))
        self.core = length - self.window + 1
        self.cell = min(32, self.window)
        self.cell_core = length - self.cell + 1


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, built by doubling: 1, 2, 4, 8, 16 bytes."""
    h, n = _ORDER[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint32(0x01000193 + 2 * n) + h[n:]
        h ^= h >> np.uint32(15)
        n *= 2
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``: of the rest of one block and the start of the next."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(part: Texts, shape: Shape) -> tuple[np.ndarray, ...]:
    """(document, anchor, first, last): runs of strings of one anchor, as places in the run of texts."""
    found = []
    count = np.maximum(part.ends - part.starts - shape.length + 1, 0)
    for begin in range(0, max(len(part.data) - shape.length + 1, 0), STRETCH):
        data = part.data[begin : begin + STRETCH + shape.length - 1]
        first = np.clip(part.starts - begin, 0, STRETCH)
        n = np.clip(part.starts + count - begin, 0, STRETCH) - first
        n = np.where(count > 0, np.maximum(n, 0), 0)
        if not n.sum():
            continue
        order = _gram_order(data).astype(np.uint64)
        least = _window_least(order << np.uint64(32) | np.arange(len(order), dtype=np.uint64), shape.window)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        found.append((doc[new], anchor[new] + begin, at[new] + begin, at[last] + begin))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _number(data: memoryview, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """One row per anchor: rank key, hash of all its bytes, the document, its place and the run of strings."""

    def run(batches):
        for batch in filter(len, batches):
            keys, wholes, rows, places = [], [], [], []
            for part in texts(batch.column(1)):
                doc, anchor, first, last = anchored(part, shape)
                data = memoryview(part.data.tobytes())
                far, near = anchor - first, anchor - last
                for a, f, t, s in zip(anchor.tolist(), first.tolist(), last.tolist(), (far << 16 | near).tolist(), strict=True):
                    keys.append(_number(data[a : a + shape.core]))
                    wholes.append(_number(data[f : t + shape.length], s))
                rows.append(doc + part.first)
                places.append(np.stack((anchor - part.starts[doc], far, near)))
            if not keys:
                continue
            at = np.concatenate(places, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(wholes, pa.int64()), batch.column(0).take(pa.array(np.concatenate(rows))),
                 *(pa.array(x) for x in at)], names=["key", "whole", "doc_key", "anchor", "far", "near"])

    return docs.select("doc_key", "text").mapInArrow(
        run, "key long, whole long, doc_key long, anchor int, far int, near int")


def _cells(docs: DataFrame, open_: DataFrame, shape: Shape) -> DataFrame:
    """Runs of at most CELL strings of the undecided anchors: bytes in common as a hash, and both edges."""

    def run(batches):
        for batch in filter(len, batches):
            out = []
            lists = batch.column(2)
            rows = lists.values
            fields = [rows.field(k).to_numpy() for k in ("key", "anchor", "far", "near")]
            ends = lists.offsets.to_numpy()
            doc_keys = batch.column(0).to_pylist()
            for r, text in enumerate(batch.column(1)):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                for key, anchor, far, near in zip(*(f[ends[r] : ends[r + 1]].tolist() for f in fields), strict=True):
                    for cell in range(near // shape.cell, far // shape.cell + 1):
                        start = anchor - cell * shape.cell  # where the last string of a whole cell begins
                        side = shape.cell - 1
                        left = bytes(data[max(start - side, 0) : start]).rjust(side, b"\0") if start > 0 else bytes(side)
                        right = bytes(data[start + shape.cell_core : start + shape.length]).ljust(side, b"\0")
                        out.append((key, cell, _number(data[start : start + shape.cell_core], cell), doc_keys[r], start,
                                    max(near - cell * shape.cell, 0), min(far - cell * shape.cell, side), left, right))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["key", "cell", "common", "doc_key", "start", "low", "high", "left", "right"])

    listed = open_.groupBy("doc_key").agg(F.collect_list(F.struct("key", "anchor", "far", "near")).alias("anchors"))
    needed = passing(docs.select("doc_key", "text"), "doc_key", marked(open_.select("doc_key")))
    return needed.join(listed.hint("merge"), "doc_key").select("doc_key", "text", "anchors").mapInArrow(
        run, "key long, cell int, common long, doc_key long, start int, low int, high int, left binary, right binary")


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_key, first, last): runs of places at which a string of ``length`` bytes starts that starts elsewhere too.

    ``docs`` has doc_key and text; rows of one doc_key are the same row, repeated.
    """
    shape = Shape(length)
    anchors = saved(_anchors(docs, shape))
    # Round 1: anchors by the bytes after them. What is unique there is unique as a whole.
    shared = saved(anchors.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    alive = saved(anchors.join(shared.hint("merge"), "key"))
    wholes = saved(alive.groupBy("key", "whole").agg(
        F.count("*").alias("c"), F.min(F.struct("doc_key", "anchor", "far", "near")).alias("row")))
    settled = alive.join(wholes.where("c > 1").select("key", "whole").hint("merge"), ["key", "whole"]).select(
        "doc_key", (F.col("anchor") - F.col("far")).alias("first"), (F.col("anchor") - F.col("near")).alias("last"))
    # Undecided: an anchor whose bytes are its own, beside others of the same rank. One of each suffices.
    undecided = saved(wholes.groupBy("key").agg(F.count("*").alias("d"), F.min("c").alias("least")).where(
        "d > 1 and least = 1").select("key"))
    open_ = saved(wholes.join(undecided.hint("merge"), "key").select("key", "row.*", (F.col("c") == 1).alias("alone")))
    if open_.isEmpty():
        return settled
    # Round 2: runs of strings by the bytes that they have in common.
    cells = saved(_cells(docs, open_.drop("alone"), shape))
    name = ["key", "cell", "common"]
    again = saved(cells.groupBy(name).agg(F.count("*").alias("c")).where("c > 1").select(name))
    cells = saved(cells.join(again.hint("merge"), name))
    edges = [*name, "low", "high", "left", "right"]
    same = saved(cells.groupBy(edges).agg(F.count("*").alias("c"), F.min("doc_key").alias("doc_key"), F.min("start").alias("start")))
    whole = cells.join(same.where("c > 1").select(edges).hint("merge"), edges).select("doc_key", "start", "low", "high")
    # Round 3: single strings by the bytes at their ends, for runs whose edges are their own.
    side = shape.cell - 1
    ends = F.concat(F.substring("left", F.lit(side + 1) - F.col("k"), F.col("k")),
                    F.substring("right", F.lit(1), F.lit(side) - F.col("k")))
    # A string is named by two hashes of all that tells it apart; its bytes are not shuffled.
    single = same.select(*edges, "c", "doc_key", "start").withColumn("k", F.explode(F.sequence("low", "high"))).select(
        *[F.xxhash64(F.lit(seed), *name, "k", ends).alias(h) for seed, h in enumerate(("string", "string2"))], "k", "c", "doc_key", "start")
    groups = ["string", "string2"]
    met = saved(single.groupBy(groups).agg(F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most").select(groups))
    ones = single.where("c = 1").join(met.hint("merge"), groups).select("doc_key", "start", F.col("k").alias("low"), F.col("k").alias("high"))
    late = whole.unionByName(ones).select(
        "doc_key", (F.col("start") - F.col("high")).alias("first"), (F.col("start") - F.col("low")).alias("last"))
    return settled.unionByName(late)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc_key: rows of the same id and text have the same key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.withColumn("doc_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))


def _kept(data: bytes, firsts: np.ndarray, lasts: np.ndarray, length: int) -> tuple[int, int, str, bytes]:
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
    spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
    return int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that stay.

    A null text is an empty one; texts shorter than ``length`` keep every byte. Repeated rows are
    copies of each other, so they lose what is covered; a null doc_id is an id of its own kind.
    Other columns are not read.
    """
    rows = keyed(docs)
    runs = repeated_strings(rows, length).groupBy("doc_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = saved(runs)

    def run(batches):
        for batch in filter(len, batches):
            lists = batch.column(2)
            at, last = (lists.values.field(k).to_numpy() for k in ("first", "last"))
            ends = lists.offsets.to_numpy()
            out = []
            for r, text in enumerate(batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                s = slice(ends[r], ends[r + 1])
                out.append((len(data), *_kept(data, at[s], last[s], length)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    none = F.from_json(F.lit("[]"), "array<struct<first:int,last:int>>")
    # Only rows that may lose bytes meet the runs; the others are read again and stay where they lie.
    bits = marked(runs.select("doc_key"))

    def rest(batches):
        yield from run(b.filter(pa.array(~holds(bits, b.column(3).to_numpy()))) for b in batches)

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = passing(rows, "doc_key", bits).join(runs.hint("merge"), "doc_key", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return cut.mapInArrow(run, kind).unionByName(rows.select("doc_id", "text", none.alias("runs"), "doc_key").mapInArrow(rest, kind))
