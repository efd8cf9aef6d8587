"""Quality by a generalised additive model with pairwise interactions.

One pass turns each whole text into a few measures. Cyclic boosting fits a shallow tree to one
measure after the other (then to the strongest pairs) and adds its leaves to that measure's
lookup table. A score is then a sum of table entries, picked by bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.llm.store import saved
from mastwire.llm.text import texts, words

THRESHOLD = 0.3
FOLDS = 5
#: Labelled rows that the model is fitted on, at most; the first by hash of their id.
MAX_ROWS = 20_000
MEASURES = (
    "log_words", "mean_word", "upper", "digit", "symbol", "exclaim", "bar", "beyond_ascii",
    "lines", "stops", "distinct", "repeated", "top_word",
)


def _set(signs: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in signs]] = True
    return table


UPPER, DIGIT, SYMBOL, EXCLAIM, BAR, LINE, STOP = map(
    _set, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*<>=@^_~\\{}[]+", "!", "|", "\n", ".?!"))
BEYOND = np.arange(256) >= 128


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES per text; all zero for an empty or null text."""
    rows = []
    for part in texts(column):
        found = words(part)
        n = np.diff(found.bounds)
        size = np.maximum(part.ends - part.starts, 1)
        each = np.maximum(n, 1)
        share = lambda table, part=part, size=size: part.counts(table[part.data]) / size
        distinct, top = np.zeros(len(n)), np.zeros(len(n))
        for i in np.flatnonzero(n):
            counts = np.unique(found.hashes[found.bounds[i] : found.bounds[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(counts), counts.max()
        same = np.zeros(len(found.hashes), dtype=bool)
        same[1:] = found.hashes[1:] == found.hashes[:-1]
        same[found.bounds[:-1][n > 0]] = False
        at = np.concatenate(([0], np.cumsum(same)))
        rows.append(np.column_stack((
            np.log1p(n), (np.concatenate(([0], np.cumsum(found.ends - found.starts)))[found.bounds[1:]]
                          - np.concatenate(([0], np.cumsum(found.ends - found.starts)))[found.bounds[:-1]]) / each,
            *(share(t) for t in (UPPER, DIGIT, SYMBOL, EXCLAIM, BAR, BEYOND)),
            part.counts(LINE[part.data]) / each, part.counts(STOP[part.data]) / each,
            distinct / each, (at[found.bounds[1:]] - at[found.bounds[:-1]]) / each, top / each)))
    return np.vstack(rows) if rows else np.zeros((0, len(MEASURES)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row's whole text."""

    def run(batches):
        for batch in filter(len, batches):
            values = measures(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(values[:, i]) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES))


@dataclass
class Additive:
    """Edges per measure, its lookup table, and tables of pairs over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, table in enumerate(self.tables):
            out += table[bins[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin: the split with the largest gain, then each side again."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    cut = int(np.argmax(left_g * _leaf(left_g, left_h) + right_g * _leaf(right_g, right_h))) + 1
    return np.concatenate((_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)))


def _gradients(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return y - p, np.maximum(p * (1 - p), 1e-6)


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of both axes at once: its gain and the leaf value of every cell."""
    sum_g, sum_h = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    best, out = -1.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        parts = []
        for s in (sum_g, sum_h):
            top, total = s[a, 1:-1], s[-1, 1:-1]
            parts.append(np.array([top, s[a, -1] - top, total - top, s[-1, -1] - s[a, -1] - (total - top)]))
        gain = (parts[0] * _leaf(*parts)).sum(axis=0)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, leaf = float(gain[b]), _leaf(parts[0][:, b], parts[1][:, b])
            out = np.empty_like(g)
            out[:a, : b + 1], out[:a, b + 1 :], out[a:, : b + 1], out[a:, b + 1 :] = leaf
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15,
        n_bins: int = 32) -> Additive:
    """Cyclic boosting on the log loss. Without rows, or with one class, the tables stay near 0."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0)
             for i in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))))
    if not len(x):
        return model
    bins = model.bins(x)
    raw = model.raw(bins)
    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = _gradients(y, raw)
            leaf = rate * _tree(*(np.bincount(bins[:, i], w, len(table)) for w in (g, h)), depth=2)
            table += leaf
            raw += leaf[bins[:, i]]
    coarse = bins // model.coarse
    sides = [len(t) // model.coarse + 1 for t in model.tables]

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * sides[j] + coarse[:, j], w, sides[i] * sides[j]).reshape(sides[i], sides[j])

    g, h = _gradients(y, raw)
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)
                    if sides[i] > 1 and sides[j] > 1), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    model.pair_tables = [np.zeros((sides[i], sides[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = _gradients(y, raw)
            leaf = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += leaf
            raw += leaf[coarse[:, i], coarse[:, j]]
    return model


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    """Rows kept from training: crc32 of the id as text leaves 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The model is fitted on at most ``max_rows`` distinct labelled rows outside the held-out fold and
    applied to all. Labels that are null or without a document are not used; repeated rows are
    scored one by one; null and empty texts get the score of all-zero measures.
    """
    rows = saved(measured(docs))
    known = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    labelled = rows.where(~held_out()).join(known, "doc_id").select("doc_id", *MEASURES, "quality").distinct()
    train = _sampled(labelled, max_rows, *MEASURES, "quality").toPandas()
    model = fit(train[list(MEASURES)].to_numpy(float), train["quality"].to_numpy(float))

    def run(batches):
        for batch in filter(len, batches):
            x = np.column_stack([batch.column(m).to_numpy() for m in MEASURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(x))],
                names=["doc_id", "held_out", "score"])

    out = rows.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns.

    The measures travel beside the text, so a row is judged in its own pass and no join brings
    text and score together. The fit reads the labelled documents only.
    """
    known = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    train = _training_rows(docs, known, max_rows)
    model = fit(train[list(MEASURES)].to_numpy(float), train["quality"].to_numpy(float))

    def run(batches):
        for batch in filter(len, batches):
            score = model.score(measures(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _sampled(rows: DataFrame, max_rows: int, *order: str) -> DataFrame:
    """At most ``max_rows`` rows by hash of their id, in order of hash and ``order``.

    The bound on the hash comes from a count, so all partitions together, and not each of them,
    offer about ``max_rows`` rows to the limit.
    """
    rows = saved(rows)
    bits = 40
    bound = int((1 << bits) * min(1.0, max_rows / max(rows.count(), 1)))
    hashed = F.xxhash64("doc_id")
    return rows.where(F.pmod(hashed, F.lit(1 << bits)) < bound).orderBy(hashed, *order).limit(max_rows)


def _training_rows(docs: DataFrame, known: DataFrame, max_rows: int) -> pd.DataFrame:
    """The labelled rows of ``_sampled``; their ids, at most ``max_rows``, are broadcast."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).distinct().join(known.distinct(), "doc_id")
    chosen = saved(_sampled(labelled, max_rows, "quality"))
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = measured(texts_.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).join(chosen, "doc_id")
    # Rows that repeat an id with other texts may be more than were chosen.
    return read.distinct().orderBy(F.xxhash64("doc_id"), *MEASURES, "quality").limit(max_rows).toPandas()
