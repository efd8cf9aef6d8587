"""Language by string kernels: which byte n-grams occur, compared with landmark texts.

The kernel of two texts is the share of n-grams (of two to four bytes together) that both hold.
A Nyström map over landmark texts and kernel ridge regression, one language against the rest,
give a score that is linear in the kernel row, hence in the n-grams: the landmarks and the
regression fold into one matrix, and a batch of texts is scored by one sparse matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.llm.text import Texts, texts

FOLDS = 3
HELD_OUT = 1
NO_LANGUAGE = "und"
SIZES = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = BUCKETS * len(SIZES)
#: Training texts and landmarks for each language, about: both by the hash of a row.
PER_LANGUAGE = 300
LANDMARKS = 50
RIDGE = 0.1

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


class Presence:
    """N-grams of one text after the other, marked in a table that is wiped after each."""

    def __init__(self):
        self.table = np.zeros(WIDTH, dtype=bool)

    def each(self, part: Texts):
        """Sorted numbers of the n-grams of every document of the run."""
        data = _FOLD[part.data]
        grams = []
        code = data
        for n in SIZES:
            code = code[:-1] * np.uint32(0x01000193) ^ data[n - 1 :] if len(code) else code
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
            grams.append((n, slot.astype(np.int32) + BUCKETS * (n - SIZES[0])))
        for a, b in zip(part.starts, part.ends, strict=True):
            for n, slot in grams:
                self.table[slot[a : max(a, b - n + 1)]] = True
            found = np.flatnonzero(self.table)
            self.table[found] = False
            yield found


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram by language

    def scores(self, column: pa.Array) -> np.ndarray:
        """Regression outputs of every text, run by run of texts."""
        presence, out = Presence(), []
        for part in texts(column):
            found = list(presence.each(part))
            sizes = np.array([len(x) for x in found])
            sums = np.zeros((len(found), len(self.languages)))
            full = np.flatnonzero(sizes)
            if len(full):
                # Rows of the 0/1 matrix lie one after the other: its product with the weights
                # is the sum of each row's weights.
                begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                sums[full] = np.add.reduceat(self.weights[np.concatenate(found)], begins, axis=0)
            out.append(sums / np.sqrt(np.maximum(sizes, 1))[:, None])
        return np.vstack(out) if out else np.zeros((0, len(self.languages)))


def train(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on the Nyström map of the first landmarks of each language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((WIDTH, 0), dtype=np.float32))
    rows = lambda part: np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(-1, WIDTH).astype(np.float32)
    chosen = [i for name in languages for i in [j for j, x in enumerate(langs) if x == name][:landmarks]]
    marks = rows([bits[i] for i in chosen])
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    kernel = []
    for at in range(0, len(bits), 64):
        block = rows(bits[at : at + 64])
        kernel.append(block @ marks.T / np.sqrt(np.maximum(block.sum(axis=1), 1))[:, None])
    kernel = np.vstack(kernel).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    kept = values > 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ target)
    return Model(languages, (marks.T @ (root @ solved)).astype(np.float32))


def held_out() -> Column:
    """crc32 of the id as text leaves HELD_OUT. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """N-gram tables and languages of about ``per_language`` training rows of each language.

    A row is taken when its hash falls under its language's share; the hash also orders them.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in docs.where(~held_out() & F.col("lang").isNotNull()).groupBy("lang")
              .agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)))
    order = F.xxhash64("doc_id", F.lit("language"))
    part = F.pmod(order, F.lit(1 << 40)).cast("double") / float(1 << 40)
    taken = known.where(part < shares[F.col("lang")]).select("text", "lang", order.alias("order"))

    def run(batches):
        presence = Presence()
        for batch in filter(len, batches):
            bits = []
            for part_ in texts(batch.column(0)):
                for found in presence.each(part_):
                    row = np.zeros(WIDTH, dtype=bool)
                    row[found] = True
                    bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits, pa.binary()), batch.column(1), batch.column(2)], names=["bits", "lang", "order"])

    rows = (taken.mapInArrow(run, "bits binary, lang string, order long").orderBy("order", "lang", "bits")
            .limit(2 * per_language * len(counts)).collect())
    return [bytes(r.bits) for r in rows], [r.lang for r in rows]


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row's whole text.

    A null text, one without a letter, or a corpus without training rows gives ``und`` and 0.
    Repeated rows are predicted one by one; columns besides doc_id, text and lang are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(*sample(rows, per_language))

    def run(batches):
        names = np.array([*model.languages, NO_LANGUAGE], dtype=object)
        for batch in filter(len, batches):
            column = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            scores = model.scores(column)
            if scores.shape[1]:
                best, top = scores.argmax(axis=1), scores.max(axis=1)
            else:
                best, top, letters = np.zeros(len(column), int), np.zeros(len(column)), np.zeros(len(column), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names[np.where(letters, best, -1)], pa.string()),
                 pa.array(np.where(letters, np.clip((top + 1) / 2, 0.0, 1.0), 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
