"""Best-fit packing of token sequences by minimum bin slack.

The choice of bins depends only on how many pieces of each length there are. That histogram
has at most ``capacity`` entries whatever the corpus, so the search over it is small and the
pieces themselves never leave their partitions: they are ranked within their length and read
their place from the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.llm.store import saved
from mastwire.llm.text import Texts, Words, texts, words

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SLICE_BYTES = 4_000_000
#: Parts of a length that are ranked apart; the driver gets at most CAPACITY * LOTS counts.
LOTS = 128


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True  # a text that spells a special token is ordinary text
    return tokenizer


def _classes() -> tuple[np.ndarray, np.ndarray]:
    letter, sign = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    letter[97:123] = letter[65:91] = True
    sign[33:127] = True
    sign[48:58] = sign[ord("'")] = False
    return letter, sign & ~letter


LETTER, SIGN = _classes()
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Vocabulary:
    """Ids of the pieces of text met so far, by the hash of a piece.

    The tokenizer drops white space and starts anew at it, and also where a sign follows a
    letter. Cut there, a text's ids are its pieces' ids in a row, and a piece is encoded once.
    The memory is bounded: it starts anew when it holds more than ``limit`` pieces.
    """

    def __init__(self, name: str, limit: int = 500_000):
        self.tokenizer, self.limit = _tokenizer(name), limit
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.at = self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Order of the pieces in the new run of ids, and their numbers of ids in that order.

        Words of plain letters end in a closing token each, so they go together and are parted
        again; the rest go one by one.
        """
        plain = [i for i, x in enumerate(pieces) if LATIN.fullmatch(x)]
        rest = sorted(set(range(len(pieces))) - set(plain))
        order, runs, sizes = [], [self.pool], []
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            text = " ".join(pieces[i] for i in some)
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            order += some
            runs.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        for i in rest:
            ids = np.asarray(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, np.uint32)
            order.append(i)
            runs.append(ids)
            sizes.append(np.array([len(ids)]))
        self.pool = np.concatenate(runs)
        return np.array(order), np.concatenate(sizes)

    def look_up(self, part: Texts, found: Words) -> np.ndarray:
        """Row of every piece, with the new ones encoded and added."""
        if len(self.hashes) > self.limit:
            self.clear()
        unique, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        row = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), dtype=bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(row, len(self.hashes) - 1)] == unique
        if not known.all():
            new = first[~known]
            data = part.data.tobytes()
            before = len(self.pool)
            bounds = zip(found.starts[new].tolist(), found.ends[new].tolist(), strict=True)
            met, size = self._encode([data[a:b].lower().decode("utf-8") for a, b in bounds])
            hashes = np.concatenate((self.hashes, unique[~known][met]))
            at = np.concatenate((self.at, before + np.cumsum(size) - size))
            order = np.argsort(hashes)
            self.hashes, self.at = hashes[order], at[order]
            self.size = np.concatenate((self.size, size))[order]
            row = np.searchsorted(self.hashes, unique)
        return row[inverse]


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """One for each tokenizer in a worker process: later tasks go on with its pieces."""
    return Vocabulary(name)


def token_ids(column: pa.Array, pieces: Vocabulary) -> Iterator[np.ndarray]:
    """For each text its ids and the closing id; a null text is an empty one."""
    end = np.array([END_ID], dtype=np.uint32)
    for part in texts(column, SLICE_BYTES):
        data = part.data
        cuts = np.zeros(len(data), dtype=bool)
        cuts[1:] = SIGN[data[1:]] & LETTER[data[:-1]]
        # Also after a letter of Latin-1, two bytes of which the first is C3 (D7 and F7 are signs).
        cuts[2:] |= SIGN[data[2:]] & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & (data[1:-1] > 127)
        found = words(part, cuts=cuts)
        row = pieces.look_up(part, found)
        size = pieces.size[row]
        ends = np.cumsum(size)
        # Each piece's ids are a run of the pool: shift a running number to each run's start.
        ids = pieces.pool[np.repeat(pieces.at[row] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[found.bounds]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.concatenate((ids[a:b], end))


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only longer documents are cut."""

    def cut(batches):
        pieces = vocabulary(tokenizer)
        for batch in filter(len, batches):
            rows = []
            for row, ids in enumerate(token_ids(batch.column(1), pieces)):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((row, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)),
                 *(pa.array(c) for c in columns[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that the counts allow, its first the longest piece left.

    ``reach`` is a bitset of the sums reachable with the pieces seen so far. A length that may
    be used c times enters as binary multiples 1, 2, 4, ..., so each step is one shift of a
    whole number. The sums are then walked back from the largest to the pieces they need.
    """
    first = max(counts)
    room = capacity - first
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        spare = min(counts[length] - (length == first), room // length)
        times = 1
        while spare > 0:
            times = min(times, spare)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            spare -= times
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    bin_ = [first]
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            bin_ += [length] * times
            total -= length * times
    return bin_


def bin_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, their lengths) until no piece is left: minimum bin slack on the histogram.

    A pattern is repeated as long as its lengths last, so every step uses up a length and there
    are at most ``capacity`` patterns.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        bin_ = fullest(left, capacity)
        need = {k: bin_.count(k) for k in set(bin_)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, sorted(bin_, reverse=True)))
    return out


def plan_table(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each length the ranks that a pattern takes: first rank, first bin, pieces a bin, offset."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for times, bin_ in patterns:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            each = bin_.count(length)
            rows.append((length, used.get(length, 0), bins, each, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        bins += times
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "each", "offset"]).sort_values(["length", "rank"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Null and empty texts are the closing id alone. Repeated rows and null ids are packed as they
    stand, row by row. No row: no sequence. Columns besides doc_id and text are not read.
    """
    pieces = saved(tokenized_pieces(docs, capacity, tokenizer))
    # Pieces of one length are dealt to lots, so a length that a third of all pieces have is still
    # ranked in parallel; what the driver gets is bounded by capacity and lots, not by the cluster.
    lots = LOTS
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lots)).cast("int"))
    counts = dealt.groupBy("length", "lot").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "lot"])
    histogram = {int(length): int(n) for length, n in counts.groupby("length")["n"].sum().items()}
    plan = plan_table(bin_patterns(histogram, capacity))
    codes = (counts["length"] * lots + counts["lot"]).to_numpy(np.int64)
    starts = (counts.groupby("length")["n"].cumsum() - counts["n"]).to_numpy(np.int64)
    # One sortable number for (length, rank): ranks are below the number of pieces.
    span = max(histogram.values(), default=0) + 1
    marks = (plan["length"] * span + plan["rank"]).to_numpy(np.int64)
    bins, each, offsets, ranks = (plan[c].to_numpy(np.int64) for c in ("bin", "each", "offset", "rank"))

    def place(batches):
        # A task meets whole (length, lot) groups in a row; the rank runs on over batch ends.
        last, at = None, 0
        for batch in filter(len, batches):
            length = batch.column("length").to_numpy()
            code = length * lots + batch.column("lot").to_numpy()
            new = np.concatenate(([True], code[1:] != code[:-1]))
            run = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
            if code[0] == last:
                first_run = len(code) if not new[1:].any() else int(np.flatnonzero(new[1:])[0]) + 1
                run[:first_run] += at
            last, at = code[-1], run[-1] + 1
            rank = run + starts[np.searchsorted(codes, code)]
            row = np.searchsorted(marks, length * span + rank, side="right") - 1
            within = rank - ranks[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(bins[row] + within // each[row]), pa.array(offsets[row] + within % each[row] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ordered = dealt.repartition("length", "lot").sortWithinPartitions("length", "lot", "doc_id", "piece")
    return ordered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
