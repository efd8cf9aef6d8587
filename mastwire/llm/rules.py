"""Quality rules: an ordered list of readable threshold conjunctions, learned from labelled statistics.

Sequential covering: a rule is grown test by test on one part of the labelled rows, always by the
test that gains most on rejected rows, then pruned on the other part. Rows that it covers are set
aside and the next rule is learned from the rest, until no rule is right often enough. The list is
emitted as one conditional Spark expression over the statistics of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.llm.store import saved
from mastwire.llm.text import BLANK, EXACT, Texts, mixed, shingles, texts, words

FOLDS = 5
#: Labelled rows that the list is learned from, at most; taken by hash of their id.
MAX_ROWS = 20_000
MAX_RULES = 24
MAX_TESTS = 4
#: Share of the rows covered by a rule that must be rejected ones, on the rows it is pruned on.
PRECISION = 0.9
#: Limits tried for each statistic, at quantiles of the rows still uncovered.
LIMITS = 48
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct", "n_top", "n_echoes")

#: Statistic of a rule: counts of the text, set against its size.
STATISTICS = {
    "words": "cast(n_words AS double)",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_char": "n_symbols / greatest(word_chars, 1)",
    "upper_a_char": "n_upper / greatest(word_chars, 1)",
    "digits_a_char": "n_digits / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "stops_a_word": "n_stops / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "commonest_word": "n_top / greatest(n_words, 1)",
    "echoed_words": "n_echoes / greatest(n_words, 1)",
}
NAMES = tuple(STATISTICS)


def _table(signs: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in signs])


SYMBOLS, UPPER, DIGITS, MARKS, STOPS = map(
    _table, ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".!?"))
STARTS = (np.arange(256) & 0xC0) != 0x80


def _repeated(part: Texts, found) -> np.ndarray:
    """Words of each document that lie in a window of WINDOW words that it holds twice or more."""
    n = np.diff(found.bounds)
    hashes, bounds = shingles(found, WINDOW)
    whole = np.repeat(n >= WINDOW, np.diff(bounds))
    doc = np.repeat(np.arange(len(n)), np.diff(bounds))
    at = found.bounds[doc] + np.arange(len(doc)) - bounds[doc]
    keys = mixed(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, often = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[(often[back] > 1) & whole]
    cover = np.zeros(len(found.starts) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return inside[found.bounds[1:]] - inside[found.bounds[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counted(column: pa.Array) -> np.ndarray:
    """One row of COUNTS per text; all zero for an empty or null text."""
    rows = []
    for part in texts(column):
        found = words(part, signs=EXACT)
        n = np.diff(found.bounds)
        solid = ~BLANK[part.data] & STARTS[part.data]
        lines = np.array([_lines(part.data[a:b].tobytes()) for a, b in zip(part.starts, part.ends, strict=True)]).reshape(-1, 2)
        distinct, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for i in np.flatnonzero(n):
            often = np.unique(found.hashes[found.bounds[i] : found.bounds[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(often), often.max()
        echo = np.zeros(len(found.hashes), dtype=bool)
        echo[1:] = found.hashes[1:] == found.hashes[:-1]
        echo[found.bounds[:-1][n > 0]] = False
        echoes = np.concatenate(([0], np.cumsum(echo)))
        rows.append(np.column_stack((
            n, part.counts(solid), part.counts(SYMBOLS[part.data]), lines[:, 1], _repeated(part, found),
            lines[:, 0], *(part.counts(t[part.data]) for t in (UPPER, DIGITS, MARKS, STOPS)),
            distinct, top, echoes[found.bounds[1:]] - echoes[found.bounds[:-1]])))
    return np.vstack(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's whole text, in one pass without a shuffle."""

    def run(batches):
        for batch in filter(len, batches):
            values = counted(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(values[:, i], pa.int64()) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit!r}"

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, NAMES.index(self.name)]
        return column > self.limit if self.above else column <= self.limit

    def column(self) -> Column:
        value = F.expr(STATISTICS[self.name])
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule]) if rule else np.ones(len(x), dtype=bool)


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the test with the largest information gain until no kept row is covered or nothing gains."""
    rule: list[Test] = []
    while len(rule) < MAX_TESTS and bad.any() and not bad.all():
        before, best, chosen = np.log2(bad.mean()), 1e-9, None
        for i, name in enumerate(NAMES):
            values = np.sort(x[:, i])
            steps = np.unique(np.quantile(values, np.linspace(0, 1, LIMITS + 2)[1:-1], method="lower"))
            steps = np.unique(np.concatenate((steps, np.quantile(x[bad, i], (0.02, 0.98), method="lower"))))
            for limit in steps[steps < values[-1]]:
                high = x[:, i] > limit
                for above, side in ((True, high), (False, ~high)):
                    p = np.count_nonzero(bad & side)
                    if p:
                        gain = p * (np.log2(p / np.count_nonzero(side)) - before)
                        if gain > best:
                            best, chosen = gain, (Test(name, above, float(limit)), side)
        if chosen is None:
            break
        rule.append(chosen[0])
        x, bad = x[chosen[1]], bad[chosen[1]]
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop last tests as long as the rule does no worse on rows it was not grown on."""
    def worth(r: Rule) -> float:
        side = covers(r, x)
        p, n = np.count_nonzero(bad & side), np.count_nonzero(~bad & side)
        return (p - n) / (p + n) if p + n else -1.0

    lengths = range(len(rule), 0, -1)
    return rule[: max(lengths, key=lambda k: (worth(rule[:k]), -k))] if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules that reject, in order. Every third row prunes, the others grow; without rejected rows there are none."""
    rules: list[Rule] = []
    prunes = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules and bad[~prunes].any():
        rule = _prune(_grow(x[~prunes], bad[~prunes]), x[prunes], bad[prunes])
        side = covers(rule, x)
        judged = side & prunes if np.count_nonzero(side & prunes) >= 5 else side
        if not rule or np.count_nonzero(bad & judged) + 1 < precision * (np.count_nonzero(judged) + 1):
            break
        rules.append(rule)
        x, bad, prunes = x[~side], bad[~side], prunes[~side]
    return rules


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Rows kept from learning, for measuring: crc32 of the id as text leaves 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, from 1, as one conditional expression; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, k) if out is None else out.when(condition, k)
    return F.lit(0) if out is None else out.otherwise(0)


def learned(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """The list from labelled statistics: rows outside the held-out fold that pass the base, at most ``max_rows``."""
    known = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad")).distinct()
    order = F.xxhash64("doc_id", F.lit("rules"))
    train = saved(rows.where(~base_failed() & ~held_out()).join(known, "doc_id")
                  .select(order.alias("order"), "bad", *(F.expr(e).alias(n) for n, e in STATISTICS.items())))
    # The bound on the hash comes from a count, so no partition offers more than its share.
    bits = 40
    bound = int((1 << bits) * min(1.0, max_rows / max(train.count(), 1)))
    sample = (train.where(F.pmod("order", F.lit(1 << bits)) < bound).orderBy("order", *NAMES, "bad").limit(max_rows).toPandas())
    return learn(sample[list(NAMES)].to_numpy(float), sample["bad"].to_numpy(bool))


def verdicts(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, counts, base_failed, kept, rule (that rejects; 0 for none, null where the base failed) and its reason.

    Null and empty texts have no words and fail the base. Repeated rows are judged one by one; a
    document with labels of both kinds is learned with both. Labels that are null or without a
    document are not used; without rejected labels the list is empty and the base decides alone.
    Texts of any length are taken whole. Columns besides doc_id, text and quality are not read.
    """
    rows = saved(statistics(docs))
    rules = learned(rows, labels, max_rows)
    out = rows.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    texts_ = F.array(*(F.lit(" AND ".join(map(str, r))) for r in rules)) if rules else F.array().cast("array<string>")
    return out.select(
        "doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
        F.when(F.col("rule") > 0, F.get(texts_, F.col("rule") - 1)).alias("reason"))
