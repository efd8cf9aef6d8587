import random
import re

import numpy as np
import pyarrow as pa

from mastwire.llm import rules
from mastwire.llm.store import table

SMALL = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def cases():
    rng = random.Random(3)
    words = ["a", "B", "b", "é#", "ß|", "word", "Word"]
    out = [None, "", " \n\t", "x\x0by z\nx\x0by z", "one two\none two\n\n\nOne two", " ".join(["same"] * 400)]
    for _ in range(120):
        out.append("".join(rng.choice(words) + rng.choice(" \n\t ") for _ in range(rng.randint(0, 60))))
    return [*out, "lang " * 300_000 + "\n" + " ".join(map(str, range(50_000)))]


def test_counts_against_plain_python():
    got = rules.counted(pa.array(cases()))[:, :5]
    for text, row in zip(cases(), got.tolist(), strict=True):
        if text and len(text) > 1_000_000:
            assert row[0] == 350_000 and row[4] == 300_000
        else:
            assert tuple(row) == plain(text), text


def test_rules_are_grown_pruned_and_ordered():
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(rules.NAMES)))
    at = {n: x[:, i] for i, n in enumerate(rules.NAMES)}
    bad = ((at["symbols_a_char"] > 0.8) & (at["words"] > 0.5)) | (at["distinct_words"] <= 0.1)
    bad ^= rng.random(len(x)) < 0.01
    found = rules.learn(x, bad)
    names = [{t.name for t in r} for r in found[:2]]
    assert {"distinct_words"} in names and {"symbols_a_char", "words"} in names
    hit = np.logical_or.reduce([rules.covers(r, x) for r in found])
    assert (hit == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(len(x), bool)) == [] and rules.learn(x[:0], bad[:0]) == []


def test_verdicts_of_held_out_rows_and_of_the_emitted_expression(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    got = rules.verdicts(docs, labels)
    assert got.count() == docs.count()
    both = got.withColumn("held", rules.held_out()).where("held AND NOT base_failed").join(labels, "doc_id").toPandas()
    assert len(both) > 50 and (both.kept == (both.quality == 1)).mean() > 0.97
    rows = rules.statistics(docs)
    found = rules.learned(rows, labels)
    assert found
    frame = rows.where(~rules.base_failed()).select(
        rules.first_rule(found).alias("rule"), *(rules.F.expr(e).alias(n) for n, e in rules.STATISTICS.items())).toPandas()
    x = frame[list(rules.NAMES)].to_numpy(float)
    expected = np.zeros(len(x), int)
    for k, rule in reversed(list(enumerate(found, 1))):
        expected[rules.covers(rule, x)] = k
    assert (frame.rule.to_numpy() == expected).all()
    for row in got.join(docs.select("doc_id", "text"), "doc_id").collect():
        n, chars, symbols, dup, repeat = plain(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert row.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (row.base_failed and row.kept)


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, "u"), (None, "", "u"), (2, "good words here " * 2, "u"), (2, "good words here " * 2, "u"), (3, " ".join(map(str, range(40))), None)],
        "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(2, None, 0), (3, 1, 0), (3, 0, 0), (None, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.verdicts(docs, labels).collect()
    assert len(got) == 5 and [r.kept for r in got if r.doc_id == 2] == [False, False]
    assert sum(r.kept for r in rules.verdicts(docs, labels.limit(0)).collect()) == 1
    assert rules.verdicts(docs.limit(0), labels).count() == 0
