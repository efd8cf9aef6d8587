import hashlib
from collections import Counter

import numpy as np
import pytest

from mastwire.llm import repeats


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = np.random.default_rng(seed)

    def prose(n):
        return "".join(rng.choice(list("abcdeé \n"), n))

    passages = [prose(int(length * f)) for f in (0.9, 1.0, 1.02, 1.3, 2.5, 4)]
    texts = [None, "", prose(length - 5), "x" * (length * 3), "ab" * length, prose(length)]
    for _ in range(25):
        body = prose(int(rng.integers(0, 4 * length)))
        for p in rng.choice(len(passages), int(rng.integers(0, 3))):
            at = int(rng.integers(len(body) + 1))
            cut = passages[p]
            if rng.random() < 0.4:
                cut = cut[int(rng.integers(len(cut) // 2)) :]
            body = body[:at] + cut + body[at:]
        texts.append(body)
        if rng.random() < 0.4:
            copy = list(body)
            for _ in range(int(rng.integers(0, 3))):
                if copy:
                    copy[int(rng.integers(len(copy)))] = "Z"
            texts.append("".join(copy))
    texts += [texts[8]] * 3
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, length, stretch", [(1, 400, 1 << 20), (2, 64, 100), (3, 40, 1 << 20), (4, 400, 1000)])
def test_removed_bytes_equal_the_brute_force(spark, monkeypatch, seed, length, stretch):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    rows = [*corpus(seed, length), (77, "same row " * 80), (77, "same row " * 80)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = sorted((tuple(r)[:5] for r in repeats.removed(docs, length).collect()), key=str)
    assert got == brute(rows, length)


def test_nothing(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_give_every_string_the_same_anchor(monkeypatch):
    import pyarrow as pa

    from mastwire.llm.text import texts

    part = next(texts(pa.array([t for _, t in corpus(5, 64)])))
    shape = repeats.Shape(64)

    def places():
        return {(d, p): a for d, a, f, t in zip(*(x.tolist() for x in repeats.anchored(part, shape)), strict=True)
                for p in range(f, t + 1)}

    whole = places()
    monkeypatch.setattr(repeats, "STRETCH", 37)
    assert places() == whole
    assert len(whole) == sum(max(0, e - s - 63) for s, e in zip(part.starts, part.ends, strict=True))
    assert all(p <= a < p + shape.window for (_, p), a in whole.items())


def test_only_texts_that_a_round_needs_are_joined(spark, monkeypatch):
    rows = corpus(6, 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, passing, passed = brute(rows, 64), repeats.passing, []

    def counted(df, column, bits):
        out = passing(df, column, bits)
        passed.append(out.count())
        return out

    monkeypatch.setattr(repeats, "passing", counted)
    assert sorted((tuple(r)[:5] for r in repeats.removed(docs, 64).collect()), key=str) == want
    assert passed[-1] == sum(r[2] > 0 for r in want) < len(rows) and all(n < len(rows) for n in passed)
    # A filter that is full lets every row through and changes no result.
    monkeypatch.setattr(repeats, "marked", lambda hashes: np.full((1 << 26) // 8, 255, np.uint8))
    assert sorted((tuple(r)[:5] for r in repeats.removed(docs, 64).collect()), key=str) == want
    assert passed[-1] == len(rows)


def test_no_table_is_sent_to_all_tasks(spark, monkeypatch):
    """Sized by its file, a table that an explode makes 32 times as long was sent through the driver."""
    plans = []
    kept = repeats.saved

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(repeats, "saved", noted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3, 40))], "doc_id long, text string")
    out = repeats.removed(docs, 40)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
