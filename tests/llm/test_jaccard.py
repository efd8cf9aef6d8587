import re

import numpy as np
import pytest

from mastwire.llm import jaccard
from mastwire.llm.links import components


def grams(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [grams(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 30))
    texts = [None, "", " \n", "a b", "A  b", "a b c", "x y z w", "x y z w v"]
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    texts += [texts[20]] * 4
    order = rng.permutation(len(texts))
    return [(int(i) if i % 11 else None, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed, size, percent, block", [(1, 4, 85, 1024), (2, 5, 80, 3), (3, 2, 60, 2)])
def test_clusters_equal_all_pairs(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, key int")
    got = sorted([tuple(r) for r in jaccard.clusters(docs, size, percent).collect()], key=str)
    assert got == brute(rows, size, percent)


def test_one_row_of_each_stays(spark):
    rows = [*corpus(4), (5, "same words here again and more"), (5, "same words here again and more")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, root int")
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    texts = [t for _, t in rows]
    want = brute(rows, 5, 80)
    bare = sum(not (t or "").strip() for t in texts)
    # A component of null ids alone has a null id, so count components by brute force on numbered rows.
    numbered = brute([(i, t) for i, t in enumerate(texts)], 5, 80)
    assert kept.count() == len({c for _, n, c in numbered if n}) + bare
    ids = {r.doc_id for r in kept.collect()}
    assert {c for _, n, c in want if n and c is not None} <= ids


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.clusters(empty).count() == 0 and jaccard.first_of_each(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 20)]
    noise = [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    pairs = chain + star + noise + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def test_overlap_counts_and_likely_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 120))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    sets += [x[:-1] for x in sets[:20] if len(x) > 1]
    got = jaccard.overlaps(sets, width=16)
    pairs = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in jaccard.likely_pairs(
        np.array([len(x) for x in sets]), [jaccard._bit_row(x) for x in sets], None, 60)[:2]))}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == common
            if 100 * common >= 60 * (len(sets[i]) + len(sets[j]) - common):
                assert (j, i) in pairs
