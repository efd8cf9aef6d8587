import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from mastwire.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaf = lambda n: not any(len(m) > len(n) and m[: len(n)] == n for m in members)
        ends = sorted(c for c in held if built[c] == node)
        out[min(held), len(node)] = (
            min(members[node[:-1]]) if node else None, len(held), len(children), sum(map(leaf, below)),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def rows_of(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def conversations(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "bot", None]), rng.choice(["", "é", "hi", None, "long " * 5])))
    return rows


def test_against_a_walk_over_all_conversations(spark):
    for seed in range(3):
        rows = conversations(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        expected = plain(rows)
        got = prefixes.trie(df)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert got.count() == len(expected) and rows_of(got) == expected


def test_a_crowded_sketch_changes_nothing(spark):
    rows = conversations(9)
    df = spark.createDataFrame(rows, SCHEMA)
    for bits in (4, 6):
        assert rows_of(prefixes.trie(df, bits)) == plain(rows)


def test_screening_proves_most_singletons(spark):
    rows = [(c, t, "user", f"{c if t else 0}-{t}") for c in range(0, 2000, 5) for t in range(4)]
    built = prefixes.rebuilt(spark.createDataFrame(rows, SCHEMA))
    flags = prefixes.screened(built, prefixes.sketch(built.where("depth > 0"))).groupBy("depth", "once").count().collect()
    held = {(r.depth, r.once): r["count"] for r in flags}
    assert (1, True) not in held and held[2, True] > 0.95 * 400 and (2, True) in held


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(9000) for t in range(3)] + [(9001, 0, "user", "other")]
    got = rows_of(prefixes.trie(spark.createDataFrame(rows, SCHEMA)))
    root = got[0, 0]
    assert root[1] == 9001 and got[0, 3][1] >= 8000
    ends = hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert got[0, 3][5] == ends and got[0, 3][3] == 1


def test_odd_tables(spark):
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, "user", "lost"), (7, 1, None, None), (7, 1, None, None), (7, None, "user", "x" * 2_000_000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", depth string")
    assert rows_of(prefixes.trie(df)) == plain(rows)


def test_sql(spark):
    rows = conversations(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    sql = {tuple(r[:2]): tuple(r[2:]) for r in con.execute(prefixes.ORACLE).fetchall()}
    assert sql == plain(rows)
