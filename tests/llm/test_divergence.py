import random
import re
from collections import Counter, defaultdict

from mastwire.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= 3)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in kept)
            counts[None].update(t for t in terms if t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts.keys() - {None}:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts.keys() - {None, s}]
            term = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pair), ("term", term)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, *x, k) for k, x in enumerate(items, 1) if part == "pair" or k <= 200}
    return out


def test_against_plain_sums(spark):
    rng = random.Random(5)
    words = ["the", "The", "été", "Éa", "x1y", "a_b", "日本", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(18) for j in range(18)]
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "c"])))
    rows += [(1000 + i, "the very same text", "en", "ab"[i % 2]) for i in range(70)] + [(5, None, "en", "d"), (None, "", "xx", "z")]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)


def test_long_texts_split_where_terms_end(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 7)
    text = "Alpha beta, gammadeltaepsilon 12 é\nlast".encode()
    assert [t for part in divergence.stretches(text) for t in part] == [b"alpha", b"beta", b"gammadeltaepsilon", "é".encode(), b"last"]


def test_full_tables_are_sent_on(spark, monkeypatch):
    tables = divergence._Tables()
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    sent = [b for i in range(200) for b in tables.add("en", b"a%d b%d " % (i, i) + bytes([97 + i % 26]), [{"source": "s", "n": 1 + i % 2}])]
    sent += list(tables.batches())
    assert len(sent) > 2 and sum(sum(b.column("n").to_pylist()) for b in sent) == sum(3 * (1 + i % 2) for i in range(200))


def test_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x", "en", "a"), (1, "x", "en", "a"), (2, "long " * 400_000, "en", "b"), (3, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n long, term long")
    assert {tuple(r) for r in divergence.audit(df).collect()} == plain(rows)
