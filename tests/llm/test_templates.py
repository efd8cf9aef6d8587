import re

import pytest

from mastwire.llm import templates
from mastwire.llm.store import table

ITEM = ("A farmer named Alice sells 12 apples at the market for 3 dollars each morning, and then Alice gives 5 apples to Bob "
        "before walking 2 km back to the farm where Bob waits. How many apples does Alice have left in the end?")
OTHER = ITEM.replace("Alice", "Mary").replace("Bob", "Tom").replace("12", "48").replace(" 5 ", " 7 ").replace("3", "9").replace("2 km", "6 miles")
MIXED = ITEM.replace("Alice gives", "Greta gives").replace("does Alice", "does Henry").replace("where Bob", "where Alice")
FILL = "Some words that stand around it in the text of a page, one after the other, and say nothing of farms at all. "


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (None, ITEM, 0), (4, "Short item here", 0)],
                                 "item_id long, text string, doc_id int")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in templates.leaks(docs, bench).collect()}


def test_copies_and_reparameterised_copies(spark, bench):
    texts = {0: FILL + ITEM + " " + FILL, 1: FILL + OTHER, 2: FILL * 3, 3: None, 4: "", 5: "(" + ITEM.replace(" ", "\n ").lower() + ")",
             6: "short item here", 7: FILL + " ".join(ITEM.split()[:12]) + " " + FILL, 8: OTHER + " " + ITEM, 9: ITEM * 3}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "x"), (None, ITEM, "x")],
                                 "doc_id long, text string, item_id string")
    got = found(docs, bench)
    assert {k for k in got} >= {(0, 1), (1, 1), (8, 1), (9, 1), (6, 4), (None, 1)}
    assert {d for d, _ in got} & {2, 3, 4, 7} == set()
    assert got[0, 1].exact and got[9, 1].exact and not got[1, 1].exact and got[0, 1].share == 1
    kept = templates.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 7} | ({5} - {d for d, _ in got})


def test_values_must_fit_one_to_one(spark, bench):
    """Only the windows that stand in the text word for word count where the others break the map."""
    got = found(spark.createDataFrame([(0, MIXED)], "doc_id long, text string"), bench)
    assert set(got) == {(0, 1)} and got[0, 1].windows == 17 and not got[0, 1].exact
    # Long texts are taken whole; of two items with one text both are named.
    both = bench.unionByName(spark.createDataFrame([(21, ITEM, 0)], "item_id long, text string, doc_id int"))
    assert set(found(spark.createDataFrame([(5, FILL * 20_000 + ITEM)], "doc_id long, text string"), both)) == {(5, 1), (5, 21)}


def test_given_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    plain = lambda t: [w for w in (re.sub(r"[^a-z0-9\u0080-￿]", "", x.lower()) for x in t.split()) if w]
    known = {r.item_id: " " + " ".join(plain(r.text)) + " " for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in known.items() if t in " " + " ".join(plain(d.text)) + " "}
    got = set(found(docs, items))
    assert len(want) > 10 and want <= got
    assert len({d for d, _ in got}) <= len({d for d, _ in want}) + 2


def test_nothing(spark, bench):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert templates.leaks(docs.limit(0), bench).count() == 0
    assert templates.leaks(docs, bench.limit(0)).count() == 0
    assert templates.without_leaks(docs, bench.limit(0)).count() == 1


def test_families_are_reported_whole(spark):
    item = "A shop sells {} pens and {} books on a quiet day, so how many things does the shop sell in all on {} days of that kind?"
    family = [(i, item.format(i + 20, i + 60, i + 100)) for i in range(30)] + [(100 + i, ITEM) for i in range(25)]
    docs = spark.createDataFrame([(0, FILL + family[3][1] + FILL), (1, FILL + item.format(7, 8, 9)), (2, FILL), (3, FILL + ITEM)], "doc_id long, text string")
    got = found(docs, spark.createDataFrame(family, "item_id long, text string"))
    assert {i for d, i in got if d == 0} == set(range(30)) and {i for d, i in got if d == 1} == set(range(30))
    assert [i for i in range(30) if got[0, i].exact] == [3] and not any(got[1, i].exact for i in range(30))
    assert {i for d, i in got if d == 3} == set(range(100, 125)) and all(got[3, i].exact for i in range(100, 125))
    assert {d for d, _ in got} == {0, 1, 3}


def test_exact_copies_in_any_case_and_short_items(spark, bench):
    german = "Der alte Müller trägt am Montag die großen Säcke aus der Mühle zum Markt und verkauft dort das Mehl an Bäcker Weiß."
    items = bench.select("item_id", "text").unionByName(spark.createDataFrame(
        [(10, "What is 12 times 7"), (11, "Anna 3 Bob 4 Carl 5 Dora 6 Emil 7 Fritz 8 Gerd 9"), (12, german)], "item_id long, text string"))
    texts = {0: ITEM.lower(), 1: ITEM.upper(), 2: FILL + "Now: what is 12 times 7? " + FILL, 3: FILL + "Anna 3 Bob 4 Carl 5 Dora 6 Emil 7 Fritz 8 Gerd 9",
             4: german.upper(), 5: german.lower(), 6: FILL + "what is 12 times 8? " + FILL, 7: FILL + "a short item here " + FILL,
             8: "(" + ITEM.replace(" ", "\n ").lower() + ")"}
    got = found(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), items)
    assert set(got) == {(0, 1), (1, 1), (2, 10), (3, 11), (4, 12), (5, 12), (7, 4), (8, 1)}
    assert all(r.share == 1 and r.exact for r in got.values())


def test_one_clash_does_not_discard_the_copy(spark, bench):
    texts = {0: ITEM.replace("12", "4").replace(" 5 ", " 4 "), 1: ITEM.replace("does Alice", "does Greta"), 2: OTHER.replace("48", "7"),
             3: OTHER.replace("does Mary", "does Jane")}
    got = found(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench)
    assert set(got) == {(d, 1) for d in texts} and not any(r.exact for r in got.values())
    assert got[1, 1].windows == 31  # all but the six windows of the edited name
