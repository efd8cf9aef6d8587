"""Benchmark items in documents, also with other numbers, names and units.

Words become templates: a number, a unit after it and a name inside a sentence are typed
placeholders. Items of one template, a family, are one form, so that a window all of them hold is
one row of the join. Beside the windows of templates stand exact windows of the folded words. Where
a document meets a form, its values are set against those of each item: a copy maps each value of
the item to one value of the document.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mastwire.llm.filters import holds, marked
from mastwire.llm.repeats import keyed
from mastwire.llm.store import saved
from mastwire.llm.text import Texts, Words, shingles, texts, words

WINDOW = 8
#: A window of a template needs as many plain words to say anything.
MIN_PLAIN = 4
#: A document holds an item when it has half of the item's windows, or as many as this in a row or apart.
SHARE = 0.5
ENOUGH = 10
#: Keeps hashes of exact windows apart from those of templates.
EXACT = np.uint64(0x5851F42D4C957F2D)

NUMBER, NAME, UNIT = 1, 2, 3
#: Words that are units when a number stands before them.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year "
    "years mph kmh km/h c f k j kj cal kcal w kw v a hz khz mhz ghz dollar dollars cent cents euro euros usd eur percent degree degrees"
).split()

_KEPT = np.zeros(256, dtype=bool)
_KEPT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 58, 59, 63]] = True


def _unit_hashes() -> np.ndarray:
    part = next(texts(pa.array([" ".join(UNITS)])))
    return np.sort(words(part, _KEPT).hashes)


def _solid(part: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words with a byte that counts, their documents, and how many such bytes they have."""
    found = words(part, _KEPT)
    kept = np.concatenate(([0], np.cumsum(_KEPT[part.data])))
    n_kept = kept[found.ends] - kept[found.starts]
    doc = np.repeat(np.arange(len(part.starts)), np.diff(found.bounds))
    real = n_kept > 0
    doc = doc[real]
    bounds = np.searchsorted(doc, np.arange(len(part.starts) + 1))
    return Words(found.starts[real], found.ends[real], found.hashes[real], bounds), doc, n_kept[real]


def canonical(part: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words whose hashes are those of the templates, the words' own hashes, and their kinds (0: plain)."""
    found, doc, n_kept = _solid(part)
    starts, ends, hashes, bounds = found.starts, found.ends, found.hashes, found.bounds
    data = part.data
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    kinds = np.where(digits[ends] - digits[starts] == n_kept, NUMBER, 0)
    first = data[starts] if len(starts) else np.empty(0, np.uint8)
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else first
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    opens = np.ones(len(starts), dtype=bool)  # a capital here may be the sentence's
    if len(starts) > 1:
        opens[1:] = (doc[1:] != doc[:-1]) | _STOP[data[ends[:-1] - 1]] | (data[starts[1:] - 1] == 10)
    kinds[(kinds == 0) & capital & ~opens] = NAME
    units = _unit_hashes()
    if len(starts) > 1:
        is_unit = units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes
        kinds[1:][is_unit[1:] & (kinds[:-1] == NUMBER) & (doc[1:] == doc[:-1])] = UNIT
    template = np.where(kinds > 0, kinds.astype(np.uint64), hashes)
    return Words(starts, ends, template, bounds), hashes, kinds


def _places(found: Words, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every window's document, place, hash, first word and end among all words, and number of plain words."""
    hashes, bounds = shingles(found, WINDOW)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(hashes)) - bounds[doc]
    at = found.bounds[doc] + place
    stop = np.minimum(at + WINDOW, found.bounds[doc + 1])
    plain = np.concatenate(([0], np.cumsum(kinds == 0)))
    return doc, place, hashes, at, stop, plain[stop] - plain[at]


def windows(column: pa.Array, passed: np.ndarray | None = None):
    """(row, place, hash, values): windows of every text's template that hold placeholders, with their words in order."""
    for part in texts(column):
        found, values, kinds = canonical(part)
        doc, place, hashes, at, stop, plain = _places(found, kinds)
        live = (plain >= np.minimum(MIN_PLAIN, stop - at)) & (plain < stop - at)
        if passed is not None:
            live &= holds(passed, hashes)
        live = np.flatnonzero(live)
        inside = at[live][:, None] + np.arange(WINDOW)[None, :]
        taken = inside < stop[live][:, None]
        inside = np.where(taken, inside, 0)
        taken &= kinds[inside] > 0 if len(kinds) else False
        ends = np.concatenate(([0], np.cumsum(taken.sum(axis=1)))).astype(np.int32)
        yield (doc[live] + part.first, place[live], hashes[live].view(np.int64), pa.ListArray.from_arrays(
            pa.array(ends), pa.array(values[inside[taken]].view(np.int64))))


def _folded(column: pa.Array) -> pa.Array:
    """Lower case of any alphabet, with one form for the letters whose capitals lower to others."""
    low = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    return pc.replace_substring(pc.replace_substring(low, "ß", "ss"), "ς", "σ")


def exact_windows(column: pa.Array, sizes: list[int], passed: np.ndarray | None = None):
    """(row, place, hash): windows of the folded words themselves, of each size, of the texts that have as many."""
    for part in texts(_folded(column)):
        found, _, _ = _solid(part)
        n = np.diff(found.bounds)
        for size in sizes:
            hashes, bounds = shingles(found, size)
            hashes = hashes ^ EXACT
            doc = np.repeat(np.arange(len(n)), np.diff(bounds))
            live = n[doc] >= size
            if passed is not None:
                live &= holds(passed, hashes)
            live = np.flatnonzero(live)
            yield doc[live] + part.first, (np.arange(len(hashes)) - bounds[doc])[live], hashes[live].view(np.int64)


def _windowed(rows: DataFrame, key: str, sizes: list[int], passed: np.ndarray) -> DataFrame:
    """(key, place, hash, values) of the windows of ``rows`` (key, text); exact ones have no values."""

    def run(batches):
        def out(keys, row, place, hashes, values):
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(hashes), values], names=[key, "place", "hash", "values"])

        for batch in filter(len, batches):
            for row, place, hashes, values in windows(batch.column(1), passed):
                if len(row):
                    yield out(batch.column(0), row, place, hashes, values)
            for row, place, hashes in exact_windows(batch.column(1), sizes, passed):
                if len(row):
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array([], pa.int64()))
                    yield out(batch.column(0), row, place, hashes, none)

    return rows.select(key, "text").mapInArrow(run, f"{key} long, place int, hash long, values array<long>")


def _items(benchmark: DataFrame) -> DataFrame:
    """A row per item: its form, words, and by place the hashes and whether the template says anything there.

    ``slots`` are the places of the placeholders among the words, ``own`` the item's words there.
    """
    names = ["item_id", "templates", "slots", "own", "typed", "live", "exact"]

    def run(batches):
        for batch in filter(len, batches):
            exact = defaultdict(list)
            for part in texts(_folded(batch.column(1))):
                found, _, _ = _solid(part)
                hashes, bounds = shingles(found, WINDOW)
                for i in range(len(bounds) - 1):
                    exact[part.first + i] = (hashes[bounds[i] : bounds[i + 1]] ^ EXACT).view(np.int64).tolist()
            rows = []
            for part in texts(batch.column(1)):
                found, values, kinds = canonical(part)
                doc, _, hashes, at, stop, plain = _places(found, kinds)
                live = plain >= np.minimum(MIN_PLAIN, stop - at)
                some = live & (plain < stop - at)
                first = np.searchsorted(doc, np.arange(len(part.starts) + 1))
                for i in range(len(part.starts)):
                    word, window = slice(*found.bounds[i : i + 2]), slice(*first[i : i + 2])
                    slots = np.flatnonzero(kinds[word])
                    rows.append((
                        batch.column(0)[part.first + i].as_py(), found.hashes[word].view(np.int64).tolist(), slots.tolist(),
                        values[word][slots].view(np.int64).tolist(),
                        [h if s else None for h, s in zip(hashes[window].view(np.int64).tolist(), some[window].tolist(), strict=True)],
                        live[window].tolist(), exact[part.first + i]))
            kinds_ = [pa.int64(), *(pa.list_(x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_, strict=True)], names=names)

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parsed = rows.mapInArrow(run, "item_id long, templates array<long>, slots array<int>, own array<long>, "
                                  "typed array<long>, live array<boolean>, exact array<long>").where(F.size("templates") > 0)
    says = F.size(F.filter("live", lambda x: x))
    half = lambda n: F.ceil(n * SHARE).cast("int")
    return parsed.select(
        "*", F.xxhash64("templates", "slots").alias("form"), F.xxhash64("item_id", "templates", "own", "exact").alias("item_key"),
        F.size("exact").alias("n"), says.alias("n_live")).withColumn(
        "need", F.least(F.lit(ENOUGH), half(F.col("n")), F.when(F.col("n_live") > 0, half(F.col("n_live")))))


def agreeing(run: list[tuple], slots: list[int], own: list[int], exact: list[int]) -> tuple[list[int], bool]:
    """Places of one run (place, hash, values) that fit the item, and whether all its values are the item's own.

    In a run a word of the item meets one word of the document. Each value is mapped to the word
    that it meets most often, to itself among equals; windows that hold the item's own values always fit,
    and so do those that follow the map. Two values may meet one word. Where more windows break
    the map than follow it, the others are other text in the same form and only the item's own stay.
    """
    item = dict(zip(slots, own, strict=True))
    typed, plain, met = {}, set(), {}
    for place, hash_, values in run:
        inside = [w for w in range(place, place + WINDOW) if w in item]
        if values:
            typed[place] = inside
            met.update(zip(inside, values, strict=True))
        elif exact[place] == hash_:
            plain.add(place)
            met.update((w, item[w]) for w in inside)
    mine = plain | {p for p, inside in typed.items() if all(met[w] == item[w] for w in inside)}
    votes: dict[int, Counter] = defaultdict(Counter)
    for w, value in met.items():
        votes[item[w]][value] += 1
    to = {v: max(c, key=lambda x: (c[x], x == v, x)) for v, c in votes.items()}
    kept = mine | {p for p, inside in typed.items() if all(met[w] == to[item[w]] for w in inside)}
    broken = len(typed.keys() - kept)
    return (sorted(kept), not broken and kept == mine) if len(kept) > broken else (sorted(mine), False)


def _fitting(runs: DataFrame) -> DataFrame:
    """(doc_key, item_id, item_key, n, n_live, own, place, live): places of the runs that fit their item."""

    def run(batches):
        for batch in filter(len, batches):
            lines = batch.to_pylist()
            rows = []
            for x in lines:
                kept, same = agreeing([(w["place"], w["hash"], w["values"]) for w in x["run"]], x["slots"], x["own"], x["exact"])
                rows += [(x["doc_key"], x["item_id"], x["item_key"], x["n"], x["n_live"], same, p, x["live"][p]) for p in kept]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["doc_key", "item_id", "item_key", "n", "n_live", "same", "place", "live"])

    return runs.select("doc_key", "item_id", "item_key", "n", "n_live", "slots", "own", "exact", "live", "run").mapInArrow(
        run, "doc_key long, item_id long, item_key long, n int, n_live int, same boolean, place int, live boolean")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_key, doc_id, item_id, windows, item_windows, share, exact): the items that documents hold.

    ``exact`` says that all values are the item's own; otherwise some were replaced. Of a family
    (items of one template) a document with other values holds every item that its values fit.
    An item of fewer words than a window is found wherever its words stand, and with other values
    where it is a whole text. Null and empty texts hold nothing and are held by nothing; items
    without an id take no part, items of one id are one. Repeated rows of a document give one row;
    other columns are not read.
    """
    items = saved(_items(benchmark))
    sizes = [WINDOW, *sorted(r.w for r in items.where(F.size("templates") < WINDOW).select(F.size("templates").alias("w")).distinct().collect())]
    at = lambda c: items.select("form", "need", "n", F.posexplode(c).alias("item_place", "hash")).where("hash is not null")
    known = saved(at("exact").unionByName(at("typed")).distinct())
    # A document that holds an item meets one of its places even without the need - 1 most common ones.
    often = known.groupBy("hash").agg(F.count_distinct("form").alias("forms"))
    rare = Window.partitionBy("form").orderBy("forms", "item_place")
    chosen = known.join(often, "hash").groupBy("form", "item_place").agg(
        F.max("forms").alias("forms"), F.max(F.col("n") - F.col("need") + 1).alias("most")).withColumn("at", F.row_number().over(rare)).where(
        F.col("at") <= F.col("most"))
    asked = known.join(chosen.select("form", "item_place"), ["form", "item_place"]).select("hash", "form").distinct()
    rows = keyed(docs)
    seen = saved(_windowed(rows, "doc_key", sizes, marked(known.select("hash"))).distinct())
    likely = saved(seen.select("doc_key", "hash").join(asked, "hash").select("doc_key", "form").distinct())
    met = saved(seen.join(likely, "doc_key").join(known, ["form", "hash"]))
    full = met.groupBy("doc_key", "form").agg(F.count_distinct("item_place").alias("c"), F.max("need").alias("need")).where("c >= need")
    runs = met.join(full.select("doc_key", "form"), ["doc_key", "form"]).withColumn("shift", F.col("place") - F.col("item_place")).groupBy(
        "doc_key", "form", "shift").agg(F.collect_set(F.struct(F.col("item_place").alias("place"), "hash", "values")).alias("run"))
    found = _fitting(runs.join(items, "form")).groupBy("doc_key", "item_id", "item_key").agg(
        F.count_distinct("place").cast("long").alias("windows"), F.count_distinct(F.when(F.col("live"), F.col("place"))).alias("live"),
        F.max("n").cast("long").alias("item_windows"), F.max("n_live").alias("n_live"), F.min("same").alias("exact"))
    held = found.where(
        (F.col("windows") >= F.ceil(F.col("item_windows") * SHARE)) | (F.col("windows") >= ENOUGH)
        | (F.col("n_live") > 0) & (F.col("live") >= F.ceil(F.col("n_live") * SHARE)))
    share = (F.col("windows") / F.col("item_windows")).alias("share")
    best = saved(held.groupBy("doc_key", "item_id").agg(F.max(F.struct(share, "windows", "item_windows", "exact")).alias("best")))
    ids = rows.select("doc_key", "doc_id").distinct()
    return best.join(ids, "doc_key").select(
        "doc_key", "doc_id", "item_id", "best.windows", "best.item_windows", "best.share", "best.exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    held = leaks(docs, benchmark).select(F.col("doc_key").alias("__held")).distinct()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    return docs.withColumn("__key", key).join(held, F.col("__key") == F.col("__held"), "left_anti").select(docs.columns)
