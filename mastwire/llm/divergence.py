"""How far the words of each source lie from other sources and from their language.

Identical texts of a language are collapsed into one row with a count for each source, so each
distinct text is tokenized once and its terms enter with their weights. A filter of fixed size,
marked from text hashes, proves most texts to occur once: they are tokenized where they lie, and
only texts that may have copies are shuffled. Pairs of sources are evaluated sparsely: a term
that a source lacks has that source's floor share, so a pair's sum is a base of floors, a change
for each term of either side, and a correction for the terms that both sides hold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.llm.filters import holds, marked
from mastwire.llm.store import saved

SCALE = 10**9
LEAST_DOCS = 3
TOP_TERMS = 200
#: Entries of a task's tables before they are sent on, and bytes of a text that are split at a time.
ENTRIES = 1 << 18
STRETCH = 1 << 22

#: A-Z become a-z, other letters and all bytes beyond ASCII stay, everything else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some megabytes at a time; a term longer than that stays whole."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Tables:
    """Occurrences and documents of every term, for each language and source met in a task."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.added = 0

    def add(self, lang: str, text: bytes, sources: list[dict]) -> Iterator[pa.RecordBatch]:
        """Count a text for all its sources; the tables are sent on whenever they are full."""
        if len(sources) == 1 and sources[0]["n"] == 1:
            group, seen = (lang, sources[0]["source"]), set()
            for terms in stretches(text):
                self.counts[group].update(terms)
                seen.update(terms)
            self.docs[group].update(seen)
            yield from self.full()
            return
        found = Counter()
        for terms in stretches(text):
            found.update(terms)
        for s in sources:
            counts, docs, n = self.counts[lang, s["source"]], self.docs[lang, s["source"]], s["n"]
            for term, k in found.items():
                counts[term] += k * n
                docs[term] += n
            yield from self.full()

    def full(self) -> Iterator[pa.RecordBatch]:
        self.added += 1
        if self.added % 32 == 0 and sum(map(len, self.counts.values())) > ENTRIES:
            yield from self.batches()

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.counts.items():
            docs = self.docs[lang, source]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()),
                pa.array(list(counts), pa.binary()).cast(pa.string()),
                pa.array([docs[t] for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64()),
            ], names=["lang", "source", "term", "docs", "n"])
        self.__init__()


def _counted(bits: np.ndarray | None):
    """Rows (lang, text, sources, key) to term tables; with ``bits``, without texts that may have copies."""

    def run(batches):
        tables = _Tables()
        for batch in filter(len, batches):
            if bits is not None:
                batch = batch.filter(pa.array(~holds(bits, batch.column("key").to_numpy())))
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                for row in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(),
                               part.column("sources").to_pylist(), strict=True):
                    yield from tables.add(*row)
        yield from tables.batches()

    return run


def _maybe_repeated(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in filter(len, batches):
            yield batch.filter(pa.array(holds(bits, batch.column("key").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents that hold a term and its occurrences, summed in parts."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.withColumn("key", F.xxhash64("lang", "text"))
    bits = marked(rows.groupBy("key").count().where("count > 1").select("key"))
    single = rows.select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("sources"), "key")
    # A text with copies is shuffled once for each source that holds it, however many copies there are.
    copies = (_maybe_repeated(rows, bits).groupBy("key", "lang", "text", "source").agg(F.count("*").alias("n"))
              .groupBy("key", "lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
              .select("lang", "text", "sources", "key"))
    schema = "lang string, source string, term string, docs long, n long"
    return single.mapInArrow(_counted(bits), schema).unionByName(copies.mapInArrow(_counted(None), schema))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exact; 1 where nothing is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.when(kept > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(total + kept)) + 1).otherwise(
        F.lit(1).cast("long"))


def _far(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others (`pair`) and the
    terms that set it apart from its language (`term`, the ``top_terms`` furthest).

    A null lang, source or text is an empty one. Repeated rows are documents of their own and count as
    often as they come; ties rank by item. Texts of any length are split in stretches. A language
    without kept terms has pairs of value 0; an empty table gives no rows. Columns besides lang,
    source and text are not read.
    """
    every = Window.partitionBy("lang", "term")
    kept = saved(
        term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .select("lang", "term", "source", "n", F.sum("docs").over(every).alias("lang_docs"), F.sum("n").over(every).alias("lang_n"),
                (F.col("source") == F.min("source").over(every)).cast("long").alias("first"))
        .where(F.col("lang_docs") >= least_docs).drop("lang_docs"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
    groups = saved(
        docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        .withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    terms = saved(
        kept.join(groups, ["lang", "source"])
        .withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
        .withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
        .select("lang", "term", "source", "p", "p0", "q"))

    ranked = lambda df: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int"))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    apart = ranked(terms.where("p > q").select("lang", "source", F.col("term").alias("item"), _far("p", "q").alias("value"))).where(
        F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    here = groups.select("lang", "source", "p0", "kept").join(other, "lang").where("source != item")
    floors = here.select("lang", "source", "item", (F.col("kept") * _far("p0", "q0")).alias("value"))
    # Terms of one source with the same count have the same share: one row for all of them.
    alike = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    change = alike.join(other, "lang").where("source != item")
    own = change.select("lang", "source", "item", (F.col("k") * (_far("p", "q0") - _far("p0", "q0"))).alias("value"))
    theirs = change.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                           (F.col("k") * (_far("q0", "p") - _far("q0", "p0"))).alias("value"))
    facing = terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pq"), F.col("p0").alias("q0"))
    shared = terms.join(facing, ["lang", "term"]).where("source != item").select(
        "lang", "source", "item",
        (_far("p", "pq") - _far("p", "q0") - _far("p0", "pq") + _far("p0", "q0")).alias("value"))
    total = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (own, theirs, shared)]
    pairs = floors
    for x in total:
        pairs = pairs.unionByName(x)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return named(ranked(pairs), "pair").unionByName(named(apart, "term"))


ORACLE = r"""
with docs as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text,
           row_number() over () as d
    from documents),
tokens as (
    select lang, source, d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from tokens group by all having count(distinct d) >= 3),
counts as (
    select t.lang, t.source, t.term, count(*)::hugeint as n
    from tokens t join kept k on t.lang = k.lang and t.term = k.term group by all),
sizes as (select lang, count(*)::hugeint as v from kept group by lang),
groups as (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce((select sum(n) from counts c where c.lang = g.lang and c.source = g.source), 0) as total
    from (select distinct lang, source from docs) g left join sizes s on s.lang = g.lang),
shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p
    from groups g join kept k on k.lang = g.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (
    select c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 1)) // (any_value(t.total) + any_value(s.v)) as q
    from counts c join (select lang, sum(n) as total from counts group by lang) t on t.lang = c.lang
    join sizes s on s.lang = c.lang group by c.lang, c.term),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
    from groups a join groups b on a.lang = b.lang and a.source != b.source
    left join shares x on x.lang = a.lang and x.source = a.source
    left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by all),
apart as (
    select s.lang, s.source, s.term as item, ((s.p - w.q) * (s.p - w.q)) // w.q as value
    from shares s join whole w on w.lang = s.lang and w.term = s.term where s.n > 0 and s.p > w.q)
select lang, source, 'pair' as part, item, value::bigint as value,
       (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select lang, source, 'term' as part, item, value::bigint as value, rank from (
    select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from apart) where rank <= 200
"""
