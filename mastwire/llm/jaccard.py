"""Documents whose word n-grams overlap: an exact Jaccard join in sparse matrix blocks.

The document by n-gram incidence matrix is never multiplied whole. A document that reaches the
bound must share one of its ``n - ceil(t n) + 1`` rarest n-grams with its partner, so only those
columns are kept; columns with the same documents are one. Within a column, blocks of documents
are compared: the overlap is bounded from their sizes and from bit rows of their n-grams, and a
pair below the bound is discarded. What is left is counted n-gram by n-gram on the texts.

Only components are asked for, so a block first gives a spanning forest of its likely pairs.
A second round takes the families of sets that likely pairs of different components still join,
multiplies them exactly, two blocks at a time, and gives a forest of the links: no link is lost,
and a large group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.llm.filters import marked, passing
from mastwire.llm.links import components
from mastwire.llm.store import saved
from mastwire.llm.text import shingles, texts, words

#: Bits of the table of n-gram counts that orders the columns; its size does not grow with the corpus.
SKETCH_BITS = 20
RANGES = 64
#: Documents in one side of a compared block.
BLOCK = 1024
EXACT_BLOCK = 512
#: Machine words in one step of a comparison.
STEP_WORDS = 1 << 20


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the n-grams of each hash slot occur in all documents.

    Any order of the n-grams gives the same links; the rarer ones first keep common passages
    out of the columns. Every task counts into a table of fixed size, and the tables are summed
    slot range by slot range.
    """
    slots = 1 << SKETCH_BITS
    width = slots // RANGES

    def count(batches):
        table = np.zeros(slots, dtype=np.int64)
        for batch in filter(len, batches):
            for part in texts(batch.column(0)):
                hashes, _ = shingles(words(part), size)
                table += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=slots)
        parts = []
        for r in range(RANGES):
            own = table[r * width : (r + 1) * width]
            at = np.flatnonzero(own)
            parts.append(zlib.compress(at.astype("<u4").tobytes() + own[at].astype("<i8").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["r", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(part)
                n = len(raw) // 12
                own = sums.setdefault(r, np.zeros(width, dtype=np.int64))
                own[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["r", "part"])

    out = np.zeros(slots, dtype=np.int64)
    for row in docs.select("text").mapInArrow(count, "r int, part binary").repartition("r").mapInArrow(
            add, "r int, part binary").collect():
        out[row.r * width : (row.r + 1) * width] = np.frombuffer(row.part, np.int64)
    return out


def _bit_row(hashes: np.ndarray) -> bytes:
    """A row of at least twice as many bits as n-grams, a power of two, each n-gram's bit set."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    row = np.zeros(bits, dtype=bool)
    row[(hashes >> np.uint64(16)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(row, bitorder="little").tobytes()


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_id, set_id (same n-grams, same id; null without words), n, keys, bits."""
    counts = rarity(docs, size)

    def run(batches):
        for batch in filter(len, batches):
            ids, ns, keys, key_ends, bits = [], [], [], [0], []
            for part in texts(batch.column(2)):
                hashes, bounds = shingles(words(part), size)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.unique(hashes[a:b])
                    n = len(own)
                    ns.append(n)
                    if n:
                        order = np.argsort(counts[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                        keys.append(own[order[: n - -(-percent * n // 100) + 1]])
                        key_ends.append(key_ends[-1] + len(keys[-1]))
                        ids.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                        bits.append(_bit_row(own))
                    else:
                        key_ends.append(key_ends[-1])
                        ids.append(None)
                        bits.append(None)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(key_ends, pa.int32()), pa.array(flat)), pa.array(bits, pa.binary())],
                names=["doc_id", "text_id", "set_id", "n", "keys", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), "text").mapInArrow(
        run, "doc_id long, text_id long, set_id long, n long, keys array<long>, bits binary")


def columns(profile: DataFrame) -> DataFrame:
    """(key, set_id): the sets of every kept column that has two or more, each list of sets once."""
    entries = profile.where("n > 0").select("set_id", F.explode("keys").alias("key"))
    sign = F.xxhash64("set_id")
    # The join back takes the same way at every size, so what is shuffled grows with the corpus.
    # Two sums of half hashes, the count and both ends stand for the list of a column's sets.
    shared = entries.groupBy("key").agg(
        F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("*").alias("c"),
        F.sum(sign.bitwiseAND(0xFFFFFFFF)).alias("x"), F.sum(F.shiftrightunsigned(sign, 32)).alias("y"),
    ).where(F.col("lo") != F.col("hi"))
    lists = saved(shared.groupBy("lo", "hi", "c", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return saved(entries.join(lists.hint("merge"), "key").distinct())


def _matrix(rows: list[bytes], words_: int) -> np.ndarray:
    """Bit rows as machine words, longer ones folded to ``words_``: a bit's place is its low bits."""
    out = np.zeros((len(rows), words_), dtype=np.uint64)
    for i, row in enumerate(rows):
        whole = np.frombuffer(row, dtype=np.uint64)
        out[i] = np.bitwise_or.reduce(whole.reshape(-1, words_), axis=0)
    return out


def likely_pairs(n: np.ndarray, bits: list[bytes], side: np.ndarray | None, percent: int):
    """Pairs (i, j, rate) that the size-derived bounds let through, in blocks of the product.

    Two sets reach the bound when their difference is at most (1 - t) / (1 + t) of the sum of
    their sizes. Bits that only one row has are n-grams that only one set has, so their number
    bounds the difference from below. Sizes within the bound need rows of the same or twice the bits.
    """
    width = np.array([len(b) // 8 for b in bits])
    left, right, rates = [], [], []
    for w in np.unique(width):
        a = np.flatnonzero(width == w)
        b = np.flatnonzero((width == w) | (width == 2 * w))
        rows_a, rows_b = _matrix([bits[i] for i in a], w), _matrix([bits[i] for i in b], w)
        step = max(1, STEP_WORDS // (len(b) * int(w)))
        for at in range(0, len(a), step):
            i, own = a[at : at + step], rows_a[at : at + step]
            apart = np.bitwise_count(own[:, None, :] ^ rows_b[None, :, :]).sum(axis=2, dtype=np.int64)
            total = n[i][:, None] + n[b][None, :]
            near = apart * (100 + percent) <= total * (100 - percent)
            near &= np.minimum(n[i][:, None], n[b][None, :]) * 100 >= percent * np.maximum(n[i][:, None], n[b][None, :])
            near &= (width[b][None, :] > w) | (i[:, None] < b[None, :])
            if side is not None:
                near &= side[i][:, None] != side[b][None, :]
            x, y = np.nonzero(near)
            left.append(i[x])
            right.append(b[y])
            rates.append(apart[x, y] / total[x, y])
    return np.concatenate(left), np.concatenate(right), np.concatenate(rates)


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Pairs of a spanning forest over the labels, the likeliest first (each label's best, again and again)."""
    labels = np.unique(labels, return_inverse=True)[1]
    chosen = []
    while True:
        live = np.flatnonzero(labels[i] != labels[j])
        if not len(live):
            return np.unique(np.concatenate(chosen)) if chosen else live
        ends = np.concatenate((labels[i[live]], labels[j[live]]))
        pairs = np.concatenate((live, live))
        order = np.lexsort((pairs, rate[pairs], ends))
        best = pairs[order[np.unique(ends[order], return_index=True)[1]]]
        chosen.append(best)
        root = np.arange(labels.max() + 1)
        for a, b in zip(labels[i[best]], labels[j[best]], strict=True):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
        labels = root[labels]


def _with_pairs(placed: DataFrame) -> DataFrame:
    """A row for every two blocks that its own block is one of."""
    one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("p"), F.greatest(k, F.col("block")).alias("q")))
    return placed.withColumn("pair", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)))


def _grouped(placed: DataFrame) -> DataFrame:
    """(p, q, rows): the sets of two blocks of a column, for every two blocks."""
    grouped = _with_pairs(placed).groupBy("key", "pair").agg(F.collect_list(F.struct("set_id", "root", "n", "block", "bits")).alias("rows"))
    return grouped.select("pair.p", "pair.q", "rows")


def _candidates(grouped: DataFrame, percent: int, of_sets: bool) -> DataFrame:
    """(a, b) with a below b: a spanning forest of each group's likely pairs between components.

    The forest spans the components, or (``of_sets``) the sets that have such a pair.
    """

    def run(batches):
        for batch in filter(len, batches):
            lists = batch.column(2)
            rows = lists.values
            ids, label, n, side = (rows.field(k).to_numpy() for k in ("set_id", "root", "n", "block"))
            bits, ends = rows.field("bits"), lists.offsets.to_numpy()
            out_a, out_b = [], []
            for g, (p, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = slice(ends[g], ends[g + 1])
                own = label[s]
                if len(own) < 2 or (own == own[0]).all():
                    continue
                i, j, rate = likely_pairs(n[s], bits[s.start : s.stop].to_pylist(), side[s] if p != q else None, percent)
                apart = own[i] != own[j]
                i, j, rate = i[apart], j[apart], rate[apart]
                if len(i):
                    kept = forest(np.arange(len(own)) if of_sets else own, i, j, rate)
                    a, b = ids[s][i[kept]], ids[s][j[kept]]
                    out_a.append(np.minimum(a, b))
                    out_b.append(np.maximum(a, b))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for part in texts(column):
        hashes, bounds = shingles(words(part), size)
        out += [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _texts_of(sets: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, text) of one row for each set; rows that cannot be one are left out before the shuffle."""
    own = saved(info.join(sets, "set_id", "left_semi").select("set_id", "doc_id", "text_id"))
    source = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_text"), "text")
    source = passing(source, "own_text", marked(own.select("text_id")))
    return own.hint("merge").join(source, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_id") == F.col("own_text"))).select("set_id", "text")


def counted(pairs: DataFrame, info: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that truly reach the bound, counted on the texts of one row each."""
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    held = saved(_texts_of(ends, info, docs))
    # Joins that grow with the corpus take the same way at every size.
    both = pairs.hint("merge").join(held.select(F.col("set_id").alias("a"), F.col("text").alias("a_text")), "a").hint("merge").join(
        held.select(F.col("set_id").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches):
        for batch in filter(len, batches):
            keep = []
            for x, y in zip(_sets(batch.column("a_text"), size), _sets(batch.column("b_text"), size), strict=True):
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Overlap counts of all pairs: the incidence matrix times its transpose, some columns at a time."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    # An n-gram that one set has alone adds to no overlap but its own.
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out


def _exact_links(families: DataFrame, info: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between different components inside each family, a spanning forest of every two blocks.

    ``families`` has set_id, family and root. A family is cut to blocks, and every two blocks are
    one group: their sets go to one task, and only a forest of their links leaves it.
    """

    def pack(batches):
        for batch in filter(len, batches):
            packed = [x.tobytes() for x in _sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["set_id", "packed"])

    held = _texts_of(families.select("set_id").distinct(), info, docs).mapInArrow(pack, "set_id long, packed binary")
    held = saved(held.groupBy("set_id").agg(F.first("packed").alias("packed")))
    sizes = saved(families.groupBy("family").agg(F.ceil(F.count("*") / EXACT_BLOCK).cast("int").alias("blocks")))

    def run(batches):
        for batch in filter(len, batches):
            rows = batch.column(2).values
            ids, label, side = (rows.field(k).to_numpy() for k in ("set_id", "root", "block"))
            packed, ends = rows.field("packed"), batch.column(2).offsets.to_numpy()
            for g, (p, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = slice(ends[g], ends[g + 1])
                if len(ids[s]) < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in packed[s.start : s.stop].to_pylist()]
                n = np.array([len(x) for x in sets], dtype=np.float64)
                common = overlaps(sets).astype(np.float64)
                near = 100 * common >= percent * (n[:, None] + n[None, :] - common)
                near &= label[s][:, None] != label[s][None, :]
                if p != q:
                    near &= side[s][:, None] != side[s][None, :]
                i, j = np.nonzero(np.triu(near, 1))
                if len(i):
                    kept = forest(label[s], i, j, 1 - common[i, j] / (n[i] + n[j]))
                    a, b = ids[s][i[kept]], ids[s][j[kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    placed = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).join(held, "set_id")
    met = _with_pairs(placed).groupBy("family", "pair").agg(F.collect_list(F.struct("set_id", "root", "block", "packed")).alias("rows"))
    return met.select("pair.p", "pair.q", "rows").mapInArrow(run, "a long, b long").distinct()


def _places(column: DataFrame, info: DataFrame) -> DataFrame:
    sizes = column.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = saved(sizes)
    return column.join(sizes, "key").join(info, "set_id").select(
        "key", "set_id", "n", "bits", "blocks", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"))


def linked_sets(docs: DataFrame, profile: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root): sets of n-grams that are linked with another, with their component."""
    column = columns(profile)
    needed = column.select("set_id").distinct()
    info = saved(profile.select("set_id", "doc_id", "text_id", "n", "bits").join(needed, "set_id", "left_semi").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_id")).alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        .select("set_id", "row.doc_id", "row.text_id", "n", "bits"))
    placed = saved(_places(column, info.select("set_id", "n", "bits")))
    first = saved(_candidates(_grouped(placed.withColumn("root", F.col("set_id"))), percent, of_sets=False))
    links = saved(counted(first, info, docs, size, percent))
    roots = saved(components(links, "a", "b"))
    labelled = placed.join(roots, placed["set_id"] == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    left = saved(_candidates(_grouped(labelled), percent, of_sets=True))
    if left.isEmpty():
        return roots
    families = components(left, "a", "b").select(F.col("node").alias("set_id"), F.col("root").alias("family"))
    families = saved(families.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "family", F.coalesce("root", "set_id").alias("root")))
    rest = saved(_exact_links(families, info, docs, size, percent))
    return roots if rest.isEmpty() else components(links.unionByName(rest), "a", "b")


def clusters(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two rows link when ``100 * common >= percent * union`` of their distinct n-grams; rows of
    fewer words have their whole sequence as one n-gram; null and empty texts have none and link
    with nothing. Repeated rows link like copies. A null doc_id is never the smallest, so a
    component of null ids alone has a null id. Other columns are not read.
    """
    profile = saved(profiles(docs, size, percent))
    return _named(profile, linked_sets(docs, profile, size, percent)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _named(profile: DataFrame, roots: DataFrame) -> DataFrame:
    firsts = profile.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = firsts.join(roots, firsts["set_id"] == roots["node"], "left").select(
        "set_id", "least", F.coalesce("root", "set_id").alias("root"))
    named = saved(named)
    least = saved(named.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = saved(named.join(least, "root").select("set_id", "component_id", "root"))
    # Rows without n-grams have a set of their own.
    rows = profile.where("n > 0").select("doc_id", "text_id", "n", "set_id").join(ids, "set_id")
    bare = profile.where("n = 0").select(
        "doc_id", "text_id", "n", F.lit(None).cast("long").alias("set_id"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return rows.select(bare.columns).unionByName(bare)


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component: the smallest doc_id (null last), repeated rows once.

    Rows without words link with nothing and all stay.
    """
    profile = saved(profiles(docs, size, percent))
    rows = _named(profile, linked_sets(docs, profile, size, percent))
    order: Column = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("keep_id"), F.col("text_id").alias("keep_text"))
    kept = saved(rows.where("root is not null").groupBy("root").agg(F.min(order).alias("row")).select("row.keep_id", "row.keep_text"))
    own = docs.withColumn("__text_id", F.xxhash64("text"))
    chosen = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("__text_id") == F.col("keep_text")), "left_semi")
    repeated = saved(rows.groupBy("doc_id", "text_id").agg(F.count("*").alias("c")).where("c > 1").select(
        F.col("doc_id").alias("keep_id"), F.col("text_id").alias("keep_text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("__text_id") == F.col("keep_text"))
    once = chosen.join(repeated, same, "left_anti")
    again = chosen.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__text_id"])
    bare = own.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return once.unionByName(again).unionByName(bare).select(docs.columns)
