"""Conversations as a trie of shared prefixes.

A prefix is named by a digest: the exclusive or of one hash for each of its turns, each hash keyed
by the turn's place. Two 64-bit digests name it, so no text is shuffled. All prefix digests are
counted in a count-min sketch of bounded size. An estimate never lies below the truth, so an
estimate of one proves that a single conversation holds the prefix, and with it every longer one:
these tails are emitted where they lie. Only prefixes that may be shared are grouped exactly.

Sums over subtrees need no walk by depth. A node belongs to its smallest member, so each
conversation owns a path of nodes to its end, and a subtree's sum is the sum over its members
of what their paths hold there.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.llm.store import saved

FAMILY = 5
HEADS = 9
#: Cells of a sketch row: four for each prefix, rounded up to a power of two, within these bounds.
LEAST_BITS, MOST_BITS = 10, 24
SKETCH_ROWS = 4
RANGES = 64
#: Members of a node are joined in pieces of ids from one range of so many.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "g1", "g2"]
PARENT = ["depth - 1 AS depth", "p1 AS g1", "p2 AS g2"]


def head(conv: Column) -> Column:
    """Turns that a conversation takes from the first one of its family."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """One row for each turn of a rebuilt conversation, and one of depth 0 for the conversation itself.

    conv_id, depth, length (turns of the conversation), bytes (of the turn's text), digests of the
    prefix that ends here (g1, g2), of the one before (p1, p2) and of the whole (e1, e2).
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("content"), F.octet_length("text").cast("long").alias("bytes"),
             (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family"))
    # A family meets in one task; both windows then lie in the same partitioning.
    original = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    rows = rows.repartition("family").withColumn("i", F.row_number().over(original))
    place = lambda conv, part: F.struct(conv.alias("conv_id"), F.lit(part).alias("part"))
    uses = F.array_compact(F.array(
        F.when(F.col("i") == 1, place(F.col("conv_id"), 0)),
        F.when(F.col("i") > head(F.col("conv_id")), place(F.col("conv_id"), 2)),
        *(F.when((F.col("conv_id") == F.col("family")) & (F.col("i") <= head(F.col("family") + k)), place(F.col("family") + k, 1))
          for k in range(FAMILY)),
    ))
    rows = rows.select("family", "i", "role", "content", "bytes", F.explode(uses).alias("use")).select(
        "family", "use.*", "i", "role", "content", "bytes")
    whole = Window.partitionBy("family", "conv_id")
    order = whole.orderBy("part", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Part 0 is the conversation's own mark; without it the conversation does not occur.
    rows = rows.withColumn("depth", F.row_number().over(whole.orderBy("part", "i")) - 1).withColumn(
        "occurs", F.min("part").over(whole) == 0).where("occurs")
    for j in ("1", "2"):
        rows = rows.withColumn("t" + j, F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
            F.xxhash64(F.lit(int(j)), "depth", "role", "content")))
    return rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), (F.count("*").over(whole) - 1).alias("length"),
        F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.col("bytes")).alias("bytes"),
        *(F.bit_xor("t" + j).over(order).alias("g" + j) for j in "12"),
        *(F.bit_xor("t" + j).over(order).bitwiseXOR(F.col("t" + j)).alias("p" + j) for j in "12"),
        *(F.bit_xor("t" + j).over(whole).alias("e" + j) for j in "12"))


def _cells(g1: np.ndarray, g2: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cell of each prefix in every row of the sketch: bits of the two digests."""
    mask = np.uint64((1 << bits) - 1)
    a, b = g1.view(np.uint64), g2.view(np.uint64)
    return [(x & mask).astype(np.int64) for x in (a, b, a >> np.uint64(32), b >> np.uint64(32))]


def sketch(rows: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Count-min sketch of all prefixes, cells counted up to two; SKETCH_ROWS by a power of two, at most 64 MB.

    Past the bound more cells are shared, so fewer tails are proven and more rows are grouped exactly.
    """
    n = rows.count()
    bits = min(max(LEAST_BITS, (4 * n).bit_length()), most_bits)
    size = SKETCH_ROWS << bits
    width = size // RANGES

    def parts(table: np.ndarray, ranges) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int32()), pa.array(
            [zlib.compress(table[r].tobytes(), 1) for r in ranges], pa.binary())], names=["r", "part"])

    def count(batches):
        table = np.zeros(size, dtype=np.uint8)
        for batch in filter(len, batches):
            for k, cell in enumerate(_cells(batch.column("g1").to_numpy(), batch.column("g2").to_numpy(), bits)):
                cell, often = np.unique(cell, return_counts=True)
                at = cell + (k << bits)
                table[at] = np.minimum(table[at] + np.minimum(often, 2), 2)
        if table.any():
            yield parts(table.reshape(RANGES, width), range(RANGES))

    def merge(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, part in zip(batch.column("r").to_pylist(), batch.column("part").to_pylist(), strict=True):
                raw = np.frombuffer(zlib.decompress(part), np.uint8)
                out[r] = np.minimum(out[r] + raw, 2) if r in out else raw
        if out:
            yield parts(out, out)

    table = np.zeros((RANGES, width), dtype=np.uint8)
    for row in (rows.select("g1", "g2").mapInArrow(count, "r int, part binary").repartition("r")
                .mapInArrow(merge, "r int, part binary").collect()):
        table[row.r] = np.frombuffer(zlib.decompress(row.part), np.uint8)
    return table.reshape(SKETCH_ROWS, -1)


def screened(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows with three flags: whether this prefix, the one before and the whole are proven to be held once."""
    bits = table.shape[1].bit_length() - 1
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        cells = shared.value
        for batch in filter(len, batches):
            column = lambda name, batch=batch: batch.column(name).to_numpy()
            flags = []
            for x, depth in (("g", column("depth")), ("p", column("depth") - 1), ("e", column("length"))):
                estimate = np.min([cells[k][c] for k, c in enumerate(_cells(column(x + "1"), column(x + "2"), bits))], axis=0)
                flags.append(pa.array((estimate == 1) & (depth > 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "once", "parent_once", "end_once"])

    names = ", ".join(f"{c} long" for c in rows.columns)
    return rows.mapInArrow(run, names + ", once boolean, parent_once boolean, end_once boolean")


def _ends(ended: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending: pieces of bounded size, digested in their order."""
    pieces = (ended.groupBy(*KEY, F.floor(F.col("conv_id") / PIECE).alias("piece"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    names = [*KEY, "ends_sha256"]

    def run(batches):
        key = state = None
        for batch in filter(len, batches):
            out = []
            for *now, _, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece", "ids")), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest()), strict=True))], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(run, "depth long, g1 long, g2 long, ends_sha256 string")


def trie(turns: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Null turns come first and null roles and texts are empty. Turns of one number are ordered by role,
    then by the MD5 of their text; repeated rows are turns of their own. Rows without conv_id belong
    to no conversation. An empty table has no node, not even a root. Texts enter by their digest, so
    their length does not matter; columns besides the four are not read.
    """
    rows = saved(rebuilt(turns))
    table = sketch(rows.where("depth > 0"), most_bits)
    rows = saved(screened(rows, table))
    maybe = rows.where(~F.col("once"))

    nodes = maybe.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("end_once").cast("long")).alias("tails"))
    nodes = saved(nodes)
    first = rows.where("once AND NOT parent_once")
    children = first.selectExpr(*PARENT).unionByName(nodes.where("depth > 0").selectExpr(*PARENT)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, KEY, "left").fillna(0, ["n_children"])
                  .withColumn("spared", (F.col("n_convs") - 1) * F.col("bytes")))

    # What each path holds, brought to all nodes that its conversation is a member of.
    paths = nodes.groupBy("conv_id").agg(F.sum("spared").alias("spared"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")).where(
        "spared > 0 OR leaves > 0")
    below = maybe.select(*KEY, "conv_id").join(paths, "conv_id").groupBy(*KEY).agg(
        F.sum("spared").alias("below"), F.sum("leaves").alias("leaves"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    nodes = (nodes
             .withColumn("above", F.coalesce(F.sum("spared").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("starts", F.row_number().over(path) == 1))
    ends = _ends(maybe.where("depth = length").select(*KEY, "conv_id"))
    nodes = saved(
        nodes.join(below, KEY, "left").join(ends, KEY, "left").fillna(0, ["below", "leaves"]).fillna(EMPTY, ["ends_sha256"])
        .select(*KEY, "p1", "p2", "starts", "conv_id", "n_convs", "n_children", (F.col("tails") + F.col("leaves")).alias("n_leaves"),
                (F.col("below") - F.col("above")).alias("saved_tokens"), "ends_sha256"))

    # Only where a path starts does the node before belong to another conversation.
    tail_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY))
    tail = [F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), tail_end.alias("ends_sha256")]
    values = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = nodes.select(F.col("conv_id").alias("parent_conv_id"), *KEY)
    beginning = (nodes.where("starts AND depth > 0").select("conv_id", "depth", "p1", "p2", *values)
                 .unionByName(first.select("conv_id", "depth", "p1", "p2", *tail)))
    beginning = beginning.selectExpr("conv_id", "depth AS own_depth", *PARENT, *values).join(above, KEY, "left").select(
        "conv_id", F.col("own_depth").alias("depth"), F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), *values)
    same = F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    rest = nodes.where("NOT starts OR depth = 0").select("conv_id", "depth", same, *values)
    alone = rows.where("once AND parent_once").select("conv_id", "depth", same, *tail)
    return alone.unionByName(rest).unionByName(beginning)


ORACLE = r"""
with ordered as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as i
    from conversations where conv_id is not null),
sums as (
    select conv_id, 4294967295 - list_reduce([4294967295::bigint] || list_transform(split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
        lambda crc, b: list_reduce([xor(crc, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
            lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)) as crc
    from (select distinct conv_id from ordered)),
heads as (select conv_id, conv_id - conv_id % 5 as family, crc % 9 as h from sums),
parts as (
    select h.conv_id, 1 as part, o.i, o.role, o.text from heads h join ordered o on o.conv_id = h.family and o.i <= h.h
    union all select h.conv_id, 2, o.i, o.role, o.text from heads h join ordered o on o.conv_id = h.conv_id and o.i > h.h),
turns as (
    select conv_id, row_number() over w as depth, strlen(text) as bytes,
           string_agg(md5(length(role) || ':' || role || text), ',') over w as prefix
    from parts window w as (partition by conv_id order by part, i)),
rows as (
    select conv_id, 0 as depth, 0 as bytes, '' as prefix from heads
    union all select * from turns),
lengths as (select conv_id, max(depth) as length from rows group by conv_id),
nodes as (
    select depth, prefix, min(r.conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
           sha256(coalesce(string_agg(r.conv_id::varchar, ',' order by r.conv_id) filter (where depth = length), '')) as ends_sha256
    from rows r join lengths l on l.conv_id = r.conv_id group by depth, prefix),
linked as (
    select r.conv_id as member, r.depth, r.prefix, n.conv_id, lag(n.conv_id) over w as parent_conv_id, lead(n.conv_id) over w as child
    from rows r join nodes n on n.depth = r.depth and n.prefix = r.prefix window w as (partition by r.conv_id order by r.depth)),
around as (select depth, prefix, any_value(parent_conv_id) as parent_conv_id, count(distinct child) as n_children from linked group by depth, prefix),
held as (
    select n.conv_id, n.depth, (n.n_convs - 1) * n.bytes as spared, (a.n_children = 0)::int as leaf
    from nodes n join around a on a.depth = n.depth and a.prefix = n.prefix),
below as (
    select r.depth, r.prefix, sum(h.spared) as saved_tokens, sum(h.leaf) as n_leaves
    from rows r join held h on h.conv_id = r.conv_id and h.depth >= r.depth group by r.depth, r.prefix)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, a.parent_conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs,
       a.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join around a on a.depth = n.depth and a.prefix = n.prefix join below b on b.depth = n.depth and b.prefix = n.prefix
"""
