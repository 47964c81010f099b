"""The prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest that turns add up to: each turn's digest, its depth
included, is split into 32-bit lanes, and the lanes of the first d turns are summed. Sums need no chain through a
conversation, so a conversation with a third of all turns is summed in segments of SEGMENT turns whose totals are then
summed, and a row knows its parent's key, the sums without itself.

Edges lead from a node's key to its parent's. In round k every node points to its ancestor 2^k levels up and holds the
sums of its subtree's first 2^k levels; it adds them to that ancestor (one aggregation, combined before the shuffle) and
points to its ancestor's ancestor (one join). As many rounds as the depth has binary digits give all nodes their whole
subtrees. Many nodes can point to one ancestor; it has one row on the other side of the join, and the join is written as
it is, so Spark's adaptive execution splits such a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import store

#: Turns of a conversation that are summed in one window.
SEGMENT = 4_096
#: 32-bit lanes of a digest.
LANES = 4
#: Characters of role and text that order turns of one number, before their digest does.
TIE_CHARS = 64


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, total, digest, n_bytes): each conversation's turns, numbered from 0, and how many it has.

    Null turns come first, then by number; turns of one number by role and text (their first TIE_CHARS characters, then
    their digest). Equal rows are turns of their own. Null roles and texts are empty; rows without conv_id belong to no
    conversation and are left out. Ranges of the order are numbered by themselves and get their starts from the counts
    before them, so no conversation has to fit one task.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.substring(role, 1, TIE_CHARS).alias("role"), F.substring(text, 1, TIE_CHARS).alias("head"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("row")]
    rows = store.table(rows.repartitionByRange(store.partitions(spark), F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    every = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("own")).alias("pos"), "total", "digest", "n_bytes")


def rebuild(turns: DataFrame, family: int, shared: Column, most: int) -> DataFrame:
    """(conv_id, depth, size, digest, n_bytes): conversations whose first turns come from the first one of their family.

    turns as of ordered(). `shared`, an expression over conv_id of at most `most`, says how many turns of conversation
    conv_id - conv_id % family come first (fewer if it has fewer, none if there is none); then follow its own after as
    many. Every conversation also has a row of depth 0 without digest; size is its number of turns.
    """
    turns = store.table(turns, "turns-ordered")
    base = F.col("conv_id") - F.col("conv_id") % family
    totals = turns.where("pos = 0").select("conv_id", "total")
    plan = totals.withColumns({"base": base, "shared": shared.cast("long")}).alias("c").join(totals.alias("b"), F.col("c.base") == F.col("b.conv_id"), "left")
    lead = F.least(F.col("shared"), F.coalesce(F.col("b.total"), F.lit(0)))
    size = lead + F.greatest(F.col("c.total") - F.col("shared"), F.lit(0))
    plan = store.table(plan.select("c.conv_id", "base", "shared", lead.alias("lead"), size.alias("size")), "conversations")
    # a conversation's many turns join its one row of the plan
    own = turns.withColumn("shared", shared.cast("long")).where("pos >= shared").join(plan.select("conv_id", "lead", "size"), "conv_id")
    own = own.select("conv_id", (F.col("lead") + F.col("pos") - F.col("shared") + 1).alias("depth"), "size", "digest", "n_bytes")
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    first = plan.where("lead > 0").join(heads, "base").where("pos < lead").select("conv_id", (F.col("pos") + 1).alias("depth"), "size", "digest", "n_bytes")
    none = F.lit(None).cast("string")
    return plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "size", none.alias("digest"), F.lit(0).cast("long").alias("n_bytes")).unionByName(own).unionByName(first)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, size, n_bytes, key, parent): the nodes that each conversation passes; the root has no parent."""
    lanes = [f"lane{i}" for i in range(LANES)]
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    parts = {lane: F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long")) for i, lane in enumerate(lanes)}
    rows = turns.withColumn("hash", digest).select("conv_id", "depth", "size", "n_bytes", F.floor(F.col("depth") / SEGMENT).alias("segment"), *[c.alias(lane) for lane, c in parts.items()])
    rows = store.table(rows, "lanes")
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "segment").agg(*[F.sum(lane).alias(lane) for lane in lanes])
    totals = totals.select("conv_id", "segment", *[F.sum(lane).over(before).alias(f"{lane}_before") for lane in lanes]).where("segment > 0")
    inside = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"{lane}_sum": F.sum(lane).over(inside) for lane in lanes}).join(totals, ["conv_id", "segment"], "left")
    sums = [F.col(f"{lane}_sum") + F.coalesce(F.col(f"{lane}_before"), F.lit(0)) for lane in lanes]
    up = [s - F.col(lane) for s, lane in zip(sums, lanes, strict=True)]
    return summed.select("conv_id", "depth", "size", "n_bytes", _key(F.col("depth"), sums).alias("key"), F.when(F.col("depth") > 0, _key(F.col("depth") - 1, up)).alias("parent"))


def roll_up(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(key, *values) with each value summed over the node's subtree. nodes: (key, parent, depth, *values), depth 0 at roots."""
    state = store.table(nodes.select("key", F.col("parent").alias("up"), "depth", *values), "roll-up")
    deepest = state.agg(F.max("depth")).head()[0] or 0
    reach = 1
    while reach <= deepest:
        # all of a node's first `reach` levels go to the ancestor that many levels up
        given = state.where("up IS NOT NULL").select(F.col("up").alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("depth"), *values)
        added = state.unionByName(given).groupBy("key").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), *[F.sum(v).alias(v) for v in values])
        ahead = state.where("up IS NOT NULL").select(F.col("key").alias("at"), F.col("up").alias("next"))
        far = F.when(F.col("depth") >= 2 * reach, F.col("up"))  # the others have no ancestor that far up
        following = store.table(added.withColumn("far", far).join(ahead, F.col("far") == F.col("at"), "left").select("key", F.col("next").alias("up"), "depth", *values), "roll-up")
        store.discard(state)
        state, reach = following, 2 * reach
    return state.select("key", *values)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the sha256 of each key's conv_ids in decimal, ascending and joined by commas. ends: (conv_id, key).

    Ranges of ids are sorted and joined to strings for each key and batch, so a key with a third of all ids comes as some
    strings to the task that hashes it, which reads them in order and keeps only the state of the hash.
    """
    spark = ends.sparkSession

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.table({"key": batch.column("key"), "first": batch.column("conv_id"), "id": batch.column("conv_id").cast(pa.string())})
            made = made.group_by("key", use_threads=False).aggregate([("first", "min"), ("id", "list")])
            yield pa.RecordBatch.from_arrays([made["key"].combine_chunks(), made["first_min"].combine_chunks(), pc.binary_join(made["id_list"].combine_chunks(), ",")], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, sums = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        keys.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(sums, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    n = store.partitions(spark)
    strings = ends.select("conv_id", "key").repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id").mapInArrow(join, "key binary, first long, ids string")
    return strings.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def summarize(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of turns (as of rebuild()): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without conversations there is no node; with only empty ones the root alone, its
    own leaf."""
    found = store.table(paths(turns), "paths")
    nodes = found.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    nodes = store.table(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, F.col("key") == F.col("of"), "left").select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_bytes")
    counted = store.table(counted, "nodes-counted")
    own = counted.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    sums = roll_up(own, ("n_leaves", "saved_tokens"))
    ends = ends_digest(found.where("depth = size"))
    above = counted.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    placed = store.table(counted.join(above, F.col("parent") == F.col("above"), "left").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"), "nodes-placed")
    rows = placed.join(sums, "key").join(ends, "key", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"))


def trie(conversations: DataFrame, family: int = 5, shared: Column | None = None, most: int = 8) -> DataFrame:
    """summarize() of the rebuilt conversations: families of `family` ids share first turns, of a number up to `most` that
    follows from the crc32 of the id in decimal unless `shared` says it. Columns other than conv_id, turn, role and text
    are not read; what nulls, ties and repeated rows get is said at ordered()."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1) if shared is None else shared
    return summarize(rebuild(ordered(conversations), family, shared, most))
