"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents stand in key order, and the mix takes whole
epochs of that order and then its first words up to the source's exact budget. The keys are uniform, so the range
borders of the sort are known without sampling: a range is a slice of the key space. One pass sums words by source and
range (combined before the shuffle); prefix sums of these small totals give each range its start, and a window within
(source, range) gives each document its own. A source with a third of all rows is dealt over all its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import store, words

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that a range has on average; the number of ranges follows from the number of rows.
RANGE_ROWS = 20_000
#: Up to so many sources their cuts are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights by rank (null last), water-filled.

    All targets sum to share * all sizes (at most: to what the limits allow); none is above most * its source's size, and
    the excess goes to the others by weight. In order of limit per weight, the sources that reach their limit come first,
    so one window gives the level. Sources are few; only their totals meet in one task.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("top", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.partitionBy(F.lit(1)).orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("full", F.col("top") <= F.col("level") * F.col("weight"))
    # the level of the first source that stays below its limit holds for it and for all after it
    first = F.min(F.when(~F.col("full"), F.struct(F.col("top") / F.col("weight"), "source", "level"))).over(everything)["level"]
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(first * F.col("weight")).alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(words.WORD)), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    """60 random bits of the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _placed(docs: DataFrame, seed: int, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """doc_id, source, key, size, source_size, target, epochs (whole ones) and rest (words of the epoch that is cut)."""
    sized = store.table(docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key")), "mix")
    ranges = max(1, -(-sized.count() // RANGE_ROWS))
    sized = sized.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.lit(float(ranges))).cast("int"))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").cast("long").alias("source_size")), weights, share, most)
    prior = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("range_size").over(prior), F.lit(0)))
    starts = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "range", "start", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d")
    placed = inner.join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.least(F.greatest(budget - epochs * F.col("source_size") - F.col("start") - F.col("inner"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "d.source", "key", "size", "source_size", "target", epochs.cast("long").alias("epochs"), rest.cast("long").alias("rest"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts and texts without words have size 0 and taken 0. A null source is a source, the last by name. Rows with
    equal doc_id share a key and stand next to each other, smaller ones first. The same rows and seed give the same
    result in any partitioning. Only one document for each source is taken in part, the one that the budget's end cuts,
    so a source's taken words are its target, rounded. No rows give no rows; other columns are not read.
    """
    return _placed(docs, seed, weights, share, most).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


def sample(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with all its columns (any others than doc_id, text
    and source pass through untouched).

    The whole texts are not shuffled: the narrow plan of mix() gives one cut for each source, and a row compares its own
    key with it. The document at the cut ends with the budget's last word, its words joined by single spaces; rows that
    equal it in doc_id and size are cut alike. Rows without words are not taken.
    """
    order = F.struct("key", F.col("doc_id").alias("id"), "size")
    plan = _placed(docs, seed, weights, share, most)
    cuts = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), F.min(F.when(F.col("rest") < F.col("size"), F.struct(order.alias("at"), "rest"))).alias("cut"))
    cuts = store.table(cuts.select(F.col("source").alias("of"), "epochs", F.col("cut.at").alias("at"), F.col("cut.rest").alias("rest")), "mix-cuts")
    own = F.struct(_key(seed).alias("key"), F.col("doc_id").alias("id"), _size().alias("size"))
    packed = docs.select(F.struct("*").alias("row"), own.alias("own"), "source")
    joined = packed.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts, F.col("source").eqNullSafe(F.col("of")))
    rest = F.when(F.col("at").isNull() | (F.col("own") < F.col("at")), F.col("own.size")).when(F.col("own") == F.col("at"), F.col("rest")).otherwise(F.lit(0))
    copies = joined.where("own.size > 0").withColumn("rest", rest).select("row", "own", F.explode(F.concat(F.array_repeat(F.col("own.size"), F.col("epochs").cast("int")), F.array("rest"))).alias("n")).where("n > 0")
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all("row.text", F.lit(f"({words.WORD})"), F.lit(1)), 1, F.col("n").cast("int")))
    text = F.when(F.col("n") < F.col("own.size"), first).otherwise(F.col("row.text"))
    return copies.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
