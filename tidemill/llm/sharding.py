"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws an exponential waiting time for a key, from the hash of both, at a rate of its weight; the shortest wait
takes the record. A draw depends on its own shard alone, so a further shard takes records only into itself, and a
changed weight moves records only into or out of its shard. All of it is column expressions: assigning needs no shuffle.

Slots number a shard's records without gaps. Records are dealt to buckets by the hash of all that tells them apart, which
splits an id or a text with a third of all rows; equal records are counted before the shuffle and travel as runs of
MOST_COPIES at most. Counts by shard and bucket give each bucket its start, a window inside the bucket the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import store

#: Eight shards of equal weight.
WEIGHTS = (1.0,) * 8
#: Records that a bucket has on average; the number of buckets follows from the number of records.
BUCKET_ROWS = 10_000
#: Equal records that stay together.
MOST_COPIES = 5_000


def _bits(text: Column) -> Column:
    """60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _wait(key: Column, shard: int, weight: float, seed: int) -> Column:
    """(wait, draw, shard) of one shard for a key; the draw, 60 random bits, decides where doubles tie."""
    bits = _bits(F.concat(F.lit(f"{seed}:{shard}:"), key))
    wait = -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 60))) / F.lit(float(weight))
    return F.struct(wait.alias("wait"), (-bits).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: tuple[float, ...] = WEIGHTS, seed: int = 13) -> Column:
    """The shard, from 0, of a key; a null key counts as empty text. A shard of weight 0 takes nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    waits = [_wait(key, i, w, seed) for i, w in enumerate(weights) if w > 0]
    if not waits:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*waits))["shard"]


def assign(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, key: str = "doc_id", into: str = "shard", seed: int = 13) -> DataFrame:
    """docs with the shard of each row in the column `into`, which replaces one of that name. No shuffle; rows with equal
    keys share a shard."""
    return docs.withColumn(into, shard_of(docs[key], weights, seed))


def write(docs: DataFrame, path: str, weights: tuple[float, ...] = WEIGHTS, key: str = "doc_id", into: str = "shard", seed: int = 13) -> None:
    """Writes the rows of docs as Parquet, a folder `into`=i for each shard with rows. A shard's rows are dealt over many
    tasks by their texts' hash, so neither a shard nor an id with a third of all rows meets in one."""
    rows = assign(docs, weights, key, into, seed)
    spread = F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(16))
    rows.repartition(F.col(f"`{into}`"), spread).write.partitionBy(into).parquet(path)


def place(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, added: float = 1.0, seed: int = 13) -> DataFrame:
    """One row for each row of docs: doc_id, size (bytes of the text and one), text_crc32, law, shard, slot, grown_shard
    (the shard if one more of weight `added` joins).

    Slots count from 0 in each shard, in order of bucket, doc_id (null first), size and crc32; the same rows give the same
    slots in any partitioning. Null texts have size 1 and the crc32 of no bytes, 0; a null doc_id is a key like any other.
    Equal rows share a shard and have slots of their own, rows of one doc_id with different texts too. No rows give no
    rows; other columns are not read.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(body) + 1).cast("long")
    counted = docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(MOST_COPIES).cast("long"))))
    runs = runs.select("doc_id", "size", "text_crc32", "run", F.least(F.col("copies") - F.col("run"), F.lit(MOST_COPIES)).alias("copies"), shard_of(F.col("doc_id"), weights, seed).alias("shard"), shard_of(F.col("doc_id"), (*weights, added), seed).alias("grown_shard"))
    runs = store.table(runs, "shards")
    total = runs.agg(F.sum("copies")).head()[0] or 0
    told_apart = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "size", "text_crc32", "run")]
    runs = runs.withColumn("bucket", _bits(F.concat_ws(":", *told_apart)) % max(1, -(-total // BUCKET_ROWS)))
    prior = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("inner", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    first = F.col("start") + F.col("inner")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")
