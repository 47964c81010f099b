"""Deduplication, upserts and set operations by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")


def first_per_key(df: DataFrame, *by: str, order: str) -> DataFrame:
    """The first row of each key."""
    return _one(df, list(by), [F.col(order)])


def last_per_key(df: DataFrame, *by: str, order: str) -> DataFrame:
    """The last row of each key: the latest state, the last word."""
    return _one(df, list(by), [F.desc(order)])


def longest_per_key(df: DataFrame, *by: str, body: str, order: str) -> DataFrame:
    """The row with the longest body of each key; the first of equals."""
    return _one(df, list(by), [F.desc(F.length(body)), F.col(order)])


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not known."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """All keys, each with its row of highest version; new rows win ties."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return _one(rows, [key], [F.desc(version), F.desc("__new")]).drop("__new")


def synced(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, action): delete what is stored and not wanted, insert what is only wanted, update the rest."""
    a, b = stored.select(key, F.lit(True).alias("__s")), wanted.select(key, F.lit(True).alias("__w"))
    return a.join(b, key, "full").select(key, F.when(F.col("__w").isNull(), "delete").when(F.col("__s").isNull(), "insert").otherwise("update").alias("action"))


def appended(old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """old and the rows of new whose key neither old nor an earlier row of new has (earlier: by ord)."""
    rows = first_per_key(new.withColumn("__k", key), "__k", order="ord")
    return old.unionByName(rows.join(old.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def records(entries: DataFrame, key: str, values: tuple[str, ...], hidden: str = "chroma:") -> DataFrame:
    """(key, doc, meta): a record for each key from entries (key, name, *values), whatever names there are. An entry's value is the
    first of its values that is given, as text; entries without one are left out. The entry `hidden`document is the record's
    text, others of that beginning are dropped. Of entries that repeat a name the least value stays. Only one record's entries
    meet, sorted by name."""
    given = entries.select(key, "name", F.coalesce(*[F.col(v).cast("string") for v in values]).alias("value"))
    one = given.groupBy(key, "name").agg(F.min("value").alias("value"))
    shown = ~F.startswith("name", F.lit(hidden)) & F.col("value").isNotNull()
    meta = F.map_from_entries(F.array_sort(F.collect_list(F.when(shown, F.struct("name", "value")))))
    return one.groupBy(key).agg(F.max(F.when(F.col("name") == f"{hidden}document", F.col("value"))).alias("doc"), meta.alias("meta"))


def as_texts(meta: Column) -> Column:
    """A map with text values; nulls are empty."""
    return F.transform_values(meta, lambda _, v: F.coalesce(v.cast("string"), F.lit("")))


def quota_sample(df: DataFrame, slot: str, quota: int, key: str, seed: int = 0) -> DataFrame:
    """Up to `quota` rows of each slot in an order by the md5 of seed and key; the same in every engine."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(slot).orderBy(order))).where(F.col("nth") <= quota)


def assembled(rows: DataFrame, slot: str, key: str, order: str, quota: int, reason: str = "reason", seed: int = 0) -> DataFrame:
    """Rows without a reason of rejection, the first of each key in each slot, and up to `quota` of these, with nth."""
    columns = [c for c in rows.columns if c not in (slot, key)]
    first = rows.where(F.col(reason).isNull()).groupBy(slot, key).agg(F.min_by(F.struct(*columns), order).alias("__row"))
    return quota_sample(first, slot, quota, key, seed).select(slot, key, "__row.*", "nth").drop(reason)


def assembly_counts(rows: DataFrame, slot: str, key: str, quota: int, reason: str = "reason") -> DataFrame:
    """(slot, outcome, n): rows rejected for each reason, and repeated, over quota and used ones."""
    n = rows.groupBy(slot, reason, key).agg(F.count("*").alias("n"))
    passed = n.where(F.col(reason).isNull()).groupBy(slot).agg(F.sum("n").alias("all"), F.count("*").alias("keys"))
    used = F.least("keys", F.lit(quota))
    parts = F.array(*[F.struct(F.lit(name).alias("outcome"), c.alias("n")) for name, c in (("repeated", F.col("all") - F.col("keys")), ("over_quota", F.col("keys") - used), ("used", used))])
    kept = passed.select(slot, F.inline(parts)).where("n > 0")
    return n.where(F.col(reason).isNotNull()).groupBy(slot, F.col(reason).alias("outcome")).agg(F.sum("n").alias("n")).unionByName(kept)
