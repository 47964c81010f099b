"""Running sums and positions in an order, where a group may hold a third of all rows.

The rows are dealt to ranges of the order and stored with their range; sums by group and range give each range its start,
and a window inside (group, range) gives each row its own. No group meets in one task; what does is a row for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.stored import stored


def accumulated(rows: DataFrame, within: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of `sums`: the sum of its values from the group's first row to this one in `order`, which
    must tell rows of a group apart for the result to be the same in every run. Nulls in `within` are a group."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *within, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    prior = Window.partitionBy(*within or [F.lit(1)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*within, "__range").agg(*[F.sum(c).alias(f"__sum_{name}") for name, c in sums.items()])
    starts = totals.select(*[F.col(c).alias(f"__of_{c}") for c in within], F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__sum_{name}").over(prior), F.lit(0)).alias(f"__start_{name}") for name in sums])
    inside = Window.partitionBy(*within, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"__own_{name}": F.sum(c).over(inside) for name, c in sums.items()})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in within], F.col("__range") == F.col("__at"))
    return own.join(starts, same).select(*rows.columns, *[(F.col(f"__start_{name}") + F.coalesce(f"__own_{name}", F.lit(0))).alias(name) for name in sums])


def numbered(rows: DataFrame, within: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place, from 1, in each group's order."""
    return accumulated(rows, within, order, {name: F.lit(1).cast("long")})
