"""Folds over ordered rows, where the state that a row leaves decides about the next one and a group may hold a third of
all rows.

Rows are dealt to ranges of the order and stored. Every range is folded from an empty state at first; its last state is
then handed to the next range of the group, and ranges that were given another state than before are folded again, until
none is. A fold that forgets, as one does that starts anew where neighbours differ, needs two or three rounds; the result
is that of one pass through the group in any case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.stored import stored


def _fold(rows: pd.DataFrame, given: pd.DataFrame, least: float) -> tuple[list[int], int, np.ndarray]:
    """The run of each row, and the last run with the direction of its mean."""
    run, mean, runs = (None, None, []) if given.empty or given["mean"].iloc[0] is None else (given["run"].iloc[0], np.asarray(given["mean"].iloc[0]), [])
    for key, vector in zip(rows["ord"], rows["vector"], strict=True):
        v = np.asarray(vector, np.float64)
        v = v / max(np.linalg.norm(v), 1e-12)
        if mean is not None and float(mean @ v) >= least:
            mean = mean + v
            mean = mean / (np.linalg.norm(mean) + 1e-12)
        else:
            run, mean = key, v
        runs.append(run)
    return runs, run, mean


def merged_runs(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(grp, ord, run): neighbours are merged as long as the cosine of the run's mean direction and the next vector is `least`
    or more; run is its first row's ord. rows: (grp, ord, vector), ord distinct in its group. Rows with a null group, ord or
    vector are left out; a vector without length begins a run that nothing joins."""
    spark = rows.sparkSession
    rows = rows.where("grp IS NOT NULL AND ord IS NOT NULL AND vector IS NOT NULL").select("grp", F.col("ord").cast("long").alias("ord"), F.col("vector").cast("array<double>").alias("vector"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp", "ord").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "fold")
    kind = dealt.schema["grp"].dataType.simpleString()
    state = f"grp {kind}, part int, run long, mean array<double>"
    parts = dealt.select("grp", "part").distinct()
    before = F.lag("part").over(Window.partitionBy("grp").orderBy("part"))
    chain = stored(parts.withColumn("before", before), "fold-chain")

    def last(held: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return pd.DataFrame({"grp": [], "part": [], "run": [], "mean": []})
        _, run, mean = _fold(held.sort_values("ord"), given, least)
        return pd.DataFrame({"grp": [held["grp"].iloc[0]], "part": [held["part"].iloc[0]], "run": [run], "mean": [mean.tolist()]})

    def every(held: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return pd.DataFrame({"grp": [], "ord": [], "run": []})
        held = held.sort_values("ord")
        return pd.DataFrame({"grp": held["grp"], "ord": held["ord"], "run": _fold(held, given, least)[0]})

    def given_by(ends: DataFrame) -> DataFrame:
        """(grp, part, run, mean): what each range is given by the one before it; nulls at the first."""
        e = ends.select(F.col("grp").alias("of"), F.col("part").alias("from"), "run", "mean")
        return chain.join(e, (F.col("grp") == F.col("of")) & (F.col("before") == F.col("from")), "left").select("grp", "part", "run", "mean")

    def folded(held: DataFrame, given: DataFrame, f, schema: str) -> DataFrame:
        return held.groupBy("grp", "part").cogroup(given.groupBy("grp", "part")).applyInPandas(f, schema)

    given = chain.select("grp", "part", F.lit(None).cast("long").alias("run"), F.lit(None).cast("array<double>").alias("mean"))
    ends = stored(folded(dealt, given, last, state), "fold-ends")
    given = stored(given, "fold-given")
    while True:
        now = stored(given_by(ends), "fold-given")
        old = given.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.col("run").alias("r"), F.col("mean").alias("m"))
        changed = now.join(old, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p"))).where(~(F.col("run").eqNullSafe(F.col("r")) & F.col("mean").eqNullSafe(F.col("m")))).select("grp", "part")
        changed = stored(changed, "fold-changed")
        if changed.isEmpty():
            return folded(dealt, now, every, f"grp {kind}, ord long, run long")
        again = folded(dealt.join(changed, ["grp", "part"], "left_semi").select(*dealt.columns), now.join(changed, ["grp", "part"], "left_semi"), last, state)
        ends, given = stored(ends.join(changed, ["grp", "part"], "left_anti").select("grp", "part", "run", "mean").unionByName(again), "fold-ends"), now
