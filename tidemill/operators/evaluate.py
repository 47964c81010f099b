"""Evaluation of rankings and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.order import accumulated


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, stratum, rank): the first rank with a relevant item, null without one. ranked: (q, item, rank); gold: (q, stratum, item)."""
    hits = ranked.join(gold.select("q", "item"), ["q", "item"]).groupBy("q").agg(F.min("rank").alias("rank"))
    return gold.select("q", "stratum").distinct().join(hits, "q", "left")


def first_relevant(ranked: DataFrame, questions: DataFrame, relevant: Column) -> DataFrame:
    """first_hits() where ranked rows (q, rank) tell themselves whether they are relevant, so nothing is made of items that no
    ranking has. questions: (q, stratum)."""
    hits = ranked.where(relevant).groupBy("q").agg(F.min("rank").alias("rank"))
    return questions.select("q", "stratum").distinct().join(hits, "q", "left")


def recall_mrr(hits: DataFrame) -> DataFrame:
    """n, recall@5, recall@10 and mrr@10 of all strata (stratum 'all') and each, in one aggregation."""
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(10**9)) <= k).cast("double")), 4)
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 4)
    rows = hits.groupingSets([[], ["stratum"]], "stratum").agg(F.grouping("stratum").alias("g"), F.count("*").alias("n"), at(5).alias("recall_5"), at(10).alias("recall_10"), mrr.alias("mrr_10"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), "n", "recall_5", "recall_10", "mrr_10")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two labels; kappa is 1 where chance agreement is 1."""
    joint = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    left, right = (joint.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    chance = left.join(right, left["label"].eqNullSafe(right["label"])).agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return total.join(F.broadcast(chance)).select(F.col("t").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def auc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties half; by average ranks of distinct scores, which
    are summed before they are ordered, so no pair is formed."""
    at = scored.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    wins = accumulated(at, [], [F.col(score)], {"upto": F.col("n")}).withColumn("wins", F.col("p") * (F.col("upto") - F.col("n") / 2))
    return wins.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.round(F.sum("wins") / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def precision_recall(scored: DataFrame, score: str, positive: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """kept, precision and recall for each threshold, in one pass."""
    rows = scored.select(F.col(score).alias("s"), positive.alias("p"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = F.col("s") >= F.col("threshold")
    agg = rows.groupBy("threshold").agg(F.sum(kept.cast("long")).alias("kept"), F.sum((kept & F.col("p")).cast("long")).alias("hit"), F.sum(F.col("p").cast("long")).alias("all"))
    return agg.select("threshold", "kept", F.round(F.when(F.col("kept") > 0, F.col("hit") / F.col("kept")).otherwise(0.0), 6).alias("precision"), F.round(F.when(F.col("all") > 0, F.col("hit") / F.col("all")).otherwise(0.0), 6).alias("recall"))


def upper_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, upper_median): the element at place n div 2 of each group's sorted values, nulls left out. Equal values are
    counted before they are ordered."""
    at = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    reached, total = F.sum("n").over(Window.partitionBy(by).orderBy(value)), F.sum("n").over(Window.partitionBy(by))
    at = at.select(by, value, reached.alias("reached"), total.alias("total"))
    return at.where(F.col("reached") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(value).alias("upper_median"))


def first_failing(rules: dict[str, Column], passed: str | None = "passed") -> Column:
    """The name of the first rule that holds, in the order given; `passed` if none does."""
    return F.coalesce(*[F.when(rule, name) for name, rule in rules.items()], F.lit(passed))


def discordant(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both, only a, only b and neither, for paired booleans."""
    x, y = F.col(a), F.col(b)
    count = lambda c: F.sum(c.cast("long"))
    return pairs.agg(count(x & y).alias("both"), count(x & ~y).alias("only_a"), count(~x & y).alias("only_b"), count(~x & ~y).alias("neither"))


def majority(runs: DataFrame, key: str, fail: Column) -> DataFrame:
    """(key, any_fail, majority_fail) over repeated runs."""
    return runs.groupBy(key).agg(F.max(fail).alias("any_fail"), (F.sum(fail.cast("int")) * 2 > F.count("*")).alias("majority_fail"))


def rank_band(c: Column) -> Column:
    return F.when(c.isNull(), "none").when(c <= 5, "1-5").when(c <= 10, "6-10").when(c <= 30, "11-30").otherwise("31+")


def keep_sets(rows: DataFrame, by: str, question: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall) of what each judge keeps, over all its rows (question, kept, relevant). A question of
    which a judge keeps nothing is kept whole."""
    some = rows.groupBy(F.col(by).alias("__by"), F.col(question).alias("__q")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("some"))
    rows = rows.join(some, (F.col(by) == F.col("__by")) & (F.col(question) == F.col("__q")))
    kept, good = F.coalesce("kept", F.lit(False)) | ~F.col("some"), F.coalesce("relevant", F.lit(False))
    n = rows.groupBy(by).agg(F.count_if(kept & good).alias("tp"), F.count_if(kept & ~good).alias("fp"), F.count_if(~kept & good).alias("fn"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b)), 6)
    return n.select(by, "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def judge_agreement(rows: DataFrame, by: str, *key: str) -> DataFrame:
    """(a, b, n, agreement) of each pair of judges over the keys that both judged; judges are few."""
    one = rows.select(*key, F.col(by).alias("a"), F.col("kept").alias("x"))
    two = rows.select(*key, F.col(by).alias("b"), F.col("kept").alias("y"))
    return one.join(two, list(key)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("double")), 6).alias("agreement"))


def graded(rows: DataFrame, by: str, question: str, grade: str, best: int = 2) -> DataFrame:
    """(by, questions, mean_best, with_best, zeros, n): the mean number of best grades of a question, questions with one, and rows
    without any relevance."""
    q = rows.groupBy(by, question).agg(F.count_if(F.col(grade) == best).alias("best"), F.count_if(F.col(grade) == 0).alias("zero"), F.count("*").alias("n"))
    return q.groupBy(by).agg(F.count("*").alias("questions"), F.round(F.avg("best"), 6).alias("mean_best"), F.count_if(F.col("best") > 0).alias("with_best"), F.sum("zero").alias("zeros"), F.sum("n").alias("n"))


def set_recall(ranked: DataFrame, gold: DataFrame, depths: tuple[int, ...] = (5, 15)) -> DataFrame:
    """(type, questions, and for each depth hit_d, all_d and three_d): questions with one, all and three or more of their gold items
    among the first d. ranked: (q, item, rank); gold: (q, type, item); questions without a ranking count as misses."""
    hits = gold.select("q", "type", "item").distinct().join(ranked.groupBy("q", "item").agg(F.min("rank").alias("rank")), ["q", "item"], "left")
    q = hits.groupBy("q", "type").agg(F.count("*").alias("n_gold"), *[F.count_if(F.col("rank") <= d).alias(f"n_{d}") for d in depths])
    of = lambda d: [F.count_if(F.col(f"n_{d}") > 0).alias(f"hit_{d}"), F.count_if(F.col(f"n_{d}") == F.col("n_gold")).alias(f"all_{d}"), F.count_if(F.col(f"n_{d}") >= 3).alias(f"three_{d}")]
    return q.groupBy("type").agg(F.count("*").alias("questions"), *[c for d in depths for c in of(d)])


def gap_stats(rows: DataFrame, gap: str, tiny: float = 0.02, small: float = 0.05, large: float = 0.2) -> DataFrame:
    """n, mean, median, least and greatest gap, and how many are tiny (below), small (up to), middling and large (from)."""
    g = F.col(gap)
    return rows.where(g.isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(g), 4).alias("mean"), F.round(F.median(g), 4).alias("median"), F.min(g).alias("least"), F.max(g).alias("greatest"), F.count_if(g < tiny).alias("tiny"), F.count_if((g >= tiny) & (g <= small)).alias("small"), F.count_if((g > small) & (g < large)).alias("middling"), F.count_if(g >= large).alias("large"))


def first_stage(rows: DataFrame, key: str, stage: str, stages: tuple[str, ...], passed: Column) -> DataFrame:
    """(key, stage): the first of the stages, in their order, whose row of the key passed; keys without one are left out."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(stage))
    return rows.where(passed & (place > 0)).groupBy(key).agg(F.min_by(stage, place).alias(stage))


def violation_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """(reason, n): rows by each reason's part before a colon, an array of them a row."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def paired_counts(pairs: DataFrame, a: str, b: str, stratum: str) -> DataFrame:
    """(stratum, n, n_a, n_b, only_a, only_b) of two runs' flags over questions that both answered."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return pairs.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))
