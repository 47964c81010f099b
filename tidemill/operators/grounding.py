"""Citations and numbers of answers against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import ids
from tidemill.operators.order import numbered

NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w]|\.\d)"


def numbers(c: Column, least_digits: int = 2) -> Column:
    """Distinct numbers of at least `least_digits` digits, without years."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.length(F.regexp_replace(x, r"\.", "")) >= least_digits) & ~x.rlike(r"^(19|20)\d\d$")))


def unsupported(answer: Column, source: Column) -> Column:
    """Numbers of the answer that stand nowhere in the source between other characters than digits; an empty source supports all."""
    pattern = lambda x: F.concat(F.lit("(?<![0-9])"), F.regexp_replace(x, r"\.", r"\\."), F.lit("(?![0-9])"))
    missing = F.filter(numbers(answer), lambda x: ~F.regexp(source, pattern(x)))
    return F.when(F.coalesce(source, F.lit("")) == "", F.array().cast("array<string>")).otherwise(missing)


def repaired_citations(cited: DataFrame, context: DataFrame) -> DataFrame:
    """(answer, id) and (answer, context_id) to (answer, id, fixed, how): kept if the context has it; else its version, or
    the only context id within one edit, takes its place; else it is dropped. Answers without context keep theirs."""
    c = context.select(F.col("answer").alias("__a"), F.col("context_id"))
    rows = cited.join(c, F.col("answer") == F.col("__a"), "left")
    base = lambda x: ids.normalize_id(x, "suffix")
    exact, same = F.col("id") == F.col("context_id"), base(F.col("id")) == base(F.col("context_id"))
    near = F.levenshtein(base(F.col("id")), base(F.col("context_id")), 1) == 1
    agg = rows.groupBy("answer", "id").agg(F.max(exact).alias("exact"), F.min(F.when(same, F.col("context_id"))).alias("version"), F.min(F.when(near, F.col("context_id"))).alias("near"), F.count_distinct(F.when(near, F.col("context_id"))).alias("n_near"), F.count("context_id").alias("n"))
    how = F.when(F.col("n") == 0, "untouched").when(F.col("exact"), "kept").when(F.col("version").isNotNull(), "version").when(F.col("n_near") == 1, "near").otherwise("dropped")
    fixed = F.when(how.isin("untouched", "kept"), F.col("id")).when(how == "version", F.col("version")).when(how == "near", F.col("near"))
    return agg.select("answer", "id", fixed.alias("fixed"), how.alias("how"))


def aligned_numbers(conclusion: DataFrame, body: DataFrame, within: float = 0.01) -> DataFrame:
    """(paper, x) decimals of conclusions with the body's value where exactly one of the same paper has the same integer
    part, as many decimals or more, and differs by at most `within`."""
    b = body.select(F.col("paper").alias("__p"), F.col("x").alias("y")).distinct()
    whole, places = lambda c: F.substring_index(c, ".", 1), lambda c: F.length(F.substring_index(c, ".", -1))
    x, y = F.col("x"), F.col("y")
    close = (whole(x) == whole(y)) & (F.abs(x.cast("double") - y.cast("double")) <= within * F.greatest(x.cast("double"), F.lit(1e-9))) & (places(y) >= places(x))
    rows = conclusion.select("paper", "x").distinct().join(b, (F.col("paper") == F.col("__p")), "left")
    agg = rows.groupBy("paper", "x").agg(F.max(x == y).alias("there"), F.min(F.when(close, y)).alias("y"), F.count_distinct(F.when(close, y)).alias("n"))
    return agg.select("paper", "x", F.when(~F.coalesce("there", F.lit(False)) & (F.col("n") == 1), F.col("y")).otherwise(x).alias("aligned"))


def citation_edges(papers: DataFrame, content: str = "content") -> DataFrame:
    """(src, dst) arXiv ids that a paper's text cites, without itself."""
    pattern = r"(?i)(?:arxiv|abs/|corr)[^\d\n]{0,25}?(\d{4}\.\d{4,5})(?!\d)"
    own = ids.normalize_id(F.col("paper_id"))
    rows = papers.select(own.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(1))).alias("dst"))
    return rows.where(ids.valid_arxiv_id(F.col("dst")) & (F.col("src") != F.col("dst"))).distinct()


def outside_targets(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(dst, n, rank): targets of edges (src, dst) that are not known (id), by how many sources name them, then by name. Rows
    that repeat an edge count once; ranks come from ranges, so no task has to hold all targets."""
    out = edges.select("src", "dst").distinct().join(known.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    return numbered(out.groupBy("dst").agg(F.count("*").alias("n")), [], [F.desc("n"), F.col("dst")], "rank")


def edge_totals(edges: DataFrame, known: DataFrame) -> DataFrame:
    """One row: sources, edges to known and to other targets, and how many other targets there are."""
    inside = known.select(F.col("id").alias("dst"), F.lit(True).alias("inside")).distinct()
    rows = edges.select("src", "dst").distinct().join(inside, "dst", "left")
    outside = F.col("inside").isNull()
    by_target = rows.groupBy("dst", outside.alias("outside")).agg(F.count("*").alias("n"))
    counts = by_target.agg(F.coalesce(F.sum(F.when(~F.col("outside"), F.col("n"))), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0)).alias("outside"), F.count_if("outside").alias("targets"))
    return counts.join(F.broadcast(edges.agg(F.count_distinct("src").alias("sources"))))  # one row each


#: Up to so many runs of items are broadcast; more are joined by their own partitions.
BROADCAST_RUNS = 200_000


def shared_ngrams(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, item_id, shared): distinct runs of n tokens that a document has in common with an item. While the items' runs are
    few, they go to the documents' tasks, and only runs that are shared are shuffled."""
    def runs(t: DataFrame, key: str) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " "))
        return t.where(F.size("tokens") >= n).select(key, F.explode(F.array_distinct(each)).alias("run"))

    asked = runs(items, "item_id")
    few = asked.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    return runs(docs, "doc_id").join(F.broadcast(asked) if few else asked, "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
