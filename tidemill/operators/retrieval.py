"""Retrieval: BM25, vectors, fusion and document ranking. Every order ends in an explicit ordinal or id, so ties are settled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import ids, text
from tidemill.functions.questions import trimmed
from tidemill.operators import grid
from tidemill.operators.order import accumulated, numbered
from tidemill.sources.stored import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def document_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df, begun, size), stored: documents that have each term, how many of them begin with it, and these documents'
    tokens; tasks add up their own before the shuffle. All of begun and size are the documents with a token and their
    tokens, so that texts are tokenized once for the terms and their sizes."""
    # outer: for a plain explode Spark looks first whether there are tokens, which tokenizes again
    terms = docs.select(F.size(tokens).alias("n"), F.posexplode_outer(F.array_distinct(tokens)).alias("at", "term")).where("term IS NOT NULL")
    first = F.col("at") == 0
    counts = terms.groupBy("term").agg(F.count("*").alias("df"), F.count_if(first).alias("begun"), F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("size"))
    return stored(counts, "counts")


def term_weights(counts: DataFrame, n_docs: int, epsilon: float = EPSILON) -> DataFrame:
    """(term, df), which is read twice, to (term, df, idf): ln((N - df + 0.5) / (df + 0.5)); negative values become epsilon
    times the mean of all."""
    df = counts.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))  # one row
    return df.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def best_by_terms(docs: DataFrame, weights: DataFrame, queries: DataFrame, mean_len: float, sizes: tuple[int, int], k: int, key: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(q, key, score, by, wanted): the k best BM25 scores above 0 of each query inside each block of documents (key, tokens), by
    the score rounded to 9 digits (by), then the key; and the scores of the pairs (q, key) that are wanted, marked so. queries:
    (q, terms), repeated terms count. The scores of all pairs are never rows. sizes: documents and tokens, in all."""
    asked = queries.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    asked = asked.join(weights, "term").select("q", "term", (F.col("times") * F.col("idf")).alias("weight"))
    return grid.best_by_terms(docs, stored(asked, "asked"), mean_len, sizes, k, K1, B, key, wanted)


def top_k(scores: DataFrame, k: int, by: str = "score", key: str = "doc_id", within: str = "q") -> DataFrame:
    """The k best of each query, with their rank; ties by key."""
    place = Window.partitionBy(within).orderBy(F.desc(by), F.col(key))
    return scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Exact k nearest by 1 - cosine, of each query and (if given) each group. queries: (q, qv), a stated set. Blocks of both
    sides meet in arrays, and what is moved is the k best of each block and not the pairs; columns beside the vector are
    joined to these."""
    rows = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    grp = F.coalesce(F.col(group).cast("string"), F.lit("\0")) if group else F.lit("")
    near = grid.nearest_rows(rows.select("row", "vec_id", grp.alias("grp"), "embedding"), stored(queries, "queries"), k)
    near = near.join(rows.select("row", grp.alias("grp")), "row") if group else near
    place = Window.partitionBy("q", *(["grp"] if group else [])).orderBy("dist", "vec_id")
    best = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("row", "q", "dist", "rank")
    return best.join(rows.drop("embedding"), "row").drop("row")


def minmax(c: Column, within: Column | str, equal: float = 0.5) -> Column:
    """c between 0 and 1 within its group; `equal` if all are equal."""
    w = Window.partitionBy(within)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-12, F.lit(equal)).otherwise((c - low) / (high - low))


def fused(pool: DataFrame, vector_weight: float = 0.5, bm25_weight: float = 0.5, boost: float = 1.2, query: Column | None = None) -> DataFrame:
    """Adds score to (q, ord, dist, bm25, title): weighted min-max of 1 / (1 + dist) and BM25; a BM25 column without
    differences counts 0, one of distances 0.5. Without any distance the incoming order scores. A query of five
    characters or more that stands in the title multiplies by boost."""
    w = Window.partitionBy("q")
    n = F.count("*").over(w)
    by_dist = F.when(F.col("dist").isNull(), 0.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), F.col("dist"))))
    place = F.row_number().over(Window.partitionBy("q").orderBy("ord"))
    v = F.when(F.count("dist").over(w) > 0, by_dist).otherwise((n - place + 1) / n)
    rows = pool.withColumn("v", v).withColumn("b", F.coalesce("bm25", F.lit(0.0)))
    score = vector_weight * minmax(F.col("v"), "q") + bm25_weight * minmax(F.col("b"), "q", 0.0)
    if query is not None:
        asked = F.lower(trimmed(query))
        score = score * F.when((F.length(asked) >= 5) & F.contains(F.lower(F.coalesce("title", F.lit(""))), asked), boost).otherwise(1.0)
    return rows.withColumn("score", score)


def rrf(pool: DataFrame, k: float = 60.0, first: str = "v", second: str = "b") -> DataFrame:
    """Adds rrf: 1 / (k + rank) by each of two signals, ties by ord."""
    place = lambda c: F.row_number().over(Window.partitionBy("q").orderBy(F.desc(c), "ord"))
    return pool.withColumn("rrf", 1 / (k + place(first)) + 1 / (k + place(second)))


def _own_paper() -> Column:
    """paper_id; a row with an empty one is a paper of its own."""
    return F.when(F.coalesce("paper_id", F.lit("")) == "", F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.col("paper_id"))


def document_scores(chunks: DataFrame, weights: tuple[float, ...] = (0.15,), strong: float = 0.85, evidence: float = 0.0, best: tuple[str, ...] = ()) -> DataFrame:
    """(q, paper_id, score, ord) to a row for each paper: best chunk plus weights times the next ones, plus evidence for
    each further chunk near the best (five at most), with rank and the best chunk's columns `best`. A row with an empty id
    is a paper of its own. A paper's chunks are sorted, not gathered, so they may spill."""
    order = Window.partitionBy("q", "paper").orderBy(F.desc("score"), "ord")
    rows = chunks.withColumn("paper", _own_paper()).select("q", "paper", "score", "ord", *best)
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("top", F.first("score").over(order))
    at = lambda c, n: F.max(F.when(F.col("nth") == n, F.col(c)))
    near = F.count_if(F.col("score") >= strong * F.col("top"))
    score = at("score", 1) + sum((w * F.coalesce(at("score", i + 2), F.lit(0.0)) for i, w in enumerate(weights)), F.lit(0.0)) + evidence * F.least(near - 1, F.lit(5))
    ranked = rows.groupBy("q", "paper").agg(F.count("*").alias("n_chunks"), near.cast("int").alias("n_strong"), score.alias("score"), F.min("ord").alias("ord"), *[at(c, 1).alias(c) for c in best])
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord")))


def titled(score: Column, likeness: Column, weight: float = 0.08, high: float = 0.7, times: float = 1.05) -> Column:
    """A paper's score with weight times the likeness of its title and the query, and `times` as much for a high likeness."""
    score = score + weight * likeness
    return F.when(likeness > high, score * times).otherwise(score)


def ranked_papers(chunks: DataFrame, most: int = 10, per_paper: int = 2, pool: int = 50, protected: DataFrame | None = None) -> DataFrame:
    """(q, paper, place, nth, ord) of the best chunks of each query's best papers, from (q, paper_id, ord, score, likeness, close).

    Papers are ranked by document_scores() with the likeness of their titles; the first `pool` of them then by `close` of their
    best chunk. `most` stay; protected papers (q, paper) beyond take the last places of these, in their order."""
    papers = document_scores(chunks, best=("likeness", "close")).withColumn("score", F.round(titled(F.col("score"), F.col("likeness")), 9))
    papers = papers.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord")))
    papers = reranked(papers, "close", pool).select("q", "paper", "pos", F.lit(False).alias("safe"))
    if protected is not None:
        safe = protected.select("q", "paper", F.lit(True).alias("named")).distinct()
        papers = papers.join(safe, ["q", "paper"], "left").withColumn("safe", F.coalesce("named", F.lit(False)))
    missed = (F.col("safe") & (F.col("pos") > most)).cast("int")
    papers = papers.withColumn("missed", missed).withColumn("nth_missed", F.sum("missed").over(Window.partitionBy("q").orderBy("pos")))
    papers = papers.withColumn("n_missed", F.least(F.sum("missed").over(Window.partitionBy("q")), F.lit(most)))
    papers = papers.where((F.col("pos") <= most - F.col("n_missed")) | ((F.col("missed") == 1) & (F.col("nth_missed") <= most)))
    papers = papers.select("q", "paper", F.row_number().over(Window.partitionBy("q").orderBy("pos")).alias("place"))
    best = Window.partitionBy("q", "paper").orderBy(F.desc("score"), "ord")
    rows = chunks.select("q", _own_paper().alias("paper"), "ord", "score").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_paper)
    return rows.join(papers, ["q", "paper"]).select("q", "paper", "place", "nth", "ord")


def with_term_papers(pool: DataFrame, hits: DataFrame, chunks: DataFrame, top: int = 120, per_paper: int = 5, least_chars: int = 80) -> DataFrame:
    """(q, paper_id, ord, dist, by_terms): the pool's rows (q, paper_id, ord, dist), and of papers that only the terms found
    (hits: q, paper_id, rank; the first `top`) the nearest chunks (q, paper_id, ord, dist, n_chars), of which
    those that are too short are then left out and not replaced. Papers are the same without their versions."""
    same = lambda d: d.withColumn("base", ids.normalize_id(F.col("paper_id")))
    new = same(hits.where(F.col("rank") <= top)).where("base <> ''").select("q", "base").distinct()
    new = new.join(same(pool).select("q", "base"), ["q", "base"], "left_anti")
    near = Window.partitionBy("q", "base").orderBy("dist", "ord")
    found = same(chunks).join(new, ["q", "base"]).withColumn("nth", F.row_number().over(near)).where((F.col("nth") <= per_paper) & (F.col("n_chars") >= least_chars))
    return pool.select("q", "paper_id", "ord", "dist", F.lit(False).alias("by_terms")).unionByName(found.select("q", "paper_id", "ord", "dist", F.lit(True).alias("by_terms")))


def candidates(questions: DataFrame, chunks: DataFrame, term_scores: Callable[[DataFrame, int], DataFrame], papers: int = 5, top: int = 120, per_hit: int = 5, least_chars: int = 80) -> DataFrame:
    """The pool of each question, (q, ord, vec_id, paper_id, title, dist, bm25): the max(20 * papers, 100) nearest chunks, the
    one whose title holds most words of the question first if that is 60 % or more of them, chunks that read like a
    bibliography last; then the `per_hit` nearest chunks of each of the `top` papers by terms that are not among them, without
    short ones. bm25 is the paper's score by terms, 0 without one.

    questions: (q, question, qv); chunks: (vec_id, embedding, paper_id, title, n_chars, refs); term_scores gives from pairs
    (q, base) and a number k the rows (q, base, bm25, by, wanted) of papers without version: each question's k best by `by`
    at least, and the wanted pairs. A pool has as many rows for a question as these numbers allow, whatever the chunks are.
    """
    fetch = max(20 * papers, 100)
    near = nearest(chunks, questions.select("q", "qv"), fetch).join(questions.select("q", "question"), "q")
    words = text.overlap_tokens(F.col("question"))
    share = F.when(F.size(words) >= 2, F.size(F.array_intersect(words, text.overlap_tokens(F.col("title")))) / F.size(words)).otherwise(0.0)
    best = F.first("vec_id").over(Window.partitionBy("q").orderBy(F.desc("share"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = near.withColumn("share", share).withColumn("later", ((F.col("share") < 0.6) | (F.col("vec_id") != best)).cast("int"))
    pool = near.select("q", "vec_id", "paper_id", "title", "dist", F.struct(F.lit(0).alias("a"), F.col("refs").cast("int").alias("b"), F.col("later").alias("c"), F.col("rank").cast("double").alias("d")).alias("at"))
    base = lambda d: d.withColumn("base", ids.normalize_id(F.col("paper_id")))
    pool = stored(pool, "near")
    scores = stored(term_scores(base(pool).select("q", "base").distinct(), top), "scores")
    best = stored(top_k(scores.where("NOT wanted AND bm25 > 0"), top, by="by", key="base"), "hits")
    hits = best.select("q", "base", F.col("rank").alias("hit"))
    new = hits.join(base(pool).select("q", "base"), ["q", "base"], "left_anti").join(questions.select("q", "qv"), "q")
    found = base(chunks).join(new, "base").withColumn("dist", 1 - cosine(F.col("embedding"), F.col("qv")))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("q", "base").orderBy("dist", "vec_id"))).where((F.col("nth") <= per_hit) & (F.col("n_chars") >= least_chars))
    added = found.select("q", "vec_id", "paper_id", "title", "dist", F.struct(F.lit(1).alias("a"), F.col("hit").cast("int").alias("b"), F.col("nth").cast("int").alias("c"), F.lit(0.0).alias("d")).alias("at"))
    known = scores.where("wanted").select("q", "base", "bm25").unionByName(best.select("q", "base", "bm25").join(new.select("q", "base"), ["q", "base"], "left_semi"))
    rows = base(pool.unionByName(added)).join(known, ["q", "base"], "left")
    placed = rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("at", "vec_id")))
    return placed.select("q", F.col("ord").cast("long").alias("ord"), "vec_id", "paper_id", "title", "dist", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def within_years(rows: DataFrame, asked: DataFrame, year: str = "year") -> DataFrame:
    """Rows (q, year) inside their query's range (asked: q, first, last; nulls are open), or all of them where none is; adds
    status: any (nothing asked), kept or none. Queries' counts are added up in tasks, so a query with many rows isn't one task."""
    inside = (F.col(year) >= F.coalesce("first", F.lit(-(10**6)))) & (F.col(year) <= F.coalesce("last", F.lit(10**6)))
    rows = rows.join(asked.select("q", "first", "last"), "q", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    some = rows.groupBy("q").agg(F.max("inside").alias("some"))
    free = F.col("first").isNull() & F.col("last").isNull()
    status = F.when(free, "any").when(F.col("some"), "kept").otherwise("none")
    kept = rows.join(some, "q").withColumn("status", status).where((F.col("status") != "kept") | F.col("inside"))
    return kept.drop("first", "last", "inside", "some")


def promoted(rows: DataFrame, query_tokens: Column, least: float = 0.6) -> DataFrame:
    """Adds pos: the row whose title holds most query tokens comes first if that is `least` of them or more; else by ord."""
    share = F.size(F.array_intersect(query_tokens, text.overlap_tokens(F.col("title")))) / F.greatest(F.size(query_tokens), F.lit(1))
    rows = rows.withColumn("share", F.when(F.size(query_tokens) >= 2, share).otherwise(0.0))
    # the best of each query is found in the tasks before the shuffle; only it changes its place
    best = rows.where(F.col("share") >= least).groupBy(F.col("q").alias("of")).agg(F.max_by("ord", F.struct("share", -F.col("ord"))).alias("best"))
    rows = rows.join(best, F.col("q").eqNullSafe(F.col("of")), "left").withColumn("first", F.coalesce(F.col("ord") == F.col("best"), F.lit(False)))
    return numbered(rows.drop("of", "best"), ["q"], [F.desc("first"), F.col("ord")]).drop("first")


def demoted(rows: DataFrame, flag: Column) -> DataFrame:
    """Adds pos: rows without the flag first, each kind in its order."""
    return numbered(rows.withColumn("flagged", flag.cast("int")), ["q"], [F.col("flagged"), F.col("ord")]).drop("flagged")


def first_per_paper(rows: DataFrame) -> DataFrame:
    """Adds pos: each paper's first row in order, then the others; rows without an id count as papers of their own."""
    paper = rows.withColumn("paper", _own_paper())
    first = paper.groupBy(F.col("q").alias("of"), F.col("paper").alias("by")).agg(F.min("ord").alias("first"))
    rows = paper.join(first, F.col("q").eqNullSafe(F.col("of")) & (F.col("paper") == F.col("by"))).withColumn("later", (F.col("ord") > F.col("first")).cast("int"))
    return numbered(rows.drop("of", "by", "first", "paper"), ["q"], [F.col("later"), F.col("ord")]).drop("later")


def within_budget(rows: DataFrame, most: int, by: str = "paper_id", order: str = "ord", size: str = "n_chars") -> DataFrame:
    """Rows in order until the first that would exceed `most` in sum."""
    return accumulated(rows, [by], [F.col(order)], {"__sum": F.col(size)}).where(F.col("__sum") <= most).drop("__sum")


def interleaved(rows: DataFrame, most: int = 3) -> DataFrame:
    """(topic, ord, item): a round robin over topics of `most` items each, an item once, with pos."""
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("topic").orderBy("ord"))).where(F.col("nth") <= most)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("item").orderBy("nth", "topic"))).where("again = 1")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("nth", "topic"))).drop("again")


def reranked(rows: DataFrame, score: str, n: int = 50) -> DataFrame:
    """Adds pos: the first n rows of each query by another score, the rest in order."""
    head = F.col("ord") <= n
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col(score)).otherwise(F.lit(0.0)), "ord")))


def hybrid_merge(vectors: DataFrame, terms: DataFrame, vector_weight: float = 0.5, term_weight: float = 0.5, k: int = 30) -> DataFrame:
    """(q, paper_id, vec_id, score, rank): the k best of vector rows (q, paper_id, vec_id, dist) and papers that only the terms
    found (q, paper_id, bm25), which have no vec_id and are named without version. Papers are the same without their versions. Each signal is scaled to 0 to 1 within a query, one value alone to 0; an
    absent signal is 0, a null distance 0.5. A paper's rows of terms count by their best; ties go to vector rows, then by id."""

    def scaled(c: Column) -> Column:
        low, high = F.min(c).over(Window.partitionBy("q")), F.max(c).over(Window.partitionBy("q"))
        return (c - low) / F.when(high > low, high - low).otherwise(1.0)

    base = ids.normalize_id(F.col("paper_id")).alias("base")
    v = vectors.withColumn("v", scaled(1 - F.coalesce("dist", F.lit(0.5)))).select("q", "paper_id", base, "vec_id", "v")
    b = terms.withColumn("b", scaled(F.col("bm25"))).groupBy("q", base).agg(F.max("b").alias("b"))
    score = vector_weight * F.coalesce("v", F.lit(0.0)) + term_weight * F.coalesce("b", F.lit(0.0))
    place = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), F.col("vec_id").asc_nulls_last(), "paper_id")
    merged = v.join(b, ["q", "base"], "full").withColumn("paper_id", F.coalesce("paper_id", "base")).withColumn("score", score)
    return merged.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("q", "paper_id", "vec_id", "score", "rank")
