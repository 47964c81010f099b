"""Queries of joins by likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import ids, text
from tidemill.operators import folds, matching
from tidemill.plans.registry import query
from tidemill.sources.tables import table


def _lines(spark, sf_dir):
    """(doc_id, line, text): the documents' lines by their key."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.select("doc_id", "line", ids.loose_key(F.col("text")).alias("text")).where("text <> ''")


@query()
def decontaminate_ratio(spark, sf_dir):
    """Lines of documents that are too close to a benchmark item's line, with the highest ratio."""
    lines = _lines(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("item")).select(ids.loose_key(F.col("item")).alias("item")).where("item <> ''")
    best = matching.alike(lines.select("text"), items).groupBy("text").agg(F.max("ratio").alias("ratio"))
    return lines.join(best, "text").select("doc_id", "line", F.round("ratio", 3).alias("ratio"))


@query("""WITH RECURSIVE n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE label IS NOT NULL),
f AS (SELECT label, vec_id, i, vec_id AS run, v AS mean FROM n WHERE i = 1
UNION ALL SELECT n.label, n.vec_id, n.i, CASE WHEN list_inner_product(f.mean, n.v) >= 0.12 THEN f.run ELSE n.vec_id END,
  CASE WHEN list_inner_product(f.mean, n.v) >= 0.12 THEN list_transform(list_zip(f.mean, n.v), lambda z: (z[1] + z[2]) / sqrt(2 + 2 * list_inner_product(f.mean, n.v))) ELSE n.v END FROM f JOIN n ON n.label = f.label AND n.i = f.i + 1)
SELECT label, vec_id, run FROM f""")
def semantic_merge(spark, sf_dir):
    """Neighbouring vectors of a label, merged while the next one is near the run's mean; these vectors are far apart, so near
    is a cosine of 0.12."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return folds.merged_runs(v, 0.12).select(F.col("grp").alias("label"), F.col("ord").alias("vec_id"), "run")


@query(r"""WITH d AS (SELECT doc_id, lower(regexp_replace(split_part(text, chr(10), 1), '[^\pL\pN\pM_]+', '', 'g')) AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\pL\pN\pM_]+', '', 'g')) AS k FROM pages)
SELECT doc_id, EXISTS (FROM p WHERE p.k <> '' AND (p.k = d.k OR (least(len(p.k), len(d.k)) >= 30 AND (starts_with(p.k, d.k) OR starts_with(d.k, p.k))))) AS known FROM d WHERE k <> ''""")
def known_titles(spark, sf_dir):
    """Whether a page has each document's title, or one that begins like it."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", ids.title_key(F.substring_index("text", "\n", 1)).alias("key"))
    p = table(spark, sf_dir, "pages").select(ids.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("key"))
    return d.join(matching.known_titles(d, p), "key").select("doc_id", "known")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^0-9A-Za-z가-힣]+'), lambda w: len(w) >= 2))"


@query(f"""WITH a AS (SELECT item_id, {_WORDS.format("split_part(text, chr(10), 1)")} AS w FROM benchmark), t AS (SELECT doc_id, {_WORDS.format("split_part(text, chr(10), 1)")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, greatest(len(list_intersect(a.w, t.w)) / len(a.w), len(list_intersect(a.w, t.w)) / len(t.w)) AS score FROM a, t WHERE len(a.w) >= 2 AND len(t.w) > 0)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score >= 0.6) WHERE r = 1""")
def paper_by_title(spark, sf_dir):
    """The document whose title is meant by the first line of each benchmark item."""
    words = lambda c: text.overlap_tokens(F.substring_index(c, "\n", 1))
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), words("text").alias("words"))
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), words("text").alias("words"))
    return matching.best_titles(a, t).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_TITLES = r"""t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN x || ': ' || title WHEN 1 THEN 'On ' || x || '-Net' || ' of ' || title ELSE title END AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title,
  regexp_extract(text, '([A-Za-z]{3})', 1) || upper(regexp_extract(text, '\n([A-Za-z]{2})', 1)) || (doc_id % 40) AS x FROM documents WHERE text IS NOT NULL))"""


def _named(spark, sf_dir):
    """Titles of which two in three hold a name made of the text's first letters, before a colon or inside."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    title = F.substring_index("text", "\n", 1)
    x = F.concat(F.regexp_extract("text", "([A-Za-z]{3})", 1), F.upper(F.regexp_extract("text", "\n([A-Za-z]{2})", 1)), (F.col("doc_id") % 40).cast("string"))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(x, F.lit(": "), title)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("On "), x, F.lit("-Net of "), title)).otherwise(title)
    return d.select("doc_id", made.alias("title"))


@query(rf"""WITH {_TITLES}, n AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(title, '(?:^|[^A-Za-z0-9-])([A-Za-z][A-Za-z0-9-]*)', 1), lambda w: len(w) >= 4 AND regexp_matches(w, '[a-z]') AND regexp_matches(substr(w, 2), '[A-Z0-9]'))) AS name FROM t),
h AS (SELECT name, doc_id, starts_with(title, name || ':') AS leads FROM n, t WHERE contains(title, name) AND regexp_matches(title, '(^|[^A-Za-z0-9])' || name || '($|[^A-Za-z0-9])')),
g AS (SELECT name, count(*) AS n, min(doc_id) AS id, sum(leads::INT) AS k, min(CASE WHEN leads THEN doc_id END) AS lead FROM h GROUP BY name)
SELECT name, CASE WHEN k = 1 THEN lead WHEN n = 1 THEN id END AS doc_id FROM g""")
def named_papers(spark, sf_dir):
    """The one paper that each name in the titles stands for."""
    t = _named(spark, sf_dir)
    names = t.select(F.explode(text.proper_names(F.col("title"))).alias("name"))
    return matching.named_titles(names, t.select(F.col("doc_id").alias("id"), "title")).select("name", F.col("id").alias("doc_id"))


_HEADS = "h AS (SELECT doc_id, lower(split_part(text, chr(10), 1) || ' ' || substr(text, len(split_part(text, chr(10), 1)) + 2, 500)) AS x FROM documents WHERE text IS NOT NULL)"
_KEYS = "k AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9A-Za-z가-힣]+'), lambda w: len(w) >= 3)) AS w FROM benchmark)"


def _heads(spark, sf_dir):
    """Title and the first 500 characters of what follows, in lower case."""
    title = F.substring_index("text", "\n", 1)
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("id"), F.lower(F.concat(title, F.lit(" "), F.substr("text", F.length(title) + 2, F.lit(500)))).alias("text"))


def _keywords(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^0-9A-Za-z가-힣]+"), lambda w: F.length(w) >= 3))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), words.alias("keywords"))


@query(f"WITH {_HEADS}, {_KEYS}, m AS (SELECT DISTINCT item_id, doc_id FROM k, h WHERE contains(x, w) AND doc_id % 7 <> item_id % 7) SELECT item_id, doc_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS nth FROM m) WHERE nth <= 5")
def keyword_supplement(spark, sf_dir):
    """Five more documents for each benchmark item by its words; a seventh of the documents, other ones for each, is present."""
    a, d = _keywords(spark, sf_dir), _heads(spark, sf_dir)
    present = a.select("q", (F.col("q") % 7).alias("r")).join(d.select("id", (F.col("id") % 7).alias("r")), "r").select("q", "id")
    return matching.keyword_supplement(a, d, present).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), F.col("nth").cast("long").alias("nth"))


@query(f"WITH {_HEADS}, {_KEYS}, w AS (SELECT DISTINCT w FROM k) SELECT w AS keyword, count(*) AS n, min(doc_id) AS first FROM w, h WHERE contains(x, w) GROUP BY w")
def keyword_counts(spark, sf_dir):
    """In how many documents' heads each of the benchmark's words stands, and the first of them."""
    words = _keywords(spark, sf_dir).select(F.explode("keywords").alias("keyword"))
    return matching.keyword_hits(_heads(spark, sf_dir), words).groupBy("keyword").agg(F.count("*").alias("n"), F.min("id").alias("first"))
