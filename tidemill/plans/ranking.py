"""Queries of retrieval from question to ranked papers, on real scores of both kinds.

Documents that have a vector (vec_id = doc_id) are chunks, four neighbours a paper; every hundredth is a question, its first
line the words and its vector the meaning. Vector hits name papers with a version, hits of terms without.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import ids, questions, text
from tidemill.operators import retrieval
from tidemill.plans.registry import query, tokens_sql
from tidemill.sources.stored import stored
from tidemill.sources.tables import table


def _chunks(spark, sf_dir):
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    number = F.floor(F.col("doc_id") / 4)
    base = F.format_string("%04d.%05d", 2401 + F.pmod(number, F.lit(12)), F.pmod(number, F.lit(90_000)))
    d = d.select(F.col("doc_id").alias("vec_id"), base.alias("base"), F.concat(base, F.lit("v"), (number % 3 + 1).cast("string")).alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    return d.join(v.select("vec_id", "embedding"), "vec_id")


_C = r"""c AS (SELECT doc_id, title, text, v, base, base || 'v' || (doc_id // 4 % 3 + 1) AS paper_id FROM (SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text, e.embedding::DOUBLE[] AS v,
  printf('%04d.%05d', 2401 + d.doc_id // 4 % 12, d.doc_id // 4 % 90000) AS base FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)),
asked AS (SELECT doc_id AS q, title AS x, v AS qv FROM c WHERE doc_id % 100 = 0)"""


def _questions(chunks):
    return chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("title").alias("question"), F.col("embedding").alias("qv"))


_LONG = "(VALUES {}) l(i, pattern, long)".format(", ".join(f"({i}, '(^|[^a-z0-9가-힣])({short}|{short.replace('-', ' ')})($|[^a-z0-9가-힣])', '{long}')" for i, (short, long) in enumerate(questions.EXPANSIONS.items())))


def expanded_sql(source: str, key: str) -> str:
    """CTEs ending in wide (key, x): the questions x of `source` as the search by terms takes them."""
    tail, short = questions.GENERIC_TAIL, questions.SHORT_TAIL
    low, words = "lower(x)", "list_distinct(regexp_split_to_array(regexp_replace(lower(x), '[-_]+', ' ', 'g'), '\\s+'))"
    return rf"""named AS (SELECT {key}, min(i) AS i, long FROM {source}, {_LONG} WHERE regexp_matches(regexp_replace(lower(trim(x)), '[-_]+', ' ', 'g'), pattern) AND NOT contains(lower(trim(x)), lower(long)) GROUP BY {key}, long),
full_names AS (SELECT s.{key}, any_value(trim(x)) || COALESCE(' ' || string_agg(long, ' ' ORDER BY i), '') AS x FROM {source} s LEFT JOIN named n ON n.{key} = s.{key} GROUP BY s.{key}),
general AS (SELECT {key}, CASE WHEN len(x) >= 12 AND NOT regexp_matches({low}, '\b\d{{4}}\.\d{{4,5}}\b') AND NOT (contains({low}, 'survey') AND contains({low}, 'benchmark'))
    AND len(list_intersect({words}, list_distinct(string_split('{tail}', ' ')))) < 5
    AND (contains({low}, 'retrieval augmented generation') OR contains({low}, 'retrieval-augmented') OR (contains({low}, 'retrieval') AND regexp_matches({low}, 'generation|accuracy|improve|improving|quality|question answering')) OR regexp_matches(regexp_replace({low}, '[-_]+', ' ', 'g'), '(^|[^a-z0-9가-힣])rag($|[^a-z0-9가-힣])'))
  THEN x || ' {tail}' ELSE x END AS x FROM full_names),
wide AS (SELECT {key}, CASE WHEN len(x) >= 8 THEN array_to_string(list_concat([x], list_filter({short}, lambda w: NOT contains({low}, w))), ' ') ELSE x END AS x FROM general)"""


_SAMPLES = ("", " self-rag", " RAG 비교", " retrieval quality", " HyDE와 colbert", " retrieval-augmented survey benchmark", " 2401.00001 rag", " crag, self rag dpr")


@query(f"WITH src AS (SELECT doc_id, split_part(text, chr(10), 1) || {list(_SAMPLES)}[doc_id % {len(_SAMPLES)} + 1] AS x FROM documents WHERE text IS NOT NULL), {expanded_sql('src', 'doc_id')} SELECT doc_id, md5(x) AS digest, len(x)::INT AS n_chars FROM wide")
def query_expansion(spark, sf_dir):
    """Every document's first line as a question, with short names and general words behind it in turn."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    behind = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % len(_SAMPLES) + 1).cast("int"))
    x = questions.expanded(F.concat(F.substring_index("text", "\n", 1), behind))
    return d.select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("digest"), F.length("x").alias("n_chars"))


_BM = rf"""{expanded_sql('asked', 'q')}, t AS (SELECT base, {tokens_sql('text')} AS t FROM c), plen AS (SELECT base, sum(len(t)) AS len FROM t GROUP BY base HAVING sum(len(t)) > 0),
post AS (SELECT base, term, count(*) AS tf FROM (SELECT base, unnest(t) AS term FROM t) GROUP BY ALL), stat AS (SELECT count(*) AS n, avg(len) AS m FROM plen),
raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, stat GROUP BY term),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
terms AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest({tokens_sql('x')}) AS term FROM wide) GROUP BY ALL),
bm AS (SELECT q, base, greatest(0, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m)))) AS bm25 FROM post JOIN idf USING (term) JOIN terms USING (term) JOIN plen USING (base), stat GROUP BY q, base)"""


def _term_scores(chunks, asked, k, wanted=None):
    """(q, base, bm25, by, wanted): the Okapi scores of papers, all chunks of one together, for the questions as widened: each
    question's k best of each block, and the wanted ones."""
    docs = stored(chunks.select("base", text.tokens(F.col("text")).alias("tokens")), "tokens")
    wide = asked.select("q", questions.expanded(F.col("question")).alias("x")).select("q", text.tokens(F.col("x")).alias("terms"))
    n, mean, size = docs.groupBy("base").agg(F.sum(F.size("tokens")).alias("len")).where("len > 0").agg(F.count("*"), F.avg("len"), F.sum("len")).first()
    counts = stored(docs.select("base", F.explode(F.array_distinct("tokens")).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df")), "counts")
    scores = retrieval.best_by_terms(docs, retrieval.term_weights(counts, n), wide, mean or 1.0, (n, size or 0), k, "base", wanted)
    return scores.select("q", "base", F.greatest("score", F.lit(0.0)).alias("bm25"), "by", "wanted")


_POOL = rf"""{_C}, {_BM}, near AS (SELECT q, qv, x, doc_id, base, paper_id, title, text, 1 - list_cosine_similarity(qv, v) AS dist FROM c, asked),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, doc_id) AS rank FROM near),
tops AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(x), '[^0-9A-Za-z가-힣]+'), lambda w: len(w) >= 2)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^0-9A-Za-z가-힣]+'), lambda w: len(w) >= 2)) AS b, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 600) AS head FROM r WHERE rank <= 100),
marked AS (SELECT *, CASE WHEN len(a) >= 2 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS share, len(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30 AND
  CASE WHEN contains(lower(head), 'doi:') OR contains(lower(head), 'doi.org/') THEN 2 ELSE 0 END + CASE WHEN contains(lower(head), 'issn') OR contains(lower(head), 'isbn') THEN 2 ELSE 0 END + regexp_matches(head, '_[A-Z][A-Za-z].*?_')::INT
  + contains(head, 'https://doi.org/')::INT + len(regexp_extract_all(head, '\[\d{{1,4}}\]')) + regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^\s*[-–•*]?\s*\[?\d*\]?\s*[A-Z][a-z]+\s+[A-Z]')::INT >= 3 AS refs FROM tops),
firsts AS (SELECT *, first_value(doc_id) OVER (PARTITION BY q ORDER BY share DESC, rank) AS best FROM marked),
hits AS (SELECT * FROM (SELECT q, base, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, base) AS hit FROM bm WHERE bm25 > 0) WHERE hit <= 120),
more AS (SELECT n.*, hit, row_number() OVER (PARTITION BY n.q, n.base ORDER BY dist, doc_id) AS nth FROM near n JOIN hits h ON h.q = n.q AND h.base = n.base WHERE NOT EXISTS (FROM tops t WHERE t.q = n.q AND t.base = n.base)),
every AS (SELECT q, doc_id, base, paper_id, title, x, dist, 0 AS k1, refs::INT AS k2, (NOT (share >= 0.6 AND doc_id = best))::INT AS k3, rank AS k4 FROM firsts
  UNION ALL SELECT q, doc_id, base, paper_id, title, x, dist, 1, hit, nth, 0 FROM more WHERE nth <= 5 AND len(text) >= 80),
pool AS (SELECT e.q, e.doc_id, e.base, e.paper_id, e.title, e.x, e.dist, k1, COALESCE(bm25, 0) AS bm25, row_number() OVER (PARTITION BY e.q ORDER BY k1, k2, k3, k4, doc_id) AS ord FROM every e LEFT JOIN bm ON bm.q = e.q AND bm.base = e.base),
sig AS (SELECT *, 1 / (1 + greatest(0, dist)) AS v, bm25 AS b FROM pool),
fus AS (SELECT *, (0.5 * COALESCE((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0.5) + 0.5 * COALESCE((b - min(b) OVER w) / nullif(max(b) OVER w - min(b) OVER w, 0), 0))
  * CASE WHEN len(trim(x)) >= 5 AND contains(lower(title), lower(trim(x))) THEN 1.2 ELSE 1 END AS score FROM sig WINDOW w AS (PARTITION BY q))"""


def _retrieved(spark, sf_dir):
    """Chunks, questions and the stored pool of each question, scored; the pool is read more than once."""
    chunks = stored(_chunks(spark, sf_dir), "chunks")
    asked = _questions(chunks)
    stripped = text.stripped(F.col("text"))
    narrow = chunks.select("vec_id", "embedding", "paper_id", "title", F.length("text").alias("n_chars"), text.reference_like(stripped).alias("refs"))
    pool = retrieval.candidates(asked, narrow, lambda wanted, k: _term_scores(chunks, asked, k, wanted)).join(asked.select("q", "question"), "q")
    return chunks, asked, stored(retrieval.fused(pool, query=F.col("question")), "pool")


@query(f"WITH {_POOL} SELECT q, ord, doc_id AS vec_id, paper_id, round(dist, 6) AS dist, round(bm25, 6) AS bm25, k1 = 1 AS by_terms FROM pool")
def candidate_pool(spark, sf_dir):
    _, _, pool = _retrieved(spark, sf_dir)
    nearest = F.row_number().over(retrieval.Window.partitionBy("q").orderBy("ord")) > 100
    return pool.select("q", "ord", "vec_id", "paper_id", F.round(F.abs("dist") * F.signum(F.round("dist", 6)), 6).alias("dist"), F.round("bm25", 6).alias("bm25"), nearest.alias("by_terms"))


@query(f"WITH {_POOL} SELECT q, doc_id AS vec_id, round(score, 6) AS score FROM fus")
def minmax_fusion(spark, sf_dir):
    return _retrieved(spark, sf_dir)[2].select("q", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_POOL} SELECT q, doc_id AS vec_id, round(1 / (60 + row_number() OVER (PARTITION BY q ORDER BY round(v, 12) DESC, ord)) + 1 / (60 + row_number() OVER (PARTITION BY q ORDER BY round(b, 9) DESC, ord)), 9) AS rrf FROM sig")
def rrf_fusion(spark, sf_dir):
    pool = _retrieved(spark, sf_dir)[2].withColumns({"v": F.round("v", 12), "b": F.round("b", 9)})
    return retrieval.rrf(pool).select("q", "vec_id", F.round("rrf", 9).alias("rrf"))


_PAPERS = f"""{_POOL}, nth AS (SELECT *, row_number() OVER (PARTITION BY q, paper_id ORDER BY round(score, 9) DESC, ord) AS nr FROM fus),
whole AS (SELECT q, paper_id, count(*) AS n_chunks, sum(CASE nr WHEN 1 THEN round(score, 9) WHEN 2 THEN 0.15 * round(score, 9) ELSE 0 END) AS s, min(ord) AS o, arg_min(dist, nr) AS d FROM nth GROUP BY q, paper_id)"""


@query(f"WITH {_PAPERS} SELECT q, paper_id AS paper, n_chunks, round(s, 6) AS score FROM whole")
def doc_score_top2(spark, sf_dir):
    pool = _retrieved(spark, sf_dir)[2].withColumn("score", F.round("score", 9))
    return retrieval.document_scores(pool).select("q", "paper", "n_chunks", F.round("score", 6).alias("score"))


@query(f"""WITH {_PAPERS}, lead AS (SELECT base, arg_min(v, doc_id) AS tv FROM c GROUP BY base), likes AS (SELECT w.*, greatest(0, list_cosine_similarity(qv, tv)) AS l FROM whole w JOIN asked USING (q) JOIN lead ON lead.base = split_part(paper_id, 'v', 1)),
a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round((s + 0.08 * l) * CASE WHEN l > 0.7 THEN 1.05 ELSE 1 END, 9) DESC, o) AS r1 FROM likes),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r1 > 50, CASE WHEN r1 <= 50 THEN round(d, 9) ELSE 0 END, r1) AS place FROM a)
SELECT q, b.paper_id AS paper, place, nr AS nth, doc_id AS vec_id FROM b JOIN nth USING (q, paper_id) WHERE place <= 5 AND nr <= 2""")
def ranked_papers(spark, sf_dir):
    """Questions to five papers with two chunks each: pool, fusion, title's likeness (of the paper's first chunk's vector, as
    there are no vectors of titles), then the first fifty again by their best chunk's closeness."""
    chunks, asked, pool = _retrieved(spark, sf_dir)
    first = chunks.groupBy(F.col("base").alias("of")).agg(F.min_by("embedding", "vec_id").alias("tv"))
    rows = pool.join(asked.select("q", "qv"), "q").join(first, ids.normalize_id(F.col("paper_id")) == F.col("of"))
    rows = rows.withColumns({"score": F.round("score", 9), "likeness": F.greatest(F.lit(0.0), retrieval.cosine(F.col("qv"), F.col("tv"))), "close": F.round(-F.col("dist"), 9)})
    ranked = retrieval.ranked_papers(rows.select("q", "paper_id", "ord", "score", "likeness", "close"), most=5, per_paper=2, pool=50)
    return ranked.join(pool.select("q", "ord", "vec_id"), ["q", "ord"]).select("q", "paper", F.col("place").cast("long").alias("place"), F.col("nth").cast("long").alias("nth"), "vec_id")


@query(f"""WITH {_PAPERS}, a AS (SELECT q, paper_id, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, o) AS pos, paper_id IN (SELECT p.paper_id FROM c p WHERE p.doc_id IN (40, 41, 160)) AS safe FROM whole),
m AS (SELECT *, (safe AND pos > 3)::INT AS missed FROM a), k AS (SELECT *, sum(missed) OVER (PARTITION BY q) AS n FROM m)
SELECT q, paper_id AS paper, row_number() OVER (PARTITION BY q ORDER BY pos) AS place FROM k WHERE pos <= 3 - n OR missed = 1""")
def paper_ranking(spark, sf_dir):
    """Three papers of each question by their chunks' scores alone; two named papers take the last places if they are in the pool."""
    chunks, _, pool = _retrieved(spark, sf_dir)
    named = chunks.where("vec_id IN (40, 41, 160)").select(F.col("paper_id").alias("paper")).distinct()
    safe = pool.select("q", F.col("paper_id").alias("paper")).join(named, "paper").distinct()
    rows = pool.select("q", "paper_id", "ord", F.round("score", 9).alias("score"), F.lit(0.0).alias("likeness"), F.lit(0.0).alias("close"))
    ranked = retrieval.ranked_papers(rows, most=3, per_paper=1, pool=0, protected=safe)
    return ranked.select("q", "paper", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_C}, {_BM}, near AS (SELECT q, doc_id, base, paper_id, text, 1 - list_cosine_similarity(qv, v) AS dist FROM c, asked), v AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, doc_id) AS r FROM near QUALIFY r <= 30),
hits AS (SELECT * FROM (SELECT q, base, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, base) AS hit FROM bm WHERE bm25 > 0) WHERE hit <= 120),
more AS (SELECT n.*, row_number() OVER (PARTITION BY n.q, n.base ORDER BY dist, doc_id) AS nth FROM near n JOIN hits h ON h.q = n.q AND h.base = n.base WHERE NOT EXISTS (FROM v WHERE v.q = n.q AND v.base = n.base))
SELECT q, doc_id AS vec_id, paper_id, false AS by_terms FROM v UNION ALL SELECT q, doc_id, paper_id, true FROM more WHERE nth <= 5 AND len(text) >= 80""")
def bm25_union(spark, sf_dir):
    """The thirty nearest chunks of each question, and chunks of the papers that only the terms found."""
    chunks = stored(_chunks(spark, sf_dir), "chunks")
    asked = _questions(chunks)
    near = retrieval.nearest(chunks.select("vec_id", "embedding", "paper_id"), asked.select("q", "qv"), 30).select("q", "paper_id", F.col("vec_id").alias("ord"), "dist")
    hits = stored(retrieval.top_k(_term_scores(chunks, asked, 120), 120, by="by", key="base").select("q", F.col("base").alias("paper_id"), "rank"), "hits")
    # only chunks of papers that some question's terms found are measured
    found = chunks.join(hits.select("q", F.col("paper_id").alias("base")), "base").join(asked.select("q", "qv"), "q")
    found = found.select("q", "paper_id", F.col("vec_id").alias("ord"), (1 - retrieval.cosine(F.col("embedding"), F.col("qv"))).alias("dist"), F.length("text").alias("n_chars"))
    return retrieval.with_term_papers(near, hits, found).select("q", F.col("ord").alias("vec_id"), "paper_id", "by_terms")


@query(f"""WITH {_C}, {_BM}, vec AS (SELECT q, doc_id, base, paper_id, list_cosine_similarity(qv, v) AS sim, row_number() OVER (PARTITION BY q ORDER BY 1 - list_cosine_similarity(qv, v), doc_id) AS r FROM c, asked QUALIFY r <= 20),
v AS (SELECT *, (sim - min(sim) OVER w) / CASE WHEN max(sim) OVER w > min(sim) OVER w THEN max(sim) OVER w - min(sim) OVER w ELSE 1 END AS v FROM vec WINDOW w AS (PARTITION BY q)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, base) AS hit FROM bm WHERE bm25 > 0) WHERE hit <= 20),
b AS (SELECT *, (bm25 - min(bm25) OVER w) / CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN max(bm25) OVER w - min(bm25) OVER w ELSE 1 END AS b FROM top WINDOW w AS (PARTITION BY q)),
merged AS (SELECT v.q, v.paper_id, v.doc_id, 0.5 * v.v + 0.5 * COALESCE(b.b, 0) AS score FROM v LEFT JOIN b ON b.q = v.q AND b.base = v.base
  UNION ALL SELECT q, base, NULL, 0.5 * b FROM b WHERE NOT EXISTS (FROM v WHERE v.q = b.q AND v.base = b.base))
SELECT q, paper_id, doc_id AS vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id NULLS LAST, paper_id) AS rank FROM merged) WHERE rank <= 30""")
def hybrid_merge(spark, sf_dir):
    """The twenty nearest chunks of each question and the twenty best papers by terms, named with and without version."""
    chunks = stored(_chunks(spark, sf_dir), "chunks")
    asked = _questions(chunks)
    near = retrieval.nearest(chunks.select("vec_id", "embedding", "paper_id"), asked.select("q", "qv"), 20).select("q", "paper_id", "vec_id", "dist")
    found = retrieval.top_k(_term_scores(chunks, asked, 20), 20, by="by", key="base").select("q", F.col("base").alias("paper_id"), "bm25")
    return retrieval.hybrid_merge(near, found).select("q", "paper_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
