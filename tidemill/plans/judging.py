"""Queries of judgements of several readers, stages of assembly, kinds of texts, and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import blocks, replies, text
from tidemill.operators import classify, evaluate, retrieval
from tidemill.plans.registry import query
from tidemill.sources.tables import table


def _judges(spark, sf_dir):
    """Three readers of each labelled document, questions of a hundred documents: what each keeps, and what is relevant."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id")
    rows = [("short", F.col("n_chars") < 600), ("long", F.col("n_chars") >= 600), ("english", F.col("lang") == "en")]
    made = F.inline(F.array(*[F.struct(F.lit(n).alias("judge"), c.alias("kept")) for n, c in rows]))
    return d.select("doc_id", F.floor(F.col("doc_id") / 100).alias("q"), (F.col("quality") == 1).alias("relevant"), made)


_JUDGES = "d AS (SELECT doc_id, doc_id // 100 AS q, quality = 1 AS relevant, n_chars, lang FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), j AS (SELECT doc_id, q, relevant, 'short' AS judge, n_chars < 600 AS kept FROM d UNION ALL SELECT doc_id, q, relevant, 'long', n_chars >= 600 FROM d UNION ALL SELECT doc_id, q, relevant, 'english', lang = 'en' FROM d)"


@query(f"WITH {_JUDGES}, k AS (SELECT judge, relevant, COALESCE(kept, false) OR NOT bool_or(COALESCE(kept, false)) OVER (PARTITION BY judge, q) AS kept FROM j), n AS (SELECT judge, count(*) FILTER (kept AND relevant) AS tp, count(*) FILTER (kept AND NOT relevant) AS fp, count(*) FILTER (NOT kept AND relevant) AS fn FROM k GROUP BY judge) SELECT judge, tp, fp, fn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM n")
def keep_sets(spark, sf_dir):
    return evaluate.keep_sets(_judges(spark, sf_dir), "judge", "q")


@query(f"WITH {_JUDGES} SELECT a.judge AS a, b.judge AS b, count(*) AS n, round(avg((a.kept IS NOT DISTINCT FROM b.kept)::INT), 6) AS agreement FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.judge < b.judge GROUP BY ALL")
def judge_agreement(spark, sf_dir):
    return evaluate.judge_agreement(_judges(spark, sf_dir), "judge", "doc_id")


@query("WITH g AS (SELECT lang, doc_id // 50 AS q, quality + 1 - toxic AS grade FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT lang, q, count(*) FILTER (grade = 2) AS best, count(*) FILTER (grade = 0) AS zero, count(*) AS n FROM g GROUP BY lang, q) SELECT lang, count(*) AS questions, round(avg(best), 6) AS mean_best, count(*) FILTER (best > 0) AS with_best, sum(zero)::BIGINT AS zeros, sum(n)::BIGINT AS n FROM s GROUP BY lang")
def graded_relevance(spark, sf_dir):
    l = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    rows = table(spark, sf_dir, "documents").join(l, "doc_id").select("lang", F.floor(F.col("doc_id") / 50).alias("q"), (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return evaluate.graded(rows, "lang", "q", "grade")


@query("""WITH near AS (SELECT q.vec_id AS q, v.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 15),
gold AS (SELECT vec_id AS q, 't' || (vec_id // 50 % 3) AS type, vec_id + unnest([0, 1, 7]) AS item FROM embeddings WHERE vec_id % 50 = 0), h AS (SELECT g.q, g.type, count(*) AS n, count(*) FILTER (rank <= 5) AS n5, count(*) FILTER (rank <= 15) AS n15 FROM gold g LEFT JOIN near n ON n.q = g.q AND n.item = g.item GROUP BY ALL)
SELECT type, count(*) AS questions, count(*) FILTER (n5 > 0) AS hit_5, count(*) FILTER (n5 = n) AS all_5, count(*) FILTER (n5 >= 3) AS three_5, count(*) FILTER (n15 > 0) AS hit_15, count(*) FILTER (n15 = n) AS all_15, count(*) FILTER (n15 >= 3) AS three_15 FROM h GROUP BY type""")
def set_recall(spark, sf_dir):
    """Three gold vectors of each fiftieth one: itself, the next and the seventh after it."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    gold = q.select("q", F.concat(F.lit("t"), (F.floor(F.col("q") / 50) % 3).cast("string")).alias("type"), F.explode(F.array(*[F.col("q") + i for i in (0, 1, 7)])).alias("item"))
    return evaluate.set_recall(retrieval.nearest(v, q, 15).select("q", F.col("vec_id").alias("item"), "rank"), gold)


@query("WITH g AS (SELECT value / 1000.0 - floor(value / 1000.0) AS gap FROM events) SELECT count(*) AS n, round(avg(gap), 4) AS mean, round(median(gap), 4) AS median, min(gap) AS least, max(gap) AS greatest, count(*) FILTER (gap < 0.02) AS tiny, count(*) FILTER (gap BETWEEN 0.02 AND 0.05) AS small, count(*) FILTER (gap > 0.05 AND gap < 0.2) AS middling, count(*) FILTER (gap >= 0.2) AS large FROM g")
def gap_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 1000.0 - F.floor(F.col("value") / 1000.0)).alias("gap"))
    return evaluate.gap_stats(e, "gap")


_STAGES = ("long", "middle", "any")


@query("WITH r AS (SELECT source, doc_id, CASE WHEN n_chars > 3000 THEN 0 WHEN n_chars > 1000 THEN 1 ELSE 2 END AS s, n_chars % 3 <> 0 AS ok FROM documents) SELECT doc_id % 97 AS k, ['long', 'middle', 'any'][min(s) + 1] AS stage FROM r WHERE ok GROUP BY k")
def first_stage(spark, sf_dir):
    """The first stage in which a group of documents has one that passed."""
    stage = F.when(F.col("n_chars") > 3000, "long").when(F.col("n_chars") > 1000, "middle").otherwise("any")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("k"), stage.alias("stage"), (F.col("n_chars") % 3 != 0).alias("ok"))
    return evaluate.first_stage(d, "k", "stage", _STAGES, F.col("ok"))


@query("WITH v AS (SELECT unnest(list_filter([CASE WHEN len(text) > 4000 THEN 'length' END, CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN len(string_split(text, chr(10))) > 8 THEN 'lines' END], lambda x: x IS NOT NULL)) AS reason FROM documents) SELECT reason, count(*) AS n FROM v GROUP BY reason")
def violation_counts(spark, sf_dir):
    lines = F.size(F.split("text", "\n", -1))
    rules = [F.when(F.length("text") > 4000, F.concat(F.lit("length:"), F.length("text").cast("string"))), F.when(F.contains("text", F.lit("http")), "link"), F.when(lines > 8, F.concat(F.lit("lines:"), lines.cast("string")))]
    return evaluate.violation_counts(table(spark, sf_dir, "documents").select(F.array_compact(F.array(*rules)).alias("r")), "r")


@query("WITH p AS (SELECT lang, n_chars % 5 = 0 AS a, CASE WHEN doc_id % 9 <> 0 THEN n_chars % 7 = 0 END AS b FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND NOT COALESCE(b, false)) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM p GROUP BY lang")
def paired_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 5 == 0).alias("a"), F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") % 7 == 0).alias("b"))
    return evaluate.paired_counts(d, "a", "b", "lang")


@query()
def text_kinds(spark, sf_dir):
    """The quality that a model of two thirds of the labelled documents' whole texts predicts for the others."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").where("quality IS NOT NULL")
    model = classify.fit(rows.where("doc_id % 3 <> 1"), "text", "quality")
    return classify.predicted(model, rows.where("doc_id % 3 = 1").select("doc_id", "text", "quality"), "text").select("doc_id", "quality", "predicted")


_REPLY = """r AS (SELECT conv_id, turn, regexp_replace(lower(role), '[^a-z]', '', 'g') AS q, regexp_replace(string_split(text, chr(10))[1], '["\\\\{}`:]', '', 'g') AS a FROM conversations WHERE text IS NOT NULL)"""


@query(f"WITH {_REPLY} SELECT conv_id, turn, CASE WHEN turn % 5 < 4 AND trim(a) <> '' THEN q || ' ' || turn END AS question, CASE WHEN turn % 5 < 4 AND trim(a) <> '' THEN md5(trim(a)) END AS digest FROM r")
def replies_read(spark, sf_dir):
    """Turns as replies: an object of JSON, one in a fence behind an aside, one with a broken end, labelled lines, and none."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    a = F.regexp_replace(F.substring_index("text", "\n", 1), r'["\\{}`:]', "")
    q = F.concat(F.regexp_replace(F.lower("role"), "[^a-z]", ""), F.lit(" "), F.col("turn").cast("string"))
    json = F.concat(F.lit('{"question": "'), q, F.lit('", "answer": "'), a, F.lit('"}'))
    forms = [json, F.concat(F.lit("Wait, let me see.\n```json\n"), json, F.lit("\n```\n끝")), F.concat(F.lit("<think>x</think>"), F.regexp_replace(json, r"\}$", "")), F.concat(F.lit("질문: "), q, F.lit("\n\n답변: "), a), F.lit("nothing here")]
    found = replies.question_and_answer(F.element_at(F.array(*forms), (F.col("turn") % 5 + 1).cast("int")))
    return c.select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.question", F.md5("f.answer").alias("digest"))


@query()
def kept_blocks(spark, sf_dir):
    """Contexts of three blocks from each conversation, kept as a made reader says."""
    c = table(spark, sf_dir, "conversations").where("turn < 3 AND text IS NOT NULL")
    block = F.concat(F.lit("[2401.0000"), F.col("turn").cast("string"), F.lit("v1] "), F.col("text"))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), blocks.BETWEEN).alias("context"))
    said = F.element_at(F.array(F.lit("관련: 1, 3"), F.lit("관련: 없음"), F.lit("?"), F.lit("관련: 2")), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = rows.withColumn("chosen", blocks.relevant(said, F.size(blocks.blocks(F.col("context")))))
    return rows.select("conv_id", blocks.kept(F.lit(""), F.col("context"), F.col("chosen")).alias("k")).select("conv_id", "k.status", F.md5("k.context").alias("digest"))


@query(r"SELECT conv_id, turn, round(len(regexp_extract_all(text, '[가-힣]')) / greatest(1, len(regexp_extract_all(text, '[가-힣A-Za-z]'))), 6) AS hangul FROM conversations WHERE text IS NOT NULL")
def hangul_share(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", F.round(text.hangul_share(F.col("text")), 6).alias("hangul"))
