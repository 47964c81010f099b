"""Texts are worked through once for each pass over them: what is costly in an expression stands once in its plan."""

import re
import time

from pyspark.sql import functions as F

from tidemill.functions import answers as rules
from tidemill.functions import text
from tidemill.operators import answers, retrieval
from tidemill.plans import answers as plans
from tidemill.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_tokenized_once_for_their_counts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append(df) or df)
    docs = spark.createDataFrame([(1, "bb aa bb"), (2, "aa x-y cc-dd"), (3, ""), (4, None), (5, "- x"), (6, "cc")], "doc_id long, text string")
    counts = retrieval.document_counts(docs.select("doc_id", text.tokens(F.col("text")).alias("tokens")))
    assert plan(kept[0]).count("regexp_extract_all") == 1
    rows = {r.term: r for r in counts.collect()}
    assert {t: r.df for t, r in rows.items()} == {"aa": 2, "bb": 1, "xy": 1, "cc": 2, "dd": 1, "ccdd": 1}
    assert (sum(r.begun for r in rows.values()), sum(r["size"] for r in rows.values())) == (3, 9)


def test_weights_are_made_of_kept_counts(spark, sf_dir):
    docs, weights, mean, (n, size) = catalogue._index(spark, sf_dir)
    assert "regexp_extract_all" not in plan(weights)
    told = docs.where(F.size("tokens") > 0).agg(F.count("*"), F.avg(F.size("tokens")), F.sum(F.size("tokens"))).first()
    assert tuple(told) == (n, mean, size)


def test_lines_of_answers_are_made_once(spark):
    a = spark.createDataFrame([(1, "### 서론\na\n\n### 본론\n1. b\n2. c\n\n### 결론\nd")], "answer long, text string")
    made = plan(answers.lines(a))
    assert "size(split(" not in made  # the body is not split again for each of its lines
    assert made.count(rules.BODY) == plan(a.select(rules.sections(F.col("text")).alias("s"))).count(rules.BODY)  # nor cut out again


def test_grounding_reads_answers_once(spark, sf_dir):
    made = plan(plans.grounded_answers(spark, sf_dir))
    assert made.count("Relation [") == 2  # the answers and their sources


def test_numbers_that_stand_in_a_source(spark):
    sources = ["1.2.3 12,5 7", "a12 .5 x,6 34", "3.14, 15. 9,2,6", "٣٤ 5٦ 1,000,000", "12.50%", "", "20-30", "1..2", "8.x 0.75"]
    asked = sorted({n for s in sources for n in re.findall(r"\d+(?:[.,]\d+)?|\d", s)} | {"1", "2", "12", "5", "1,000", "000", "50", "3.1", "0"})
    rows = spark.createDataFrame([(s, n) for s in sources for n in asked], "s string, n string")
    found = rows.select("s", "n", F.array_contains(rules.standing(F.col("s")), F.col("n")).alias("new"), rules._stands(F.col("n"), F.col("s")).alias("old")).collect()
    assert [r for r in found if r.new != r.old] == [] and any(r.new for r in found)


#: Patterns as they were before they looked at what is cheap first, and those of today.
PATTERNS = {
    r"(?U)\s*\((?:참고[:：]?\s*)?[^()\n]*문서\s*\d[^()\n]*\)": rules.DOCUMENT_NOTE,
    r"(?U)(?<![\[\w])문서\s*(\d{1,2}(?:\s*·\s*\d{1,2}(?!\d|\.\d))*)(?!\s*\])": rules.DOCUMENT_BARE,
    r"(?U)(?<![\d.])(\d+\.\d+)(?![\d.])": rules.DECIMAL, r"(?U)\b(?:19|20)\d{2}\b": rules.YEAR,
    r"(?mdU)(?:^###\s*결론\s*$|<b>결론</b>)": rules.CONCLUSION,
}


def test_patterns_find_what_they_found(spark):
    texts = ["a (문서 1)  \n (참고: 문서 2) ( (문서 3) 　(문서 4 x)y", "문서 1 [문서 2] 문서 3 · 4.5 a문서 5 _문서 6 문서7] 문서", "1.5 x2.25 3.4.5 .6 7.8. ٣.٤ 9.10", "1999 a2001 2002b 20033 (2004) 1899 2019-2020", "x ### 결론\n### 결론 \n<b>결론</b> ###결론\n###\n결론\r\n", ""]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    for old, new in PATTERNS.items():
        rows = d.select(F.regexp_replace("s", old, "{$0}").alias("old"), F.regexp_replace("s", new, "{$0}").alias("new")).collect()
        assert [r.new for r in rows] == [r.old for r in rows] and any("{" in r.new for r in rows)


def test_cut_takes_the_first_match(spark):
    texts = ["x ### 결론\n### 결론\nb\n### 결론\n", "### 결론\n", "a <b>결론</b>", "📎\n### 결론  \n📎 z", "none", ""]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    found = [r.c and tuple(r.c) for r in d.select(rules._cut(F.col("s"), rules.CONCLUSION).alias("c")).collect()]
    assert found == [("x ### 결론\n", "### 결론", "\nb\n### 결론\n"), ("", "### 결론\n", ""), ("a ", "<b>결론</b>", ""), ("📎\n", "### 결론  ", "\n📎 z"), None, None]


def test_long_white_space_is_read_once(spark):
    d = spark.createDataFrame([("a" + " " * 200_000 + "b (문서 1)",)], "s string")
    began = time.time()
    assert d.select(F.length(rules.internal_refs_cleaned(F.col("s"), F.create_map(F.lit(1), F.lit("x"))))).first()[0] == 200_002
    assert time.time() - began < 15  # its square is some 20,000,000,000 steps
