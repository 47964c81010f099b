"""Functions that SQL can't check, against plain Python or known values, and the streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import ids, questions, stats, text, verdicts
from tidemill.operators import grounding, keys, retrieval, schedule
from tidemill.sources import tables
from tidemill.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("2401.00001v2", "2401.00001"), ("solv-int/9901001v2", "solv-int/9901001v2"), (" 2401.1 ", "2401.1"), (None, ""), ("v2", "v2")])
def test_normalize_id(spark, value, want):
    assert one(spark, ids.normalize_id(F.col("c")), c=value) == want


def test_id_rules_differ(spark):
    assert one(spark, ids.normalize_id(F.col("c"), "suffix"), c="solv-int/9901001v2") == "solv-int/9901001"
    assert one(spark, ids.normalize_id(F.col("c"), "first"), c="solv-int/9901001v2") == "sol"


def test_tokens_of_hyphens(spark):
    assert one(spark, text.tokens(F.col("c")), c="State-of GPT-4x a") == ["state", "of", "stateof", "gpt", "4x", "gpt4x"]
    assert one(spark, text.tokens(F.col("c")), c=None) == []


def test_blank_texts(spark):
    for c in (None, "", "  "):
        assert one(spark, text.math_share(F.col("c")), c=c) == 1.0
        assert one(spark, text.url_share(F.col("c")), c=c) == 0.0
        assert one(spark, text.good_chunk(F.col("c")), c=c) is False
        assert one(spark, text.english_share(F.col("c")), c=c) == 0.0


def test_collapsed_spans(spark):
    span = "a repeated span of text "
    assert one(spark, text.collapsed_spans(F.col("c")), c=f"x {span * 3}y") == f"x {span}y"
    assert one(spark, text.collapsed_spans(F.col("c")), c="short short") == "short short"
    assert one(spark, text.collapsed_spans(F.col("c")), c=None) is None


def test_exact_tests(spark):
    assert one(spark, stats.mcnemar("b", "c"), b=8, c=8) == 1.0
    assert one(spark, stats.mcnemar("b", "c"), b=5, c=0) == pytest.approx(0.0625)
    assert one(spark, stats.mcnemar("b", "c"), b=0, c=0) == 1.0
    assert one(spark, stats.fisher("a", "b", "c", "d"), a=3, b=1, c=1, d=3) == pytest.approx(0.4857142857)


def test_numbers_need_support(spark):
    assert one(spark, grounding.unsupported(F.col("a"), F.col("s")), a="scores 81.5 and 77 in 2024", s="it has 81.5") == ["77"]
    assert one(spark, grounding.unsupported(F.col("a"), F.col("s")), a="scores 81.5", s=None) == []
    assert one(spark, grounding.unsupported(F.col("a"), F.col("s")), a="scores 81 and 815", s="it has 81.5") == ["815"]
    assert one(spark, text.math_share(F.col("a")), a="\n\n") == 1.0
    assert one(spark, text.good_chunk(F.col("a")), a="x" * 79 + "\n\n") is False


def test_fusion_of_equal_signals(spark):
    pool = spark.createDataFrame([(1, i, "p", "", None, 2.0) for i in range(3)], "q int, ord int, paper_id string, title string, dist double, bm25 double")
    rows = retrieval.fused(pool).orderBy("ord").collect()
    assert [r.b for r in rows] == [2.0] * 3
    assert [round(r.score, 6) for r in rows] == [0.5, 0.25, 0.0]  # without distances the order scores, equal BM25 counts 0


def test_first_per_paper_takes_turns(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate("AABA")], "q int, ord int, paper_id string")
    assert [r.paper_id for r in retrieval.first_per_paper(rows).orderBy("pos").collect()] == ["A", "B", "A", "A"]


def test_month_without_the_day(spark):
    at = lambda now, day: spark.range(1).select(schedule.next_monthly(F.lit(now), F.lit("08:00"), F.lit(day)).alias("x")).first().x
    assert at(datetime(2026, 1, 31, 9), 31) is None
    assert at(datetime(2026, 1, 31, 7), 31) == datetime(2026, 1, 31, 8)


def test_sources(spark, tmp_path):
    lines = [{"paper_id": "2401.00001v2", "title": " t ", "summary": "s", "text": "body", "date": "2024-01-02"}, {"paper_id": "x", "authors": ["a", "b"], "abstract": " ", "content": "c"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = tables.papers(spark, str(tmp_path)).collect()
    assert [(r.paper_id, r.title, r.abstract, r.content, r.published) for r in rows][:2] == [("2401.00001", "t", "s", "body", "2024-01-02"), ("x", "", "", "c", None)]
    assert rows[2].bad == "not json"


def test_appended_keeps_the_first(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, ord int"), spark.createDataFrame([("b", 3), ("b", 2), ("a", 4)], "k string, ord int")
    assert sorted(tuple(r) for r in keys.appended(old, new, F.col("k")).collect()) == [("a", 1), ("b", 2)]


def test_streams(spark, tmp_path):
    rows = [(1, 1, "queued", "2026-01-01T00:00:00"), (2, 1, "done", "2026-01-01T00:10:00"), (3, 2, "queued", "2026-01-01T01:30:00"), (3, 2, "queued", "2026-01-01T01:30:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("event", "job", "state", "ts"), r, strict=True))) for r in rows))
    stream = lambda: jobs.records(spark, str(tmp_path / "in"), "event long, job long, state string, ts timestamp")
    for name, df, mode in (("states", jobs.latest_states(stream(), "job", "state", "event"), "complete"), ("hours", jobs.per_window(stream(), "ts", "1 hour", "1 day"), "update"), ("firsts", jobs.first_seen(stream(), "event", "ts", "1 day"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("states").select("job", "state", "n").collect())) == [(1, "done", 2), (2, "queued", 2)]
    assert sorted(r.n for r in spark.table("hours").collect()) == [2, 2]
    assert spark.table("firsts").count() == 3


@pytest.mark.parametrize(("question", "years", "n"), [
    ("2026년에 나온 RAG 논문", (2026, 2026), None), ("2025년 이후 나온 양자화", (2025, None), None), ("2024년까지 나온 논문 6개 찾아줘", (None, 2024), 6),
    ("2023년부터 2026년까지 나온 논문", (2023, 2026), None), ("재작년 이전 연구 3개만 알려줘", (None, 2023), 3), ("7B 이하 모델", None, None), ("상위 10개 중 절반", None, None), (None, None, None),
])
def test_question_conditions(spark, question, years, n):
    found = one(spark, questions.year_range(F.col("c"), 2026), c=question)
    assert (found and tuple(found)) == years
    assert one(spark, questions.requested_count(F.col("c")), c=question) == n


@pytest.mark.parametrize(("lines", "want"), [(["x" * 20] * 3, True), (["x" * 20, "y" * 30, "x" * 20, "y" * 30], False), (["a"] * 5, False), ([], False)])
def test_has_repeated_line(spark, lines, want):
    assert one(spark, text.has_repeated_line(F.col("c")), c="\n".join(lines)) is want


@pytest.mark.parametrize(("query", "want"), [
    ("deep research agents for papers 2025", '"deep research" agents for'), ("deep research agents evaluation survey 2025", '"deep research" agents evaluation'),
    ("graph rag retrieval large Large", "graph rag retrieval"), ("recent xlarge model, methods tuning", "xlarge model tuning"), ("  best papers ", "best papers"), (None, ""),
])
def test_cleaned_query(spark, query, want):
    assert one(spark, questions.cleaned(F.col("c")), c=query) == want


@pytest.mark.parametrize(("raw", "graded", "want"), [
    ("답: 문서 3", False, ("있음", 3)), ("답： [문서 12]", False, ("있음", 12)), ("답: 없음", False, ("없음", None)), ("모름", False, None), (None, False, None),
    ("답: 부분, 문서 2", True, ("부분", 2)), ("답: 있음 [문서 4", True, ("있음", 4)), ("답: 없음", True, ("없음", None)), ("답: 문서 3", True, None),
])
def test_picked(spark, raw, graded, want):
    found = one(spark, verdicts.picked(F.col("c"), graded), c=raw)
    assert (found and tuple(found)) == want


def test_item_documents(spark):
    rows = spark.createDataFrame([(1, "문서 2: 항목 1, 3\n문서 1: 1\n문서 2: 1\n문서 3: 없음 1"), (2, "x"), (3, None)], "k long, raw string")
    found = {(r.k, r.item): r.docs for r in verdicts.item_documents(rows, "k", "raw", 2).collect()}
    assert found == {(1, 1): [2, 1]}


@pytest.mark.parametrize(("answer", "gold", "want"), [
    ("### 서론\n소개.\n### 본론\n1. A [문서 2]\n2. B [문서 1]\n### 결론\n끝", [2], []),
    ("### 서론\n소개.\n### 본론\n1. A [문서 1]\n2. B\n### 결론\n끝 [문서 9]", [2], ["인용범위", "항목무인용", "정답이1번아님"]),
    ("### 서론\n소개 {x} 2401.00001v2\n### 본론\n1. A [문서 1]\n### 결론\n끝", [], ["arXivID", "플레이스홀더/힌트누출", "정답없는데안밝힘"]),
    (f"### 서론\n{verdicts.NO_DOCUMENT}.\n### 본론\n1. A [문서 1]\n### 결론\n끝", [1], ["정답있는데없다고함"]),
    (None, [], ["섹션", "본론항목", "정답없는데안밝힘"]),
])
def test_format_violations(spark, answer, gold, want):
    rows = spark.createDataFrame([(answer, gold, 5)], "a string, g array<int>, n int")
    assert rows.select(verdicts.format_violations(F.col("a"), F.col("g"), F.col("n")).alias("x")).first().x == want
