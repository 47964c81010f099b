"""Judgements, kinds of texts and replies on stated cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import replies, text, verdicts
from tidemill.operators import classify, evaluate
from tidemill.plans import catalogue


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def test_grams(spark):
    def chars(t):
        out = []
        for w in t.lower().split():
            w = f" {w} "
            for n in range(1, 5):
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
                if n >= len(w):
                    break
        return sorted(out)

    for t in ("Ab c défg", "", "  x ", "한국어 RAG?"):
        assert sorted(one(spark, classify.character_grams(F.lit(t)))) == chars(t)
        w = t.lower().split()
        assert one(spark, classify.word_grams(F.lit(t))) == w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    assert one(spark, classify.word_grams(F.lit(None).cast("string"))) == []


def test_kinds_are_learnt(spark):
    rng = np.random.default_rng(2)
    listing, number = ["논문 목록을 알려줘", "관련 연구 추천해줘", "어떤 연구가 있어"], ["성능이 몇 퍼센트야", "수치가 얼마나 올랐어", "정확도는 얼마야"]
    rows = [(f"{rng.choice(['RAG', 'LLM', 'KV 캐시', '평가'])} {rng.choice(kind)}", y) for y, kind, n in ((1, listing, 30), (0, number, 90)) for _ in range(n)]
    made = spark.createDataFrame([*rows, ("x", None)], "q string, y int").repartition(3)
    model = classify.fit(made, "q", "y")
    asked = spark.createDataFrame([("임베딩 논문 추천해줘", 1), ("임베딩 정확도가 얼마나 돼", 0), ("", 0), (None, 0)], "q string, label int")
    found = classify.predicted(model, asked, "q")
    assert found.columns == ["q", "label", "predicted"] and [r.predicted for r in found.collect()][:2] == [1, 0]
    with pytest.raises(ValueError, match="both kinds"):
        classify.fit(made.where("y = 1"), "q", "y")


def test_text_kinds_of_held_out_documents(spark):
    rows = catalogue.QUERIES["text_kinds"](spark, "/root/testdata/sf0.01").collect()
    by = {y: [r.predicted for r in rows if r.quality == y] for y in (0, 1)}
    assert all(by.values()) and np.mean(by[1]) > np.mean(by[0]) + 0.3  # first lines of good texts are told from those of poor ones


def bucket(gram, words):
    """The dimension of an n-gram in plain integers."""
    most, place, h = 1 << 64, 0x9E3779B97F4A7C15, 0
    if not words:
        for c in gram:
            h = h * place + ord(c) + 1
    else:
        own = [sum((ord(c) + 1) * place ** (i + 1) for i, c in enumerate(w)) for w in gram.split(" ")]
        h = own[0] if len(own) == 1 else own[0] * 0xC2B2AE3D27D4EB4F + own[1]
    h %= most
    return (((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) % most) >> 50


def test_counts_are_those_of_all_grams(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("abcé한🙂İ") + ["\u00a0", "\u2003", "\x1c", " ", "\n"]
    texts = ["", None, "  ", "x", "한국어 RAG? RAG", "long" * 40, *["".join(rng.choice(letters, rng.integers(1, 300))) for _ in range(40)]]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), classify.character_grams(F.col("t")).alias("runs"), classify.word_grams(F.col("t")).alias("words")).collect()
    for piece in (1, 7, 1 << 18):  # pieces lose no pair of words
        monkeypatch.setattr(classify, "PIECE", piece)
        for r in made:
            runs, words = [np.bincount([bucket(g, kind) for g in grams], minlength=classify.DIMENSIONS) for grams, kind in ((r.runs, False), (r.words, True))]
            assert np.array_equal(classify.counts(r.low), np.concatenate([runs, words]))


def test_text_kinds_reads_whole_texts(spark, tmp_path):
    """Documents that differ behind 2,000 equal characters, on lines of their own or not."""
    same = "first line of all " * 120
    rows = [(i, same + ("\n" if i % 2 else " ") + (f"good prose {i}" if i % 5 < 3 else f"buy cheap {i}"), int(i % 5 < 3)) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    d.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    d.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    found = catalogue.QUERIES["text_kinds"](spark, str(tmp_path)).collect()
    assert len(found) == 30 and all(r.predicted == r.quality for r in found)


def test_replies(spark):
    f = lambda x: one(spark, replies.question_and_answer(F.lit(x)))
    assert tuple(f('{"instruction": " ", "question": "Q ‘1’?", "답변": "A\\n2"}')) == ("Q '1'?", "A\n2")
    assert tuple(f('text ```json\n{"prompt": "p", "response": "r"}\n``` {"a": 1}')) == ("p", "r")
    assert tuple(f('so {"question": "q", "answer": "a"} done')) == ("q", "a")
    assert tuple(f('{"instruction": "half", "output": "cut"')) == ("half", "cut")
    assert tuple(f("<think>hm</think>\nLet me think about it.\n질문: 무엇?\n\n답변: 이것\n더")) == ("무엇?", "이것\n더")
    assert f("plain") is None and f(None) is None and f('{"question": "q"}') is None
    assert one(spark, replies.without_asides(F.lit("Wait, no.\n한글 wait, 줄\nhmm! x\nkeep\n"))) == "한글 wait, 줄\nkeep\n"
    label = lambda x, labels: one(spark, replies.without_label(F.lit(x), labels))
    assert [label("A: yes", replies.ANSWER_LABELS), label("Agentic", replies.ANSWER_LABELS), label("question what", replies.QUESTION_LABELS), label(" 질문： x", replies.QUESTION_LABELS)] == ["yes", "Agentic", "what", "x"]
    assert [one(spark, replies.wrapped_code(F.lit(x))) for x in ('{"script": " x=1 "}', "x", '{"a": 1}', "{bad")] == ["x=1", None, None, None]
    bad = lambda q, a, s: one(spark, replies.needs_repair(F.lit(q), F.lit(a), F.lit(s)))
    assert [bad("q", "a 12.5", "x 12.5"), bad("q", "a 12", "x 12.5"), bad("q", "a 12", "x 125"), bad("", "a", "s"), bad("q", "Q: a A: b", ""), bad("Q&A 작성", "a", ""), bad("q 7", "a", " ")] == [False, False, True, True, True, True, False]


def test_violations_and_verdicts_of_null_texts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, verdicts.picked(none)) is None and one(spark, verdicts.picked(F.lit("답 : [ 문서 3]"))).doc == 3
    assert one(spark, text.hangul_share(F.lit("ab ### 본론 한a"))) == 0.5 and one(spark, text.hangul_share(none)) == 0.0


def test_first_stage_and_counts(spark):
    rows = [("a", "s2", True), ("a", "s1", False), ("b", "s1", True), ("b", "s2", True), ("c", "s9", True), ("d", "s2", None)]
    made = spark.createDataFrame(rows, "k string, s string, ok boolean")
    assert {tuple(r) for r in evaluate.first_stage(made, "k", "s", ("s1", "s2"), F.col("ok")).collect()} == {("a", "s2"), ("b", "s1")}
    reasons = spark.createDataFrame([(["x:1", "y"],), (["x:2"],), ([],), (None,)], "r array<string>")
    assert {tuple(r) for r in evaluate.violation_counts(reasons, "r").collect()} == {("x", 2), ("y", 1)}
    kept = spark.createDataFrame([("j", 1, True, True), ("j", 1, False, True), ("j", 2, False, True), ("j", 2, None, False)], "judge string, q int, kept boolean, relevant boolean")
    assert tuple(evaluate.keep_sets(kept, "judge", "q").head()) == ("j", 2, 1, 1, 0.666667, 0.666667)
