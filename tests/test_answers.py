"""Answers: lossless splitting, and the rules on items against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import answers as rules
from tidemill.operators import answers
from tidemill.plans import catalogue

IDS = ["2401.00001", "2401.00002v2", "2401.00003v1"]
BLOCKS = {"2401.00001": "[문서 1] gains 46{,}080 and 3.8\\% of 25", "2401.00002": "[문서 2] 24 languages, 61.85 points", "2401.00003": "2025 saw 7 and 512"}


def made(rng):
    """An answer of random items, maybe without a head."""
    heads = ("### 서론", "### 본론", "### 결론") if rng.random() < 0.5 else ("<b>서론</b>", "<b>본론</b>", "<b>결론</b>")
    items = []
    for _ in range(rng.integers(0, 6)):
        said = [f"{rng.choice(['값은', 'score'])} {rng.choice(['46,080', '3.8%', '25', '24', '61.85', '99', '7', '2025', '512', 'x'])}{rng.choice(['다.', '.', '!', ' 끝'])}" for _ in range(rng.integers(1, 4))]
        ids = "".join(f"[{i}]" for i in rng.choice(IDS, rng.integers(0, 3)))
        items.append(f"{rng.choice(['', ' '])}{rng.integers(1, 12)}. {rng.choice(['**N**: ', '<b>M</b>: ', ''])}{' '.join(said)}{ids}{rng.choice(['', '.', '  '])}{rng.choice(['', chr(10) + '더 있다 12.', chr(10)])}")
    body = "\n".join(items)
    parts = [f"{heads[0]}\n처음 1. 문장\n\n", f"{heads[1]}\n{body}\n", f"\n{heads[2]}\n1. 끝 99.\n"]
    return "".join(p for p in parts if rng.random() < 0.9)


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(9)
    return [made(rng) for _ in range(250)] + ["", None, "### 본론\n1. x", "<b>본론</b>", "### 결론\nx\n### 본론\n3. y\n4. z", "📎 \U0001f600 ### 본론 <b>본론</b>\n2. \U0001f600\n<b>결론</b>"]


def body_of(a):
    head = lambda n: r"(?:^###\s*%s\s*$|<b>%s</b>)" % (n, n)
    b, c = re.search(head("본론"), a, re.M), re.search(head("결론"), a, re.M)
    if not b:
        return None
    return b.end(), c.start() if c and c.start() > b.end() else len(a)


def renumber(a):
    if not (at := body_of(a)):
        return a
    n, out = 0, []
    for line in a[at[0] : at[1]].split("\n"):
        if m := re.match(r"(\s*)\d{1,2}\.(\s+)", line):
            n += 1
            line = f"{m[1]}{n}.{m[2]}{line[m.end():]}"
        out.append(line)
    return a[: at[0]] + "\n".join(out) + a[at[1] :]


CITED = re.compile(r"\[\s*(\d{4}\.\d{4,5})(?:v\d+)?\s*\]")


def ground(a):
    if not (at := body_of(a)):
        return a

    def bad(s, src):
        s = re.sub(r"\b(?:19|20)\d{2}\b", " ", re.sub(r"<[^>]+>", " ", CITED.sub(" ", s)))
        return any(len(t) > 1 and not re.search(rf"(?<![\d.,]){re.escape(t)}(?!\d)", src) for t in re.findall(r"\d+(?:[.,]\d+)?", s))

    out = []
    for line in a[at[0] : at[1]].split("\n"):
        m = re.match(r"\s*(?:<b>)?\d+\.\s", line)
        refs = CITED.findall(line[m.end() :]) if m else []
        src = "\n".join(BLOCKS[r].replace("{,}", ",").replace("\\%", "%") for r in dict.fromkeys(refs) if r in BLOCKS)
        if src:
            sents = re.split(r"(?<=[.!?。])\s+", line[m.end() :])
            keep = [s for s in sents if not bad(s, src)]
            plain = r"\[[^\]\n]*\]|\([^()\n]*\)|<b>[^<\n]*</b>|\*\*[^*\n]*\*\*|<[^>]+>"
            if len(keep) < len(sents) and any(re.search(r"\w", re.sub(plain, " ", s)) for s in keep):
                text = " ".join(keep)
                last = {r: x.group(0) for r, x in zip(refs, CITED.finditer(line[m.end() :]))}
                line = m[0] + text + "".join(x for r, x in last.items() if r not in CITED.findall(text))
        out.append(line)
    return a[: at[0]] + "\n".join(out) + a[at[1] :]


def merge(a):
    if not (at := body_of(a)):
        return a
    parts = re.split(r"(?m)^(?=[ \t]*\d{1,2}\.\s)", a[at[0] : at[1]])
    groups, order = {}, []
    for i, p in enumerate(parts):
        ids = set(CITED.findall(p)) if i else set()
        k = next(iter(ids)) if len(ids) == 1 else i
        if k not in groups:
            order.append(k)
        groups.setdefault(k, []).append(p)
    out = []
    for k in order:
        first, *more = groups[k]
        for x in more:
            said = re.sub(r"^\d{1,2}\.\s+(?:(?:<b>[^<\n]*</b>|\*\*[^*\n]*\*\*)\s*[:：]\s*)?", "", x.strip(), count=1)
            first = first.rstrip() + " " + said + first[len(first.rstrip()) :]
        out.append(first)
    return a[: at[0]] + "".join(out) + a[at[1] :]


def test_rules_on_items(spark, samples):
    docs = spark.createDataFrame(list(enumerate(samples)), "answer int, text string")
    blocks = spark.createDataFrame([(i, k, b) for i in range(len(samples)) for k, b in BLOCKS.items()], "answer int, id string, block string")
    rows = answers.lines(docs)
    of = lambda made: {r.answer: r.text for r in answers.assembled(made).collect()}
    texts = {i: s or "" for i, s in enumerate(samples)}
    assert of(rows) == texts
    assert of(answers.renumbered(rows)) == {i: renumber(s) for i, s in texts.items()}
    assert of(answers.grounded(rows, blocks)) == {i: ground(s) for i, s in texts.items()}
    assert of(answers.merged_papers(rows)) == {i: merge(s) for i, s in texts.items()}
    assert sum(ground(s) != s for s in texts.values()) > 20 and sum(merge(s) != s for s in texts.values()) > 20
    assert answers.assembled(answers.renumbered(answers.lines(docs.limit(0)))).count() == 0


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def test_contradictions(spark):
    a = "### 서론\n제공된 문서에는 찾는 연구가 없습니다. 이미지는 중요합니다.\n\n### 본론\n1. **C**: x [2412.17315v1].\n\n### 결론\nC 가 찾는 연구입니다.\n"
    f = lambda x: one(spark, rules.contradiction_dropped(F.lit(x)))
    assert f(a) == a.replace("제공된 문서에는 찾는 연구가 없습니다. ", "")
    assert f(a.replace("C 가 찾는 연구입니다.", "확인되지 않았다.")) == a.replace("C 가 찾는 연구입니다.", "확인되지 않았다.")
    for x in ("제공된 문서에는 없습니다.", a.replace("### 결론", ""), a.replace("제공된", "주어진")):
        assert f(x) == x


def test_related_items(spark):
    a = "### 서론\n캐시는 중요하다.\n\n### 본론\n1. **H**: 벤치. [문서 1]\n2. 설명 [문서 3]\n\n### 결론\n찾을 수 없습니다.\n📎 더"
    f = lambda x: one(spark, rules.related_marked(F.lit(x)))
    out = f(a)
    assert "1. **H** (관련 연구): 벤치." in out and "2. (관련 연구) 설명" in out and "### 서론\n제공된 문서에는 질문이 찾는 연구가 없습니다. 캐시는" in out
    assert f(out) == out and f(a.replace("찾을 수 없습니다.", "H 다.")) == a.replace("찾을 수 없습니다.", "H 다.")
    assert f("x") == "x"


def test_internal_refs(spark):
    ids = F.create_map(*[F.lit(x) for kv in {1: "2503.00001v3", 2: "2607.00002v1", 4: "2503.00001v3"}.items() for x in kv])
    f = lambda x: one(spark, rules.internal_refs_cleaned(F.lit(x), ids))
    assert f("문제[2503.00001v3] (참고: 문서 1·2는 다르다).\n[2503.00001v3]과 [2503.00001v3]는 50%. 문서 1·2는 같다. 문서 3·9는 모른다[문서 2].") == (
        "문제[2503.00001v3].\n[2503.00001v3]는 50%. [2503.00001v3][2607.00002v1]는 같다. 문서 3·9는 모른다[문서 2]."
    )
    numbers = F.create_map(F.lit("2503.00001"), F.lit(1))
    assert one(spark, rules.ids_as_refs(F.lit("a [2503.00001v3] b [2607.00002]"), numbers)) == "a [문서 1] b [2607.00002]"


def test_conclusions_take_the_body_s_decimals(spark):
    a = "<b>본론</b>\n1. <b>j</b>: 61.85 점, 4.79%. [2509.25085v4]\n2. <b>R</b>: 0.72, 2.9. [2312.02724v1]\n\n<b>결론</b>\nj 는 61.94 · 4.79% 다 [2509.25085v4]. R 은 0.88, 2.92 다[2312.02724v1].\n\n📎 61.94"
    f = lambda x: one(spark, rules.conclusion_aligned(F.lit(x)))
    assert f(a) == a.replace("61.94 ·", "61.85 ·")
    for x in ("61.94", "<b>본론</b>\n1. x [2412.17188v1][2412.13050v1]\n<b>결론</b>\nA 다[2412.13050v1]."):
        assert f(x) == x


def test_every_rule_has_its_effect_on_the_made_answers(spark, monkeypatch):
    counts = lambda: catalogue.QUERIES["answer_rules"](spark, "/root/testdata/sf0.001").head().asDict()
    full = counts()
    assert full["n"] > 0 and set(full.values()) == {full["n"]}
    for rule, column in (("contradiction_dropped", "contradiction"), ("related_marked", "related"), ("internal_refs_cleaned", "refs"), ("conclusion_aligned", "aligned")):
        with monkeypatch.context() as m:  # without the rule no answer counts
            m.setattr(rules, rule, lambda c, *_: c)
            assert counts() == full | {column: 0}


def test_refusals(spark):
    blocks = F.create_map(F.lit(1), F.lit("gain 12.5 on 300"), F.lit(2), F.lit("x 7"))
    f = lambda x: one(spark, rules.conclusion_fault(F.lit(x), blocks))
    long = "이 논문은 긴 문장으로 결과를 자세하게 설명하고 있으며 더 많은 것을 말한다 "
    assert [f(long), f("[문서 1]"), f(long + "漢[문서 1]"), f(long + "[문서 3]"), f(long + "12.5 그리고 7 [문서 1]"), f(long + "12.5, 300 [문서 1]")] == ["인용 없음", "길이", "한자", "본론 밖 문서 인용", "문서 밖 숫자 7", None]
    g = lambda s, x: one(spark, rules.translation_fault(F.lit(s), F.lit(x)))
    assert [g("up 5%", "5와 6"), g("a", "漢"), g("a", ""), g("a", "한국"), g("it does not win", "이 논문은 이긴다"), g("it does not win", "이 논문은 이기지 않는다")] == ["원문 밖 숫자 6", "한자", "꼴", "한국어 아님", "부정어 빠짐", None]
    h = lambda x, old: one(spark, rules.item_fault(F.lit(x), F.lit(old), F.array(F.lit("12.5")) ))
    assert [h("x", ""), h("가" * 80 + "漢", ""), h("가" * 80, "나" * 90), h("가" * 80 + " 99.", "x"), h("가" * 80 + " 12.5.", "x [2401.00001]")] == ["길이", "한자", "짧아짐", "문서 밖 숫자", None]
    assert one(spark, rules.third_person(F.lit("우리는 우리의 것을"))) == "이 논문은 이 논문의 것을"
    assert one(spark, rules.no_related_tail_dropped(F.lit("관련된 문서가 없습니다. [a] [b] 끝"))) == "관련된 문서가 없습니다.끝"
