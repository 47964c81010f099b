"""Questions and answers in what a model wrote: asides and labels removed, JSON read, pairs that need repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.bind import once
from tidemill.functions.questions import trimmed
from tidemill.functions.text import straight_quotes, without_thinking

# Keys, labels and patterns that decide results.
QUESTION_KEYS, ANSWER_KEYS, CODE_KEYS = ("instruction", "question", "prompt", "질문"), ("output", "answer", "response", "답변"), ("code", "python", "script", "source")
QUESTION_LABELS, ANSWER_LABELS = ("Q", "Question", "질문"), ("A", "Answer", "답변")
ASIDE = r"(?iU)^\s*(?:wait|let me|i need to|i should|hmm|okay|oh)\b[,.\s!].{0,800}\s*$"
LONG_LINE = 900
GENERIC = ("Q&A를 작성", "Q&A 작성", "요약한 Q&A", "작성해주세요", "작성해 주세요")
MARKS = r"(?iU)(?:^|[\n\r\s])(?:Q\s*:|A\s*:|Question\s*:|Answer\s*:|질문\s*[:：]|답변\s*[:：])"
PAIRS = (
    r'(?is)"instruction"\s*:\s*"(.*?)"\s*,\s*"output"\s*:\s*"(.*?)"',
    r'(?is)"question"\s*:\s*"(.*?)"\s*,\s*"answer"\s*:\s*"(.*?)"',
    r"(?isU)(?:instruction|question|질문)\s*[:：]\s*(.+?)(?:\n|\r\n)+(?:output|answer|답변)\s*[:：]\s*(.+)",
)
FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def without_asides(c: Column) -> Column:
    """Without lines that are a short aside in English; lines with Hangul stay."""
    keep = lambda x: (trimmed(x) == "") | x.rlike("[가-힣]") | (F.length(trimmed(x)) > LONG_LINE) | ~trimmed(x).rlike(ASIDE)
    return F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r", -1), keep), "\n")


def cleaned_reply(c: Column) -> Column:
    """Without thinking and asides, quotes straightened."""
    return straight_quotes(without_asides(without_thinking(c)))


def without_label(c: Column, labels: tuple[str, ...]) -> Column:
    """Without the labels at the beginning; one of a single letter needs a colon, so words that begin with it stay."""
    out = trimmed(c)
    for label in labels:
        out = trimmed(F.regexp_replace(out, rf"(?iU)^\s*{label}\s*[:：]{'' if len(label) == 1 else '?'}\s*", ""))
    return out


def _field(c: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys with a text that isn't blank."""
    value = lambda k: F.nullif(trimmed(F.get_json_object(c, f"$['{k}']")), F.lit(""))
    return F.coalesce(*map(value, keys))


def wrapped_code(c: Column) -> Column:
    """The code in an object of JSON, null if the text is none or has none."""
    x = trimmed(c)
    return F.when(F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull(), _field(x, CODE_KEYS))


def question_and_answer(c: Column) -> Column:
    """Struct (question, answer) of a reply, or null: an object of JSON that is the reply, stands in a fence or between its
    outermost braces; else what the patterns find, each tried on each of these."""

    def read(x: Column) -> Column:
        fences = F.filter(F.transform(F.regexp_extract_all(x, F.lit(FENCE), F.lit(1)), lambda b: trimmed(b)), lambda b: b != "")
        braces = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
        tried = F.filter(F.concat(F.array(x), fences, F.array(braces)), lambda t: t.isNotNull() & (t != ""))

        def pair(t: Column) -> Column:
            parsed = F.try_parse_json(t).isNotNull()
            made = [(F.when(parsed, _field(t, QUESTION_KEYS)), F.when(parsed, _field(t, ANSWER_KEYS)))]
            bare = lambda p, g: F.nullif(F.regexp_replace(trimmed(F.regexp_extract(t, p, g)), r'^"+|"+$', ""), F.lit(""))
            made += [(bare(p, 1), bare(p, 2)) for p in PAIRS]
            field = lambda v: F.nullif(trimmed(cleaned_reply(v)), F.lit(""))
            return F.coalesce(*[F.when(field(q).isNotNull() & field(a).isNotNull(), F.struct(field(q).alias("question"), field(a).alias("answer"))) for q, a in made])

        return F.get(F.filter(F.transform(tried, pair), lambda p: p.isNotNull()), F.lit(0))

    return once(cleaned_reply(cleaned_reply(c)), read)


def needs_repair(question: Column, answer: Column, source: Column) -> Column:
    """Whether the question is empty or a template, the answer holds two labels or more, or either a number that the source
    lacks; an empty source supports all."""
    numbers = F.regexp_extract_all(F.concat_ws("\n", question, answer), F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0))
    lacks = F.exists(numbers, lambda n: ~F.regexp(source, F.concat(F.lit(r"(?U)(?<!\d)"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)"))))
    generic = (trimmed(question) == "") | F.exists(F.array(*map(F.lit, GENERIC)), lambda g: F.contains(question, g))
    return generic | (F.regexp_count(trimmed(answer), F.lit(MARKS)) >= 2) | F.when(trimmed(source) != "", lacks).otherwise(False)
