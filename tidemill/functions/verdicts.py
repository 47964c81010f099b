"""What judges and writers answered: picked documents, and departures from the asked format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and words that decide results; (?U) gives white space of all scripts.
PICK = r"(?U)답\s*[:：]\s*(?:\[?\s*문서\s*(\d{1,2})\s*\]?|(없음))"
GRADED_PICK = r"(?U)답\s*[:：]\s*(?:(있음|부분)\s*,?\s*\[?\s*문서\s*(\d{1,2})|(없음))"
ITEM_LINE = r"(?U)문서\s*(\d{1,2})\s*[:：]\s*(.*)"
NONE = "없음"
SECTIONS = ("서론", "본론", "결론")
NO_DOCUMENT = "제공된 문서에는 질문이 찾는 연구가 없습니다"
PLACEHOLDER = r"[{}]|정답 힌트|교사 전용"


def picked(c: Column, graded: bool = False) -> Column:
    """Struct (kind, doc) of the first verdict: the document's number with 있음 or, if graded, 부분; 없음 without a number.
    Null if there is no verdict."""
    c, pattern = F.coalesce(c, F.lit("")), GRADED_PICK if graded else PICK
    doc = F.regexp_extract(c, pattern, 2 if graded else 1).try_cast("int")
    none = F.regexp_extract(c, pattern, 3 if graded else 2) != ""
    kind = F.regexp_extract(c, pattern, 1) if graded else F.lit("있음")
    return F.when(none, F.struct(F.lit(NONE).alias("kind"), F.lit(None).cast("int").alias("doc"))).when(doc.isNotNull(), F.struct(kind.alias("kind"), doc.alias("doc")))


def item_documents(answers: DataFrame, key: str, raw: str, n_items: int) -> DataFrame:
    """(key, item, docs): documents that lines of `raw` name for each item up to n_items, in order, once each; lines that say
    none name no item. Items without a document have no row."""
    text = F.coalesce(F.col(raw), F.lit(""))
    lines = F.arrays_zip(F.regexp_extract_all(text, F.lit(ITEM_LINE), F.lit(1)).alias("doc"), F.regexp_extract_all(text, F.lit(ITEM_LINE), F.lit(2)).alias("named"))
    rows = answers.select(key, F.posexplode(lines).alias("pos", "line")).where(~F.col("line.named").contains(NONE))
    rows = rows.select(key, "pos", F.col("line.doc").cast("int").alias("doc"), F.explode(F.regexp_extract_all("line.named", F.lit(r"(\d{1,2})"), F.lit(1))).alias("item"))
    first = rows.withColumn("item", F.col("item").cast("int")).where(F.col("item").between(1, n_items)).groupBy(key, "item", "doc").agg(F.min("pos").alias("pos"))
    return first.groupBy(key, "item").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]).alias("docs"))  # doc < 100


def _after(c: Column, mark: str) -> Column:
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark))).otherwise(c)


def format_violations(answer: Column, gold: Column, n_docs: Column) -> Column:
    """Names of the format rules that an answer breaks, without the counts that a report may put behind two of them. gold: numbers of the documents that answer the question, maybe none."""
    answer = F.coalesce(answer, F.lit(""))
    opening, closing = f"### {SECTIONS[1]}", f"### {SECTIONS[2]}"
    heads = F.regexp_extract_all(answer, F.lit(r"(?mU)^###\s*(서론|본론|결론)\s*$"), F.lit(1))
    body = F.when(answer.contains(opening), F.substring_index(_after(answer, opening), closing, 1)).otherwise("")
    blocks = F.slice(F.split(body, r"(?mU)^\s*\d+\.\s"), 2, 1_000_000)
    cites = F.regexp_extract_all(answer, F.lit(r"(?U)\[문서\s*(\d+)\]"), F.lit(1))
    says_none = F.substring_index(answer, opening, 1).contains(NO_DOCUMENT)
    first = F.coalesce(F.get(blocks, F.lit(0)), F.lit(""))
    has_gold = F.size(gold) > 0
    rules = {
        "섹션": heads != F.array(*map(F.lit, SECTIONS)),
        "본론항목": ~F.size(blocks).between(1, 4),
        "인용범위": F.exists(cites, lambda x: ~F.coalesce(x.try_cast("int").between(1, n_docs), F.lit(False))),
        "항목무인용": F.exists(blocks, lambda x: ~x.rlike(r"(?U)\[문서\s*\d+\]")),
        "arXivID": answer.rlike(r"(?U)\b\d{4}\.\d{4,5}(v\d+)?\b"),
        "플레이스홀더/힌트누출": answer.rlike(PLACEHOLDER),
        "정답이1번아님": has_gold & ~F.exists(gold, lambda g: F.regexp(first, F.concat(F.lit(r"(?U)\[문서\s*"), g.cast("string"), F.lit(r"\]")))),
        "정답있는데없다고함": has_gold & says_none,
        "정답없는데안밝힘": ~has_gold & ~says_none,
    }
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
