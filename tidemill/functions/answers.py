"""Answers of three sections (introduction, numbered body items that cite papers, conclusion): their parts, and rules that
mend one text by itself. What needs the sources of an answer is in operators.answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.bind import once
from tidemill.functions.text import hanzi

# Heads, sentences, words and patterns that decide results; (?U) gives classes of all scripts. Patterns that are
# searched for in whole answers look at what is cheap and seldom there first.
HEAD = r"(?mdU)(?=[#<])(?:^###\s*{0}\s*$|<b>{0}</b>)"
INTRO, BODY, CONCLUSION = (HEAD.format(name) for name in ("서론", "본론", "결론"))
NO_DOCUMENT = r"(?U)제공된\s*(?:문서|텍스트|정보|자료)(?:들)?에는[^.\n]*?(?:없습니다|찾을 수 없습니다)\.?[ \t]*"
NEGATIVE = r"포함되어 있지 않|제공되지 않|찾을 수 없|명시되어 있지 않|존재하지 않|확인되지 않|없습니다"
NONE_FOUND = r"찾는 연구(는|가)?[^.\n]{0,30}(없|찾을 수 없)|찾을 수 없습니다|다루(지 않|는 연구는 없)|포함되어 있지 않|포함되지 않"
CITED = r"(?U)\[\s*(\d{4}\.\d{4,5})(?:v\d+)?\s*\]"
CITED_ID = r"(?U)\[\d{4}\.\d{4,5}(?:v\d+)?\]"
DOCUMENT = r"(?U)\[\s*문서\s*(\d{1,2})\s*\]"
DOCUMENT_NOTE = r"(?U)(?=[\s(])(?<!\s)\s*+\((?:참고[:：]?\s*)?[^()\n]*문서\s*\d[^()\n]*\)"
DOCUMENT_BARE = r"(?U)문서(?<![\[\w]문서)\s*(\d{1,2}(?:\s*·\s*\d{1,2}(?!\d|\.\d))*)(?!\s*\])"
REPEATED_CITATION = r"(?U)(\[\d{4}\.\d{4,5}(?:v\d+)?\])(?:\s*(?:과|와|,|및|그리고)?\s*\1)+"
ITEM = r"(?U)^(\s*)(\d{1,2})\.(\s+)"
ITEM_NAMED = ITEM + r"(?:\*\*[^*\n]+\*\*|<b>[^<\n]+</b>)"
RELATED, RELATED_LEAD = "(관련 연구)", "제공된 문서에는 질문이 찾는 연구가 없습니다."
CONCLUSION_END = r"\n[ \t]*(?:📎|<b>📎|---)"
ELSEWHERE = "\n\n📎"
NUMBER = r"(?U)\d+(?:[.,]\d+)?"
STANDING = r"(?U)(?<![\d.,])\d+(?:[.,]\d+)?"
DECIMAL = r"(?U)(?=\d)(?<![\d.])(\d+\.\d+)(?![\d.])"
YEAR = r"(?U)(?=19|20)\b(?:19|20)\d{2}\b"
SENTENCE_END = r"(?U)(?<=[.!?。])\s+"
NOT_TEXT = r"\[[^\]\n]*\]|\([^()\n]*\)|<b>[^<\n]*</b>|\*\*[^*\n]*\*\*|<[^>]+>"
NO_RELATED_TAIL = r"(관련된 문서가 없습니다\.?)[ \t]*(?:\[[^\]\n]*\][ \t]*)+"
NEGATION, NEGATION_KO = r"(?iU)\b(?:not|no|never|without|cannot|neither|nor|unable|fails?|failed|lacks?)\b|n't", r"않|없|못|아[니닌닐님]|불가|실패|부족|결여"
FIRST_PERSON = {"우리는": "이 논문은", "우리의": "이 논문의", "우리가": "이 논문이", "우리를": "이 논문을"}


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def mapped(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """c with f of each match in its place."""
    return once(c, lambda x: F.array_join(F.zip_with(F.split(x, pattern, -1), _all(x, pattern), lambda rest, m: F.concat(rest, F.coalesce(f(m), F.lit("")))), ""))


def _cut(c: Column, pattern: str) -> Column:
    """Struct (a, m, z): what stands before the first match, the match, and what follows; null without one. The text behind a
    match goes with it, for split() searches on to the end whatever its limit; the pattern then matches where its rest begins."""

    def parts(x: Column) -> Column:
        behind = lambda s, y, m: F.struct(s[0].alias("a"), m.alias("m"), F.substr(y, F.length(m) + 1).alias("z"))
        rest = lambda s: F.when(F.size(s) == 2, once(F.substr(x, F.length(s[0]) + 1), lambda y: once(F.regexp_extract(y, pattern, 0), lambda m: behind(s, y, m))))
        return once(F.split(x, pattern + "(?s:.*)", 2), rest)

    return once(c, parts)


def _parted(c: Column) -> Column:
    """Struct (a, b, z): the cuts of an answer at the body's head, and of what follows at the conclusion's head."""
    return once(_cut(c, BODY), lambda a: F.struct(a.alias("a"), _cut(a["z"], CONCLUSION).alias("z")))


def sections(c: Column) -> Column:
    """Struct (lead, body, rest) that joins to the answer: through the body's head, the body, from the conclusion's head on if
    that follows. Without a body's head all is lead and body is null."""
    c = F.coalesce(c, F.lit(""))

    def named(p: Column) -> Column:
        head, close = p["a"], p["z"]
        ends = close["a"].isNotNull() & (close["a"] != "") & ~head["a"].rlike(CONCLUSION)
        return F.struct(
            F.when(head["m"].isNull(), c).otherwise(F.concat(head["a"], head["m"])).alias("lead"),
            F.when(ends, close["a"]).otherwise(head["z"]).alias("body"), F.when(ends, F.concat(close["m"], close["z"])).otherwise("").alias("rest"),
        )

    return once(_parted(c), named)


def cited(c: Column) -> Column:
    """Distinct cited ids without version, in order."""
    return F.array_distinct(_all(c, CITED, 1))


def contradiction_dropped(c: Column) -> Column:
    """Without the introduction's first sentence that no document is there, if the conclusion doesn't say so too. Answers
    without the three heads in order are unchanged."""

    def mended(i: Column, p: Column) -> Column:
        head, close, said = p["a"], p["z"], _cut(p["a"]["a"], NO_DOCUMENT)
        ordered = close["a"].isNotNull() & ~F.concat(i["a"], head["a"]).rlike(CONCLUSION) & ~i["a"].rlike(BODY)
        new = F.regexp_replace(F.concat(said["a"], said["z"]), r"^(\n?)[ \t]+", "$1")
        return F.when(ordered & said["a"].isNotNull() & ~close["z"].rlike(NEGATIVE), F.concat(i["a"], i["m"], new, head["m"], head["z"]))

    return F.coalesce(once(_cut(c, INTRO), lambda i: once(_parted(i["z"]), lambda p: mended(i, p))), c)


def related_marked(c: Column) -> Column:
    """Body items marked as related if the conclusion says that nothing was found, and the introduction begins with saying so;
    marked items stay."""

    def mark(line: Column) -> Column:  # an item without a bold name gets the mark behind its number
        new = F.when(line.rlike(ITEM_NAMED), F.regexp_replace(line, ITEM_NAMED, f"$0 {RELATED}")).otherwise(F.regexp_replace(line, ITEM, f"$0{RELATED} "))
        return F.when(F.contains(line, F.lit("관련 연구")), line).otherwise(new)

    def lead(before: Column) -> Column:
        told = lambda i: F.when(~i["z"].rlike(NONE_FOUND), F.concat(i["a"], i["m"], F.lit(f"\n{RELATED_LEAD} "), F.regexp_replace(i["z"], r"^\n+", "")))
        return F.coalesce(once(_cut(before, INTRO), told), before)

    def mended(p: Column) -> Column:
        head, close = p["a"], p["z"]
        own = F.coalesce(_cut(close["z"], CONCLUSION_END)["a"], close["z"])
        applies = ~head["a"].rlike(CONCLUSION) & own.rlike(NONE_FOUND)
        new = lambda body: F.when(body != close["a"], F.concat(lead(head["a"]), head["m"], body, close["m"], close["z"]))
        return F.when(applies, once(F.array_join(F.transform(F.split(close["a"], "\n", -1), mark), "\n"), new))

    return F.coalesce(once(_parted(c), mended), c)


def internal_refs_cleaned(c: Column, ids: Column) -> Column:
    """Without notes on numbered documents; bare numbers of documents as their ids ([id], from the map ids) if all are known;
    a citation that repeats next to itself once."""
    c = F.regexp_replace(c, DOCUMENT_NOTE, "")

    def named(m: Column) -> Column:
        numbers = F.transform(_all(m, r"\d{1,2}"), lambda n: n.cast("int"))
        known = F.forall(numbers, lambda n: F.map_contains_key(ids, n))
        return F.when(known, F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), F.try_element_at(ids, n), F.lit("]"))), "")).otherwise(m)

    return F.regexp_replace(mapped(c, DOCUMENT_BARE, named), REPEATED_CITATION, "$1")


def ids_as_refs(c: Column, numbers: Column) -> Column:
    """Cited ids as [문서 n]; numbers: a map from an id without version to n. Others stay."""
    n = lambda m: F.try_element_at(numbers, F.regexp_extract(m, CITED, 1))
    return mapped(c, CITED, lambda m: F.coalesce(F.concat(F.lit("[문서 "), n(m).cast("string"), F.lit("]")), m))


def _stands(number: Column, source: Column) -> Column:
    return F.regexp(source, F.concat(F.lit(r"(?U)(?<![\d.,])"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)")))


def standing(c: Column) -> Column:
    """Distinct numbers that stand in a text, without a digit, point or comma before and a digit behind: what _stands() finds."""
    return once(_all(c, STANDING), lambda found: F.array_distinct(F.concat(found, F.transform(found, lambda n: F.regexp_extract(n, r"(?U)^\d+", 0)))))


def foreign_numbers(c: Column, known: Column) -> Column:
    """Numbers of two characters or more, years and citations apart, that are not among the known ones (an array)."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, CITED, " "), r"<[^>]+>", " "), YEAR, " ")
    found = F.filter(_all(plain, NUMBER), lambda n: (F.length(n) > 1) & ~F.array_contains(known, n))
    return F.when(c.isNull() | c.rlike(r"(?U)\d"), found).otherwise(F.array().cast("array<string>"))  # most sentences have no digit


def grounded_item(c: Column, known: Column) -> Column:
    """An item without the sentences that hold a number that is not known from its sources (an array, null without a source);
    citations that go with them are put behind. Unchanged if it has no source, or no sentence with text would stay."""

    def mended(c: Column, known: Column) -> Column:
        def of(parts: Column, kept: Column) -> Column:
            out = F.array_join(kept, " ")
            last = lambda i: F.element_at(F.filter(_all(c, CITED), lambda m: F.regexp_extract(m, CITED, 1) == i), -1)
            text = F.exists(kept, lambda x: F.regexp_replace(x, NOT_TEXT, " ").rlike(r"(?U)\w"))
            behind = F.array_join(F.transform(F.array_except(cited(c), cited(out)), last), "")
            return F.when((F.size(kept) < F.size(parts)) & text, F.concat(out, behind))

        return once(F.split(c, SENTENCE_END, -1), lambda parts: once(F.filter(parts, lambda x: F.size(foreign_numbers(x, known)) == 0), lambda kept: of(parts, kept)))

    return once(c, lambda x: once(known, lambda k: F.coalesce(F.when(k.isNotNull(), mended(x, k)), x)))


def conclusion_fault(c: Column, blocks: Column) -> Column:
    """Why a new conclusion is refused, or null: no citation, length, Chinese characters, a document outside of the body, or a
    number of none of the cited blocks (a map from number to text)."""
    refs = F.array_distinct(F.transform(_all(c, DOCUMENT, 1), lambda n: n.cast("int")))
    sources = F.transform(F.filter(refs, lambda n: F.map_contains_key(blocks, n)), lambda n: F.element_at(blocks, n))
    foreign = F.filter(_all(F.regexp_replace(c, DOCUMENT, ""), NUMBER), lambda n: ~F.exists(sources, lambda s: _stands(n, s)))
    return (
        F.when(F.size(refs) == 0, "인용 없음").when(~F.length(c).between(40, 700), "길이").when(hanzi(c) > 0, "한자")
        .when(F.exists(refs, lambda n: ~F.map_contains_key(blocks, n)), "본론 밖 문서 인용").when(F.size(foreign) > 0, F.concat(F.lit("문서 밖 숫자 "), F.get(foreign, F.lit(0))))
    )


def _foreign_sentence(c: Column, sources: Column) -> Column:
    """Whether a sentence has a foreign number; sources: an array of texts."""
    known = F.flatten(F.transform(sources, standing))
    return once(known, lambda k: F.exists(F.split(c, SENTENCE_END, -1), lambda s: F.size(foreign_numbers(s, k)) > 0))


def item_fault(c: Column, old: Column, sources: Column) -> Column:
    """Why a rewritten item is refused, or null: length, Chinese characters, not longer than the old one, a foreign number."""
    plain = F.regexp_replace(F.regexp_replace(old, CITED, ""), r"(?U)^\s+|\s+$", "")
    return F.when(~F.length(c).between(80, 700), "길이").when(hanzi(c) > 0, "한자").when(F.length(c) <= F.length(plain), "짧아짐").when(_foreign_sentence(c, sources), "문서 밖 숫자")


def translation_fault(source: Column, c: Column) -> Column:
    """Why a sentence's translation is refused, or null: a number that the source has not, Chinese characters, form, fewer than
    five Hangul syllables, a lost negation."""
    extra = F.filter(_all(c, NUMBER), lambda n: ~F.array_contains(_all(source, NUMBER), n))
    return (
        F.when(F.size(extra) > 0, F.concat(F.lit("원문 밖 숫자 "), F.get(extra, F.lit(0)))).when(hanzi(c) > 0, "한자").when((F.coalesce(c, F.lit("")) == "") | F.contains(c, F.lit("\n")), "꼴")
        .when(F.regexp_count(c, F.lit("[가-힣]")) < 5, "한국어 아님").when(source.rlike(NEGATION) & ~c.rlike(NEGATION_KO), "부정어 빠짐")
    )


def third_person(c: Column) -> Column:
    return mapped(c, "우리(?:는|의|가|를)", lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in FIRST_PERSON.items() for x in kv]), m))


def no_related_tail_dropped(c: Column) -> Column:
    """Without the citations behind the sentence that no related document is there."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), NO_RELATED_TAIL, "$1")


def conclusion_aligned(c: Column) -> Column:
    """The answer with each decimal of its conclusion that the body's items of the papers cited in the sentence have not, but for
    exactly one of the same integer part, as many decimals or more and at most 1 % off that the sentence lacks, as that one.
    Parts of the conclusion about papers elsewhere stay."""
    decimals = lambda x: F.filter(_all(x, DECIMAL, 1), lambda v: ~v.rlike(r"^\d{4}\.\d{4,5}$"))
    places = lambda x: F.length(F.substring_index(x, ".", -1))

    def aligned(s: Column, values: Column) -> Column:
        def near(x: Column) -> Column:
            close_to = lambda v: F.abs(v.cast("double") - x.cast("double")) <= 0.01 * F.greatest(x.cast("double"), F.lit(1e-9))
            return F.filter(values, lambda v: (F.substring_index(v, ".", 1) == F.substring_index(x, ".", 1)) & close_to(v) & ~F.contains(s, v) & (places(v) >= places(x)))

        return mapped(s, DECIMAL, lambda x: F.when(x.rlike(r"^\d{4}\.\d{4,5}$") | F.array_contains(values, x), x).otherwise(once(near(x), lambda n: F.when(F.size(n) == 1, n[0]).otherwise(x))))

    def mended(p: Column) -> Column:
        head, close = p["a"], p["z"]
        items = F.split(close["a"], r"(?U)\n(?=\s*(?:<b>)?\d+\.\s)", -1)
        known = F.filter(F.transform(items, lambda x: F.struct(cited(x).alias("ids"), decimals(x).alias("values"))), lambda x: F.size(x["ids"]) > 0)
        at = F.instr(close["z"], ELSEWHERE)
        own, other = F.when(at > 0, F.substr(close["z"], F.lit(1), at - 1)).otherwise(close["z"]), F.when(at > 0, F.substr(close["z"], at)).otherwise("")
        parts = F.split(own, r"(?U)(?<=[.!?。])(?=\s)", -1)  # sentences keep the white space before them
        of = lambda s, k: F.when(s.rlike(DECIMAL), once(cited(s), lambda ids: F.array_distinct(F.flatten(F.transform(F.filter(k, lambda x: F.arrays_overlap(x["ids"], ids)), lambda x: x["values"])))))
        said = once(known, lambda k: F.array_join(F.transform(parts, lambda s: once(of(s, k), lambda v: F.when(F.size(v) > 0, aligned(s, v)).otherwise(s))), ""))
        # without a decimal in the conclusion nothing changes, and the body isn't read
        return F.when(~head["a"].rlike(CONCLUSION) & own.rlike(DECIMAL), F.concat(head["a"], head["m"], close["a"], close["m"], said, other))

    return F.coalesce(once(_parted(c), mended), c)
