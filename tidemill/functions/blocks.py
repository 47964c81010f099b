"""Contexts: texts of blocks, one for each hit, behind lines of separators; and labels that a reader gave to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import proper_names

# Separators, words and patterns that decide results.
BETWEEN = "\n\n---\n\n"
NOTHING = "관련 문서 없음"
FAILED = ("관련 문서 없음", "검색 오류")
CUT = "\n\n...(이하 잘림)"
PAPER = r"(?m)^\[(\d{4}\.\d{4,5})"
TAGGED = r"(?mU)^\s*\[((?!Distance|발행일)[^\]\n]+)\]\s+\S"
RELEVANT = r"(?U)관련\s*[:：]\s*(.+)"
GRADE = r"(?mU)^\s*\[?(\d{1,2})\]?\s*[:：.)]?\s*\**\s*(핵심|관련|무관)"
NUMBERED = r"(?s)\[문서 (\d+)\]\n(.*?)(?=\n\[문서 \d+\]\n|\z)"
DIRECT, PARTIAL = "D", "P"


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def blocks(c: Column) -> Column:
    """The blocks of a context, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\Q" + BETWEEN + r"\E", -1), stripped), lambda b: b != "")


def _bounded(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", ""), F.lit(CUT))).otherwise(c)


def first_block(c: Column, most: int = 5500) -> Column:
    return F.when(F.size(blocks(c)) > 0, _bounded(blocks(c)[0], most)).otherwise(c)


def top_blocks(c: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(blocks(c), 1, n), BETWEEN)


def same_paper(c: Column, most: int = 8000) -> Column:
    """All blocks that name the first block's paper ([id] title), `most` characters at most; only the first block if it names none."""
    tag = F.regexp_extract(blocks(c)[0], TAGGED, 1)
    own = F.filter(blocks(c), lambda b: F.contains(b, F.concat(F.lit("["), tag, F.lit("]"))))
    return F.when(F.size(blocks(c)) == 0, c).when(tag == "", _bounded(blocks(c)[0], most)).otherwise(_bounded(F.array_join(own, BETWEEN), most))


def _key(b: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(b, PAPER, 1), F.lit("")), F.substring(b, 1, 80))


def _distinct(every: Column) -> Column:
    """Blocks of papers that no earlier block has."""
    keys = F.transform(every, _key)
    return F.filter(every, lambda b, i: F.array_position(keys, _key(b)) == i + 1)


def merged(primary: Column, extras: Column, per_extra: int = 2) -> Column:
    """The first blocks of each further context, then the primary one's; each paper once. Contexts that say that nothing was found
    are left out."""
    good = F.filter(extras, lambda x: (stripped(x) != "") & ~F.exists(F.array(*map(F.lit, FAILED)), lambda f: F.startswith(stripped(x), f)))
    every = F.concat(F.flatten(F.transform(good, lambda x: F.slice(blocks(x), 1, per_extra))), blocks(primary))
    return F.when(F.size(every) > 0, F.array_join(_distinct(every), BETWEEN)).otherwise(primary)


def interleaved(primary: Column, topics: Column, most: int = 3) -> Column:
    """The topics' blocks in turn, up to `most` of each, then the primary ones; each paper once."""
    good = F.filter(topics, lambda x: (stripped(x) != "") & ~F.exists(F.array(*map(F.lit, FAILED)), lambda f: F.startswith(stripped(x), f)))
    rows = F.transform(good, lambda x: F.slice(blocks(x), 1, most))
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.array_compact(F.transform(rows, lambda r: F.get(r, k)))))
    failed = F.exists(F.array(*map(F.lit, FAILED)), lambda f: F.startswith(stripped(primary), f))
    every = F.concat(turns, F.when(failed, F.array().cast("array<string>")).otherwise(blocks(primary)))
    return F.when(F.size(turns) > 0, F.array_join(_distinct(every), BETWEEN)).otherwise(primary)


def compact(c: Column, most: int = 500) -> Column:
    """Each block's head and the first characters of its abstract, or of its body without one."""

    def short(b: Column) -> Column:
        parts = F.split(b, r"\[초록\] ", 2)
        abstract = F.substring_index(F.get(parts, F.lit(1)), "\n\n", 1)
        head = F.regexp_extract(b, r"(?sd)^(.*?(?:^|\n)\[\d{4}\.\d{4,5}[^\n]*)", 1)
        body = F.substr(b, F.length(head) + F.when(head == "", 1).otherwise(2))
        return stripped(F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("[초록] "), F.substring(abstract, 1, most))).otherwise(F.concat(head, F.lit("\n"), F.substring(body, 1, most))))

    return F.when(F.size(blocks(c)) > 0, F.array_join(F.transform(blocks(c), short), BETWEEN)).otherwise(c)


def item_papers(answer: Column) -> Column:
    """The first cited id of each numbered item of the body, null without one."""
    after = F.when(F.contains(answer, F.lit("본론")), F.substring_index(F.substr(answer, F.instr(answer, "본론") + 2), "결론", 1)).otherwise(F.substring_index(answer, "결론", 1))
    items = F.slice(F.split(F.concat(F.lit("\n"), after), r"(?U)\n\s*\d+\.\s", -1), 2, 1_000_000)
    return F.transform(items, lambda x: F.nullif(F.regexp_extract(x, r"(?U)\[\s*(\d{4}\.\d{4,5})(?:v\d+)?\s*\]", 1), F.lit("")))


def numbered(c: Column, most: int = 900) -> Column:
    """Array of (n, text): the numbered documents of a context as title and abstract."""
    body = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBERED), F.lit(2))
    number = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBERED), F.lit(1))

    def brief(b: Column) -> Column:
        title = stripped(F.regexp_extract(b, r"(?U)\[\d{4}\.\d{4,5}(?:v\d+)?\]\s*(.*)", 1))
        said = F.when(F.contains(b, F.lit("[초록]")), F.substr(b, F.instr(b, "[초록]") + 4)).otherwise(b)
        return F.concat(title, F.lit("\n"), F.substring(stripped(F.regexp_replace(said, r"(?U)\s+", " ")), 1, most))

    return F.zip_with(number, body, lambda n, b: F.struct(n.cast("int").alias("n"), brief(b).alias("text")))


def answer_class(labels: Column) -> Column:
    """Struct (kind, doc) of documents' labels (a map): a and the first direct one; b with a partial one, else c."""
    direct = F.array_min(F.map_keys(F.map_filter(labels, lambda _, x: x == DIRECT)))
    kind = F.when(direct.isNotNull(), "a").when(F.exists(F.map_values(labels), lambda x: x == PARTIAL), "b").otherwise("c")
    return F.struct(kind.alias("kind"), direct.alias("doc"))


def relevant(c: Column, n: Column) -> Column:
    """Numbers from 1 to n that a reader calls relevant: empty if it says none, null if it can't be read or names no such number."""
    said = F.regexp_extract(F.coalesce(c, F.lit("")), RELEVANT, 1)
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(said, F.lit(r"\d{1,2}"), F.lit(0)), lambda x: x.cast("int")), lambda x: x.between(1, n)))
    return F.when(F.contains(said, F.lit("없음")), F.array().cast("array<int>")).when(F.size(found) > 0, found)


def graded(c: Column, n: Column) -> Column:
    """Grades of the documents 1 to n, the last that a reader gave to each; null unless each has one."""
    text = F.coalesce(c, F.lit(""))
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(GRADE), F.lit(1)).alias("i"), F.regexp_extract_all(text, F.lit(GRADE), F.lit(2)).alias("grade"))
    last = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.try_element_at(F.filter(rows, lambda r: r["i"].cast("int") == k), F.lit(-1))["grade"])
    return F.when((n > 0) & ~F.exists(last, lambda g: g.isNull()), last)


def protected(question: Column, every: Column) -> Column:
    """Numbers of blocks whose title line holds a proper name of the question."""
    names = F.transform(proper_names(question), F.lower)
    title = lambda b: F.lower(F.regexp_extract(b, r"(?m)^\s*(\[\d{4}\.\d{4,5}[^\n]*)", 1))
    return F.filter(F.transform(every, lambda b, i: F.when(F.exists(names, lambda x: F.contains(title(b), x)), i + 1)), lambda i: i.isNotNull())


def kept(question: Column, context: Column, chosen: Column, grades: Column | None = None, keep: tuple[str, ...] = ("핵심", "관련"), none: int = 0) -> Column:
    """Struct (context, status): the blocks that a reader chose and the protected ones. By grades, if given, else by `chosen`
    (see relevant()); unreadable choices keep all, and so does a choice of nothing unless `none` says how many come first then."""
    every = blocks(context)
    n = F.size(every)
    safe = protected(question, every)
    if grades is not None:
        own = F.filter(F.transform(grades, lambda g, i: F.when(g.isin(*keep), i + 1)), lambda i: i.isNotNull())
        numbers, unread, empty = F.array_union(own, safe), grades.isNull(), F.size(F.array_union(own, safe)) == 0
    else:
        unread, empty = chosen.isNull(), (F.size(chosen) == 0) & F.lit(not 0 < none)
        first = F.when((F.size(chosen) == 0) & (n > none), F.slice(F.sequence(F.lit(1), F.lit(max(none, 1))), 1, none)).otherwise(chosen)
        empty = empty | ((F.size(chosen) == 0) & (n <= none))
        numbers = F.array_union(first, safe)
    left = F.filter(every, lambda b, i: F.array_contains(numbers, i + 1))
    status = F.when(n < 2, "대상 아님").when(unread, "못 읽음").when(empty, "없음").otherwise(F.concat(n.cast("string"), F.lit("→"), F.size(left).cast("string")))
    whole = (n < 2) | unread | empty
    return F.struct(F.when(whole, context).otherwise(F.array_join(left, BETWEEN)).alias("context"), status.alias("status"))
