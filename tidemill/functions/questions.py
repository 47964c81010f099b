"""Conditions that a question states: a range of years and a number of papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.bind import once

# Patterns and years that decide results; (?U) gives white space and word borders of all scripts.
RANGE = r"(?U)(20\d\d)\s*년?\s*(?:~|-|–|부터)\s*(20\d\d)\s*년"
YEAR = r"(?U)(20\d\d)\s*년\s*(이후|부터|이전|전에|전|까지)?"
RELATIVE = r"(?U)(재작년|작년|지난해|올해|금년)\s*(이후|부터|이전|전에|전|까지)?"
RELATIVE_YEARS = {"재작년": -2, "작년": -1, "지난해": -1, "올해": 0, "금년": 0}
COUNT = r"(?U)(?<![\d.])(\d{1,2})\s*(?:개|편)\s*(?:의\s*)?(?:논문|연구)?\s*(?:만|정도|쯤)?\s*(?:을|를)?\s*(?:찾|알려|골라|고르|뽑|추천|정리|보여|소개|요약|비교|설명|나열|줘|주세요)"
FROM, BEFORE, UNTIL = ("이후", "부터"), ("이전", "전에", "전"), "까지"


def year_range(c: Column, this_year: int | None = None) -> Column:
    """Struct (first, last) of the years that a question asks for, an open side null; null without such a condition."""
    one, other, given, named = (F.regexp_extract(c, p, i) for p, i in ((RANGE, 1), (RANGE, 2), (YEAR, 1), (RELATIVE, 1)))
    one, other = one.try_cast("int"), other.try_cast("int")
    this = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    year = F.coalesce(given.try_cast("int"), *[F.when(named == word, this + n) for word, n in RELATIVE_YEARS.items()])
    word = F.when(given != "", F.regexp_extract(c, YEAR, 2)).otherwise(F.regexp_extract(c, RELATIVE, 2))
    first = F.when(one.isNotNull(), F.least(one, other)).when(~word.isin(*BEFORE, UNTIL), year)
    last = F.when(one.isNotNull(), F.greatest(one, other)).when(word.isin(*BEFORE), year - 1).when(~word.isin(*FROM), year)
    return F.when(one.isNotNull() | year.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def requested_count(c: Column, least: int = 2, most: int = 10) -> Column:
    """The number of papers that a question asks for, null without one or outside of least to most."""
    n = F.regexp_extract(c, COUNT, 1).try_cast("int")
    return F.when(n.between(least, most), n)


# Words and patterns that decide results.
INTENTS = {
    "survey": ("survey systematic review overview literature", r"\b(survey|systematic\s+review|overview|literature\s+review)\b"),
    "benchmark": ("benchmark evaluation metrics dataset", r"(?s)^(?=.*benchmark).*(evaluation|metric|dataset)"),
    "framework": ("framework architecture pipeline design", r"framework|pipeline"),
    "method": ("method approach algorithm methodology", r"\b(method|approach|algorithm|methodology)\b"),
}
GENERIC = (
    "research researches academic paper papers study studies survey surveys keywords keyword summary trend trends "
    "overview literature article articles publication publications recent latest methods method approach approaches "
    "best practices guidelines"
).split()
PHRASES = ("deep research",)
YEAR_WORD = r"^(?:19|20)\d\d$"


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def variants(c: Column, most: int = 6, least_chars: int = 8) -> Column:
    """Array of (intent, query): the query itself, then with the words of each intent that it doesn't state yet; only
    itself if it is short, nothing if it is blank."""
    base = trimmed(c)
    added = [
        F.when((F.length(base) >= least_chars) & ~F.lower(base).rlike(stated), F.struct(F.lit(intent).alias("intent"), F.regexp_replace(F.concat(base, F.lit(f" {words}")), r"(?U)\s+", " ").alias("query")))
        for intent, (words, stated) in INTENTS.items()
    ]
    own = F.when(base != "", F.struct(F.lit("base").alias("intent"), base.alias("query")))
    return F.slice(F.array_compact(F.array(own, *added)), 1, max(1, most))


def cleaned(c: Column, least: int = 3) -> Column:
    """The query without generic words and years, fixed phrases in quotes; the query itself if fewer than `least` words stay."""
    q = F.coalesce(c, F.lit(""))
    for phrase in PHRASES:
        q = F.regexp_replace(q, f"(?i){phrase}", phrase.replace(" ", "\0"))
    held = lambda t: F.instr(t, "\0") > 0
    kept = F.filter(F.split(q, r"(?U)[\s,]+"), lambda t: (t != "") & (held(t) | (~F.lower(t).isin(GENERIC) & ~t.rlike(YEAR_WORD))))
    kept = F.transform(kept, lambda t: F.when(held(t), F.concat(F.lit('"'), F.replace(t, F.lit("\0"), F.lit(" ")), F.lit('"'))).otherwise(t))
    kept = F.split(F.regexp_replace(F.array_join(kept, "\1"), "(?i)(?:(?:^|\1)large)+$", ""), "\1")
    return F.when(F.size(kept) >= least, F.array_join(kept, " ")).otherwise(trimmed(c))


# What a query of words is widened by, and when.
EXPANSIONS = {
    "self-rag": "Self-Reflective Retrieval Augmented Generation",
    "self rag": "Self-Reflective Retrieval Augmented Generation",
    "crag": "Corrective Retrieval Augmented Generation",
    "dpr": "Dense Passage Retrieval",
    "colbert": "ColBERT",
    "ragas": "RAGAS retrieval evaluation",
    "hyde": "Hypothetical Document Embeddings",
    "specter": "SPECTER scientific document embedding",
}
GENERIC_TAIL = "survey systematic review overview benchmark evaluation metrics methodology experimental results accuracy improvement state of the art comparison analysis method framework approach architecture design"
SHORT_TAIL = "survey benchmark comparison analysis evaluation method framework approach".split()
OUTSIDE = "a-z0-9가-힣"
ID = r"(?U)\b\d{4}\.\d{4,5}\b"


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[-_]+", " ")


def with_expansions(c: Column) -> Column:
    """The query and the long forms of the short names in it that it doesn't spell out, each once, in the list's order."""

    def widen(q: Column) -> Column:
        found = [F.when(_spaced(q).rlike(f"(?<![{OUTSIDE}])(?:{short}|{short.replace('-', ' ')})(?![{OUTSIDE}])") & ~F.contains(F.lower(q), F.lit(long.lower())), long) for short, long in EXPANSIONS.items()]
        return F.concat_ws(" ", q, F.array_distinct(F.array_compact(F.array(*found))))

    return once(trimmed(c), widen)


def with_generic_tail(c: Column) -> Column:
    """The query and GENERIC_TAIL if it asks about retrieval in general: twelve characters or more, no paper's id, not both
    survey and benchmark, and fewer than five words of the tail."""
    low, spaced = F.lower(c), _spaced(c)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    broad = has("retrieval augmented generation", "retrieval-augmented") | (has("retrieval") & has("generation", "accuracy", "improve", "improving", "quality", "question answering")) | spaced.rlike(f"(?<![{OUTSIDE}])rag(?![{OUTSIDE}])")
    words = F.array_distinct(F.split(F.regexp_replace(spaced, r"(?U)\s+", " "), " "))
    told = F.size(F.array_intersect(words, F.array(*map(F.lit, dict.fromkeys(GENERIC_TAIL.lower().split())))))
    wanted = (F.length(c) >= 12) & ~low.rlike(ID) & broad & ~(has("survey") & has("benchmark")) & (told < 5)
    return F.when(wanted, F.concat(c, F.lit(f" {GENERIC_TAIL}"))).otherwise(c)


def with_short_tail(c: Column) -> Column:
    """The query and those words of SHORT_TAIL that don't stand in it, if it has eight characters or more."""
    missing = F.filter(F.array(*map(F.lit, SHORT_TAIL)), lambda w: ~F.contains(F.lower(c), w))
    return F.when(F.length(c) >= 8, F.concat_ws(" ", c, missing)).otherwise(c)


def expanded(c: Column) -> Column:
    """The query as the search by terms takes it; the search by vectors takes the plain one."""
    return once(once(with_expansions(c), with_generic_tail), with_short_tail)
