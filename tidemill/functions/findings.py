"""Which sentences of a source to keep or to set beside a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.answers import CITED
from tidemill.functions.bind import once
from tidemill.functions.text import sentences

# Patterns and limits that decide results.
RESULT = (
    "(?i)outperform|improv|reduc|increas|achiev|surpass|benefit|cost-effective|limit|degrad|drop|cliff|"
    "match|better|worse|gain|lower|higher|faster|slower|show|find|found|reveal|demonstrat"
)
RESULT_NUMBER = r"(?iU)\d+(?:\.\d+)?\s*(?:%|x|×|times|배|points?)|from \d|\(\d|\d+\s*(?:vs\.?|→)"
ACCOUNT = r"(?iU)\baccounts? for\b"
PROPOSE = r"(?iU)\b(we|this (paper|work|study))\b[^.]{0,60}\b(propose|present|introduce|develop|build|design)"
DOMAINS = (r"(?iU)dataset|corpus|corpora|benchmark|evaluat\w* on|we evaluate|experiments? on", "(?i)domain|documents|industr|enterprise|proprietary|real-world")
JUNK = r"(?iU)\||https?://|\S+@\S+\.\w|arXiv preprint|et al\.,? \(?\d{4}|\[\d+(?:\s*[,–-]\s*\d+)*\]|University|Institute"
NUMBER_TOKEN, LATIN = r"(?U)(?<![A-Za-z])(?<![A-Za-z]-)\d+(?:[.,]\d+)?", r"[A-Za-z][A-Za-z0-9\-]{2,}"
TITLE_LINE, ABSTRACT = r"(?mU)^\[(\d{4}\.\d{4,5}(?:v\d+)?)\]\s*(.+)$", r"(?sU)\[초록\]\s*(.+?)(?:\n\s*\n|\z)"
LEAST_ROOM, RESULTS = 120, 3

_PICK = "array<struct<i:int,s:string>>"


def _scored(s: Column, extra: bool) -> Column:
    """Struct (i, s, score) of sentences; the first has none."""
    verb = lambda x: x.rlike(RESULT) | x.rlike(ACCOUNT) if extra else x.rlike(RESULT)
    return F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("s"), F.when(i > 0, 2 * x.rlike(RESULT_NUMBER).cast("int") + verb(x).cast("int")).otherwise(0).alias("score")))


def _best(rows: Column) -> Column:
    """The RESULTS best rows with a score, the later of equals first."""
    order = F.array_sort(F.transform(F.filter(rows, lambda r: r["score"] > 0), lambda r: F.struct((-r["score"]).alias("a"), (-r["i"]).alias("b"), r["i"].alias("i"), r["s"].alias("s"), r["score"].alias("score"))))
    return F.transform(F.slice(order, 1, RESULTS), lambda r: F.struct(r["i"].alias("i"), r["s"].alias("s"), r["score"].alias("score")))


def _first(rows: Column, pattern: str) -> Column:
    return F.slice(F.filter(rows, lambda r: r["s"].rlike(pattern)), 1, 1)


def _domain(rows: Column) -> Column:
    first, second = (_first(rows, p) for p in DOMAINS)
    return F.when(F.size(first) > 0, first).otherwise(second)


def brief(c: Column, most: int) -> Column:
    """A source's sentence that proposes, its three best results and its domain, as far as `most` characters hold them, in
    their own order. A result that doesn't fit is cut if LEAST_ROOM characters are left. Without any: the text's beginning."""

    def picked(rows: Column) -> Column:
        want = F.concat(_first(rows, PROPOSE), _best(rows), _domain(rows))
        want = F.filter(want, lambda r, k: F.array_position(F.transform(want, lambda x: x["i"]), r["i"]) == k + 1)

        def step(acc: Column, r: Column) -> Column:
            room = most - acc["used"] - 1
            short = F.concat(F.regexp_replace(F.substr(r["s"], F.lit(1), room - 1), r"(?U)\s+$", ""), F.lit("…"))
            s = F.when(F.length(r["s"]) <= room, r["s"]).when((r["score"] > 0) & (room >= LEAST_ROOM), short)
            more = F.struct((acc["used"] + F.length(s) + 1).alias("used"), F.array_append(acc["kept"], F.struct(r["i"].alias("i"), s.alias("s"))).alias("kept"))
            return F.when(s.isNull(), acc).otherwise(more)

        start = F.struct(F.lit(0).alias("used"), F.array().cast(_PICK).alias("kept"))
        return F.aggregate(want, start, step, lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda r: r["s"]), " "))

    rows = _scored(sentences(F.replace(F.coalesce(c, F.lit("")), F.lit("\\%"), F.lit("%"))), True)
    out = once(rows, picked)
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return F.when(out != "", out).otherwise(F.substring(plain, 1, most))


def findings(c: Column) -> Column:
    """Struct (results, domain) of a block: its three best result sentences behind the title line, in order, or the last two;
    and the sentence that names its data or domain, empty without one."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?m)^\[\d{4}\.\d{4,5}[^\n]*", 2)
    body = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(parts[0])

    def of(rows: Column) -> Column:
        best = F.array_sort(_best(rows))
        last = F.slice(rows, F.greatest(F.size(rows) - 1, F.lit(1)), 2)
        results = F.transform(F.when(F.size(best) > 0, best).otherwise(last), lambda r: r["s"])
        return F.struct(results.alias("results"), F.coalesce(F.get(F.transform(_domain(rows), lambda r: r["s"]), F.lit(0)), F.lit("")).alias("domain"))

    return once(_scored(sentences(body), False), of)


def candidates(c: Column) -> Column:
    """Result sentences of a block, without title, the abstract's first sentence, proposals, tables, references and affiliations."""
    c = F.coalesce(c, F.lit(""))
    parts = F.split(c, TITLE_LINE, 2)
    body = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(c)
    plain = lambda x: F.replace(x, F.lit("\\%"), F.lit("%"))
    first = F.get(sentences(plain(F.regexp_extract(c, ABSTRACT, 1))), F.lit(0))
    return F.filter(sentences(plain(body)), lambda s: (s != F.coalesce(first, F.lit(""))) & ~s.rlike(JUNK) & ~s.rlike(PROPOSE) & (s.rlike(RESULT) | s.rlike(RESULT_NUMBER)))


def nearest_sentence(claim: Column, options: Column) -> Column:
    """Struct (sentence, numbers) of the option that shares most with a claim, a number three points and a Latin word one; the last
    of equals; at least one number must be shared, else null."""
    every = lambda x, p: F.array_distinct(F.regexp_extract_all(x, F.lit(p), F.lit(0)))
    plain = F.regexp_replace(F.coalesce(claim, F.lit("")), CITED, "")

    def best(told: Column) -> Column:
        def scored(s: Column, i: Column) -> Column:
            shared = F.array_intersect(told["numbers"], every(s, NUMBER_TOKEN))
            return F.struct((3 * F.size(shared) + F.size(F.array_intersect(told["words"], every(F.lower(s), LATIN)))).alias("score"), i.alias("i"), s.alias("sentence"), shared.alias("numbers"))

        top = F.array_max(F.filter(F.transform(options, scored), lambda x: F.size(x["numbers"]) > 0))
        return F.when(top.isNotNull(), F.struct(top["sentence"].alias("sentence"), F.array_sort(top["numbers"]).alias("numbers")))

    return once(F.struct(every(plain, NUMBER_TOKEN).alias("numbers"), every(F.lower(plain), LATIN).alias("words")), best)


def aligned(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """claims (claim_id, id, claim) with sentence and numbers of the nearest sentence of their block (id, block), null without."""
    b = blocks.select(F.col("id").alias("of"), candidates(F.col("block")).alias("options"))
    rows = claims.join(b, F.col("id") == F.col("of"), "left").withColumn("found", nearest_sentence(F.col("claim"), F.col("options")))
    return rows.select("claim_id", "id", "claim", "found.sentence", "found.numbers")
