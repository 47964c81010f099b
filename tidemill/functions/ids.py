"""Paper ids and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(c: Column, rule: str = "numeric") -> Column:
    """The id without its version. numeric: only after digits and points; suffix: any trailing v and digits; first: all
    from the first v on. Null is empty."""
    c = F.trim(F.coalesce(c, F.lit("")))
    if rule == "numeric":
        return F.regexp_replace(c, r"^([0-9.]*[0-9][0-9.]*)v[0-9]+$", "$1")
    return F.regexp_replace(c, r"v[0-9]+$", "") if rule == "suffix" else F.substring_index(c, "v", 1)


def version_candidates(c: Column, most: int = 20) -> Column:
    """The id and its versions v1 to v`most`."""
    return F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.concat(c, F.lit("v"), i.cast("string"))))


def valid_arxiv_id(c: Column, last: int = 2611) -> Column:
    """Whether yymm.number is plausible: from 0704 to `last`, a month, four digits up to 1412 and five from 1501 on."""
    month = F.substring(c, 1, 4).cast("int")
    digits = F.when(month <= 1412, 9).otherwise(10)
    return F.coalesce(c.rlike(r"^[0-9]{4}\.[0-9]{4,5}$") & month.between(704, last) & (month % 100).between(1, 12) & (F.length(c) == digits), F.lit(False))


def loose_key(c: Column) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\W_]+", ""))


def title_key(c: Column) -> Column:
    """Lower-cased word characters of any script."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", ""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the squeezed parts, joined by the unit separator."""
    return F.sha2(F.concat_ws(chr(31), *map(squeezed, parts)), 256)


def evidence_fingerprint(ids: Column, *parts: Column) -> Column:
    """fingerprint(), with sorted distinct ids as one more part."""
    return F.sha2(F.concat_ws(chr(31), *map(squeezed, parts), F.array_join(F.array_sort(F.array_distinct(ids)), ",")), 256)


def chunk_id(paper_id: Column, position: Column) -> Column:
    """32 hexadecimal digits that depend on the paper and the chunk's place alone."""
    return F.substring(F.sha2(F.concat(paper_id, F.lit("::chunk::"), position.cast("string")), 256), 1, 32)


def cited_ids(c: Column) -> Column:
    """Distinct ids in brackets or after paper_id=, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?:\[\s*|paper_id=\s*)([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"), F.lit(1)))
