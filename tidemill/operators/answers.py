"""Answers as rows of lines and items, rules on these rows, and answers put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import answers as rules
from tidemill.functions.bind import once

#: A line that begins an item for joining items: a number, a point, and white space, maybe the line's end.
_BEGINS = r"(?U)^[ \t]*\d{1,2}\.(?:\s|$)"


def lines(answers: DataFrame, key: str = "answer", c: str = "text") -> DataFrame:
    """(key, part, kind, line, tail): the lead, each line of the body and the rest of answers; line and tail (the line feed)
    in the order of part join to the answer, so nothing is lost. A null answer is empty."""
    s = rules.sections(F.col(c))
    row = lambda kind, line, tail: F.struct(F.lit(kind).alias("kind"), line.alias("line"), tail.alias("tail"))
    body = once(F.split("s.body", "\n", -1), lambda parts: F.transform(parts, lambda x, i: row("line", x, F.when(i < F.size(parts) - 1, "\n").otherwise(""))))
    every = F.concat(F.array(row("lead", F.col("s.lead"), F.lit(""))), F.coalesce(body, F.array().cast("array<struct<kind:string,line:string,tail:string>>")), F.array(row("rest", F.col("s.rest"), F.lit(""))))
    # outer: for a plain explode Spark looks first whether there are rows, which makes them again
    return answers.select(key, s.alias("s")).select(key, F.posexplode_outer(every).alias("part", "row")).select(key, "part", "row.*")


def assembled(rows: DataFrame, key: str = "answer") -> DataFrame:
    """(key, text) of lines(): one answer's lines meet, no more."""
    parts = F.sort_array(F.collect_list(F.struct("part", F.concat("line", "tail").alias("piece"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))


def _count(flag: Column, key: str) -> Column:
    return F.sum(flag.cast("int")).over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))


def renumbered(rows: DataFrame, key: str = "answer") -> DataFrame:
    """lines() with the body's items numbered from 1 in order."""
    item = (F.col("kind") == "line") & F.col("line").rlike(rules.ITEM)
    rows = rows.withColumn("nth", _count(item, key))
    new = F.concat(F.regexp_extract("line", rules.ITEM, 1), F.col("nth").cast("string"), F.lit("."), F.regexp_extract("line", rules.ITEM, 3), F.regexp_replace("line", rules.ITEM, ""))
    return rows.withColumn("line", F.when(item, new).otherwise(F.col("line"))).drop("nth")


def merged_papers(rows: DataFrame, key: str = "answer") -> DataFrame:
    """lines() with each item that cites one paper alone put behind the first item that cites this paper alone, without its
    number and name. A merged item is a line of its own kind, `item`; numbers stay as they are."""
    last = F.col("tail") == ""
    begins = (F.col("kind") == "line") & F.col("line").rlike(_BEGINS) & ~(last & ~F.col("line").rlike(r"(?U)^[ \t]*\d{1,2}\.\s"))
    rows = rows.withColumn("nth", _count(begins, key))
    body = rows.where("kind = 'line'").groupBy(key, "nth").agg(F.min("part").alias("part"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", F.concat("line", "tail").alias("piece")))), lambda x: x["piece"]), "").alias("line"))
    ids = rules.cited(F.col("line"))
    body = body.withColumn("paper", F.when((F.col("nth") > 0) & (F.size(ids) == 1), ids[0]))
    owner = F.min("nth").over(Window.partitionBy(key, "paper"))
    body = body.withColumn("owner", F.when(F.col("paper").isNull(), F.col("nth")).otherwise(owner))
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    said = F.regexp_replace(trimmed, r"(?U)^\d{1,2}\.\s+(?:(?:<b>[^<\n]*</b>|\*\*[^*\n]*\*\*)\s*[:：]\s*)?", "")
    parts = F.sort_array(F.collect_list(F.struct("nth", "part", "line", said.alias("said"))))
    own, more = parts[0]["line"], F.slice(parts, 2, 1_000_000)
    joined = F.concat(F.regexp_replace(own, r"(?U)\s+$", ""), F.lit(" "), F.array_join(F.transform(more, lambda x: x["said"]), " "), F.regexp_extract(own, r"(?U)(\s*)$", 1))
    items = body.groupBy(key, "owner").agg(parts[0]["part"].alias("part"), F.when(F.size(parts) > 1, joined).otherwise(own).alias("line"))
    items = items.select(key, "part", F.lit("item").alias("kind"), "line", F.lit("").alias("tail"))
    return rows.where("kind <> 'line'").drop("nth").unionByName(items)


def grounded(rows: DataFrame, blocks: DataFrame, key: str = "answer") -> DataFrame:
    """lines() whose numbered items have lost the sentences with numbers that none of their cited blocks has (blocks: (key, id,
    block), ids with or without version). Items without a known block stay; so do those that would lose all text."""
    head = r"(?U)^(\s*(?:<b>)?\d+\.\s)"
    normal = F.replace(F.replace("block", F.lit("{,}"), F.lit(",")), F.lit("\\%"), F.lit("%"))
    told = blocks.where("block IS NOT NULL").select(F.col(key).alias("of"), F.struct(F.regexp_replace("id", r"v\d+$", "").alias("id"), rules.standing(normal).alias("numbers")).alias("block"))
    told = told.groupBy("of").agg(F.collect_list("block").alias("told"))
    item = (F.col("kind") == "line") & F.col("told").isNotNull() & F.col("line").rlike(head)

    def mended(line: Column) -> Column:
        known = once(rules.cited(line), lambda ids: F.filter("told", lambda b: F.array_contains(ids, b["id"])))
        known = once(known, lambda b: F.when(F.size(b) > 0, F.flatten(F.transform(b, lambda x: x["numbers"]))))
        return F.concat(F.regexp_extract(line, head, 1), rules.grounded_item(F.regexp_replace(line, head, ""), known))

    rows = rows.join(told, F.col(key) == F.col("of"), "left")
    return rows.withColumn("line", F.when(item, mended(F.col("line"))).otherwise(F.col("line"))).drop("of", "told")
