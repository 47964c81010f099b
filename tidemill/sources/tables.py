"""Sources: the test tables, papers from JSON lines, Atom and RSS feeds, and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import ids, text

PAPER = "paper_id string, title string, authors array<string>, abstract string, summary string, published string, published_date string, date string, pdf_url string, content string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Paper records of JSON lines: alternative fields merged, ids normalized. Lines that don't parse have `bad`, and
    nothing else; file and place in it say which record of an id came first."""
    raw = spark.read.schema(f"{PAPER}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(paths)
    return raw.select(
        ids.normalize_id(F.col("paper_id")).alias("paper_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "authors", F.trim(F.coalesce(text.first_given(F.col("abstract"), F.col("summary")), F.lit(""))).alias("abstract"),
        F.coalesce(text.first_given(F.col("content"), F.col("text")), F.lit("")).alias("content"), text.first_given(F.col("published_date"), F.col("published"), F.col("date")).alias("published"), "pdf_url", "bad",
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("place"),
    )


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of Atom feeds (a row is a feed): id after /abs/, squeezed title and abstract, authors, date, PDF link (made
    from the id where the feed has none)."""
    clean = F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    entry = feeds.select(clean.alias("x")).select("x", F.posexplode(F.xpath("x", F.lit("//entry/id/text()"))).alias("i", "url"))
    at = lambda p: F.expr(f"xpath_string(x, concat('//entry[', i + 1, ']/{p}'))")
    pid = F.substring_index("url", "/abs/", -1)
    pdf = F.expr("xpath_string(x, concat('//entry[', i + 1, ']/link[@title=\"pdf\"]/@href'))")
    return entry.select(
        pid.alias("paper_id"), ids.squeezed(at("title")).alias("title"), F.expr("xpath(x, concat('//entry[', i + 1, ']/author/name/text()'))").alias("authors"), ids.squeezed(at("summary")).alias("abstract"),
        F.substring(at("published"), 1, 10).alias("published"), F.coalesce(F.nullif(pdf, F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), pid)).alias("pdf_url"),
    )


def rss_items(feeds: DataFrame, xml: str = "xml", most: int = 12) -> DataFrame:
    """(feed, nth, title, link) of the first items of RSS feeds."""
    clean = F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = feeds.select("feed", clean.alias("x")).select("feed", "x", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("nth"))
    rows = rows.select("feed", "nth", F.expr("trim(xpath_string(x, concat('//item[', nth, ']/title')))").alias("title"), F.expr("trim(xpath_string(x, concat('//item[', nth, ']/link')))").alias("link"))
    return rows.where("title <> ''")


def from_inverted_index(c: Column) -> Column:
    """The text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def in_order(rows: DataFrame, wanted: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of the wanted ids (key, ord), in their order."""
    return rows.join(wanted, key).orderBy("ord")


def in_range(published: Column, first: str, last: str) -> Column:
    """Whether the date that a text begins with lies between two; unreadable dates don't."""
    return F.coalesce(F.try_to_date(F.substring(published, 1, 10)).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))
