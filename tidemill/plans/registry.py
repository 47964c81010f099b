"""The registered queries and their SQL, and what several modules of queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pid = F.format_string("%04d.%05d", 2401 + F.pmod("doc_id", F.lit(12)), F.pmod("doc_id", F.lit(700)))
    return d.select("doc_id", F.concat(pid, F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string")).alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), "text", "source", "lang", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string").alias("published"))


PAPERS = r"""papers AS (SELECT doc_id, printf('%04d.%05dv%d', 2401 + doc_id % 12, doc_id % 700, doc_id % 3 + 1) AS paper_id, split_part(text, chr(10), 1) AS title,
  text, source, lang, strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS published FROM documents)"""


def tokens_sql(c: str) -> str:
    """Tokens of a text in DuckDB: lower case, a-b as a, b and ab, split at other characters, of two characters or more."""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(trim({c})), '([\pL\pN_]+)-([\pL\pN_]+)', '\1 \2 \1\2', 'g'), '[^0-9A-Za-z가-힣]+'), lambda t: len(t) >= 2)"


TOKENS = tokens_sql("text")
