"""The corpus pipeline: toxic documents go, then texts without a language, then near duplicates; sources are mixed to
their weights, and the mix is encoded as SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import dedup, language, mixing, pieces, queries, toxicity


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and all other columns in one, so that no operator's column meets one of theirs.

    From here on the session passes rows to Python in batches of 4 MB, which bounds what a task's worker holds.
    """
    queries.store.set_small_batches(docs.sparkSession, 4 << 20)
    return docs.select("doc_id", "text", "lang", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*["text" if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict as toxic.

    Null and empty texts have the score of no votes, the base rate, and stay; equal texts share their fate, and every repeated
    row is judged by its own text. Without labels of both kinds all stay. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(queries.LEARN), labels.where(queries.LEARN))
    return _unpacked(toxicity.score(_packed(docs), model, ("text", "__row")).where("predicted = 0"), docs.columns)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which the language operator finds a language.

    Texts that are null or hold no letter go, with every repeat of them; all others stay. Without labelled languages all go.
    An empty table gives an empty one.
    """
    found = language.identify(_packed(docs), language.reference(docs.where(queries.LEARN)), ("text", "__row"))
    return _unpacked(found.where(F.col("lang_pred") != language.UNDETERMINED), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The row of the least doc_id stays, one of equal rows; rows that share a doc_id are judged by their own texts. Texts
    without words, null ones too, and rows with a null doc_id are near duplicates of nothing and stay.
    """
    return _unpacked(dedup.one_of_each(_packed(docs), shingle=5, percent=80), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are not taken; a null source is a source; each repeated row is a row of its own.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of each document's SentencePiece ids: a row for each row of docs, with no ids for null and empty texts."""
    return pieces.digest(_packed(docs), queries.tokenizer_path(queries.PIECE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: The operators that learn or hash can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread by the next. The session keeps its small Arrow
    batches afterwards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = queries.store.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
