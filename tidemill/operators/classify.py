"""Kinds of texts by character and word n-grams and logistic regression, fitted and applied as Spark jobs.

N-grams are counted in arrays of numbers, piece by piece of a text, and not made as strings; character_grams() and word_grams()
say what they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemill.sources.stored import stored

#: Dimensions that n-grams of each kind are hashed to (a round of the fit adds up as many sums for each task), and the strength of a fit against its size (the inverse of C).
DIMENSIONS, C = 1 << 14, 10.0

#: Longest runs of characters, code points of a text that are counted at once (and on to the word's end), and texts whose counts are handed on at once.
RUN, PIECE, TEXTS = 4, 1 << 18, 256

#: Odd factors of the hashes: of a place in a run or word, of the first word of a pair, and of the last mixing.
_PLACE, _PAIR, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))

#: White space of all scripts, as (?U)\s.
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True

_COUNTED = "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def character_grams(c: Column, most: int = RUN) -> Column:
    """Runs of one to `most` characters inside each word, which has a space at both ends; a word that is as long as a run or
    shorter gives one run of it and no longer ones."""

    def of(word: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.length(word)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, n))))

    return F.flatten(F.transform(F.transform(_words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), of))


def word_grams(c: Column) -> Column:
    """Words, and pairs of neighbours."""
    w = _words(c)
    return F.concat(w, F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat(w[i], F.lit(" "), x)))


def _tally(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return np.bincount((mixed >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64), minlength=DIMENSIONS)


def counts(text: str | None) -> np.ndarray:
    """How many of the character_grams() of a text in small letters each dimension has, and behind them of its word_grams()."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    white = _WHITE[np.minimum(points, len(_WHITE) - 1)]
    runs, words, before, end = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64), np.empty(0, np.uint64), 0
    while end < len(points):
        start, end = end, min(end + PIECE, len(points))
        if end < len(points):  # pieces end with a word
            end = end + int(np.argmax(white[end:])) if white[end:].any() else len(points)
        at = np.flatnonzero(~white[start:end])
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        sizes = np.diff(first, append=len(at))
        word, chars = np.repeat(np.arange(len(first)), sizes), points[start:end][at].astype(np.uint64) + np.uint64(1)
        padded, owner = np.full(len(at) + 2 * len(first), 33, np.uint64), np.repeat(np.arange(len(first)), sizes + 2)  # a space's code point and 1
        padded[np.arange(len(at)) + 2 * word + 1] = chars
        hashes = padded
        runs += _tally(hashes)
        for n in range(1, RUN):
            hashes = hashes[:-1] * _PLACE + padded[n:]
            runs += _tally(hashes[owner[n:] == owner[:-n]])
        places = np.cumprod(np.full(sizes.max(), _PLACE))
        own = np.add.reduceat(chars * places[np.arange(len(at)) - first[word]], first)
        joined = np.concatenate([before, own])
        words += _tally(own) + _tally(joined[:-1] * _PAIR + joined[1:])
        before = own[-1:]
    return np.concatenate([runs, words])


def _counted(rows: DataFrame) -> DataFrame:
    """(label, features) of rows (label, text), with the fields of a sparse vector."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                found = [(at := np.flatnonzero(x), x[at]) for x in map(counts, part.column(1).to_pylist())]
                ends = np.cumsum([0, *(len(at) for at, _ in found)]).astype(np.int32)
                listed = lambda j, kind: pa.ListArray.from_arrays(ends, np.concatenate([x[j] for x in found]).astype(kind))  # noqa: B023, E731
                n = len(found)
                vectors = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 2 * DIMENSIONS, np.int32)), listed(0, np.int32), listed(1, np.float64)], fields=list(_VECTOR))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["label", "features"])

    return rows.mapInArrow(of, _COUNTED)


def fit(rows: DataFrame, c: str, label: str) -> Model:
    """A model of label (0 or 1) by the n-grams of the whole texts in column c. Both kinds weigh alike in sum; rows without
    label are left out. The n-grams' weights are their TF-IDF over the rows; Spark sums the loss over all partitions, so
    nothing but the coefficients comes to the driver."""
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.lower(c).alias("text"))
    # n-grams are made once; every later pass reads their counts
    counted = stored(_counted(rows), "counts", StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    n, yes = counted.agg(F.count("*"), F.sum("label")).head()
    if not yes or yes == n:
        raise ValueError("rows of both kinds are needed")
    # every partition sends its own sums in every round, so there are no more than two for each core
    weighed = counted.coalesce(2 * counted.sparkSession.sparkContext.defaultParallelism).withColumn("weight", F.when(F.col("label") == 1, n / (2 * yes)).otherwise(n / (2 * (n - yes))))
    idf = IDF(inputCol="features", outputCol="weighed", minDocFreq=1).fit(weighed)
    regression = LogisticRegression(featuresCol="weighed", weightCol="weight", regParam=1 / (C * n), standardization=False, maxIter=50)
    made = regression.fit(idf.transform(weighed))
    return Model(idf.idf.toArray() * made.coefficients.toArray(), made.intercept)


def predicted(model: Model, rows: DataFrame, c: str) -> DataFrame:
    """rows with `predicted` (0 or 1); null and blank texts get what their missing n-grams give."""

    @F.pandas_udf("int")
    def kind(texts: pd.Series) -> pd.Series:
        return pd.Series([int(counts(x) @ model.weights + model.intercept > 0) for x in texts], dtype="int32")

    return rows.withColumn("predicted", kind(F.lower(c)))
