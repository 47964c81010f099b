"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased letter runs and their four- and five-letter beginnings, which tie inflected and disguised forms of a
word together. All terms of a bounded sample of labelled rows are kept, and all of its rows are examples; a term weighs by
its TF-IDF times the root of one more than the log-likelihood ratio of its presence and the label, so that words of either
label are heard above the others, of which none is left out. The examples stand in postings lists (those of frequent terms as
dense rows), with each frequent term's greatest weight in each block of examples; a block that by its bound can't reach the
k-th cosine found is passed over. Single precision finds the candidates with a margin, double precision compares them, so
the neighbours are exact. Their votes, weighted by a power of the cosine and made monotone on the examples' own
left-out votes, are the score; the neighbours are its evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemill.llm import words

#: Labelled rows that are drawn (by the hash of doc_id) at most.
SAMPLE_ROWS = 3_000
#: Neighbours that vote, the power of the cosine that each votes with (of 1 to 10 the one with the least logarithmic loss of the
#: learning rows' left-out votes at sf0.1), and the weight of the base rate among them.
NEIGHBOURS, POWER, PRIOR_WEIGHT = 15, 3, 1.0
#: Examples in a block of the index.
BLOCK = 1_024
#: Queries that are compared at once; terms of more than one in as many examples, OFTEN at most, are held as dense rows.
BATCH, OFTEN = 32, 1_024
#: Bytes of text that are scored at once; a longer text is a piece of its own.
TEXT_BYTES = 1 << 20
#: Twice what a cosine in single precision may be off, at least.
MARGIN = 1e-4
#: A text with this score or more counts as toxic.
CUT = 0.7
PREFIXES = (4, 5)


def terms(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all tokens, and where each token's begin (one more than tokens)."""
    lists = pc.split_pattern(pc.replace_substring_regex(tokens, r"[^\p{L}]+", " "), " ")
    runs, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    sizes = pc.utf8_length(runs).to_numpy()
    found, of = [runs.filter(pa.array(sizes > 0))], [parent[sizes > 0]]
    for n in PREFIXES:
        longer = sizes > n
        found.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(runs.filter(pa.array(longer)), 0, n), "*", ""))
        of.append(parent[longer])
    order = np.argsort(np.concatenate(of), kind="stable")
    return pa.concat_arrays(found).take(pa.array(order)), np.searchsorted(np.concatenate(of)[order], np.arange(len(tokens) + 1))


class Rows(NamedTuple):
    """Sparse rows of n_columns: row i has columns[starts[i]:starts[i + 1]], ascending, and their weights."""

    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    n_columns: int

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        at, columns = np.nonzero(dense)
        return cls(np.searchsorted(at, np.arange(len(dense) + 1)), columns.astype(np.int32), dense[at, columns].astype(float), dense.shape[1])


@dataclass
class Model:
    """vocabulary: the columns' terms; idf: the columns' factors; weights: the examples' (unit length), as Rows or dense;
    their ids and labels; base: share of positive rows; steps: votes and scores.

    Columns of many examples (at most OFTEN) are the dense rows `often`, found by `place`; the others' postings, (example,
    weight), are lists at starts[c] to starts[c + 1]. peaks: the dense rows' greatest weight in each block of BLOCK."""

    vocabulary: pa.Array
    idf: np.ndarray
    weights: Rows | np.ndarray
    ids: np.ndarray
    positive: np.ndarray
    base: float
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        rows = Rows.of(self.weights) if isinstance(self.weights, np.ndarray) else self.weights
        self.weights = rows
        n, counts = len(self.ids), np.bincount(rows.columns, minlength=rows.n_columns)
        many = np.argsort(-counts, kind="stable")[:OFTEN]
        many = many[counts[many] * BATCH > n]
        self.place = np.full(rows.n_columns, -1, np.int32)
        self.place[many] = np.arange(len(many))
        example, dense = np.repeat(np.arange(n), np.diff(rows.starts)), self.place[rows.columns] >= 0
        self.often = np.zeros((len(many), n), np.float32)
        self.often[self.place[rows.columns[dense]], example[dense]] = rows.weights[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(rows.columns[rare], kind="stable")]
        self.lists = example[rare], rows.weights[rare]
        self.starts = np.concatenate(([0], np.cumsum(np.where(self.place < 0, counts, 0))))
        self.borders = np.arange(0, n, BLOCK)
        self.peaks = np.maximum.reduceat(self.often, self.borders, axis=1) if n else self.often

    def nearest(self, columns: np.ndarray, query: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k examples of greatest cosine above 0 (ties: first row) and their cosines."""
        return next(self.all_nearest([(columns, query)], k, [skip]))

    def all_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: Iterable[int] = repeat(-1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each query, (columns, weights)."""
        spread, skips = np.zeros(self.weights.n_columns), iter(skips)
        for first in range(0, len(queries), BATCH):
            some = queries[first : first + BATCH]
            for (columns, query), found in zip(some, self._rough(some, k, list(islice(skips, len(some)))), strict=True):
                least = np.partition(found, -k)[-k] if len(found) > k else 0.0
                rows = np.flatnonzero((found > 0) & (found >= least - MARGIN))
                if not len(rows):
                    yield rows, np.zeros(0)
                    continue
                begin, end = self.weights.starts[rows], self.weights.starts[rows + 1]
                at, spread[columns] = words.ranges(begin, end - begin), query
                cosines = np.add.reduceat(self.weights.weights[at] * spread[self.weights.columns[at]], np.cumsum(end - begin) - (end - begin))
                spread[columns] = 0
                order = np.lexsort((rows, -np.round(cosines, 12)))[:k]
                yield rows[order], cosines[order]

    def _rough(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int]) -> np.ndarray:
        """Cosines of queries and examples within half of MARGIN, and 0 or less where they can't be among the k greatest."""
        n = len(self.ids)
        dense, found = np.zeros((len(queries), len(self.often)), np.float32), np.zeros((len(queries), n), np.float32)
        if not n:
            return found
        columns, weights = (np.concatenate([q[k] for q in queries]) for k in (0, 1))
        row, place = np.repeat(np.arange(len(queries)), [len(c) for c, _ in queries]), self.place[columns]
        often = place >= 0
        dense[row[often], place[often]] = weights[often]
        rare, row, weights = columns[~often], row[~often], weights[~often]
        size = self.starts[rare + 1] - self.starts[rare]
        at = words.ranges(self.starts[rare], size)
        found[:] = np.bincount(np.repeat(row * n, size) + self.lists[0][at], np.repeat(weights, size) * self.lists[1][at], found.size).reshape(found.shape)
        for i in np.flatnonzero(np.array(skips[: len(queries)]) >= 0):
            found[i, skips[i]] = -np.inf
        bounds, kth = dense @ self.peaks + np.maximum.reduceat(found, self.borders, axis=1), np.zeros(len(queries), np.float32)
        for block in np.argsort(-bounds.max(0), kind="stable"):
            at, near = slice(block * BLOCK, (block + 1) * BLOCK), bounds[:, block] >= kth - MARGIN
            found[~near, at] = 0
            found[near, at] += dense[near] @ self.often[:, at]
            if found[:, at].shape[1] > k and near.any():
                kth[near] = np.maximum(kth[near], np.partition(found[near, at], -k, axis=1)[:, -k])
        return found

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines**POWER
        return float((weights[self.positive[rows]].sum() + PRIOR_WEIGHT * self.base) / (weights.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if self.steps is not None else vote


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights of term counts."""
    w = (1 + np.log(counts)) * idf
    return w / np.sqrt(np.square(w).sum())


def monotone(votes: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the shares of positive rows there, smoothed by half a row of each kind, never falling (pool adjacent violators)."""
    values, back = np.unique(np.round(votes, 3), return_inverse=True)
    blocks: list[list[float]] = []  # [positive, rows, first, last]
    for v, p, n in zip(values, np.bincount(back, positive), np.bincount(back), strict=True):
        blocks.append([p, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + n, blocks[-1][2], last]
    x = [b[i] for b in blocks for i in (2, 3)]
    y = [(b[0] + 0.05) / (b[1] + 0.1) for b in blocks for _ in (2, 3)]
    return np.array(x), np.maximum.accumulate(np.array(y))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of up to SAMPLE_ROWS labelled rows of docs, whatever the tables' sizes.

    Rows with a null label are left out; a doc_id with several labels has the greatest. Without labelled rows of both
    kinds there are no terms, and every text has the base rate (0 if there are no rows). All terms and rows of the sample
    come to the driver.
    """
    drawn = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS rows
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn.select(F.col("doc_id").alias("of"), "label")), F.col("doc_id") == F.col("of")).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            found, doc, term = _incidence(piece.column("text"), None)
            positive = piece.column("label").to_numpy(zero_copy_only=False)[doc] == 1
            yield pa.RecordBatch.from_pydict({"term": found, "yes": np.bincount(term[positive], minlength=len(found)), "no": np.bincount(term[~positive], minlength=len(found))})

    sizes = rows.groupBy("label").count().toPandas().set_index("label")["count"]
    n_yes, n_no = int(sizes.get(1, 0)), int(sizes.drop(1, errors="ignore").sum())
    total = n_yes + n_no
    if not n_yes or not n_no:
        return Model(pa.array([], pa.string()), np.zeros(0), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, bool), n_yes / total if total else 0.0)
    counts = rows.mapInArrow(tally, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    yes, no = F.col("yes").cast("double"), F.col("no").cast("double")
    share = (yes + no) / total
    ratio = 2 * (part(yes, n_yes * share) + part(no, n_no * share) + part(n_yes - yes, n_yes * (1 - share)) + part(n_no - no, n_no * (1 - share)))
    known = counts.select("term", (yes + no).alias("seen"), F.greatest(F.lit(0.0), ratio).alias("ratio")).toArrow().sort_by("term")
    vocabulary = known.column("term").combine_chunks()
    idf = (np.log((total + 1) / (known.column("seen").to_numpy() + 1)) + 1) * np.sqrt(1 + known.column("ratio").to_numpy())
    del known
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            columns, times = _columns(piece.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(columns, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "label", "columns", "times"])

    held = rows.mapInArrow(vectors, "doc_id long, label int, columns array<int>, times array<int>").toArrow()
    shared.unpersist()
    ids, labelled, lists, times = (held.column(c).combine_chunks() for c in ("doc_id", "label", "columns", "times"))
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    columns, times = lists.flatten().to_numpy(), times.flatten().to_numpy()
    borders = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    weighed = np.concatenate([np.zeros(0), *[weigh(times[a:b], idf[columns[a:b]]) for a, b in borders if b > a]])
    # alike examples share blocks
    tops = np.array([columns[a + np.argmax(weighed[a:b])] if b > a else len(vocabulary) for a, b in borders], np.int64)
    order = np.lexsort((ids.to_numpy(), tops))
    sizes = np.diff(starts)[order]
    moved = words.ranges(starts[:-1][order], sizes)
    weights = Rows(np.concatenate(([0], np.cumsum(sizes))), columns[moved], weighed[moved], len(vocabulary))
    model = Model(vocabulary, idf, weights, ids.to_numpy()[order], labelled.to_numpy()[order] == 1, n_yes / total)
    del held, lists, times, columns, weighed, moved
    own = [(weights.columns[a:b], weights.weights[a:b]) for a, b in zip(weights.starts[:-1], weights.starts[1:], strict=True)]
    votes = [model.vote(*x) for x in model.all_nearest(own, NEIGHBOURS, range(len(own)))]
    model.steps = monotone(np.array(votes), model.positive)
    return model


def _incidence(text: pa.Array, vocabulary: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, and each (text, term) that occurs, once. With a vocabulary: text and column of each occurrence of its terms."""
    split = words.split(pc.utf8_lower(pc.fill_null(text, "")))
    spelled, ends = terms(split.vocabulary)
    if vocabulary is None:
        coded = spelled.dictionary_encode()
        known, of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    else:
        known, found = vocabulary, pc.index_in(spelled, value_set=vocabulary)
        of, good = pc.fill_null(found, 0).to_numpy().astype(np.int64), pc.is_valid(found).to_numpy(zero_copy_only=False)
        of, ends = of[good], np.concatenate(([0], np.cumsum(good)))[ends]
    lengths = np.diff(ends)[split.codes]
    term = of[words.ranges(ends[:-1][split.codes], lengths)]
    doc = np.repeat(np.repeat(np.arange(len(text)), np.diff(split.offsets)), lengths)
    if vocabulary is None:
        pairs = np.unique(doc * max(1, len(known)) + term)
        doc, term = pairs // max(1, len(known)), pairs % max(1, len(known))
    return known, doc, term


def _columns(text: pa.Array, vocabulary: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: its columns, ascending, and how often each occurs."""
    _, doc, term = _incidence(text, vocabulary)
    pairs, times = np.unique(doc * max(1, len(vocabulary)) + term, return_counts=True)
    cuts = np.searchsorted(pairs // max(1, len(vocabulary)), np.arange(1, len(text)))
    return np.split((pairs % max(1, len(vocabulary))).astype(np.int32), cuts), np.split(times.astype(np.int32), cuts)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= CUT), evidence (the neighbours' doc_id, cosine and label, nearest
    first) and the columns named in keep, for each row of docs.

    Whole texts are read. A text without any term of the examples, null and empty ones too, has the score of no votes and
    no evidence. Equal texts get equal scores; other columns are not read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        none = model.score(model.vote(np.zeros(0, np.int64), np.zeros(0)))
        for piece in words.pieces(batches, most=TEXT_BYTES):
            scores, evidence = np.full(piece.num_rows, none), [[]] * piece.num_rows
            found = [(i, c, weigh(t, model.idf[c])) for i, (c, t) in enumerate(zip(*_columns(piece.column("text"), model.vocabulary), strict=True)) if len(c)]
            for (i, *_), (rows, cosines) in zip(found, model.all_nearest([x[1:] for x in found], NEIGHBOURS), strict=True):
                scores[i] = model.score(model.vote(rows, cosines))
                evidence[i] = [{"doc_id": int(model.ids[r]), "cosine": float(x), "label": int(model.positive[r])} for r, x in zip(rows, cosines, strict=True)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            own = [piece.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array((scores >= CUT).astype(np.int32)), pa.array(evidence, kind)], ["doc_id", *keep, "score", "predicted", "evidence"])

    source = docs.select("doc_id", *keep, *[c for c in ("text",) if c not in keep])
    one = StructType([StructField("doc_id", LongType()), StructField("cosine", DoubleType()), StructField("label", IntegerType())])
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", ArrayType(one))]
    return source.mapInArrow(predict, StructType([*[docs.schema[c] for c in ("doc_id", *keep)], *added]))


def predict(docs: DataFrame, labels: DataFrame, learn: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """score(), with a model of the rows of docs and labels where `learn`, a condition on doc_id, holds."""
    return score(docs, fit(docs.where(learn), labels.where(learn)), keep)


