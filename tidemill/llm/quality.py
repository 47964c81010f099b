"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Base statistics of every whole text become a vector (logarithms of the number of words and of the mean word length, of
symbols, repeated lines and repeated words per hundred words). For each language and source an MCD estimate is fitted on
all rows that pass the base rules: the rows are counted in the cells of a fine fixed grid, with the exact sums and
products of their vectors, so one aggregation, combined before its shuffle, holds all that concentration steps need, and
a group with a third of all rows is no larger than its occupied cells. Documents whose vector is too far by Mahalanobis
distance are rejected. A group of few rows takes its language's estimate, or that of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import store, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Cells of the grid in each coordinate: width, and least and greatest index.
CELL, EDGES = (1 / 8, 1 / 32, 1 / 2, 1 / 2, 1 / 2), ((0, 160), (0, 320), (0, 12), (0, 10), (0, 10))
#: Least standard deviation of each coordinate, added to every covariance; else those that are 0 in most texts would have none.
FLOOR = (0.2, 0.05, 0.5, 0.6, 0.9)
#: Share of a group's rows that an estimate rests on.
COVER = 0.75
#: Groups of fewer rows take a wider group's estimate.
LEAST_ROWS = 200
#: A clean document is rejected with about this probability if its vector is normally distributed.
ALPHA = 1e-5
#: Up to so many estimates are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
_P = len(CELL)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text (null: zeros)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            text = pc.fill_null(piece.column("text"), "")
            yield pa.RecordBatch.from_pydict({c: piece.column(c) for c in ("doc_id", "lang", "source")} | _counts(text))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return own.mapInArrow(count, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def _counts(text: pa.Array) -> dict[str, np.ndarray]:
    split = words.split(text)
    n, of = len(text), split.offsets
    per_text = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[of[1:]] - np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[of[:-1]]
    lengths = pc.utf8_length(split.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(of))
    lines = pc.split_pattern(text, "\n")
    coded = lines.flatten().dictionary_encode()
    line, line_doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    full = pc.match_substring_regex(coded.dictionary, words.WORD.replace("\\x20", " ")).to_numpy(zero_copy_only=False)[line]
    distinct = np.unique(line_doc[full] * len(coded.dictionary) + line[full])
    symbols = pc.count_substring_regex(text, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    dup_lines = np.bincount(line_doc[full], minlength=n) - np.bincount(distinct // max(1, len(coded.dictionary)), minlength=n)
    return {"n_words": np.diff(of), "word_chars": per_text(lengths[split.codes]), "n_symbols": symbols, "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": per_text(_repeated(split, doc))}


def _repeated(split: words.Words, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of WINDOW words that its text has twice or more."""
    h = words.hashes(split.vocabulary)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        odd, size = np.uint64(0x9E3779B97F4A7C15), 1
        with np.errstate(over="ignore"):
            factor = odd
            while size < WINDOW:  # the hash of a window is made of those of its halves
                h = words.mix(h[:-size] * factor + h[size:])
                factor, size = factor * odd, size * 2
            inside = doc[: len(h)] == doc[WINDOW - 1 :]
            at = np.flatnonzero(inside)
            key = words.mix(h[at] ^ (doc[at].astype(np.uint64) * odd))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.log1p(F.lit(100.0) * F.col(c) / n)
    found = [F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return [F.round(x * 4096) / 4096 for x in found]  # sums of such values are exact, so in any order the same


def chi2(p: int, alpha: float) -> float:
    """The value that a chi-squared variable of p degrees of freedom exceeds with probability alpha (Wilson and Hilferty)."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(1 - alpha) * (2 / (9 * p)) ** 0.5) ** 3


def mcd(weight: np.ndarray, sums: np.ndarray, products: np.ndarray, cover: float = COVER, floor: tuple[float, ...] = FLOOR, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the cells' rows by MCD, reweighted once. weight: rows (n,), sums (n, p), products (n, p, p)
    of their vectors. Starts are a coordinatewise robust one and random subsets; the best of them are concentrated until
    they don't change."""
    at, total, p, extra = sums / weight[:, None], weight.sum(), sums.shape[1], np.diag(np.square(floor[: sums.shape[1]]))

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = w / weight
        mean = (f[:, None] * sums).sum(0) / w.sum()
        return mean, (f[:, None, None] * products).sum(0) / w.sum() - np.outer(mean, mean) + extra

    def distances(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        x = at - mean
        return np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x)

    def nearest(d: np.ndarray, rows: float) -> np.ndarray:
        order = np.argsort(d, kind="stable")
        before = np.cumsum(weight[order]) - weight[order]
        w = np.empty_like(weight)
        w[order] = np.clip(rows - before, 0, weight[order])
        return w

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return moments(nearest(distances(mean, cov), cover * total))

    order = np.argsort(at, axis=0, kind="stable")
    middle = np.array([at[order[np.searchsorted(np.cumsum(weight[order[:, j]]), total / 2), j], j] for j in range(p)])
    away = np.abs(at - middle)
    order = np.argsort(away, axis=0, kind="stable")
    spread = np.array([away[order[np.searchsorted(np.cumsum(weight[order[:, j]]), total / 2), j], j] for j in range(p)])
    starts, rng = [(middle, np.diag(np.square(1.4826 * spread)) + extra)], np.random.default_rng(seed)
    for _ in range(20):
        w = np.zeros_like(weight)
        w[rng.choice(len(weight), min(len(weight), p + 1), replace=False, p=weight / total)] = 1
        starts.append(moments(w))
    tried = sorted((step(*step(*s)) for s in starts), key=lambda s: np.linalg.slogdet(s[1])[1])[:5]
    best = None
    for mean, cov in tried:
        size = np.linalg.slogdet(cov)[1]
        for _ in range(100):
            mean, cov = step(mean, cov)
            last, size = size, np.linalg.slogdet(cov)[1]
            if size > last - 1e-9:
                break
        if best is None or size < best[0]:
            best = size, mean, cov
    _, mean, cov = best
    d = distances(mean, cov)
    order = np.argsort(d, kind="stable")
    half = d[order[np.searchsorted(np.cumsum(weight[order]), total / 2)]]
    cov = cov * max(1.0, half / chi2(p, 0.5))
    w = np.where(distances(mean, cov) <= chi2(p, 0.025), weight, 0.0)
    return moments(w) if w.sum() > 0 else (mean, cov)


def estimates(vectors: DataFrame) -> DataFrame:
    """(lang, source, x) to an estimate for each group of the levels 0 (language and source), 1 (language) and 2 (all):
    level, g_lang, g_source, rows, mean, inverse (row by row)."""
    cell = F.array(*[F.least(F.greatest(F.floor(F.col("x")[j] / F.lit(CELL[j])), F.lit(EDGES[j][0])), F.lit(EDGES[j][1])).cast("int") for j in range(_P)])
    pairs = [(i, j) for i in range(_P) for j in range(i, _P)]
    names = [f"s{i}" for i in range(_P)] + [f"p{i}{j}" for i, j in pairs]
    cells = vectors.groupBy("lang", "source", cell.alias("cell")).agg(F.count("*").cast("double").alias("rows"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(_P)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}{j}") for i, j in pairs])
    add = [F.sum(c).alias(c) for c in ("rows", *names)]
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None).cast("string")).alias("g_lang"), (F.col("source") if k < 1 else F.lit(None).cast("string")).alias("g_source")) for k in range(3)]))
    cells = cells.select(levels.alias("g"), "cell", "rows", *names).groupBy("g.level", "g.g_lang", "g.g_source", "cell").agg(*add)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell", key=lambda c: c.map(tuple))
        weight, sums = group["rows"].to_numpy(), group[names[:_P]].to_numpy()
        products = np.empty((len(group), _P, _P))
        for i, j in pairs:
            products[:, i, j] = products[:, j, i] = group[f"p{i}{j}"]
        mean, cov = mcd(weight, sums, products)
        return pd.DataFrame({"level": [key[0]], "g_lang": [key[1]], "g_source": [key[2]], "rows": [int(weight.sum())], "mean": [mean], "inverse": [np.linalg.inv(cov).ravel()]})

    return cells.groupBy("level", "g_lang", "g_source").applyInPandas(fit, "level int, g_lang string, g_source string, rows long, mean array<double>, inverse array<double>")


def judge(docs: DataFrame, alpha: float = ALPHA, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance (squared
    Mahalanobis distance; null where the base rules failed) of every row of docs.

    base_failed: fewer than least_words words, or more than most_repeated percent in repeated windows. Null and empty
    texts have no words and fail. Null languages and sources are groups like others. If no row passes the base rules,
    nothing is kept. Other columns are not read; equal rows get equal results.
    """
    base = store.table(base_statistics(docs), "quality")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = base.withColumn("base_failed", failed).withColumn("x", F.array(*_vector()))
    fitted = store.table(estimates(judged.where("not base_failed").select("lang", "source", "x")).where((F.col("rows") >= LEAST_ROWS) | (F.col("level") == 2)), "quality-mcd")
    few = fitted.count() <= BROADCAST_GROUPS
    for k, on in ((0, ("lang", "source")), (1, ("lang",)), (2, ())):
        one = fitted.where(F.col("level") == k).select(*[F.col(f"g_{c}") for c in on], F.struct("mean", "inverse").alias(f"fit{k}"))
        match = F.lit(True)
        for c in on:
            match &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
        judged = judged.join(F.broadcast(one) if few else one, match, "left").drop(*[f"g_{c}" for c in on])
    fit = F.coalesce("fit0", "fit1", "fit2")
    judged = judged.withColumn("fit", fit).withColumn("away", F.zip_with("x", F.col("fit.mean"), lambda a, b: a - b))
    distance = sum(F.col("away")[i] * F.col("away")[j] * F.col("fit.inverse")[i * _P + j] for i in range(_P) for j in range(_P))
    distance = F.when(~F.col("base_failed"), distance)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(distance <= F.lit(chi2(_P, alpha)), F.lit(False)).alias("kept"), distance.alias("distance"))
