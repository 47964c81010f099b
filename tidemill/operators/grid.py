"""All pairs of queries and rows in a grid of blocks: a block of either side meets one of the other in a task's arrays.

What a pair of blocks keeps of a query are its best rows, so what is shuffled is the rows once for each block of queries, the
queries once for each block of rows, and a query's best for each block of rows. No task holds more than a block of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block; numbers of a block of vectors; pairs whose scores are held at once.
QUERIES, NUMBERS, PAIRS = 8_192, 1 << 20, 1 << 21
#: Tokens, and documents, of a block of texts.
TOKENS, DOCUMENTS = 2_000_000, 16_384


def _dealt(c: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _met(rows: DataFrame, queries: DataFrame, n: int, work, schema: str) -> DataFrame:
    """Blocks (row_block, query_block) of both sides, met by work; n pairs of blocks."""
    pair = ["row_block", "query_block"]
    left, right = rows.repartition(n, *pair), queries.repartition(n, *pair)
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(work, schema)


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each line are its k smallest; of equal ones the first. NaN is greatest."""
    if keys.shape[1] <= k:
        return np.ones(keys.shape, bool)
    kth = np.partition(keys, k - 1, axis=1)[:, k - 1 : k]
    less = (keys < kth) | (np.isnan(kth) & ~np.isnan(keys))
    same = (keys == kth) | (np.isnan(kth) & np.isnan(keys))
    return less | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= k - less.sum(axis=1, keepdims=True)))


def _matrix(column: pa.ChunkedArray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Vectors as lines of `width` numbers; those of size -1 are zeros."""
    out = np.zeros((len(sizes), width))
    lists = column.combine_chunks()
    values, offsets = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        out[at, :size] = values[offsets[at][:, None] + np.arange(size)]
    return out


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray | slice = slice(None), j: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Inner products of columns i and j of two matrices, added up from the first component to the last, as Spark's aggregate() does."""
    s = np.float64(0)
    for x, y in zip(a, b, strict=True):
        s = s + x[i] * y[j]
    return s


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, row, vec_id, dist): of each query (q, qv) the k rows (row, vec_id, grp, embedding) of each group that are nearest by
    1 - cosine inside each block of rows, ties by vec_id.

    A matrix product finds the rows that may be among them, within more than its error; these are measured by sums in the
    components' order, so distances are the same in every block. Of equal vectors of a group only the k first ids can be.
    """
    sized = lambda c: F.when(F.col(c).isNull() | F.exists(c, lambda x: x.isNull()), -1).otherwise(F.size(c))
    rows = rows.withColumn("size", sized("embedding"))
    queries = queries.withColumn("size", sized("qv"))
    n, width = rows.agg(F.count("*"), F.max("size")).first()
    n_queries = queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_rows = max(1, -(-n * max(width or 1, 1) // NUMBERS), min(cores, -(-n // 1024)))
    n_query_blocks = max(1, -(-n_queries // QUERIES))
    left = rows.select(_dealt("row", n_rows).alias("row_block"), _every(n_query_blocks).alias("query_block"), "row", F.coalesce("vec_id", F.lit(-(2**63))).alias("vec_id"), "grp", "size", F.coalesce("embedding", F.array().cast(rows.schema["embedding"].dataType)).alias("embedding"))
    right = queries.select(_every(n_rows).alias("row_block"), _dealt("q", n_query_blocks).alias("query_block"), "q", "size", F.coalesce("qv", F.array().cast(queries.schema["qv"].dataType)).alias("qv"))

    def work(v: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], q.schema.field("q").type), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        if not v.num_rows or not q.num_rows:
            return empty
        v_sizes, q_sizes = (t.column("size").to_numpy() for t in (v, q))
        dims = int(max(v_sizes.max(), q_sizes.max(), 1))
        x, y = _matrix(v.column("embedding"), v_sizes, dims), _matrix(q.column("qv"), q_sizes, dims)
        ids, row = v.column("vec_id").to_numpy(), v.column("row").to_numpy()
        group = pc.index_in(v.column("grp"), value_set=pc.unique(v.column("grp"))).to_numpy()
        # equal vectors side by side, in a group, by id
        _, same = np.unique(np.ascontiguousarray(np.column_stack([x, v_sizes.astype(float)])).view(f"V{8 * (dims + 1)}").ravel(), return_inverse=True)
        order = np.lexsort((ids, same, group))
        g, s = group[order], same[order]
        begins = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
        order = order[nth < k]
        order = order[np.lexsort((ids[order], group[order]))]
        x, ids, row, group, v_sizes = x[order], ids[order], row[order], group[order], v_sizes[order]
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        with np.errstate(all="ignore"):
            xt = np.ascontiguousarray(x.T)
            x_norm, y_norm = np.sqrt(_dots(xt, xt)), np.sqrt(_dots(y.T, y.T))
            parts = []
            lines = max(1, PAIRS // len(ids))
            for at in range(0, len(y), lines):
                some = y[at : at + lines]
                norm = y_norm[at : at + lines, None] * x_norm
                valid = (norm > 0) | np.isnan(norm)
                valid &= q_sizes[at : at + lines, None] == v_sizes
                about = 1 - np.where(valid, (some @ xt) / norm, 0.0)
                maybe = np.empty(about.shape, bool)
                for low, high in zip(bounds, bounds[1:]):
                    part = about[:, low:high]
                    kth = np.partition(part, k - 1, axis=1)[:, k - 1 : k] if high - low > k else np.inf
                    maybe[:, low:high] = ~(part > kth + 1e-14 * max(dims, 64))
                few = max(1, len(some) // 8)  # what may be near is few rows, but nearly all where they are alike
                for low in range(0, len(some), few):
                    a, b = np.nonzero(maybe[low : low + few])
                    a = a + low
                    dist = 1 - np.where(valid[a, b], _dots(some.T, xt, a, b) / norm[a, b], 0.0)
                    by = np.lexsort((ids[b], dist, group[b], a))
                    a, b, dist = a[by], b[by], dist[by]
                    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (group[b][1:] != group[b][:-1])]) if len(a) else np.array([], int)
                    best = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)])) < k
                    parts.append((a[best] + at, b[best], dist[best]))
        a, b, dist = (np.concatenate(p) for p in zip(*parts))
        return pa.table({"q": q.column("q").take(pa.array(a)).combine_chunks(), "row": pa.array(row[b], pa.int64()), "vec_id": pa.array(ids[b], pa.int64()), "dist": pa.array(dist, pa.float64())})

    return _met(left, right, n_rows * n_query_blocks, work, f"q {queries.schema['q'].dataType.simpleString()}, row long, vec_id long, dist double")


def _term_scores(texts: np.ndarray, terms: np.ndarray, parts: np.ndarray, weights: np.ndarray, n_texts: int) -> np.ndarray:
    """Scores (query, text) as the sum over terms of weights (query, term) and parts of (text, term), sorted by term."""
    score = np.zeros((len(weights), n_texts))
    begins = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.array([], int)
    ends = np.r_[begins[1:], len(terms)]
    asked = (weights != 0).sum(axis=0)
    often = []
    for low, high in zip(begins, ends):
        term = terms[low]
        if not asked[term]:
            continue
        if asked[term] * (high - low) * 16 > score.size:
            often.append((low, high))
            continue
        who = np.flatnonzero(weights[:, term])
        score[who[:, None], texts[low:high]] += weights[who, term][:, None] * parts[low:high]
    for at in range(0, len(often), 256):
        some = often[at : at + 256]
        dense = np.zeros((len(some), n_texts))
        for i, (low, high) in enumerate(some):
            dense[i, texts[low:high]] = parts[low:high]
        score += weights[:, [terms[low] for low, _ in some]] @ dense
    return score


def best_by_terms(docs: DataFrame, asked: DataFrame, mean_len: float, sizes: tuple[int, int], k: int, k1: float, b: float, key: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(q, key, score, by, wanted): of each query (q, term, weight) the k keys with the highest BM25 score above 0, rounded to 9
    digits (by), inside each block of documents (key, tokens), ties by key; then, with wanted, the scores of pairs (q, key)
    that are asked for, if they share a term. A key's rows count together. sizes: documents and tokens, in all."""
    n_rows = max(1, -(-sizes[1] // TOKENS), -(-sizes[0] // DOCUMENTS), min(docs.sparkSession.sparkContext.defaultParallelism, -(-sizes[0] // 256)))
    n_queries = max(1, -(-asked.select("q").distinct().count() // QUERIES))
    q_type, key_type = (d.schema[c].dataType.simpleString() for d, c in ((asked, "q"), (docs, key)))
    left = docs.select(_dealt(key, n_rows).alias("row_block"), _every(n_queries).alias("query_block"), F.col(key).alias("key"), "tokens")
    right = asked.select(_every(n_rows).alias("row_block"), _dealt("q", n_queries).alias("query_block"), "q", "term", F.col("weight").cast("double").alias("weight"), F.lit(None).cast(key_type).alias("key"))
    if wanted is not None:
        right = right.unionByName(wanted.select(_dealt(key, n_rows).alias("row_block"), _dealt("q", n_queries).alias("query_block"), "q", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight"), F.col(key).alias("key")))

    def blocks(d: pa.Table, a: pa.Table) -> Iterator[pa.Table]:
        keys = pc.unique(d.column("key"))
        keys = keys.take(pc.sort_indices(keys))
        of = pc.index_in(d.column("key"), value_set=keys).to_numpy()
        lists = d.column("tokens").combine_chunks()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        lengths = np.bincount(of, counts, len(keys))
        rows, pairs = a.filter(pc.is_valid(a.column("term"))), a.filter(pc.is_null(a.column("term")))
        vocabulary, queries = pc.unique(rows.column("term")), pc.unique(rows.column("q"))
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
        code = (found.astype(np.int64) * len(keys) + np.repeat(of, counts))[found >= 0]
        code, tf = np.unique(code, return_counts=True)
        terms, texts = code // len(keys), code % len(keys)
        parts = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[texts] / mean_len))
        q = pc.index_in(rows.column("q"), value_set=queries).to_numpy()
        term, weight = pc.index_in(rows.column("term"), value_set=vocabulary).to_numpy(), rows.column("weight").to_numpy()
        want_q = pc.fill_null(pc.index_in(pairs.column("q"), value_set=queries), -1).to_numpy()
        want_key = pc.fill_null(pc.index_in(pairs.column("key"), value_set=keys), -1).to_numpy()
        lines = max(1, PAIRS // max(len(keys), 1))
        for at in range(0, len(queries), lines):
            mine = (q >= at) & (q < at + lines)
            used, column = np.unique(term[mine], return_inverse=True)
            weights = np.zeros((min(lines, len(queries) - at), len(used)))
            np.add.at(weights, (q[mine] - at, column), weight[mine])
            place = np.searchsorted(used, terms)
            here = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == terms)
            score = _term_scores(texts[here], place[here], parts[here], weights, len(keys))
            by = np.round(score, 9)
            i, j = np.nonzero(_first(np.where(score > 0, -by, np.inf), k) & (score > 0))
            w = np.flatnonzero((want_q >= at) & (want_q < at + lines) & (want_key >= 0))
            i, j, wanted = np.r_[i, want_q[w] - at], np.r_[j, want_key[w]], np.r_[np.zeros(len(i), bool), np.ones(len(w), bool)]
            yield pa.table({"q": queries.take(pa.array(i + at)), key: keys.take(pa.array(j)), "score": score[i, j], "by": by[i, j], "wanted": wanted})

    def work(d: pa.Table, a: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], a.schema.field("q").type), key: pa.array([], d.schema.field("key").type), "score": pa.array([], pa.float64()), "by": pa.array([], pa.float64()), "wanted": pa.array([], pa.bool_())})
        return pa.concat_tables([empty, *blocks(d, a)]) if d.num_rows and a.num_rows else empty

    return _met(left, right, n_rows * n_queries, work, f"q {q_type}, {key} {key_type}, score double, by double, wanted boolean")
