"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's coordinates are dealt to `LISTS` lists; a pair's score is the sum of its partial scores in them. (1) Every list
gives, for each query, its local candidates of greatest partial score; these are gathered and scored exactly, and the
k-th best score of a query is a safe cutoff: at least k vectors reach it. (2) The cutoffs go to all lists, and each gives
every entry whose partial score is at least cutoff / LISTS; whatever reaches the cutoff in total does so in one list.
(3) An entry that all lists gave has its score; the rest of the others is resolved from the vectors, and the k best of
those that reach the cutoff are the result.

Vectors are packed to blocks once and stay where they are. Queries go to them in passes of PASS_BYTES, each broadcast to the
tasks, which read their blocks and keep the best of what they have seen, so what is shuffled is some entries of each query,
list and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import store

LISTS = 2
#: Vectors in a block, queries that meet a block at once, and bytes of queries that go to all tasks together.
VECTORS, QUERIES, PASS_BYTES = 2048, 512, 32 << 20
#: Local candidates of a list for each result asked for.
DEPTH = 3
#: Components are cut to this magnitude, 1,048,576 before they are scaled, so scores of up to 2,000 components fit into 64 bits.
LIMIT = 1 << 26


def quantized(embedding: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    whole = F.transform(e, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return F.when(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), whole)


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, parts): vectors packed to blocks, with their ids and each list's coordinates (row by row, zeros after the end)."""
    n, width = (x or 0 for x in rows.agg(F.count("*"), F.max(F.size("v"))).first())
    dims = max(LISTS, width)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = _packed(group["id"], group["v"], dims)
        return pd.DataFrame({"ids": [ids.astype("<i8").tobytes()], "parts": [[np.ascontiguousarray(matrix[:, g::LISTS]).tobytes() for g in range(LISTS)]]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-n // VECTORS)))).cast("int"))
    return store.table(dealt.groupBy("block").applyInPandas(pack, "ids binary, parts array<binary>"), "topk-blocks")


def _packed(ids, vectors, dims: int) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.zeros((len(ids), dims), "<i4")
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    return np.asarray(ids, np.int64), matrix


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for frame in frames:
        for ids, parts in zip(frame["ids"], frame["parts"], strict=True):
            ids = np.frombuffer(ids, "<i8")
            yield ids, [np.frombuffer(p, "<i4").reshape(len(ids), -1) for p in parts]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in floating point only as far as it holds them."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors of greatest inner product, other than itself.

    vectors and queries have vec_id and embedding. Ties go to the smaller vec_id; fewer than k vectors give all. Rows with
    a null vec_id, or a vector that is null or holds null or non-finite components, take no part; a shorter vector counts
    as if zeros followed it. Rows with the query's vec_id are its own; other repeated rows are each a result; a vec_id is
    one query, with the first of its vectors. Other columns are not read. The number of passes over the vectors grows with the
    bytes of the queries, not with the vectors.
    """
    own = lambda t: t.select(F.col("vec_id").cast("long").alias("id"), quantized("embedding", scale).alias("v")).where("id is not null and v is not null")
    v = store.table(own(vectors), "topk-vectors")
    q = store.table(own(queries).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    blocks = _blocks(v)
    n, width = (x or 0 for x in q.agg(F.count("*"), F.max(F.size("v"))).first())
    passes = max(1, -(-n * max(LISTS, width) * 4 // PASS_BYTES))
    scored = None
    for i in range(passes):
        found = _one_pass(blocks, v, q.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i), max(LISTS, width), k)
        scored = found if scored is None else scored.unionByName(found)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(blocks: DataFrame, v: DataFrame, q: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of all that reaches their queries' cutoffs, for queries of PASS_BYTES or about as many."""
    context, deep = v.sparkSession.sparkContext, DEPTH * k
    rows = q.orderBy("id").collect()  # bounded by PASS_BYTES
    q_ids, matrix = _packed([r.id for r in rows], [r.v for r in rows], dims)
    asked = context.broadcast((q_ids, [np.ascontiguousarray(matrix[:, g::LISTS]) for g in range(LISTS)]))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, parts = asked.value
        best = [[np.zeros((len(of), 0), np.int64), np.zeros((len(of), 0), np.int64)] for _ in range(LISTS)]  # ids and partial scores
        for ids, held in _read(frames):
            for g in range(LISTS):
                kept_ids, kept = np.empty((len(of), min(deep, best[g][0].shape[1] + len(ids))), np.int64), None
                kept = np.empty_like(kept_ids)
                for a in range(0, len(of), QUERIES):
                    some = slice(a, a + QUERIES)
                    p = _products(parts[g][some], held[g])
                    p[of[some, None] == ids] = np.iinfo(np.int64).min  # its own
                    every = np.concatenate((best[g][1][some], p), axis=1)
                    names = np.concatenate((best[g][0][some], np.broadcast_to(ids, p.shape)), axis=1)
                    top = np.argpartition(-every, kept.shape[1] - 1, axis=1)[:, : kept.shape[1]]
                    kept[some], kept_ids[some] = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)
                best[g] = [kept_ids, kept]
        for g, (names, p) in enumerate(best):
            i, j = np.nonzero(p > np.iinfo(np.int64).min)
            yield pd.DataFrame({"q_id": of[i], "list": np.full(len(i), g, np.int32), "id": names[i, j], "p": p[i, j]})

    lists = blocks.mapInPandas(local, "q_id long, list int, id long, p long")
    place = F.row_number().over(Window.partitionBy("q_id", "list").orderBy(F.desc("p"), "id"))
    found = lists.withColumn("nth", place).where(F.col("nth") <= deep).select("q_id", "id").distinct()
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a.cast("long") * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = found.join(v, "id").join(F.broadcast(q.select(F.col("id").alias("q_id"), F.col("v").alias("qv"))), "q_id").select("q_id", dot.alias("score"))
    kth = exact.withColumn("nth", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score")))).where(F.col("nth") == k)
    cutoffs = {r.q_id: r.score for r in kth.select("q_id", "score").collect()}  # one of each query of the pass
    # a query with fewer than k vectors has none: everything is sufficient
    cuts = context.broadcast(np.array([cutoffs.get(i, np.iinfo(np.int64).min // 4) for i in q_ids.tolist()], np.int64))

    def sufficient(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (of, parts), least = asked.value, cuts.value
        for ids, held in _read(frames):
            for a in range(0, len(of), QUERIES):
                some = slice(a, a + QUERIES)
                given = [_products(parts[g][some], held[g]) for g in range(LISTS)]
                share = -(-least[some] // LISTS)[:, None]
                enough = [p >= share for p in given]
                i, j = np.nonzero(np.logical_or.reduce(enough))
                total = np.zeros(len(i), np.int64)
                for p, known, g in zip(given, enough, range(LISTS), strict=True):
                    told = known[i, j]
                    total[told] += p[i[told], j[told]]
                    rest = np.flatnonzero(~told)
                    width = min(parts[g].shape[1], held[g].shape[1])
                    for block in np.array_split(rest, max(1, len(rest) // 50_000)):
                        total[block] += np.einsum("ij,ij->i", parts[g][some][i[block], :width].astype(np.int64), held[g][j[block], :width].astype(np.int64))
                good = (total >= least[some][i]) & (of[some][i] != ids[j])
                yield pd.DataFrame({"query_id": of[some][i[good]], "vec_id": ids[j[good]], "score": total[good]})

    return blocks.mapInPandas(sufficient, "query_id long, vec_id long, score long")
