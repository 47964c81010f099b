"""Near duplicates: MinHash banding, sequential Bayesian verification of signatures, exact confirmation on full sets.

Texts with equal shingle sets are one node. Nodes that agree in a band of their signatures are candidates. First the
members of each bucket are tried against its first node. Then buckets that still hold nodes of different groups meet in
block tasks, which try all such pairs and return only those that join two groups, so that no task lists a bucket's pairs:
every pair that survives its trial now lies inside one group of suspects. The suspects that were found are confirmed on full
sets and joined to components; groups of suspects that still hold several components meet in block tasks once more, with
their full sets, and every pair across components that survives its trial is confirmed there. Such a task returns only
links that join two components. Pairs inside a component need no test, so no link that could join components is lost.

A trial compares signatures batch by batch. With a uniform prior the similarity's posterior after n comparisons and m
matches is Beta(m + 1, n - m + 1); a pair is pruned when the probability of reaching the threshold falls below MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemill.llm import store, words

#: Signature length, hashes in a band, hashes in a batch of a trial, and the probability of pruning a pair that belongs.
HASHES, ROWS, BATCH, MISS = 128, 4, 32, 1e-6
#: Members of a block of a bucket, members of a group whose pairs are listed inside a task, shingles of a block with full sets.
BLOCK, SMALL, BLOCK_SHINGLES = 2_048, 24, 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, as 64-bit hashes, ascending in each text, and where each text's begin.

    A-Z are lower-cased. A text of fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    split = words.split(text, lower=True)
    h = words.hashes(split.vocabulary)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
    n = np.diff(split.offsets)
    with np.errstate(over="ignore"):
        rolled, at = h.copy(), split.offsets[:-1]
        for k in range(1, shingle):
            following = np.concatenate((h[k:], np.zeros(min(k, len(h)), np.uint64)))
            inside = np.arange(len(h)) + k < np.repeat(split.offsets[1:], n)  # a short text's shingle ends with it
            rolled = np.where(inside, words.mix(rolled * _ODD + following), rolled)
    many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), many)
    rolled = words.mix(rolled[words.ranges(at, many)])
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[first], np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(n)))))


def _factors() -> np.ndarray:
    return np.random.default_rng(23).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(hashes: np.ndarray, factors: np.ndarray) -> bytes:
    """For each factor the element of least product, as 16 well-mixed bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            least = np.minimum(least, (hashes[i : i + 1024, None] * factors).min(0))
    return (words.mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def _prints(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits that name each text's set: sums of its mixed elements."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(words.mix(h ^ np.uint64(c)), dtype=np.uint64))) for c in (1, 2)]
        return [x.tobytes() for x in np.stack([s[at[1:]] - s[at[:-1]] for s in sums], 1)]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the set), signature (null for empty sets)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for piece in words.pieces(batches):
            h, at = shingle_hashes(piece.column("text"), shingle)
            signed = [_signature(h[a:b], factors) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(at)), pa.array(_prints(h, at), pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "print", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, print binary, signature binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(id, n_shingles, signature) to a row (band, nr, id, n_shingles) for each band; band is the hash of its number nr and its values."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u8").reshape(batch.num_rows, -1)
                width = values.shape[1]
                with np.errstate(over="ignore"):
                    keys = words.mix(values + np.arange(1, width + 1, dtype=np.uint64) * _ODD).view(np.int64)
                own = [pa.array(np.repeat(batch.column(c).to_numpy(), width)) for c in ("id", "n_shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(width, dtype=np.int8), batch.num_rows)), *own], ["band", "nr", "id", "n_shingles"])

    return nodes.select("id", "n_shingles", "signature").mapInArrow(cut, "band long, nr byte, id long, n_shingles long")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of batches: the fewest matches with which P(similarity >= threshold) is at least miss."""
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # a Beta(m + 1, n - m + 1) variable exceeds t as often as a binomial(n + 1, t) one is at most m
        below = np.cumsum([comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(n + 1)])
        found.append(int(np.argmax(below >= miss)))
    return found


def trial(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of signatures a and b (uint16): indices of the pairs that survive all batches, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, few in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        good = matches >= few
        alive, matches = alive[good], matches[good]
    return alive, matches


def _tried(pairs: DataFrame, nodes: DataFrame, least: list[int]) -> DataFrame:
    """Pairs (a, b) that survive their trial, with matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(c)) for c in ("sa", "sb"))
                alive, matches = trial(a, b, least)
                kept = batch.select(["a", "b"]).take(pa.array(alive))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches, pa.int64())], ["a", "b", "matches"])

    joined = pairs.join(nodes.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(nodes.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, matches long")


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), "<u2").reshape(-1, HASHES)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    @pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out)

    with_b = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("sa")), "a")
    return both.where(linked("sa", "sb")).select("a", "b")


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """id and elements (the 64-bit hashes of all distinct shingles) of the nodes (id, least, print)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            h, at = shingle_hashes(piece.column("text"), shingle)
            elements = pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            own = pa.array([x == y for x, y in zip(_prints(h, at), piece.column("print").to_pylist(), strict=True)])  # another row of the id may have another text
            yield pa.RecordBatch.from_arrays([piece.column("id"), elements], ["id", "elements"]).filter(own)

    wanted = nodes.select("id", "least", "print")
    held = docs.select(F.col("doc_id").cast("long").alias("of"), "text").join(wanted, F.col("of") == F.col("least"))
    return held.select("id", "text", "print").mapInArrow(pack, "id long, elements binary").dropDuplicates(["id"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the least id reachable, for every id that has a link.

    Each round takes the least label among neighbours and then the label of that label, until nothing changes.
    """
    edges = store.table(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")), "dedup-edges")
    labels = store.table(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "dedup-labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("near"))
        joined = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = store.table(joined.join(jump, "component").select("id", "old", F.least("component", "next").alias("component")), "dedup-labels")
        store.discard(labels)
        if not new.where("old <> component").limit(1).count():
            store.discard(edges)
            return new.select("id", "component")
        labels = new


class _Rows:
    """Rows of some whole groups, ordered by group: where groups begin and end, and columns by name."""

    def __init__(self, rows: pa.Table, starts: np.ndarray) -> None:
        self.table, self.starts = rows, starts
        self.id, self.component, self.n, self.stray = (rows.column(c).to_numpy() for c in ("id", "component", "n_shingles", "stray"))
        self.member = rows.column("member").to_numpy()
        self.signature = _matrix(rows.column("signature"))


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[_Rows]:
    """Whole groups of rows that come ordered by their key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for c in key:
            v = batch.column(c).to_numpy()
            changes[1:] |= v[1:] != v[:-1]
            changes[0] |= bool(held) and held[-1].column(c)[-1].as_py() != v[0]
        cut = np.flatnonzero(changes)
        if not len(cut):
            held.append(batch)
            continue
        yield from _whole([*held, batch.slice(0, cut[-1])], key)
        held = [batch.slice(cut[-1])]
    yield from _whole(held, key)


def _whole(batches: list[pa.RecordBatch], key: list[str]) -> Iterator[_Rows]:
    if rows := sum(b.num_rows for b in batches):
        table, changes = pa.Table.from_batches(batches).combine_chunks(), np.zeros(rows, bool)
        changes[0] = True
        for c in key:
            v = table.column(c).to_numpy()
            changes[1:] |= v[1:] != v[:-1]
        yield _Rows(table, np.append(np.flatnonzero(changes), rows))


def _blocks(rows: DataFrame, key: str, sizes: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of groups (key) dealt to block tasks, with the columns of more (by id). All rows of a group of one block meet in one
    task; of a larger group, whatever lies outside its main component (stray) meets every block of members."""
    dealt = rows.join(sizes, key)
    for other in more:
        dealt = dealt.join(other, "id")
    deal, blocks, outside = F.xxhash64("id"), F.col("blocks"), F.col("component") != F.col("main")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("strays") * blocks / F.col("of")).cast("int"))
    place = lambda block, chunk, stray, member: F.struct(block.cast("int").alias("block"), chunk.cast("int").alias("chunk"), F.lit(stray).alias("stray"), F.lit(member).alias("member"))
    whole = F.array(place(F.lit(0), F.lit(0), True, True))
    members = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: place(F.pmod(deal, blocks), c, False, True))
    strays = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: place(b, F.pmod(F.shiftright(deal, 20), chunks), True, False))
    places = F.when(blocks == 1, whole).when(outside, F.concat(members, strays)).otherwise(members)
    dealt = dealt.withColumn("at", F.explode(places)).select(*rows.columns, *[c for other in more for c in other.columns if c != "id"], "at.*")
    return dealt.repartition(store.partitions(rows.sparkSession), key, "block", "chunk").sortWithinPartitions(key, "block", "chunk", "id", "stray")


def _sizes(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Groups of several components: their blocks (an expression of n and shingles), main component, members (of) and strays."""
    by_part = rows.groupBy(key, "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    sums = by_part.groupBy(key).agg(F.sum("k").alias("of"), F.sum("s").alias("shingles"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return sums.select(key, "of", blocks.cast("int").alias("blocks"), F.col("top.component").alias("main"), (F.col("of") - F.col("top.k")).alias("strays"))


def _joining(rows: _Rows, a: int, b: int, test) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a group, a to b, that join two of its components. test(x, others): those that belong to x, best first."""
    members = np.flatnonzero(rows.member[a:b]) + a
    of = rows.component[a:b].copy()
    for x in np.flatnonzero(rows.stray[a:b]) + a:
        others = members[(of[members - a] != of[x - a]) & (rows.id[members] != rows.id[x])]
        if rows.member[x]:  # the group is one block: every pair once
            others = others[others > x]
        for y in test(x, others) if len(others) else ():
            if of[y - a] != of[x - a]:
                of[of == of[y - a]] = of[x - a]
                yield x, y


def _alike(rows: _Rows, x: np.ndarray | int, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * np.minimum(rows.n[x], rows.n[y]) >= percent * np.maximum(rows.n[x], rows.n[y])


def _suspects(open_: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Pairs (a, b, matches) of a bucket that survive their trial and join two groups; a pair is tried in the first band that it shares."""

    def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.ascontiguousarray(a).view("<u8") == np.ascontiguousarray(b).view("<u8")).argmax(1)

    def small(rows: _Rows, nr: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Of all groups of up to SMALL rows at once."""
        sizes = np.diff(rows.starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        own, last, xs, ys = np.flatnonzero(groups[group]), len(group) - 1, [], []
        for d in range(1, int(sizes[groups].max(initial=1))):
            x, y = own, np.minimum(own + d, last)
            good = (x + d <= last) & (group[x] == group[y]) & (rows.component[x] != rows.component[y]) & _alike(rows, x, y, percent)
            xs.append(x[good])
            ys.append(y[good])
        if not xs:
            return
        x, y = np.concatenate(xs), np.concatenate(ys)
        for part in np.array_split(np.arange(len(x)), len(x) // 100_000 + 1):
            sa, sb = rows.signature[x[part]], rows.signature[y[part]]
            alive, matches = trial(sa, sb, least)
            shared = first_band(sa[alive], sb[alive]) == nr[x[part][alive]]
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def root(k: tuple[int, int], up=up) -> tuple[int, int]:
                while k in up:
                    k = up[k]
                return k

            for i in np.flatnonzero(shared)[np.argsort(-matches[shared], kind="stable")]:
                p, q = x[part][alive[i]], y[part][alive[i]]
                u, v = root((group[p], rows.component[p])), root((group[q], rows.component[q]))
                if u != v:
                    up[u] = v
                    yield p, q, matches[i]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["band", "block", "chunk"]):
            nr, sizes = rows.table.column("nr").to_numpy(), np.diff(rows.starts)
            tiny = (sizes <= SMALL) & rows.stray[rows.starts[:-1]] & rows.member[rows.starts[:-1]]
            found = list(small(rows, nr, tiny))
            for g in np.flatnonzero(~tiny):
                seen: dict[tuple[int, int], int] = {}

                def test(x: int, others: np.ndarray, rows=rows, nr=nr, seen=seen) -> np.ndarray:
                    others = others[_alike(rows, x, others, percent)]
                    sa, sb = np.broadcast_to(rows.signature[x], (len(others), HASHES)), rows.signature[others]
                    alive, matches = trial(sa, sb, least)
                    own = first_band(sa[alive], sb[alive]) == nr[x]
                    alive, matches = alive[own], matches[own]
                    order = np.argsort(-matches, kind="stable")
                    seen.clear()
                    seen.update(zip(others[alive].tolist(), matches.tolist(), strict=True))
                    return others[alive[order]]

                found += [(x, y, seen[int(y)]) for x, y in _joining(rows, rows.starts[g], rows.starts[g + 1], test)]
            if found:
                x, y, matches = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rows.id[x], rows.id[y])), pa.array(np.maximum(rows.id[x], rows.id[y])), pa.array(matches)], ["a", "b", "matches"])

    return open_.mapInArrow(meet, "a long, b long, matches long")


def _links(open_: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Pairs (a, b) of a group of suspects that are linked by their full sets and join two components."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["suspect", "block", "chunk"]):
            found = []
            for s, t in zip(rows.starts[:-1], rows.starts[1:], strict=True):
                data = rows.table.column("elements").slice(s, t - s).to_pylist()
                ends = np.concatenate(([0], np.cumsum([len(d) // 8 for d in data])))
                names, at = np.unique(np.frombuffer(b"".join(data), "<u8"), return_inverse=True)
                at, held = at.astype(np.int32), np.zeros(len(names), np.int8)

                def test(x: int, others: np.ndarray, rows=rows, s=s, ends=ends, at=at, held=held) -> np.ndarray:
                    others = others[_alike(rows, x, others, percent)]
                    alive, matches = trial(np.broadcast_to(rows.signature[x], (len(others), HASHES)), rows.signature[others], least)
                    y = others[alive[np.argsort(-matches, kind="stable")]]
                    if not len(y):
                        return y
                    mine = at[ends[x - s] : ends[x - s + 1]]
                    held[mine] = 1
                    n = rows.n[y]
                    both = np.add.reduceat(held[at[words.ranges(ends[y - s], n)]], np.cumsum(n) - n, dtype=np.int64)
                    held[mine] = 0
                    return y[100 * both >= percent * (rows.n[x] + n - both)]

                found += list(_joining(rows, s, t, test))
            if found:
                x, y = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rows.id[x], rows.id[y])), pa.array(np.maximum(rows.id[x], rows.id[y]))], ["a", "b"])

    return open_.mapInArrow(meet, "a long, b long")


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (id, ...) with their component, their own id where they have no link."""
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _linked(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row of docs with the name of its set, the nodes, and links between them that join all that is linked."""
    least = least_matches(percent / 100)
    signed = store.table(signatures(docs, shingle), "dedup-signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("print").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = store.table(nodes.withColumn("id", F.monotonically_increasing_id()), "dedup-nodes")
    banded = bands(nodes)
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    banded = store.table(banded.join(heads, "band"), "dedup-bands")  # only buckets of two or more
    first = banded.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    tried = _tried(first, nodes, least).groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("a"))).alias("best"))
    first = store.table(tried.select((-F.col("best.a")).alias("a"), "b"), "dedup-first")
    placed = store.table(_placed(banded.drop("head"), components(first)), "dedup-placed")
    sizes = _sizes(placed, "band", F.ceil(F.col("of") / BLOCK))
    met = _blocks(placed, "band", sizes, nodes.select("id", "signature"))
    more = store.table(_suspects(met, least, percent).groupBy("a", "b").agg(F.max("matches").alias("matches")), "dedup-suspects")
    pairs = first.union(more.select("a", "b"))
    suspects = components(pairs).withColumnRenamed("component", "suspect")
    known = nodes.join(suspects, "id")
    sets = store.table(full_sets(docs, known, shingle), "dedup-sets")
    links = store.table(_confirmed(pairs, sets, percent), "dedup-links")
    # a group of two suspects has one pair, which is confirmed or not; larger ones meet whole
    placed = store.table(_placed(known.select("id", "suspect", "n_shingles"), components(links)), "dedup-placed")
    sizes = _sizes(placed, "suspect", F.greatest(F.ceil(F.col("of") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).where("of > 2")
    met = _blocks(placed, "suspect", sizes, nodes.select("id", "signature"), sets)
    links = links.union(store.table(_links(met, least, percent).distinct(), "dedup-more-links"))
    return signed, nodes, links


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, print, component_id and stands of every row of docs: `print` names the row's set, and `stands` is true
    on the rows of one set in each component, that of the least doc_id (of several sets, the least print)."""
    with store.small_batches(docs.sparkSession):  # sets and texts are wide rows
        signed, nodes, links = _linked(docs, shingle, percent)
        found = components(links)
    found = _placed(nodes.select("id", "least", "print"), found)
    heads = found.groupBy("component").agg(F.min(F.struct("least", "print")).alias("head"))
    by_print = found.join(heads, "component").select(F.col("print").alias("of"), F.col("head.least").alias("component_id"), (F.col("print") == F.col("head.print")).alias("stands"))
    result = signed.join(by_print, signed["print"] == by_print["of"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    stands = F.col("stands") & (F.col("doc_id") == F.col("component_id"))
    return result.select("doc_id", "n_shingles", "print", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, stands).otherwise(True).alias("stands"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included), kept (doc_id =
    component_id) of every row of docs.

    Two texts are linked if 100 * intersection >= percent * union of their sets of distinct word shingles. Texts
    without words, null ones too, have empty sets and are linked with nothing. Equal sets are one node; copies of any
    number cost that one. A null doc_id is alone (its component is null and it is kept). Of rows that repeat a doc_id each
    gets the component of its own set: a shared doc_id is no link. Other columns are not read. Shingles are compared by
    64-bit hashes: two of a million different ones meet with a probability of 3e-8.
    """
    return groups(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns but `__print`) without near duplicates: of each component one row stays.

    It is a row with the least doc_id; of several texts with that doc_id the one of the least print; of rows equal in
    doc_id and set, any one. Rows with an empty set or a null doc_id are near duplicates of nothing and all stay.
    """
    rows = store.table(groups(docs, shingle, percent), "dedup-groups")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            prints = pa.array(_prints(*shingle_hashes(piece.column("text"), shingle)), pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns, prints], [*piece.schema.names, "__print"])

    marked = docs.mapInArrow(mark, StructType([*docs.schema.fields, StructField("__print", BinaryType())]))
    gone = rows.where("not stands").select(F.col("doc_id").alias("g_id"), F.col("print").alias("g_print")).distinct()
    left = marked.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("__print") == F.col("g_print")), "left_anti")
    twice = rows.where("stands and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "print").count().where("count > 1").select(F.col("doc_id").alias("t_id"), F.col("print").alias("t_print"))
    same = (F.col("doc_id") == F.col("t_id")) & (F.col("__print") == F.col("t_print"))
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__print"])).drop("__print")
