"""Language-model scores: a Katz bigram model with Good-Turing discounts.

P(w | h) = d(c) c / (C + 1) for a bigram seen c times after a history seen C times (the one more is a virtual event, so no
history is left without mass to back off with), else a(h) P(w), with a(h) such that the distribution sums to exactly one;
P(w) = d'(c) c / (N + 1) for words seen c times, the rest of the mass for all unknown words together. d and d' are Katz's
Good-Turing discounts of counts up to MOST_DISCOUNTED. A history that training lacks backs off wholly.

Texts are tokenized once, in pieces of some megabytes, which are written to the shared folder. Three tables follow, each
written there in key ranges, whose number comes from the number of keys. (1) A piece tells the ranges its distinct words and
bigrams (sorted 64-bit keys, packed) with its training counts; each range adds up, keeps the sums in the count table and
answers each piece in the order asked, so every token is looked up though only distinct keys travel. Ranges are of mixed
keys: a frequent history is spread over them by its successors. (2) What each history's seen successors take is added up
by range into the table of backoff weights, which answers in the same way. (3) The evaluation of a token recurses from its
bigram to its word to the unknown words. A text's terms are summed by the class of count that they depend on, and the
discounts, known only when all counts are, are put in at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import store, words

#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_K = MOST_DISCOUNTED
#: Bytes of text in a piece, keys told to a range by all pieces together, about, and bytes of rows that go into Python at once.
PIECE_BYTES, RANGE_KEYS, BATCH_BYTES = 8 << 20, 1_000_000, 8 << 20


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed: rows stay small in Spark, too; zero planes compress to nothing."""
    planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(data: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(np.dtype(kind).newbyteorder("<")).ravel().astype(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's keys begin among ascending keys, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _bincount(x: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(x, weights, n)


class Piece:
    """Tokens of some texts: vocabulary (ascending keys), code of each token, borders of texts, and distinct bigrams."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, borders: np.ndarray, train: np.ndarray) -> None:
        self.vocabulary, self.codes, self.borders, self.train = vocabulary, codes, borders, train
        self.doc = np.repeat(np.arange(len(train)), np.diff(borders))
        n = len(vocabulary)
        before = np.concatenate(([0], codes[:-1])) + 1
        before[borders[:-1]] = 0  # the start of a text
        pairs, self.bigram = np.unique(before * n + codes, return_inverse=True)
        histories, successors = pairs // n, pairs % n
        with np.errstate(over="ignore"):
            named = words.mix(np.concatenate(([_START], vocabulary))[histories] * _ODD + vocabulary[successors])
        order = np.argsort(named, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.bigrams, self.histories, self.successors, self.bigram = named[order], histories[order], successors[order], place[self.bigram]

    @classmethod
    def of(cls, text: pa.Array, train: np.ndarray) -> Piece:
        split = words.split(text, lower=True)
        named = words.mix(np.concatenate((words.hashes(split.vocabulary), [_END])))
        ends = np.insert(split.codes.astype(np.int64), split.offsets[1:], len(named) - 1)
        vocabulary, place = np.unique(named, return_inverse=True)
        used, codes = np.unique(place[ends], return_inverse=True)
        return cls(vocabulary[used], codes, split.offsets + np.arange(len(split.offsets)), train)

    @classmethod
    def read(cls, r: dict | pd.Series) -> Piece:
        """Of a row of the pieces' table."""
        return cls(unpack_keys(r["vocabulary"]), unpack(r["codes"], np.uint32).astype(np.int64), np.frombuffer(r["borders"], "<i8"), np.frombuffer(r["train"], bool))

    def messages(self, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(order, partition, keys, training counts)."""
        weights = self.train[self.doc].astype(float)
        for order, keys, at in ((1, self.vocabulary, self.codes), (2, self.bigrams, self.bigram)):
            counts, cuts = _bincount(at, len(keys), weights).astype(np.uint32), _cuts(keys, parts)
            for p in np.flatnonzero(np.diff(cuts)):
                yield order, int(p), pack_keys(keys[cuts[p] : cuts[p + 1]]), pack(counts[cuts[p] : cuts[p + 1]])


def _ask(pieces: DataFrame, parts: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                rows = list(Piece.read(held).messages(parts))
                grams, part, keys, counts = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([held["piece"]] * len(rows)), pa.array(grams, pa.int32()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["piece", "grams", "part", "keys", "counts"])

    return pieces.select("piece", "train", "vocabulary", "codes", "borders").mapInArrow(ask, "piece long, grams int, part int, keys binary, counts binary")


def _add_up(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """The range's rows of the count table (piece null), and for each message the total counts in its order, and which keys it is
    the first to have."""
    asked = asked.sort_values("piece", kind="stable")
    keys = [unpack_keys(x) for x in asked["keys"]]
    counts = np.concatenate([unpack(x, np.uint32) for x in asked["counts"]]).astype(float)
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = _bincount(at, len(distinct), counts).astype(np.uint32)
    owned = np.zeros(len(at), bool)
    owned[first[totals > 0]] = True
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    answers = pd.DataFrame({"kind": "answer", "grams": key[0], "part": key[1], "piece": asked["piece"].astype("Int64"), "keys": None, "counts": [pack(x) for x in np.split(totals[at], cuts)], "owned": [np.packbits(x).tobytes() for x in np.split(owned, cuts)]})
    seen = totals > 0
    table = pd.DataFrame({"kind": ["count"], "grams": key[0], "part": key[1], "piece": pd.array([None], "Int64"), "keys": [pack_keys(distinct[seen])], "counts": [pack(totals[seen])], "owned": None})
    return pd.concat((answers, table), ignore_index=True)


def _payload(docs: DataFrame) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, piece in enumerate(words.pieces(batches, most=PIECE_BYTES)):
            number = TaskContext.get().partitionId() << 24 | k
            train = piece.column("train").to_numpy(zero_copy_only=False)
            x = Piece.of(piece.column("text"), train)
            codes = pack(x.codes.astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"piece": [number], "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), "train": [train.tobytes()], "vocabulary": [pack_keys(x.vocabulary)], "codes": [codes], "borders": [x.borders.astype("<i8").tobytes()], "n_keys": [len(x.bigrams)]})

    return docs.select("doc_id", "text", "train").mapInArrow(keep, "piece long, doc_ids array<long>, train binary, vocabulary binary, codes binary, borders binary, n_keys long")


#: Columns of a text's linear statistics: known logarithms, tokens by class of bigram count, by class of the count backed off to.
_STATS = ["base", "fixed", *[f"m{c}" for c in range(1, _K + 1)], "backed", *[f"u{c}" for c in range(_K + 1)]]
_TEXT = "n_docs long, doc_ids array<long>, train binary, n_tokens binary, n_known binary, stats binary, asked_docs binary, asked binary, ones array<long>, twos array<long>"
#: Rows of kind text, and those that ask a range of histories.
_LOOKED = f"kind string, piece long, {_TEXT}, part int, names binary, sums binary, wants binary"


def _classes(counts: np.ndarray) -> np.ndarray:
    """Each count's class: itself up to MOST_DISCOUNTED, then one more."""
    return np.minimum(counts, _K + 1)


def _look_up(parts: int):
    def look_up(key: tuple, held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = held.iloc[0]
        x = Piece.read(r)
        train = x.train
        answers, found = answers.sort_values(["y_grams", "y_part"]), {}
        for grams, n in ((1, len(x.vocabulary)), (2, len(x.bigrams))):
            own = answers[answers["y_grams"] == grams]
            counts = [unpack(c, np.uint32) for c in own["y_counts"]]
            owned = [np.unpackbits(np.frombuffer(o, np.uint8))[: len(c)].astype(bool) for o, c in zip(own["y_owned"], counts, strict=True)]
            found[grams] = np.concatenate(counts).astype(np.int64), np.concatenate(owned)
            if len(found[grams][0]) != n:
                raise ValueError("a piece's answers do not fit its tokens: the documents changed while they were scored")
        (c1, own1), (c2, own2) = found[1], found[2]
        end = np.searchsorted(x.vocabulary, words.mix(np.array([_END])))[0]
        c_history = np.concatenate(([c1[end]], c1))  # a start occurs once for each end
        n, size = len(train), (len(train), len(_STATS))
        stats, of = np.zeros(size), {c: i for i, c in enumerate(_STATS)}
        word, seen, total = c1[x.codes], c2[x.bigram], c_history[x.histories][x.bigram]
        add = lambda name, some, weights=None: stats.__setitem__((slice(None), of[name]), stats[:, of[name]] + _bincount(x.doc[some], n, weights))
        add("base", slice(None), np.log10(word + 1.0))
        hit = seen > 0
        add("fixed", hit, np.log10(seen[hit]) - np.log10(total[hit] + 1.0))
        rest = ~hit & (word > 0)
        add("fixed", rest, np.log10(word[rest]))
        add("backed", ~hit)
        for c in range(1, _K + 1):
            add(f"m{c}", seen == c)
            add(f"u{c}", ~hit & (word == c))
        add("u0", ~hit & (word == 0))
        # what owned bigrams take from their histories, for the histories' partitions
        h, w, c = x.histories[own2], x.successors[own2], c2[own2]
        names = words.mix(np.concatenate(([_START], x.vocabulary)))
        sums = np.zeros((len(names), 2 * _K + 3), np.uint64)
        np.add.at(sums, (h, _classes(c) - 1), np.where(c > _K, c, 1).astype(np.uint64))
        np.add.at(sums, (h, _K + _classes(c1[w])), np.where(c1[w] > _K, c1[w], 1).astype(np.uint64))
        sums[:, -1] = c_history
        some = np.unique(h)
        some = some[np.argsort(names[some])]
        need = np.flatnonzero(~hit & (total > 0))
        wanted, asked = np.unique(names[x.histories[x.bigram[need]]], return_inverse=True)
        a, b = _cuts(names[some], parts), _cuts(wanted, parts)
        used = np.flatnonzero(np.diff(a) + np.diff(b))
        k = len(used)
        asks = {"kind": ["ask"] * k, "piece": [key[0]] * k, "part": used.tolist(), "names": [pack_keys(names[some][a[p] : a[p + 1]]) for p in used], "sums": [pack(sums[some][a[p] : a[p + 1]].T.ravel()) for p in used], "wants": [pack_keys(wanted[b[p] : b[p + 1]]) for p in used]}
        of_counts = lambda c, own: np.append(_bincount(np.minimum(c[own], _K + 2), _K + 3), c[own].sum()).astype(int).tolist()
        row = {
            "kind": "text", "piece": key[0], "n_docs": n, "doc_ids": r["doc_ids"], "train": r["train"], "n_tokens": np.diff(x.borders).astype("<i8").tobytes(), "n_known": _bincount(x.doc[word > 0], n).astype("<i8").tobytes(), "stats": stats.tobytes(),
            "asked_docs": pack(x.doc[need].astype(np.uint32)), "asked": pack(asked.astype(np.uint32)), "ones": of_counts(c1, own1), "twos": of_counts(c2, own2),
        }
        columns = [c.split(" ")[0] for c in _LOOKED.split(", ")]
        return pd.DataFrame({c: pd.Series([row.get(c), *asks.get(c, [None] * k)], dtype="Int64" if c in ("n_docs", "part") else None) for c in columns})

    return look_up


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discounts of the counts 1 to MOST_DISCOUNTED, from n[c], the number of kinds seen c times (n[0] unused).

    Where the counts of counts give no value in (0, 1], as in tiny corpora, half an occurrence is taken from each kind.
    """
    common = (_K + 1) * n[_K + 1] / n[1] if n[1] else 1.0
    out = []
    for c in range(1, _K + 1):
        d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and common < 1 else 0.0
        out.append(d if 0 < d <= 1 else (c - 0.5) / c)
    return np.array(out)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of docs; `learn` says which rows
    are training rows.

    Tokens are the words, A-Z lower-cased, and an end; null and empty texts are one end. base_score is add-one unigram
    smoothing with one kind for all unknown words; score is the Katz model's log10 probability. Equal texts get equal
    scores. Without training rows every token has probability 1. Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("train"))
    with store.small_batches(spark, BATCH_BYTES):
        pieces = store.table(_payload(own), "katz-texts")  # numbered and cut once: batches of other columns end at other rows
        parts = max(1, -(-(pieces.agg(F.sum("n_keys")).first()[0] or 0) // RANGE_KEYS))
        counted = _ask(pieces, parts).groupBy("grams", "part").applyInPandas(_add_up, "kind string, grams int, part int, piece long, keys binary, counts binary, owned binary")
        counted = store.table(counted, "katz-counts", ("kind", "grams"))
        answers = counted.where("kind = 'answer'").select(*[F.col(c).alias(f"y_{c}") for c in ("piece", "grams", "part", "counts", "owned")])
        looked = pieces.drop("n_keys").groupBy("piece").cogroup(answers.groupBy("y_piece")).applyInPandas(_look_up(parts), _LOOKED)
        looked = store.table(looked, "katz-pieces", ("kind",))
        asks, looked = looked.where("kind = 'ask'").select("piece", "part", "names", "sums", "wants"), looked.where("kind = 'text'").select("piece", *[c.split(" ")[0] for c in _TEXT.split(", ")])
    add = lambda c: [F.sum(F.col(c)[i]) for i in range(_K + 4)]
    totals = [int(x or 0) for x in looked.agg(*add("ones"), *add("twos")).first()]
    ones, twos = totals[: _K + 4], totals[_K + 4 :]
    n, kinds = ones[-1], sum(ones[1 : _K + 3])
    d1, d2 = discounts(ones), discounts(twos)
    unknown = 1 - (n - sum((1 - d1[c - 1]) * c * ones[c] for c in range(1, _K + 1))) / (n + 1)
    classes = np.arange(1, _K + 1)

    def weigh(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("piece", kind="stable")
        width = 2 * _K + 3
        parts_of = [(unpack_keys(k), unpack(s, np.uint64).reshape(width, -1)) for k, s in zip(told["names"], told["sums"], strict=True)]
        names, at = np.unique(np.concatenate([k for k, _ in parts_of]), return_inverse=True)
        all_sums = np.concatenate([s for _, s in parts_of], axis=1).astype(float)
        sums = np.stack([_bincount(at, len(names), s) for s in all_sums[:-1]]) if len(names) else np.zeros((width - 1, 0))
        total = np.zeros(len(names))
        total[at] = all_sums[-1]
        taken = ((d2 * classes) @ sums[:_K] + sums[_K]) / (total + 1)
        lower = ((d1 * classes) @ sums[_K + 1 : 2 * _K + 1] + sums[2 * _K + 1]) / (n + 1)
        alpha = np.log10(np.maximum(1 - taken, 1e-300) / np.maximum(1 - lower, 1e-300))
        out = []
        for data in told["wants"]:
            wanted = unpack_keys(data)
            place = np.minimum(np.searchsorted(names, wanted), max(0, len(names) - 1))
            # a history of this model has at least one seen successor, its text's next word or end
            out.append(alpha[place].astype("<f8").tobytes())
        answers = pd.DataFrame({"kind": "answer", "part": key[0], "piece": told["piece"].astype("Int64"), "histories": None, "alpha": out})
        table = pd.DataFrame({"kind": ["weight"], "part": key[0], "piece": pd.array([None], "Int64"), "histories": [pack_keys(names)], "alpha": [alpha.astype("<f8").tobytes()]})
        return pd.concat((answers, table), ignore_index=True)

    with store.small_batches(spark, BATCH_BYTES):
        weights = store.table(asks.groupBy("part").applyInPandas(weigh, "kind string, part int, piece long, histories binary, alpha binary"), "katz-weights", ("kind",))
    backoff = weights.where("kind = 'answer'").select(F.col("piece").alias("y_piece"), F.col("part").alias("y_part"), "alpha")

    def finish(key: tuple, held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r = held.iloc[0]
        rows = int(r["n_docs"])
        stats = np.frombuffer(r["stats"]).reshape(rows, len(_STATS))
        get = {c: stats[:, i] for i, c in enumerate(_STATS)}
        n_tokens = np.frombuffer(r["n_tokens"], "<i8")
        alpha = np.concatenate([np.frombuffer(x, "<f8") for x in told.sort_values("y_part")["alpha"]]) if len(told) else np.zeros(0)
        total = get["fixed"] + _bincount(unpack(r["asked_docs"], np.uint32), rows, alpha[unpack(r["asked"], np.uint32)])
        for c in range(1, _K + 1):
            total = total + get[f"m{c}"] * np.log10(d2[c - 1]) + get[f"u{c}"] * np.log10(d1[c - 1])
        total = total + get["u0"] * np.log10(unknown) - (get["backed"] - get["u0"]) * np.log10(n + 1)
        base = get["base"] - n_tokens * np.log10(n + kinds + 1)
        return pd.DataFrame({"doc_id": pd.array(list(r["doc_ids"]), "Int64"), "train": np.frombuffer(r["train"], bool), "n_tokens": n_tokens, "n_known": np.frombuffer(r["n_known"], "<i8"), "train_tokens": n, "base_score": base, "score": total})

    texts = looked.select("piece", "n_docs", "doc_ids", "train", "n_tokens", "n_known", "stats", "asked_docs", "asked")
    return texts.groupBy("piece").cogroup(backoff.groupBy("y_piece")).applyInPandas(finish, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


