"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-led words of a batch are concatenated; a suffix array over them, sorted as deep as the longest piece,
answers by binary search where each piece of the vocabulary occurs. The occurrences are edges between positions; sorted
by position they are relaxed: the prefix that ends at a position has one last piece, the edge whose start has a last
piece that may stand before it. For a BPE model two pieces may stand next to each other if no merge across their border
would have come before the merges that made them, which is read off their merge trees. That rule gives the same pieces
as merging best pairs first. Characters in no piece fall back to bytes. Decoding joins pieces and bytes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import words

SPACE = "▁"
#: Words whose ids a task keeps, and characters that are indexed at once.
CACHED_WORDS, INDEXED_CHARS = 300_000, 500_000
#: Bytes of text that are encoded at once; a longer text is a piece of its own.
TEXT_BYTES = 2 << 20
_NONE, _START, _UNKNOWN = -9, -1, -2


@dataclass
class Vocabulary:
    """pieces: text by id; rank: order of merging (-1: single character); left, right: the merge that makes a piece
    (itself if single); usable: pieces that merging can make; byte_ids: id of each byte; pairs, merged: codes left * size +
    right of pieces that may merge, ascending, and what they make; alphabet: characters of all pieces."""

    pieces: list[str]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray
    raw: list[bytes]

    def __post_init__(self) -> None:
        size, index = len(self.pieces), {self.pieces[i]: i for i in np.flatnonzero(self.rank > -9)}
        found = [(index[p[:k]] * size + index[p[k:]], i) for p, i in index.items() for k in range(1, len(p)) if p[:k] in index and p[k:] in index]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.pairs, self.merged, self.index = table[:, 0], table[:, 1], index
        self.alphabet = np.unique(np.array([ord(c) for p in index for c in p]))
        ids = np.flatnonzero(self.usable)
        self.ids, self.lengths = ids, np.array([len(self.pieces[i]) for i in ids])
        self.depth = int(self.lengths.max(initial=1))
        self.spelled = np.zeros((len(ids), self.depth), np.int32)
        for row, i in enumerate(ids):
            self.spelled[row, : len(self.pieces[i])] = np.searchsorted(self.alphabet, [ord(c) for c in self.pieces[i]]) + 1

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: undo their merges, last first, and see whether a merge across comes before.
        Of equal merges the left one comes first."""
        pairs, back = np.unique(a * len(self.pieces) + b, return_inverse=True)
        x, y = pairs // len(self.pieces), pairs % len(self.pieces)
        ok, todo = np.ones(len(x), bool), np.arange(len(x))
        never = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(x), never), np.full(len(x), never)
        while len(todo):
            code = x * len(self.pieces) + y
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == code, self.rank[self.merged[at]], never)
            bad = (rank < until_x) & (rank <= until_y) & (rank < never)
            ok[todo[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            todo, x, y, until_x, until_y = todo[go], x[go], y[go], until_x[go], until_y[go]
            undo = self.rank[x] > self.rank[y]
            until_x, until_y = np.where(undo, self.rank[x], until_x), np.where(undo, until_y, self.rank[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok[back]


@cache
def vocabulary(path: str) -> Vocabulary:
    """Reads a BPE model file with byte fallback and no normalization but for spaces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in range(size)])
    rank = np.full(size, -9, np.int64)
    order = {s: r for r, s in enumerate(sorted({-scores[i] for i in normal}))}
    for i in normal:
        rank[i] = order[-scores[i]] if len(pieces[i]) > 1 else -1
    index = {pieces[i]: i for i in normal}
    left, right, usable = np.arange(size), np.arange(size), np.zeros(size, bool)
    for i in normal:  # merge a piece's own text, best pair first
        parts = list(pieces[i])
        while len(parts) > 1:
            best = min(((rank[index[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in index), default=None)
            if best is None:
                break
            k = best[1]
            if len(parts) == 2:
                left[i], right[i] = index.get(parts[0], i), index.get(parts[1], i)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        usable[i] = len(parts) == 1
    byte_ids = np.array([index_of if (index_of := model.piece_to_id(f"<0x{b:02X}>")) >= 0 else 0 for b in range(256)])
    raw = [b""] * size
    for i in normal:
        raw[i] = pieces[i].replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    return Vocabulary(pieces, rank, left, right, usable, byte_ids, raw)


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their next `depth` or more symbols (prefix doubling); 0 is below all symbols."""
    rank, reach = text.astype(np.int64), 1
    while reach < depth:
        following = np.concatenate((rank[reach:], np.zeros(min(reach, len(rank)), np.int64)))
        rank = np.unique(rank * (rank.max() + 1 if len(rank) else 1) + following, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def _occurrences(text: np.ndarray, suffixes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place among the suffixes of each usable piece's occurrences, by binary search."""
    n, padded = len(text), np.concatenate((text, np.zeros(vocab.depth, text.dtype)))
    low, high = np.zeros(len(vocab.ids), np.int64), np.full(len(vocab.ids), n)
    for d in range(vocab.depth):
        alive = np.flatnonzero((vocab.lengths > d) & (low < high))
        if not len(alive):
            break
        symbol = vocab.spelled[alive, d]
        ends = []
        for above in (0, 1):  # the first suffix in the range whose symbol is not below symbol + above
            a, b = low[alive].copy(), high[alive].copy()
            while (open_ := a < b).any():
                middle = (a + b) // 2
                below = padded[suffixes[np.minimum(middle, n - 1)] + d] < symbol + above
                a, b = np.where(open_ & below, middle + 1, a), np.where(open_ & ~below, middle, b)
            ends.append(a)
        low[alive], high[alive] = ends
    return low, np.maximum(low, high)


def _matched(units: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each unit (a text without a space behind another character), as little-endian unsigned 32-bit integers."""
    joined = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, units), np.int64, len(units))
    start = np.cumsum(size + 1) - size - 1
    place = np.minimum(np.searchsorted(vocab.alphabet, joined), len(vocab.alphabet) - 1)
    text = np.where(vocab.alphabet[place] == joined, place + 1, 0).astype(np.int32)
    inside = np.ones(len(text), bool)
    inside[start[1:] - 1] = False
    text[~inside] = 0
    suffixes = _suffixes(text, vocab.depth)
    low, high = _occurrences(text, suffixes, vocab)
    count = high - low
    at = suffixes[words.ranges(low, count)]
    piece, length = np.repeat(vocab.ids.astype(np.int32), count), np.repeat(vocab.lengths.astype(np.int32), count)
    unknown = np.flatnonzero((text == 0) & inside).astype(np.int32)
    at, piece, length = np.concatenate((at, unknown)), np.concatenate((piece, np.full(len(unknown), _UNKNOWN, np.int32))), np.concatenate((length, np.ones(len(unknown), np.int32)))
    unit = np.repeat(np.arange(len(units), dtype=np.int32), size + 1)[: len(text)]
    end = at - start.astype(np.int32)[unit[at]] + length
    order = np.argsort(end, kind="stable")  # by where the edge ends in its unit
    at, piece, length, end = at[order], piece[order], length[order], end[order]
    last = np.full(len(text) + 1, _NONE, np.int64)  # the last piece of the prefix that ends before a position
    last[start] = _START
    cuts = np.searchsorted(end, np.arange(1, int(size.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        before, own = last[at[a:b]], piece[a:b]
        good = (before != _NONE) & ((before < 0) | (own < 0))
        test = np.flatnonzero((before >= 0) & (own >= 0))
        good[test] = vocab.adjacent(before[test], own[test].astype(np.int64))
        last[at[a:b][good] + length[a:b][good]] = own[good]
    # a unit's first position is also the end of the separator before it; its own last piece stands behind its end
    spans = np.ones(len(vocab.pieces) + 1, np.int64)
    spans[vocab.ids] = vocab.lengths
    where, alive, steps = start + size, np.arange(len(units)), []
    while len(alive):
        own = last[where[alive]]
        alive, own = alive[where[alive] > start[alive]], own[where[alive] > start[alive]]
        where[alive] -= spans[own]
        steps.append((alive, own, where[alive].copy()))
    if not steps:
        return [b""] * len(units)
    of, ids, places = (np.concatenate([s[k] for s in steps]) for k in range(3))
    order = np.argsort(places, kind="stable")
    of, ids, places = of[order], ids[order], places[order]
    if (ids == _UNKNOWN).any():
        spelled = [vocab.byte_ids[np.frombuffer(chr(joined[p]).encode("utf-8", "replace"), np.uint8)] if i == _UNKNOWN else [i] for i, p in zip(ids, places, strict=True)]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        ids, of = np.concatenate(spelled), np.repeat(of, lengths)
    data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(of, minlength=len(units)))).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_texts(texts: pa.Array, path: str, kept: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin (one more than texts). Null and empty texts have none.

    kept: ids of up to CACHED_WORDS words that earlier calls have found, which this one adds to."""
    vocab, kept = vocabulary(path), {} if kept is None else kept
    texts = pc.fill_null(texts, "")
    hard = pc.match_substring_regex(texts, f"[ {SPACE}][ {SPACE}]|^[ {SPACE}]|[ {SPACE}]$|{SPACE}")
    parts = pc.split_pattern(pc.if_else(hard, "", texts), " ")
    flat, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
    offsets, codes = offsets - offsets[0], flat.indices.to_numpy().astype(np.int64)
    units = [SPACE + x for x in flat.dictionary.to_pylist()]
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    rows, borders = codes, offsets
    if hard_rows := np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist():
        index = {u: i for i, u in enumerate(units)}
        split = {i: [index.setdefault(u, len(index)) for u in _units(texts[i].as_py())] for i in hard_rows}
        units = list(index)
        lists = [np.array(split[i], np.int64) if i in split else codes[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        rows, borders = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    keep = np.repeat(~empty, np.diff(borders))
    borders = np.concatenate(([0], np.cumsum(keep)))[borders]
    rows = rows[keep]
    used = np.unique(rows)
    names = [units[i] for i in used.tolist()]
    new = [u for u in names if u not in kept]
    fresh: dict[str, bytes] = {}
    start = size = 0
    for k, unit in enumerate(new):
        size += len(unit) + 1
        if size > INDEXED_CHARS or k == len(new) - 1:
            batch = new[start : k + 1]
            fresh |= zip(batch, _matched(batch, vocab), strict=True)
            start, size = k + 1, 0
    found = [x if (x := kept.get(u)) is not None else fresh[u] for u in names]
    kept.update(islice(fresh.items(), max(0, CACHED_WORDS - len(kept))))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    place = np.zeros(len(units), np.int64)
    place[used] = np.arange(len(used))
    rows = place[rows]
    lengths = sizes[rows]
    ids = np.frombuffer(b"".join(found), "<u4")[words.ranges((np.cumsum(sizes) - sizes)[rows], lengths)]
    return ids, np.concatenate(([0], np.cumsum(lengths)))[borders]


def _units(text: str) -> list[str]:
    """Runs of spaces with the characters behind them, of a text with a space put before it."""
    out, inside = [], True
    for c in SPACE + text.replace(" ", SPACE):
        if c == SPACE and inside:
            out.append([])
        inside = c != SPACE
        out[-1].append(c)
    return ["".join(x) for x in out]


def decode_ids(ids: np.ndarray, borders: np.ndarray, path: str) -> list[str]:
    """The texts of ids; bytes that are not UTF-8 become replacement characters, and one leading space goes."""
    raw = vocabulary(path).raw
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    table = np.frombuffer(b"".join(raw), np.uint8)
    data = table[words.ranges((np.cumsum(sizes) - sizes)[ids], sizes[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[borders]
    return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array) of every row of docs: whole texts, null and empty ones without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, bytes] = {}
        for piece in words.pieces(batches, most=TEXT_BYTES):
            ids, borders = encode_texts(piece.column("text"), path, kept)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
        kept.clear()
        words.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            borders = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), borders, path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_chars and round_trip (decoding
    gives the text, with every U+2581 read as a space) of every row of docs; ids are encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, bytes] = {}
        for piece in words.pieces(batches, most=TEXT_BYTES):
            ids, borders = encode_texts(piece.column("text"), path, kept)
            data, texts = ids.astype("<u4").tobytes(), pc.fill_null(piece.column("text"), "").to_pylist()
            back = decode_ids(ids, borders, path)
            sums = [crc32(data[4 * a : 4 * b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            same = [a == b.replace(SPACE, " ") for a, b in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(borders)), pa.array(sums, pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "round_trip"])
        kept.clear()
        words.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean")
