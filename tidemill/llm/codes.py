"""Token ids in files of directly addressable codes (DACs).

An id is cut into chunks of 8 bits, low chunk first. Level k has the k-th chunk of every id that has one, and a bitmap
that says which of them continue on level k + 1; a rank directory counts the ones before every 512th bit. Token i of a
segment is found by its chunk on level 0 and, while the bitmap says so, by rank on the next level; no other token is
decoded. The container is Parquet, so files commit as a whole and are read where only Spark can open them: a row is a
segment (consecutive documents), its columns are the levels and the document borders.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import store, words

#: Bits that a rank directory's entry covers.
RANK_BITS = 512
#: White space next to white space, where a text can't be cut into words before each space; Unicode's, as the tokenizer has it.
_WHITE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TAILS = (".", ",")
#: Byte-level tokenizers' character for each byte: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Level(NamedTuple):
    """chunks: a byte for each id that reaches this level; bits: which go on (little-endian bits); ranks: ones before every RANK_BITS-th."""

    chunks: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray


def pack(ids: np.ndarray) -> list[Level]:
    """Levels of unsigned ids; at least one, without chunks if there are no ids."""
    levels, ids = [], ids.astype(np.uint64)
    while True:
        more = ids > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(_ONES[bits], dtype=np.uint32)))
        levels.append(Level(ids.astype(np.uint8), bits, ones[:: RANK_BITS // 8].astype(np.uint32)))
        if not more.any():
            return levels
        ids = ids[more] >> np.uint64(8)


def rank(level: Level, i: int) -> int:
    """Ones of the level's bitmap before bit i."""
    block = i // RANK_BITS
    byte = block * (RANK_BITS // 8)
    ones = int(level.ranks[block]) + int(_ONES[level.bits[byte : i // 8]].sum())
    return ones + (int(_ONES[level.bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)


def access(levels: list[Level], start: int, stop: int) -> np.ndarray:
    """Ids start to stop, straight from their own chunks."""
    out, at = np.zeros(stop - start, np.uint64), np.arange(stop - start)
    for k, level in enumerate(levels):
        if stop <= start:
            break
        out[at] |= level.chunks[start:stop].astype(np.uint64) << np.uint64(8 * k)
        bits = np.unpackbits(level.bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
        at, first = at[bits], rank(level, start)
        start, stop = first, first + len(at)
    return out


@cache
def _tokenizer(path: str, specials: bool = False):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = not specials  # whether a special token's string in a text is text
    return made


@cache
def _added(path: str) -> list[str]:
    """Strings of the tokenizer's added tokens."""
    return [x.content for x in _tokenizer(path).get_added_tokens_decoder().values()]


#: Bytes of text handled at once, and parts of texts whose ids a worker keeps.
TEXT_BYTES, CACHED_PARTS = 8 << 20, 500_000
_kept: dict[str, dict[str, bytes]] = {}


def _encoded(parts: list[str], tokenizer_path: str) -> list[bytes]:
    """Ids of each part as little-endian unsigned 32-bit integers. Parts hold no white space next to white space.

    A full stop or comma that ends a part after a letter is a token run of its own, so the part before it is looked up
    alone. A part of letters only, but for a space before them, is one pre-token and goes straight to the model.
    """
    kept, whole = _kept.setdefault(tokenizer_path, {}), _tokenizer(tokenizer_path)
    stems, rest, split = {}, [], []
    for x in parts:
        if x not in kept:
            if x[-1:] in _TAILS and x[-2:-1].isalpha():
                split.append(x)
                x = x[:-1]
                if x in kept or x in stems:
                    continue
            if x.lstrip(" ").isalpha():
                stems[x] = None
            else:
                rest.append(x)
    tokenize, packed = whole.model.tokenize, {}
    for x in stems:
        packed[x] = array("I", [t.id for t in tokenize(x.replace(" ", _BYTES[32]) if x.isascii() else "".join([_BYTES[b] for b in x.encode()]))]).tobytes()
    for x, encoding in zip(rest, whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        packed[x] = array("I", encoding.ids).tobytes()
    tails = {t: array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in _TAILS}
    for x in split:
        stem = x[:-1]
        packed[x] = (packed[stem] if stem in packed else kept[stem]) + tails[x[-1]]
    if len(kept) + len(packed) <= CACHED_PARTS:
        kept |= packed
        packed = kept
    return [kept[x] if x in kept else packed[x] for x in parts]


def token_ids(texts: pa.Array, tokenizer_path: str, specials: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin (one more than texts). Null: no ids.

    Byte-level pre-tokenizers let a lone space only begin a token, so a text can be cut before every space that stands
    between other characters; each distinct part goes through the tokenizer once. A text with white space next to white
    space, or at its ends, or with the string of an added token goes through it whole. With `specials` the strings of
    special tokens become these tokens, as is the library's default; else they are text.
    """
    texts = pc.fill_null(texts, "")
    hard = pc.match_substring_regex(texts, f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$")
    for added in _added(tokenizer_path):
        hard = pc.or_(hard, pc.match_substring(texts, added))
    # the first part of a text has no space before it; a whole text stands in for its first part
    parts = pc.split_pattern(pc.if_else(hard, "", texts), " ")
    flat, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
    offsets, codes = offsets - offsets[0], flat.indices.to_numpy().astype(np.int64)
    vocabulary, n = flat.dictionary.to_pylist(), len(flat.dictionary)
    codes[offsets[:-1]] += n
    unit = np.flatnonzero(np.bincount(codes, minlength=2 * n))
    found = _encoded([" " + vocabulary[i] if i < n else vocabulary[i - n] for i in unit], tokenizer_path)
    place = np.zeros(2 * n, np.int64)
    place[unit] = np.arange(len(unit))
    codes = place[codes]
    if whole := np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist():
        codes[offsets[whole]] = len(found) + np.arange(len(whole))
        found += [array("I", x.ids).tobytes() for x in _tokenizer(tokenizer_path, specials).encode_batch_fast(pc.take(texts, pa.array(whole)).to_pylist(), add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    lengths = sizes[codes]
    ids = np.frombuffer(b"".join(found), "<u4")[words.ranges((np.cumsum(sizes) - sizes)[codes], lengths)]
    return ids, np.concatenate(([0], np.cumsum(lengths)))[offsets]


_SEGMENT = "part int, segment long, base long, n_ids long, doc_ids array<long>, borders binary, chunks array<binary>, bits array<binary>, ranks array<binary>"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, specials: bool = False) -> None:
    """Encodes every whole text, appends end_id, and writes segments in ascending doc_id order (null first) under path.

    Part files follow each other in that order, and so do the segments of a part; base counts the ids of the part before
    a segment. Rows with equal doc_id are ordered by their text's hash; such rows with equal texts are equal. Null texts
    are empty and have the end id alone. `specials` as in token_ids().
    """
    hashed = F.coalesce(F.xxhash64("text"), F.lit(0))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hashed.alias("tie")).repartitionByRange(store.partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0
        for k, piece in enumerate(words.pieces(batches, most=TEXT_BYTES)):
            ids, borders = token_ids(piece.column("text"), tokenizer_path, specials)
            ids = np.insert(ids, borders[1:], end_id)
            borders = borders + np.arange(len(borders))
            levels = pack(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "segment": [k], "base": [base], "n_ids": [len(ids)],
                    "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), "borders": [borders.astype("<u4").tobytes()],
                    "chunks": [[x.chunks.tobytes() for x in levels]], "bits": [[x.bits.tobytes() for x in levels]], "ranks": [[x.ranks.astype("<u4").tobytes() for x in levels]],
                }
            )
            base += len(ids)

    dealt.mapInArrow(encode, _SEGMENT).write.parquet(path)


def read(segments: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers). No segments: no rows.

    Only the number of ids of each part is gathered for the starts, one row for each part file.
    """
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    # as many rows as there are part files, which the number of partitions bounds
    placed = segments.join(F.broadcast(starts), F.col("part") == F.col("of"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row].as_py() for c in ("doc_ids", "borders", "chunks", "bits", "ranks", "base", "part_start")}
                levels = [Level(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for c, b, r in zip(get["chunks"], get["bits"], get["ranks"], strict=True)]
                borders = np.frombuffer(get["borders"], "<u4").astype(np.int64)
                sums = [crc32(access(levels, int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(borders[:-1], borders[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(get["doc_ids"], pa.int64()), "start": borders[:-1] + get["base"] + get["part_start"], "n_tokens": np.diff(borders), "ids_crc32": pa.array(sums, pa.int64())})

    return placed.select("base", "part_start", "doc_ids", "borders", "chunks", "bits", "ranks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
