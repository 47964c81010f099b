"""Fill-in-middle documents from an index of distinct texts.

The index has a row for each distinct text with the byte offsets of its code points as an Elias-Fano list: high parts in
unary in a bitmap, low bits packed, and the place of every SAMPLE-th one. A document selects its two cuts in the list,
which reads a few hundred bytes of it, and slices the text's bytes there.

A text whose hash no other row has is alone; its list is made where the row is read, and the text isn't shuffled. Rows
whose hash falls into a bucket with a repeated hash go to the index: Spark groups them by hash and text, comparing the
texts themselves, and joins the lists back by hash and text. Buckets are BUCKETS at most, so their broadcast has a fixed
bound; where repeats fill them all, every text takes the second way, with the same result. The join has one row for a text
on the index's side and needs no partitioning afterwards, so Spark's adaptive execution can split a text with a third of
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm import store, words

#: Ones of the bitmap between two sampled places.
SAMPLE = 512
#: Buckets of hashes; those with a repeated hash are broadcast.
BUCKETS = 1 << 20
#: Bytes of a text that are scanned at once.
BLOCK = 1 << 20
# Marks and shares of the forms, in per cent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SPM = 90, 20

_LIST = "n long, low_bits int, high binary, low binary, places binary"


class Boundaries(NamedTuple):
    """The n + 1 byte offsets where a text's code points start, its end included: offset i is the i-th one's place in
    `high` less i, followed by `low_bits` bits of `low`. places: of every SAMPLE-th one, as 64-bit integers."""

    n: int
    low_bits: int
    high: bytes
    low: bytes
    places: bytes


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits (little-endian in bytes) at these places, which lie close together."""
    if len(at):
        start = int(at.min()) >> 3
        flags = np.zeros(int(at.max()) + 1 - 8 * start, bool)
        flags[at - 8 * start] = True
        packed = np.packbits(flags, bitorder="little")
        bits[start : start + len(packed)] |= packed


def boundaries(text: bytes) -> Boundaries:
    """The list of a UTF-8 text; an empty text has the offset 0 alone."""
    raw = np.frombuffer(text, np.uint8)
    blocks = range(0, len(raw) + 1, BLOCK)
    starts = lambda b: np.flatnonzero((raw[b : b + BLOCK] & 0xC0) != 0x80)
    n = sum(len(starts(b)) for b in blocks)
    low_bits = max(0, (len(raw) // (n + 1)).bit_length() - 1)
    high, low = np.zeros(((len(raw) >> low_bits) + n + 8) >> 3, np.uint8), np.zeros(((n + 1) * low_bits + 7) >> 3, np.uint8)
    done, places = 0, []
    for b in blocks:
        offsets = starts(b) + b
        if b == blocks[-1]:
            offsets = np.append(offsets, len(raw))
        i = np.arange(done, done + len(offsets))
        ones = (offsets >> low_bits) + i
        _set(high, ones)
        for k in range(low_bits):
            _set(low, i[(offsets >> k) & 1 == 1] * low_bits + k)
        places.append(ones[-done % SAMPLE :: SAMPLE])
        done += len(offsets)
    return Boundaries(n, low_bits, high.tobytes(), low.tobytes(), np.concatenate(places).astype("<i8").tobytes())


def select(found: Boundaries, i: int) -> int:
    """The byte offset of code point i, 0 <= i <= n. Reads from the sampled place before it to the next one."""
    k = i // SAMPLE
    at = int.from_bytes(found.places[8 * k : 8 * k + 8], "little")
    end = int.from_bytes(found.places[8 * k + 8 : 8 * k + 16], "little") or 8 * len(found.high)
    first = at >> 3
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(found.high[first : (end >> 3) + 1], np.uint8), bitorder="little"))
    place = 8 * first + int(ones[np.searchsorted(ones, at - 8 * first) + i - k * SAMPLE])
    bits = range(i * found.low_bits, (i + 1) * found.low_bits)
    return ((place - i) << found.low_bits) | sum((found.low[b >> 3] >> (b & 7) & 1) << j for j, b in enumerate(bits))


def _hash() -> Column:
    return F.xxhash64("text")


def index(texts: DataFrame) -> DataFrame:
    """(hash, text, n, low_bits, high, low, places): a row for each distinct `text`, null as empty. Texts with equal
    hashes are compared and keep rows of their own if they differ."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            made = [boundaries(t) for t in piece.column("text").cast(pa.binary()).to_pylist()]
            columns = {f: pa.array([getattr(b, f) for b in made], kind) for f, kind in zip(Boundaries._fields, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)}
            yield pa.RecordBatch.from_pydict({"hash": piece.column("hash"), "text": piece.column("text")} | columns)

    whole = texts.select(F.coalesce("text", F.lit("")).alias("text")).select(_hash().alias("hash"), "text")
    return whole.distinct().mapInArrow(lists, f"hash long, text string, {_LIST}")


def _indexed(docs: DataFrame) -> DataFrame:
    """docs (with text, not null) and the columns of their lists, null where the text is alone."""
    bucket = F.pmod(_hash(), F.lit(BUCKETS))
    repeated = docs.select(_hash().alias("hash")).groupBy("hash").count().where("count > 1")
    full = F.broadcast(store.table(repeated.select(F.pmod("hash", F.lit(BUCKETS)).alias("bucket")).distinct(), "fim-buckets"))
    alone = docs.join(full, bucket == full["bucket"], "left_anti")
    shared = docs.join(full, bucket == full["bucket"], "left_semi")
    lists = index(shared)
    joined = shared.alias("d").join(lists.alias("i"), (_hash_of("d") == F.col("i.hash")) & (F.col("d.text") == F.col("i.text")))
    fields = [f.strip().split() for f in _LIST.split(",")]
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in fields]
    return alone.select("*", *missing).unionByName(joined.select("d.*", *[f"i.{name}" for name, _ in fields]))


def _hash_of(alias: str) -> Column:
    return F.xxhash64(f"{alias}.text")


def transform(docs: DataFrame, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the columns of `keep`, doc_id, n (code points), form, prefix_chars, middle_chars and
    output, the text with its parts in the form's order.

    The cuts and the form depend on seed and doc_id alone, through the first four 32-bit numbers of a sha256: rows of one
    doc_id are cut by the same numbers, equal texts of different ids each by their own. A null doc_id counts as empty text,
    a null text as empty. Empty texts and texts that hold a mark are plain, and plain rows have no prefix_chars and
    middle_chars. Columns named in `keep` pass untouched and must have other names than the results. No rows give no rows.
    """
    own = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    if clash := set(own) & set(keep):
        raise ValueError(f"these names are the operator's own: {sorted(clash)}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in keep]).alias("__row"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            lists = zip(*[piece.column(f).to_pylist() for f in Boundaries._fields], strict=True)
            made = []
            for doc_id, text, stored in zip(piece.column("doc_id").to_pylist(), texts, lists, strict=True):
                found = boundaries(text) if stored[0] is None else Boundaries(*stored)
                digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
                h1, h2, h3, h4 = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
                if not text or h3 % 100 >= TRANSFORMED or any(m in text for m in marks):
                    made.append((found.n, "plain", None, None, text))
                    continue
                a, b = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
                i, j = select(found, a), select(found, b)
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                if h4 % 100 < SPM:
                    made.append((found.n, "spm", a, b - a, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))))
                else:
                    made.append((found.n, "psm", a, b - a, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))))
            n, form, prefix_chars, middle_chars, output = zip(*made, strict=True) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [piece.column("__row"), piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                ["__row", *own],
            )

    schema = StructType([rows.schema["__row"], rows.schema["doc_id"], *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])
    made = _indexed(rows).mapInArrow(cut, schema)
    return made.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], *own)


def restored(output: Column, form: Column) -> Column:
    """The text from which transform() made an output of this form. A mark can't arise inside a text that holds none, nor
    across its parts, so the first one found is the one that was set."""
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    at = F.instr(output, second)
    end = F.instr(output, F.lit(MIDDLE))
    one, other = F.substr(output, F.length(first) + 1, at - F.length(first) - 1), F.substr(output, at + F.length(second), end - at - F.length(second))
    middle = F.substr(output, end + F.lit(len(MIDDLE)))
    return F.when(form == "plain", output).when(form == "spm", F.concat(other, middle, one)).otherwise(F.concat(one, middle, other))
