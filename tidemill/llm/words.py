"""Words of whole texts, for Arrow batches in tasks. A word is a run of bytes other than space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

import contextlib
import ctypes

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once in a task, in bytes; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
#: The same words as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


class Words(NamedTuple):
    """codes: a vocabulary index for each word of all texts, in order; text i has codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batches, of about `most` bytes of text each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def release() -> None:
    """Gives memory that is free back to the system: the task's worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; none for null. lower: A-Z become a-z first."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy().astype(np.int32), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # white space at the ends of a text
        full = codes != empty
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        codes = codes[full]
    return Words(codes, offsets, coded.dictionary)


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry, the same in every process."""
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
