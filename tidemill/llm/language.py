"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled reference text answers, from any place in a text, how long the longest
match is. A text is parsed greedily into such longest matches; a phrase costs the logarithm of the reference's length,
and the language that needs the fewest bits for each byte wins. Texts are lower-cased and every run of other characters than
letters becomes one space; matches run over the borders of words. The automata are over the bytes of UTF-8 and stand in one
table of steps, so a batch's texts are parsed in all languages side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemill.llm import words

#: Characters of reference text of each language, whatever others there are, and labelled rows of it that are drawn (by hash)
#: to fill them.
REFERENCE_CHARS, REFERENCE_ROWS = 20_000, 300
#: The prediction for texts without letters.
UNDETERMINED = "und"
#: Bits of difference that change the score's odds by a factor of two.
TEMPERATURE = 16.0
#: Parses that run side by side at least; the longest few go on one by one.
LANES = 32


class Automaton:
    """The suffix automaton of some bytes: next[state][byte]; state 0 is the empty match."""

    def __init__(self, text: bytes) -> None:
        self.length = len(text)
        self.next: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for ch in text:
            new = len(self.next)
            self.next.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and ch not in self.next[at]:
                self.next[at][ch] = new
                at = link[at]
            if at >= 0:
                to = self.next[at][ch]
                if longest[to] != longest[at] + 1:
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    longest.append(longest[at] + 1)
                    link.append(link[to])
                    while at >= 0 and self.next[at].get(ch) == to:
                        self.next[at][ch] = copy
                        at = link[at]
                    link[to] = copy
                    to = copy
                link[new] = to
            last = new


class Parsers:
    """The automata of several references. steps[state * width + byte's place] is 4 * width * the next state + the phrases that
    end here; after a mismatch the next match begins with the same byte, and a byte that the reference lacks is a phrase."""

    def __init__(self, references: list[bytes]) -> None:
        used = sorted({b for text in references for b in text})
        self.place = np.zeros(256, np.uint8)
        self.place[used] = np.arange(1, len(used) + 1)
        self.width, self.bits, tables, roots, first = len(used) + 1, [], [], [], 0
        for text in references:
            automaton = Automaton(text)
            n = len(automaton.next)
            state = np.repeat(np.arange(n), [len(x) for x in automaton.next])
            byte = np.fromiter((b for x in automaton.next for b in x), np.int64, len(state))
            to = np.zeros((n, self.width), np.int32)
            to[state, self.place[byte]] = np.fromiter((t for x in automaton.next for t in x.values()), np.int64, len(state))
            again = np.tile(to[0], (n, 1))
            again[0] = 0
            ends = 1 + (again == 0).astype(np.int32)
            ends[0] = 1  # nothing was matched before
            ends[to > 0] = 0
            tables.append((np.where(to > 0, to, again) + np.int32(first)) * np.int32(self.width * 4) + ends)
            roots.append(first * self.width)
            first += n
            self.bits.append(np.log2(max(2, automaton.length)))
        self.steps, self.roots = np.concatenate(tables).ravel(), np.array(roots, np.int32)

    def phrases(self, texts: pa.Array) -> np.ndarray:
        """Phrases of each text (rows) by each reference (columns)."""
        texts = texts.cast(pa.large_binary())
        n, k = len(texts), len(self.roots)
        borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = self.place[np.frombuffer(texts.buffers()[2], np.uint8)[borders[0] : borders[-1]]] if n and borders[-1] > borders[0] else np.zeros(0, np.uint8)
        borders = borders - borders[0]
        order = np.argsort(-np.diff(borders), kind="stable")
        at, left = np.repeat(borders[:-1][order], k), np.repeat(np.diff(borders)[order], k)
        state, count = np.tile(self.roots, n), np.zeros(n * k, np.int32)
        ends = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # lanes with more bytes than t
        t = 0
        while t < len(ends) and ends[t] > LANES:
            m = ends[t]
            step = self.steps[state[:m] + data[at[:m] + t]]
            count[:m] += step & 3
            state[:m] = step >> 2
            t += 1
        steps = memoryview(self.steps)
        for i in range(int(ends[t]) if t < len(ends) else 0):
            now, phrases = int(state[i]), 0
            for b in data[at[i] + t : at[i] + left[i]].tobytes():
                step = steps[now + b]
                phrases += step & 3
                now = step >> 2
            state[i], count[i] = now, count[i] + phrases
        out = np.empty((n, k), np.int64)
        out[order] = (count + (state != np.tile(self.roots, n))).reshape(n, k)
        return out


def plain(texts: pa.Array) -> pa.Array:
    """Lower-cased letters, with one space for every run of others, at both ends too; empty if there are no letters."""
    text = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " "), " ")
    return pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, " ", ""))


def reference(labelled: DataFrame, chars: int = REFERENCE_CHARS, rows: int = REFERENCE_ROWS) -> dict[str, str]:
    """For each non-null lang, the plain() letters of whole texts that together have `chars` characters at most.

    They come from up to `rows` texts, drawn by the hash of doc_id: in that order each that fits into what is left is taken;
    where none fits, the shortest is. The bound holds whatever the table's size. Languages without letters in their texts
    are left out.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text", F.length("text").alias("size")).where("size > 0")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "size")
    drawn = labelled.select("doc_id", "lang", "size").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= rows).orderBy("lang", "nth").collect()
    taken, left = [], {r.lang: chars for r in drawn}
    for r in drawn:
        if r.size <= left[r.lang]:
            left[r.lang] -= r.size
            taken.append(r)
    some = {r.lang for r in taken}
    taken += [min((r for r in drawn if r.lang == lang), key=lambda r: (r.size, r.nth)) for lang in left if lang not in some]
    if not taken:
        return {}
    chosen = labelled.sparkSession.createDataFrame([(r.doc_id, r.lang, r.size, r.nth) for r in taken], StructType([labelled.schema["doc_id"], labelled.schema["lang"], labelled.schema["size"], StructField("nth", labelled.schema["size"].dataType)]))
    chosen = chosen.select(F.col("doc_id").alias("of"), F.col("lang").alias("in_lang"), F.col("size").alias("of_size"), "nth")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("lang") == F.col("in_lang")) & (F.col("size") == F.col("of_size"))
    texts = labelled.join(F.broadcast(chosen), same).groupBy("in_lang", "nth").agg(F.min("text").alias("text")).orderBy("in_lang", "nth").collect()  # at most `rows` for each
    found: dict[str, list[str]] = {}
    for lang, text in zip([r.in_lang for r in texts], plain(pa.array([r.text for r in texts], pa.string())).to_pylist(), strict=True):
        if text:
            found.setdefault(lang, []).append(text.strip())
    return {lang: f" {' '.join(parts)} " for lang, parts in sorted(found.items())}


_built: dict[tuple[str, ...], Parsers] = {}


def _parsers(texts: tuple[str, ...]) -> Parsers:
    """This task's automata of the texts."""
    if texts not in _built:
        _built.clear()
        _built[texts] = Parsers([t.encode() for t in texts])
    return _built[texts]


def identify(docs: DataFrame, references: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits_per_char (of the best language, for each byte; null if undetermined) and the
    columns named in keep, for each row of docs.

    A null text, or one without letters, is `und` with score 0. On ties the first language by code point wins. The score
    is the best language's share if all languages' bits are taken as likelihoods, tempered. Without any reference every
    text is `und`. Equal texts get equal results; other columns are not read.
    """
    langs, texts = list(references), tuple(references.values())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            n, text = piece.num_rows, plain(piece.column("text"))
            lang, score, rate = np.full(n, UNDETERMINED, object), np.zeros(n), np.full(n, np.nan)
            if langs:
                parsers = _parsers(texts)
                bits, size = parsers.phrases(text) * parsers.bits, pc.binary_length(text).to_numpy(zero_copy_only=False)
                best, some = bits.argmin(1), size > 0
                lang[some] = np.array(langs, object)[best[some]]
                least = bits[np.arange(n), best]
                score[some] = 1 / np.exp2(-(bits - least[:, None])[some] / TEMPERATURE).sum(1)
                rate[some] = least[some] / size[some]
            columns = [piece.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], ["doc_id", *keep, "lang_pred", "score", "bits_per_char"])
        _built.clear()  # the worker lives on for other stages
        words.release()

    source = docs.select("doc_id", *keep, *[c for c in ("text",) if c not in keep])
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_char", DoubleType())]
    return source.mapInArrow(predict, StructType([*[docs.schema[c] for c in ("doc_id", *keep)], *added]))


def predict(docs: DataFrame, learn: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """identify(), with references from the rows of docs where `learn` holds."""
    return identify(docs, reference(docs.where(learn)), keep)
