"""Joins by likeness: texts by their matching blocks, titles by prefix and by shared words, names and keywords in titles.

Each finds its pairs by an equality (a cell of lengths, a prefix, a rare word, a run of letters) that no wanted pair can
miss, and then tests them exactly.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.sources.stored import stored


class Subsequences:
    """Items side by side as the bits of one number, with a free bit behind each, so that a text's longest common subsequences with
    all of them take one pass over its characters."""

    def __init__(self, items: list[str]) -> None:
        self.lengths = np.array([len(x) for x in items])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        codes = np.frombuffer("\0".join([*items, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n_bytes = len(codes) // 8 + 1
        used = np.ones(len(codes), bool)
        used[self.starts + self.lengths] = False
        self.full = self._number(used)
        order = np.argsort(codes, kind="stable")
        order = order[used[order]]
        self.masks = {}
        for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
            bits = np.zeros(len(codes), bool)
            bits[at] = True
            self.masks[chr(codes[at[0]])] = self._number(bits)

    @staticmethod
    def _number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def lengths_with(self, text: str) -> np.ndarray:
        """Length of the text's longest common subsequence with each item, which no sum of matching blocks exceeds."""
        row, full, masks = self.full, self.full, self.masks
        for ch in text:
            if mask := masks.get(ch):
                hit = row & mask
                row = ((row + hit) | (row ^ hit)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(self.n_bytes, "little"), np.uint8), bitorder="little")
        return self.lengths - np.add.reduceat(bits, self.starts, dtype=np.int64)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two texts."""
    return int(Subsequences([b]).lengths_with(a)[0])


#: Texts, and items, of a block; every block of texts meets each of items of its cell.
TEXTS, ITEMS = 32_768, 4_096


def alike(texts: DataFrame, items: DataFrame, least: float = 0.72) -> DataFrame:
    """(text, item, ratio): each distinct text with each distinct item whose ratio of matching blocks is `least` or more.

    texts: (text), items: (item). Lengths of such a pair differ by less than a cell of a geometric scale, so blocks of texts meet
    blocks of items of their cell and its two neighbours; the longest common subsequences bound the ratio from above, and only
    what is left is matched block by block. Two empty texts are alike; null ones are left out.
    """
    step = math.log((2 - least) / least)
    cell = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / step).cast("int")
    a = stored(texts.where("text IS NOT NULL").select("text").distinct(), "texts")
    b = stored(items.where("item IS NOT NULL").select("item").distinct(), "items")
    n_texts, n_items = (max(1, -(-d.count() // size)) for d, size in ((a, TEXTS), (b, ITEMS)))
    n_texts = max(n_texts, texts.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = cell(F.col("item"))
    b = b.select("item", dealt("item", n_items).alias("nth"), F.explode(F.array(own - 1, own, own + 1)).alias("cell"))
    held = b.select("cell").distinct()  # a few lengths
    a = a.select("text", cell(F.col("text")).alias("cell"), dealt("text", n_texts).alias("block")).join(F.broadcast(held), "cell", "left_semi")
    a, b = a.select("*", every(n_items).alias("nth")), b.select("*", every(n_texts).alias("block"))

    def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            names = sorted(right["item"])
            all_items = Subsequences(names)
            for text in sorted(left["text"]):
                total = least * (len(text) + all_items.lengths)
                if not (2 * np.minimum(len(text), all_items.lengths) >= total).any():
                    continue
                for i in np.flatnonzero(2 * all_items.lengths_with(text) >= total):
                    ratio = difflib.SequenceMatcher(None, text, names[i]).ratio()
                    if ratio >= least:
                        found.append((text, names[i], ratio))
        return pd.DataFrame(found, columns=["text", "item", "ratio"])

    key = ["cell", "block", "nth"]
    n = n_texts * n_items
    return a.repartition(n, *key).groupBy(*key).cogroup(b.repartition(n, *key).groupBy(*key)).applyInPandas(matched, "text string, item string, ratio double")


def known_titles(titles: DataFrame, known: DataFrame, least: int = 30) -> DataFrame:
    """(key, known): whether each distinct key equals a known key, or one of them begins with the other and both have `least`
    characters or more. Both: (key). Empty and null keys are known by nothing.

    Keys are cut to the lengths that the other side's keys have, and joined by equality in both directions, so titles that
    share their beginning are never paired with each other. The distinct lengths travel as one row.
    """
    a, b = (d.where("key <> ''").select("key").distinct() for d in (titles, known))

    def begun(long: DataFrame, short: DataFrame) -> DataFrame:
        """(key, start): keys of `long` with their beginnings that have the length of a key of `short`."""
        lengths = short.where(F.length("key") >= least).agg(F.collect_set(F.length("key")).alias("lengths"))
        rows = long.where(F.length("key") > least).join(F.broadcast(lengths))  # one row
        return rows.select("key", F.explode(F.filter("lengths", lambda n: n < F.length("key"))).alias("n")).select("key", F.expr("left(key, n)").alias("start"))

    same = a.join(b, "key", "left_semi")
    longer = begun(a, b).join(b.select(F.col("key").alias("start")), "start", "left_semi").select("key")
    shorter = begun(b, a).select("start").distinct().withColumnRenamed("start", "key").join(a, "key", "left_semi")
    found = same.unionByName(longer).unionByName(shorter).distinct().withColumn("known", F.lit(True))
    return a.join(found, "key", "left").select("key", F.coalesce("known", F.lit(False)).alias("known"))


def best_titles(asked: DataFrame, titles: DataFrame, least: float = 0.6, least_words: int = 2) -> DataFrame:
    """(q, id, score): for each question the title that shares the largest part of its words or of the question's, if that is
    `least` or more; the first id of equals. asked: (q, words), titles: (id, words); words are distinct.

    Titles with the same words count as their first. A pair at `least` shares one of the question's rarest words or one of
    the title's: of n words at least ceil(least * n) are shared, so n + 1 - ceil(least * n) of them, the rarest, can't all be
    missing. Only those are joined, with all words of the other side. Questions with fewer than `least_words` find nothing.
    """
    t = titles.where(F.size("words") > 0).select("id", F.array_sort("words").alias("words")).groupBy("words").agg(F.min("id").alias("id"))
    t = stored(t, "titles")
    a = stored(asked.where(F.size("words") >= least_words).select("q", "words"), "asked")
    counts = t.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        words = rows.select(key, F.size("words").alias("size"), F.explode("words").alias("word")).join(counts, "word", "left")
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "word"))
        return words.withColumn("place", place).where(F.col("place") <= F.col("size") + 1 - F.ceil(F.col("size") * least - 1e-9)).select(key, "word")

    each = lambda rows, key: rows.select(key, F.explode("words").alias("word"))
    pairs = rarest(a, "q").join(each(t, "id"), "word").select("q", "id").unionByName(each(a, "q").join(rarest(t, "id"), "word").select("q", "id")).distinct()
    shared = F.size(F.array_intersect("a.words", "t.words"))
    score = F.greatest(shared / F.size("a.words"), shared / F.size("t.words"))
    scored = pairs.join(a.alias("a"), "q").join(t.alias("t"), "id").select("q", "id", score.alias("score")).where(F.col("score") >= least)
    return scored.groupBy("q").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


def named_titles(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, id): the title that holds a name, in its own case and not inside a longer word: the only one that begins with the
    name and a colon, else the only one at all; null if it is none or not one. names: (name), titles: (id, title).

    A name's first run of letters and digits is a run of the title too, which joins them; the name itself is tested then.
    """
    run = lambda c: F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    asked = names.select("name").distinct().withColumn("run", F.get(run(F.col("name")), F.lit(0)))
    rows = titles.select("id", "title", F.explode(F.array_distinct(run(F.coalesce("title", F.lit(""))))).alias("run"))
    holds = F.regexp("title", F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.col("name"), F.lit(r"\E(?![A-Za-z0-9])")))
    hits = rows.join(asked, "run").where(holds)
    leads = F.startswith("title", F.concat("name", F.lit(":")))
    agg = hits.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.count_if(leads).alias("n_leads"), F.min(F.when(leads, F.col("id"))).alias("lead"))
    found = agg.select(F.col("name").alias("of"), F.when(F.col("n_leads") == 1, F.col("lead")).when(F.col("n") == 1, F.col("id")).alias("id"))
    return asked.select("name").join(found, F.col("name") == F.col("of"), "left").select("name", "id")


#: Keywords that one automaton holds; more make several passes over the texts.
KEYWORDS = 200_000


def _named(texts: DataFrame, keywords: DataFrame, key: str, c: str, name: str) -> DataFrame:
    """(key, name): the distinct names of keywords (keyword, names) that stand anywhere in a text, from each row of texts once for
    each block of keywords. An automaton of up to KEYWORDS of them goes to all tasks, so a text is read once for all of these."""
    spark = texts.sparkSession
    rows = stored(keywords, "keywords")
    blocks = max(1, -(-rows.count() // KEYWORDS))
    kind, of = texts.schema[key].dataType.simpleString(), keywords.schema["names"].dataType.elementType
    parts = []
    for block in range(blocks):
        held = [(r.keyword, tuple(r.names)) for r in rows.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block).toLocalIterator()]
        shared = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word, names in shared.value:
                automaton.add_word(word, (word, names))
            if shared.value:
                automaton.make_automaton()
            for batch in batches:
                ids, found = [], []
                for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = dict(x for _, x in automaton.iter(body or "")) if shared.value else {}
                    names = set().union(*hits.values())
                    ids.extend([i] * len(names))
                    found.extend(names)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, to_arrow_type(of))], [key, name])

        parts.append(texts.select(key, c).mapInArrow(search, f"`{key}` {kind}, `{name}` {of.simpleString()}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str = "id", c: str = "text") -> DataFrame:
    """(key, keyword): the distinct keywords that stand anywhere in a text. keywords: (keyword); empty and null ones are in
    nothing."""
    return _named(texts, keywords.where("keyword <> ''").select("keyword").distinct().withColumn("names", F.array("keyword")), key, c, "keyword")


def keyword_supplement(asked: DataFrame, texts: DataFrame, present: DataFrame, most: int = 5, key: str = "id") -> DataFrame:
    """(q, key, nth): for each question the first `most` texts, by key, that hold one of its keywords and are not present yet.
    asked: (q, keywords); texts: (key, text); present: (q, key)."""
    words = asked.select("q", F.explode("keywords").alias("keyword")).where("keyword <> ''").groupBy("keyword").agg(F.collect_set("q").alias("names"))
    # a text names its questions where it is read: its keywords times their questions are no rows
    new = _named(texts, words, key, "text", "q").join(present.select("q", key), ["q", key], "left_anti")
    return new.withColumn("nth", F.dense_rank().over(Window.partitionBy("q").orderBy(key))).where(F.col("nth") <= most).distinct()
