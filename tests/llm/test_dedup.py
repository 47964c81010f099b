import random
import re
from collections import Counter
from itertools import combinations

import pytest

from tidemill.llm import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, n):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs of distinct sets; a set is named by its least doc_id."""
    sets = [frozenset(shingles(t, n)) for _, t in rows]
    name = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and s:
            name[s] = min(i, name.get(s, i))
    up = {i: i for i in name.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(name, 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = sorted((root(name[a]), root(name[b])))
            up[y] = x
    of = [root(name[s]) if i is not None and s else i for (i, _), s in zip(rows, sets, strict=True)]
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, of, strict=True)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("shingle", [2, 5])
def test_against_all_pairs(spark, sf_dir, shingle):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(dedup.near_duplicates(docs, shingle)) == brute(rows, shingle, 80)


def test_chains_and_large_groups(spark):
    """A large group of near copies whose pairs are partly below the threshold: links run through other members."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows, text = [], base
    for i in range(160):
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(60)] = f"n{i}"
        changed = list(text)
        changed[rng.randrange(60)] = f"m{i}"
        rows.append((1000 - i, " ".join(changed)))
    rows += [(i, " ".join(f"u{rng.randrange(300)}" for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup.near_duplicates(docs, 2)) == brute(rows, 2, 80)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = dedup.near_duplicates(odd, 2)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(found) == brute(rows, 2, 80)
    assert dedup.near_duplicates(empty, 2).count() == 0


def test_least_matches_keeps_what_belongs():
    """A pair at the threshold is pruned with a small probability only, a pair far below it at once."""
    import numpy as np

    rng, least = np.random.default_rng(1), dedup.least_matches(0.8)
    a = rng.integers(0, 1 << 16, (20_000, dedup.HASHES)).astype(np.uint16)
    for s, low, high in ((0.8, 0.999, 1.0), (0.2, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < s, a, a ^ 1)
        assert low <= len(dedup.trial(a, b, least)[0]) / len(a) <= high


def test_repeated_ids_are_no_links(spark):
    """Each row of a doc_id has its own set; what is near one of its texts is found whichever text that is."""
    words = [f"w{i}" for i in range(40)]
    a, near_b = " ".join(words), " ".join([*[f"v{i}" for i in range(40)], "more"])
    b = " ".join(f"v{i}" for i in range(40))
    for ids in ((1, 2), (2, 1)):
        rows = [(ids[0], a), (ids[0], b), (ids[1], near_b), (9, a), (None, b), (None, b)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {(r.doc_id, r.n_shingles): r.component_id for r in dedup.near_duplicates(docs, 2).where("doc_id is not null").collect()}
        assert found == {(ids[0], 39): found[ids[0], 39], (ids[1], 40): 1, (9, 39): ids[0]}
        kept = sorted((str(r.doc_id), r.text) for r in dedup.one_of_each(docs, 2).collect())
        assert kept == sorted([(str(ids[0]), a), ("1", b if ids[0] == 1 else near_b), ("None", b), ("None", b)])


def test_one_of_each_keeps_one_row_of_a_component(spark, odd, empty):
    left = dedup.one_of_each(odd, 2)
    assert left.columns == odd.columns
    of = Counter()
    for i, s in {(r.doc_id, frozenset(shingles(r.text, 2))) for r in left.collect() if r.doc_id is not None and shingles(r.text, 2)}:
        of[s] += 1
    assert max(of.values()) == 1
    want = {frozenset(shingles(r.text, 2)) for r in odd.collect()}
    assert {frozenset(shingles(r.text, 2)) for r in left.collect()} == want  # here near texts are equal sets
    twice = odd.union(odd)
    assert left.where("doc_id is not null and length(text) > 20").count() == dedup.one_of_each(twice, 2).where("doc_id is not null and length(text) > 20").count()
    assert dedup.one_of_each(empty, 2).count() == 0


def test_large_buckets_meet_in_blocks(spark, sf_dir, monkeypatch):
    """Blocks of a few members give what one task gives."""
    monkeypatch.setattr(dedup, "BLOCK", 5)
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(dedup, "SMALL", 2)
    rng = random.Random(6)
    rows, text = [], [f"w{rng.randrange(5000)}" for _ in range(60)]
    for i in range(90):
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(60)] = f"n{i}"
        changed = list(text)
        for _ in range(i % 4):
            changed[rng.randrange(60)] = f"m{i}"
        rows.append((1000 - i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup.near_duplicates(docs, 2)) == brute(rows, 2, 80)
