import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import fold
from tests.llm.test_dedup import WORD, lowered
from tidemill.llm import katz, queries

END, START = ("end",), ("start",)


def tokens(text):
    return [*WORD.findall(lowered(text or "")), END]


class Model:
    """Katz's model in dictionaries, straight from the formulas."""

    def __init__(self, texts):
        self.uni, self.bi, self.after = Counter(), Counter(), defaultdict(set)
        for t in map(tokens, texts):
            for h, w in zip([START, *t], t, strict=False):
                self.uni[w] += 1
                self.bi[h, w] += 1
                self.after[h].add(w)
        self.n = sum(self.uni.values())
        self.hist = Counter()
        for (h, _), c in self.bi.items():
            self.hist[h] += c
        k = katz.MOST_DISCOUNTED
        of = lambda counts: katz.discounts([0, *[sum(c == r for c in counts.values()) for r in range(1, k + 2)]])
        self.d1, self.d2, self.k = of(self.uni), of(self.bi), k
        self.unknown = 1 - sum(self.p1(w) for w in self.uni)

    def p1(self, w):
        c = self.uni[w]
        return (self.d1[c - 1] if c <= self.k else 1) * c / (self.n + 1) if c else self.unknown

    def p2(self, h, w):
        c = self.bi[h, w]
        return (self.d2[c - 1] if c <= self.k else 1) * c / (self.hist[h] + 1)

    def alpha(self, h):
        if h not in self.after:
            return 1.0
        return (1 - sum(self.p2(h, w) for w in self.after[h])) / (1 - sum(self.p1(w) for w in self.after[h]))

    def p(self, h, w):
        return self.p2(h, w) if self.bi[h, w] else self.alpha(h) * self.p1(w)


def brute(rows, train):
    m = Model([t for (_, t), ok in zip(rows, train, strict=True) if ok])
    alphas = {}
    for (i, text), ok in zip(rows, train, strict=True):
        t = tokens(text)
        base = sum(math.log10((m.uni[w] + 1) / (m.n + len(m.uni) + 1)) for w in t)
        score = 0.0
        for h, w in zip([START, *t], t, strict=False):
            if m.bi[h, w]:
                score += math.log10(m.p2(h, w))
            else:
                if h not in alphas:
                    alphas[h] = m.alpha(h)
                score += math.log10(alphas[h] * m.p1(w))
        yield i, not ok, len(t), sum(m.uni[w] > 0 for w in t), m.n, base, score


def test_query_against_the_formulas(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    want = sorted(brute(rows, [fold(i, 7) != 2 for i, _ in rows]))
    found = sorted(tuple(r) for r in queries.op9_katz(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    assert [x[:5] for x in found] == [x[:5] for x in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-7)
    held = [x for x in found if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)  # better than the base model on unseen texts


def test_pieces_do_not_depend_on_the_batches(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(40 + i % 50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 6_000)
    try:
        found = sorted(tuple(r) for r in katz.score(docs, F.col("doc_id") % 4 != 1).select("doc_id", (~F.col("train")).alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    for a, b in zip(found, sorted(brute(rows, [i % 4 != 1 for i, _ in rows])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-7)


def test_sums_to_one(spark, sf_dir):
    texts = [r.text for r in queries.documents(spark, sf_dir).limit(60).collect()]
    m = Model(texts)
    for h in [START, *list(m.uni)[:40], "a word that training lacks"]:
        assert sum(m.p(h, w) for w in m.uni) + (m.alpha(h) * m.unknown) == pytest.approx(1.0)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = katz.score(odd, (F.col("doc_id") % 4 != 1)).select("doc_id", (~F.col("train")).alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = list(brute(rows, [i is not None and i % 4 != 1 for i, _ in rows]))
    key = lambda x: (str(x[0]), x[2], round(x[6], 6))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-7)
    assert katz.score(empty, F.lit(True)).count() == 0
    assert {r.score for r in katz.score(odd, F.lit(False)).collect()} == {0.0}
