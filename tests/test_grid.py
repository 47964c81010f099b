"""Queries and rows that meet in blocks, against plain loops over all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.operators import evaluate, grid, retrieval


def cosine(a, b):
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return 0.0
    dot = lambda x, y: sum((i * j for i, j in zip(x, y, strict=True)), 0.0)
    norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / norm if norm > 0 else 0.0


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in {"QUERIES": 2, "NUMBERS": 12, "PAIRS": 10, "TOKENS": 20, "DOCUMENTS": 3}.items():
        monkeypatch.setattr(grid, name, n)


@pytest.mark.parametrize("group", [None, "label"])
def test_nearest_in_blocks(spark, small_blocks, group):
    vectors = [(i, [float((i * 7 + d * d * (i % 5)) % 11 - 5) for d in range(3)], i % 3 or None) for i in range(40)]
    vectors += [(i, [1.0, 2.0, 3.0], 1) for i in range(40, 60)] + [(60, None, 1), (61, [1.0, None, 2.0], 2), (62, [0.0] * 3, None), (63, [1.0, 2.0], 1)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    asked = [v for v in vectors if v[0] % 7 == 0 or v[0] > 58]
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked], "q long, qv array<double>")
    found = retrieval.nearest(rows, queries, 4, group)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan  # pairs are no rows
    expected = set()
    for q, qv, _ in asked:
        near = sorted((1 - cosine(v, qv), i, label) for i, v, label in vectors)
        for label in {x[2] for x in near} if group else [0]:
            mine = [x for x in near if not group or x[2] == label][:4]
            expected |= {(q, i, own, n + 1, dist) for n, (dist, i, own) in enumerate(mine)}
    assert {(r.q, r.vec_id, r.label, r.rank, r.dist) for r in found.collect()} == expected


def test_best_by_terms_in_blocks(spark, small_blocks):
    docs = [(i % 9, [f"w{(i * 5 + j * j) % 13}" for j in range(i % 6 + 1)]) for i in range(30)] + [(20, ["w1", "w2"]), (21, ["w1", "w2"]), (22, ["w1", "w2"])]
    weights = {f"w{i}": 0.1 + i % 4 for i in range(13)}
    asked = {q: [f"w{(q * 3 + j) % 15}" for j in range(4)] + ["w1"] * (q % 3) for q in range(5)}
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    w = spark.createDataFrame([(t, 1, x) for t, x in weights.items()], "term string, df int, idf double")
    a = spark.createDataFrame(list(asked.items()), "q long, terms array<string>")
    wanted = spark.createDataFrame([(0, 20), (3, 8)], "q long, doc_id long")
    size = sum(len(t) for _, t in docs)
    found = retrieval.best_by_terms(d, w, a, 5.0, (12, size), 3, wanted=wanted).cache()
    best = {(r.q, r.doc_id): r.rank for r in retrieval.top_k(found.where("NOT wanted"), 3, by="by").collect()}
    texts: dict[int, list[str]] = {}
    for i, t in docs:
        texts[i] = texts.get(i, []) + t
    score = lambda q, i: sum(weights.get(t, 0.0) * texts[i].count(t) * 2.5 / (texts[i].count(t) + 1.5 * (0.25 + 0.75 * len(texts[i]) / 5.0)) for t in asked[q])
    expected = {}
    for q in asked:
        order = sorted((-round(score(q, i), 9), i) for i in texts if score(q, i) > 0)[:3]
        expected |= {(q, i): n + 1 for n, (_, i) in enumerate(order)}
    assert best == expected
    assert {(r.q, r.doc_id): pytest.approx(r.score) for r in found.where("wanted").collect()} == {(q, i): score(q, i) for q, i in [(0, 20), (3, 8)]}


def test_a_question_without_relevant_items_counts(spark):
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "q long, rank int, good boolean")
    hits = evaluate.first_relevant(ranked, spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q long, stratum string"), F.col("good"))
    assert {(r.q, r.stratum, r.rank) for r in hits.collect()} == {(1, "a", 1), (2, "a", None), (3, "b", None)}
