"""Mixing, quality, language, HTML, top-k, toxicity and the pipeline against brute force, labels and planted cases."""

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import fold
from tests.llm.test_dedup import WORD, brute
from tidemill.llm import html, language, mixing, quality, queries, topk, toxicity


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cur = duck.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*order).collect())) == sorted(cur.fetchall())


def test_mixing_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(t) == round(target) for (_, target), t in taken.items())
    mixed = mixing.sample(odd)
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def base(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(spark, sf_dir, odd, empty):
    for docs in (queries.documents(spark, sf_dir), odd):
        want = sorted((str(r.doc_id), *base(r.text)) for r in docs.collect())
        found = quality.judge(docs).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    assert quality.judge(empty).count() == 0


def test_mcd_finds_outliers():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (1500, 5)), rng.normal(9, 0.5, (300, 5))))
    mean, cov = quality.mcd(np.ones(len(x)), x, x[:, :, None] * x[:, None, :], floor=(1e-3,) * 5)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    bad = d > quality.chi2(5, 1e-5)
    assert bad[1500:].all() and bad[:1500].mean() < 0.01


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(5)
    for _ in range(200):
        reference, text = ("".join(rng.choice(list("abc "), n)) for n in (60, 25))
        count, at = 0, 0
        while at < len(text):
            size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in reference), 1)
            count, at = count + 1, at + size
        assert language.Parsers([b"xyz", reference.encode()]).phrases(pa.array([text, "b", text]))[:, 1].tolist() == [count, 1 if "b" in reference else 1, count]


def test_long_and_many_texts_are_parsed_alike():
    rng = np.random.default_rng(6)
    parsers = language.Parsers([b" one two three ", " déjà vu one ".encode()])
    texts = ["".join(rng.choice(list("one twodré "), n)) for n in rng.integers(0, 90, 200)]
    together = parsers.phrases(pa.array(texts))
    assert (together == np.concatenate([parsers.phrases(pa.array([t])) for t in texts])).all()
    assert (parsers.phrases(pa.array(texts).slice(7, 50)) == together[7:57]).all()


def test_texts_without_letters_are_undetermined(spark):
    rows = [(0, "½ ² ③"), (1, "12 + 3_4"), (2, "½ cup"), (3, None), (4, "ÉÀ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `my-col` int")
    found = {r.doc_id: (r.lang_pred, r.score, r["my-col"]) for r in language.identify(docs, {"xx": " cup "}, ("my-col",)).collect()}
    assert found == {0: ("und", 0.0, 1), 1: ("und", 0.0, 1), 2: ("xx", 1.0, 1), 3: ("und", 0.0, 1), 4: ("xx", 1.0, 1)}


def test_references_are_whole_texts(spark):
    docs = spark.createDataFrame([(i, f"abc {'x' * (10 * i)}", "l1") for i in range(1, 9)] + [(20, "Ä long one " * 50, "l2"), (21, "1 2", "l3"), (22, None, "l1")], "doc_id long, text string, lang string")
    found = language.reference(docs, chars=100, rows=5)
    assert set(found) == {"l1", "l2"} and found["l2"].count("ä long one") == 50
    assert {len(p) for p in found["l1"].split() if p.startswith("x")} <= {10 * i for i in range(1, 9)} and len(found["l1"]) <= 102


def test_languages_keep_their_references_beside_others(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} " * 30, f"l{i % 50}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every, one = language.reference(docs), language.reference(docs.where("lang = 'l7'"))
    assert len(every) == 50 and every["l7"] == one["l7"] and len(one["l7"]) > 4 * 85


def test_language(spark, odd, empty):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    found = language.predict(docs, queries.LEARN, ("lang",)).where((queries.remainder(3) == 1) & F.col("lang").isNotNull()).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    rows = language.predict(odd, queries.LEARN).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.predict(empty, queries.LEARN).count() == 0
    und = {r.doc_id for r in language.identify(odd, {"xx": " abc "}).where("lang_pred = 'und'").collect()}
    assert {0, 1, 2, 12} <= und and 3 not in und


def test_marginals_by_enumeration():
    model = html.Model()
    nodes, _ = html.parse("<body><nav><a href=x>m</a></nav><div class=content><p>some words of a text</p><ul><li>x</li></ul></div></body>")
    weight = {}
    for labels in product((0, 1), repeat=len(nodes) - 1):
        y = (0, *labels)
        p = model.local(nodes[0])[0]
        for i, node in enumerate(nodes[1:], 1):
            p *= model.local(node)[y[i]] * model.step(html._kind(node.tag), y[node.parent], y[i])
        weight[y] = p
    total = sum(weight.values())
    want = [sum(p for y, p in weight.items() if y[i]) / total for i in range(len(nodes))]
    assert model.marginals(nodes) == pytest.approx(want)


def test_html(spark, sf_dir):
    model = html.Model()
    page = "<html><head><title>T</title></head><body><nav><a href=a>Menu</a></nav><article><h1>A &amp; B</h1><p>First  paragraph\nof it, long enough to be one.<script>x()</script></p><p>Second &lt;one&gt; with <b>bold</b> words in it.</p></article><div class=comments><p>I like this page a lot.</p></div><footer>foot of it</footer>"
    assert model.extract(page) == "A & B\nFirst paragraph of it, long enough to be one.\nSecond <one> with bold words in it."
    for broken in (None, "", "<", "<p", "<!-- never ends", "<script>x", "plain text", "</div></div>", "<p>" * 3000):
        assert isinstance(model.extract(broken), str)
    rows = queries.op5_html(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in rows) and np.mean([r.n_chars > 0 for r in rows]) > 0.9
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>x</p>", 3)], "page_id long, url string, html string, text int")
    assert html.extract(odd).count() == 3 and html.extract(odd.limit(0)).count() == 0


def test_html_raw_text_ends_at_its_end_tag():
    model = html.Model()
    body = "<article><h1>A heading</h1><p>A paragraph of the story, long enough to be one of its own.</p></article>"
    want = model.extract(f"<html><body>{body}</body></html>")
    assert want
    for raw in ("<script>for(i=0;i<n;i++){f(i);}</script>", "<script>s='<!--';</script>", "<style>a:before{content:'<b'}</style>", "<script>t='<i title=\"'</SCRIPT >", "<title>a <b</title>", "<script>'</scripts>'<n</script\n>"):
        assert model.extract(f"<html><body>{raw}{body}</body></html>") == want
    assert model.extract(f"<html><body>{body}<script>i<n") == want


def test_topk_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.choice([-0.5, 0.25, 1.0], 8).tolist(), i) for i in range(300)]
    rows += [(300, None, 0), (None, [1.0] * 8, 0), (301, [float("nan")] * 8, 0), (302, [float("inf")] * 8, 0), (303, [None] * 8, 0), (304, [1.0] * 3, 0), (305, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = {i: np.pad(np.floor(64 * np.array(e)), (0, 8 - len(e))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = [(q, n + 1, i, int(s)) for q in good if q % 20 == 0 for n, (s, i) in enumerate(sorted(((good[q] @ e, i) for i, e in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:20])]
    assert sorted(map(tuple, topk.search(v, v.where("vec_id % 20 = 0")).collect())) == sorted(want)
    few = v.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(9)
    w = rng.random((500, 12)) * (rng.random((500, 12)) < 0.3)
    w = w[w.any(1)]
    w /= np.sqrt((w**2).sum(1, keepdims=True))
    w = w[np.argsort(w.argmax(1), kind="stable")]
    model = toxicity.Model(pa.array([], pa.string()), np.ones(12), w, np.arange(len(w)), rng.random(len(w)) < 0.5, 0.5)
    for x in w[::7]:
        c = np.flatnonzero(x)
        rows, cosines = model.nearest(c, x[c], 15)
        want = np.sort(w @ x)[::-1]
        assert cosines == pytest.approx(want[want > 0][:15])


def test_toxicity(spark, odd, empty):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op7_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.94
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    for docs in (odd, empty):
        found = toxicity.predict(docs, labels, queries.LEARN).collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    planted = spark.createDataFrame([(0, "so you are an idiot and a moron , scum"), (1, "the text is kind to all")], "doc_id long, text string")
    model = toxicity.fit(queries.documents(spark, sf_dir).where(queries.LEARN), labels.where(queries.LEARN))
    assert [r.predicted for r in toxicity.score(planted, model).orderBy("doc_id").collect()] == [1, 0]


def test_toxicity_finds_copies_of_rare_examples(spark):
    rng = np.random.default_rng(4)
    common, letters = [f"w{c}" for c in "abcdefghijklmnopqrst"], list("bcdfghklmn")
    made = lambda: "".join(rng.choice(letters, 9))
    rows = [(i, " ".join([*rng.choice(common, 12), *([made() for _ in range(6)] if i % 2 else [])])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 1)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.ids) == len(rows) and set(toxicity.terms(pa.array([w for _, t in rows for w in t.split()]))[0].to_pylist()) == set(model.vocabulary.to_pylist())
    for r in toxicity.score(docs, model).collect():
        assert (r.evidence[0]["doc_id"], r.evidence[0]["cosine"]) == (r.doc_id, pytest.approx(1.0))


def test_nearest_examples_over_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(10)
    w = rng.random((400, 60)) ** 6 * (rng.random((400, 60)) < 0.2)
    w = w[w.any(1)]
    w /= np.sqrt((w**2).sum(1, keepdims=True))
    w = w[np.argsort(w.argmax(1), kind="stable")]
    model = toxicity.Model(pa.array([], pa.string()), np.ones(60), w, np.arange(len(w)), rng.random(len(w)) < 0.5, 0.5)
    for i, x in enumerate(w):
        c, want = np.flatnonzero(x), w @ x
        want[i] = 0
        rows, cosines = model.nearest(c, x[c], 15, skip=i)
        assert cosines == pytest.approx(np.sort(want)[::-1][: len(rows)]) and i not in rows
        assert len(rows) == min(15, (want > 0).sum())


def test_pipeline_stages(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "language", "near_duplicates", "mixing", "sentencepiece"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = steps["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, ok in brute(rows, 5, 80) if ok)
    left = steps["toxicity"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    toxic = {r.doc_id for r in queries.op7_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - toxic
    assert steps["language"](spark, docs, sf_dir).columns == docs.columns
    assert steps["mixing"](spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_folds(spark, sf_dir):
    for r in queries.documents(spark, sf_dir).select("doc_id", queries.remainder(3).alias("a"), queries.remainder(7).alias("b")).collect():
        assert (r.a, r.b) == (fold(r.doc_id, 3), fold(r.doc_id, 7))


def test_pipeline_stages_survive_odd_rows(spark, odd, empty):
    sf_dir = "/root/testdata/sf0.01"
    steps = dict(corpus_pipeline.STAGES)
    docs = odd.withColumn("my-col", F.lit(1))
    for name in ("toxicity", "language", "near_duplicates", "mixing"):
        assert steps[name](spark, docs, sf_dir).columns == docs.columns
        assert steps[name](spark, empty, sf_dir).count() == 0
    sizes = {name: {r["size"] for r in steps[name](spark, docs, sf_dir).collect()} for name in ("toxicity", "near_duplicates")}
    assert {0, 1, 2} <= sizes["toxicity"]
    assert {0, 1, 2} <= sizes["near_duplicates"] and len({9, 10, 11} & sizes["near_duplicates"]) == 1 and len({7, 8} & sizes["near_duplicates"]) == 1
    assert steps["sentencepiece"](spark, docs, sf_dir).count() == docs.count()
