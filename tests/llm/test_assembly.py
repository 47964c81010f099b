"""Fill-in-middle, the conversation trie and sharding against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm import fim, queries, sharding, trie


def test_boundaries_of_random_texts():
    rng = np.random.default_rng(4)
    for alphabet, size in (("abc d", 300), ("aé漢\U0001f600", 5000), ("\U0001f600", 2000), ("漢字x", 4097), ("a", 1025), ("é", 512)):
        text = "".join(rng.choice(list(alphabet), size))
        found = fim.boundaries(text.encode())
        ends = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        assert found.n == len(text) and [fim.select(found, i) for i in range(len(text) + 1)] == ends.tolist()
    empty = fim.boundaries(b"")
    assert empty.n == 0 and fim.select(empty, 0) == 0


def test_boundaries_over_blocks(monkeypatch):
    text = ("ab漢é" * 70).encode()
    whole = fim.boundaries(text)
    for block in (1, 7, 350, len(text)):
        monkeypatch.setattr(fim, "BLOCK", block)
        assert fim.boundaries(text) == whole


def fim_of(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("buckets", [fim.BUCKETS, 1])
def test_fim_of_odd_rows(spark, odd, empty, buckets, monkeypatch):
    monkeypatch.setattr(fim, "BUCKETS", buckets)
    marks = [(100 + i, t) for i, t in enumerate(("a <P> b", "<", "<S", "x<M", "P>S>M>", "<<S>>", "\U0001f600<P", "<P" * 30, "a\u0000b"))]
    docs = odd.unionByName(spark.createDataFrame(marks * 2, "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.collect()
    found = fim.transform(docs, keep=("text", "id", "component")).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    order = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    got = sorted(((r.doc_id, r.text, r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=order)
    assert got == sorted(((r.doc_id, r.text, r.id, *fim_of(r.doc_id, r.text)) for r in rows), key=order)
    assert sorted((r.output, r.back) for r in found.collect()) == sorted((fim_of(r.doc_id, r.text)[-1], r.text or "") for r in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    assert fim.transform(empty).count() == 0
    with pytest.raises(ValueError, match="own"):
        fim.transform(docs.withColumn("n", F.lit(1)), keep=("n",))


def test_index_has_each_text_once(spark, odd):
    texts = [r.text or "" for r in odd.collect()]
    rows = fim.index(odd).collect()
    assert sorted(r.text for r in rows) == sorted(set(texts))
    for r in rows:
        found = fim.Boundaries(r.n, r.low_bits, bytes(r.high), bytes(r.low), bytes(r.places))
        assert r.n == len(r.text) and fim.select(found, r.n // 2) == len(r.text[: r.n // 2].encode())


def trie_of(rows):
    """The contract in dictionaries; rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), children, sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_of_odd_conversations(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(c), None if rng.random() < 0.1 else int(rng.integers(0, 9)), None if rng.random() < 0.1 else str(rng.choice(["user", "assistant"])), None if rng.random() < 0.1 else str(rng.choice(["a", "bé", "", "long " * 40]))) for c in rng.integers(-7, 60, 260)]
    rows += [(None, 1, "user", "x"), *[(70, 0, "user", "a")] * 30, *[(75, i, "user", f"t{i % 3}") for i in range(90)], (76, 0, "user", "lone")]
    schema = "conv_id long, turn long, role string, text string, key string, depth int, size int, part int, digest string"
    made = spark.createDataFrame([(*r, "k", 1, 2, 3, "d") for r in rows], schema).repartition(5)
    want = trie_of(rows)
    assert trie_rows(trie.trie(made)) == want
    monkeypatch.setattr(trie, "SEGMENT", 7)
    assert trie_rows(trie.trie(made)) == want
    assert trie.trie(made.limit(0)).count() == 0


def test_trie_of_empty_conversations(spark):
    # both lose their one turn to a first conversation of the family that isn't there
    gone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9][:2]
    rows = [(c, 0, "user", "x") for c in gone]
    assert trie_rows(trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == trie_of(rows)
    assert len(trie_of(rows)) == 1


def test_trie_of_all_conversations(spark, sf_dir):
    made = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert trie_rows(queries.op12_trie(spark, sf_dir)) == trie_of([(r.conv_id, r.turn, r.role, r.text) for r in made.collect()])


def test_ends_over_batches(spark):
    ids = spark.range(0, 30_000).select((F.col("id") * 7 % 30_011).alias("conv_id"), F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("key"))
    want = {}
    for r in ids.collect():
        want.setdefault(bytes(r.key), []).append(r.conv_id)
    want = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert {bytes(r.key): r.ends_sha256 for r in trie.ends_digest(ids).collect()} == want


def test_shards_by_weight_and_growth(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = (1.0, 2.0, 0.0, 5.0)
    both = keys.select("doc_id", sharding.shard_of(F.col("doc_id"), weights).alias("a"), sharding.shard_of(F.col("doc_id"), (*weights, 2.0)).alias("b"), sharding.shard_of(F.col("doc_id"), (1.0, 2.0, 0.0, 8.0)).alias("c")).collect()
    share = np.bincount([r.a for r in both], minlength=4) / len(both)
    assert np.allclose(share, [0.125, 0.25, 0, 0.625], atol=0.01)
    assert all(r.a == r.b or r.b == 4 for r in both) and abs(np.mean([r.b == 4 for r in both]) - 0.2) < 0.01
    assert all(r.a == r.c or r.c == 3 for r in both)
    with pytest.raises(ValueError, match="weight"):
        sharding.shard_of(F.col("doc_id"), (0.0,))


def test_slots_of_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_COPIES", 3)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    copies = spark.createDataFrame([(50, "same")] * 20 + [(None, None)] * 11 + [(51, f"text {i}") for i in range(30)], "doc_id long, text string")
    docs = odd.unionByName(copies, allowMissingColumns=True)
    found = sharding.place(docs).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in found)
    assert len({(r.doc_id, r.shard) for r in found}) == len({r.doc_id for r in found})
    again = sharding.place(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.place(empty).count() == 0


def test_written_shards(spark, odd, tmp_path):
    path = f"{tmp_path}/shards"
    sharding.write(odd, path, (1.0, 1.0))
    back = spark.read.schema(StructType(list(odd.schema.fields)).add("shard", "integer")).parquet(path)
    assert sorted(str(r) for r in back.select(*odd.columns).collect()) == sorted(str(r) for r in odd.collect())
    assert back.where(F.col("shard") != sharding.shard_of(F.col("doc_id"), (1.0, 1.0))).count() == 0
