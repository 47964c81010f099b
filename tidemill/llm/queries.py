"""The registered queries of the operators: each applies one operator to its whole table and returns a digest of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import codes, dedup, fim, html, katz, language, mixing, pieces, quality, sharding, store, topk, toxicity, trie

#: The folder of public tokenizer files is a parameter of the operators; the queries ask the installed package for it.
BYTE_BPE, END_ID, PIECE_BPE = "byte_bpe_50k.json", 2, "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int):
    """crc32(doc_id as text) mod n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


#: Rows that the classifiers may learn from.
LEARN = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 3 <> 1"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), tokenizer_path(PIECE_BPE))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.predict(documents(spark, sf_dir), LEARN)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.predict(documents(spark, sf_dir), labels, LEARN)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(documents(spark, sf_dir), shingle=2)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(documents(spark, sf_dir), remainder(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "codes")
    codes.write(documents(spark, sf_dir), path, tokenizer_path(BYTE_BPE), END_ID, specials=True)
    return codes.read(spark.read.parquet(path))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


#: CTEs (crc_table, and crc over `keyed`: (k, body)) that give the unsigned crc32 of a text's UTF-8 bytes, by half bytes.
CRC = """
crc_table AS (SELECT list(list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384::BIGINT * (s & 1))) ORDER BY i) AS t FROM range(16) r(i)),
halves AS (SELECT k, string_split(hex(body), '') AS h, len(hex(body)) AS m FROM keyed),
crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(m), lambda i: ('0x' || h[xor(i, 1) + 1])::BIGINT)), lambda s, x: xor(s >> 4, t[(xor(s, x) & 15) + 1])), 4294967295)::BIGINT AS crc FROM halves, crc_table)"""

OP11_SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || COALESCE(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
    ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = f"""
WITH n AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
keyed AS (SELECT DISTINCT conv_id AS k, conv_id::VARCHAR AS body FROM n),{CRC},
ids AS (SELECT n.conv_id, count(*) AS total, any_value(crc.crc) % 9 AS h FROM n JOIN crc ON crc.k = n.conv_id GROUP BY n.conv_id),
plan AS (
  SELECT i.conv_id, i.conv_id - i.conv_id % 5 AS base, i.h, least(i.h, COALESCE(b.total, 0)) AS lead, least(i.h, COALESCE(b.total, 0)) + greatest(i.total - i.h, 0) AS size
  FROM ids i LEFT JOIN ids b ON b.conv_id = i.conv_id - i.conv_id % 5),
r AS (
  SELECT p.conv_id, p.size, n.pos + 1 AS depth, role, text FROM plan p JOIN n ON n.conv_id = p.base AND n.pos < p.lead
  UNION ALL SELECT p.conv_id, p.size, p.lead + n.pos - p.h + 1, role, text FROM plan p JOIN n ON n.conv_id = p.conv_id AND n.pos >= p.h),
paths AS (
  SELECT conv_id, size, 0 AS depth, '' AS key, NULL AS parent, 0 AS bytes FROM plan
  UNION ALL SELECT conv_id, size, depth, string_agg(md5(role) || md5(text), '') OVER w, COALESCE(string_agg(md5(role) || md5(text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), strlen(text)
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT key, any_value(parent) AS parent, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
known AS (SELECT nodes.*, COALESCE(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
below AS (
  SELECT up.key, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM known f JOIN paths up ON up.conv_id = f.conv_id AND up.depth <= f.depth GROUP BY up.key),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM paths WHERE depth = size GROUP BY key)
SELECT k.conv_id, k.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, COALESCE(e, sha256('')) AS ends_sha256
FROM known k JOIN below b USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes above ON above.key = k.parent
"""

OP13_SQL = f"""
WITH keyed AS (SELECT row_number() OVER () AS k, COALESCE(text, '') AS body, doc_id FROM documents),{CRC},
drawn AS (
  SELECT doc_id, strlen(body) + 1 AS size, crc.crc AS text_crc32,
    (row_number() OVER (PARTITION BY doc_id, strlen(body), crc.crc) - 1) // 5000 * 5000 AS run,
    list_transform(range(9), lambda i: -ln((('0x' || substr(md5('13:' || i || ':' || COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976)) AS waits
  FROM keyed JOIN crc USING (k)),
placed AS (
  SELECT *, (list_position(waits, list_min(waits[1:8])) - 1)::INT AS shard, (list_position(waits, list_min(waits)) - 1)::INT AS grown_shard,
    ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':' || run), 1, 15))::BIGINT % greatest(1, ((count(*) OVER ()) + 9999) // 10000) AS bucket
  FROM drawn)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, run) - 1 AS slot, grown_shard
FROM placed
"""

OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
sums AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2::DOUBLE AS top FROM sums),
levels AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - COALESCE(SUM(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goal AS (
  SELECT source, source_size, CASE WHEN top <= level * w THEN top
    ELSE (SELECT arg_min(level, (top / w)) FROM levels WHERE top > level * w) * w END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
    COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
    + LEAST(GREATEST(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before, 0), size))::BIGINT AS taken
FROM placed
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_quality": op2_quality, "op3_pieces": op3_pieces, "op4_language": op4_language, "op5_html": op5_html, "op6_topk": op6_topk, "op7_toxicity": op7_toxicity, "op8_dedup": op8_dedup, "op9_katz": op9_katz, "op10_codes": op10_codes, "op11_fim": op11_fim, "op12_trie": op12_trie, "op13_sharding": op13_sharding}
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op6_topk": OP6_SQL, "op11_fim": OP11_SQL, "op12_trie": OP12_SQL, "op13_sharding": OP13_SQL}
