"""SentencePiece pieces and directly addressable codes against the tokenizer libraries."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import TEXTS
from tidemill.llm import codes, pieces, queries, store

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def processor():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_BPE))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    made.encode_special_tokens = True
    return made


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_of_all_texts(spark, sf_dir, processor):
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf_dir).collect()}
    found = queries.op3_pieces(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = processor.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), crc(ids), True)


def test_pieces_of_odd_rows(spark, odd, empty, processor):
    path = queries.tokenizer_path(queries.PIECE_BPE)
    encoded = pieces.encode(odd, path)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(list(processor.encode(r.text or "")))
    for r in encoded.collect():
        assert list(r.ids) in texts[r.doc_id]
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in pieces.decode(encoded, path).collect())
    assert back == sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").replace("▁", " ")) for r in odd.collect())
    assert pieces.digest(empty, path).count() == 0


def test_pieces_of_random_text(processor):
    rng = np.random.default_rng(2)
    alphabet = list("abcdeinorst  .,-▁éß漢\U0001f600\n'0123")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(600)]
    ids, borders = pieces.encode_texts(pa.array(texts, pa.string()), queries.tokenizer_path(queries.PIECE_BPE))
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)] == [processor.encode(t) for t in texts]


def codes_of(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) by the library alone."""
    start, out = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, queries.END_ID]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_codes_of_all_texts(spark, sf_dir, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in queries.op10_codes(spark, sf_dir).collect()) == codes_of(rows, tokenizer)


def test_codes_of_odd_rows(spark, odd, empty, tokenizer):
    for docs in (odd, empty):
        path = store.new_path(spark, "test-codes")
        codes.write(docs, path, queries.tokenizer_path(queries.BYTE_BPE), queries.END_ID)
        found = sorted(codes.read(spark.read.parquet(path)).collect(), key=lambda r: r.start)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        by_library = sorted((str(i), n, c) for i, _, n, c in codes_of(rows, tokenizer))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == by_library
        ids = [r.doc_id for r in found]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
        assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()][: len(found)]


def test_random_access():
    rng = np.random.default_rng(7)
    ids = (2.0 ** rng.uniform(0, 31, 5_000)).astype(np.uint64)
    levels = codes.pack(ids)
    assert len(levels) == 4
    for i in rng.integers(0, len(ids), 300):
        assert codes.access(levels, int(i), int(i) + 1)[0] == ids[i]
    for a, b in ((0, 5_000), (17, 17), (1023, 1025), (511, 4099)):
        assert (codes.access(levels, a, b) == ids[a:b]).all()
    assert len(codes.access(codes.pack(np.zeros(0)), 0, 0)) == 0


def test_parts_meet_the_tokenizer(tokenizer):
    texts = pa.array([t for t in TEXTS if t is not None], pa.string())
    ids, borders = codes.token_ids(texts, queries.tokenizer_path(queries.BYTE_BPE))
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]


def test_codes_of_added_tokens_as_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    rows = list(enumerate(["one <|endoftext|> two", "a<|endoftext|><|endoftext|>", "<|endoftext|>", "  <|endoftext|>  x", "plain words here"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert 50256 in library.encode(rows[0][1], add_special_tokens=False).ids
    assert sorted(tuple(r) for r in queries.op10_codes(spark, str(tmp_path)).collect()) == codes_of(rows, library)
