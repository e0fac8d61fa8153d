"""Token files: exact round trips, sums, random access, odd input."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.llm import rans, token_files
from logspark.session import scratch_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.word_bpe())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END]


@pytest.fixture(scope="module")
def by_words():
    with open(token_files.word_bpe(), encoding="utf-8") as f:
        return token_files.Encoder(f.read(), True)


def expected(docs, plain):
    """By the order of the files: doc id, number of ids, their sum."""
    out = []
    for doc_id, text in docs:
        ids = plain(text)
        out.append((doc_id is None, doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    return sorted(out, key=lambda r: r[:4])


def check(spark, docs, plain, path):
    want = expected(docs, plain)
    starts = np.cumsum([0, *(r[2] for r in want)])
    got = sorted(tuple(r) for r in token_files.read_documents(spark, path).select("start", "n_tokens", "ids_crc32").collect())
    assert got == [(int(s), r[2], r[3]) for s, r in zip(starts, want)]
    return [i for r in want for i in r[4]]


def test_whole_table(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op11_token_files(spark, SF_DIR).collect()}
    start = 0
    for null, doc_id, n, crc, _ in expected(docs, plain):
        assert got[None if null else doc_id] == (start, n, crc)
        start += n
    assert len(got) == len(docs)


def test_many_parts_and_blocks(spark, plain, monkeypatch, generated_docs):
    """Documents over several blocks and parts; every id and every range comes back."""
    monkeypatch.setattr(token_files, "PART_TOKENS", 3000)
    monkeypatch.setattr(token_files, "AT_ONCE", 2)
    docs = [*generated_docs, (1000, "one two three " * 60_000), (-5, "a"), (None, "b c"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(frame, path)
    ids = check(spark, docs, plain, path)
    assert spark.read.parquet(f"{path}/blocks").count() > spark.read.parquet(f"{path}/parts").count() > 3
    pieces = sorted((r.piece_start, r.ids) for r in token_files.read_tokens(spark, path).collect())
    assert np.array_equal(np.frombuffer(b"".join(bytes(p[1]) for p in pieces), "<u4"), ids)
    for first, last in ((0, 1), (777, 9000), (len(ids) - 70_000, len(ids) - 3), (len(ids) - 1, len(ids) + 5), (5, 5)):
        cut = sorted((r.start, bytes(r.ids)) for r in token_files.read_range(spark, path, first, last).collect())
        assert np.array_equal(np.frombuffer(b"".join(c for _, c in cut), "<u4"), ids[first:last])


def test_odd_rows(spark, odd, plain):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(odd, path)
    check(spark, [(r.doc_id, r.text) for r in odd.collect()], plain, path)


def test_empty_table(spark, empty):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(empty, path)
    assert token_files.read_documents(spark, path).collect() == []
    assert token_files.read_range(spark, path, 0, 10).collect() == []


def test_one_document_without_words(spark, plain):
    path = scratch_path(spark, "tokens")
    docs = [(1, "")]
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id bigint, text string"), path)
    assert check(spark, docs, plain, path) == [token_files.END]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAeZ'st1,.!<|>endoftxé́ßΣİ中  ‍ \n\t-_^`~🙂"), max_size=60), max_size=4))
def test_by_words_equals_whole_texts(by_words, texts):
    texts = [*texts, "it's <|endoftext|> and <|ENDOFTEXT|>, O'Re's", None]
    want = [list(ids) for ids in by_words.whole([t or "" for t in texts])]
    assert [list(ids) for ids in by_words(pa.array(texts, pa.string()))] == want


def test_memory_of_words_is_bounded(by_words, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 10)
    for k in range(30):
        text = " ".join(f"word{chr(97 + (k + j) % 26)}x." for j in range(7))
        assert list(by_words(pa.array([text]))[0]) == list(by_words.whole([text])[0])
        assert len(by_words.keys) <= 14


def test_words_that_share_a_hash(by_words, monkeypatch):
    """Two words of one key: of different sizes the texts are encoded whole."""
    from logspark.llm.text import Texts

    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends: np.ones(len(starts), np.uint64))
    by_words.forget()
    for text in ("alpha", "be gamma", "longerword"):
        assert list(by_words(pa.array([text]))[0]) == list(by_words.whole([text])[0])
    by_words.forget()


def test_tokenizer_that_keeps_blanks_needs_whole_texts(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(2, "a  b"), (1, None)], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, scratch_path(spark, "tokens"), tokenizer=path)
    where = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, where, tokenizer=path, by_words=False)
    assert sorted((r.doc_id, r.start) for r in token_files.read_documents(spark, where).collect()) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("n, kinds", [(1, 1), (63, 2), (64, 2), (70_000, 900), (3 * rans.BLOCK + 5, 30_000)])
def test_codec(n, kinds):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), kinds) - 1
    counts = np.bincount(ids, minlength=kinds)
    freq = rans.frequencies(counts)
    assert freq.sum() == 1 << rans.PRECISION and ((freq > 0) == (counts > 0)).all()
    table = rans.Table(freq)
    docs = rans.Docs(np.array([7]), np.array([0]), np.array([0]), np.array([n]))
    raw = [f for i in range(0, n, rans.BLOCK) for f in rans.frames(table, [ids[i : i + rans.BLOCK]], [docs])]
    assert np.array_equal(np.concatenate(rans.read(table, [rans.Frame(r) for r in raw])), ids)
    if kinds > 100:
        p = counts[counts > 0] / n
        assert 8 * sum(map(len, raw)) / n < -(p * np.log2(p)).sum() * 1.1
    for at in (5, len(raw[0]) - 1):
        broken = bytearray(raw[0])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.read(table, [rans.Frame(bytes(broken))])


@given(st.binary(max_size=50), st.binary(max_size=3000))
def test_joined_crc(a, b):
    assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
