"""Encoding against the tokenizers library, over prose, odd texts and boundaries of pieces."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.registry import TOKENIZER, op12_bpe

SF = "/root/testdata/sf0.001"
ATOMS = (
    "a", "b", "'", "s", "re", "'re", "'ll", "don't", " ", "  ", "\n", " \n", "\n\n", "\t", "\r", "1", "23", "½", "é", "é", "中文", "՘", "　",
    " ", "\x85", "\x1c", "\x00", "!", "...", "<|endoftext|>", "<|endof", "\U0001f600", "‍", "रा", "ไทย", "\U00010940", "the", " ing", "ation",
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("piece", [3, 10, 1_000_000])
def test_random_texts_equal_the_library(library, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "PARTS", 50)
    rng, vocab = random.Random(piece), bpe.vocabulary(TOKENIZER)
    texts = ["".join(rng.choices(ATOMS, k=rng.randrange(25))) for _ in range(3000)]
    got = bpe.encode_texts(vocab, texts)
    assert got == [ids_of(library, t) for t in texts]
    assert [bpe.decode_ids(vocab, x) for x in got] == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in got]


def test_a_full_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    monkeypatch.setattr(bpe, "PARTS", 10)
    vocab, rng = bpe.vocabulary(TOKENIZER), random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdet", k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(50)]
    assert bpe.encode_texts(vocab, texts) == [ids_of(library, t) for t in texts]


def test_every_merge_order_of_one_part(library):
    """Ties go left, and later merges need earlier ones: long runs of few letters."""
    rng, vocab = random.Random(1), bpe.vocabulary(TOKENIZER)
    texts = ["".join(rng.choices("aest", k=n)) for n in (2, 3, 4, 5, 8, 9, 16, 17, 33, 700, 5000)] + ["a" * 3000, "s" * 4097]
    assert bpe.encode_texts(vocab, texts) == [ids_of(library, t) for t in texts]


def test_bytes_that_are_no_text_decode_as_the_library_does(library):
    rng, vocab = random.Random(2), bpe.vocabulary(TOKENIZER)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert bpe.decode_ids(vocab, np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    schema = "doc_id long, text string, ids int, `te.xt` string"
    rows = [(1, None, 5, "x"), (1, None, 5, "x"), (None, "", 6, None), (2, "a b", 7, "y")]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, schema), TOKENIZER), TOKENIZER).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4, r.text) for r in got) == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 2, "a b")]
    both = bpe.round_trip(spark.createDataFrame(rows, schema), TOKENIZER).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, got))
    none = bpe.encode(spark.createDataFrame([], schema), TOKENIZER)
    assert none.columns == ["doc_id", "ids"] and none.count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.vocabulary(TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k"))


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = ids_of(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        decoded = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
