import random

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns, words
from tokenizers import Tokenizer

from logarbor.llm import bpe_chunks

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("mask_bits", [2, 5, 9])
def test_ids_equal_the_tokenizer(exact, mask_bits):
    """Small masks cut inside nearly every word, so nearly every id comes from a repaired join."""
    coder = bpe_chunks.ChunkEncoder(PATH, mask_bits)
    assert coder.blank_safe
    rng = random.Random(2)
    texts = [t or "" for t in odd_texts()]
    alphabet = "ab Zé\n'sß中́İΣ<|endoftext|>0 🙂   "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    for t in texts + texts:
        ids = exact.encode(t, add_special_tokens=False).ids
        assert coder.encode(t).tolist() == ids
        assert coder.decode(ids) == exact.decode(ids, skip_special_tokens=False)


def test_equal_passages_are_encoded_once():
    coder = bpe_chunks.ChunkEncoder(PATH, 6)
    rng = random.Random(4)
    passage = words(rng, 2000, 10**6)
    coder.encode("one start " + passage)
    before = coder.encoded
    coder.encode("quite another beginning of it " + passage + " end")
    assert coder.encoded - before < 0.05 * before and coder.reused > 0.9 * before


def test_cuts_follow_content_and_characters():
    text = "é中🙂 word " * 500
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    cuts = bpe_chunks.cut_positions(data, 3)
    assert len(cuts)
    assert all((data[c] & 0xC0) != 0x80 for c in cuts if c < len(data))
    assert len(bpe_chunks.cut_positions(np.full(10_000, 97, np.uint8), 3)) <= 1


def test_small_memory_gives_the_same_ids(exact, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe_chunks, "CHUNK_BYTES_KEPT", 2000)
    coder = bpe_chunks.ChunkEncoder(PATH, 5)
    for t in odd_texts():
        assert coder.encode(t or "").tolist() == exact.encode(t or "", add_special_tokens=False).ids


def test_a_file_that_keeps_blanks_is_used_on_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe_chunks.ChunkEncoder(path)
    assert not coder.blank_safe
    text = "a  b\n c"
    assert coder.encode(text).tolist() == Tokenizer.from_file(path).encode(text).ids


def test_tables(spark, exact):
    texts = odd_texts()
    docs = with_clashing_columns(docs_of(spark, texts + ["again"]))
    coded = bpe_chunks.encode(docs, PATH, decoded=True)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].ids, rows[i].decoded) == (ids, exact.decode(ids, skip_special_tokens=False))
    again = {r.doc_id: r.decoded for r in bpe_chunks.decode(coded, PATH).collect()}
    assert again == {k: r.decoded for k, r in rows.items()}
    assert bpe_chunks.encode(spark.createDataFrame([], DOCS), PATH, decoded=True).count() == 0
