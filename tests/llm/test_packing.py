import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logarbor.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def least_bins(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, rest + [r - sizes[i]])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit_enclose_the_optimum(sizes):
    lengths = np.array(sizes)
    bins = packing.best_fit_decreasing(lengths, 20)
    assert np.bincount(bins, weights=lengths).max() <= 20
    assert packing.lower_bound(lengths, 20) <= least_bins(sizes, 20) <= bins.max() + 1


def test_bound_sees_more_than_the_sum():
    assert packing.lower_bound(np.array([11] * 6), 20) == 6   # no two fit together
    assert packing.lower_bound(np.array([7] * 9), 20) == 5    # two in a bin


def test_pieces_are_the_tokenizers_ids(spark):
    texts = odd_texts()
    exact = Tokenizer.from_file(PATH)
    got = {}
    for r in packing.token_pieces(docs_of(spark, texts), PATH).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert pieces[0].start == 0 and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 2048 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("per_partition", [50_000, 150])
def test_every_piece_has_one_gapless_place(spark, per_partition):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randrange(1, 100), rng.randrange(1, 30), 100, 51, 50]) for _ in range(1200)]
    pieces = spark.createDataFrame([(i % 7, i, 0, n, i) for i, n in enumerate(sizes)], packing.PIECES)
    rows = packing.pack_pieces(pieces, capacity=100, items_per_partition=per_partition).collect()
    assert sorted(r.piece for r in rows) == list(range(1200))
    n = check_packed(rows, 100)
    bound = packing.lower_bound(np.array(sizes), 100)
    assert bound <= n <= bound + 3


def test_exchange_closes_gaps(spark):
    """Partitions of one piece each waste half a bin; exchanges pair them."""
    pieces = spark.createDataFrame([(i, 0, 0, 50, i) for i in range(64)], packing.PIECES)
    rows = packing.pack_pieces(pieces, capacity=100, items_per_partition=1).collect()
    assert check_packed(rows, 100) == 32


def test_sequences_hold_the_ids(spark):
    docs = docs_of(spark, [None, "a b c", "a b c", "hello world"])
    pieces = packing.token_pieces(docs, PATH, with_ids=True)
    out = packing.sequences(packing.pack_pieces(pieces), pieces).collect()
    assert len(out) == 1
    exact = Tokenizer.from_file(PATH)
    want = sorted(x for t in ["", "a b c", "a b c", "hello world"] for x in [*exact.encode(t).ids, 0])
    assert sorted(out[0].ids) == want


def test_empty_clashing_and_null_ids(spark):
    empty = packing.pack_pieces(packing.token_pieces(spark.createDataFrame([], DOCS), PATH))
    assert empty.count() == 0
    docs = with_clashing_columns(spark.createDataFrame([(None, "x", "", "", 1), (1, None, None, None, None),
                                                        (1, None, None, None, None)], DOCS))
    assert packing.pack_pieces(packing.token_pieces(docs, PATH)).count() == 3
