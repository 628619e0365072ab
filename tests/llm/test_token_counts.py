import random
from functools import lru_cache

import public_tokenizers
import pytest
import regex
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns
from logarbor.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def costs():
    return tc.zipf_costs(RANKS)


def reference(costs, unknown):
    @lru_cache(None)
    def tokens(word):
        best = [(0, 0)]
        for j in range(1, len(word) + 1):
            options = [(best[j - 1][0] + costs.get(word[j - 1:j], unknown), best[j - 1][1] + 1)]
            options += [(best[i][0] + costs[word[i:j]], best[i][1] + 1) for i in range(j - 1) if word[i:j] in costs]
            best.append(min(options))
        return best[-1][1]
    return tokens


def test_trie_equals_word_by_word(costs):
    rng = random.Random(1)
    vocabulary = {b"a": 5, b"b": 5, b"ab": 7, b"aba": 9, b"bb": 10, b"abab": 14, b"c" * 7: 3}
    for model in (vocabulary, costs):
        trie = tc.PrefixTrie(model)
        words = list({bytes(rng.choice(b"abcx") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
        want = reference(model, trie.unknown)
        assert trie.counts(words) == {w: want(w) for w in words}


def test_shared_prefixes_are_scored_once(costs):
    trie = tc.PrefixTrie(costs)
    words = [b"walk", b"walked", b"walker", b"walking", b"wall"]
    trie.counts(words)
    assert trie.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_tables_equal_brute_force(spark, costs, monkeypatch):
    texts = odd_texts()
    docs = with_clashing_columns(docs_of(spark, texts + texts[:5]))
    rows = {r.doc_id: r for r in tc.token_counts(docs, RANKS, batch_chars=500).collect()}
    want = reference(costs, 0)
    pattern = regex.compile(tc.PATTERN)
    for i, t in enumerate(texts + texts[:5]):
        own = [w.encode() for w in pattern.findall(t or "")]
        assert (rows[i].n_pretokens, rows[i].n_tokens) == (len(own), sum(map(want, own)))
    assert tc.token_counts(spark.createDataFrame([], DOCS), RANKS).count() == 0


def test_small_memory_gives_the_same_counts(costs, monkeypatch):
    texts = [t or "" for t in odd_texts()]
    full = tc.Counter(costs).batch(texts)
    monkeypatch.setattr(tc, "PIECES_KEPT", 3)
    forgetful = tc.Counter(costs)
    parts = [forgetful.batch([t]) for t in texts]
    assert ([p[0][0] for p in parts], [p[1][0] for p in parts]) == full
