import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns
from logarbor.llm import spelling as sp


def edit_distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute_force(rows, every=199):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edit_distance_is_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, c, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, c in n.items()}


def found(df):
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typo(rng, w, letters="abcdeé÷"):
    k, x = rng.randrange(len(w)), rng.choice(letters)
    return rng.choice([w[:k] + w[k + 1:], w[:k] + x + w[k:], w[:k] + x + w[k + 1:]])


def corpus(seed=1, stems=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(6, 12))) for _ in range(stems)]
    base += ["listen" * 2, "silent" * 2, "×÷×÷×÷", "Éclairs", "éclairs", "x" * 300, "x" * 299]
    words = []
    for w in base:
        chain = w
        for n in (160, 30, 6):  # each form some five times rarer than the last
            words += [chain] * n
            chain = typo(rng, chain)
        words += [typo(rng, w) for _ in range(10)] * 3
    rng.shuffle(words)
    return [" ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words[k:k + 50])
            + rng.choice([".", "-1", "\n中文"]) for k in range(0, len(words), 50)]


@pytest.mark.parametrize("shard_words", [8, 8192])
def test_equals_brute_force(spark, shard_words):
    texts = corpus() + odd_texts()
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = with_clashing_columns(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS))
    want = brute_force(rows)
    got = found(sp.variants(docs, shard_words=shard_words))
    assert got == want
    assert any(r[3] for r in got) and any(r[3] != r[5] for r in got if r[3])  # chains of forms


def test_typos_are_made_by_the_rule(spark):
    texts = corpus(2, 10)
    rows = list(enumerate(texts, 10)) + [(None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert found(sp.variants(docs, every=3)) == brute_force(rows, 3)


def test_anagrams_share_one_leaf_dealt_over_shards(spark):
    """Words of equal counts cannot be told apart by the trie; they are dealt by hash and all meet."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(300)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:50]}
    docs = docs_of(spark, [" ".join(words)] * 6)
    assert found(sp.variants(docs, shard_words=16)) == brute_force(list(enumerate([" ".join(words)] * 6)))


def test_empty_and_null_tables(spark):
    assert sp.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert sp.variants(docs_of(spark, [None, "", "short"])).collect() == []


def test_one_apart_against_a_plain_check():
    rng = random.Random(9)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(80)})
    both = [(a, b) for a in range(len(words)) for b in range(len(words))]
    i, j = np.array(both).T
    packed = sp.Words(words)
    assert sp.one_apart(packed, i, packed, j).tolist() == [edit_distance_is_one(words[a], words[b]) for a, b in both]


def test_every_near_word_meets_at_its_home():
    """Whatever the sample of the top trie, a word visits the home shard of all words near to it."""
    rng = random.Random(3)
    words = list({typo(rng, "".join(rng.choice("etaoinhq") for _ in range(rng.randrange(6, 9)))) for _ in range(600)})
    trie = sp.top_trie(sp.Words(words[:40]).vectors, len(words), 20)
    visits, home = {k: set() for k in range(len(words))}, {}
    keys = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    for shard, idx, at_home in sp.route(trie, sp.Words(words).vectors, keys):
        for k, h in zip(idx.tolist(), at_home.tolist()):
            visits[k].add(shard)
            if h:
                assert k not in home
                home[k] = shard
    assert len(home) == len(words)
    for a in range(len(words)):
        for b in range(len(words)):
            if edit_distance_is_one(words[a], words[b]):
                assert home[b] in visits[a]


def test_a_shard_keeps_the_best_of_ties():
    rows = pa.table({"word": ["banana", "bananb", "bananc", "cherry"], "n": pa.array([5, 9, 9, 7], pa.int64()),
                     "home": [True] * 4})
    best = {r["word"]: (r["near"], r["best_n"], r["best"]) for r in sp.shard_best(rows).to_pylist()}
    assert best == {"banana": (2, 9, "bananb"), "bananb": (2, 9, "bananc"), "bananc": (2, 9, "bananb")}
