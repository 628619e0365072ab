import hashlib
import random

import pytest
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns, words

from logarbor.llm import lz_fingerprint as lz


def phrases(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen


def test_parse_in_parts_equals_whole_parse():
    rng = random.Random(1)
    for t in odd_texts():
        t = t or ""
        k = rng.randrange(len(t) + 1)
        parts = lz.Parse().feed(t[:k])
        assert list(lz.Parse(parts).feed(t[k:]).signature()) == list(lz.signature(t))
        assert parts.feed(t[k:]).seen == phrases(t)


def test_signature_holds_the_least_hashes_of_the_phrases():
    rng = random.Random(2)
    for t in [words(rng, n) for n in (1, 5, 50, 900)]:
        sig = lz.signature(t)
        assert len(sig) == min(lz.SIGNATURE, len(phrases(t)))
        assert list(lz.from_text(lz.as_text(sig))) == list(sig)


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    errors = []
    for _ in range(60):
        a = words(rng, rng.randrange(5, 400))
        b = a[: rng.randrange(len(a))] + words(rng, rng.randrange(1, 200))
        x, y = phrases(a), phrases(b)
        errors.append(abs(lz.likeness(lz.signature(a), lz.signature(b)) - len(x & y) / len(x | y)))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.05
    small = lz.likeness(lz.signature("abcabc"), lz.signature("abcd"))
    assert small == pytest.approx(len(phrases("abcabc") & phrases("abcd")) / len(phrases("abcabc") | phrases("abcd")))
    assert lz.likeness(lz.signature(""), lz.signature("")) == 1.0
    assert lz.likeness(lz.signature("a"), lz.signature("")) == 0.0


def expected(rows):
    """(doc_id, text) rows in the order of ids -> expected result rows."""
    out = []
    for i, (doc, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        own, changed, other = lz.signature(t), lz.signature(e), lz.signature(nxt)
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), lz.as_text(own), lz.as_text(changed),
                    lz.likeness(own, changed), lz.likeness(own, other)))
    return out


@pytest.mark.parametrize("ids", ["dense", "sparse"])
def test_edited_likeness_equals_brute_force(spark, ids, monkeypatch):
    monkeypatch.setattr(lz, "RANGE_IDS", 4)
    monkeypatch.setattr(lz, "RANGES_PER_BLOCK", 3)
    rng = random.Random(4)
    texts = odd_texts()
    keys = sorted(rng.sample(range(-2000, 9000), len(texts))) if ids == "sparse" else range(len(texts))
    rows = list(zip(keys, texts))
    shuffled = rng.sample(rows, len(rows))
    docs = with_clashing_columns(spark.createDataFrame([(k, t, "", "", 0) for k, t in shuffled], DOCS))
    got = [tuple(r) for r in lz.edited_likeness(docs).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_repeated_null_and_lone_ids(spark):
    rows = [(1, "abab", "", "", 0), (1, "abab", "", "", 0), (1, "zz", "", "", 0), (None, "null id", "", "", 0),
            (None, None, "", "", 0)]
    got = lz.edited_likeness(spark.createDataFrame(rows, DOCS)).collect()
    order = [(1, "abab"), (1, "abab"), (1, "zz"), (None, ""), (None, "null id")]
    key = lambda r: (r[0] is None, *map(str, r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected(order), key=key)
    lone = lz.edited_likeness(docs_of(spark, ["only one text"])).collect()
    assert [tuple(r) for r in lone] == expected([(0, "only one text")])
    assert lz.edited_likeness(spark.createDataFrame([], DOCS)).count() == 0
    assert lz.fingerprints(docs_of(spark, ["a", "a", None])).select("fingerprint").distinct().count() == 2
