import random
import re

import numpy as np
import xxhash
from helpers import DOCS, docs_of, odd_texts, with_clashing_columns, words

from logarbor.llm import simhash
from logarbor.llm.components import components


def reference_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not own:
        return 0
    shingles = [" ".join(own[i:i + k]) for i in range(max(1, len(own) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_groups(fps, bits):
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                group[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_the_definition():
    for t in odd_texts():
        assert simhash.fingerprint(t) == reference_fingerprint(t)


def test_shard_links_equal_brute_force():
    rng = random.Random(3)
    for _ in range(6):
        fps = [rng.getrandbits(64) for _ in range(400)]
        for f in rng.sample(fps, 100):  # chains and clusters of neighbours
            for _ in range(rng.randrange(1, 8)):
                f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
                fps.append(f)
        fps = sorted(set(fps), key=lambda _: rng.random())
        x = np.array(fps, dtype=np.uint64)
        root = simhash.link_shard(x, np.ones(len(x), dtype=bool), 3)
        want = reference_groups(fps, 3)
        pairs = {(root[i] == root[j]) == (want[i] == want[j]) for i in range(len(x)) for j in range(0, len(x), 7)}
        assert pairs == {True}


def test_groups_equal_brute_force_over_many_shards(spark):
    rng = random.Random(5)
    texts = odd_texts()
    for t in [words(rng, 300) for _ in range(60)]:
        texts.append(t)
        for _ in range(rng.randrange(0, 4)):
            own = t.split()
            own[rng.randrange(len(own))] = "edited"
            t = " ".join(own)
            texts.append(t)
    rows = simhash.near_groups(docs_of(spark, texts), shard_classes=16).collect()
    assert len(rows) == len(texts)
    want = reference_groups([reference_fingerprint(t) for t in texts], 3)
    got = {r.doc_id: r.component_id for r in rows}
    assert [got[i] for i in range(len(texts))] == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(5, a, "en", "s", 1), (3, a, "en", "s", 1), (3, a, "en", "s", 1), (None, a, "en", "s", 1),
            (None, b, "en", "s", 2), (9, None, "en", "s", 0), (8, "", None, None, None)]
    docs = with_clashing_columns(spark.createDataFrame(rows, DOCS))
    out = simhash.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted([(3, a), (-1, b), (8, "")])
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0
    groups = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert groups == {(5, 3), (3, 3), (None, 3), (None, None), (9, 8), (8, 8)}
