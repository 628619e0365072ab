import random

import numpy as np
import pytest
from helpers import DOCS, odd_texts, with_clashing_columns, words
from test_packing import PATH, check_packed
from test_pii import corpus, near_evidence_added, reference_spans
from test_simhash import reference_fingerprint, reference_groups
from tokenizers import Tokenizer

import corpus_pipeline
from logarbor.llm import packing, pii, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with toxic texts, copies, near copies, personal data and odd texts."""
    rng = random.Random(11)
    texts, toxic = [], []
    for i in range(300):
        t = words(rng, rng.randrange(30, 150), 4000)
        if i % 4 == 0:
            t += " moronic scumbag idiotic " + words(rng, 5, 4000)
        texts.append(t)
        toxic.append(int(i % 4 == 0))
    more = odd_texts() + corpus() + texts[1:40:2] + [" ".join(t.split()[:-1]) for t in texts[2:60:4]]
    where = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + more)] + [(None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int"
                          ).write.parquet(f"{where}/labels.parquet")
    return str(where), rows, toxic


def test_stages_equal_brute_force(spark, folder):
    where, rows, toxic = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    models = toxicity.fit(docs, spark.read.parquet(f"{where}/labels.parquet"))
    kept = [r for r in rows if toxicity.score_text(r[1], models) < 0.5]
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    caught = {i for i, t in enumerate(toxic) if t} & gone
    assert len(caught) > 0.7 * sum(toxic) and len(gone) < len(caught) + 10
    # near-duplicates: the first of each group, in the order of ids, nulls last
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    groups = reference_groups([reference_fingerprint(r[1]) for r in kept], 3)
    kept = [r for i, r in enumerate(kept) if groups[i] == i]
    texts = [r[1] for r in kept]
    added = near_evidence_added(texts)
    assert sum(map(len, added)) > 0
    clean = [None if t is None else pii.apply_spans(t, reference_spans(t) + a) for t, a in zip(texts, added)]
    exact = Tokenizer.from_file(PATH)
    lengths = {}
    for r, t in zip(kept, clean):
        bounds = packing.piece_bounds(len(exact.encode(t or "", add_special_tokens=False).ids) + 1)
        lengths |= {(r[0], k): b for k, b in enumerate(bounds)}
    out = corpus_pipeline.run(spark, where).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in out} == lengths
    assert check_packed(out, packing.CAPACITY) == packing.lower_bound(np.array([r.length for r in out]))


def test_stages_keep_the_columns(spark, folder):
    where, _, _ = folder
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).dtypes == docs.dtypes
    clash = with_clashing_columns(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, where).dtypes == clash.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, where).count() == 0
