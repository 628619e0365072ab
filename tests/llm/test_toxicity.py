import random
import zlib

import numpy as np
from helpers import DOCS, odd_texts, with_clashing_columns, words

from logarbor.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_slots_are_the_ngrams_of_blocks(monkeypatch):
    rng = random.Random(1)
    text = words(rng, 500)
    whole = toxicity.slots(text)
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert np.array_equal(np.sort(toxicity.slots(text)), whole)
    assert len(toxicity.slots("")) == len(toxicity.slots(None)) == 0
    assert np.array_equal(toxicity.slots("Ab  cd\n"), toxicity.slots("aB cd"))


def test_log_count_ratio_scaling():
    """A slot only in toxic texts gets a positive weight, one only in clean texts a negative one."""
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(200):
        labels.append(i % 2)
        texts.append(words(rng, 20) + (" grumpf " if i % 2 else " flower "))
    model = toxicity.fit_rows(texts, np.array(labels))
    assert model.weights[toxicity.slots("grumpf")].sum() > 0 > model.weights[toxicity.slots("flower")].sum()


def corpus(n=700):
    rng = random.Random(3)
    bad = ["moronic", "scumbag", "idiotic", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        own = words(rng, rng.randrange(20, 120)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    labels += [(10_000, 1, 1), (None, 1, 1), (3, 1, None), (4, 1, 7)]
    docs = with_clashing_columns(spark.createDataFrame(rows, DOCS))
    out = toxicity.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels[:len(rows)]}
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a = toxicity.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    b = toxicity.classify(docs, spark.createDataFrame(flipped, LABELS)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_scores_depend_on_the_text_alone(spark):
    rows, labels = corpus(300)
    texts = odd_texts()
    docs = spark.createDataFrame(rows + [(None, t, None, None, None) for t in texts + texts], DOCS)
    out = toxicity.classify(docs, spark.createDataFrame(labels, LABELS))
    models = toxicity.fit(docs, spark.createDataFrame(labels, LABELS).where(~toxicity.held_out()))
    nulls = sorted(r.score for r in out.where("doc_id IS NULL").collect())
    want = sorted(toxicity.score_text(t, models) for t in texts + texts)
    assert np.allclose(nulls, want)
    assert out.where("held_out IS NULL OR score IS NULL").count() == 0


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a", "", "", 1), (2, None, "", "", 1)], DOCS)
    none = toxicity.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert [r.predicted for r in none] == [0, 0]
    clean = toxicity.classify(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert [r.predicted for r in clean] == [0, 0]
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0
