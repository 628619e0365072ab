"""Fixtures of the operator tests: small tables with nulls, empty and long texts, repeats and clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def doc_rows(texts, start=0):
    return [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame(doc_rows(texts, start), DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=7):
    """Null, empty, blank, short, long, repeated, multilingual and marker texts."""
    rng = random.Random(seed)
    return [None, "", " \n\t ", "a", "ab", "Aa aA", words(rng, 60), words(rng, 60), words(rng, 9000), "x" * 5000,
            "Ünïcödé 中文 テスト 🙂🙂 ñandú", "same text here twice", "same text here twice", "é" * 3 + " ́combining",
            "line one\nline two\n\nline  three   end", "<|endoftext|> not the end <|startoftext|>",
            "1234 5678\t9   nbsp", "don't we'll I'd ''s", "\x00nul\x0bvt\x1csep"] + [words(rng, 40) for _ in range(20)]


def with_clashing_columns(df):
    """Columns that the operators also use inside."""
    from pyspark.sql import functions as F

    for name in ("row", "fp", "root", "base", "spans", "added", "contexts", "row_key_0", "range", "ahead", "part",
                 "v", "q", "block", "segment", "messages", "score", "half", "label", "record", "digest", "offset"):
        df = df.withColumn(name, F.lit("clash"))
    return df
