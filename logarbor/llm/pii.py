"""Personal data: base patterns plus information-theoretic sanitisation of revealing terms.

Base spans are e-mail, IP, card and phone matches. Each distinct match is a protected
entity. Words within ``window`` words of an entity are its context terms. Over the
whole corpus, with N documents, an entity's information is IC(e) = log2(N / df(e))
and a term reveals PMI(e, t) = log2(N co(e, t) / (df(e) df(t))) of it (Sanchez and
Batet, C-sanitized). A term whose PMI is at least ``generalise_at`` of the IC is
generalised, at least ``remove_at`` removed, wherever it stands in that entity's
context; a pair needs ``support`` documents, so a chance meeting is no evidence.
With ``everywhere`` evidence still comes from the words near an entity, but a revealing
term is marked at each place in all documents that hold its entity: a rare word that
only shares a long document with an entity is left alone, a code name beside it is not.
With a ``window`` of None the whole document is the context of each entity in it, for
the counts and for the marks. Entities that stand in the same documents count alike,
so they are taken together and a text full of entities is no square of pairs.

Counts cover all documents. Term frequencies are counted per task for the words
that hit a fixed 2**24-bit map of the candidate terms, then summed by an exact join,
so what is sent to the tasks does not grow and no other word is shuffled.

Nulls: a null text is empty (no spans); a null doc_id is kept. Repeated rows are
documents of their own. An empty table, or one without entities, adds no spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logarbor.llm.tools import row_keys, small, written

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")
BASE_KINDS = 4
WINDOW = 5
SUPPORT = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
MAP_BITS = 24      # 2 MB; few other words share a bit with a candidate term
CHUNK_BITS = 32768  # of the bitmap that bitmap_construct_agg makes
FLUSH_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[0-9]")


# ---------------------------------------------------------------- base patterns
def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: the local part is the run before an '@'."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):  # a run with fewer dots cannot hold a match that starts later in it
        parts = m.group().split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m.group()))
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _near_words(text: str, start: int, end: int, n: int) -> list[tuple[int, int]]:
    """The n terms before ``start`` and the n after ``end``."""
    width = 40 * n
    while True:
        lo = max(0, start - width)
        before = [m.span() for m in _TERM.finditer(text, lo, start)]
        if lo and before and before[0][0] == lo:
            before = before[1:]  # may have begun earlier
        if len(before) >= n or lo == 0:
            break
        width *= 4
    after = []
    for m in _TERM.finditer(text, end):
        after.append(m.span())
        if len(after) == n:
            break
    return before[-n:] + after


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> list[dict]:
    """Each (entity, term) occurrence within ``window`` words; words that touch a base span are no terms."""
    out = []
    taken = [(s, e) for s, _, e in spans]
    for s, kind, e in spans:
        value = _value(text, (s, kind, e))
        for a, b in _near_words(text, s, e, window):
            if not any(a < y and x < b for x, y in taken):
                out.append({"entity": value, "term": text[a:b].lower(), "start": a, "end": b})
    return out


# ---------------------------------------------------------------- corpus passes
def _value(text: str, span: tuple[int, int, int]) -> str:
    """The entity that a base span names."""
    s, kind, e = span
    return f"{KINDS[kind]}:{text[s:e].lower() if kind < 2 else ''.join(_DIGIT.findall(text[s:e]))}"


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Each term of the text that touches no base span, without an entity; ``spans`` by start."""
    out, ends, at = [], 0, 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            ends = max(ends, spans[at][2])
            at += 1
        if ends <= a:
            out.append({"entity": None, "term": m.group().lower(), "start": a, "end": b})
    return out


def scan(docs: DataFrame, *, window: int | None = WINDOW, keep: tuple[str, ...] = ("doc_id",),
         everywhere: bool = False) -> DataFrame:
    """``row``, the columns of ``keep``, ``base`` spans, ``entities`` and ``contexts``, as a written table.

    With ``everywhere`` also ``terms``: all occurrences, in texts that hold an entity.
    """
    @F.pandas_udf("base array<struct<kind:int,start:bigint,end:bigint>>, entities array<string>, "
                  "contexts array<struct<entity:string,term:string,start:bigint,end:bigint>>, "
                  "terms array<struct<entity:string,term:string,start:bigint,end:bigint>>")
    def find(text: pd.Series) -> pd.DataFrame:
        base, entities, near, terms = [], [], [], []
        for t in text:
            spans = base_spans(t) if t else []
            base.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            entities.append(sorted({_value(t, s) for s in spans}))
            near.append((occurrences(t, spans) if window is None else contexts(t, spans, window)) if spans else [])
            terms.append(occurrences(t, spans) if spans and everywhere else [])
        return pd.DataFrame({"base": base, "entities": entities, "contexts": near, "terms": terms})

    found = docs.select(*keep, find(F.col("text").cast("string")).alias("found"))
    return written(found.select(F.monotonically_increasing_id().alias("row"), *keep, "found.base", "found.entities",
                                "found.contexts", *(["found.terms"] if everywhere else [])))


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): documents that hold each of ``terms``, a table of distinct terms."""
    size = 1 << MAP_BITS
    slot = F.pmod(F.xxhash64("term"), F.lit(size))
    chunks = (terms.select(slot.alias("slot")).groupBy(F.expr(f"slot div {CHUNK_BITS}").alias("chunk"))
              .agg(F.bitmap_construct_agg(F.col("slot") % CHUNK_BITS).alias("bits")).collect())  # the map's bytes at most
    hits = bytearray(size // 8)
    for c in chunks:
        hits[c["chunk"] * CHUNK_BITS // 8:(c["chunk"] + 1) * CHUNK_BITS // 8] = c["bits"]
    bits = docs.sparkSession.sparkContext.broadcast(bytes(hits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").tobytes()
        digest, mask = xxhash.xxh64_intdigest, size - 1
        df: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())],
                                              names=["term", "df"])

        for b in batches:
            for t in b.column(0):
                words = {w.lower() for w in _TERM.findall(t.as_py() or "")}
                df.update([w for w in words if wanted[digest(w.encode(), 42) & mask]])
            if len(df) > FLUSH_TERMS:
                yield out()
                df.clear()
        yield out()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "term string, df bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term", "left_semi")


def revealing_terms(docs: DataFrame, scanned: DataFrame, *, support: int = SUPPORT,
                    generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(entity, term, kind): pairs whose share PMI / IC reaches a threshold; kind 4 generalised, 5 removed."""
    n = scanned.count()
    met = scanned.select("row", F.explode("contexts").alias("c")).select("row", "c.entity", "c.term").distinct()
    pairs = written(met.groupBy("entity", "term").agg(F.count("*").alias("co")).where(F.col("co") >= support))
    entities = (scanned.select("row", F.explode(F.array_distinct(F.col("contexts.entity"))).alias("entity"))
                .groupBy("entity").agg(F.count("*").alias("df_e")))
    df = term_frequencies(docs, pairs.select("term").distinct())
    ic = F.log2(F.lit(float(n)) / F.col("df_e"))
    share = F.log2(F.col("co") * F.lit(float(n)) / (F.col("df_e") * F.col("df"))) / ic
    return (pairs.join(entities, "entity").join(df, "term").where(F.col("df_e") < n)
            .withColumn("share", share).where(F.col("share") >= generalise_at)
            .select("entity", "term", F.when(F.col("share") >= remove_at, 5).otherwise(4).alias("kind"), "share"))


def _revealed(docs: DataFrame, scanned: DataFrame, *, support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
              remove_at: float = REMOVE_AT) -> DataFrame:
    """(row, term, kind): the terms that reveal an entity of their row, co-occurrence over whole documents."""
    n = scanned.count()
    held = scanned.select("row", F.explode("entities").alias("entity"))
    # entities of the same documents have the same counts with every term: one group, named by its documents' hashes
    group = ["df_e", "set_0", "set_1"]
    groups = held.join(held.groupBy("entity").agg(
        F.count("*").alias("df_e"), F.bit_xor(F.xxhash64("row")).alias("set_0"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("set_1")), "entity").where(F.col("df_e") < n)
    groups = groups.select("row", *group).distinct()
    words = written(scanned.select("row", F.explode(F.array_distinct(F.col("contexts.term"))).alias("term")))
    ic = F.log2(F.lit(float(n)) / F.col("df_e"))

    def share(co: Column) -> Column:
        return F.log2(co * F.lit(float(n)) / (F.col("df_e") * F.col("df"))) / ic

    # a pair cannot pass if it would not with the most documents it may share
    met = written(words.join(term_frequencies(docs, words.select("term").distinct()), "term").join(groups, "row")
                  .where(share(F.least("df_e", "df")) >= generalise_at))
    pairs = (met.groupBy(*group, "term", "df").agg(F.count("*").alias("co")).where(F.col("co") >= support)
             .withColumn("share", share(F.col("co"))).where(F.col("share") >= generalise_at)
             .select(*group, "term", F.when(F.col("share") >= remove_at, 5).otherwise(4).alias("kind")))
    return met.join(pairs, [*group, "term"]).groupBy("row", "term").agg(F.max("kind").alias("kind"))


def _near_evidence(docs: DataFrame, scanned: DataFrame, *, support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
                   remove_at: float = REMOVE_AT) -> DataFrame:
    """(row, marks): the terms, with their kind, that reveal an entity of the row by standing near it in some document."""
    n = scanned.count()
    held = scanned.select("row", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") < n)
    met = scanned.select("row", F.explode("contexts").alias("c")).select("row", "c.entity", "c.term").distinct()
    co = met.groupBy("entity", "term").agg(F.count("*").alias("co")).where(F.col("co") >= support)

    def share(df: Column) -> Column:
        return (F.log2(F.col("co") * F.lit(float(n)) / (F.col("df_e") * df))
                / F.log2(F.lit(float(n)) / F.col("df_e")))

    # no term stands in fewer documents than in those that hold an entity: what cannot pass with these is not counted
    least = (scanned.select(F.explode(F.array_distinct(F.col("terms.term"))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("least")))
    pairs = written(co.join(entities, "entity").join(least, "term").where(share(F.col("least")) >= generalise_at)
                    .drop("least"))
    df = term_frequencies(docs, pairs.select("term").distinct())
    reveal = (pairs.join(df, "term").withColumn("share", share(F.col("df")))
              .where(F.col("share") >= generalise_at)
              .select("entity", "term", F.when(F.col("share") >= remove_at, 5).otherwise(4).alias("kind")))
    return (held.join(reveal, "entity").groupBy("row", "term").agg(F.max("kind").alias("kind"))
            .groupBy("row").agg(F.collect_list(F.struct("term", "kind")).alias("marks")))


def _added(docs: DataFrame, scanned: DataFrame, window: int | None, everywhere: bool = False, **thresholds) -> DataFrame:
    """(row, start, kind, end): occurrences of revealing terms in the contexts of their entities."""
    if everywhere:
        marked = scanned.where(F.size("entities") > 0).select("row", "terms").join(
            _near_evidence(docs, scanned, **thresholds), "row")
        kind = F.map_from_entries("marks")
        hits = F.transform(F.filter("terms", lambda t: F.array_contains("marks.term", t["term"])), lambda t: F.struct(
            t["start"].alias("start"), F.element_at(kind, t["term"]).alias("kind"), t["end"].alias("end")))
        return marked.select("row", F.explode(hits).alias("hit")).select("row", "hit.*")
    met = scanned.select("row", F.explode("contexts").alias("c")).select("row", "c.*")
    if window is None:
        return met.join(_revealed(docs, scanned, **thresholds), ["row", "term"]).select("row", "start", "end", "kind")
    reveal = written(revealing_terms(docs, scanned, **thresholds))
    return (met.join(reveal, ["entity", "term"])
            .groupBy("row", "start", "end").agg(F.max("kind").alias("kind")))


def find_spans(docs: DataFrame, *, window: int | None = WINDOW, everywhere: bool = False, **thresholds) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (base and added), arrays of (start, kind, end) by start, then kind.

    ``thresholds``: support, generalise_at, remove_at of ``revealing_terms``.
    """
    scanned = scan(docs, window=window, everywhere=everywhere)
    added = _added(docs, scanned, window, everywhere, **thresholds).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    ordered = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                     s["end"].alias("end")))
    return (scanned.join(added, "row", "left").withColumn("base", F.array_sort(ordered))
            .select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base"))
                    .otherwise(F.array_sort(F.concat("base", "added"))).alias("spans")))


def span_text(spans: str) -> Column:
    """'kind:start:end' of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apply_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each (start, kind, end) replaced by its kind's mark; overlapping spans by the first one's."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += (text[at:start], MARKS[kind])
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, window: int | None = WINDOW, everywhere: bool = False, **thresholds) -> DataFrame:
    """``docs`` with the columns it has, all spans replaced in ``text``, and ``n_chars`` (if any) counted anew."""
    keyed, names = row_keys(docs)
    scanned = scan(keyed, window=window, keep=tuple(names), everywhere=everywhere)
    spans = written(_added(docs, scanned, window, everywhere, **thresholds).join(scanned.select("row", *names), "row"))
    added = spans.groupBy(*names).agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, added: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else apply_spans(
            t, base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in (() if a is None else a)])
            for t, a in zip(text, added)], dtype=object)

    (mark,) = [n for n in ("added", "added_", "added__") if n not in docs.columns][:1]
    joined = keyed.join(small(added.withColumnRenamed("added", mark), spans.count()), names, "left")
    clean = replace(F.col("text").cast("string"), mark)
    out = joined.select(*(clean.alias(c) if c == "text" else F.col(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out
