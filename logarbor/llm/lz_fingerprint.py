"""Document fingerprints from Lempel-Ziv phrases (LZJD: Raff and Nicholas, 2017).

A text is parsed into LZ78 dictionary phrases: the shortest piece that is not yet a
phrase becomes one. Every phrase is hashed, and the 128 least hashes are the text's
signature. The likeness of two signatures estimates the Jaccard similarity of the
phrase sets; it is exact while both sets are complete in their signatures.

``with_next`` pairs every document with the next by id. Ids are cut into ranges of
fixed width; each text is shuffled once, to its range, and the first document of a
range goes to the range before as well. A task streams its sorted ranges and holds
two documents at a time.

Nulls: a null text is empty (an empty signature; two empty ones have likeness 1);
null ids come last. Rows of equal id follow each other by text. With one row, the
next document is the row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logarbor.llm.tools import small

SIGNATURE = 128
RANGE_IDS = 128
RANGES_PER_BLOCK = 4096
LAST_RANGE = (1 << 62)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 14, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = _Powers()


class Parse:
    """LZ78 parse of a growing text: the phrases seen, the open one, and the hashes of the finished ones."""

    def __init__(self, other: Parse | None = None) -> None:
        self.seen: set[str] = set(other.seen) if other else set()
        self.open = other.open if other else ""
        self.hashes: list[np.ndarray] = list(other.hashes) if other else []

    def feed(self, text: str) -> Parse:
        if not text:
            return self
        whole = self.open + text
        seen, add = self.seen, self.seen.add
        ends, w, i = [], self.open, len(self.open)
        for c in text:
            w += c
            i += 1
            if w not in seen:
                add(w)
                ends.append(i)
                w = ""
        self.open = w
        if ends:
            self.hashes.append(_phrase_hashes(whole[:ends[-1]], np.array(ends)))
        return self

    def signature(self) -> np.ndarray:
        if not self.hashes:
            return np.empty(0, dtype=np.uint32)
        return np.unique(np.concatenate(self.hashes))[:SIGNATURE]


def _phrase_hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """32-bit hash of each phrase: a polynomial of its code points, taken from prefix sums, mixed with its length."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    _POWERS.reach(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _POWERS.up[:len(codes)], dtype=np.uint64)))
    starts = np.concatenate(([0], ends[:-1]))
    h = (sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(text: str | None) -> np.ndarray:
    return Parse().feed(text or "").signature()


def as_text(sig: np.ndarray) -> str:
    """Eight hex digits for each of the signature's hashes, ascending."""
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the least hashes of the union that both hold."""
    both = np.concatenate((a, b))
    if not len(both):
        return 1.0
    both.sort()
    first = np.concatenate(([True], both[1:] != both[:-1]))
    last = np.concatenate((first[1:], [True]))
    shared = ~last[first]  # a value of the union that stands twice
    if len(a) == SIGNATURE or len(b) == SIGNATURE:
        shared = shared[:SIGNATURE]
    return float(shared.mean())


# ---------------------------------------------------------------- on tables
def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([as_text(signature(t.as_py())) for t in b.column(1)], pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, fingerprint string")


def _ranges(docs: DataFrame) -> DataFrame:
    """(head, before): the least id of each range of ids, and the range before it (before the first: the last)."""
    heads = docs.groupBy("range").agg(F.min("doc_id").alias("head")).withColumn(
        "block", F.floor(F.col("range") / RANGES_PER_BLOCK))
    blocks = heads.groupBy("block").agg(F.max("range").alias("top"))
    in_order = Window.orderBy("block")  # one row for each 2**21 ids
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.lag("top").over(in_order), F.max("top").over(everything)).alias("top"))
    before = F.lag("range").over(Window.partitionBy("block").orderBy("range"))
    return (heads.withColumn("before", before).join(blocks, "block")
            .select("head", F.coalesce("before", "top").alias("before")))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, ahead, doc_id, text): ranges whole in one partition, sorted; ``ahead`` rows only follow a range's last."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.floor(F.col("doc_id").cast("bigint") / RANGE_IDS), F.lit(LAST_RANGE)).alias("range"))
    ranges = _ranges(rows.select("doc_id", "range"))
    n = rows.select("range").distinct().count()
    both = rows.join(small(ranges, n), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead"))
    back = F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))
    dealt = both.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own))
                                                    .otherwise(F.array(own, back))).alias("to"))
    return (dealt.select("to.range", "to.ahead", "doc_id", "text").repartition("range")
            .sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), "text"))


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document, its text with the last quarter replaced by the next document's first characters, and likenesses."""
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, kept length, parse of the kept part, signature)
        for b in batches:
            out = []
            for span, ahead, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if ahead and last is None:
                    continue  # a second candidate for the same place
                text = text.as_py()
                keep = len(text) - len(text) // 4
                kept = Parse().feed(text[:keep])
                sig = Parse(kept).feed(text[keep:]).signature()
                if last is not None and last[0] == span:
                    _, before, was, part, parse, own = last
                    tail = text[:len(was) - part]
                    changed = parse.feed(tail).signature()
                    out.append((before, len(was), hashlib.sha256((was[:part] + tail).encode()).hexdigest(),
                                as_text(own), as_text(changed), likeness(own, changed), likeness(own, sig)))
                last = None if ahead else (span, doc, text, keep, kept, sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return with_next(docs).mapInArrow(run, EDITED)
