"""SimHash near-duplicates through vantage-point trees: exact pairs within a Hamming distance.

1. One pass fingerprints every whole text (XXH64 of word shingles, bit majority).
2. Equal fingerprints form a class; only class fingerprints are compared.
3. The top of a vantage-point tree, built on a bounded sample, deals the classes
   into shards: a vantage point and a radius split each node into inside
   (d <= radius) and outside. By the triangle inequality, two fingerprints within
   ``bits`` of each other can fall on both sides only if their distances lie
   within ``bits`` of the radius; such inside points also visit the outside shard.
4. Each shard continues the tree down to leaves, prunes by the same bounds, and
   compares what is left. It returns a spanning set of its links, not all pairs,
   so a large group of near copies costs one link a member.
5. Connected components over the links; a document's component is the smallest
   doc_id of its group.

The fitted top tree only decides where pairs meet; results are exact for any sample.
Nulls: a null text has no words (fingerprint 0, linked like any other); a null
doc_id is kept as a row and ignored in the minimum (null if the group has no id).
Repeated rows are one class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logarbor.llm.components import components
from logarbor.llm.tools import row_keys, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SHARD_CLASSES = 8192      # classes at home in a shard, about
SAMPLE_PER_SHARD = 32     # fingerprints that fit the top tree, for each shard
MAX_SAMPLE = 131_072      # and at most so many (1 MB on the driver)
LEAF = 192
BLOCK = 1 << 20           # distances computed at once


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    words = (text or "").encode().lower().split()  # both act on ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        octets = hashes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, the columns ``keep``, and fp (the fingerprint's bits as a signed long), one row per row of ``docs``."""
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
                         .view(np.int64))

    return docs.select(F.col("doc_id").cast("bigint"), *keep, of(F.col("text").cast("string")).alias("fp"))


# ---------------------------------------------------------------- vantage-point tree
def _distance(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ p).astype(np.int64)


def _split(x: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius for ``x``: of a few candidates, the one whose distances spread most."""
    best, found = -1.0, None
    probe = x[:: max(1, len(x) // 2048)]
    for p in x[:: max(1, len(x) // 6)][:6]:
        d = _distance(probe, p)
        radius = int(np.median(d))
        if radius >= d.max():
            radius = int(d.max()) - 1
        spread = float(np.mean(np.abs(d - radius) > MAX_BITS)) if (d <= radius).any() else -1.0
        if spread > best:
            best, found = spread, (p, radius)
    return found


def top_tree(sample: np.ndarray, shards: int):
    """Nested (vantage, radius, inside, outside) with shard numbers as leaves."""
    count = iter(range(shards * 2 + 1))

    def build(x: np.ndarray, want: int):
        split = _split(x) if want > 1 and len(x) > 8 else None
        if split is None:
            return next(count)
        inside = _distance(x, split[0]) <= split[1]
        return (*split, build(x[inside], want // 2), build(x[~inside], want - want // 2))

    return build(sample, shards)


def _route(tree, x: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, whether at home there) for the points of ``x``."""
    todo = [(tree, np.arange(len(x)), np.ones(len(x), dtype=bool))]
    while todo:
        node, idx, home = todo.pop()
        if not len(idx):
            continue
        if isinstance(node, int):
            yield node, idx, home
            continue
        p, radius, inside, outside = node
        d = _distance(x[idx], p)
        into = np.where(home, d <= radius, d - bits <= radius)
        out = d + bits > radius
        todo.append((inside, idx[into], home[into]))
        todo.append((outside, idx[out], (home & (d > radius))[out]))


class _Forest:
    """Local components, joined by whole arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            a, b, i, j = a[differ], b[differ], i[differ], j[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def link_shard(x: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Root index of each point after joining all home-home and visitor-home pairs within ``bits``."""
    forest = _Forest(len(x))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        rows = max(1, BLOCK // max(1, len(right)))
        for k in range(0, len(left), rows):
            part = left[k:k + rows]
            i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[right][None, :]) <= bits)
            forest.join(part[i], right[j])

    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        split = _split(x[own]) if len(own) > LEAF else None
        if split is None:
            compare(own, own)
            compare(guests, own)
            continue
        p, radius = split
        d, g = _distance(x[own], p), _distance(x[guests], p)
        inside = d <= radius
        todo.append((own[inside], guests[g - bits <= radius]))
        todo.append((own[~inside], np.concatenate([guests[g + bits > radius], own[inside & (d + bits > radius)]])))
    return forest.root


def near_links(classes: DataFrame, *, bits: int = MAX_BITS, shard_classes: int = SHARD_CLASSES) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fp`` within ``bits`` of each other."""
    n = classes.count()
    shards = 1 << max(0, -(-n // shard_classes) - 1).bit_length()
    sample = [r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp")
              .limit(min(MAX_SAMPLE, SAMPLE_PER_SHARD * shards)).collect()]
    tree = top_tree(np.array(sample, dtype=np.int64).view(np.uint64), shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for shard, idx, home in _route(tree, fps.view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), shard, np.int32)), pa.array(fps[idx]), pa.array(home)],
                    names=["shard", "fp", "home"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        root = link_shard(fps.view(np.uint64), pdf["home"].to_numpy(bool), bits)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": fps[moved], "b": fps[root[moved]]})

    return (classes.select("fp").mapInArrow(route, "shard int, fp bigint, home boolean")
            .groupBy("shard").applyInPandas(link, "a bigint, b bigint"))


def _grouped(fps: DataFrame, bits: int, shard_classes: int) -> DataFrame:
    """``fps`` with ``root`` (a key of the group) and ``component_id``."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(near_links(classes, bits=bits, shard_classes=shard_classes))
    rooted = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    labels = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(labels, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, seed: int = SEED,
                shard_classes: int = SHARD_CLASSES) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    fps = written(fingerprints(docs, shingle=shingle, seed=seed))
    return _grouped(fps, bits, shard_classes).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, seed: int = SEED,
                      shard_classes: int = SHARD_CLASSES) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (a null one only if the group has no other)."""
    keyed, names = row_keys(docs)
    fps = written(fingerprints(keyed, *names, shingle=shingle, seed=seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), *names))
    keep = _grouped(fps, bits, shard_classes).groupBy("root").agg(first.alias("row")).select(
        *(f"row.{n}" for n in names))
    # of repeated rows one; the window runs on the join's own partitioning
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    kept = keyed.join(keep, names)
    return kept.select(*docs.columns, nth.alias(names[0])).where(F.col(names[0]) == 1).select(*docs.columns)
