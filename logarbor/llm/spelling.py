"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

A word's vector holds how often each group of letters occurs in it. One inserted, deleted
or replaced code point changes it by a surplus of at most one and a deficit of at most
one. The vectors of all words form a trie, one group a level:

1. One pass counts words; a batch's counts are merged before the shuffle.
2. The top of the trie, fitted on a bounded sample of words, deals them into shards. Each
   word is at home in one shard and, as a query, spends its surplus and deficit on the way
   down and visits every shard it can reach. A leaf whose words share all counts is dealt
   over several shards by hash; a query visits them all.
3. Each shard goes on with the trie of its home words, depth first, with all queries that
   still have budget; words of a small node or a leaf are verified by their letters.
4. Each query keeps its number of near words and the best one of a shard; no pairs leave it.

The sample decides only where words meet; results are exact for any sample. Forms are
followed to roots by pointer doubling: n grows at least ``ratio`` times a step, so a few
joins do.

Null text: no words. A null doc_id counts as an empty one in the crc. Repeated rows count
each time. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logarbor.llm.tools import written

PATTERN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
TYPO_EVERY = 199
RATIO = 5
WORDS_TOGETHER = 200_000   # distinct words counted before they are handed on
SHARD_WORDS = 8192         # words at home in a shard, about
SAMPLE_PER_SHARD = 64      # words that fit the top of the trie, for each shard
MAX_SAMPLE = 131_072       # and at most so many (a few MB on the driver)
SMALL_NODE = 48            # home words of a node that are verified without going deeper
PAIRS = 1 << 18            # pairs compared at once
# Fixed value: the letter groups in trie order, frequent letters alone; all others are the last group.
GROUPS = ("e", "t", "a", "o", "i", "n", "h", "r", "s", "d", "l", "u", "cm", "gw", "fyp", "bvk", "jqxz")


# ---------------------------------------------------------------- words
def with_typo(word: str, crc: int, every: int = TYPO_EVERY) -> str:
    """``word`` without its code point ``crc % length`` where ``every`` divides ``crc``."""
    at = crc % len(word)
    return word if crc % every else word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, *, pattern: str = PATTERN, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur at least ``min_count`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, crc32, seen = re.compile(pattern), zlib.crc32, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = crc32(b"%d:" % doc_id if doc_id is not None else b":")
                # bytes.lower changes A-Z alone
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                for word, n in found.items():
                    if len(word) < min_length:
                        continue
                    h = crc32(word.encode(), start)
                    if not h % every:
                        word = with_typo(word, h, every)
                        if len(word) < min_length:
                            continue
                    seen[word] = seen.get(word, 0) + n
                if len(seen) >= WORDS_TOGETHER:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return (texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


# ---------------------------------------------------------------- vectors and the top of the trie
class Words:
    """Code points and letter-group counts of a list of words."""

    def __init__(self, words: list[str], groups: tuple[str, ...] = GROUPS) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(words) else self.size
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        table = np.full(257, len(groups), np.int64)
        for g, letters in enumerate(groups):
            table[[ord(x) for x in letters]] = g
        width = len(groups) + 1
        cell = np.repeat(np.arange(len(words)) * width, self.size) + table[np.minimum(self.codes, 256)]
        self.vectors = np.bincount(cell, minlength=len(words) * width).reshape(len(words), width).astype(np.int32)


def top_trie(vectors: np.ndarray, words: int, shard_words: int):
    """Lists of children by count (the last one for all greater counts), down to leaves (first shard, shards)."""
    weight, shards = words / max(1, len(vectors)), iter(range(1 << 62))

    def build(v: np.ndarray, level: int):
        if len(v) * weight > shard_words and level < vectors.shape[1]:
            counts = v[:, level]
            if counts.max() == 0:
                return [build(v, level + 1)]
            return [build(v[counts == c], level + 1) for c in range(counts.max())] + [
                build(v[counts == counts.max()], level + 1)]
        parts = max(1, -(-int(len(v) * weight) // (2 * shard_words))) if level == vectors.shape[1] else 1
        return next(shards), [next(shards) for _ in range(parts - 1)]

    return build(vectors, 0)


def route(trie, vectors: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, whether at home there) of the words; queries spend a surplus and a deficit of one each."""
    n = len(vectors)
    todo = [(trie, 0, np.arange(n), np.ones(n, bool), np.ones(n, bool), np.ones(n, bool))]
    while todo:
        node, level, idx, more, less, home = todo.pop()
        if not len(idx):
            continue
        if isinstance(node, tuple):
            parts = [node[0], *node[1]]
            own = keys[idx] % np.uint64(len(parts))
            for k, shard in enumerate(parts):
                yield shard, idx, home & (own == k)
            continue
        count, last = vectors[idx, level], len(node) - 1
        mine = np.minimum(count, last)
        up, down = np.minimum(count + 1, last), np.minimum(np.maximum(count - 1, 0), last)
        for c, child in enumerate(node):
            same, rise, fall = mine == c, more & (up == c) & (mine != c), less & (down == c) & (mine != c)
            hit = same | rise | fall
            todo.append((child, level + 1, idx[hit], (more & ~rise)[hit], (less & ~fall)[hit], (home & same)[hit]))


# ---------------------------------------------------------------- a shard
def one_apart(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words ``a[i]`` and ``b[j]`` differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(i), bool)
    la, lb = a.size[i], b.size[j]
    for swap in (False, True):  # the word of the left side is not the longer one
        x, y, ix, iy, lx, ly = (b, a, j, i, lb, la) if swap else (a, b, i, j, la, lb)
        fits = (ly == lx + 1) if swap else (ly == lx) | (ly == lx + 1)
        for length in np.unique(lx[fits]).tolist():
            some = np.flatnonzero(fits & (lx == length))
            step = max(1, (PAIRS * 16) // (length + 1))
            for k in range(0, len(some), step):
                p = some[k:k + step]
                columns = np.arange(length)
                left = x.codes[x.at[ix[p]][:, None] + columns]
                right = y.codes[y.at[iy[p]][:, None] + columns]
                same = left == right
                longer = ly[p] > length
                out[p] = ~longer & (same.sum(axis=1) == length - 1)
                if longer.any():
                    q, same = p[longer], same[longer]
                    ahead = left[longer] == y.codes[y.at[iy[q]][:, None] + columns + 1]
                    prefix = np.where(same.all(axis=1), length, np.argmin(same, axis=1)) if length else np.zeros(len(q), int)
                    tail = ahead[:, ::-1]
                    suffix = np.where(tail.all(axis=1), length, np.argmin(tail, axis=1)) if length else prefix
                    out[q] = prefix + suffix >= length
    return out


def near_pairs(home: Words, queries: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, home) indices of words one apart, depth first through the trie of the home words' vectors."""
    order = np.lexsort(home.vectors.T[::-1])
    v, levels = home.vectors[order], home.vectors.shape[1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def verified():
        i, j = (np.concatenate(x) for x in zip(*found))
        ok = one_apart(queries, i, home, j)
        found.clear()
        return i[ok], j[ok]

    n = len(queries.vectors)
    todo = [] if not len(v) else [(0, len(v), 0, np.arange(n), np.ones(n, np.int32), np.ones(n, np.int32))]
    while todo:
        lo, hi, level, idx, more, less = todo.pop()
        if not len(idx):
            continue
        if hi - lo <= SMALL_NODE or level == levels:
            width = max(1, PAIRS // max(1, len(idx)))
            rows = max(1, PAIRS // min(width, hi - lo))
            for a in range(lo, hi, width):
                z = min(hi, a + width)
                for k in range(0, len(idx), rows):
                    own = idx[k:k + rows]
                    change = v[a:z, level:][None, :, :] - queries.vectors[own, level:][:, None, :]
                    rise = np.maximum(change, 0).sum(axis=2, dtype=np.int32)
                    ok = (rise <= more[k:k + rows, None]) & (rise - change.sum(axis=2, dtype=np.int32) <= less[k:k + rows, None])
                    q, h = np.nonzero(ok)
                    found.append((own[q], order[a + h]))
                    held += len(q)
                    if held >= PAIRS * 4:
                        yield verified()
                        held = 0
            continue
        column = v[lo:hi, level]
        at = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        asked = queries.vectors[idx, level]
        for a, b in zip(at, np.append(at[1:], hi - lo)):
            change = column[a] - asked
            alive = (change == 0) | ((change == 1) & (more > 0)) | ((change == -1) & (less > 0))
            todo.append((lo + a, lo + b, level + 1, idx[alive], (more - (change == 1))[alive],
                         (less - (change == -1))[alive]))
    if found:
        yield verified()


def shard_best(rows: pa.Table) -> pa.Table:
    """Each query's number of near home words, and the one of largest n (ties: the smallest word)."""
    asked, at_home = rows.column("word").to_pylist(), rows.column("home").to_numpy()
    n = rows.column("n").to_numpy()[at_home]
    words = [w for w, h in zip(asked, at_home) if h]
    best_first = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), np.int64)
    rank = np.empty(len(words), np.int64)
    rank[best_first] = np.arange(len(words))
    near = np.zeros(len(asked), np.int64)
    best = np.full(len(asked), len(words), np.int64)
    for i, j in near_pairs(Words(words), Words(asked)):
        near += np.bincount(i, minlength=len(asked))
        np.minimum.at(best, i, rank[j])
    hit = np.flatnonzero(near)
    chosen = best_first[best[hit]]
    return pa.table({"word": pa.array([asked[i] for i in hit], pa.string()), "near": pa.array(near[hit], pa.int64()),
                     "best_n": pa.array(n[chosen], pa.int64()), "best": pa.array([words[k] for k in chosen], pa.string())})


def near_words(counts: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best): ``best`` is a struct (minus n, word) of the near word of largest n."""
    total = counts.count()
    shards = -(-total // shard_words)
    sample = [r[0] for r in counts.select("word").orderBy(F.xxhash64("word"), "word")
              .limit(min(MAX_SAMPLE, SAMPLE_PER_SHARD * max(1, shards))).collect()]
    trie = top_trie(Words(sample).vectors, total, shard_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            keys = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
            for shard, idx, home in route(trie, Words(words).vectors, keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), shard, np.int64)), b.column(0).take(pa.array(idx)),
                     b.column(1).take(pa.array(idx)), pa.array(home)], names=["shard", "word", "n", "home"])

    best = (counts.select("word", "n").mapInArrow(deal, "shard bigint, word string, n bigint, home boolean")
            .groupBy("shard").applyInArrow(shard_best, "word string, near bigint, best_n bigint, best string"))
    return best.groupBy("word").agg(F.sum("near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form."""
    steps = written(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        steps = longer.drop("moved")
        if not moved:
            return steps


def variants(docs: DataFrame, *, ratio: int = RATIO, shard_words: int = SHARD_WORDS, **counting) -> DataFrame:
    """word, n, n_near, form, form_n, root for every counted word of ``docs``."""
    counts = written(word_counts(docs, **counting))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    forms = written(counts.join(near_words(counts, shard_words=shard_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        form["word"].alias("form"), (-form["n"]).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
