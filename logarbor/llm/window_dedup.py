"""Repeated passages removed: a count-min prefilter of word windows, then exact groups of what it lets through.

A window is ``window`` consecutive words of one document. A word goes if a window over it
also starts in a document with a smaller doc_id. Texts are dealt into blocks once, and
five steps pass only packed arrays between blocks and hash ranges:

1. A block hashes its windows to 128 bits and keeps a sketch: the cells (leading bits of
   the hash) it holds, each with a count of documents that stops at two. The sketch has
   one row of some 32 times as many cells as there are windows, stored sparse.
2. The sketches of all blocks are merged range by range. A cell's sum is at least the
   number of documents of each window in it, so no repeated window has a sum under two;
   the block gets one bit a cell back.
3. A block sends the 128-bit keys of the windows in cells of two or more, each once with
   its least doc_id.
4. A range groups equal keys exactly and answers one bit a key: is there a smaller doc_id
   in another block?
5. The block marks words and joins the kept ones.

Blocks and ranges are filled by hashes, so a passage that stands in a third of all
documents is one entry of each block. Nothing is sent to the driver but the size.

Null text: no words. A null doc_id has no smaller or greater one: such a row keeps its
words and removes none. Rows of equal doc_id are one document for the comparison. Short
texts have no window and are kept. An empty table gives an empty result. Other columns
are not read. ``docs`` should be a stored table, as rows are numbered while it is read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_CHARS = 4 << 20       # text of a block, about
RANGE_WINDOWS = 4 << 20     # windows in a hash range, at most about
SPARE_BITS = 5              # cells of the sketch: 2**5 times the windows or more
LONG_WORD = 64              # bytes
MIX = 0xBF58476D1CE4E5B9
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

PIECES = "range int, block int, body binary"
ANSWERS = "block int, step int, range int, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _bits_for(n: float) -> int:
    return max(0, int(n) - 1).bit_length()


def _pack(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned values as gaps of the narrowest width."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    top = int(gaps[1:].max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + int(gaps[0]).to_bytes(8, "little") + gaps[1:].astype(f"<u{width}").tobytes()


def _unpack(body: memoryview, n: int) -> tuple[np.ndarray, int]:
    width, first = body[0], int.from_bytes(body[1:9], "little")
    gaps = np.empty(n, np.uint64)
    gaps[0] = first
    gaps[1:] = np.frombuffer(body, f"<u{width}", n - 1, 9)
    return np.cumsum(gaps, dtype=np.uint64), 9 + (n - 1) * width


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _starts(new: np.ndarray) -> np.ndarray:
    """Positions where a run of equal values begins; ``new`` tells it for all but the first value."""
    return np.flatnonzero(np.concatenate(([True], new)))


class Spans:
    """Words of a column of texts, as places in its bytes."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        column = pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks()
        _, places, data = column.buffers()
        bounds = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        inside = ~_BLANK[self.data]
        inside[:bounds[0]] = inside[bounds[-1]:] = False
        cut = np.zeros(len(inside) + 1, bool)  # a text begins or ends here
        cut[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.lengths -= self.starts
        self.offsets = np.searchsorted(self.starts, bounds)  # first word of each text

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes' hashes, mixed; words over LONG_WORD bytes by XXH3."""
        table = np.array([xxhash.xxh3_64_intdigest(bytes([c]), seed) for c in range(256)], np.uint64)
        p, out = np.uint64(MULTIPLIERS[seed]), np.empty(len(self.starts), np.uint64)
        size = np.minimum(self.lengths, LONG_WORD + 1).astype(np.uint8)
        order = np.argsort(~size, kind="stable")  # long ones first
        at, total = self.starts[order], np.zeros(len(order), np.uint64)
        longer = len(order) - np.cumsum(np.bincount(size, minlength=LONG_WORD + 2))  # words of more than k bytes
        for k in range(LONG_WORD):
            n = int(longer[k])
            if not n:
                break
            part = total[:n]
            part *= p
            part += table[self.data[at[:n] + k]]
        total ^= total >> np.uint64(29)
        total *= np.uint64(MIX)
        total ^= total >> np.uint64(32)
        out[order] = total
        for i in np.flatnonzero(self.lengths > LONG_WORD):
            a = self.starts[i]
            out[i] = xxhash.xxh3_64_intdigest(self.data[a:a + self.lengths[i]].tobytes(), seed)
        return out


class Block:
    """The windows of a block's documents as 128-bit keys, ordered by key."""

    def __init__(self, rows: pa.Table, window: int, cell_bits: int) -> None:
        rows = rows.sort_by("row")
        self.ids, self.texts, self.window = rows.column("doc_id").to_pylist(), rows.column("text"), window
        self.spans = Spans(self.texts)
        self.offsets = self.spans.offsets
        self.sizes = np.diff(self.offsets)
        takes_part = np.array([i is not None for i in self.ids], bool)
        counts = np.where(takes_part, np.maximum(self.sizes - window + 1, 0), 0)
        owner = np.repeat(np.arange(len(rows)), counts)
        self.starts = np.arange(len(owner)) + (self.offsets[:-1] - np.cumsum(counts) + counts)[owner]
        ids = np.array([i or 0 for i in self.ids], np.int64)
        self.doc = ids[owner]
        key = self._keys(0)
        order = np.argsort(key)
        self.k1, self.doc, self.starts = key[order], self.doc[order], self.starts[order]
        # distinct cells: leading bits of the key
        cell = self.k1 >> np.uint64(64 - cell_bits)
        self.first = _starts(cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, np.int64)
        self.cells = cell[self.first]

    def _keys(self, half: int) -> np.ndarray:
        """Sum of p**j times the hash of word j for each window, by sums over the whole block."""
        of_word = self.spans.hashes(half)
        p, room = MULTIPLIERS[half], 1 << _bits_for(len(of_word) + 1)
        sums = np.zeros(len(of_word) + 1, np.uint64)
        np.cumsum(of_word * _powers(p, room)[:len(of_word)], out=sums[1:])
        return (sums[self.starts + self.window] - sums[self.starts]) * _powers(pow(p, -1, 2**64), room)[self.starts]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Whether a word lies in a window that begins at ``starts``."""
        edge = np.zeros(int(self.offsets[-1]) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge[:-1]) > 0

    def cell_sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.k1)))

    def in_two(self) -> np.ndarray:
        """Whether a cell holds windows of two or more documents of this block."""
        if not len(self.first):
            return np.zeros(0, bool)
        return np.minimum.reduceat(self.doc, self.first) < np.maximum.reduceat(self.doc, self.first)

    def narrow(self, passed: np.ndarray) -> None:
        """Keeps the windows of cells that ``passed`` and sorts them into distinct keys with their least doc_id."""
        keep = np.repeat(passed, self.cell_sizes())
        self.k1, self.doc, self.starts = self.k1[keep], self.doc[keep], self.starts[keep]
        arrays = (self.k1, self._keys(1), self.doc, self.starts)
        (self.k1, self.k2, self.doc, self.starts), self.first = _runs(*arrays)
        self.least = np.minimum.reduceat(self.doc, self.first) if len(self.first) else self.doc


def _runs(k1: np.ndarray, k2: np.ndarray, *others: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays, in order of ``k1`` already, with runs of equal (k1, k2), and where the runs begin."""
    arrays = [k1, k2, *others]
    if not len(k1):
        return arrays, np.zeros(0, np.int64)
    new = k1[1:] != k1[:-1]
    other = k2[1:] != k2[:-1]
    if (~new & other).any():  # two keys share their first half
        order = np.lexsort((k2, k1))
        arrays = [x[order] for x in arrays]
        other = arrays[1][1:] != arrays[1][:-1]
    return arrays, _starts(new | other)


def _by_range(values: np.ndarray, range_bits: int, bits: int):
    """(range, slice) of sorted values of ``bits`` bits."""
    if not len(values):
        return
    ranges = (values >> np.uint64(bits - range_bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
    at = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    for a, b in zip(at, np.append(at[1:], len(values))):
        yield int(ranges[a]), slice(a, b)


def _pieces(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"range": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()),
                     "body": pa.array([r[2] for r in rows], pa.binary())})


def _answers(step: int, at: int, blocks: list[int], bits: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.int32()), "step": pa.array([step] * n, pa.int32()),
                     "range": pa.array([at] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _read(answers: pa.Table, step: int) -> np.ndarray:
    """The bits that the ranges answered, in the order of the block's values."""
    rows = sorted((r["range"], r["bits"]) for r in answers.to_pylist() if r["step"] == step)
    parts = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4),
                           count=int.from_bytes(b[:4], "little")).astype(bool) for _, b in rows]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _sketch(block: Block, number: int, range_bits: int, bits: int) -> pa.Table:
    two = block.in_two()
    return _pieces([(r, number, len(block.cells[s]).to_bytes(4, "little") + np.packbits(two[s]).tobytes()
                     + _pack(block.cells[s])) for r, s in _by_range(block.cells, range_bits, bits)])


def merge_sketches(pieces: pa.Table) -> pa.Table:
    """Sum of one range's sketches; a bit a cell for each block: two or more?"""
    cells, two = [], []
    for body in pieces.column("body"):
        raw = memoryview(body.as_py())
        n = int.from_bytes(raw[:4], "little")
        flags = -(-n // 8)
        two.append(np.unpackbits(np.frombuffer(raw, np.uint8, flags, 4), count=n).astype(bool))
        cells.append(_unpack(raw[4 + flags:], n)[0])
    sizes = [len(c) for c in cells]
    cell, both = np.concatenate(cells), np.concatenate(two)
    order = np.argsort(cell)
    ordered = cell[order]
    first = _starts(ordered[1:] != ordered[:-1])
    count = np.add.reduceat(both[order].astype(np.int64) + 1, first)
    passed = np.empty(len(cell), bool)
    passed[order] = np.repeat(count >= 2, np.diff(np.append(first, len(cell))))
    parts = np.split(passed, np.cumsum(sizes)[:-1])
    return _answers(1, pieces.column("range")[0].as_py(), pieces.column("block").to_pylist(), [_bits(p) for p in parts])


def _candidates(block: Block, number: int, range_bits: int) -> pa.Table:
    k1, k2, doc = block.k1[block.first], block.k2[block.first], block.least
    out = []
    for r, s in _by_range(k1, range_bits, 64):
        ids, index = np.unique(doc[s], return_inverse=True)
        width = 2 if len(ids) <= 1 << 16 else 4
        out.append((r, number, len(k1[s]).to_bytes(4, "little") + len(ids).to_bytes(4, "little")
                    + k1[s].astype("<u8").tobytes() + k2[s].astype("<u8").tobytes() + ids.astype("<i8").tobytes()
                    + index.astype(f"<u{width}").tobytes()))
    return _pieces(out)


def group_exactly(pieces: pa.Table) -> pa.Table:
    """Equal keys of one range; a bit a key for each block: does another block hold a smaller doc_id?"""
    k1, k2, doc = [], [], []
    for body in pieces.column("body"):
        raw = body.as_py()
        n, m = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
        k1.append(np.frombuffer(raw, "<u8", n, 8))
        k2.append(np.frombuffer(raw, "<u8", n, 8 + 8 * n))
        ids = np.frombuffer(raw, "<i8", m, 8 + 16 * n)
        doc.append(ids[np.frombuffer(raw, "<u2" if m <= 1 << 16 else "<u4", n, 8 + 16 * n + 8 * m)])
    sizes = [len(k) for k in k1]
    a, b, d = np.concatenate(k1), np.concatenate(k2), np.concatenate(doc)
    order = np.argsort(a)
    (_, _, d, order), first = _runs(a[order], b[order], d[order], order)
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
    smaller = np.empty(len(d), bool)
    smaller[order] = least < d
    parts = np.split(smaller, np.cumsum(sizes)[:-1])
    return _answers(2, pieces.column("range")[0].as_py(), pieces.column("block").to_pylist(), [_bits(p) for p in parts])


def _keep(block: Block, smaller: np.ndarray) -> pa.Table:
    """Rows of the result: words under a window of a smaller document are left out."""
    sizes = np.diff(np.append(block.first, len(block.k1)))
    gone = np.repeat(smaller, sizes) | (block.doc > np.repeat(block.least, sizes))
    left = ~block.covered(block.starts[gone])
    n_left, kept = [], []
    for text, a, b in zip(block.texts, block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
        words, out = (text.as_py() or "").encode().split(), left[a:b]
        n = int(np.count_nonzero(out))
        n_left.append(n)
        kept.append(b" ".join(words if n == len(words) else compress(words, out.tolist())))
    return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(block.sizes, pa.int64()),
                     "n_removed": pa.array(block.sizes - np.array(n_left, np.int64), pa.int64()),
                     "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                   range_windows: int = RANGE_WINDOWS, spare_bits: int = SPARE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-(chars + 64 * rows) // block_chars))
    windows = max(2, chars // 4)
    range_bits = _bits_for(windows / range_windows)
    bits = min(63, _bits_for(windows) + spare_bits)
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    dealt = (numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
             .repartition(blocks, "block"))

    def number(t: pa.Table) -> int:
        return t.column("block")[0].as_py()

    def sketch(t: pa.Table) -> pa.Table:
        return _sketch(Block(t, window, bits), number(t), range_bits, bits)

    def narrowed(t: pa.Table, answers: pa.Table) -> Block:
        block = Block(t, window, bits)
        block.narrow(_read(answers, 1))
        return block

    def candidates(t: pa.Table, answers: pa.Table) -> pa.Table:
        return _candidates(narrowed(t, answers), number(t), range_bits)

    def keep(t: pa.Table, answers: pa.Table) -> pa.Table:
        return _keep(narrowed(t, answers), _read(answers, 2))

    passed = dealt.groupBy("block").applyInArrow(sketch, PIECES).groupBy("range").applyInArrow(merge_sketches, ANSWERS)
    found = (dealt.groupBy("block").cogroup(passed.groupBy("block")).applyInArrow(candidates, PIECES)
             .groupBy("range").applyInArrow(group_exactly, ANSWERS))
    return dealt.groupBy("block").cogroup(passed.unionByName(found).groupBy("block")).applyInArrow(keep, RESULT)
