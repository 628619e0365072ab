"""Bound-certified best-fit packing of tokenised documents into fixed-size sequences.

1. ``token_pieces`` turns each text into token ids plus an end id; a document
   longer than the capacity is cut so that only its first piece may be shorter.
2. Pieces that fill a sequence alone need no packing. The others are dealt over
   partitions by a hash of their row id, so no key can be hot.
3. Each partition runs best-fit decreasing. Dual-feasible functions give a lower
   bound on its bins: bins == bound certifies the partition.
4. Partitions with a gap release the documents of their bins with slack (a
   certified one offers its emptiest bin); these are exchanged: pooled into
   fewer partitions and packed again. A pool keeps its old bins unless the new
   packing needs fewer. Rounds end when one pool is left.

Only lengths travel; token ids are hashed where they are made. Nulls: a null text
is an empty document (just the end id); a null doc_id is an ordinary value.
Repeated rows are packed once each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logarbor.llm.tools import written

CAPACITY = 2048
END_ID = 0
ITEMS_PER_PARTITION = 50_000
MAX_ROUNDS = 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = ("row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "sequence_id bigint, offset bigint, bins bigint, bound bigint, released boolean")


# ---------------------------------------------------------------- tokens
@lru_cache(maxsize=4)
def _encoder(path: str):
    """text -> uint32 ids of the tokenizer file at ``path``.

    A byte-level BPE file whose ids follow its merge order has the form tiktoken
    needs; its ids are then the same (tested) and come several times faster.
    Other files, texts holding a special token's string, and very long runs
    without a blank go through ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    exact = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    units = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = (model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel"
             and pre.get("use_regex") and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                "end_of_word_suffix", "ignore_merges")))
    if not plain:
        return slow
    # the byte each printable stand-in means: printable Latin-1 stands for itself, the others follow from 256
    own = [b for b in range(256) if chr(b) in set(units)]
    means = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(means[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(p)] for p in pairs]
    if made != sorted(made) or len(ranks) != 256 + len(set(made)):
        return slow
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # without two white-space characters in a row the look-ahead decides nothing, and the automaton is faster
    lone = tiktoken.Encoding("lone", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks,
                             special_tokens={})
    import re
    run, long = re.compile(r"\s\s"), re.compile(r"[^\s]{2000}|\s{2000}")

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special) or long.search(text):
            return slow(text)
        return (enc if run.search(text) else lone).encode_to_numpy(text, disallowed_special=())

    return fast


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole, or cut with the short piece first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = PIECES + (", ids array<bigint>" if with_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + ([pa.list_(pa.int64())] if with_ids else [])
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[s:s + n]
                    for col, v in zip(rows, (doc, k, s, n, zlib.crc32(own.tobytes()), own.astype(np.int64))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- packing of one partition
def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each item (any order in); a bin with the least sufficient room is found in a bit set."""
    bins = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r set: some bin has room r
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Most bins that the dual-feasible functions u(k), U(eps) and phi(eps) prove necessary, in exact integers."""
    if not len(lengths):
        return 0
    c = capacity
    count = np.bincount(lengths, minlength=c + 1).astype(np.int64)[: c + 1]
    x = np.arange(c + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // c)
    for k in range(1, 21):
        v = np.where((k + 1) * x % c == 0, k * x, (k + 1) * x // c * c)
        best = max(best, -(-int((count * v).sum()) // (k * c)))
    n_from = np.append(np.cumsum(count[::-1])[::-1], 0)          # items of at least x
    s_from = np.append(np.cumsum((count * x)[::-1])[::-1], 0)
    large = x > c // 2 if c % 2 else x > c / 2
    half = int(np.argmax(large))
    for eps in range(1, c // 2 + 1):
        total = c * int(n_from[c - eps + 1]) + int(s_from[eps] - s_from[c - eps + 1])
        best = max(best, -(-total // c))
        q = c // eps
        total = int((count[half:] * (q - (c - x[half:]) // eps)).sum()) + int(n_from[eps] - n_from[half])
        best = max(best, -(-total // q))
    return best


def _packer(capacity: int, final: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """One partition: best fit decreasing, its certificate, and what it releases for the exchange."""
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        lengths, old = pdf["length"].to_numpy(np.int64), pdf["sequence_id"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        before = len(np.unique(old)) if old[0] >= 0 else n + 1  # no old bins in the first round
        if n >= before:
            own, bins = np.unique(old, return_inverse=True)
            n, seq = before, old
        else:
            own = (int(pdf["part"].iloc[0]) << 32) + np.arange(n)
            seq = own[bins]
        fill = np.bincount(bins, weights=lengths, minlength=n)
        bound = lower_bound(lengths, capacity)
        free = fill < capacity if n > bound else np.arange(n) == int(np.argmin(fill))
        order = np.lexsort((pdf["row"].to_numpy(), -lengths, bins))
        ends = np.cumsum(lengths[order])
        sorted_bins = bins[order]
        first = np.searchsorted(sorted_bins, sorted_bins, side="left")
        offset = np.empty(len(lengths), dtype=np.int64)
        offset[order] = ends - lengths[order] - (ends - lengths[order])[first]
        out = pdf.drop(columns=["part"])
        return out.assign(sequence_id=seq, offset=offset, bins=n, bound=bound,
                          released=False if final else free[bins])[[c.split()[0] for c in PACKED.split(", ")]]
    return pack


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, items_per_partition: int = ITEMS_PER_PARTITION,
                max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths run from 1 to ``capacity``.

    Extra columns: ``bins`` and ``bound``, the bins of the partition a piece was
    last packed in and the bins proven necessary there.
    """
    rows = written(pieces.select(F.monotonically_increasing_id().alias("row"),
                                 *(c.split()[0] for c in PIECES.split(", "))))
    whole = rows.where(F.col("length") == capacity).select(
        "*", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        F.lit(1).cast("bigint").alias("bins"), F.lit(1).cast("bigint").alias("bound"))
    names = whole.columns
    loose = rows.where(F.col("length") < capacity).withColumn("sequence_id", F.lit(-1).cast("bigint"))
    n, kept, base, last = loose.count(), [whole], 0, 0
    for round_ in range(max_rounds):
        parts = max(1, -(-n // items_per_partition))
        if round_:
            parts = min(parts, -(-last // 2))  # an exchange joins at least two partitions
        final = parts == 1 and round_ > 0 or round_ == max_rounds - 1 or (parts == 1 and last == 0)
        # the old bins of a partition stay together in one pool, so a pool can keep them
        key = (F.pmod(F.xxhash64("row"), F.lit(parts)) if round_ == 0
               else F.pmod(F.xxhash64(F.shiftright("sequence_id", 32)), F.lit(parts)))
        packed = written(loose.withColumn("part", key + F.lit(base)).groupBy("part")
                         .applyInPandas(_packer(capacity, final), PACKED))
        kept.append(packed.where(~F.col("released")).select(names))
        base, last = base + parts, parts
        loose = packed.where("released").select("row", *(c.split()[0] for c in PIECES.split(", ")), "sequence_id")
        n = 0 if final else loose.count()
        if not n:
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id and its ids, at most ``capacity`` of them."""
    ids = pieces_with_ids.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    join = (F.col("p.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("p.piece") == F.col("i.piece"))
            & (F.col("p.ids_crc32") == F.col("i.ids_crc32")))
    return (packed.alias("p").join(ids.alias("i"), join).groupBy("sequence_id")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))),
                                       lambda s: s["ids"])).alias("ids")))
