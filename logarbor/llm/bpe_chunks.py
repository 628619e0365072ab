"""Exact BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of their bytes hits a mask, so equal passages
in different documents give equal chunks wherever they stand. A chunk is encoded
once and its ids are reused. The word that a join cuts in two is repaired: the
window around the join grows to the blanks on both sides and is encoded anew.
Beyond those blanks both encodings agree exactly, because the tokenizer drops
blanks and neither its normaliser nor its merges reach across one. That property
is tested on the tokenizer file when it is loaded; a file without it is used on
whole texts, without reuse.

Chunks and words are remembered per Python worker in two bounded generations; a
lost worker loses nothing but speed. There is no shuffle.

A null text is an empty document (no ids, decoded to the empty string). Special
tokens' strings in a text become their ids as the tokenizers library does it.
Repeated rows and null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logarbor.llm.tools import TwoGenerations

MASK_BITS = 9           # a cut every 2**9 bytes, about
WINDOW = 16             # bytes that decide a cut
WORDS_KEPT = 300_000    # words in a generation
CHUNK_BYTES_KEPT = 16 << 20  # bytes of chunks in a generation
FLUSH_BYTES = 4 << 20   # text returned at once


def cut_positions(data: np.ndarray, mask_bits: int = MASK_BITS, window: int = WINDOW) -> np.ndarray:
    """Byte positions after which a chunk ends: a rolling hash of the last ``window`` bytes hits the mask.

    Never inside a UTF-8 character, and not where the byte before hit as well, so a
    run of one character is not cut into single bytes.
    """
    if len(data) < window:
        return np.empty(0, dtype=np.int64)
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    width = 1
    while width < window:  # h over 2w bytes from h over w bytes
        h[width:] = h[width:] + (h[:-width] * np.uint32(pow(0x01000193, width, 1 << 32)))
        width *= 2
    hit = (h >> np.uint32(32 - mask_bits)) == 0
    hit[: window - 1] = False
    hit[1:] &= ~hit[:-1]
    hit[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(hit) + 1


class ChunkEncoder:
    """Text -> ids of one tokenizer file, with memory of chunks and words."""

    def __init__(self, path: str, mask_bits: int = MASK_BITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mask_bits = mask_bits
        self.words = TwoGenerations(WORDS_KEPT)
        self.chunks = TwoGenerations(CHUNK_BYTES_KEPT)
        self.blank_safe = self._drops_blanks()
        self.tokens = None
        if self.tokenizer.decoder is None:
            self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.reused = self.encoded = 0

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _drops_blanks(self) -> bool:
        parts = ["a", "Zz", "́b", "é", "Été", "9", "''s", "'ll", "...", "中文", "<|endoftext|>", "\U0001f600",
                 "ΣΣ", "İ", "하", "ᆫ", "x y", "​", "don't", "a1b"]
        return all(self._plain(a + blank + b) == self._plain(a) + self._plain(b)
                   for a in parts for b in parts for blank in (" ", "\n", "  ", " \n"))

    def _ids_of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """ids of each word; the new ones are encoded in one call."""
        ids = {w: self.words.find(w) for w in words}
        new = [w for w, v in ids.items() if v is None]
        if new:
            for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                ids[w] = np.array(e.ids, dtype="<u4").tobytes()
                if len(w) <= 256:
                    self.words.put(w, ids[w])
        return ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not self.blank_safe:
            return [np.frombuffer(self._plain(t), dtype="<u4") for t in texts]
        plans = []  # for each text: (word repaired at the join, chunk after it)
        fresh: dict[bytes, tuple] = {}
        wanted = set()
        for text in texts:
            data = text.encode()
            cuts = [0, *cut_positions(np.frombuffer(data, dtype=np.uint8), self.mask_bits).tolist(), len(data)]
            plan, open_word = [], []
            for i, j in zip(cuts, cuts[1:]):
                chunk = data[i:j]
                known = self.chunks.find(chunk) or fresh.get(chunk)
                if known is None:
                    self.encoded += 1
                    words = chunk.replace(b"\n", b" ").split(b" ")
                    # cut word at the start, words between, cut word at the end; no blank: one cut word
                    known = (chunk, None, b"") if len(words) == 1 else (words[0], words[1:-1], words[-1])
                    wanted.update(known[1] or ())
                    fresh[chunk] = known
                else:
                    self.reused += 1
                open_word.append(known[0])
                if known[1] is not None:
                    plan.append((b"".join(open_word), chunk, known))
                    open_word = [known[2]]
            plan.append((b"".join(open_word), None, None))
            wanted.update([p[0] for p in plan])
            plans.append(plan)
        ids = self._ids_of(wanted)
        done = {}
        for chunk, (head, words, tail) in fresh.items():
            done[chunk] = (head, None if words is None else b"".join([ids[w] for w in words]), tail)
            self.chunks.put(chunk, done[chunk], len(chunk) + len(done[chunk][1] or b"") + 200)
        out = []
        for plan in plans:
            parts = []
            for word, chunk, known in plan:
                parts.append(ids[word])
                if chunk is not None:
                    parts.append(done.get(chunk, known)[1])
            out.append(np.frombuffer(b"".join(parts), dtype="<u4"))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's decode with special tokens kept: a file without a decoder joins the tokens by blanks."""
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


@lru_cache(maxsize=2)
def _coder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode(docs: DataFrame, tokenizer_path: str, *, decoded: bool = False) -> DataFrame:
    """doc_id, ids (and their decoded text) for every row of ``docs``."""
    schema = "doc_id bigint, ids array<int>" + (", decoded string" if decoded else "")
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        for b in batches:
            start, texts, size = 0, [], 0
            for k, text in enumerate(b.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= FLUSH_BYTES or k == b.num_rows:
                    ids = [x.astype(np.int32) for x in coder.encode_many(texts)]
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    cols = [b.column(0).slice(start, k - start),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                    if decoded:
                        cols.append(pa.array([coder.decode(x.tolist()) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    start, texts, size = k, [], 0

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, decoded text of each row's ``ids``; null ids decode to the empty string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        for b in batches:
            texts = [coder.decode([i for i in x.as_py() or [] if i is not None]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id bigint, decoded string")
