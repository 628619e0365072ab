"""Token counts by trie-shared dynamic programming over a unigram model.

The model is a vocabulary of byte pieces with integer costs. A pre-token's tokens
are its cheapest segmentation (fewest tokens among equals). The distinct pre-tokens
of a batch are walked as a trie, in sorted order: a node is a distinct prefix, its
forward score (least cost and its token count) is computed once for all pre-tokens below
it, and the count at a terminal node is stored. Nodes of one depth are scored together.

A text is cut at each blank before a non-blank, where a pre-token always begins, and
the pieces between are remembered, up to a bound, in each Python worker, so only new
ones reach the trie. One pass, no shuffle.

A null text counts as an empty one (no tokens); null ids and repeated rows are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COST_UNIT = 1 << 20
PIECES_KEPT = 1_000_000    # pieces that a Python worker remembers, and at most one batch more
SHORT_WORD = 32            # bytes; a score holds the cost times twice as much, and the tokens
ABSENT = 1 << 61
HASH_BASE, HASH_MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LONG_PIECE = 64            # code points; longer ones are not remembered
# Fixed value: the pre-token pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def zipf_costs(path: str) -> dict[bytes, int]:
    """Integer costs of a rank file's pieces: -log p with p by Zipf's law from the rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(len(ranks))
    return {piece: round(COST_UNIT * math.log((rank + 1) * norm)) for piece, rank in ranks.items()}


class Pieces:
    """The vocabulary as a hash table over 64-bit hashes of byte strings: a value of cost and one token each."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.values = {piece: cost * SHORT_WORD * 2 + 1 for piece, cost in costs.items() if 0 < len(piece) <= SHORT_WORD}
        self.unknown = 2 * max(costs.values(), default=1) * SHORT_WORD * 2 + 1
        self.longest = max(map(len, self.values), default=1)
        self.bytes = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)
        hashes = np.zeros(len(self.values), np.uint64)
        for k, piece in enumerate(self.values):
            h = 0
            for c in reversed(piece):
                h = (int(self.bytes[c]) + h * HASH_BASE) & (2**64 - 1)
            hashes[k] = h
        values = np.fromiter(self.values.values(), np.int64, len(hashes))
        # two tables of slots; what finds its slot taken in the first goes to the second
        self.bits = max(8, len(hashes).bit_length() + 4)
        while True:
            slots = [(hashes * np.uint64(HASH_BASE)) >> np.uint64(64 - self.bits),
                     (hashes * np.uint64(HASH_MIX)) >> np.uint64(64 - self.bits)]
            _, first = np.unique(slots[0], return_index=True)
            rest = np.setdiff1d(np.arange(len(hashes)), first)
            if len(np.unique(slots[1][rest])) == len(rest):
                break
            self.bits += 1
        self.keys = np.zeros((2, 1 << self.bits), np.uint64)
        self.found = np.full((2, 1 << self.bits), ABSENT, np.int64)
        for t, own in enumerate((first, rest)):
            self.keys[t][slots[t][own]] = hashes[own]
            self.found[t][slots[t][own]] = values[own]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, ABSENT where it is no piece."""
        out = None
        for t, mix in enumerate((HASH_BASE, HASH_MIX)):
            slot = (h * np.uint64(mix)) >> np.uint64(64 - self.bits)
            got = np.where(self.keys[t][slot] == h, self.found[t][slot], ABSENT)
            out = got if out is None else np.minimum(out, got)
        return out


class PrefixTrie:
    """Forward scores over shared prefixes; a byte that is no piece costs as much as the dearest piece twice over.

    Words of up to SHORT_WORD bytes form one trie, whose nodes are scored level by level; longer ones another,
    walked in sorted order.
    """

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.costs = costs
        self.longest = max(map(len, costs), default=1)
        self.unknown = 2 * max(costs.values(), default=1)
        self.pieces = Pieces(costs)
        self.nodes = 0

    def counts(self, words: list[bytes]) -> dict[bytes, int]:
        """Tokens of each word; each distinct prefix is scored once."""
        short = sorted(w for w in words if len(w) <= SHORT_WORD)
        out = dict(zip(short, self._short(short))) if short else {}
        long = [w for w in words if len(w) > SHORT_WORD]
        if long:
            out.update(self._long(long))
        return out

    def _short(self, words: list[bytes]) -> list[int]:
        n, pieces = len(words), self.pieces
        octets = np.frombuffer(b"".join(w.ljust(SHORT_WORD, b"\0") for w in words), np.uint8).reshape(n, SHORT_WORD)
        size = np.fromiter(map(len, words), np.int64, n)
        # bytes that a word shares with the one before it
        differ = octets[1:] != octets[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), SHORT_WORD)
        shared = np.concatenate(([-1], np.minimum(np.minimum(shared, size[1:]), size[:-1])))
        node, score = [np.zeros(n, np.int64)], [np.zeros(1, np.int64)]
        out = np.zeros(n, np.int64)
        for depth in range(1, int(size.max()) + 1):
            new = (shared < depth) & (size >= depth)
            rows = np.flatnonzero(new)  # the first word below each node
            node.append(np.cumsum(new) - 1)
            h, best = np.zeros(len(rows), np.uint64), np.full(len(rows), ABSENT, np.int64)
            for start in range(depth - 1, max(-1, depth - pieces.longest - 1), -1):
                h = pieces.bytes[octets[rows, start]] + h * np.uint64(HASH_BASE)
                value = pieces.look_up(h)
                if start == depth - 1:
                    value = np.where(value == ABSENT, pieces.unknown, value)
                np.minimum(best, score[start][node[start][rows]] + value, out=best)
            score.append(best)
            self.nodes += len(rows)
            ends = np.flatnonzero(size == depth)
            out[ends] = best[node[depth][ends]] % (SHORT_WORD * 2)
        return out.tolist()

    def _long(self, words: list[bytes]) -> dict[bytes, int]:
        get, unknown, longest = self.costs.get, self.unknown, self.longest
        cost, tokens = [0], [0]
        out, previous = {}, b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(previous))
            if word[:most] == previous[:most]:
                shared = most
            else:
                while word[shared] == previous[shared]:
                    shared += 1
            del cost[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, least = cost[end - 1] + get(word[end - 1:end], unknown), tokens[end - 1] + 1
                for start in range(end - 2, max(-1, end - longest - 1), -1):
                    c = get(word[start:end])
                    if c is not None:
                        c += cost[start]
                        if c < best or c == best and tokens[start] + 1 < least:
                            best, least = c, tokens[start] + 1
                cost.append(best)
                tokens.append(least)
            self.nodes += len(word) - shared
            out[word] = tokens[-1]
            previous = word
        return out


class Counter:
    """text -> (pre-tokens, tokens), with memory of the pieces between blanks.

    A piece is remembered without the blank before it; a text's first piece, which has none, with one.
    """

    def __init__(self, costs: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.trie = PrefixTrie(costs)
        self.cut = regex.compile(r" (?=\S)")
        self.words = regex.compile(pattern)
        self.known: dict[str, int] = {}  # piece -> pre-tokens << 32 | tokens

    def _pieces(self, text: str) -> tuple[list[str], set[str]]:
        """Pieces of a text and those not known yet."""
        pieces = text.split(" ")
        pieces[0] = " " + pieces[0]
        new = set(pieces).difference(self.known)
        if any(not p or p[0].isspace() and p is not pieces[0] for p in new):  # a blank that begins no pre-token
            pieces = self.cut.split(text)
            pieces[0] = " " + pieces[0]
            new = set(pieces).difference(self.known)
        return pieces, new

    def batch(self, texts: list[str]) -> tuple[list[int], list[int]]:
        cut = [self._pieces(t) for t in texts]
        new = set().union(*(n for _, n in cut))
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known = {}
            new = set().union(*(p for p, _ in cut))
        found = {p: [w.encode() for w in self.words.findall(p[1:] if p[0] == " " else " " + p)] for p in new}
        tokens = self.trie.counts(list({w for ws in found.values() for w in ws}))
        known = self.known
        known.update((p, len(ws) << 32 | sum(tokens[w] for w in ws)) for p, ws in found.items())
        value = known.__getitem__
        totals = [sum(map(value, pieces)) for pieces, _ in cut]
        for p in new:
            if len(p) > LONG_PIECE:
                del known[p]
        return [t >> 32 for t in totals], [t & 0xFFFFFFFF for t in totals]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(zipf_costs(path))


def token_counts(docs: DataFrame, ranks_path: str, *, batch_chars: int = 2 << 20) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks_path)
        for b in batches:
            texts, size, pre, tok = [], 0, [], []
            for k, text in enumerate(b.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= batch_chars or k == b.num_rows:
                    x, y = counter.batch(texts)
                    pre, tok, texts, size = pre + x, tok + y, [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(pre, np.int64)),
                                              pa.array(np.array(tok, np.int64))],
                                             names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
