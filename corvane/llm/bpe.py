"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut by the tokenizer's pattern; each distinct piece of a task's
corpus is encoded once. All new pieces lie end to end in one symbol array, and
an inverted index leads from the rank of a token pair to the positions where it
stands. Merges are replayed in rank order from a heap: one rank merges at all
its positions at once, and only the pairs with the touched neighbours are
looked up and indexed anew.

Pieces are independent, and within one piece the lowest rank, leftmost first,
is merged next, so the replay gives the piece's ordinary BPE result, with one
exception: a merge that brings up a pair of a *lower* rank while the same rank
waits further right in the piece. Such pieces are marked and encoded on their
own by the ordinary rule.

Defined results: null and empty texts have no ids (the digests of nothing);
repeated rows each get their row; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K

#: Distinct pieces that a task remembers; it starts anew beyond that.
REMEMBERED = 250_000
PIECE_CHUNK_BYTES = 6 << 20


class Ranks:
    """A vocabulary of byte strings by rank, with its mergeable pairs in sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.token = {r: t for t, r in ranks.items()}
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.merged = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to, -1 if none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def alone(self, piece: bytes) -> list[int]:
        """The ordinary rule on one piece: merge the lowest rank, leftmost first; a heap holds what can merge."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (both := parts[i] + parts[after[i]]) in self.ranks:
                heapq.heappush(heap, (self.ranks[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue  # one of the two has merged meanwhile
            gone = after[i]
            parts[i], parts[gone], after[i] = both, None, after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each distinct piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner, n = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # -1 and n: piece ends
        ends = np.cumsum(lengths)
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = -1
        alive, odd = np.ones(n, bool), np.zeros(len(pieces), bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(left: np.ndarray, ranks: np.ndarray) -> None:
            found = ranks >= 0
            if not found.any():
                return
            left, ranks = left[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            left, ranks = left[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cut]].tolist(), np.split(left, cut)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(after < n)
        enter(start, self.rank_of(symbol[start], symbol[after[start]]))
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[alive[at] & (after[at] < n)]
            if not len(at):
                continue
            right = after[at]
            same = self.rank_of(symbol[at], symbol[right]) == rank
            at, right = at[same], right[same]
            if len(at) > 1 and (clash := right[:-1] == at[1:]).any():
                # Overlapping pairs, as in "aaa": leftmost first within each chain.
                new = np.r_[True, ~clash]
                chain = np.cumsum(new) - 1
                place = np.arange(len(at)) - np.flatnonzero(new)[chain]
                at, right = at[place % 2 == 0], right[place % 2 == 0]
            if not len(at):
                continue
            symbol[at], alive[right] = rank, False
            beyond = after[right]
            after[at] = beyond
            near = beyond < n
            before[beyond[near]] = at[near]
            prior = before[at]
            has = prior >= 0
            left, ranks = prior[has], self.rank_of(symbol[prior[has]], symbol[at[has]])
            own, to_right = at[near], self.rank_of(symbol[at[near]], symbol[beyond[near]])
            for p, r in ((left, ranks), (own, to_right)):
                odd[owner[p[(r >= 0) & (r < rank)]]] = True
                enter(p, r)
        kept = np.flatnonzero(alive)
        bounds = np.searchsorted(owner[kept], np.arange(len(pieces) + 1))
        ids = symbol[kept].astype(np.uint32)
        out = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.alone(pieces[i]), np.uint32)
        return out


@lru_cache(maxsize=4)
def _ranks(path: str) -> Ranks:
    return Ranks.from_file(path)


class _Numbers(dict):
    """Numbers pieces in the order in which they are first looked up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes texts with one vocabulary and pattern, remembering the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.cut = _ranks(path), regex.compile(pattern).findall
        self.numbers, self.ids = _Numbers(), []

    def _learn(self) -> None:
        """Ids of the pieces that have a number, but no ids yet."""
        whole, ids, new = self.ranks.ranks, self.ids, []
        for piece in islice(self.numbers, len(ids), None):
            raw = piece.encode()
            rank = whole.get(raw)
            if rank is None:
                new.append((len(ids), raw))
                ids.append(b"")
            else:  # a piece that is itself in the vocabulary is one id
                ids.append(rank.to_bytes(4, "little"))
        if new:
            for (i, _), own in zip(new, self.ranks.replay([raw for _, raw in new])):
                ids[i] = own.astype("<u4", copy=False).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > REMEMBERED:
            self.numbers, self.ids = _Numbers(), []
        # Texts wait as piece numbers, not as strings, until their chunk's new pieces are encoded.
        number = self.numbers.__getitem__
        waiting = [np.fromiter(map(number, self.cut(text)), np.int32) for text in texts]
        self._learn()
        ids_of = self.ids.__getitem__
        return [b"".join(map(ids_of, numbers.tolist())) for numbers in waiting]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoded(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            _, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, PIECE_CHUNK_BYTES):
                rows = batch.slice(a, b - a)
                ids = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
                out = [rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if keep_ids:
                    yield pa.RecordBatch.from_arrays([*out, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
                else:
                    digests = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (ids, map(encoder.decode, ids))]
                    yield pa.RecordBatch.from_arrays([*out, *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of every text. ``path`` must be readable on every executor."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.trimmed(_encoded(path, pattern, True)), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of a table with doc_id and ids (null: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _ranks(path).token
        for batch in batches:
            out = [b"".join(map(token.__getitem__, x or ())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document for the contract of operator 10: each text is encoded, and its ids decoded, in one pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.trimmed(_encoded(path, pattern, False)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
