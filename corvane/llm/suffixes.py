"""Suffix-array dedup: sampled suffixes in sorted ranges, every suffix of what is left open.

Wanted are the strings of ``size`` bytes that start more than once.

1. Winnowing samples the suffixes, about one in (size - k) / 2, such that equal
   strings of ``size`` bytes hold an equal sampled suffix at the same place.
2. Splitters from a sample part the suffixes into ranges of their leading
   ``LEADING`` bytes. Each range is sorted by content: a multikey quicksort over
   the ``k`` leading bytes, eight at a time, with the middle suffix of each open
   group as pivot; what equals it in all bytes is settled, the rest goes on in
   two groups. Neighbours that share all ``k`` bytes are one anchor; a sampled
   suffix that shares them with none cannot start a repeat.
3. Across boundaries: a splitter stands between different leading bytes, so two
   neighbours that a boundary parts share fewer than ``LEADING`` bytes, which is
   less than an anchor; equal suffixes are always in one range.
4. Of anchors that stand several times, stretches that agree in every byte
   around them are settled at once. Where they agree in part, the bytes go to the
   range of their anchor, and every suffix of them is sorted by its first
   ``size`` bytes in the same way; equal neighbours are repeats.

A task settles the equal stretches of its share of the corpus before it sends
them, so a passage in a third of all documents is one record from each share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.own_ids import by_own_ids
from corvane.llm.repeats import END, SHARE_RUNS, TEXT_ENDS, Ends, Repeats, _batch, cleaned, slots_for

#: Bytes of a suffix by which its range is chosen.
LEADING = 16
#: Documents and suffixes of the sample that the splitters of the ranges are taken from.
SAMPLED_DOCS, SAMPLED_SUFFIXES = 2_000, 200_000
#: Bytes of text that a task gathers before it sends them on.
SENT_BYTES = 16 << 20


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_VALUE[data], offsets


def word_places(size: int) -> list[int]:
    """Where to read eight bytes at a time so that ``size`` bytes are read: in order, the last ones perhaps overlapping."""
    return [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]


def words_at(raw: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, as numbers that sort as the bytes do."""
    return np.ndarray((max(len(raw) - 7, 0),), ">u8", buffer=raw, strides=(1,))


def sorted_places(n: int, word: Callable[[int, np.ndarray], np.ndarray], depth: int) -> np.ndarray:
    """For n strings of ``depth`` words: where each string's group of equal ones begins in sorted order.

    ``word(d, rows)`` gives the d-th words of rows. A multikey quicksort with
    three-way splits: one sort by the first word, then each open group splits
    into what is less than, equal to and greater than its middle string.
    """
    place = np.zeros(n, np.int64)
    if not n:
        return place
    head = word(0, np.arange(n))
    order = np.argsort(head, kind="stable")
    new = np.ones(n, bool)
    new[1:] = head[order][1:] != head[order][:-1]
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    open_ = order[~(new & np.append(new[1:], True))] if depth > 1 else order[:0]
    while len(open_):
        begin = place[open_]
        first = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]])
        sizes = np.diff(np.append(first, len(open_)))
        group = np.repeat(np.arange(len(first)), sizes)
        pivot = open_[first + sizes // 2][group]
        side, alike = np.zeros(len(open_), np.int8), np.arange(len(open_))
        for d in range(1, depth):
            x, y = word(d, open_[alike]), word(d, pivot[alike])
            differ = x != y
            if differ.any():
                side[alike[differ]] = np.where(x[differ] < y[differ], -1, 1)
                alike = alike[~differ]
        less = np.bincount(group[side < 0], minlength=len(first))
        equal = np.bincount(group[side == 0], minlength=len(first))
        place[open_] = begin + np.where(side < 0, 0, np.where(side == 0, less[group], (less + equal)[group]))
        many = np.where(side < 0, less[group], (sizes - less - equal)[group]) > 1
        open_ = open_[(side != 0) & many]
        open_ = open_[np.argsort(place[open_], kind="stable")]
    return place


class Suffixes(Repeats):
    """Runs of windows with a sampled suffix's leading bytes, which go to ranges."""

    def __init__(self, size: int, k: int, slots: int, splitters: np.ndarray):
        super().__init__(size, k, False, byte_symbols, slots, 1 << 19)
        self.splitters, self.places = splitters, word_places(k)
        self.run = K.Records(span=K.U64, doc=np.int64, low=np.uint32, n=np.uint16, at=np.uint16, many=np.uint8, hot=np.uint8, **{f"word{d}": K.U64 for d in range(len(self.places))})

    def sought(self, symbols: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
        raw = K.byte_of(symbols)
        words = words_at(raw)
        return {"bucket": self.range_of(raw, at)} | {f"word{d}": words[at + p].astype(K.U64) for d, p in enumerate(self.places)}

    def told(self, runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return runs | {"anchor": sorted_places(len(runs["doc"]), lambda d, rows: runs[f"word{d}"][rows], len(self.places))}

    def range_of(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of the range that holds the suffix at each place."""
        return np.searchsorted(self.splitters, leading(raw, at, min(LEADING, self.k)), "right").astype(np.int32)


def leading(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` bytes of the suffixes at the given places; as all have as many, they compare as bytes do."""
    return np.ascontiguousarray(raw[at[:, None] + np.arange(n)]).view(f"S{n}").ravel()


class SuffixEnds(Ends):
    """End runs travel as the bytes that their windows cover, and every suffix of them is sorted.

    Those of hot anchors would all meet in the range of the anchor: they travel
    window by window, by two hashes of all its bytes.
    """

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rows, size, parts = self.repeats, [], 0, []
        for symbols, begin, own in self.runs(batches):
            hot = own["hot"] > 0
            if hot.any():
                parts.append(self.windows(symbols, begin[hot], {name: values[hot] for name, values in own.items()}))
                if sum(len(p["h"]) for p in parts) >= SHARE_RUNS:
                    yield _batch(self.sent(parts))
                    parts.clear()
                begin, own = begin[~hot], {name: values[~hot] for name, values in own.items()}
            raw = K.byte_of(symbols)
            order = np.argsort(bucket := r.range_of(raw, begin + own["at"]), kind="stable")
            begin, own, bucket = begin[order], {name: values[order] for name, values in own.items()}, bucket[order]
            found, first = np.unique(bucket, return_index=True)
            for key, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)]):
                of, place = K.spread(own["n"][a:b].astype(np.int64) + r.size - 1)
                said = raw[begin[a:b][of] + place].tobytes()
                rows.append((key, TEXT_ENDS, (b - a).to_bytes(4, "little") + END.pack(own, slice(a, b)) + said))
                size += len(rows[-1][-1])
            if size >= SENT_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if parts:
            rows += self.sent(parts)
        if rows:
            yield _batch(rows)

    def settle(self, table: pa.Table) -> pa.Table:
        other = super().settle(table)
        r, docs, lows, starts, texts, at = self.repeats, [], [], [], [], 0
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload")):
            if kind != TEXT_ENDS:
                continue
            raw = payload.as_py()
            head = 4 + int.from_bytes(raw[:4], "little") * END.width
            own = END.unpack(raw[4:head])
            n = own["n"].astype(np.int64)
            base = np.cumsum(n + r.size - 1) - (n + r.size - 1)
            of, place = K.spread(n)
            docs.append(own["doc"][of])
            lows.append((own["low"][of] + place).astype(np.uint32))
            starts.append(at + base[of] + place)
            texts.append(raw[head:])
            at += len(raw) - head
        if not docs:
            return other
        doc, low, start = np.concatenate(docs), np.concatenate(lows), np.concatenate(starts)
        words, places = words_at(np.frombuffer(b"".join(texts), np.uint8)), word_places(r.size)
        place = sorted_places(len(start), lambda d, rows: words[start[rows] + places[d]].astype(K.U64), len(places))
        repeat = np.bincount(place, minlength=len(place))[place] > 1
        return pa.concat_tables([other, pa.Table.from_batches([_batch(self.ranges(doc[repeat], low[repeat]))])])


def sampled_splitters(docs: DataFrame, size: int, k: int, ranges: int) -> np.ndarray:
    """Splitters that part the sampled suffixes of a bounded sample of documents into even ranges.

    They only balance the ranges; every suffix of every document goes to one.
    """
    n = min(LEADING, k)
    share = min(1.0, SAMPLED_DOCS / max(1, docs.count()))
    few = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    each = max(1, SAMPLED_SUFFIXES // SAMPLED_DOCS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, 1 << 20):
                symbols, bounds = byte_symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                w = K.winnow(symbols, bounds, size, k)
                key = np.sort(leading(K.byte_of(symbols), bounds[:-1][w["doc"]] + w["at"], n))
                key = key[:: max(1, len(key) // (each * (b - a)))][: 2 * each * (b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(n, b"\0") for x in key.tolist()], pa.binary())], names=["key"])

    found = np.sort(np.array([bytes(r["key"]) for r in few.mapInArrow(keys, "key binary").collect()], f"S{n}"))
    return found[(np.arange(1, ranges) * len(found)) // ranges] if len(found) else found


def _kept_bytes(raw: bytes, spans: tuple | None) -> tuple:
    if spans is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    gone = K.covered(len(raw), *spans)
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest()


def remove_repeated_bytes(docs: DataFrame, size: int = 200, k: int = 32) -> DataFrame:
    """Drop each byte covered by a ``size``-byte string that also starts anywhere else, the same document included.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256. Null and empty texts lose nothing. Bytes may be cut inside a
    character. Rows that share an id count as different documents; equal rows
    give equal results, also where ids are null. Other columns are not read.
    ``k`` is 8 or more, and less than ``size``.
    """
    if not 8 <= k < size:
        raise ValueError("k must be from 8 to size - 1")
    return by_own_ids(docs, lambda told: _remove_repeated_bytes(told, size, k))


def _remove_repeated_bytes(docs: DataFrame, size: int, k: int) -> DataFrame:
    slots = slots_for(docs)
    repeats = Suffixes(size, k, slots, sampled_splitters(docs, size, k, 2 * slots))
    return cleaned(docs, repeats, SuffixEnds(repeats), _kept_bytes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
