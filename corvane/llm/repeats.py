"""Repeated passages: winnowed anchors as seeds, extended to maximal repeats.

A *window* is ``size`` consecutive symbols of one document (words or bytes).
Wanted are the windows whose content also starts elsewhere, and the symbols
they cover. Every window picks one anchor k-gram by winnowing (see
``kernels.winnow``); consecutive windows with one anchor form a *run*, about
one for every (size - k) / 2 symbols.

1. Seeds: each run goes, as 16 bytes of hashes and its place, to the bucket of
   its anchor. Within a task's share of the corpus equal runs are settled
   first, so a passage that fills a third of the corpus still sends only one
   record from each share.
2. Extension: runs equal over all their symbols extend each other's match in
   both directions at once. A run whose anchor stands nowhere else is unique.
   What remains are runs at the ends of repeats: same anchor, other extent.
   An anchor that a task sees with ``HOT_SPANS`` extents or more is hot: its
   runs are all ends, so they go to buckets of their extent instead, and a
   marker tells the anchor's bucket.
3. The ends are settled window by window, from the text itself; equal windows
   of a task's share are settled there first, and one speaks for them.
4. Adjacent and overlapping windows merge into maximal repeats per document.

Nothing is compared in pairs, so cost is linear however large a group of
copies is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.own_ids import NO_ID, by_own_ids
from corvane.sources.shared import materialize

#: Runs, or windows, that a task gathers before it settles them and sends them on.
SHARE_RUNS = 500_000

#: Different extents of one anchor in a task's share from which on its runs are dealt out by extent.
HOT_SPANS = 8
PLAIN, HOT, MARKER = range(3)

RUN = K.Records(anchor=K.U64, span=K.U64, doc=np.int64, low=np.uint32, n=np.uint16, at=np.uint16, many=np.uint8, hot=np.uint8)
END = K.Records(doc=np.int64, low=np.uint32, n=np.uint16, at=np.uint16, hot=np.uint8)
RANGE = K.Records(doc=np.int64, begin=np.uint32, end=np.uint32)
_ROWS = "slot int, kind int, payload binary"
SEEDS, RANGES, ENDS, TEXT_ENDS, WINDOW_ENDS = range(5)


#: Makes a second, independent hash of the same symbols.
OTHER = K.U64(0x9E3779B97F4A7C15)
def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slots, kinds, payloads = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=["slot", "kind", "payload"])


def slot_of(doc: np.ndarray, slots: int) -> np.ndarray:
    return (K.mix(doc.astype(K.U64)) % K.U64(slots)).astype(np.int64)


class Repeats:
    """One way to cut documents into symbols, and what counts as a repeat.

    ``earlier``: a window is a repeat if a document with a smaller doc_id has
    it too. Otherwise any second occurrence makes both repeats.
    """

    #: What a run is sent as.
    run = RUN

    def __init__(self, size: int, k: int, earlier: bool, symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], slots: int, chunk_bytes: int = 1 << 20):
        self.size, self.k, self.earlier, self.symbols, self.slots, self.chunk_bytes = size, k, earlier, symbols, slots, chunk_bytes
        self.buckets, self.hot_spans = 2 * slots, HOT_SPANS

    def sought(self, symbols: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """The bucket where equal content meets, by its hash; further columns by which it is compared there."""
        return {"bucket": (hashes % K.U64(self.buckets)).astype(np.int32)}

    def told(self, runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The runs of one bucket with ``anchor``, equal for equal anchors."""
        return runs

    # Both stages of settling work on records sorted by (identity, document, place).

    def _settle(self, runs: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Sorted runs, which of them are repeats, and which speak for their content elsewhere."""
        order = np.lexsort((runs["low"], runs["doc"], runs["span"], runs["anchor"]))
        runs = {name: values[order] for name, values in runs.items()}
        n = len(order)
        new = np.ones(n, bool)
        new[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["span"][1:] != runs["span"][:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if self.earlier:
            speaks = runs["doc"] == runs["doc"][first][group]
            return runs, ~speaks, speaks
        total = np.add.reduceat(1 + runs["many"].astype(np.int64), first) if n else np.zeros(0, np.int64)
        runs["many"] = (total >= 2)[group].astype(np.uint8)
        return runs, runs["many"] > 0, new

    def _ranges(self, doc: np.ndarray, low: np.ndarray, n: np.ndarray | int) -> list[tuple[int, int, bytes]]:
        if not len(doc):
            return []
        ranges = {"doc": doc, "begin": low, "end": low.astype(np.int64) + n + (self.size - 1)}
        return [(slot, RANGES, raw) for slot, raw in RANGE.split(ranges, slot_of(doc, self.slots))]

    def _dealt(self, runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Sorted runs with those of hot anchors in buckets of their extents, and a marker of each such anchor."""
        n = len(runs["anchor"])
        if not n:
            return runs
        new = np.r_[True, runs["anchor"][1:] != runs["anchor"][:-1]]
        extent = np.r_[True, (runs["span"][1:] != runs["span"][:-1]) | new[1:]]
        first, anchor = np.flatnonzero(new), np.cumsum(new) - 1
        hot = np.add.reduceat(extent.astype(np.int64), first) >= self.hot_spans
        marks = first[hot]
        runs = {name: np.concatenate([values, values[marks]]) for name, values in runs.items()}
        runs["hot"] = np.r_[np.where(hot[anchor], HOT, PLAIN), np.full(len(marks), MARKER)].astype(np.uint8)
        by_extent = self.buckets + (K.mix(runs["span"]) % K.U64(self.buckets)).astype(np.int64)
        runs["bucket"] = np.where(runs["hot"] == HOT, by_extent, runs["bucket"]).astype(np.int32)
        return runs

    def seeds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[dict[str, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            runs = {name: np.concatenate([g[name] for g in gathered]) for name in gathered[0]}
            gathered.clear()
            runs, repeat, speaks = self._settle(runs)
            rows = self._ranges(runs["doc"][repeat], runs["low"][repeat], runs["n"][repeat])
            kept = self._dealt({name: values[speaks] for name, values in runs.items()})
            rows += [(slot, SEEDS, raw) for slot, raw in self.run.split(kept, kept["bucket"])]
            return _batch(rows)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, self.chunk_bytes):
                symbols, bounds = self.symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                w = K.winnow(symbols, bounds, self.size, self.k)
                own = {"anchor": w["anchor"], "span": w["span"], "doc": ids[a:b][w["doc"]], "low": w["low"].astype(np.uint32), "n": (w["high"] - w["low"] + 1).astype(np.uint16), "at": (w["at"] - w["low"]).astype(np.uint16), "many": np.zeros(len(w["low"]), np.uint8), "hot": np.zeros(len(w["low"]), np.uint8)}
                gathered.append(own | self.sought(symbols, bounds[:-1][w["doc"]] + w["at"], w["anchor"]))
                if sum(len(g["low"]) for g in gathered) >= SHARE_RUNS:
                    yield sent()
        if gathered:
            yield sent()

    def extend(self, table: pa.Table) -> pa.Table:
        """Verdicts on the runs of one bucket of anchors; ranges settled earlier pass through."""
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        rows = [(s, RANGES, p) for s, k, p in zip(table.column("slot").to_pylist(), kinds.tolist(), payloads) if k == RANGES]
        runs = self.told(self.run.unpack_all([p for k, p in zip(kinds.tolist(), payloads) if k == SEEDS]))
        hot = np.unique(runs["anchor"][runs["hot"] != PLAIN])
        plain = runs["hot"] != MARKER
        runs, repeat, speaks = self._settle({name: values[plain] for name, values in runs.items()})
        rows += self._ranges(runs["doc"][repeat], runs["low"][repeat], runs["n"][repeat])
        if len(speaks):
            new = np.ones(len(speaks), bool)
            new[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
            anchor = np.cumsum(new) - 1
            differs = np.zeros(len(speaks), bool)
            differs[1:] = (runs["span"][1:] != runs["span"][:-1]) & ~new[1:]
            runs["hot"] = np.isin(runs["anchor"], hot).astype(np.uint8)
            several = (np.bincount(anchor, weights=differs) > 0) | (runs["hot"][new] > 0)
            ends = {name: values[speaks & several[anchor]] for name, values in runs.items()}
            if len(ends["doc"]):
                rows += [(slot, ENDS, raw) for slot, raw in END.split(ends, slot_of(ends["doc"], self.slots))]
        return pa.Table.from_batches([_batch(rows)])


class Ends:
    """Settles windows at the ends of repeats: texts, each with its end records, to ranges."""

    #: A window by two independent 64-bit hashes of its symbols.
    WINDOW = K.Records(h=K.U64, g=K.U64, doc=np.int64, low=np.uint32)

    def __init__(self, repeats: Repeats):
        self.repeats = repeats

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        """Chunk by chunk: symbols, where each end run's windows begin in them, and the runs."""
        r = self.repeats
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, r.chunk_bytes):
                own = END.unpack_all(payloads[a:b])
                row = np.repeat(np.arange(b - a), [len(p) // END.width for p in payloads[a:b]])
                symbols, bounds = r.symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                begin = bounds[row] + own["low"]
                fits = begin + own["n"] + (r.size - 1) <= bounds[row + 1]  # always, unless two texts share an id
                yield symbols, begin[fits], {name: values[fits] for name, values in own.items()}

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of all end runs, by bucket of their content."""
        parts: list[dict[str, np.ndarray]] = []
        for symbols, begin, own in self.runs(batches):
            parts.append(self.windows(symbols, begin, own))
            if sum(len(p["h"]) for p in parts) >= SHARE_RUNS:
                yield _batch(self.sent(parts))
                parts.clear()
        if parts:
            yield _batch(self.sent(parts))

    def windows(self, symbols: np.ndarray, begin: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Every window of the runs, by its two hashes."""
        r = self.repeats
        h = K.gram_hashes(symbols, r.size)
        g = K.gram_hashes(K.mix(symbols ^ OTHER), r.size)
        of, place = K.spread(own["n"].astype(np.int64))
        at = begin[of] + place
        return {"h": h[at], "g": g[at], "doc": own["doc"][of], "low": (own["low"][of] + place).astype(np.uint32)}

    def sent(self, parts: list[dict[str, np.ndarray]]) -> list[tuple[int, int, bytes]]:
        """Rows of a share's windows: of equal ones only what speaks for them elsewhere, and the ranges of those that are repeats already."""
        w, repeat, new = self.sorted({name: np.concatenate([p[name] for p in parts]) for name in parts[0]})
        speaks = ~repeat if self.repeats.earlier else new
        kept = {name: values[speaks] for name, values in w.items()}
        rows = [(bucket, WINDOW_ENDS, raw) for bucket, raw in self.WINDOW.split(kept, (kept["h"] % K.U64(self.repeats.buckets)).astype(np.int64))] if speaks.any() else []
        return rows + self.ranges(w["doc"][repeat], w["low"][repeat])

    def settle(self, table: pa.Table) -> pa.Table:
        """Ranges of the repeats in one bucket; those that were told earlier pass through."""
        kinds, payloads, slots = (table.column(c).to_pylist() for c in ("kind", "payload", "slot"))
        rows = [(s, RANGES, p) for s, k, p in zip(slots, kinds, payloads) if k == RANGES]
        windows = [p for k, p in zip(kinds, payloads) if k == WINDOW_ENDS]
        if windows:
            w, repeat, _ = self.sorted(self.WINDOW.unpack_all(windows))
            rows += self.ranges(w["doc"][repeat], w["low"][repeat])
        return pa.Table.from_batches([_batch(rows)])

    def sorted(self, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Windows by content and document, which of them are repeats, and which are the first of their content."""
        order = np.lexsort((w["doc"], w["g"], w["h"]))
        w = {name: values[order] for name, values in w.items()}
        new = np.ones(len(order), bool)
        new[1:] = (w["h"][1:] != w["h"][:-1]) | (w["g"][1:] != w["g"][:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        if self.repeats.earlier:
            repeat = w["doc"] > w["doc"][first][group] if len(order) else new
        else:
            repeat = (np.diff(np.append(first, len(order))) > 1)[group] if len(order) else new
        return w, repeat, new

    def ranges(self, doc: np.ndarray, low: np.ndarray) -> list[tuple[int, int, bytes]]:
        """The ranges that repeated windows cover; neighbouring windows of one document make one."""
        order = np.lexsort((low, doc))
        doc, low = doc[order], low[order].astype(np.int64)
        if not len(doc):
            return []
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > low[:-1] + 1)
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(doc)) - 1
        return self.repeats._ranges(doc[first], low[first], low[final] - low[first] + 1)


def _by_document(records: K.Records):
    """All records of one slot as (doc_id, payload): one row for each document."""

    def run(table: pa.Table) -> pa.Table:
        own = records.unpack_all(table.column("payload").to_pylist())
        docs, at = np.unique(own["doc"], return_inverse=True)
        payloads = [raw for _, raw in records.split(own, at)] if len(docs) else []
        return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(payloads, pa.binary())], names=["doc_id", "payload"])

    return run


def of_documents(rows: DataFrame, records: K.Records) -> DataFrame:
    """(doc_id, payload) of the records in (slot, payload) rows; slots are those of ``slot_of``."""
    return rows.select("slot", "payload").groupBy("slot").applyInArrow(_by_document(records), "doc_id long, payload binary")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id (nulls as the largest id) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def found(docs: DataFrame, repeats: Repeats, ends: Ends) -> DataFrame:
    """Rows (slot, kind, payload) with the ranges of all repeats, by slot of documents."""
    texts = numbered(docs)
    verdicts = materialize(texts.mapInArrow(repeats.seeds, _ROWS).groupBy("slot").applyInArrow(lambda table: repeats.extend(table), _ROWS), "repeats")
    own = of_documents(verdicts.where(F.col("kind") == ENDS), END)
    windows = texts.join(own.hint("merge"), "doc_id").mapInArrow(lambda batches: ends.cut(batches), _ROWS)
    more = windows.groupBy("slot").applyInArrow(lambda table: ends.settle(table), _ROWS)
    return verdicts.where(F.col("kind") == RANGES).unionByName(more)


def cleaned(docs: DataFrame, repeats: Repeats, ends: Ends, kept: Callable[[bytes, np.ndarray | None], tuple], schema: str, names: list[str]) -> DataFrame:
    """One row per document: doc_id and what ``kept`` makes of the text and its covered ranges (None: none).

    Texts meet their ranges in a join that sorts and may spill, and then pass
    batch by batch, so no task holds a whole slot of texts.
    """
    types = [f.dataType for f in pa_fields(schema)]
    arrow = [pa.int64() if t.simpleString() == "bigint" else pa.string() for t in types]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, payload in zip(batch.column("text"), batch.column("payload")):
                spans = None
                if payload.is_valid:
                    own = RANGE.unpack(payload.as_py())
                    spans = own["begin"].astype(np.int64), own["end"].astype(np.int64)
                out.append(kept((text.as_py() or "").encode(), spans))
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, arrow))], names=["doc_id", *names])

    rows = numbered(docs).join(of_documents(found(docs, repeats, ends), RANGE).hint("merge"), "doc_id", "left").mapInArrow(finish, f"doc_id long, {schema}")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def pa_fields(schema: str) -> list:
    from pyspark.sql import types as T

    return T.StructType.fromDDL(schema).fields


#: Bytes of text whose records one task of a grouped step holds at once.
SLOT_BYTES = 64 << 20


def slots_for(docs: DataFrame) -> int:
    """Slots of documents: one for every ``SLOT_BYTES`` of text, or for each shuffle partition if these are more; anchors have twice as many buckets."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(partitions, -(-total // SLOT_BYTES))


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = K.words(data, offsets, K.SPACED_WORD)
    return K.word_hashes(data, starts, ends), bounds


def _kept_words(raw: bytes, spans: tuple | None, text: bool) -> tuple:
    words = raw.split()
    kept = words if spans is None else list(compress(words, (~K.covered(len(words), *spans)).tolist()))
    joined = b" ".join(kept)
    out = len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()
    return (*out, joined.decode()) if text else out


def remove_repeated_words(docs: DataFrame, size: int = 13, k: int = 5, with_text: bool = False) -> DataFrame:
    """Substring dedup: drop each word covered by a ``size``-word window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined
    by one space) and, if asked for, kept_text. Null and empty texts, and
    texts under ``size`` words, lose nothing. Null ids count as larger than all
    others. Equal rows that share an id count as one document: none of them is
    earlier than another. Different texts under one id, or without an id, are
    different documents (see ``by_own_ids``). Other columns are not read.
    """
    return by_own_ids(docs, lambda told: _remove_repeated_words(told, size, k, with_text))


def _remove_repeated_words(docs: DataFrame, size: int, k: int, with_text: bool) -> DataFrame:
    repeats = Repeats(size, k, True, word_symbols, slots_for(docs))
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return cleaned(docs, repeats, Ends(repeats), lambda raw, spans: _kept_words(raw, spans, with_text), schema, names)
