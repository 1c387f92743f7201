"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark are hashed once on the driver, as flat arrays:
sorted hashes with the item and the place of each window, and the items' words
end to end. Training texts are scanned in Arrow tasks without a shuffle; each
hash hit is verified word by word.

A benchmark of more than ``block_bytes`` is never on the driver or in a task as
a whole. Its windows stay a table; what is broadcast is a bitmap of their
hashes, of ``BITMAP_BYTES`` whatever their number. Tasks send on the windows of
documents whose bit is set, with their words, and these join the table by their
words. Only they are shuffled, and texts are read once.

Defined results: a null or empty text has no words, no hits and is never
contaminated; items without words are ignored; a repeated item id counts once;
repeated documents each get their row; other columns of either input are not
read (their names may clash).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import kernels as K
from corvane.sources.shared import materialize

WINDOW_WORDS = 13
BLOCK_BYTES, BITMAP_BYTES = 8 << 20, 32 << 20
#: Bytes of the bitmap that one task sets.
PIECE_BYTES = 1 << 16
_SCAN = "doc_id long, text string, n_words long, hits array<struct<begin:long,end:long>>, items array<string>"


class Windows:
    """The windows of some items as flat arrays: about five bytes for each byte of text."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [(t or "").encode() for _, t in items]
        self.names = [name for name, _ in items]
        raw = K.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, bounds = K.words(raw, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), K.PLAIN_WORD)
        self.raw, self.starts, self.ends = raw.tobytes(), starts.astype(np.int32), ends.astype(np.int32)
        symbols, counts = K.word_hashes(raw, starts, ends), np.diff(bounds)
        owner, width = np.repeat(np.arange(len(items)), counts), np.minimum(counts, window)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted({int(w) for w in width if w}):
            grams = K.gram_hashes(symbols, w)
            at = np.flatnonzero((owner[: len(grams)] == owner[w - 1 :][: len(grams)]) & (width[owner[: len(grams)]] == w))
            order = at[np.argsort(grams[at], kind="stable")]
            self.by_width[w] = grams[order], order.astype(np.int32), owner[order].astype(np.int32)

    def said(self, at: int, width: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[at : at + width].tolist(), self.ends[at : at + width].tolist())]


def _hits(table: Windows, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, symbols: np.ndarray) -> tuple[list, list]:
    """(text, first word, end word) of each verified occurrence, and (text, item) pairs."""
    spans, items = [], set()
    flat, owner = raw.tobytes(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for width, (keys, places, of) in table.by_width.items():
        grams = K.gram_hashes(symbols, width)
        if not len(grams):
            continue
        rough = np.zeros(1 << 16, bool)
        rough[keys >> K.U64(48)] = True
        at = np.flatnonzero(rough[grams >> K.U64(48)])
        first = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
        same = keys[first] == grams[at]
        at, first = at[same], first[same]
        inside = owner[at] == owner[at + width - 1]
        at, first = at[inside], first[inside]
        last = np.searchsorted(keys, grams[at], "right")
        for i, x, y in zip(at.tolist(), first.tolist(), last.tolist()):
            said = [flat[a:b] for a, b in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist())]
            own = [int(of[p]) for p in range(x, y) if table.said(int(places[p]), width) == said]
            if own:
                doc = int(owner[i])
                spans.append((doc, i - int(bounds[doc]), i - int(bounds[doc]) + width))
                items.update((doc, table.names[item]) for item in own)
    return spans, list(items)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"begin": begin, "end": end})
    return out


_HITS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets):
                raw = K.LOWER[data[offsets[a] : offsets[b]]]
                starts, ends, bounds = K.words(raw, offsets[a : b + 1] - offsets[a], K.PLAIN_WORD)
                spans, items = _hits(table, raw, starts, ends, bounds, K.word_hashes(raw, starts, ends))
                by_doc: dict[int, list] = defaultdict(list)
                own: dict[int, set] = defaultdict(set)
                for doc, begin, end in spans:
                    by_doc[doc].append((begin, end))
                for doc, item in items:
                    own[doc].add(item)
                hits, names = [_merged(by_doc.get(i, [])) for i in range(b - a)], [sorted(own.get(i, ())) for i in range(b - a)]
                rows = batch.slice(a, b - a)
                more = [rows.column("carry")] if "carry" in rows.schema.names else []
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(np.diff(bounds)), pa.array(hits, _HITS), pa.array(names, pa.list_(pa.string())), *more], names=["doc_id", "text", "n_words", "hits", "items", "carry"][: 5 + len(more)])

    return run


def _item_windows(window: int):
    """(item, width, said, bit) of every window of the items; its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                table = Windows([(name, text)], window)
                for width, (keys, places, _) in table.by_width.items():
                    said = [b" ".join(table.said(p, width)).decode() for p in places.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(said), pa.string()), pa.array([width] * len(said), pa.int32()), pa.array(said, pa.string()), pa.array(_bit(keys, width))], names=["item", "width", "said", "bit"])

    return run


def _bit(keys: np.ndarray, width: int) -> np.ndarray:
    """A window's place in the bitmap."""
    return (K.mix(keys + K.U64(width)) % K.U64(8 * BITMAP_BYTES)).astype(np.int64)


def _piece(table: pa.Table) -> pa.Table:
    bits = np.zeros(8 * PIECE_BYTES, bool)
    bits[table.column("bit").to_numpy() % (8 * PIECE_BYTES)] = True
    return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _candidates(bitmap, widths: list[int]):
    """For each text its hashes, its number of words and the windows whose bit is set."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("width", pa.int32()), ("said", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets):
                raw = K.LOWER[data[offsets[a] : offsets[b]]]
                starts, ends, bounds = K.words(raw, offsets[a : b + 1] - offsets[a], K.PLAIN_WORD)
                symbols, flat, owner = K.word_hashes(raw, starts, ends), raw.tobytes(), np.repeat(np.arange(b - a), np.diff(bounds))
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for width in widths:
                    grams = K.gram_hashes(symbols, width)
                    bit = _bit(grams, width)
                    at = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    for i in at[owner[at] == owner[at + width - 1]].tolist():
                        said = b" ".join(flat[x:y] for x, y in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist()))
                        found[owner[i]].append({"at": i - int(bounds[owner[i]]), "width": width, "said": said.decode()})
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("h1"), rows.column("h2"), pa.array(np.diff(bounds)), pa.array(found, kind)], names=["h1", "h2", "n_words", "found"])

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_merged([(x["begin"], x["end"]) for x in spans]) for spans in batch.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("n_words"), pa.array(hits, _HITS), batch.column("items")], names=["h1", "h2", "n_words", "hits", "items"])


def _joined(out: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The scan of a benchmark beyond one block; what a text holds follows from the text, so verdicts go by its two hashes."""
    windows = materialize(items.mapInArrow(_item_windows(window), "item string, width int, said string, bit long"), "benchmark-windows")
    pieces = windows.select((F.col("bit") / (8 * PIECE_BYTES)).cast("int").alias("piece"), "bit").distinct().groupBy("piece").applyInArrow(_piece, "piece int, bits binary")
    bitmap = bytearray(BITMAP_BYTES)
    for r in pieces.collect():
        bitmap[r["piece"] * PIECE_BYTES : (r["piece"] + 1) * PIECE_BYTES] = r["bits"]
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    shared = out.sparkSession.sparkContext.broadcast(bytes(bitmap))
    keys = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("other"), "text")}
    texts = out.select("text").withColumns(keys)
    scanned = materialize(texts.mapInArrow(_candidates(shared, widths), "h1 long, h2 long, n_words long, found array<struct<at:long,width:int,said:string>>"), "candidate-windows")
    shared.unpersist()
    each = scanned.select("h1", "h2", F.inline("found")).distinct().join(windows.select("width", "said", "item").distinct(), ["width", "said"])
    spans = F.collect_set(F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("width")).alias("end")))
    met = each.groupBy("h1", "h2").agg(spans.alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    none = {"hits": F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"), "items": F.expr("cast(array() as array<string>)")}
    sized = scanned.groupBy("h1", "h2").agg(F.max("n_words").alias("n_words"))
    verdicts = sized.join(met, ["h1", "h2"], "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()}).select("h1", "h2", "n_words", "hits", "items")
    settled = verdicts.mapInArrow(_settled, "h1 long, h2 long, n_words long, hits array<struct<begin:long,end:long>>, items array<string>")
    return out.withColumns(keys).join(settled, ["h1", "h2"]).select("doc_id", "text", "n_words", "hits", "items", *[c for c in out.columns if c == "carry"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> DataFrame:
    """doc_id, text, n_words, hits (merged word ranges inside occurrences of benchmark windows), items.

    ``carry``: a struct of further columns of ``docs`` to pass through.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0)).alias("b")).first()["b"]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if carry is None else [carry.alias("carry")]))
    if total > block_bytes:
        return _joined(out, items, window)
    shared = spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in items.collect()], window))
    schema = T.StructType(T.StructType.fromDDL(_SCAN).fields + [f for f in out.schema.fields if f.name == "carry"])
    return out.mapInArrow(K.trimmed(_scan(shared)), schema)


def judged(scan: DataFrame) -> DataFrame:
    """The contamination digest: n_hit words in hits; contaminated from a twentieth of the words on."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return scan.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document for the contract of operator 7."""
    return judged(contamination(docs, benchmark)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not contaminated; null texts stay."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    scan = judged(contamination(docs, benchmark, carry=F.struct(*rest) if rest else None))
    return scan.where(~F.col("contaminated")).select(*[F.col(c) if c in ("doc_id", "text") else F.col("carry").getField(c).alias(c) for c in docs.columns])
