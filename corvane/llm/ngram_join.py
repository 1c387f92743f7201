"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

A document is the set of its hashed n-grams. Two link when their Jaccard
similarity reaches ``percent``; the operator finds every link between different
sets as connected components.

1. Blocking. Sizes of linked sets differ by at most 100 / percent, and at most
   h elements are in one set only, h being a bound on the sizes. Sets are cut by
   element hash into more than h parts (size class by size class, each set in
   its own class's and the next lower family): at least one part must be equal,
   so linked sets share the signature of a part. Parts that are empty say
   nothing; ``spare`` parts make up for them, and the rare set with more empty
   parts than that also sends those. Further parts raise the number of
   signatures that linked sets must share, so a document that shares fewer with
   all others together drops out of its group once groups are formed; until
   then it may connect others. No link is lost, no n-gram count is needed,
   and a passage that many documents share does not bring them together.
2. Equal signatures join into candidate groups, as stars: one row for each
   document and bucket, however many signatures or copies there are.
3. Equal sets collapse to one, by their hashes, before any set is written or
   sent: only texts of sets that have another one in their group are read
   again. Inside a candidate group the incidence matrix is multiplied block by
   block, accumulating overlap counts; pairs below the overlap that their sizes
   ask for are discarded, and what is emitted is a spanning forest of the links,
   never the pairs.
4. Large groups are first multiplied along a chain of blocks, so thousands of
   near copies of one text do not meet pair by pair. Where that leaves several
   components, the group is blocked anew by rarer evidence: the n-grams of each
   set are put in order of how many sets of a sample of the group hold them,
   and only as many of the rarest are indexed as linked sets must share one of.
   Sets of different components that meet in such a column, and whose sizes and
   places there allow a link, are verified: first each with its column's first
   set, then, of what is still apart, all. A template that the group shares is
   in no such column, so its documents do not meet at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import kernels as K
from corvane.llm.own_ids import by_own_ids
from corvane.llm.repeats import NO_ID, numbered, slot_of, slots_for
from corvane.operators.components import connected_components
from corvane.sources.shared import discard, freeing_shuffles, materialize, scratch

#: Signatures that a task gathers before it groups them and sends them on.
SHARE_SIGNATURES = 800_000
BLOCK_DOCS, BLOCK_GRAMS = 512, 1 << 20
#: Counts that a product makes at once; columns of more sets than this, and than an eighth of all, are a dense panel.
PRODUCT_ENTRIES, DENSE_FROM = 1 << 20, 16
#: Bits of a piece of the bitmap of wanted documents (Spark's bitmap functions fix it); pieces at most, 32 MiB; bits for each document.
PIECE_BITS, PIECES, BITS = 1 << 15, 1 << 13, 16
SIGNATURES, EDGES, NEEDS = range(3)
#: Parts beyond those that size bounds ask for, as a share of these: so many more signatures must linked sets share.
EXTRA_PARTS = 0.3
#: 48 bits of the signature (its bucket adds some) and the document.
SIGNATURE = K.Records(high=np.uint32, low=np.uint16, doc=np.int64)
EDGE = K.Records(a=np.int64, b=np.int64)
#: How many shared signatures a document has (positive), or must have to link with any other (negative).
NEED = K.Records(doc=np.int64, n=np.int32)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-gram hashes of each text end to end, and their counts; a shorter text is one gram."""
    raw = K.LOWER[data]
    starts, ends, bounds = K.words(raw, offsets, K.SPACED_WORD)
    hashes = K.word_hashes(raw, starts, ends)
    grams, parts = K.gram_hashes(hashes, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            parts.append(np.unique(grams[a : b - k + 1]))
        else:
            parts.append(K.mix(K.gram_hashes(hashes[a:b], b - a) + K.U64(b - a)) if b > a else hashes[:0])
    return np.concatenate(parts) if parts else hashes[:0], np.array([len(p) for p in parts], np.int64)


class Families:
    """Size classes, and how many parts a class's family of signatures has."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.parts, self.spares = percent, [1], [], []

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.percent
        while self.lows[-1] <= n:
            low = self.lows[-1]
            top = low * 100 // p
            differ = (top + top * 100 // p) * (100 - p) // (100 + p)
            spare = math.ceil((differ + 1) * (1.5 * math.exp(-low / (differ + 1)) + EXTRA_PARTS)) + 2 if differ else 0
            self.parts.append(differ + 1 + spare)
            self.spares.append(spare)
            self.lows.append(top + 1)
        return np.array(self.lows), np.array(self.parts), np.array(self.spares)

    def class_of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upto(int(n.max(initial=1)))[0], n, "right") - 1


def signatures(grams: np.ndarray, counts: np.ndarray, families: Families) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row) of every telling part of every non-empty set, and how many of them each set must share with a set that it links to."""
    own = families.class_of(counts)
    _, parts, spares = families.upto(int(counts.max(initial=1)))
    row = np.repeat(np.arange(len(counts)), counts)
    cell, element = K.mix(grams ^ K.U64(0xA5A5A5A5A5A5A5A5)), K.mix(grams + K.U64(0x3C6EF372FE94F82A))
    out, need = [], np.full(len(counts), 1 << 30)
    for down in (0, 1):
        family = own - down
        has = (counts > 0) & (family >= 0)
        n_parts = np.where(has, parts[np.maximum(family, 0)], 0)
        base = np.cumsum(n_parts) - n_parts
        used = has[row]
        at = base[row[used]] + (cell[used] % n_parts[row[used]].astype(K.U64)).astype(np.int64)
        sums = np.zeros(int(n_parts.sum()), K.U64)
        np.add.at(sums, at, element[used])
        filled = np.bincount(at, minlength=len(sums)) > 0
        owner, place = K.spread(n_parts)
        empties = np.bincount(owner[~filled], minlength=len(counts))
        spare = spares[np.maximum(family, 0)]
        told = filled | (empties > spare)[owner]
        need = np.where(has, np.minimum(need, np.maximum(1 + spare - empties, 1)), need)
        name = K.mix((family[owner].astype(K.U64) << K.U64(32)) + place.astype(K.U64) + K.U64(1))
        out.append((K.mix(sums + name)[told], owner[told]))
    return np.concatenate([s for s, _ in out]), np.concatenate([r for _, r in out]), need


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected component of the edges: (member, smallest member)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _stars(signature: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """Places of each signature's first document, stars of the others, and how many shared signatures each document has."""
    order = np.lexsort((doc, signature))
    s, d = signature[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    lead = d[first][group] if len(s) else d
    other = d != lead
    shared = np.bincount(group, weights=other, minlength=len(first)) > 0
    docs, n = np.unique(d[shared[group]], return_counts=True) if len(s) else (d, d)
    return order[new], forest(d[other], lead[other]), {"doc": docs, "n": n}


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, payloads = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "kind", "payload"])


def _signed(k: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, gathered = Families(percent), []

        def sent() -> pa.RecordBatch:
            signature, doc, needs = (np.concatenate(x, axis=-1) for x in zip(*gathered))
            gathered.clear()
            first, (a, b), count = _stars(signature, doc)
            signature, doc = signature[first], doc[first]
            columns = {"high": (signature >> K.U64(32)).astype(np.uint32), "low": ((signature >> K.U64(16)) & K.U64(0xFFFF)).astype(np.uint16), "doc": doc}
            rows = [(bucket, SIGNATURES, raw) for bucket, raw in SIGNATURE.split(columns, (signature % K.U64(buckets)).astype(np.int64))]
            if len(a):
                rows += [(bucket, EDGES, raw) for bucket, raw in EDGE.split({"a": a, "b": b}, slot_of(b, buckets))]
            told = {"doc": np.r_[count["doc"], needs[0]], "n": np.r_[count["n"], -needs[1]]}
            rows += [(bucket, NEEDS, raw) for bucket, raw in NEED.split(told, slot_of(told["doc"], buckets))]
            return _rows(rows)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = K.utf8(batch.column("text"))
            for x, y in K.chunks(offsets, 1 << 20):
                grams, counts = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k)
                signature, row, need = signatures(grams, counts, families)
                gathered.append((signature, ids[x:y][row], np.stack([ids[x:y], need])[:, counts > 0]))
                if sum(len(g[0]) for g in gathered) >= SHARE_SIGNATURES:
                    yield sent()
        if gathered:
            yield sent()

    return run


def _grouped(slots: int):
    """Stars of one bucket's signatures, packed by slot of their members: a few rows, however many edges."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        s = SIGNATURE.unpack_all([p for k, p in zip(kinds, payloads) if k == SIGNATURES])
        e = EDGE.unpack_all([p for k, p in zip(kinds, payloads) if k == EDGES])
        _, (a, b), count = _stars((s["high"].astype(K.U64) << K.U64(16)) | s["low"].astype(K.U64), s["doc"])
        told = NEED.unpack_all([p for k, p in zip(kinds, payloads) if k == NEEDS])
        told = {name: np.r_[told[name], count[name]] for name in told}
        rows = [(slot, EDGES, raw) for slot, raw in EDGE.split(x, slot_of(x["a"], slots))] if len((x := {"a": np.r_[a, e["a"]], "b": np.r_[b, e["b"]]})["a"]) else []
        rows += [(slot, NEEDS, raw) for slot, raw in NEED.split(told, slot_of(told["doc"], slots))] if len(told["doc"]) else []
        return pa.Table.from_batches([_rows(rows)])

    return run


def _different(table: pa.Table) -> pa.Table:
    """The different edges of one slot's documents, and, as edges to themselves, those that share as many signatures as a link needs.

    Counts may be too high (a signature shared within a task's share and
    beyond counts twice), never too low, so no link is lost. All edges stay:
    any document may stand for a signature of others, as the first of a share,
    and so be their only connection, even where it cannot link itself.
    """
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    e = EDGE.unpack_all([p for k, p in zip(kinds, payloads) if k == EDGES])
    told = NEED.unpack_all([p for k, p in zip(kinds, payloads) if k == NEEDS])
    docs, at = np.unique(told["doc"], return_inverse=True)
    has = np.bincount(at, weights=np.maximum(told["n"], 0), minlength=len(docs))
    need = np.full(len(docs), 1 << 30)
    np.minimum.at(need, at[told["n"] < 0], -told["n"][told["n"] < 0])
    able = docs[has >= need]
    a, b = np.r_[e["a"], able], np.r_[e["b"], able]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": a[new], "b": b[new]})


def candidate_groups(docs: DataFrame, k: int, percent: int, slots: int) -> DataFrame:
    """(node, component): documents that share as many signatures with others as a link needs, by the group that signatures connect."""
    schema = "bucket int, kind int, payload binary"
    rows = docs.mapInArrow(K.trimmed(_signed(k, percent, 2 * slots)), schema)
    stars = rows.groupBy("bucket").applyInArrow(_grouped(slots), schema)
    edges = materialize(stars.groupBy("bucket").applyInArrow(_different, "a long, b long"), "candidate-edges")
    able = edges.where("a = b").select(F.col("a").alias("node"))
    return connected_components(edges.where("a <> b")).join(able.hint("merge"), "node", "left_semi")


def _set_hashes(grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, which tell it from others."""
    ends, sums = np.cumsum(counts), []
    for salt in (1, 2):
        total = np.r_[K.U64(0), np.cumsum(K.mix(grams + K.U64(salt)), dtype=K.U64)]
        sums.append((total[ends] - total[ends - counts]).view(np.int64))
    return sums


def _told(k: int):
    """What tells each document's set: its size and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for x, y in K.chunks(offsets, 1 << 20):
                grams, n = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), pa.array(n), *map(pa.array, _set_hashes(grams, n))], names=["doc_id", "n", "h1", "h2"])

    return run


def _marked(bitmap):
    """The texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array(((bits[bit >> 3] >> (bit & 7)) & 1).astype(bool)))

    return run


def _shingled(k: int):
    """Sets in place of texts. Rows of one id follow each other; of its equal sets one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for x, y in K.chunks(offsets, 1 << 20):
                rows = batch.slice(x, y - x)
                grams, n = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k)
                kept: list[bool] = []
                sets: list[bytes] = []
                for doc, end, count, one, two in zip(rows.column("doc_id").to_pylist(), np.cumsum(n).tolist(), n.tolist(), *(h.tolist() for h in _set_hashes(grams, n))):
                    if doc != last:
                        last, seen = doc, set()
                    kept.append(count > 0 and (one, two) not in seen)
                    if kept[-1]:
                        seen.add((one, two))
                        sets.append(grams[end - count : end].tobytes())
                names = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rows.select(names).filter(pa.array(kept, pa.bool_())).columns, pa.array(sets, pa.binary())], names=[*names, "grams"])

    return run


@contextmanager
def _sets(texts: DataFrame, wanted: DataFrame, k: int) -> Iterator[DataFrame]:
    """``wanted``, a written table with one row for each doc_id, with the sets of these documents as ``grams``.

    Texts meet it in a shuffle; a bitmap, whose size has a bound, first keeps
    back nearly all texts that it does not name.
    """
    pieces = min(PIECES, 1 << max(0, wanted.count() * BITS // PIECE_BITS).bit_length())
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(pieces * PIECE_BITS))
    place = wanted.select((bit + 1).alias("bit")).select((F.bitmap_bucket_number("bit") - 1).alias("piece"), F.bitmap_bit_position("bit").alias("at"))
    bitmap = bytearray(pieces * PIECE_BITS // 8)
    for r in place.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        bitmap[r["piece"] * PIECE_BITS // 8 : (r["piece"] + 1) * PIECE_BITS // 8] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(bytes(bitmap))
    met = texts.withColumn("bit", bit).mapInArrow(K.trimmed(_marked(shared)), "doc_id long, text string").join(wanted.hint("merge"), "doc_id")
    schema = T.StructType([f for f in met.schema.fields if f.name != "text"] + [T.StructField("grams", T.BinaryType())])
    try:
        yield met.mapInArrow(K.trimmed(_shingled(k)), schema)
    finally:
        shared.unpersist()


def _product(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> tuple[list[int], list[int]]:
    """Linked pairs of left and right sets: incidence times transposed incidence, overlap counts accumulated block by block of columns.

    The product is sparse: for every n-gram of a left set, the right sets that
    hold it each get a count, and only where sizes allow a link. The few columns
    that a good part of all sets holds, which near copies of one text have, are
    counted as a dense panel beside it.
    """
    if not left or not right:
        return [], []
    mine = sorted({*left, *right})
    place = {m: i for i, m in enumerate(mine)}
    size = np.array([len(sets[m]) for m in mine])
    flat = np.concatenate([sets[m] for m in mine])
    row = np.repeat(np.arange(len(mine)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column]
    a, b = np.array([place[m] for m in left]), np.array([place[m] for m in right])
    at_left, at_right = (np.full(len(mine), -1) for _ in range(2))
    at_left[a], at_right[b] = np.arange(len(a)), np.arange(len(b))
    overlap = np.zeros(len(a) * len(b), np.int32)

    # Sparse columns: row pointers of the right sets by column, gathered for the left entries.
    dense = held > max(DENSE_FROM, len(mine) // 8)
    sparse = (held > 1) & ~dense
    name = np.unique(column[sparse], return_inverse=True)[1]
    rows = row[sparse]
    own, other = at_left[rows] >= 0, at_right[rows] >= 0
    pointer = np.searchsorted(name[other], np.arange((name.max() if len(name) else 0) + 2))
    posted, entry, of = at_right[rows[other]], at_left[rows[own]], name[own]
    counts = pointer[of + 1] - pointer[of]
    for x, y in _spans(counts, PRODUCT_ENTRIES):
        group, nth = K.spread(counts[x:y])
        i, j = entry[x:y][group], posted[pointer[of[x:y]][group] + nth]
        fits = 100 * np.minimum(size[a[i]], size[b[j]]) >= percent * np.maximum(size[a[i]], size[b[j]])
        overlap += np.bincount(i[fits] * len(b) + j[fits], minlength=len(overlap)).astype(np.int32)

    overlap = overlap.reshape(len(a), len(b))
    if dense.any():
        row, column = row[dense], np.unique(column[dense], return_inverse=True)[1]
        width = max(256, (1 << 21) // len(mine))
        for at in range(0, int(column.max()) + 1, width):
            x, y = np.searchsorted(column, [at, at + width])
            block = np.zeros((len(mine), width), np.float32)
            block[row[x:y], column[x:y] - at] = 1
            overlap += (block[a] @ block[b].T).astype(np.int32)
    total = size[a][:, None] + size[b][None, :]
    i, j = np.nonzero((100 + percent) * overlap.astype(np.int64) >= percent * total)
    return [left[x] for x in i.tolist()], [right[x] for x in j.tolist()]


def _spans(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts sum to ``limit`` at most, or one larger entry."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _multiplied(percent: int):
    """Spanning forests of the links within each task's blocks."""

    def run(table: pa.Table) -> pa.Table:
        task, doc = (table.column(c).to_numpy() for c in ("task", "doc_id"))
        sets = [np.frombuffer(g, K.U64) for g in table.column("grams").to_pylist()]
        a, b = [], []
        order = np.lexsort((doc, task))
        cut = np.flatnonzero(np.r_[True, task[order][1:] != task[order][:-1]]).tolist()
        for x, y in zip(cut, [*cut[1:], len(order)]):
            members = order[x:y].tolist()
            i, j = _product(sets, members, members, percent)
            a += doc[i].tolist()
            b += doc[j].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a, b = forest(a[a != b], b[a != b])
        return pa.table({"a": a, "b": b})

    return run


def _run_tasks(sets: DataFrame, percent: int, slots: int) -> DataFrame:
    """sets: doc_id, the tasks that it takes part in, grams."""
    bucketed = sets.select(F.explode("tasks").alias("task"), "doc_id", "grams").withColumn("bucket", F.pmod("task", F.lit(4 * slots)))
    return bucketed.groupBy("bucket").applyInArrow(_multiplied(percent), "a long, b long")


def components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Null and empty texts have empty sets and stay alone; texts under ``k``
    words are one n-gram; equal texts, repeated rows included, are linked; null
    ids count as one id, larger than all others. Other columns are not read.
    """
    texts, slots = numbered(docs), slots_for(docs)
    with freeing_shuffles(docs.sparkSession):
        groups = materialize(candidate_groups(texts, k, percent, slots), "groups").withColumnRenamed("node", "doc_id")
        told = texts.mapInArrow(K.trimmed(_told(k)), "doc_id long, n long, h1 long, h2 long").join(groups.hint("merge"), "doc_id", "left")
        sets = materialize(told.select("doc_id", "n", "h1", "h2", F.when(F.col("n") > 0, F.col("component")).alias("candidate")), "told")

        # One document for each different set of a candidate group, with its size class.
        same = ["candidate", "h1", "h2"]
        classes = materialize(sets.where("candidate is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
        linked = _linked(classes, texts, k, percent, slots)
    final = linked.select(F.col("node").alias("rep"), "component")

    found = classes.join(final, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    rows = sets.select("doc_id", "n", *same).join(found, same, "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NO_ID)).alias("component_id"))


def _linked(classes: DataFrame, texts: DataFrame, k: int, percent: int, slots: int) -> DataFrame:
    """(node, component) of the different sets of each candidate group that have links.

    Tasks are dealt out on rows of ids alone; a text is read again only if its
    set takes part in one, and a set is sent only to those.
    """
    families = Families(percent)
    largest = classes.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    lows = [int(x) for x in families.upto(largest)[0] if x <= largest]
    size_class = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda low: low <= F.col("n"))) - 1
    light = classes.select("candidate", F.col("rep").alias("doc_id"), "n", size_class.alias("c"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    whole = light.groupBy("candidate").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).where("docs > 1")
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("total") <= 4 * BLOCK_GRAMS)
    by_class = materialize(light.join(whole.where(~small), "candidate").groupBy("candidate", "c").agg(blocks.alias("blocks")), "blocks")

    # Small groups are one task. Large ones go along a chain: block i with block i + 1 of its
    # class, and the first blocks of neighbouring classes.
    tasks = light.join(whole.where(small).select("candidate"), "candidate").select(F.xxhash64("candidate").alias("task"), "doc_id")
    placed = light.join(by_class, ["candidate", "c"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    some_large = not by_class.isEmpty()
    if some_large:
        ring = F.array_distinct(F.array(F.col("block"), F.pmod(F.col("block") - 1, F.col("blocks"))))
        chain = F.transform(ring, lambda i: F.xxhash64(F.lit("ring"), "candidate", "c", i))
        steps = F.when(F.col("block") == 0, F.transform(F.array(F.col("c"), F.col("c") - 1), lambda c: F.xxhash64(F.lit("step"), "candidate", c))).otherwise(F.expr("cast(array() as array<bigint>)"))
        tasks = tasks.unionByName(placed.select(F.explode(F.concat(chain, steps)).alias("task"), "doc_id"))
    dealt = materialize(tasks.groupBy("doc_id").agg(F.collect_set("task").alias("tasks")), "tasks")
    with _sets(texts, dealt, k) as sets:
        edges = materialize(_run_tasks(sets, percent, slots), "links")
    component = connected_components(edges)
    if not some_large:
        return component

    # Large groups that are not one component yet: sets of different components that share rare n-grams meet.
    # Twice: once each with its column's first set, then, of what is still apart, all.
    grams, written = None, []
    for stars in (True, False):
        label = component.withColumnRenamed("node", "doc_id")
        labelled = placed.join(label, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
        apart = labelled.groupBy("candidate").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"), (F.min("label") < F.max("label")).alias("several")).where("several")
        apart = materialize(apart.select("candidate", "docs", "total"), "apart")
        total = apart.agg(F.sum("total").alias("n")).first()["n"]
        if not total:
            break
        labelled = labelled.join(apart, "candidate")
        if grams is None:  # components only grow, so the second time asks for some of the same sets
            wanted = materialize(labelled.select("doc_id").distinct(), "apart-docs")
            with _sets(texts, wanted, k) as sets, scratch() as written:
                grams = materialize(sets, "sets")
        pairs = _rare_pairs(labelled, grams, percent, stars, max(slots, -(-total // BLOCK_GRAMS)))
        edges = materialize(edges.unionByName(_verified_pairs(pairs, grams, percent)), "links")
        component = connected_components(edges)
    discard(texts.sparkSession, written)
    return component


#: A set's place in a column of the group's index of rare n-grams.
PLACE = K.Records(gram=K.U64, doc=np.int64, label=np.int64, size=np.int32, at=np.int32)
HELD = K.Records(gram=K.U64, n=np.uint16)


def _held(table: pa.Table) -> pa.Table:
    """The n-grams that several sets of a group's sample hold, and how many do."""
    sets = [np.frombuffer(g, K.U64) for g in table.column("grams").to_pylist()]
    grams, n = np.unique(np.concatenate(sets), return_counts=True)
    several = n > 1
    payload = HELD.pack({"gram": grams[several], "n": np.minimum(n[several], 65535)})
    return pa.table({"candidate": table.column("candidate").slice(0, 1), "held": pa.array([payload], pa.binary())})


def _placed(percent: int, buckets: int):
    """Places of the rarest n-grams of a block's sets: one more than may be missing from a set that links."""

    def run(table: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        if not table.num_rows:
            return none
        sets = [np.frombuffer(g, K.U64) for g in table.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets])
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        often = np.zeros(len(flat), np.int64)
        known = HELD.unpack_all(held.column("held").to_pylist())
        if len(known["gram"]):
            at = np.minimum(np.searchsorted(known["gram"], flat), len(known["gram"]) - 1)
            often = np.where(known["gram"][at] == flat, known["n"][at], 0)
        order = np.lexsort((flat, often, row))
        at = K.spread(size)[1]
        kept = at < (size - (percent * size + 99) // 100 + 1)[row]  # sorted by row, so rows and places are as they were
        own, at = row[kept], at[kept]
        candidate = table.column("candidate").to_numpy().astype(K.U64)
        gram = K.mix(flat[order][kept] ^ K.mix(candidate[own]))  # a column belongs to one group
        columns = {"gram": gram, "doc": table.column("doc_id").to_numpy()[own], "label": table.column("label").to_numpy()[own], "size": size[own], "at": at}
        rows = list(PLACE.split(columns, (gram % K.U64(buckets)).astype(np.int64)))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([x for _, x in rows], pa.binary())})

    return run


def pairs_of_columns(places: dict[str, np.ndarray], percent: int, stars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sets of different labels that share a column in which sizes and places allow a link; with ``stars`` each only with its column's first."""
    order = np.lexsort((places["doc"], places["gram"]))
    gram, doc, label, size, at = (places[c][order] for c in ("gram", "doc", "label", "size", "at"))
    size, at = size.astype(np.int64), at.astype(np.int64)
    new = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    column = np.cumsum(new) - 1
    # Columns of one label have nothing to tell.
    several = np.minimum.reduceat(label, first) < np.maximum.reduceat(label, first) if len(first) else np.zeros(0, bool)
    left = np.flatnonzero(several[column] & ~new) if len(first) else first
    a, b, step = [], [], 1
    while len(left):
        left = left if stars else left[left - step >= first[column[left]]]
        other = first[column[left]] if stars else left - step
        low, high = np.minimum(size[left], size[other]), np.maximum(size[left], size[other])
        shared = np.minimum(size[left] - at[left], size[other] - at[other])  # at most, if this is their first column
        fits = (label[left] != label[other]) & (100 * low >= percent * high) & ((100 + percent) * shared >= percent * (low + high))
        a.append(doc[left[fits]])
        b.append(doc[other[fits]])
        if stars:
            break
        step += 1
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pairs[0], pairs[1]


def _rare_pairs(labelled: DataFrame, grams: DataFrame, percent: int, stars: bool, buckets: int) -> DataFrame:
    """(a, b) of sets that may link across the components of their group (candidate, docs, c, block, doc_id, label)."""
    sets = labelled.select("candidate", "docs", "c", "block", "doc_id", "label").join(grams.hint("merge"), "doc_id")
    sampled = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.ceil(F.col("docs") / BLOCK_DOCS)) == 0
    held = labelled.where(sampled).select("candidate", "doc_id").join(grams.hint("merge"), "doc_id").groupBy("candidate").applyInArrow(_held, "candidate long, held binary")
    task = F.xxhash64("candidate", "c", "block").alias("task")
    beside = labelled.select("candidate", task).distinct().join(held, "candidate").select("task", "held")
    blocks = sets.select(task, "candidate", "doc_id", "label", "grams").groupBy("task").cogroup(beside.groupBy("task"))
    places = blocks.applyInArrow(_placed(percent, buckets), "bucket int, payload binary")

    def paired(table: pa.Table) -> pa.Table:
        a, b = pairs_of_columns(PLACE.unpack_all(table.column("payload").to_pylist()), percent, stars)
        return pa.table({"a": a, "b": b})

    return places.groupBy("bucket").applyInArrow(paired, "a long, b long").distinct()


def _verified_pairs(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                x, y = np.frombuffer(one, K.U64), np.frombuffer(two, K.U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append((100 + percent) * shared >= percent * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("one"))
    two = grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("two"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "one", "two").mapInArrow(verified, "a long, b long")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without all but the first of each component.

    Different texts under one id, or without an id, are different documents
    (see ``by_own_ids``); equal rows under one id stay together.
    """
    return by_own_ids(docs, lambda told: _keep_first(told, k, percent))


def _keep_first(docs: DataFrame, k: int, percent: int) -> DataFrame:
    later = components(docs, k, percent).where("component_id <> doc_id or (doc_id is null and component_id is not null)")
    gone = later.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id")).distinct()
    return docs.join(gone.hint("merge"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["gone_id"], "left_anti")
