"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line (smaller doc_id, then smaller line number) is
equal to it, or within ``edits`` insertions, deletions and substitutions of it.
Near matches take lines of ``min_chars`` code points or more: a few edits turn
short lines into any other. Equal lines go from ``exact_chars`` on, which is
``min_chars`` unless it is given, as the SQL counterpart has one floor for both.

Of edits + 1 disjoint segments of a line, at least one stands unchanged in any
line within that many edits. Equal lines collapse first, by a partial
aggregate, so a line that fills a third of the corpus is one row from each task.

One edit (the default). A line is indexed by both lengths of a pair that it can
be in: a substitution leaves its length, an insertion or deletion pairs it with
the next one. For each, the places where the edit can be are cut in two; the
key is all that stands before and after them. A key that up to ``MET`` lines
share brings these together. One that more lines share is cut again: the places
left are parted in ``PIECES``, and only lines that still agree meet, until one
place is left, where all lines of a key are within one edit, and the earliest
speaks for it. So thousands of near copies of one line cost a few keys each
and never meet pair by pair: a cut makes ``PIECES`` keys of one, however many
lines share it. A key of an insertion or deletion whose lines all have one
length holds no pair and is not cut.

More edits. Lines are indexed by length band (``BAND`` code points; one for
each length below 2 * BAND): a band whose shortest line has n code points cuts
segments of n // (edits + 1) code points, the first ones side by side from the
line's start, the last one at its end. A line probes every band that a line
within ``edits`` of it can be in: the first and the last segment where they
are, those between at every shift up to ``edits``. Here lines that share a
segment and nearly a length meet pair by pair.

Keys are hashes; each candidate pair is then verified on the texts by a banded
bit-parallel edit distance: the band's 2 * edits + 1 diagonals are the bits of
one number, and one step of a few bit operations takes in one code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.own_ids import NO_ID, by_own_ids
from corvane.sources.shared import materialize

EDITS = 1
MIN_CHARS = 30
BAND = 8
#: Lines of one key that meet pair by pair; keys of more lines are cut again, in so many pieces.
MET, PIECES = 8, 8
#: Bits of a band that one number holds.
WORD = 62


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id (null: the largest), line_no from 0, line; null texts have no lines."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(doc, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _band(n: Column) -> Column:
    """The length band of a line of ``n`` code points: one for each length below 2 * BAND, then one for every BAND lengths."""
    return F.when(n < 2 * BAND, F.greatest(n, F.lit(0))).otherwise(F.floor(n / BAND) + 2 * BAND - 2).cast("int")


def _segment_keys(band: Column, edits: int, shifted: bool) -> list[Column]:
    """Hashes of (band, segment number, segment), at every shift if ``shifted``."""
    shortest = F.when(band < 2 * BAND, band).otherwise((band - 2 * BAND + 2) * BAND)
    size = F.floor(shortest / (edits + 1)).cast("int")
    n = F.col("n")
    keys = [F.xxhash64(band, F.lit(edits), F.substring(F.col("line"), n - size + 1, size))]
    for i in range(edits):
        for shift in range(-edits, edits + 1) if shifted and i else (0,):
            keys.append(F.xxhash64(band, F.lit(i), F.substring(F.col("line"), size * i + shift + 1, size)))
    return keys


def _parted(kind: Column, short: Column, before: Column, after: Column, pieces: int) -> Column:
    """The places where one edit can be, between ``before`` and ``after`` code points that stand, parted in ``pieces``.

    ``kind`` 0 is a substitution in lines of ``short`` code points, 1 a
    deletion that leaves ``short``: a place more than code points.
    """
    last = short - before - after + kind - 1
    size = F.floor(F.greatest(last, F.lit(0)) / pieces).cast("int") + 1
    parts = F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / size).cast("int"))
    struct = lambda i: F.struct(kind.alias("kind"), short.alias("short"), (before + i * size).alias("before"), (after + F.greatest(last - i * size - size + 1, F.lit(0))).alias("after"))
    return F.when(last >= 0, F.transform(parts, struct)).otherwise(F.expr("cast(array() as array<struct<kind:int,short:int,before:int,after:int>>)"))


def _key(kind: Column, short: Column, before: Column, after: Column, line: Column, n: Column) -> Column:
    """A hash of a state's lengths and of what stands before and after the places left."""
    return F.xxhash64(kind, short, before, after, F.substring(line, F.lit(1), before), F.substring(line, n - after + 1, after))


def _halves(n: Column) -> list[tuple[Column, tuple[Column, Column, Column, Column]]]:
    """The first states of a line of ``n``: a substitution, a character too few, one too many; places in two halves each, and whether there is such a half."""
    zero, out = F.lit(0), []
    for kind, short in ((0, n), (1, n), (1, n - 1)):
        last = short + kind - 1
        size = F.shiftright(F.greatest(last, zero), 1) + 1
        out.append((last >= 0, (F.lit(kind), short, zero, F.greatest(last - size + 1, zero))))
        out.append((last >= size, (F.lit(kind), short, size, F.greatest(last - 2 * size + 1, zero))))
    return out


def keyed_lines(lines: DataFrame, edits: int, min_chars: int, exact_chars: int) -> DataFrame:
    """Lines of exact_chars or more by place: two content hashes, length, and, from min_chars on, the keys that near lines share."""
    rows = lines.withColumn("n", F.length("line")).where(F.col("n") >= min(exact_chars, min_chars))
    near, line, n = F.col("n") >= min_chars, F.col("line"), F.col("n")
    if edits == 1:
        found = [F.when(near, F.array(*[F.when(there, _key(*state, line, n)) for there, state in _halves(n)])).alias("keys")]
    else:
        low, own, high = (_band(n + d) for d in (-edits, 0, edits))
        # So many bands hold lengths that are 2 * edits apart.
        steps = (2 * edits if min_chars - edits < 2 * BAND else -(-2 * edits // BAND)) + 1
        none = F.expr("cast(array() as array<bigint>)")
        probes = F.concat(*[F.when(near & (low + i <= high), F.array(*_segment_keys(low + i, edits, True))).otherwise(none) for i in range(steps)])
        found = [F.when(near, F.array(*_segment_keys(own, edits, False))).otherwise(none).alias("index"), probes.alias("probe")]
    return rows.select("doc_id", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2"), "n", *found)


def _pairs(index: DataFrame, probe: DataFrame, *keys: str) -> DataFrame:
    """Places of index and probe rows with equal keys, the index row's first and earlier."""
    x = index.select(*keys, F.col("doc_id").alias("x_doc"), F.col("line_no").alias("x_line"), F.col("n").alias("x_n"))
    y = probe.select(*keys, F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("n").alias("y_n"))
    return x.join(y.hint("merge"), list(keys)).where((F.col("x_doc") < F.col("y_doc")) | ((F.col("x_doc") == F.col("y_doc")) & (F.col("x_line") < F.col("y_line"))))


_PAIR = ["x_doc", "x_line", "y_doc", "y_line"]


def said_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, line_no, line of the places."""
    wanted = places.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    # The wanted lines grow with the corpus: they meet the texts by a shuffle at every size, never by a broadcast.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")
    rows = texts.select("doc_id", F.explode("wanted").alias("line_no"), F.split("text", "\n", -1).alias("lines"))
    # Rows that are one document have the same lines; one of them is enough.
    return rows.select("doc_id", "line_no", F.get("lines", F.col("line_no")).alias("line")).where("line is not null").dropDuplicates(["doc_id", "line_no"])


def _shared(states: DataFrame) -> DataFrame:
    """States whose key several lines share."""
    shared = states.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    return states.join(shared.hint("merge"), "key")


def _of_both_lengths(met: DataFrame) -> DataFrame:
    """Without the keys of a deletion whose lines all have one length: a pair in one of them has the key of a substitution as well."""
    lengths = met.where("kind = 1").groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low < high").select("key")
    return met.where("kind = 0").unionByName(met.where("kind = 1").join(lengths.hint("merge"), "key"))


def _led(met: DataFrame) -> DataFrame:
    """With the place of each key's earliest line."""
    return met.join(met.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("lead")).hint("merge"), "key")


_STATE = ["kind", "short", "before", "after"]


def one_edit_pairs(first: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of lines that may be within one edit, a few for each line, and the lines that they name."""
    # Most keys have one line: until those are gone, a row is its key, its place and which of the first states it is.
    keys = first.select("doc_id", "line_no", "n", F.posexplode("keys").alias("which", "key")).where("key is not null")
    state = F.get(F.array(*[F.struct(*[c.alias(name) for c, name in zip(state, _STATE)]) for _, state in _halves(F.col("n"))]), F.col("which"))
    met = materialize(_shared(keys).withColumn("state", state).select("doc_id", "line_no", "n", "key", "lines", *[F.col("state")[c].alias(c) for c in _STATE]), "line-keys")
    said, pairs = materialize(said_lines(docs, met), "said-lines"), []
    one_place = F.col("short") - F.col("before") - F.col("after") + F.col("kind") <= 1
    while True:
        few = met.where((F.col("lines") <= MET) & ~one_place)
        # A substitution leaves the length, a deletion takes one.
        pairs.append(_pairs(few, few, "key", "kind").where(F.abs(F.col("x_n") - F.col("y_n")) == F.col("kind")).select(*_PAIR))
        led = _led(met.where(one_place)).where((F.col("doc_id") != F.col("lead.doc_id")) | (F.col("line_no") != F.col("lead.line_no")))
        pairs.append(led.select(F.col("lead.doc_id").alias("x_doc"), F.col("lead.line_no").alias("x_line"), F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line")))
        many = _of_both_lengths(met.where((F.col("lines") > MET) & ~one_place)).select("doc_id", "line_no", "n", *_STATE)
        if many.isEmpty():
            break
        again = many.join(said.hint("merge"), ["doc_id", "line_no"])
        parts = again.select("doc_id", "line_no", "n", "line", F.explode(_parted(*(F.col(c) for c in _STATE), PIECES)).alias("s"))
        states = parts.select("doc_id", "line_no", "n", *[F.col("s")[c].alias(c) for c in _STATE], _key(*[F.col("s")[c] for c in _STATE], F.col("line"), F.col("n")).alias("key"))
        # Written first: else the lines are cut once to count a key's lines and once more to join the count.
        met = materialize(_shared(materialize(states, "line-states")), "line-keys")
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "line-pairs"), said


def band_pairs(first: DataFrame, docs: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of lines that share a segment and nearly a length, and the lines that they name."""
    place = ["doc_id", "line_no", "n"]
    index = first.select(*place, F.explode("index").alias("key"))
    probe = first.select(*place, F.explode(F.array_distinct("probe")).alias("key"))
    pairs = materialize(_pairs(index, probe, "key").where(F.abs(F.col("x_n") - F.col("y_n")) <= edits).select(*_PAIR).distinct(), "line-pairs")
    places = [pairs.select(F.col(f"{side}_doc").alias("doc_id"), F.col(f"{side}_line").alias("line_no")) for side in "xy"]
    return pairs, materialize(said_lines(docs, places[0].unionByName(places[1])), "said-lines")


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by ``edits`` at most; right up to ``edits``, larger beyond.

    Bit b of column j stands for the cell of row j - edits + b of the distance
    matrix. ``up`` and ``down`` mark where a cell is one more or less than the
    one above it, ``same`` where it equals the one before it on its diagonal.
    The count runs along the diagonal that ends in the last cell.
    """
    if 2 * edits + 1 > WORD:
        return F.levenshtein(F.array_join(x, ""), F.array_join(y, ""))
    full = (1 << (2 * edits + 1)) - 1
    bits = lambda n: F.lit(n).cast("long")
    end = F.size(x) - F.size(y) + edits

    def step(s: Column, j: Column) -> Column:
        equal = bits(0)
        for b in range(2 * edits + 1):
            equal = equal.bitwiseOR(F.when(F.get(x, j - edits + b - 1) == F.get(y, j - 1), bits(1 << b)).otherwise(bits(0)))

        def taken(same: Column) -> Column:
            more = s.down.bitwiseOR(F.bitwise_not(same.bitwiseOR(s.up)).bitwiseAND(bits(full)))
            before = F.shiftright(same, 1)
            up = same.bitwiseAND(s.up).bitwiseOR(F.bitwise_not(before.bitwiseOR(more)).bitwiseAND(bits(full)))
            stays = F.call_function("shiftright", same, end).bitwiseAND(bits(1))
            return F.struct(up.alias("up"), more.bitwiseAND(before).alias("down"), (s.n + 1 - stays).alias("n"))

        def same(e: Column) -> Column:
            carried = (e.bitwiseAND(s.up) + s.up).bitwiseXOR(s.up)
            return carried.bitwiseOR(e).bitwiseOR(s.down).bitwiseAND(bits(full))

        return F.get(F.transform(F.transform(F.array(equal), same), taken), F.lit(0))

    start = F.struct(bits(full - (1 << edits) + 1).alias("up"), bits(0).alias("down"), F.greatest(F.size(x) - F.size(y), F.lit(0)).cast("long").alias("n"))
    columns = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(columns, start, step, lambda s: s.n)


def near_lines(said: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """Places of the later lines of the candidate pairs that are within ``edits``."""
    characters = F.filter(F.split("line", ""), lambda c: c != "")
    x = said.select(F.col("doc_id").alias("x_doc"), F.col("line_no").alias("x_line"), characters.alias("x"))
    y = said.select(F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), characters.alias("y"))
    both = pairs.join(x.hint("merge"), ["x_doc", "x_line"]).join(y.hint("merge"), ["y_doc", "y_line"])
    close = (F.abs(F.size("x") - F.size("y")) <= edits) & (banded_distance(F.col("x"), F.col("y"), edits) <= edits)
    return both.where(close).select(F.col("y_doc").alias("f_doc"), F.col("y_line").alias("f_line")).distinct()


def removals(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """doc_id (null: the largest), exact and near: the numbers of the lines that go, for documents that lose any."""
    rows = keyed_lines(lines_of(docs), edits, min_chars, min_chars if exact_chars is None else exact_chars)
    place = F.struct("doc_id", "line_no")
    grouped = rows.groupBy("k1", "k2").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("k1", "k2")]), place).alias("f"))
    first = materialize(grouped.select("k1", "k2", "f.*"), "lines")
    pairs, said = one_edit_pairs(first, docs) if edits == 1 else band_pairs(first, docs, edits)
    near = materialize(near_lines(said, pairs, edits), "near-lines")
    verdict = first.select("k1", "k2", F.col("doc_id").alias("f_doc"), F.col("line_no").alias("f_line")).join(near.withColumn("near", F.lit(True)), ["f_doc", "f_line"], "left")
    judged = rows.select("doc_id", "line_no", "k1", "k2").join(verdict, ["k1", "k2"])
    later = (F.col("doc_id") != F.col("f_doc")) | (F.col("line_no") != F.col("f_line"))
    gone = judged.where(later | F.col("near"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(later, F.col("line_no")))).alias("exact"), F.array_sort(F.collect_set(F.when(~later, F.col("line_no")))).alias("near"))


def _with_removals(docs: DataFrame, edits: int, min_chars: int, exact_chars: int | None, *columns: Column) -> DataFrame:
    gone = removals(docs, edits, min_chars, exact_chars).withColumnRenamed("doc_id", "gone_id")
    kept = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("gone_id"), *columns)
    none = F.expr("cast(array() as array<int>)")
    return kept.join(gone.hint("merge"), "gone_id", "left").withColumn("exact", F.coalesce("exact", none)).withColumn("near", F.coalesce("near", none))


def digest(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """One row per document: n_lines, n_exact and n_near lines that go, and the numbers of all of them, comma-joined.

    Null texts have no lines; an empty text has one, empty, that stays. Equal
    rows that share an id count as one document: they give equal results and
    do not remove each other's lines. Different texts under one id, or without
    an id, are different documents (see ``by_own_ids``). Null ids are larger
    than all others. Columns besides doc_id and text are not read.
    """
    return by_own_ids(docs, lambda told: _digest(told, edits, min_chars, exact_chars))


def _digest(docs: DataFrame, edits: int, min_chars: int, exact_chars: int | None) -> DataFrame:
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = _with_removals(docs, edits, min_chars, exact_chars, F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"))
    return rows.select("doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"), F.array_join(F.array_sort(F.concat("exact", "near")), ",").alias("removed_lines"))


def remove_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """The documents, with all their columns, without the lines that go."""
    return by_own_ids(docs, lambda told: _remove_lines(told, edits, min_chars, exact_chars))


def _remove_lines(docs: DataFrame, edits: int, min_chars: int, exact_chars: int | None) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _with_removals(docs, edits, min_chars, exact_chars, row.alias("row"))
    gone = F.concat("exact", "near")
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.size(gone) == 0, F.col("row.text")).otherwise(kept).alias("text")
    return rows.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
