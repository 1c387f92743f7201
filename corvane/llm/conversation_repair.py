"""Repair of conversations: the cheapest edits that give turns the order of a dialogue.

The roles of a repaired conversation, by their initials, match ``(s?(ua)+)?``.
Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3 (all
that a blank or duplicate turn allows), Insert an empty user or assistant turn
2; a truncated turn that stays adds 1. Of equally cheap edits the ASCII-least
string of initials is taken.

1. Conversations are dealt out by conv_id, once, with their texts; three sorts
   inside the tasks, which may spill, do the rest.
2. A window over equal turns finds the duplicates.
3. Turns pass backwards: the costs to go behind each turn, by the grammar's
   state, are attached to it.
4. Turns pass forwards: at each, the ASCII-least edit among those that the
   costs to go allow, and so the repaired turns, their hash and the counts.

Both passes hold one turn and four numbers of a conversation, so its length
bounds no memory but that of its own audit string. A conversation is one
sequence with one hash, so its turns pass one task in order.

Defined results: turns of equal number go by role, then text; repeated rows are
turns of their own (and duplicates); a null turn number comes first; null roles
and texts read as one space, so such a role is in no grammar and such a text is
blank; an empty role is in no grammar; a null conv_id is a conversation; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, U, A, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system, a user, an assistant turn. Where a role leads from each state.
NEXT = {(0, S): 1, (0, U): 2, (1, U): 2, (2, A): 3, (3, U): 2}
#: The state that the one insertable turn leads to, and its role.
INSERTED = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
#: Costs to go behind the last turn.
END = (0, 4, 2, 0)
_NO_SPACE = r"[^\x20\x09-\x0D]"
_ORDER = ("turn", "role", "text", "copy")


def damage(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of their ids: some dropped (``gone``), emptied, unpunctuated, repeated or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def turns(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as they are, in the form that ``damage`` returns."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Each turn with the number of its first fault; all turns of a conversation in one partition."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    last = F.regexp_extract("text", rf"(?s)({_NO_SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(_NO_SPACE), BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    )
    return rows.repartition(partitions, "conv_id").withColumn("fault", fault)


def _closed(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, 2 + costs[INSERTED[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _moves(after: tuple[int, ...], role: int, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost to go) of what may become of a turn, but for insertions before it."""
    yield "D", state, 3 + after[state]
    if fault not in (BLANK, DUPLICATE):
        late = int(fault == TRUNCATED)
        if (state, role) in NEXT:
            to = NEXT[state, role]
            yield "K", to, late + after[to]
        to = INSERTED[state]
        yield "R", to, 2 + late + after[to]


@cache
def before(after: tuple[int, ...], role: int, fault: int) -> tuple[int, ...]:
    """Costs to go before a turn, by state, from those behind it."""
    return _closed([min(cost for _, _, cost in _moves(after, role, fault, q)) for q in range(4)])


@cache
def walk(after: tuple[int, ...], role: int, fault: int, state: int) -> tuple[str, int, tuple[str, ...], str]:
    """The ASCII-least tight edits up to and with a turn: initials, the state reached, roles inserted before it, its new role."""
    togo, said, roles = before(after, role, fault), "", ()
    while True:
        tight = {edit: to for edit, to, cost in _moves(after, role, fault, state) if cost == togo[state]}
        if 2 + togo[INSERTED[state]] == togo[state]:
            tight["I"] = INSERTED[state]
        edit = min(tight)
        said, state = said + edit, tight[edit]
        if edit != "I":
            return said, state, roles, ROLE_OF[state] if edit == "R" else ""
        roles += (ROLE_OF[state],)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attaches the costs to go behind each turn, less their minimum; turns come in falling order."""
    own, after = object(), END
    for batch in batches:
        out = []
        for conv, gone, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "initial", "fault"))):
            if conv != own:
                own, after = conv, END
            out.append(list(after))
            if not gone:
                costs = before(after, role, fault)
                low = min(costs)
                after = tuple(c - low for c in costs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "after"])


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns in order within their tasks, each with its initial's number, its fault and the costs to go behind it."""
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(OTHER))
    marked = faults(rows).withColumn("initial", F.when(F.col("role") == "", OTHER).otherwise(initial).cast("int"))
    falling = marked.sortWithinPartitions(F.desc("conv_id"), F.desc("gone"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("copy"))
    costed = falling.mapInArrow(_backward, T.StructType([*marked.schema.fields, T.StructField("after", T.ArrayType(T.IntegerType()))]))
    return costed.sortWithinPartitions("conv_id", "gone", F.asc_nulls_first("turn"), "role", "text", "copy")


class _Conversation:
    """What the forward pass knows of one conversation."""

    def __init__(self, conv: object):
        self.conv, self.state, self.audit, self.cost = conv, 0, [], 0
        self.counts, self.illegal, self.last = [0] * 4, 0, None
        self.low = self.high = None
        self.numbers = 0
        self.place = 0

    def step(self, turn: int | None, role: str, text: str, initial: int, fault: int, after: list[int]) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns that this turn brings."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.numbers = turn if self.low is None else self.low, turn, self.numbers + 1
        self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        said, self.state, inserted, new = walk(tuple(after), initial, fault, self.state)
        self.audit.append(said)
        self.cost += 2 * len(inserted) + {"D": 3, "K": 0, "R": 2}[said[-1]] + (said[-1] != "D" and fault == TRUNCATED)
        yield from (("I", r, "") for r in inserted)
        if said[-1] != "D":
            yield said[-1], new or role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while END[self.state]:
            self.state = INSERTED[self.state]
            self.audit.append("I")
            self.cost += 2
            yield "I", ROLE_OF[self.state], ""

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.numbers


def _forward(batches: Iterator[pa.RecordBatch], take, close) -> None:
    """Walks the turns in order; ``take`` gets each repaired turn, ``close`` each conversation at its end."""
    now: _Conversation | None = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "initial", "fault", "after"))
        for conv, gone, *turn in zip(*columns):
            if now is None or now.conv != conv:
                if now is not None:
                    for made in now.end():
                        take(now, *made)
                    close(now)
                now = _Conversation(conv)
            if not gone:
                for made in now.step(*turn):
                    take(now, *made)
        yield
    if now is not None:
        for made in now.end():
            take(now, *made)
        close(now)
    yield


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of the repaired turns; ``rows`` as ``turns`` or ``damage`` returns them."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("place long, edit string, role string, text string").fields])
    arrow = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        kind = None

        def take(now: _Conversation, edit: str, role: str, text: str) -> None:
            made.append((now.conv, now.place, edit, role, text))
            now.place += 1

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for _ in _forward(seen(batches), take, lambda now: None):
            if made:
                columns = list(zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, f.type) for c, f in zip(columns[1:], arrow))], names=["conv_id", *arrow.names])
                made.clear()

    return _ordered(rows).mapInArrow(run, schema)


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows``, dropped turns included: the contract of operator 12."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_DIGEST).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        kind = None

        def take(now: _Conversation, edit: str, role: str, text: str) -> None:
            if now.place == 0:
                now.hash = hashlib.sha256()
            now.hash.update(f"{chr(10) if now.place else ''}{role}:{text}".encode())
            now.place += 1

        def close(now: _Conversation) -> None:
            sha = now.hash if now.place else hashlib.sha256()
            done.append((now.conv, now.gaps(), now.counts[BLANK], now.counts[DUPLICATE], now.counts[TRUNCATED], now.illegal, now.cost, "".join(now.audit), sha.hexdigest()))

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for _ in _forward(seen(batches), take, close):
            if done:
                columns = list(zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=names)
                done.clear()

    return _ordered(rows).mapInArrow(run, schema)
