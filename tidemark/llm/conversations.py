"""Conversation structure repair: the cheapest edits that make the roles alternate, found by a streamed dynamic program.

Rows are repartitioned by conversation and sorted by turn; a task streams through its conversations in Arrow batches and
carries only the program's state. The program runs from the last turn to the first: for each state of the automaton
of allowed role sequences it knows the least cost of the turns to come, so the choice of a row's edit, ties included,
is settled when the row is read. The choices of the four states are a two-byte backpointer; those of a giant
conversation spill to disk in the task and are read backwards at its end. A second stream, from the first turn on,
applies the edits to the rows. No task holds a conversation's rows or texts; its audit string has a byte for each edit.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of a new role, a deletion, an insertion, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: ASCII white space, and the marks that end a whole text.
SPACE, MARKS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Bytes of backpointers in memory, for each conversation that is being read; more go to a file of the task.
SPILL = 1 << 20

# The automaton of (s?(ua)+)?: before the first role, after a system row, a user row, an assistant row.
_START, _S, _U, _A = range(4)
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}  # by the role that an insertion or a new role brings
_ENDS = {_START: (0, ""), _S: (2 * INSERT, "II"), _U: (INSERT, "I"), _A: (0, "")}


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role."""
    if initial == "s" and state == _START:
        return _S
    follow = _NEXT[state]
    return follow if initial == ("u" if follow == _U else "a") else None


@cache
def _step(initial: str, fault: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(base, costs, choices) of a row for each state: the cost from it on is base + cost, the choice (letters, next).

    ``after`` are the costs behind the row, less a common base. Of equal costs the letter first in ASCII is taken; a
    letter settles the next state, so equal audits never part. Costs differ by a bounded amount, so few keys arise.
    """
    stay = TRUNCATED if fault == "truncated" else 0
    own: list[tuple[int, str, int]] = []
    for state in range(4):
        options = [(DELETE + after[state], "D", state)]
        if fault not in ("blank", "duplicate"):
            follow = _kept(state, initial)
            if follow is not None:
                options.append((stay + after[follow], "K", follow))
            options.append((stay + REROLE + after[_NEXT[state]], "R", _NEXT[state]))
        own.append(min(options))
    best: list[tuple[int, str, int]] = []
    for state in range(4):  # up to three insertions before the row; more only repeat
        options, at = [], state
        for inserted in range(4):
            cost, letter, follow = own[at]
            options.append((cost + inserted * INSERT, "I" * inserted + letter, follow))
            at = _NEXT[at]
        best.append(min(options))
    base = min(cost for cost, _, _ in best)
    return base, tuple(cost - base for cost, _, _ in best), tuple((letters, follow) for _, letters, follow in best)


class _Program:
    """The program's state for one conversation, fed with rows from the last to the first."""

    def __init__(self, codes: dict, tables: list) -> None:
        self.codes, self.tables = codes, tables  # (initial, fault, costs) -> (code, base, costs); code -> choices
        self.base, self.costs = 0, tuple(_ENDS[s][0] for s in range(4))
        self.recent, self.file = array("H"), None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.later = 0, None
        self.first = self.last = None
        self.distinct = 0

    def feed(self, turn: int | None, initial: str, fault: str) -> None:
        key = (initial, fault, self.costs)
        found = self.codes.get(key)
        if found is None:
            base, costs, choices = _step(*key)
            found = self.codes[key] = (len(self.tables), base, costs)
            self.tables.append(choices)
        code, base, self.costs = found
        self.base += base
        self.recent.append(code)
        if 2 * len(self.recent) >= SPILL:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # gone with the task
            self.recent.tofile(self.file)
            self.recent = array("H")
        if fault:
            self.counts[fault] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.first:
            self.first, self.distinct = turn, self.distinct + 1
            self.last = turn if self.last is None else self.last

    def _codes_from_the_first(self) -> Iterator[int]:
        yield from reversed(self.recent)
        at = self.file.tell() if self.file else 0
        while at:
            size = min(at, SPILL)
            at -= size
            self.file.seek(at)
            part = array("H")
            part.frombytes(self.file.read(size))
            yield from reversed(part)

    def result(self) -> tuple[int, int, int, int, int, int, str]:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit)."""
        state, letters = _START, []
        for code in self._codes_from_the_first():
            some, state = self.tables[code][state]
            letters.append(some)
        letters.append(_ENDS[state][1])
        if self.file:
            self.file.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.counts.values(), self.illegal, self.base + self.costs[_START], "".join(letters)


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``digest``, which breaks ties of turn and role."""
    digest = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    return rows.select("conv", "turn", "role", "text", digest.alias("digest"))


def _as_rows(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    one = F.lit(" ")
    return rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text")
    )


def audit(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): the faults and the cheapest edits of each conversation.

    Rows go by turn, nulls first; rows of one turn by role, then by the digest of role and text, so equal rows are
    neighbours. Null roles and texts are one blank; rows whose conversation is null are one conversation. A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated (no mark at the end). The letters of
    the edits are those of Keep, Rerole, Delete and Insert, in order; of the cheapest the first in ASCII.
    """
    marked = _marked(_as_rows(rows, conv_col, turn_col))
    trimmed, initial = F.rtrim("text", F.lit(SPACE)), F.substring("role", 1, 1)
    slim = marked.select(
        "conv", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"),
        F.when(trimmed == "", "blank").when(F.right(trimmed, F.lit(1)).isin(*MARKS), "").otherwise("truncated").alias("fault"),
    )
    # Sorted by conversation and text in the task that streams it next, so one shuffle serves both.
    placed = slim.repartition("conv")
    number = "row_number() over (partition by conv, digest order by turn asc nulls first, role)"
    faulty = placed.withColumn("again", F.expr(number) > 1).withColumn(
        "fault", F.when((F.col("fault") != "blank") & F.col("again"), "duplicate").otherwise(F.col("fault"))
    )
    ordered = faulty.sortWithinPartitions(F.asc_nulls_first("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("again"))
    kind = slim.schema["conv"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables = {}, []
        program, conv = None, None
        for batch in batches:
            done = []
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if program is None or own != conv:
                    if program:
                        done.append((conv, *program.result()))
                    program, conv = _Program(codes, tables), own
                program.feed(*row)
            yield _as_batch(done, batch.schema.field(0).type)
        if program:
            yield _as_batch([(conv, *program.result())], batch.schema.field(0).type)

    def _as_batch(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 8
        types = [conv_type, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", *_SUMMARY])

    schema = f"conv {kind}, " + ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in _SUMMARY)
    return ordered.select("conv", "turn", "initial", "fault").mapInArrow(stream, schema).withColumnRenamed("conv", conv_col)


def repair(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, place, turn, role, text, edit): the rows that the edits of :func:`audit` leave, numbered from 0.

    Inserted rows have an empty text and no turn. Rows and audits meet in one sorted stream, an audit before its rows.
    """
    marked = _marked(_as_rows(rows, conv_col, turn_col)).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(conv_col).alias("conv"), F.col("audit"))
    both = marked.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest"
    )
    kind, turn_kind = (marked.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, place, started, conv = "", 0, 0, 0, None
        done: list[tuple] = []

        def role() -> str:
            return "user" if (place - started) % 2 == 0 else "assistant"

        def insert() -> None:
            nonlocal at, place
            while at < len(edits) and edits[at] == "I":
                done.append((conv, place, None, role(), "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            for own, turn, old, text, edits_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edits_of is not None:
                    insert()  # what the conversation before still needs
                    edits, at, place, conv = edits_of, 0, 0, own
                    started = (len(edits) - edits.count("D")) % 2  # an odd number of rows has a system row first
                    continue
                insert()
                edit, at = edits[at], at + 1
                if edit != "D":
                    done.append((own, place, turn, old if edit == "K" else role(), text, edit))
                    place += 1
            yield as_batch(done, batch.schema)
            done.clear()
        insert()
        if done:
            yield as_batch(done, batch.schema)

    def as_batch(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 6
        types = [schema.field("conv").type, pa.int64(), schema.field("turn").type, pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", "place", "turn", "role", "text", "edit"]
        )

    kept = both.select("conv", "turn", "role", "text", "audit")
    out = kept.mapInArrow(stream, f"conv {kind}, place long, turn {turn_kind}, role string, text string, edit string")
    return out.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, sha256) of ``role:text`` lines joined by line feeds, from the rows of :func:`repair` as they stream."""
    kind = repaired.schema[conv_col].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None

        def as_batch(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([d for _, d in done], pa.string())], names=["conv", "sha256"])

        for batch in batches:
            done = []
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            yield as_batch(done, batch.schema.field(0).type)
        if digest:
            yield as_batch([(conv, digest.hexdigest())], batch.schema.field(0).type)

    rows = repaired.select(F.col(conv_col).alias("conv"), "place", "role", "text")
    return rows.mapInArrow(stream, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage that the crc32 of ``conv_id:turn`` modulo 20 settles; nulls are one blank.

    0 drops the row, 1 empties its text, 2 removes full stops, question and exclamation marks, 3 repeats the row,
    4 makes it a user's.
    """
    one = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), one)
    way: Column = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(part("text"), "".join(MARKS), "")).otherwise(part("text"))
    role = F.when(way == 4, "user").otherwise(part("role"))
    made = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), way.alias("way")).where("way <> 0")
    return made.withColumn("way", F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("way")
