"""Repair of damaged conversations: find faulty turns, and the cheapest edits to a valid structure.

Rows are range-sorted by conversation and turn, so a conversation of any length spreads over as many
tasks as it needs. A task repairs the conversations it holds whole. Of the others, and of longer ones,
it makes segments with a table of least solutions between any two states; tables are put together per
task and then per conversation, the way through them goes back to the segments, and these write
their part of the repaired text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.llm import turns as T
from bazaarflow.session import materialise

SEGMENT = 256
_BLANKS = " \t\n\x0b\x0c\r"
_STEPS = ("su", "ua", "au")
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STATS = ("low long, high long, turns long, head string, tail string, "
          "blank long, duplicate long, truncated long, illegal long")
_PIECE = f"key string, part long, seq long, whole boolean, {_STATS}, cost long, audit string, sha string, paths string, body binary"


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows (key, known, turn, role, text, copies): damaged by a hash of conversation and turn.

    Of 20 classes, one is dropped, one loses its text, one its sentence ends, one is there twice and
    one becomes the user's. Nulls are one space, in the hash as well.
    """
    conv, turn = F.col(id_col).cast("string"), F.col(turn_col).cast("string")
    fate = F.crc32(F.concat_ws(":", F.coalesce(conv, F.lit(" ")), F.coalesce(turn, F.lit(" ")))) % 20
    role = F.when(fate == 4, "user").otherwise(F.coalesce(F.col(role_col), F.lit(" ")))
    text = F.coalesce(F.col(text_col), F.lit(" "))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.where(fate != 0).select(
        conversation_key(id_col).alias("key"), F.col(turn_col).isNotNull().alias("known"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def conversation_key(id_col: str) -> Column:
    """The id as text behind an equals sign; a null id is the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn as one row with ``copies``, and whether it is blank, cut, or said before.

    ``first`` is the row that says its role and text for the first time in the conversation. That is
    found by an aggregate per text and a join on a unique key: a text repeated in every turn of a
    long conversation is no hot key.
    """
    turn = ["key", "known", "turn", "role", "digest"]
    said = rows.withColumn("digest", F.sha2("text", 256)).groupBy(*turn).agg(
        F.max("text").alias("text"), F.sum("copies").alias("copies"))
    first = said.groupBy("key", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("at")).select(
        "key", F.col("at.known").alias("known"), F.col("at.turn").alias("turn"), "role", "digest",
        F.lit(True).alias("first"))
    core = F.rtrim(F.col("text"), F.lit(_BLANKS))
    return said.join(first, turn, "left").select(
        *turn, "text", "copies", F.coalesce("first", F.lit(False)).alias("first"), (core == "").alias("blank"),
        (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("cut"))


class _Stats:
    """Counts of neighbouring rows that can be put together."""

    def __init__(self):
        self.low = self.high = self.last_turn = None
        self.turns = 0
        self.head = self.tail = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn or self.low is None
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        if fault:
            self.counts[fault] += 1
        if self.head is None:
            self.head = initial
        else:
            self.counts["illegal"] += self.tail + initial not in _STEPS
        self.tail = initial

    def row(self) -> list:
        return [self.low, self.high, self.turns, self.head, self.tail, *self.counts.values()]


def _added(parts: list[list]) -> list:
    """The stats row of neighbouring parts' stats rows, in order."""
    low, high, turns, head, tail, *counts = parts[0]
    for low2, high2, turns2, head2, tail2, *more in parts[1:]:
        turns += turns2 - (high is not None and high == low2)
        low = low2 if low is None else low
        high = high if high2 is None else high2
        counts = [a + b for a, b in zip(counts, more)]
        counts[3] += tail + head2 not in _STEPS
        tail = tail2
    return [low, high, turns, head, tail, *counts]


class _Piece:
    def __init__(self):
        self.stats = _Stats()
        self.turns: list[T.Turn] = []
        self.roles: list[str] = []
        self.texts: list[str] = []

    def add(self, turn: int | None, role: str, text: str, again: bool, blank: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        self.stats.add(turn, role[:1], fault)
        self.turns.append(T.Turn(role[:1], blank or again, fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)

    def solved(self) -> list:
        cost, audit = T.repair(self.turns)
        lines = T.replay(audit, self.roles, self.texts)
        return [cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None]

    def tabled(self) -> list:
        body = zstandard.compress(json.dumps([self.roles, self.texts]).encode())
        return [None, None, None, _paths(T.segment_table(self.turns)), body]


def _paths(table: T.Table) -> str:
    return json.dumps([[*k, *s] for k, s in table.items()])


def _table(paths: str) -> T.Table:
    return {(a, b): T.Solution(cost, audit) for a, b, cost, audit in json.loads(paths)}


def _pieces(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Solved conversations and segments of others, from rows in order.

    The first and the last conversation of a task may go on in the next one, so they are segments.
    """
    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in _PIECE.split(", ")]
    schema = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _PIECE.split(", ")])
    piece, key, seq, first_key = _Piece(), None, 0, None
    ready: list[list] = []

    def close(last: bool) -> None:
        whole = last and seq == 0 and key != first_key
        ready.append([key, part, seq, whole, *piece.stats.row(), *(piece.solved() if whole else piece.tabled())])

    def batch() -> pa.RecordBatch:
        columns = dict(zip(names, zip(*ready)))
        ready.clear()
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    for given in batches:
        for new, known, turn, role, text, copies, first, blank, cut in zip(
                *(given.column(i).to_pylist() for i in range(9))):
            if new != key:
                if key is not None:
                    close(True)
                else:
                    first_key = new
                piece, key, seq = _Piece(), new, 0
            for again in repeat(True, copies):
                if len(piece.turns) == segment:
                    close(False)
                    piece, seq = _Piece(), seq + 1
                piece.add(turn if known else None, role, text, not first, blank, cut)
                first = False
                if len(ready) >= 512:
                    yield batch()
    if key is not None:
        close(False)
    if ready:
        yield batch()


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_STAT_NAMES = [f.split()[0] for f in _STATS.split(", ")]


def _stats_of(frame: pd.DataFrame) -> list:
    plain = frame[_STAT_NAMES].astype(object)
    return _added(plain.where(plain.notna(), None).values.tolist())


def _per_part(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("seq")
    table = T.joined([_table(p) for p in frame["paths"]])
    return _frame([[frame["key"].iloc[0], int(frame["part"].iloc[0]), *_stats_of(frame), _paths(table)]],
                  f"key string, part long, {_STATS}, paths string")


def _per_conversation(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    tables = [_table(p) for p in frame["paths"]]
    solution, last = T.least_exit(T.joined(tables))
    way = T.route(tables, T.START, last)
    steps = json.dumps([[int(p), *step] for p, step in zip(frame["part"], way)])
    return _frame([[frame["key"].iloc[0], *_stats_of(frame), *solution, steps]],
                  f"key string, {_STATS}, cost long, audit string, steps string")


def _frame(rows: list[list], schema: str) -> pd.DataFrame:
    """Object columns, so that a null among integers stays a null."""
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")], dtype=object)


def _way_through(pieces: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    if not len(pieces) or not len(steps):
        return _frame([], "key string, part long, seq long, entry int, audit string")
    pieces = pieces.sort_values("seq")
    tables = [_table(p) for p in pieces["paths"]]
    way = T.route(tables, int(steps["entry"].iloc[0]), int(steps["exit"].iloc[0]))
    return _frame(
        [[key, int(part), int(seq), a, table[a, b].audit] for key, part, seq, table, (a, b) in
         zip(pieces["key"], pieces["part"], pieces["seq"], tables, way)],
        "key string, part long, seq long, entry int, audit string")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each segment; null where nothing is left."""
    for batch in batches:
        key, part, seq, body, entry, audit = (batch.column(i).to_pylist() for i in range(6))
        out = []
        for packed, state, edits in zip(body, entry, audit):
            roles, texts = json.loads(zstandard.decompress(packed))
            lines = T.replay(edits, roles, texts, state)
            out.append("\n".join(lines).encode() if lines else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())],
            ["key", "part", "seq", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation from its segments in order; holds one segment at a time."""
    key, digest, begun = None, None, False
    done: list[tuple[str, str]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*done)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "sha"])

    for given in batches:
        for new, lines in zip(given.column(0).to_pylist(), given.column(1)):
            if new != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, begun = new, hashlib.sha256(), False
            if lines.is_valid:
                if begun:
                    digest.update(b"\n")
                digest.update(lines.as_buffer())
                begun = True
        if done:
            yield batch()
    if key is not None:
        done.append((key, digest.hexdigest()))
        yield batch()


def repaired_segments(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations in segments: one row each with the least solution, and the segments' repaired lines.

    A segment's table is small whatever its texts, and tables meet per task that made them before
    they meet per conversation, so what one group gathers is a row per task or per segment of a task.
    """
    light = pieces.select("key", "part", "seq", *_STAT_NAMES, "paths")
    parts = light.groupBy("key", "part").applyInPandas(
        _per_part, f"key string, part long, {_STATS}, paths string")
    found = materialise(parts.groupBy("key").applyInPandas(
        _per_conversation, f"key string, {_STATS}, cost long, audit string, steps string"), "turns-found")
    steps = found.select("key", F.explode(F.from_json("steps", "array<array<int>>")).alias("s")).select(
        "key", F.col("s")[0].cast("long").alias("part"), F.col("s")[1].alias("entry"), F.col("s")[2].alias("exit"))
    ways = light.groupBy("key", "part").cogroup(steps.groupBy("key", "part")).applyInPandas(
        _way_through, "key string, part long, seq long, entry int, audit string")
    lines = pieces.select("key", "part", "seq", "body").join(ways, ["key", "part", "seq"]).select(
        "key", "part", "seq", "body", "entry", "audit").mapInArrow(
        _written, "key string, part long, seq long, lines binary")
    return found, lines


def repair_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """One row per conversation after ``damage``: its faults, the cheapest edits, and the repaired text's digest.

    Columns: the id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows go
    by turn, null turns first, then by role and by a digest of the text. Nulls in role and text are one
    space; an empty role, and any role whose initial is none of s, u and a, can only be reroled or deleted.
    Repeated rows are duplicates of the first. A null id is a conversation of its own. A conversation
    of which the damage left nothing has zeros and an empty audit. Texts of any length are one row;
    other columns are ignored; an empty table gives no rows.
    """
    key = conversation_key(id_col)
    every = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("given")).select("key")
    turns = with_faults(damage(rows, id_col, turn_col, role_col, text_col)).orderBy(
        "key", "known", "turn", "role", "digest").select(
        "key", "known", "turn", "role", "text", "copies", "first", "blank", "cut")
    pieces = materialise(turns.mapInArrow(lambda batches: _pieces(batches, segment), _PIECE), "turns")
    found, lines = repaired_segments(pieces.where(~F.col("whole")))
    digests = lines.repartition("key").sortWithinPartitions("key", "part", "seq").select(
        "key", "lines").mapInArrow(_digests, "key string, sha string")
    columns = ["key", "low", "high", "turns", *_COUNTS, "cost", "audit", "sha"]
    solved = pieces.where("whole").select(*columns).unionByName(found.join(digests, "key").select(*columns))
    zero = F.lit(0).cast("long")
    kind = rows.schema[id_col].dataType
    return every.join(solved, "key", "left").select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(id_col),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in (*_COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
