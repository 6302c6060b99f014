"""Conversation structure repair: faults, cheapest edits and repaired turns.

Rows of a conversation are read in turn order by one streaming pass over sorted
partitions. Which turn first said a text is found before that by an aggregate
(partial sums first, so a text that fills a conversation costs one row a task);
the pass itself keeps no text but those of turns whose edit is still open.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm import survivors as V

WORD = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
#: Rows and characters of an output batch.
_BATCH_ROWS, _BATCH_CHARS = 4096, 1 << 24


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of ``rows`` (conv_id, turn, role, text), damaged by
    crc32(``conv_id:turn``) % 20: 0 drops the row (present is false, so its conversation stays known), 1 empties the
    text, 2 removes its sentence marks, 3 repeats the row, 4 makes it a user's. A null is one space in the key, the
    role and the text; a null turn stays null."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), blank)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
                      F.when(kind == 0, F.lit("")).otherwise(text).alias("text"), (kind != 0).alias("present"),
                      F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank``, ``later`` (another turn said the same in the same role before) and ``truncated``.
    Equal rows of one turn are told apart by the pass that reads them side by side."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = rows.withColumn("said", said)
    first = (rows.where("present").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s"))
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("first"),
                  F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "s", F.col("first.turn").alias("t"), F.lit(True).alias("again")))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    return joined.select("conv_id", "turn", "role", "text", "present", (~F.col("text").rlike(WORD)).alias("blank"),
                         (F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("t"))).alias("later"),
                         (~F.col("text").rlike(WHOLE)).alias("truncated"))


class _Conversation:
    """One conversation's open turns; ``row`` and ``end`` return finished edits."""

    def __init__(self):
        self.repair, self.open, self.state, self.last, self.seq = V.Repair(), deque(), V.START, None, 0

    def _finish(self, edits: str) -> list[tuple]:
        out = []
        for edit in edits:
            turn, role, text, fault = (None, None, "", "") if edit == "I" else self.open.popleft()
            self.state = V.next_state(self.state, edit, (role or "")[:1])
            new = None if edit == "D" else role if edit == "K" else "user" if self.state == V.USER else "assistant"
            out.append((self.seq, edit, turn, role, new, text, fault))
            self.seq += 1
        return out

    def row(self, turn, role, text, blank, later, truncated) -> list[tuple]:
        here = (turn, role, text)
        fault = "blank" if blank else "duplicate" if later or here == self.last else "truncated" if truncated else ""
        self.last = here
        self.open.append((turn, role, text, fault))
        return self._finish(self.repair.read(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> list[tuple]:
        if self.last is None:
            return [(0, None, None, None, None, None, None)]
        return self._finish(self.repair.end()[1])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, one row an edit: (conv_id, seq, edit, turn, role, new_role, text, fault).

    ``rows`` has conv_id, turn, role, text (no nulls in role and text) and present. Turns are read by turn (nulls
    first), ties by role and text. ``edit`` is K (keep), R (rerole), D (delete) or I (insert, without turn and role);
    ``new_role`` is the repaired role, null where the turn goes. ``fault`` is the first of blank, duplicate (said before in the same
    role) and truncated that holds, else empty. The new roles' initials read ``(s?(ua)+)?``; an empty role has no
    initial and can't be kept. Of equally cheap scripts the one with the ASCII-least edits is taken. Rows that are
    not present only name their conversation; one without present rows yields one row with a null edit. Null ids are one
    conversation; extra columns are ignored; an empty table gives an empty result.

    A conversation is one stream in one task, as its order demands; the stream holds only the turns whose edits
    are still open, and the sort before it spills."""
    id_type, turn_type = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    ordered = (with_faults(rows).repartition(F.col("conv_id"))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    schema = T.StructType([
        T.StructField("conv_id", id_type), T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("turn", turn_type), T.StructField("role", T.StringType()), T.StructField("new_role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("fault", T.StringType())])

    def run(batches):
        types, ids, done, chars = None, [], [], 0
        now, one = None, None

        def flush():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(ids, types[0]), *(pa.array(c, t) for c, t in zip(columns, types[1:]))],
                                              names=[f.name for f in schema.fields])

        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), batch.schema.field(1).type, *[pa.string()] * 4]
            for conv, turn, role, text, present, blank, later, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or conv != now:
                    if one is not None:
                        new = one.end()
                        done += new
                        ids += [now] * len(new)
                    now, one = conv, _Conversation()
                if present:
                    new = one.row(turn, role, text, blank, later, truncated)
                    done += new
                    ids += [conv] * len(new)
                    chars += len(text)
                if done and (len(done) >= _BATCH_ROWS or chars >= _BATCH_CHARS):
                    yield flush()
                    ids, done, chars = [], [], 0
        if one is not None:
            new = one.end()
            done += new
            ids += [now] * len(new)
            yield flush()

    return ordered.mapInArrow(run, schema)


class _Digest:
    def __init__(self):
        self.turns = [None, None, 0]  # least, last, distinct
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.before, self.audit, self.sha, self.lines = None, bytearray(), hashlib.sha256(), 0

    def add(self, edit, turn, role, new_role, text, fault):
        if edit is None:
            return
        self.audit += edit.encode()
        self.cost += {"K": 0, "R": V.REROLE_COST, "D": V.DELETE_COST, "I": V.INSERT_COST}[edit]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if fault == "truncated" and edit != "D":
                self.cost += V.TRUNCATED_COST
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            if turn is not None and turn != self.turns[1]:
                self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if new_role is not None:
            self.sha.update((b"\n" if self.lines else b"") + f"{new_role}:{text}".encode())
            self.lines += 1

    def row(self):
        least, last, distinct = self.turns
        gaps = 0 if least is None else last - least + 1 - distinct
        return (gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def conversation_digest(edits: DataFrame) -> DataFrame:
    """One row a conversation of the streamed ``repair_conversations``: (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256). ``gaps`` counts the missing turn numbers between the least and the greatest; ``illegal`` the
    neighbouring turns whose role initials are not su, ua or au. Reads the edits as they stream, without another shuffle."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = T.StructType([T.StructField("conv_id", edits.schema["conv_id"].dataType),
                           *(T.StructField(n, T.LongType()) for n in names[:6]), *(T.StructField(n, T.StringType()) for n in names[6:])])

    def run(batches):
        now, one, kind = None, None, None
        kinds = [pa.int64()] * 6 + [pa.string()] * 2

        def out(ids, rows):
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["conv_id", *names])

        for batch in batches:
            kind, ids, rows = batch.schema.field(0).type, [], []
            for conv, edit, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or conv != now:
                    if one is not None:
                        ids.append(now)
                        rows.append(one.row())
                    now, one = conv, _Digest()
                one.add(edit, *rest)
            if ids:
                yield out(ids, rows)
        if one is not None:
            yield out([now], [one.row()])

    return edits.select("conv_id", "edit", "turn", "role", "new_role", "text", "fault").mapInArrow(run, schema)
