"""Repair of the structure of conversations (operator 13).

Roles have to alternate: ``(s?(ua)+)?`` in initials.  The cheapest edits that bring a
conversation there are found by a program over four states (nothing yet, after system,
after user, after assistant) and the rows in order:

* Rows are numbered by ``numbered`` (range parts and offsets), a row repeats if its role and
  text stand at an earlier place of its conversation (smallest place per role and SHA-256 of
  the text, aggregated before the shuffle).
* Backward, over narrow rows (conversation, place, code): the vector of the four costs to go is
  kept only at the ends of blocks of about the square root of the conversation's length.
* Forward, over whole rows: each block's vectors are computed again from the one at its end,
  and the walk takes, of the edits that stay cheapest, the least letter (Delete, Insert, Keep,
  Rerole), which gives the least string.  Both passes stream sorted partitions; a task holds
  the rows of one block and the letters of one conversation.

A conversation is one stream in each pass, since its digest is a single SHA-256 over all of
its text in order; it is never gathered.

Defined cases: null role or text counts as one space, so a null text is blank and a null or
empty role fits nowhere; rows of one turn are ordered by role and SHA-256 of the text; null
turns come first and do not count as turns; a null conversation is one of its own; a
conversation without rows, as an empty table, gives no row (the query adds those whose rows
are all dropped); a very long text stands in one row of a block; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pactlens.functions.numbering import numbered
from pactlens.llm.common import NOT_SPACE, SPACE, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Costs to go behind the last row, by state: nothing yet, after system, after user, after assistant.
END = (0, 10, 5, 0)
#: The state after an inserted or reroled row, and its role.
NEXT, ADDED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a kept row, by initial and state.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
LEGAL = ("su", "ua", "au")
LEAST_BLOCK = 64
FAULTS = ("blank", "duplicate", "truncated")

_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ROWS = "place bigint, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damages of the contract, by the crc32 of ``conv_id:turn``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("again"),
    ).drop("again")


def _fault() -> Column:
    """The first fault of a row: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    return (
        F.when(~F.col("text").rlike(NOT_SPACE), 1).when(F.col("pos") > F.coalesce("first_pos", "pos"), 2)
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), 3).otherwise(0)
    )


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, fault), written."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", blank("role"), blank("text")).withColumn("sha", F.sha2("text", 256))
    placed = numbered(rows, ["conv_id"], ["turn", "role", "sha"])
    # Only texts that do repeat are joined back; that table is narrow.
    firsts = placed.groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1").select(
        F.struct("conv_id", "role", "sha").alias("same"), "first_pos"
    )
    met = F.col("same.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("same.role") == F.col("role")) & (F.col("same.sha") == F.col("sha"))
    return written(placed.join(firsts, met, "left").select("conv_id", "turn", "role", "text", "pos", _fault().alias("fault")))[0]


def _before(after: tuple, initial: str, fault: int) -> tuple:
    """The costs to go ahead of a row, from those behind it."""
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if fault not in (1, 2):
            late = TRUNCATED if fault == 3 else 0
            best = min(best, late + REROLE + after[NEXT[state]])
            kept = KEPT.get(initial, (None,) * 4)[state]
            if kept is not None:
                best = min(best, late + after[kept])
        costs.append(best)
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant


def _step(length: int) -> int:
    return max(LEAST_BLOCK, math.isqrt(length - 1) + 1)


def _values(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _checkpoints(kind: pa.DataType):
    """Backward over (conv_id, pos, initial, fault): the vectors at the ends of all blocks but the last."""
    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "pos", "stop", "costs"]
        types = [kind, pa.int64(), pa.int64(), pa.list_(pa.int64())]
        out, conv, step, costs, fresh = [], None, 1, END, True

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        for c, pos, initial, fault in _values(batches):
            if fresh or c != conv:
                conv, step, costs, fresh = c, _step(pos + 1), END, False
            costs = _before(costs, initial, fault)
            if pos and pos % step == 0:
                out.append((c, pos - step, pos, list(costs)))
                if len(out) >= 1000:
                    yield batch()
                    out = []
        yield batch()

    return backward


class _Walk:
    """The forward pass over one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.cost, self.edits, self.hash, self.place = conv, 0, 0, [], hashlib.sha256(), 0
        self.block, self.stop, self.costs = [], None, END
        self.found, self.illegal, self.last = [0, 0, 0], 0, None
        self.turns, self.low, self.high = 0, None, None

    def row(self, turn, role: str, text: str, fault: int) -> None:
        self.found[fault - 1] += fault > 0
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.block.append((role, text, fault))

    def emit(self, edit: str, cost: int, role: str | None = None, text: str = "") -> tuple:
        self.edits.append(edit)
        self.cost += cost
        if role is not None:
            self.hash.update((("\n" if self.place else "") + f"{role}:{text}").encode())
            self.place += 1
        return self.place - 1 if role is not None else None, edit, role, text if role is not None else None

    def insert(self) -> tuple:
        made = self.emit("I", INSERT, ADDED[self.state])
        self.state = NEXT[self.state]
        return made

    def finish_block(self) -> Iterator[tuple]:
        ahead = [self.costs]
        for role, _, fault in reversed(self.block):
            ahead.append(_before(ahead[-1], role[:1], fault))
        ahead.reverse()
        for k, (role, text, fault) in enumerate(self.block):
            here, after, late = ahead[k], ahead[k + 1], TRUNCATED if fault == 3 else 0
            while here[self.state] != DELETE + after[self.state] and here[self.state] == INSERT + here[NEXT[self.state]]:
                yield self.insert()
            kept = KEPT.get(role[:1], (None,) * 4)[self.state]
            if here[self.state] == DELETE + after[self.state]:
                yield self.emit("D", DELETE)
            elif kept is not None and here[self.state] == late + after[kept]:
                yield self.emit("K", late, role, text)
                self.state = kept
            else:
                yield self.emit("R", late + REROLE, ADDED[self.state], text)
                self.state = NEXT[self.state]
        self.block, self.costs, self.stop = [], END, None

    def finish(self) -> Iterator[tuple]:
        yield from self.finish_block()
        while END[self.state]:
            yield self.insert()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.found, self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest()


def _walks(kind: pa.DataType, summaries: bool):
    """Forward over (conv_id, pos, stop, costs, turn, role, text, fault): checkpoints stand ahead of their block's rows."""
    names = ["conv_id", *[f.split()[0] for f in (_SUMMARY if summaries else _ROWS).split(", ")]]
    types = [kind, *[pa.int64() if f.endswith("bigint") else pa.string() for f in (_SUMMARY if summaries else _ROWS).split(", ")]]

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, walk = [], 0, None

        def taken(edits: Iterator[tuple]) -> None:
            nonlocal size
            for e in edits:
                if not summaries:
                    out.append((walk.conv, *e))
                    size += len(e[3] or "") + 50

        def closed() -> None:
            nonlocal size
            taken(walk.finish())
            if summaries:
                out.append((walk.conv, *walk.summary()))
                size += len(walk.edits) + 200

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        for conv, pos, stop, costs, turn, role, text, fault in _values(batches):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    closed()
                walk = _Walk(conv)
            if walk.stop is not None and pos == walk.stop:
                taken(walk.finish_block())
            if costs is not None:
                walk.costs, walk.stop = tuple(costs), stop
            else:
                walk.row(turn, role, text, fault)
            if size > 1 << 22:
                yield batch()
                out, size = [], 0
        if walk is not None:
            closed()
        yield batch()

    return forward


def _repair(conversations: DataFrame, summaries: bool) -> DataFrame:
    rows = _ordered(conversations)
    kind = conversations.schema["conv_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    narrow = rows.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), "fault")
    marks = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos")).mapInArrow(
        _checkpoints(arrow), f"conv_id {name}, pos bigint, stop bigint, costs array<bigint>"
    )
    stream = rows.unionByName(marks, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("costs").isNull())
    stream = stream.select("conv_id", "pos", "stop", "costs", "turn", "role", "text", "fault")
    return stream.mapInArrow(_walks(arrow, summaries), f"conv_id {name}, {_SUMMARY if summaries else _ROWS}")


def audited(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost and letters of the edits, digest of the repaired rows."""
    return _repair(conversations, True)


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits in order: (conv_id, place, edit, role, text); a deleted row has no place, role and text."""
    return _repair(conversations, False)


def audited_all(conversations: DataFrame, after: DataFrame) -> DataFrame:
    """``audited(after)``, with zeros for the conversations that have no rows left."""
    found = audited(after).select(F.col("conv_id").alias("_conv"), *[F.col(c.split()[0]) for c in _SUMMARY.split(", ")])
    ids = conversations.select("conv_id").distinct()
    filled = {c.split()[0]: F.lit(0).cast("bigint") if c.endswith("bigint") else F.lit("") for c in _SUMMARY.split(", ")}
    filled["repaired_sha256"] = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in filled.items()]
    )
