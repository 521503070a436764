"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. For each input turn the repair
chooses the role to give it: it may keep or change the role, merge the turn
into the one before, or insert empty turns first. Dynamic programming over the
automaton's states finds the cheapest repair.

The step of one turn is a small matrix over states, and steps compose in the
(min, +) sense. Rows are range-partitioned in conversation order and cut by
rank into blocks of bounded length, so a very long one is never in one task,
whatever its turn numbers: blocks are condensed to one matrix each, entry
states come from the matrices, and each block is then repaired on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: States: nothing yet, then the role of the last turn written.
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK = 1024
_FAR = 10**9


def _inserted(state: int, role: int) -> list[int] | None:
    """The empty turns to write between a state and a turn of a role; None where nothing helps."""
    if (state, role) in LEGAL:
        return []
    if role == SYSTEM:
        return None
    if role == ASSISTANT:
        return [USER]
    return [ASSISTANT] if state == USER else None


def _choice(state: int, given: int, role: int) -> tuple[int, str, list[int]] | None:
    """(cost, action, inserted) of giving ``role`` to a turn that says ``given`` after ``state``; the cheaper of merging and appending."""
    base = 0 if role == given else RELABEL
    name = "keep" if role == given else "relabel"
    options = []
    if role == state:
        options.append((base + MERGE, "merge" if role == given else "relabel+merge", []))
    extra = _inserted(state, role)
    if extra is not None:
        options.append((base + INSERT * len(extra), name if not extra else f"{name}+insert", extra))
    return min(options, key=lambda x: x[0]) if options else None


#: By role given (0: unknown): cost of going from each state to each.
_CHOICES = {g: {(q, t): _choice(q, g, t) for q in range(4) for t in (SYSTEM, USER, ASSISTANT)} for g in range(4)}
_STEP = np.full((4, 4, 4), _FAR, np.int64)
for _g, _c in _CHOICES.items():
    for (_q, _t), _o in _c.items():
        if _o:
            _STEP[_g, _q, _t] = _o[0]
#: Cost of ending in each state.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _code(role: str | None) -> int:
    return 1 + ROLES.index(role) if role in ROLES else 0


def condense(roles: list[str | None]) -> np.ndarray:
    """The (min, +) product of the steps of some turns."""
    total = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    for r in roles:
        total = np.minimum(_FAR, (total[:, :, None] + _STEP[_code(r)][None]).min(1))
    return total


def repair(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, str, list[int], int]]:
    """(role, action, inserted, cost) of each turn on the cheapest way from one state to another; ties prefer the lower state number."""
    best = [np.where(np.arange(4) == leave, 0, _FAR).astype(np.int64)]
    for r in reversed(roles):
        best.append(np.minimum(_FAR, (_STEP[_code(r)] + best[-1][None, :]).min(1)))
    best.reverse()
    out, state = [], entry
    for k, r in enumerate(roles):
        following = int((_STEP[_code(r)][state] + best[k + 1]).argmin())
        cost, action, inserted = _CHOICES[_code(r)][(state, following)]
        out.append((following, action, inserted, cost))
        state = following
    return out


def _safe(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "<|end|>\n"


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each input turn: conv_id, turn, place (order within the conversation), role (given), action, cost, rendered.

    The ``rendered`` pieces of a conversation, joined in the order (turn,
    place), are the repaired sequence in the template; inserted turns are part
    of the piece before which they stand, the last piece closes the sequence.
    Turns are ordered by number, then role, then text; nulls come first. Rows
    without conv_id form one conversation. An unknown or null role must be
    relabelled; a null text is empty; "<|" within texts is broken up.
    """
    keys = ["conv", "turn", "role", "text"]
    rows = turns.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie")
    )  # equal rows may stand in any order, but not all in one partition
    dealt = rows.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("tie")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv")
            before, after = conv.slice(0, len(conv) - 1), conv.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(before, after), False), pc.and_(before.is_null(), after.is_null()))
            bounds = np.concatenate([[0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False)), [len(conv)]])
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            first = pa.array(starts)
            each = pa.StructArray.from_arrays([batch.column(c) for c in ("turn", "role", "text")], ["turn", "role", "text"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(conv)), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([conv.take(first), batch.column("at").take(first), lists], names=["conv", "block", "turns"])

    types = dict(rows.dtypes)
    blocks = materialize(dealt.mapInArrow(cut, f"conv {types['conv']}, block long, turns array<struct<turn: long, role: {types['role']}, text: {types['text']}>>"), "chatblocks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [condense(r).ravel().tolist() for r in batch.column("roles").to_pylist()]
            sizes = pc.list_value_length(batch.column("roles")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), sizes, pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "size", "cost"]
            )

    conv_type = dict(blocks.dtypes)["conv"]
    condensed = blocks.select("conv", "block", F.col("turns.role").alias("roles")).mapInArrow(
        matrices, f"conv {conv_type}, block long, size long, cost array<long>"
    )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, steps in enumerate(batch.column("steps").to_pylist()):
                best = [END]
                for s in reversed(steps):
                    best.append(np.minimum(_FAR, (np.array(s["cost"]).reshape(4, 4) + best[-1][None, :]).min(1)))
                best.reverse()
                state, place = START, 0
                for k, s in enumerate(steps):
                    following = int((np.array(s["cost"]).reshape(4, 4)[state] + best[k + 1]).argmin())
                    out.append((i, s["block"], state, following, k == len(steps) - 1, place))
                    state, place = following, place + s["size"]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv").take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int32()),
                    pa.array(columns[3], pa.int32()),
                    pa.array(columns[4], pa.bool_()),
                    pa.array(columns[5], pa.int64()),
                ],
                names=["conv", "block", "entry", "leave", "last", "start"],
            )

    per_conv = condensed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "size", "cost"))).alias("steps"))
    ways = per_conv.mapInArrow(states, f"conv {conv_type}, block long, entry int, leave int, last boolean, start long")
    ready = blocks.alias("x").join(ways.alias("w"), F.expr("x.conv <=> w.conv and x.block = w.block")).select("x.*", "w.entry", "w.leave", "w.last", "w.start")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, rows = batch.column("conv"), []
            rest = zip(*(batch.column(c).to_pylist() for c in ("turns", "entry", "leave", "last", "start")), strict=True)
            for i, (turns, entry, leave, last, start) in enumerate(rest):
                state = entry
                for place, (t, (new, action, inserted, cost)) in enumerate(zip(turns, repair([t["role"] for t in turns], entry, leave), strict=True)):
                    piece = "\n\n" if "merge" in action else ("" if state == START else CLOSE) + "".join(_open(r) + CLOSE for r in inserted) + _open(new)
                    piece += _safe(t["text"])
                    if last and place == len(turns) - 1:
                        cost += int(END[new])
                        piece += CLOSE + "".join(_open(r) + CLOSE for r in ([], [USER, ASSISTANT], [ASSISTANT], [])[new])
                    rows.append((i, t["turn"], start + place, ROLES[new - 1], action, cost, piece))
                    state = new
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
                names=[conv_id, "turn", "place", "role", "action", "cost", "rendered"],
            )

    return ready.mapInArrow(render, f"`{conv_id}` {conv_type}, turn long, place long, role string, action string, cost long, rendered string")


def op3_chat_formatting(turns: DataFrame) -> DataFrame:
    """format_chats of the whole table: one row for each input row.

    Null conv_ids are one conversation, null turn numbers come first, ties go
    by role and text, repeated rows are turns of their own, a null text is
    empty, a null role is relabelled. Other columns play no part. No rows give
    no rows.
    """
    return format_chats(turns)
