"""Chat formatting: minimum-cost role repair over an automaton of legal turns (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

ROLES = ("system", "user", "assistant")
START = 3
#: What may follow: a system turn or the user at the start, then user and assistant in turn; the assistant ends it.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Turns of a conversation are dealt in stretches of so many turn numbers.
STRETCH = 256


def _moves() -> list[list[tuple[int, int, float, str, tuple[int, ...]]]]:
    """For each role (3: unknown) the moves (from, to, cost, action, inserted roles), better ones first among equals."""
    out = []
    for role in range(4):
        moves = []
        for s in range(4):
            for q in range(3):
                label = 0.0 if q == role else RELABEL
                name = "keep" if q == role else "relabel"
                if q in NEXT[s]:
                    moves.append((s, q, label, name, ()))
                if s == q:
                    moves.append((s, q, MERGE + label, "merge" if q == role else "merge_relabel", ()))
                for x in NEXT[s]:
                    if q in NEXT[x]:
                        moves.append((s, q, INSERT + label, "insert_" + name, (x,)))
        out.append(sorted(moves, key=lambda m: m[2]))
    return out


MOVES = _moves()
#: What closes a conversation in each state: roles to add.
CLOSING = {2: (), 1: (2,), 0: (1, 2), START: ()}


def _code(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else 3


def best_from(roles: list[int], start: int) -> tuple[np.ndarray, list[list]]:
    """Least cost to each state after these turns from ``start``, and the move that got there at each turn."""
    cost = np.full(4, np.inf)
    cost[start] = 0
    back = []
    for r in roles:
        new, by = np.full(4, np.inf), [None] * 4
        for m in MOVES[r]:
            if cost[m[0]] + m[2] < new[m[1]]:
                new[m[1]], by[m[1]] = cost[m[0]] + m[2], m
        cost = new
        back.append(by)
    return cost, back


def repair(roles: list[int], start: int, end: int) -> list:
    """The moves of least cost from state to state."""
    _, back = best_from(roles, start)
    out, s = [], end
    for by in reversed(back):
        out.append(by[s])
        s = by[s][0]
    return out[::-1]


def closing_cost(state: int) -> float:
    return INSERT * len(CLOSING[state])


def render_roles(chats: DataFrame) -> DataFrame:
    """conv_id, turn, old_role, role, action, inserted, rendered for each turn, in order ``place`` of its conversation.

    The pieces ``rendered`` of a conversation, joined by place, are the whole legal chat. Turns go by turn
    number (null last), then role and text; repeated turns are turns. Empty and null texts render as empty. A
    text can't forge a marker: its ``<|`` is rendered as ``< |``.
    A null or unknown role costs as a relabel. A null conv_id is one conversation. Other columns are ignored.

    Long conversations are cut into stretches. A stretch's least costs from state to state are a min-plus
    matrix; the matrices of a conversation, one small row a stretch, give each stretch's states at both
    ends, and the stretches are then repaired apart from each other.
    """
    spark = chats.sparkSession
    ws = Workspace(spark, "chat")
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(1 << 62)).cast("long")
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = rows.groupBy("conv_id", stretch.alias("stretch")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("at"), "turn", "role", "text"))).alias("turns"))
    parts = ws.table(parts)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.concatenate([best_from([_code(r) for r in roles], s)[0] for s in range(4)]) for roles in batch.column("roles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), batch.column("n"), pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], ["conv_id", "stretch", "n", "costs"])

    costs = parts.select("conv_id", "stretch", F.size("turns").cast("long").alias("n"), F.transform("turns", lambda t: t.role).alias("roles")).mapInArrow(matrices, "conv_id long, stretch long, n long, costs array<double>")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chain in zip(batch.column("conv_id").to_pylist(), batch.column("chain").to_pylist()):
                cost, back = np.full(4, np.inf), []
                cost[START] = 0
                for x in chain:
                    step = cost[:, None] + np.array(x["costs"]).reshape(4, 4)
                    back.append(step.argmin(axis=0))
                    cost = step.min(axis=0)
                total = cost + [closing_cost(s) for s in range(4)]
                s, place = int(total.argmin()), sum(x["n"] for x in chain)
                for i in reversed(range(len(chain))):
                    place -= chain[i]["n"]
                    was = int(back[i][s])
                    out.append((conv, chain[i]["stretch"], was, s, i == len(chain) - 1, place))
                    s = was
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], ["conv_id", "stretch", "was", "will", "final", "place"])

    chains = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "n", "costs"))).alias("chain"))
    states = chains.mapInArrow(ends, "conv_id long, stretch long, was int, will int, final boolean, place long")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                moves = repair([_code(t["role"]) for t in x["turns"]], x["was"], x["will"])
                for i, (t, (s, q, cost, action, added)) in enumerate(zip(x["turns"], moves)):
                    text = (t["text"] or "").replace("<|", "< |")
                    if action.startswith("merge"):
                        piece = f"\n{text}"
                    else:
                        piece = "" if s == START else "<|end|>\n"
                        piece += "".join(f"<|{ROLES[a]}|>\n<|end|>\n" for a in added) + f"<|{ROLES[q]}|>\n{text}"
                    added = [ROLES[a] for a in added]
                    after = []
                    if x["final"] and i == len(moves) - 1:
                        after = [ROLES[a] for a in CLOSING[q]]
                        cost += closing_cost(q)
                        piece += "<|end|>\n" + "".join(f"<|{a}|>\n<|end|>\n" for a in after)
                    out.append((x["conv_id"], x["place"] + i, t["turn"], t["role"], ROLES[q], action, added, after, cost, piece))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.string())
            names = ["conv_id", "place", "turn", "old_role", "role", "action", "inserted", "closing", "cost", "rendered"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    same = parts["conv_id"].eqNullSafe(states["conv_id"]) & (parts["stretch"] == states["stretch"])
    joined = parts.join(states, same).select(parts["conv_id"], "turns", "was", "will", "final", "place")
    return joined.mapInArrow(turns, "conv_id long, place long, turn long, old_role string, role string, action string, inserted array<string>, closing array<string>, cost double, rendered string")
