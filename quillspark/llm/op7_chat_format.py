"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, ending with the assistant. Turns
are read in order by an automaton whose states are the role of the message before (or the start); for each turn
a dynamic program may keep it, merge it into the message before when that has its role, relabel it, or insert empty
messages first, and takes the cheapest way to a legal end. Ties prefer keeping, then merging, relabelling, inserting.

A turn's effect is a 4 x 4 table of costs, and tables compose by (min, +), so a conversation is cut into blocks
of ``BLOCK`` turns by place, whatever its length: a block's table is found by itself, the blocks' tables fix the state at every block's
edges, and each block then renders its own part. Concatenated in the order of ``part``, the parts are the conversation.

Cases: roles are trimmed and lower-cased; null or unknown ones must be relabelled. Null text is empty. Turns with one
number are taken in the order of role and text, repeated rows too; null numbers come first. Rows with null conv_id are one
conversation. Of other columns none is read. The markers in a text are broken by a blank, so that a text can't forge a turn. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import Tables, arrow_rows, join_small, running_sum

ROLES = ("system", "user", "assistant")
#: Roles that may follow each state: the start, then a message of each role.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
BLOCK = 512
STATES = 4
_INF = float("inf")


def _moves() -> dict[int, list[list[tuple[float, tuple] | None]]]:
    """For each role (0: none of the three): cost and way from state to state over one turn.

    A way: roles of the empty messages inserted before, the role given, whether merged.
    """
    reach = [{s: (0.0, ())} for s in range(STATES)]  # by inserting alone
    for s in range(STATES):
        for _ in range(STATES):
            for mid, (cost, way) in list(reach[s].items()):
                for role in NEXT[mid]:
                    new = (cost + INSERT, (*way, role))
                    if role not in reach[s] or new < reach[s][role]:
                        reach[s][role] = new
    out = {}
    for role in range(STATES):
        table: list[list] = [[None] * STATES for _ in range(STATES)]
        for s in range(STATES):
            for mid, (cost, way) in reach[s].items():
                for to in range(1, STATES):
                    label = 0.0 if to == role else RELABEL
                    options = [(cost + label, (way, to, False))] if to in NEXT[mid] else []
                    options += [(cost + label + MERGE, (way, to, True))] if to == mid else []
                    for new in options:
                        old = table[s][to]
                        if old is None or (new[0], len(new[1][0]), to != role, new[1][2]) < (old[0], len(old[1][0]), old[1][1] != role, old[1][2]):
                            table[s][to] = new
        out[role] = table
    return out


MOVES = _moves()
_COST = {r: np.array([[_INF if x is None else x[0] for x in row] for row in t]) for r, t in MOVES.items()}
#: Messages to insert at the end: every state but the assistant's.
END = {0: (2, 3), 1: (2, 3), 2: (3,), 3: ()}


def code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def table(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(STATES, dtype=bool), 0.0, _INF)
    for r in roles:
        out = (out[:, :, None] + _COST[r][None, :, :]).min(axis=1)
    return out


def path(costs: list[np.ndarray], start: int, end: int | None) -> list[int]:
    """States before, between and after steps of the given cost tables, on a cheapest way; end None: any, closed legally."""
    best, back = np.full(STATES, _INF), []
    best[start] = 0
    for c in costs:
        total = best[:, None] + c
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    if end is None:
        end = int((best + np.array([INSERT * len(END[s]) for s in range(STATES)])).argmin())
    states = [end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _clean(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def render(turns: list[tuple[int, str | None]], start: int, end: int, last: bool) -> tuple[str, float, int, int, int]:
    """Text of a block that goes from state ``start`` to ``end``, its cost, and merged, relabelled and inserted turns."""
    states = path([_COST[r] for r, _ in turns], start, end)
    parts: list[str] = []
    cost, merged, relabelled, inserted = 0.0, 0, 0, 0

    def message(role: int, text: str) -> None:
        # the end of a message is written when the next one begins, since a merge may still follow
        parts.append(("<|im_end|>\n" if parts or start else "") + f"<|im_start|>{ROLES[role - 1]}\n{text}")

    for (role, text), a, b in zip(turns, states[:-1], states[1:], strict=True):
        c, (before, to, merge) = MOVES[role][a][b]
        cost += c
        for r in before:
            message(r, "")
        inserted += len(before)
        merged += merge
        relabelled += to != role
        if merge:
            parts.append("\n\n" + _clean(text))
        else:
            message(to, _clean(text))
    if last:
        for r in END[end]:
            message(r, "")
        inserted += len(END[end])
        cost += INSERT * len(END[end])
        parts.append("<|im_end|>\n")
    return "".join(parts), cost, merged, relabelled, inserted


def _tables() -> Callable:
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            got = [(conv, block, table([code(t["role"]) for t in turns]).ravel()) for conv, block, turns in W.rows([b], "conv", "block", "turns")]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return run


def _edges() -> Callable:
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("part", pa.int64()), ("last", pa.bool_())])

    def run(batches):
        for conv, blocks in W.rows(batches, "conv", "blocks"):
            states = path([np.array(x["costs"]).reshape(STATES, STATES) for x in blocks], 0, None)
            n = len(blocks)
            columns = [[conv] * n, [x["block"] for x in blocks], states[:-1], states[1:], list(range(n)), [i == n - 1 for i in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


_RESULT = "conv string, part long, n_turns long, n_merged long, n_relabelled long, n_inserted long, cost double, rendered string"


def _render() -> Callable:
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("n_turns", pa.int64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("cost", pa.float64()), ("rendered", pa.string())])

    def run(batches):
        for b in batches:
            got = []
            for conv, part, start, end, last, turns in W.rows([b], "conv", "part", "start", "end", "last", "turns"):
                text, cost, m, r, i = render([(code(t["role"]), t["text"]) for t in turns], start, end, last)
                got.append((conv, part, len(turns), m, r, i, cost, text))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_merged, n_relabelled, n_inserted, cost, rendered; one row a block of a conversation."""
    spark = conversations.sparkSession
    arrow_rows(spark)
    tables = Tables(spark, "chat")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))  # never null
    c = conversations.select(conv.alias("conv"), "turn", "role", "text").withColumn("one", F.lit(1).cast("long"))
    # places in the whole order, less the place of the conversation's first turn: no task needs a whole conversation
    c = tables.save(running_sum(tables, c, ["conv", "turn", "role", "text"], {"one": "place"}, "turns"), "places")
    first = tables.save(c.groupBy("conv").agg(F.min("place").alias("first")), "firsts")
    c = join_small(c, first, ["conv"], "place").withColumn("block", F.floor((F.col("place") - F.col("first")) / BLOCK).cast("long"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))  # at most BLOCK turns
    blocks = tables.save(c.groupBy("conv", "block").agg(turns.alias("turns")), "blocks")
    costs = blocks.mapInArrow(_tables(), "conv string, block long, costs array<double>")
    order = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("blocks"))  # a row a BLOCK of turns
    edges = order.mapInArrow(_edges(), "conv string, block long, start int, end int, part long, last boolean")
    out = blocks.join(edges, ["conv", "block"]).mapInArrow(_render(), _RESULT)
    kind = conversations.schema["conv_id"].dataType
    return out.select(F.when(F.col("conv") != "", F.expr("substr(conv, 2)")).cast(kind).alias("conv_id"), *(x.split()[0] for x in _RESULT.split(", ")[1:]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
