"""Operator 9: chat formatting by minimum-cost role repair.

Legal sequences are: an optional system turn first, then user and assistant in
turn, user first. Each turn is kept, relabelled, merged into the turn before, or
preceded by empty turns of the missing roles; dynamic programming over the
automaton's states finds the cheapest repair of the whole conversation, which
is then rendered.

Turns are sorted by conversation, turn, role and text over all tasks; rows equal
in all four are told apart by a number, so no key, however hot, has to be in one
task. A task cuts its part of each conversation into chunks of at most ``CHUNK``
turns. A chunk's cost from each state to each state is a 4 x 4 matrix. (min, +)
products of those, first over a task's part, then over the parts, give the
costs before each chunk; a walk back over the states that cheapest repairs enter
each chunk in gives the state behind it. So each chunk can be repaired by itself,
as in one piece, and no task needs a whole conversation. A rendered conversation is the concatenation of its rows'
``segment`` in the order of ``place``.

Defined results: turns are ordered by turn, role, text (nulls first, a null text
as an empty one); repeated rows are turns of their own; null or unknown roles
can't be kept but relabelled or merged; a null text is empty; rows with a null
conv_id are one conversation; of equally cheap repairs the one whose first
differing choice comes first in ``ACTIONS`` from the end is taken, whatever the
cuts; a text of any length is one turn; an empty table gives no rows; other
columns are unread.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch

ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, the roles that may come next.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "merge", "insert", "relabel")
COST = {"keep": 0, "merge_same": 1, "insert": 3, "relabel": 4, "relabel_unknown": 2, "merge_other": 6, "merge_unknown": 4}
CHUNK = 1024
FAR = 1 << 40


@lru_cache(maxsize=None)
def moves(role: int | None) -> tuple[tuple[int, int, int, str, tuple[int, ...]], ...]:
    """(from, to, cost, action, inserted roles) of a turn, in order of ACTIONS."""
    out = []
    for s in range(4):
        for t in NEXT[s]:
            if t == role:
                out.append((s, t, COST["keep"], "keep", ()))
            else:
                out.append((s, t, COST["relabel_unknown" if role is None else "relabel"], "relabel", ()))
        if s != START:
            cost = COST["merge_unknown" if role is None else "merge_same" if s == role else "merge_other"]
            out.append((s, s, cost, "merge", ()))
        if role is not None and role not in NEXT[s]:
            for mid in NEXT[s]:
                if role in NEXT[mid] and role != SYSTEM:
                    out.append((s, role, COST["insert"], "insert", (mid,)))
    return tuple(sorted(out, key=lambda m: ACTIONS.index(m[3])))


def role_number(role: str | None) -> int | None:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES[1:] else None


def step(costs: list[int], role: int | None) -> tuple[list[int], list]:
    """Costs after a turn and, for each state, the move that led there."""
    best, via = [FAR] * 4, [None] * 4
    for m in moves(role):
        if costs[m[0]] + m[2] < best[m[1]]:
            best[m[1]], via[m[1]] = costs[m[0]] + m[2], m
    return best, via


def matrix(roles: list[int | None]) -> list[int]:
    """Cheapest cost from each state (rows) to each state."""
    out = []
    for s in range(4):
        costs = [FAR] * 4
        costs[s] = 0
        for r in roles:
            costs = [min(c, FAR) for c in step(costs, r)[0]]
        out += costs
    return out


def onward(costs: list[int], m: list[int]) -> list[int]:
    """Costs behind a chunk with this matrix."""
    return [min(min(costs[k] + m[4 * k + t] for k in range(4)), FAR) for t in range(4)]


def cheapest(costs: list[int]) -> int:
    return min(range(4), key=lambda k: (costs[k], k))


def repair(roles: list[int | None], costs: list[int], leave: int | None = None) -> list[tuple]:
    """The moves of a cheapest repair, from the costs before the turns to a state."""
    back = []
    for r in roles:
        costs, via = step(costs, r)
        back.append(via)
    state = cheapest(costs) if leave is None else leave
    out = []
    for via in reversed(back):
        out.append(via[state])
        state = via[state][0]
    return out[::-1]


def entered(roles: list[int | None], costs: list[int]) -> list[int]:
    """For each state behind the turns, the state before them of its cheapest
    repair; -1 where there is none."""
    came = [0, 1, 2, 3]
    for r in roles:
        costs, via = step(costs, r)
        came = [came[m[0]] if m else -1 for m in via]
    return came


def segment(move: tuple, text: str, last: bool) -> str:
    """What a turn adds to the rendered conversation."""
    state, to, _, action, inserted = move
    if action == "merge":
        out = "\n" + text
    else:
        out = "" if state == START else "<|end|>\n"
        out += "".join(f"<|{ROLES[i]}|>\n<|end|>\n" for i in inserted) + f"<|{ROLES[to]}|>\n{text}"
    return out + "<|end|>\n" * last


def _grouped(batches, n_keys: int):
    """Lists of rows with equal first columns, of batches sorted by those."""
    held, key = [], None
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            for row in zip(*[c.to_pylist() for c in batch.slice(at, 4096).columns]):
                if held and row[:n_keys] != key:
                    yield held
                    held = []
                key = row[:n_keys]
                held.append(row)
    if held:
        yield held


def chunked(turns: DataFrame, chunk: int) -> DataFrame:
    """The turns in order: conv_id, turn, role, text, part (the task), cid (the
    chunk, ascending in conversation order) and at (the place in the chunk)."""
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    t = t.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        cid, at, conv, known = -1, 0, None, False
        for batch in batches:
            part = batch.column(4)[0].as_py() if batch.num_rows else 0
            cids, ats = [], []
            for c in batch.column(0).to_pylist():
                if not known or c != conv or at == chunk - 1:
                    cid, at, conv, known = cid + 1, 0, c, True
                else:
                    at += 1
                cids.append((part << 36) + cid)
                ats.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids, pa.int64()), pa.array(ats, pa.int64())],
                                             names=["conv_id", "turn", "role", "text", "part", "cid", "at"])

    t = t.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("bigint").alias("part"))
    return t.mapInArrow(cut, "conv_id bigint, turn bigint, role string, text string, part bigint, cid bigint, at bigint")


def folded(rows: DataFrame, n_keys: int, schema: str, fold) -> DataFrame:
    """``fold`` of each group of rows with equal first columns, a list of rows;
    rows of a group come ordered by the columns after those."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keys = rows.columns[:n_keys]

    def run(batches):
        for group in _grouped(batches, n_keys):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*fold(group)), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*rows.columns[: n_keys + 1]).mapInArrow(run, schema)


def chunk_row(rows):
    """conv, part, cid, n, m, roles (a byte each) of one chunk's turns."""
    roles = [role_number(r[4]) for r in rows]
    return [(rows[0][2], rows[0][3], rows[0][0], len(rows), matrix(roles), bytes(r or 0 for r in roles))]


def part_row(rows):
    """conv, part, n, m of one part's chunks (conv, part, cid, n, m)."""
    whole = rows[0][4]
    for r in rows[1:]:
        whole = [x for k in range(4) for x in onward(whole[4 * k : 4 * k + 4], r[4])]
    return [(*rows[0][:2], sum(r[3] for r in rows), whole)]


def part_starts(rows):
    """conv, part, costs and turns before it; its last state if it is the last, else -1."""
    out, costs, first = [], [0, FAR, FAR, FAR], 0
    for conv, part, n, m in rows:
        out.append([conv, part, costs, first, -1])
        costs, first = onward(costs, m), first + n
    out[-1][4] = cheapest(costs)
    return out


def chunk_starts(rows):
    """conv, part, cid, costs and turns before it, states entered, last state (-1
    unless it ends its conversation); of rows (conv, part, cid, n, m, roles, the
    part's costs, turns and last state)."""
    out, costs, first = [], rows[0][6], rows[0][7]
    for conv, part, cid, n, m, roles, _, _, final in rows:
        state = final if len(out) == len(rows) - 1 else -1
        out.append((conv, part, cid, costs, first, entered([r or None for r in roles], costs), state))
        costs, first = onward(costs, m), first + n
    return out


def part_came(rows):
    """conv, part, states entered and last state of one part's chunk_starts rows."""
    came = [0, 1, 2, 3]
    for r in rows:
        came = [came[k] if k >= 0 else -1 for k in r[3]]
    return [(*rows[0][:2], came, rows[-1][4])]


def backward(n_keys: int):
    """Of rows (keys, states entered, last state) the keys and the state behind."""

    def fold(rows):
        out, state = [], rows[-1][n_keys + 1]
        for r in reversed(rows):
            out.append((*r[:n_keys], state))
            state = r[n_keys][state]
        return out[::-1]

    return fold


def formatted(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each turn: conv_id, turn, place (in its conversation, from 0),
    role as repaired, action, inserted, cost, segment."""
    scratch = Scratch(turns.sparkSession, "chat")  # before the first map: it ships this code
    t = scratch.keep(chunked(turns, chunk), "turns")
    key, costs = "conv_id bigint, part bigint", "costs array<bigint>, first bigint"

    def on_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
        parts = parts.withColumnsRenamed({"conv_id": "p_conv", "part": "p_part"})
        return rows.join(parts, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))).drop("p_conv", "p_part")

    # forward: the costs before each chunk
    chunks = folded(t.select("cid", "at", "conv_id", "part", "role"), 1, f"{key}, cid bigint, n bigint, m array<bigint>, roles binary", chunk_row)
    chunks = scratch.keep(chunks, "chunks")
    parts = folded(chunks.select("conv_id", "part", "cid", "n", "m"), 2, f"{key}, n bigint, m array<bigint>", part_row)
    parts = folded(parts, 1, f"{key}, {costs}, final bigint", part_starts)
    starts = folded(on_part(chunks, parts), 2, f"{key}, cid bigint, {costs}, came array<bigint>, final bigint", chunk_starts)
    starts = scratch.keep(starts, "starts")
    # backward: the state behind each chunk
    ends = folded(starts.select("conv_id", "part", "cid", "came", "final"), 2, f"{key}, came array<bigint>, final bigint", part_came)
    ends = folded(ends, 1, f"{key}, behind bigint", backward(2))
    each = on_part(starts.select("conv_id", "part", "cid", "came"), ends)
    leaves = folded(each, 2, f"{key}, cid bigint, leave bigint", backward(3))
    known = starts.select(F.col("cid").alias("k_cid"), "costs", "first", (F.col("final") >= 0).alias("last")).join(leaves.select("cid", "leave"), F.col("k_cid") == F.col("cid"))
    known = scratch.keep(known.drop("cid"), "states")

    def render(rows):
        moves_ = repair([role_number(r[4]) for r in rows], rows[0][6], rows[0][9])
        end = len(rows) - 1
        return [(r[2], r[3], r[7] + r[1], ROLES[m[1]], m[3], ",".join(ROLES[i] for i in m[4]), m[2], segment(m, r[5], r[8] and k == end))
                for k, (m, r) in enumerate(zip(moves_, rows))]

    met = t.join(known, F.col("cid") == F.col("k_cid")).select("cid", "at", "conv_id", "turn", "role", "text", "costs", "first", "last", "leave")
    return folded(met, 1, "conv_id bigint, turn bigint, place bigint, role string, action string, inserted string, cost bigint, segment string", render)


def op9_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
