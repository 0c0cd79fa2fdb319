"""Chat formatting by minimum-cost role repair.

Legal sequences: an optional system turn, then user and assistant in turns, ending with the assistant. Each given turn is
kept as it is, merged into the turn before it (same role), relabelled to another role (then kept or merged), or preceded
by an empty turn of another role; an empty assistant turn may end the sequence. The cheapest repair is found by dynamic
programming over the automaton's states (the role of the last turn put out); of equally cheap ones the first in the order
keep, merge, relabel, relabel and merge, insert is taken. The repaired turns are rendered by a template.

Turns are range-partitioned by (conversation, turn), so a conversation that holds a large part of all rows is spread over
many tasks. One of more than `part_turns` turns is worked off in parts of that many turns, counted from its first turn; so
neither rows nor texts depend on the partitions. Each part gives the matrix of its costs from each state to each state;
a search over these small matrices fixes the states in which every part begins and ends, and then all parts are repaired
on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import stored
from plumbline.operators.common import ship

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
#: From a state, the roles that may follow.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 50
PART_TURNS = 10_000
TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n", "\n\n")


def role_of(name: str | None) -> int | None:
    return ALIASES.get((name or "").strip().lower())


def moves(state: int, role: int | None) -> list[tuple[int, int, tuple]]:
    """(cost, next state, (inserted role or None, merged, role)) for a turn of a role; None: a role not known."""
    out = []
    for own in (SYSTEM, USER, ASSISTANT):
        base = 0 if own == role else RELABEL
        if own in NEXT[state]:
            out.append((base, own, (None, False, own)))
        if own == state:
            out.append((base + MERGE, own, (None, True, own)))
        for gap in NEXT[state]:
            if own in NEXT[gap]:
                out.append((base + INSERT, own, (gap, False, own)))
    return sorted(out, key=lambda x: (x[0], x[2][0] is not None, x[2][2] != role, x[2][1], x[2][2]))


#: All moves, by state and role; they are a few dozen.
MOVES = {(s, r): moves(s, r) for s in range(4) for r in (None, SYSTEM, USER, ASSISTANT)}
#: Cost of ending in a state: an empty assistant turn closes a user's, a user's and an assistant's a system turn.
ENDING = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def costs(roles: list[int | None], start: int) -> list[int]:
    """Least cost to reach each state after the turns."""
    now = [FAR] * 4
    now[start] = 0
    for role in roles:
        after = [FAR] * 4
        for s in range(4):
            if now[s] < FAR:
                for c, t, _ in MOVES[s, role]:
                    after[t] = min(after[t], now[s] + c)
        now = after
    return now


def repair(roles: list[int | None], start: int = START, end: int | None = None) -> tuple[int, list[tuple], int]:
    """(cost, an action for each turn, last state), from a state to a state, or to the cheapest ending."""
    now = [FAR] * 4
    now[start] = 0
    back: list[list[tuple[int, tuple] | None]] = []
    for role in roles:
        after, how = [FAR] * 4, [None] * 4
        for s in range(4):
            if now[s] < FAR:
                for c, t, action in MOVES[s, role]:
                    if now[s] + c < after[t]:
                        after[t], how[t] = now[s] + c, (s, action)
        back.append(how)
        now = after
    last = end if end is not None else min(range(4), key=lambda s: (now[s] + ENDING[s][0], s))
    actions, s = [], last
    for how in reversed(back):
        s, action = how[s]
        actions.append(action)
    return now[last], actions[::-1], last


def render(turns: list[tuple[str | None, str | None]], start: int, end: int | None, opened: bool, closing: bool, template: tuple[str, str, str]) -> tuple[str, dict[str, int]]:
    """Text of the repaired turns. opened: a turn stands open before them; closing: the sequence ends with them."""
    roles = [role_of(r) for r, _ in turns]
    cost, actions, last = repair(roles, start, end)
    head, tail, glue = template
    out, n = [], {"cost": cost, "merged": 0, "relabelled": 0, "inserted": 0, "turns": 0}

    def put(role: int, text: str) -> None:
        nonlocal opened
        out.append((tail if opened else "") + head.format(role=ROLES[role]) + text)
        opened = True
        n["turns"] += 1

    for (_, text), role, (gap, merged, own) in zip(turns, roles, actions, strict=True):
        # A marker inside a text must not pass for one of the template's.
        text = (text or "").replace("<|", "< |")
        if gap is not None:
            put(gap, "")
            n["inserted"] += 1
        n["relabelled"] += own != role
        if merged:
            out.append(glue + text)
            n["merged"] += 1
        else:
            put(own, text)
    if closing:
        for role in ENDING[last][1]:
            put(role, "")
            n["inserted"] += 1
            n["cost"] += INSERT
        out.append(tail if opened else "")
    return "".join(out), n


def _matrix(table: pa.Table) -> pa.Table:
    roles = [role_of(r) for r in table.sort_by("pos")["role"].to_pylist()]
    return pa.table({"key": table["key"][:1], "part": table["part"][:1], "costs": pa.array([[c for s in range(4) for c in costs(roles, s)]], pa.list_(pa.int64()))})


def _route(table: pa.Table) -> pa.Table:
    """States in which the parts of one conversation begin and end."""
    rows = table.sort_by("part")
    matrices = rows["costs"].to_pylist()
    now, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        came = [min(range(4), key=lambda s: (now[s] + m[4 * s + t], s)) for t in range(4)]
        now = [min(FAR, now[came[t]] + m[4 * came[t] + t]) for t in range(4)]
        back.append(came)
    s = min(range(4), key=lambda x: (now[x] + ENDING[x][0], x))
    ends = []
    for came in reversed(back):
        ends.append(s)
        s = came[s]
    ends = ends[::-1]
    return pa.table({"key": rows["key"], "part": rows["part"], "entry": pa.array([START, *ends[:-1]], pa.int32()), "exit": pa.array(ends, pa.int32()), "closing": pa.array([False] * (len(ends) - 1) + [True])})


def _render(template: tuple[str, str, str]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        entry, leave, closing = (rows[c][0].as_py() for c in ("entry", "exit", "closing"))
        turns = list(zip(rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True))
        text, n = render(turns, entry, leave, entry != START, closing, template)
        return pa.table({"id": rows["id"][:1], "part": rows["part"][:1], "n_turns": pa.array([len(turns)], pa.int64()), "n_out": pa.array([n["turns"]], pa.int64()), "cost": pa.array([n["cost"]], pa.int64()), "merged": pa.array([n["merged"]], pa.int64()), "relabelled": pa.array([n["relabelled"]], pa.int64()), "inserted": pa.array([n["inserted"]], pa.int64()), "rendered": pa.array([text], pa.string())})

    return run


def numbered(turns: DataFrame, order: list, partitions: int | None, part_turns: int) -> DataFrame:
    """turns (with key) and pos, which sorts them, and part: the place in the conversation, divided by part_turns."""
    ranged = turns.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    cut = stored(ranged.withColumn("slice", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "turns")
    slices = cut.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"))
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    # One row for each slice of a conversation; only long conversations have more than one part.
    slices = slices.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy("key")))
    long = stored(slices.where(F.col("total") > part_turns).select("key", "slice", "lo", "offset"), "turn-slices")
    part = F.floor((F.col("offset") + F.col("pos") - F.col("lo")) / part_turns).cast("int")
    return cut.join(long, ["key", "slice"], "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("slice", "lo", "offset")


def chat_format(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: tuple[str, str, str] = TEMPLATE, partitions: int | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """<id_col>, part, n_turns, n_out, cost, merged, relabelled, inserted, rendered.

    One row for each conversation (part 0); one of more than `part_turns` turns has a row for every so many turns, whose
    texts, in order, make up the whole, so no task holds more. `partitions` fixes the number of ranges by which turns are
    sorted, else Spark does; the result is the same. Turns are taken by (turn, role, text), nulls last; repeated rows are
    turns of their own and so are ties. Null or unknown roles (tools as well) are relabelled, null texts are empty. Null
    ids make one conversation. Empty input: no rows.
    """
    ship(turns.sparkSession)
    own = turns.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    cut = numbered(own.withColumn("key", key), order, partitions, part_turns).drop("turn")
    kind = own.schema["id"].dataType.simpleString()
    several = stored(cut.where("part > 0").select("key").distinct(), "long-conversations")
    matrices = cut.select("key", "part", "pos", "role").join(several, "key").groupBy("key", "part").applyInArrow(_matrix, "key string, part int, costs array<bigint>")
    routes = stored(matrices.groupBy("key").applyInArrow(_route, "key string, part int, entry int, exit int, closing boolean"), "routes")
    routed = cut.join(routes, ["key", "part"], "left").withColumn("entry", F.coalesce("entry", F.lit(START))).withColumn("closing", F.coalesce("closing", F.lit(True)))
    out = routed.groupBy("key", "part").applyInArrow(_render(template), f"id {kind}, part int, n_turns bigint, n_out bigint, cost bigint, merged bigint, relabelled bigint, inserted bigint, rendered string")
    return out.withColumnRenamed("id", id_col)
