"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation starts with the user (after at most one system message),
then assistant and user take turns, and it ends with the assistant. Each turn is
kept, relabelled, merged into the message before, or preceded by an empty message,
so that the sequence is legal at the least total cost (``COSTS``). The states are
the role of the last message; a turn is a 4 by 4 matrix of least costs, and a
stretch of turns is the (min, +) product of its matrices.

That product is what makes long conversations distributed: rows are range-ordered
by (conversation, turn), stretches of at most ``STRETCH`` consecutive rows become
one matrix each, and matrices are multiplied in levels, at most ``FAN`` neighbours at a
time, until a conversation has no more than that. Back down the levels go the least
costs before each stretch; with these a stretch says which state before it leads to
which state after it, again composed in levels, and down go the states after each
stretch. Then every stretch is decided by itself. No row or group grows with a
conversation, one that holds a third of all turns spreads over many tasks in each
pass, and the result does not depend on ``STRETCH`` or ``FAN``; texts never travel with
the decisions. Conversations of up to ``STRETCH * FAN`` turns need one level.

The result has a row per source turn with what becomes of it and its rendered
segment; a conversation's segments in order are the rendered conversation.

Ties: of repairs with equal cost, at each turn from the last to the first, the one
whose state before is earliest in ``ROLES`` order and whose action is earliest in
the order keep, merge, relabel, insert. Defined cases: turns are ordered by (turn, role, text hash),
null turns first; repeated rows are turns of their own; null, unknown or other
roles are relabelled at a lower cost (names in ``SYNONYMS`` are those of a role);
null texts render as empty ones and count as turns; rows with null ``conv_id`` form
one conversation; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table
from ledgerline.session import store

ROLES = ["system", "user", "assistant"]
# Names for roles, costs of repairs, and the text around messages.
SYNONYMS = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
COSTS = {"merge": 1, "insert": 2, "relabel": 3, "relabel_unknown": 1}
HEAD, FOOT, JOINT = "<|{role}|>\n", "<|end|>\n", "\n"
STRETCH = 512
FAN = 64

LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())

START = 3  # states 0 to 2 are the role of the last message
AFTER = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = 2
INFINITE = 1 << 40


@cache
def moves(role: int, state: int) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(next state, cost, action, roles of empty messages before) for a turn of a role (-1: unknown) after a state."""
    out = []
    for new in range(3):
        label = 0 if new == role else COSTS["relabel"] if role >= 0 else COSTS["relabel_unknown"]
        if new in AFTER[state]:
            out.append((new, label, "relabel" if label else "keep", ()))
        if new == state:
            out.append((new, COSTS["merge"] + label, "merge_relabel" if label else "merge", ()))
        for between in AFTER[state]:
            if new in AFTER[between]:
                out.append((new, COSTS["insert"] + label, "insert_relabel" if label else "insert", (between,)))
    order = ["keep", "merge", "relabel", "merge_relabel", "insert", "insert_relabel"]
    best: dict[int, tuple] = {}
    for move in sorted(out, key=lambda m: (m[1], order.index(m[2]), m[3])):
        best.setdefault(move[0], move)
    return tuple(best.values())


@cache
def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and roles of the empty messages that end a conversation legally."""
    if state == FINAL:
        return 0, ()
    if FINAL in AFTER[state]:
        return COSTS["insert"], (FINAL,)
    return 2 * COSTS["insert"], (AFTER[state][-1], FINAL)


def stretch_matrix(roles: list[int]) -> list[int]:
    """Least costs from each state to each, row by row."""
    out: list[int] = []
    for first in range(4):
        costs = [INFINITE] * 4
        costs[first] = 0
        for role in roles:
            new = [INFINITE] * 4
            for state in range(4):
                if costs[state] < INFINITE:
                    for to, cost, _, _ in moves(role, state):
                        new[to] = min(new[to], costs[state] + cost)
            costs = new
        out += costs
    return out


def advanced(costs: list[int], matrix: list[int]) -> list[int]:
    """Least costs after a stretch, from those before it."""
    return [min(INFINITE, *(costs[a] + matrix[4 * a + b] for a in range(4))) for b in range(4)]


def product(matrices: list[list[int]]) -> list[int]:
    """The matrix of consecutive stretches, row by row."""
    out: list[int] = []
    for first in range(4):
        costs = [INFINITE] * 4
        costs[first] = 0
        for matrix in matrices:
            costs = advanced(costs, matrix)
        out += costs
    return out


def costs_after(roles: list[int], before: list[int]) -> list[list[int]]:
    """Least costs of each state before every turn of a stretch, and after the last."""
    costs = [before]
    for role in roles:
        new = [INFINITE] * 4
        for state in range(4):
            if costs[-1][state] < INFINITE:
                for to, cost, _, _ in moves(role, state):
                    new[to] = min(new[to], costs[-1][state] + cost)
        costs.append(new)
    return costs


def decide(roles: list[int], costs: list[list[int]], last: int) -> list[tuple[int, str, tuple[int, ...], int]]:
    """(state, action, empty messages before, state before) for each turn of a stretch that ends in ``last``."""
    out, to = [], last
    for k in range(len(roles) - 1, -1, -1):
        best = None
        for state in range(4):
            for target, cost, action, empty in moves(roles[k], state):
                if target == to and costs[k][state] < INFINITE and (best is None or costs[k][state] + cost < best[0]):
                    best = (costs[k][state] + cost, state, action, empty)
        out.append((to, best[2], best[3], best[1]))
        to = best[1]
    return out[::-1]


def origins(roles: list[int], before: list[int]) -> list[int]:
    """The state before a stretch for each state after it (-1: out of reach)."""
    costs = costs_after(roles, before)
    return [decide(roles, costs, to)[0][3] if costs[-1][to] < INFINITE else -1 for to in range(4)]


def composed(maps: list[list[int]]) -> list[int]:
    """The origins of consecutive stretches."""
    out = [0, 1, 2, 3]
    for step in reversed(maps):
        out = [step[state] if state >= 0 else -1 for state in out]
    return out


def role_code(role):
    plain = F.lower(F.trim(role))
    code = F.lit(-1)
    for name in [*SYNONYMS, *ROLES]:
        code = F.when(plain == name, ROLES.index(SYNONYMS.get(name, name))).otherwise(code)
    return code


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = [[code for _, code in sorted((x["pos"], x["code"]) for x in turns)] for turns in batch["turns"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["conv"], batch["part"], pa.array([stretch_matrix(r) for r in roles], LONGS), pa.array(roles, INTS), batch["positions"]],
            names=["conv", "part", "matrix", "codes", "positions"],
        )


COSTS_BEFORE = [INFINITE] * 3 + [0]  # of a conversation


def _multiplied(group: dict) -> list[dict]:
    return [{"conv": group["conv"], "part": group["up"], "matrix": product([p["matrix"] for p in group["parts"]])}]


def _prefixes(group: dict) -> list[dict]:
    out, costs = [], group["before"] or COSTS_BEFORE
    for part in group["parts"]:
        out.append({"conv": group["conv"], "part": part["part"], "before": costs})
        costs = advanced(costs, part["matrix"])
    return out


def _ends(group: dict) -> list[dict]:
    costs = COSTS_BEFORE
    for part in group["parts"]:
        costs = advanced(costs, part["matrix"])
    totals = [costs[state] + closing(state)[0] for state in range(4)]
    return [{"conv": group["conv"], "cost": min(totals), "end": totals.index(min(totals))}]


def _composed(group: dict) -> list[dict]:
    return [{"conv": group["conv"], "part": group["up"], "origin": composed([p["origin"] for p in group["parts"]])}]


def _states(group: dict) -> list[dict]:
    out, state, ends = [], group["after"], group["ends"]
    for part in reversed(group["parts"]):
        out.append({"conv": group["conv"], "part": part["part"], "after": state, "ends": ends})
        state, ends = part["origin"][state], False
    return out


def _by_group(groups: DataFrame, function: Callable[[dict], list[dict]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``function`` on every row of ``groups``, with its ``parts`` (``FAN`` at most) in order."""
    arrow = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["parts"].sort(key=lambda p: p["part"])
            yield pa.RecordBatch.from_pylist([out for row in rows for out in function(row)], arrow)

    return groups.mapInArrow(run, schema)


CONV, PART = {"conv": pa.string()}, {"conv": pa.string(), "part": pa.int64()}


def _grouped(parts: DataFrame, column: str, fan: int, top: bool) -> DataFrame:
    """Neighbours of a conversation in one row: all of them at the top, else those of the same ``up``."""
    up = F.lit(0).cast("long") if top else F.floor(F.col("part") / fan)
    return parts.groupBy("conv", up.alias("up")).agg(F.collect_list(F.struct("part", column)).alias("parts"))


def _most_parts(parts: DataFrame) -> int:
    return parts.groupBy("conv").count().agg(F.max("count")).first()[0] or 0


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [origins(roles, before) for roles, before in zip(batch["codes"].to_pylist(), batch["before"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], pa.array(found, INTS)], names=["conv", "part", "origin"])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.int64()]
    names = ["pos", "action", "new_role", "empty_before", "empty_after", "opens", "conversation_cost"]
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            costs = costs_after(row["codes"], row["before"])
            for k, (state, action, empty, before) in enumerate(decide(row["codes"], costs, row["after"])):
                at_end = row["ends"] and k == len(row["codes"]) - 1
                after = [ROLES[r] for r in closing(state)[1]] if at_end else None
                rows.append((row["positions"][k], action, ROLES[state], [ROLES[r] for r in empty], after, before == START, row["cost"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def _border_states(stretches: DataFrame, matrices: DataFrame, fan: int) -> DataFrame:
    """conv, part, before (least costs), after (state), ends, cost for each stretch."""
    levels, tops = [matrices], _most_parts(matrices) <= fan
    while not tops:
        level = _by_group(_grouped(levels[-1], "matrix", fan, False), _multiplied, PART | {"matrix": LONGS}, "conv string, part long, matrix array<long>")
        levels.append(store(level, "chat-matrices"))
        tops = _most_parts(levels[-1]) <= fan
    # Down: the least costs before each part.
    top = _grouped(levels[-1], "matrix", fan, True)
    ends = store(_by_group(top, _ends, CONV | {"cost": pa.int64(), "end": pa.int32()}, "conv string, cost long, end int"), "chat-ends")
    kinds, schema = PART | {"before": LONGS}, "conv string, part long, before array<long>"
    before = _by_group(top.withColumn("before", F.lit(None).cast("array<long>")), _prefixes, kinds, schema)
    for level in reversed(levels[:-1]):
        groups = _grouped(level, "matrix", fan, False).join(store(before, "chat-before").withColumnRenamed("part", "up"), ["conv", "up"])
        before = _by_group(groups, _prefixes, kinds, schema)
    before = store(before, "chat-before")
    # Up: where each state after a part comes from.
    known = stretches.join(before, ["conv", "part"]).select("conv", "part", "codes", "before")
    maps = [store(known.mapInArrow(_origins, "conv string, part long, origin array<int>"), "chat-origins")]
    for _ in levels[1:]:
        level = _by_group(_grouped(maps[-1], "origin", fan, False), _composed, PART | {"origin": INTS}, "conv string, part long, origin array<int>")
        maps.append(store(level, "chat-origins"))
    # Down: the state after each part.
    top = _grouped(maps[-1], "origin", fan, True).join(ends, "conv").select("conv", "parts", F.col("end").alias("after"), F.lit(True).alias("ends"))
    kinds, schema = PART | {"after": pa.int32(), "ends": pa.bool_()}, "conv string, part long, after int, ends boolean"
    after = _by_group(top, _states, kinds, schema)
    for level in reversed(maps[:-1]):
        groups = _grouped(level, "origin", fan, False).join(store(after, "chat-after").withColumnRenamed("part", "up"), ["conv", "up"])
        after = _by_group(groups, _states, kinds, schema)
    return before.join(store(after, "chat-after"), ["conv", "part"]).join(ends.select("conv", "cost"), "conv")


def repair(turns: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """conv_id, turn, pos, role, new_role, action, empty_before, empty_after, rendered, conversation_cost for each turn.

    ``pos`` orders all rows; ``empty_after`` is null but for a conversation's last turn.
    """
    ship_package(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text").withColumns({"conv": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "hash": F.xxhash64("text")})
    order = ["conv", "turn", "role", "hash"]
    # The place in the whole order: fixed once it is stored.
    ordered = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("hash"), "chat-turns")
    short = ordered.select("conv", F.floor(F.col("pos") / stretch).alias("part"), "pos", role_code(F.col("role")).alias("code"))
    # At most `stretch` rows in a group.
    stretches = short.groupBy("conv", "part").agg(F.collect_list(F.struct("pos", "code")).alias("turns"))
    stretches = stretches.select("conv", "part", "turns", F.array_sort("turns.pos").alias("positions"))
    stretches = store(stretches.mapInArrow(_matrices, "conv string, part long, matrix array<long>, codes array<int>, positions array<long>"), "chat-stretches")
    borders = _border_states(stretches, stretches.select("conv", "part", "matrix"), fan)
    known = stretches.select("conv", "part", "codes", "positions").join(borders, ["conv", "part"])
    decided = known.select("codes", "positions", "before", "after", "ends", "cost").mapInArrow(
        _decisions, "pos long, action string, new_role string, empty_before array<string>, empty_after array<string>, opens boolean, conversation_cost long"
    )
    joined = ordered.join(decided, "pos")

    def message(role):
        return F.concat(F.lit(HEAD.split("{role}")[0]), role, F.lit(HEAD.split("{role}")[1]))

    def empties(roles):
        return F.array_join(F.transform(roles, lambda r: F.concat(message(r), F.lit(FOOT))), "")

    merged = F.col("action").startswith("merge")
    opening = F.concat(F.when(F.col("opens"), "").otherwise(FOOT), empties("empty_before"), message(F.col("new_role")))
    ending = F.when(F.col("empty_after").isNotNull(), F.concat(F.lit(FOOT), empties("empty_after"))).otherwise("")
    rendered = F.concat(F.when(merged, JOINT).otherwise(opening), F.coalesce("text", F.lit("")), ending)
    return joined.select(
        "conv_id", "turn", "pos", "role", "new_role", "action", "empty_before", "empty_after", rendered.alias("rendered"), "conversation_cost"
    )


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
