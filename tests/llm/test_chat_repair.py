import heapq
import random
from collections import defaultdict

import pytest

from ledgerline.llm import chat_repair as C

TURNS = "conv_id long, turn long, role string, text string, pos string, action string"


def least_cost(roles):
    """Shortest path over (turns done, role of the last message), any number of empty messages anywhere."""
    queue, done = [(0, 0, C.START)], set()
    while queue:
        cost, k, state = heapq.heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(roles) and state == C.FINAL:
            return cost
        for new in C.AFTER[state]:
            heapq.heappush(queue, (cost + C.COSTS["insert"], k, new))
        if k < len(roles):
            for new in range(3):
                label = 0 if new == roles[k] else C.COSTS["relabel" if roles[k] >= 0 else "relabel_unknown"]
                if new in C.AFTER[state]:
                    heapq.heappush(queue, (cost + label, k + 1, new))
                if new == state:
                    heapq.heappush(queue, (cost + label + C.COSTS["merge"], k + 1, new))


def messages(rows):
    """Roles and texts of the repaired conversation, and the cost of what was done."""
    out, cost = [], 0
    for row in rows:
        for role in row["empty_before"]:
            out.append([role, ""])
            cost += C.COSTS["insert"]
        if row["action"].startswith("merge"):
            out[-1][1] += C.JOINT + (row["text"] or "")
            cost += C.COSTS["merge"]
        else:
            out.append([row["new_role"], row["text"] or ""])
        assert out[-1][0] == row["new_role"]
        code = row["code"]
        if row["action"].endswith("relabel"):
            cost += C.COSTS["relabel" if code >= 0 else "relabel_unknown"]
        else:
            assert C.ROLES.index(row["new_role"]) == code
        for role in row["empty_after"] or []:
            out.append([role, ""])
            cost += C.COSTS["insert"]
    return out, cost


NAMES = {"system": 0, "user": 1, "assistant": 2, "Human ": 1, "bot": 2, "tool": -1, None: -1}


def check(spark, turns, stretch):
    df = spark.createDataFrame([(c, t, r, x, "own", "own") for c, t, r, x in turns], TURNS).repartition(3)
    got = C.repair(df, stretch).collect()
    assert len(got) == len(turns)
    texts = defaultdict(list)
    for c, t, r, x in turns:
        texts[c, t, r].append(x)
    conversations = defaultdict(list)
    for row in sorted(got, key=lambda r: r["pos"]):
        conversations[row["conv_id"]].append(row)
    for conv, rows in conversations.items():
        order = [(r["turn"] is not None, r["turn"] or 0) for r in rows]
        assert order == sorted(order)
        roles = [NAMES[r["role"]] for r in rows]
        # The text of a row stands in its segment.
        plain = []
        for row, code in zip(rows, roles):
            text = next(x for x in texts[conv, row["turn"], row["role"]] if (x or "") in row["rendered"])
            plain.append(row.asDict() | {"text": text, "code": code})
        out, cost = messages(plain)
        assert cost == least_cost(roles) and {r["conversation_cost"] for r in rows} == {cost}, roles
        names = [role for role, _ in out]
        names = names[1:] if names[0] == "system" else names
        assert names == ["user", "assistant"] * (len(names) // 2) and names
        rendered = "".join(r["rendered"] for r in rows)
        assert rendered == "".join(C.HEAD.format(role=role) + text + C.FOOT for role, text in out)


@pytest.mark.parametrize("stretch", [C.STRETCH, 3])
def test_repairs_cost_least_and_render(spark, stretch):
    rng = random.Random(6)
    turns = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            turns.append((conv if conv else None, turn, rng.choice(list(NAMES)), f"<{conv}.{turn}>" if rng.random() < 0.9 else rng.choice([None, ""])))
    # One long conversation, one with ties and null turns, one very long text.
    turns += [(500, t, rng.choice(["user", "user", "assistant", "tool"]), f"<500.{t}>") for t in range(400)]
    turns += [(501, None, "user", "<a>"), (501, None, "assistant", "<b>"), (501, 1, "user", "<c>"), (501, 1, "user", "<d>"), (501, 1, "user", "<d>")]
    turns += [(502, 0, "user", "x" * 200_000)]
    check(spark, turns, stretch)


def test_no_turns(spark):
    assert C.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_null_and_empty_ids_are_two_conversations(spark):
    turns = [(None, 0, "user", "a"), ("", 1, "user", "b"), (None, 2, "assistant", "c"), ("", 3, "assistant", "d")]
    got = C.repair(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")).collect()
    assert {r["conversation_cost"] for r in got} == {0} and {r["action"] for r in got} == {"keep"}


def test_stretches_and_levels_do_not_show(spark):
    """The same repairs, ties included, whatever the size of stretches and of groups of them."""
    rng = random.Random(11)
    turns = [(1, t, rng.choice(["user", "user", "assistant", "tool", "system"]), f"<{t}>") for t in range(90)]
    turns += [(c, t, rng.choice(["user", "assistant", None]), f"<{c}.{t}>") for c in range(2, 20) for t in range(rng.randint(1, 12))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = [sorted(tuple(r) for r in C.repair(df, *sizes).drop("pos").collect()) for sizes in [(C.STRETCH, C.FAN), (3, 4), (1, 3)]]
    assert len(got[0]) == len(turns) and got[0] == got[1] == got[2]


def test_no_group_grows_with_a_conversation(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "_grouped", lambda parts, column, fan, top, real=C._grouped: seen.append(real(parts, column, fan, top)) or seen[-1])
    turns = [(1, t, "user" if t % 3 else "assistant", "x") for t in range(200)]
    C.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 2, 4).collect()
    assert len(seen) > 6 and max(df.selectExpr("max(size(parts)) m").first()[0] for df in seen) <= 4
