"""Repairs against a plain search over grammar states that carries whole audits."""

import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pandas as pd
import pytest

from leafmill.llm import turn_repair
from leafmill.llm.queries import op12_turn_repair
from leafmill.llm.turn_repair import best_edits, damaged, repair
from tests.llm.helpers import table

NEXT = {"B": {"s": "S", "u": "A"}, "S": {"u": "A"}, "A": {"a": "U"}, "U": {"u": "A"}}


def cheapest(turns):
    """Least (cost, audit) over all edits; ``turns`` are (initial, must go, truncated)."""
    best = {"B": (0, "")}

    def insertions(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for sign, after in NEXT[state].items():
                    if sign != "s":
                        best[after] = min(best.get(after, (10**9, "")), (cost + 5, audit + "I"))
        return best

    for initial, gone, truncated in turns:
        after = {}
        for state, (cost, audit) in insertions(best).items():
            moves = [(state, cost + 2, audit + "D")]
            if not gone:
                extra = 5 if truncated else 0
                for sign, to in NEXT[state].items():
                    if sign == initial:
                        moves.append((to, cost + extra, audit + "K"))
                    elif sign != "s":
                        moves.append((to, cost + extra + 1, audit + "R"))
            for to, c, a in moves:
                after[to] = min(after.get(to, (10**9, "")), (c, a))
        best = after
    best = insertions(best)
    return min(best[s] for s in "BU" if s in best)


def read(turns):
    return [(t.lower(), t == "x", t.isupper()) for t in turns]


def whole(turns):
    return min(b for e in "BU" if (b := best_edits(turns, "B", e)))


def strings():
    rng = random.Random(3)
    for n in range(1, 5):
        yield from map("".join, itertools.product("suaoSUAx", repeat=n))
    for weights in ((2, 8, 8, 1, 1, 1, 1, 2), (1, 1, 1, 1, 1, 1, 1, 1), (0, 1, 9, 0, 0, 1, 1, 6), (9, 1, 1, 0, 9, 1, 1, 0)):
        for n in (6, 9, 14, 40):
            for _ in range(60):
                yield "".join(rng.choices("suaoSUAx", weights, k=n))


def test_every_short_and_many_longer_conversations():
    for turns in strings():
        assert whole(turns) == cheapest(read(turns)), turns


def test_a_long_one_stays_cheap_in_a_narrow_band():
    turns = "s" + "ua" * 2000 + "x" + "ua" * 2000
    assert whole(turns) == (2, "K" + "K" * 4000 + "D" + "K" * 4000)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_chunks_give_the_same(monkeypatch, size):
    monkeypatch.setattr(turn_repair, "CHUNK", size)
    for turns in itertools.islice(strings(), 0, None, 7):
        rows = []
        for chunk, start in enumerate(range(0, len(turns), size)):
            rows += turn_repair._options(turns[start : start + size], chunk)
        names = ["chunk", "final", "start", "end", "cost", "rank", "audit"]
        costs = pd.DataFrame(rows, columns=names).assign(id=1)
        if len(turns) < size:
            assert (rows[0][4], rows[0][6]) == cheapest(read(turns))
            continue
        chosen = turn_repair._choose(costs.drop(columns="audit")).merge(costs, on=names[:4]).sort_values("chunk")
        assert (chosen.cost.sum(), "".join(chosen.audit)) == cheapest(read(turns)), turns


def plain(rows):
    """The query's rows from (conv_id, turn, role, text), as the contract words it."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]  # noqa: B018  every conversation has a row
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        cost, audit = cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(turns, faults, strict=True)])
        lines, place, state = [], 0, "B"
        for edit in audit:
            if edit != "I":
                _, role, text = turns[place]
                place += 1
            if edit == "D":
                continue
            if edit in "IR":
                role = "user" if "u" in NEXT[state] else "assistant"
            lines.append(f"{role}:{'' if edit == 'I' else text}")
            state = NEXT[state][role[:1]]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_turn_repair(spark, str(tmp_path)).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_query_on_the_table(spark, tmp_path):
    rows = table("conversations", "conv_id, turn, role, text")
    assert run(spark, rows, tmp_path) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "", "tool", "Ünit", None], ["Yes.", "No", "", " \t\r\n\x0b", None, "Why?", "é!\n", "x. y", "\xa0", "...", "a:b\nc."]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 12))]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"Text {t}.") for t in range(6)] * 2 + [(2000, None, None, None)]
    rows += [(3000 + i, 0, "user", "Hi.") for i in range(40)]  # some lose their only turn
    assert run(spark, rows, tmp_path) == plain(rows)


def test_a_conversation_of_several_chunks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"] * 6 + ["system"]), rng.choice([f"Text {t}.", "Same.", f"cut {t}", ""])) for c in (5, None) for t in range(2600)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"Clean {t}!") for t in range(1024)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind.", 9), (1, 1, "assistant", "Hello.", 9), (1, 2, "tool", "Yes.", 9), (1, 2, "tool", "Yes.", 9), (1, 3, "user", "End", 9)]
    done = repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos int"))
    assert [tuple(r) for r in done.turns.orderBy("pos", "sub").select("conv_id", "edit", "turn", "role", "text").collect()] == [
        (1, "K", 0, "system", "Be kind."), (1, "R", 1, "user", "Hello."), (1, "R", 2, "assistant", "Yes.")]
    assert [r.audit for r in done.report.collect()] == ["KRRDD"]


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}
    assert damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect() == []
