"""Repair of damaged conversations by aligning their turns to the grammar ``(s?(ua)+)?`` of role initials.

Faults of a turn, the first that holds: *blank* (no character but blanks and control spaces), *duplicate* (role and text
came earlier in the conversation), *truncated* (the last character that is not white does not end a sentence). Edits and
their costs: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate turns), Insert an empty user or
assistant turn 5; a truncated turn that is not deleted adds 5. The cheapest edits win, and among these the audit (the initials
of the edits in order) that is least in ASCII.

Alignment is Wagner and Fischer's table, turns against the alternating grammar string, filled from the end. Seen from the
end the strings of all lengths are prefixes of one another, so one table has every feasible length as a column; an initial
``s`` takes one kept turn more in front. Ukkonen's band leaves out the cells that need more deletions or insertions
than an incumbent pays, which is one walk that keeps and reroles turn after turn. Of every length that costs least the audit is traced
back and the audits are compared.

Long conversations are cut into chunks of ``CHUNK`` turns. A chunk is aligned between every pair of grammar states (nothing yet,
after s, after u, after a pair), insertions always before the turn that follows, and a walk over the chunks' small cost tables
picks the pair of each: no two audits of a chunk begin alike, so the least whole audit is made of chunks' least ones. Only turn
classes, one letter a turn, take part in this; texts are joined to the edits afterwards.

Turns are ordered by turn (null first), then role and text. A null role or text is read as one blank (so such a text is blank and
such a role is no user); a null conversation id is a conversation of its own; turns may repeat; roles count by their first character and
may be empty; other columns are ignored. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranking import running_number
from leafmill.session import materialise

CHUNK = 1024
RUN = 1000  # turns that are numbered together
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
_FAR = 1 << 40
_WHITE = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after the system turn, after a user turn, after a whole pair.
NOTHING, SYSTEM, USER, PAIR = "BSAU"
_NEXT = {NOTHING: "u", SYSTEM: "u", USER: "a", PAIR: "u"}
_LAST = {USER: "u", PAIR: "a"}
_ROLES = {"u": "user", "a": "assistant"}
#: Letter of a turn that must go; otherwise s, u, a or o (another role), in upper case if truncated.
GONE = "x"


class Table:
    """Costs[i, d]: the least cost of aligning the last i turns to the last i + d + low signs of the alternating string
    that ends in ``last``; cells outside the band cost ``_FAR``."""

    def __init__(self, turns: str, last: str, final: bool, bound: int):
        n, gone = len(turns), turns.count(GONE)
        self.low = -min(n, bound // DELETE)
        self.high = max(0, (bound - DELETE * gone) // INSERT)
        self.last, self.other = last, "ua"["au".index(last)]
        offsets = np.arange(self.low, self.high + 1)
        costs = np.full((n + 1, len(offsets)), _FAR, np.int64)
        costs[0, offsets == 0] = 0
        if final:
            costs[0, offsets > 0] = INSERT * offsets[offsets > 0]
        for i in range(1, n + 1):
            sign, row, before = turns[n - i], costs[i], costs[i - 1]
            row[:-1] = before[1:] + DELETE
            if sign != GONE:
                same = self.match(sign, last), self.match(sign, self.other)
                step = np.where((offsets + i) % 2 == 1, *same)
                row[:] = np.where(offsets + i >= 1, np.minimum(row, before + step), row)
            row[offsets + i < 0] = _FAR
            row[:] = np.minimum(np.minimum.accumulate(row - INSERT * offsets) + INSERT * offsets, _FAR)
            row[offsets + i < 0] = _FAR
        self.turns, self.costs = turns, costs

    @staticmethod
    def match(sign: str, want: str) -> int:
        return (0 if sign.lower() == want else REROLE) + (CUT_OFF if sign.isupper() else 0)

    def sign(self, j: int) -> str:
        """The j-th sign from the end."""
        return self.last if j % 2 else self.other

    def cost(self, i: int, j: int) -> int:
        d = j - i - self.low
        return int(self.costs[i, d]) if j >= 0 and 0 <= d < self.costs.shape[1] else _FAR

    def audit(self, i: int, j: int) -> str:
        """The least audit of the last i turns against the last j signs."""
        out, n = [], len(self.turns)
        while i or j:
            now = self.cost(i, j)
            if i and self.cost(i - 1, j) + DELETE == now:
                out.append("D")
                i -= 1
            elif j and self.cost(i, j - 1) + INSERT == now:
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.turns[n - i].lower() == self.sign(j) else "R")
                i, j = i - 1, j - 1
        return "".join(out)


def _incumbent(turns: str, start: str, end: str) -> int:
    """What one walk costs that keeps or reroles the sound turns and deletes the others; a bound of every answer if it fails."""
    total, state, matched = 0, start, []
    for sign in turns:
        if sign == GONE or sign.isupper():
            total += DELETE
        elif state == NOTHING and sign == "s":
            state = SYSTEM
        else:
            matched.append(Table.match(sign, _NEXT[state]))
            total += matched[-1]
            state = USER if _NEXT[state] == "u" else PAIR
    if state != end and matched and (start == end or len(matched) > 1):
        total += DELETE - matched[-1]  # one turn less ends in the other state
        state = USER if state == PAIR else PAIR
    return total if state == end else DELETE * len(turns) + 2 * INSERT + CUT_OFF + REROLE


@lru_cache(maxsize=200_000)
def best_edits(turns: str, start: str, end: str, final: bool = True) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from one state to another; None if there is none."""
    n, found = len(turns), []
    if start == end:
        found.append((DELETE * n, "D" * n))
    if start == NOTHING and end == SYSTEM:
        found += [(DELETE * (n - 1) + (CUT_OFF if s == "S" else 0), "D" * t + "K" + "D" * (n - 1 - t)) for t, s in enumerate(turns) if s in "sS"]
    if end in _LAST:
        bound = min([_incumbent(turns, start, end), *[c for c, _ in found]])
        table = Table(turns, _LAST[end], final, bound)
        heads = [(0, None)] + [(t + 1, CUT_OFF if s == "S" else 0) for t, s in enumerate(turns) if s in "sS" and start == NOTHING]
        priced = []
        for taken, penalty in heads:  # the turns before the one after which the alternating part begins
            left = n - taken
            front = 0 if penalty is None else DELETE * (taken - 1) + penalty
            for j in range(max(1, left + table.low), left + table.high + 1):
                if table.sign(j) == _NEXT[start] and (cost := table.cost(left, j) + front) < _FAR:
                    priced.append((cost, taken, j))
        least = min((c for c, _, _ in priced), default=_FAR)
        for cost, taken, j in priced:
            if cost == least:
                found.append((cost, ("D" * (taken - 1) + "K" if taken else "") + table.audit(n - taken, j)))
    return min(found, default=None)


def outputs(turns: str, audit: str, state: str) -> Iterator[tuple[int, str, str | None]]:
    """(place of the turn in the chunk, edit, new role) of every edit; an insertion has the place of the turn that follows."""
    place = 0
    for edit in audit:
        role = None
        if edit in "IR":
            role = _NEXT[state]
        kept = role or (turns[place].lower() if edit == "K" else None)
        yield place, edit, _ROLES.get(role)
        if kept:
            state = SYSTEM if kept == "s" else USER if kept == "u" else PAIR
        place += edit != "I"


_OPTIONS = "chunk bigint, final boolean, start string, end string, cost bigint, rank int, audit string"


def _options(turns: str, chunk: int) -> list[tuple]:
    """The rows of ``_OPTIONS`` for one chunk. One that is not full ends its conversation, and the first starts one."""
    rows = []
    for final in (True, False) if len(turns) == CHUNK else (True,):
        for start in (NOTHING,) if chunk == 0 else (NOTHING, SYSTEM, USER, PAIR):
            ends = (NOTHING, PAIR) if final else (NOTHING, SYSTEM, USER, PAIR)
            found = {e: best for e in ends if (best := best_edits(turns, start, e, final))}
            order = sorted(found, key=lambda e: found[e][1])
            rows += [(chunk, final, start, e, found[e][0], order.index(e), found[e][1]) for e in found]
    if chunk == 0 and len(turns) < CHUNK:  # the whole conversation
        return [min(rows, key=lambda r: (r[4], r[6]))]
    return rows


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, rows = [], []
        for k, (chunk, turns) in enumerate(zip(batch["chunk"].to_pylist(), batch["turns"].to_pylist(), strict=True)):
            made = _options(turns, chunk)
            which += [k] * len(made)
            rows += made
        types = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        taken = batch.select(["conv", "turns"]).take(pa.array(which, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=["conv", "turns", "chunk", "final", "start", "end", "cost", "rank", "audit"])


def _choose(costs: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's chunks the pairs of states that cost least in all, with the least audit."""
    last = int(costs["chunk"].max())
    steps: dict[tuple[int, str], list[tuple]] = {}
    for chunk, final, start, end, cost, rank in costs[["chunk", "final", "start", "end", "cost", "rank"]].itertuples(index=False):
        if final == (chunk == last):
            steps.setdefault((chunk, start), []).append((cost, rank, end))
    after = {NOTHING: 0, PAIR: 0}
    totals = [after]
    for chunk in range(last, -1, -1):
        after = {s: min((c + after.get(e, _FAR) for c, _, e in steps.get((chunk, s), [])), default=_FAR) for s in (NOTHING, SYSTEM, USER, PAIR)}
        totals.append(after)
    totals.reverse()
    state, out = NOTHING, []
    for chunk in range(last + 1):
        _, _, end = min((rank, cost, e) for cost, rank, e in steps[chunk, state] if cost + totals[chunk + 1].get(e, _FAR) == totals[chunk][state])
        out.append((chunk, chunk == last, state, end))
        state = end
    return pd.DataFrame(out, columns=["chunk", "final", "start", "end"]).assign(id=costs["id"].iloc[0])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, pos, sub, edit, role = [], [], [], [], []
        for k, (chunk, turns, audit, start) in enumerate(zip(*[batch[c].to_pylist() for c in ("chunk", "turns", "audit", "start")], strict=True)):
            before = (-1, 0)
            for place, e, r in outputs(turns, audit, start):
                before = (place, before[1] + 1 if before[0] == place else 0)
                which.append(k)
                pos.append(chunk * CHUNK + place + 1)
                sub.append(before[1])
                edit.append(e)
                role.append(r)
        yield pa.RecordBatch.from_arrays(
            [batch["conv"].take(pa.array(which, pa.int64())), pa.array(pos, pa.int64()), pa.array(sub, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string())],
            names=["conv", "pos", "sub", "edit", "role"])


class Repair(NamedTuple):
    """``report``: one row per conversation with its faults, cost and audit. ``turns``: the repaired turns in the order of
    (pos, sub), with the edit that made each; pos is the place of the turn it came from, or before which it was inserted."""

    report: DataFrame
    turns: DataFrame


def _sound_end(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(_WHITE)), F.lit(1)).isin(".", "!", "?")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    id_type = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    rows = running_number(rows, ["id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")],
                          [F.floor(F.col("turn") / RUN)], "pos").withColumn("conv", F.struct("id"))
    rows = materialise(rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), "turns")
    blank = F.rtrim(F.col("text"), F.lit(_WHITE)) == ""
    flags = rows.select("conv", "pos", "turn", F.struct("conv", "role", "digest").alias("same"), blank.alias("blank"),
                        (~blank & ~_sound_end(F.col("text"))).alias("cut_off"), F.substring("role", 1, 1).alias("initial"))
    first = flags.where(~F.col("blank")).groupBy("same").agg(F.min("pos").alias("first"))
    duplicate = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    flags = flags.join(first, "same", "left").select(
        "conv", "pos", "turn", "blank", duplicate.alias("duplicate"), (F.col("cut_off") & ~duplicate).alias("truncated"), initial.alias("initial"))
    gone = F.col("blank") | F.col("duplicate")
    sign = F.when(gone, GONE).when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    flags = flags.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK)).withColumn("sign", sign)

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda s: s[name]), "")

    chunks = materialise(flags.groupBy("conv", "chunk").agg(
        joined("sign").alias("turns"), joined("initial").alias("initials"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")]), "turn-chunks")
    conv = f"conv struct<id:{id_type}>"
    options = materialise(chunks.select("conv", "chunk", "turns").mapInArrow(_align, f"{conv}, turns string, {_OPTIONS}"), "alignments")
    whole = options.where((F.col("chunk") == 0) & (F.length("turns") < CHUNK))
    long = options.join(whole.select("conv"), "conv", "left_anti")
    chosen = long.select("conv.id", "chunk", "final", "start", "end", "cost", "rank").groupBy("id").applyInPandas(
        _choose, f"chunk bigint, final boolean, start string, end string, id {id_type}")
    chosen = long.join(chosen.select(F.struct("id").alias("conv"), "chunk", "final", "start", "end"), ["conv", "chunk", "final", "start", "end"], "left_semi")
    audits = materialise(whole.unionByName(chosen), "audits")

    edits = audits.select("conv", "chunk", "turns", "audit", "start").mapInArrow(_edits, f"{conv}, pos bigint, sub bigint, edit string, role string")
    edits = edits.where("edit <> 'D'").withColumnRenamed("role", "new_role")
    inserted = edits.where("edit = 'I'").select("conv", "pos", "sub", "edit", F.lit(None).cast("bigint").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    kept = edits.where("edit <> 'I'").join(rows.select("conv", "pos", "turn", "role", "text"), ["conv", "pos"]).select(
        "conv", "pos", "sub", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    turns = kept.unionByName(inserted).select(F.col("conv.id").alias(conv_col), "pos", "sub", "edit", "turn", "role", "text")
    return Repair(_report(chunks, flags, audits).withColumnRenamed("id", conv_col), turns)


def _report(chunks: DataFrame, flags: DataFrame, audits: DataFrame) -> DataFrame:
    pair = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substr("initials", i, F.lit(2)))
    illegal = F.when(F.length("initials") > 1, F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    before = F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("conv").orderBy("chunk"))
    border = F.coalesce((~F.concat(before, F.left("initials", F.lit(1))).isin("su", "ua", "au")).cast("int"), F.lit(0))
    counts = chunks.select("conv", "blank", "duplicate", "truncated", (illegal + border).cast("bigint").alias("illegal")).groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = flags.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    paid = audits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    return counts.join(turns, "conv").join(paid, "conv").select(
        F.col("conv.id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, repaired_sha256: the digest of the lines ``role:text`` of each conversation, read in order and never held together."""
    id_type = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_ = None, None, False
        for batch in batches:
            ids, out = batch["id"].to_pylist(), []
            for i, line in zip(ids, batch["line"].to_pylist(), strict=True):
                if not open_ or i != now:
                    if open_:
                        out.append((now, state.hexdigest()))
                    now, state, open_ = i, sha256(line.encode()), True
                else:
                    state.update(b"\n" + line.encode())
            if out:
                yield _named(out, batch.schema.field("id").type)
        if open_:
            yield _named([(now, state.hexdigest())], batch.schema.field("id").type)

    lines = turns.select(F.col(f"`{conv_col}`").alias("id"), "pos", "sub", F.concat_ws(":", "role", "text").alias("line"))
    sorted_ = lines.repartition("id").sortWithinPartitions("id", "pos", "sub")
    return sorted_.select("id", "line").mapInArrow(run, f"id {id_type}, repaired_sha256 string").withColumnRenamed("id", conv_col)


def _named(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    ids, sums = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sums, pa.string())], names=["id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by a hash of conversation and turn: of twenty turns one is dropped, one emptied, one
    without its sentence ends, one repeated and one given to the user. Nulls become one blank."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
                                (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
