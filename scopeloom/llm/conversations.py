"""Repair of conversations by the cheapest edits that give ``(system? (user assistant)+)?``.

A conversation is a walk through four states: nothing yet, after a system, user or assistant turn. Every row, and
every run of rows, is a 4 x 4 table of (cost, tie): the cheapest way from one state to another and its place
among equals by its audit. Hirschberg's scheme then works on such tables alone: the cost vector from the left and the
one from the right meet in the middle, the cheapest crossing with the least audit is kept, and both halves are
solved again, so that no table of rows x states is ever held.

The same scheme runs twice. In Spark, rows are put in order over all tasks and cut into blocks; a conversation's
blocks, and groups of its blocks, are summed to one table each, crossings are chosen from the top down, and each
block is solved by itself inside a task. So a conversation may be longer than any task can hold.

An audit that is least for a state never has another state's audit as its beginning, since all of them end with a
row's letter; that is why the places among equals can be added up from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import shuffle_partitions, stored

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn of each state is called.
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block (a power of two), and runs that one task joins.
BLOCK_BITS, FAN_BITS = 12, 10
#: Blank characters, as in the definition of a blank text.
BLANKS = " \t\n\x0b\x0c\r"
#: Row index bits of monotonically_increasing_id; the task's number stands above them.
_INDEX_BITS = 33

Table = list[list[tuple[int, object] | None]]


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def row_table(initial: int, deleted: bool, truncated: bool) -> Table:
    """The ways past one row: inserted turns first, then Keep, Rerole or Delete; ties are settled by the letters."""
    table: Table = [[None] * 4 for _ in range(4)]

    def offer(a: int, b: int, way: tuple[int, str]) -> None:
        if table[a][b] is None or way < table[a][b]:
            table[a][b] = way

    for start in range(4):
        at = start
        for n in range(3):
            cost, letters = INSERT * n, "I" * n
            offer(start, at, (cost + DELETE, letters + "D"))
            if not deleted:
                cost += TRUNCATED * truncated
                fits = at == START if initial == SYSTEM else initial in (USER, ASSISTANT) and _next(at) == initial
                if fits:
                    offer(start, initial, (cost, letters + "K"))
                offer(start, _next(at), (cost + REROLE, letters + "R"))
            at = _next(at)
    return table


#: By initial (0 none of the three), then by what is wrong: nothing, must go, truncated.
ROW = [[row_table(i, d, t) for d, t in ((False, False), (True, False), (False, True))] for i in range(4)]
#: Turns that must follow the last row.
TAIL = ["", "II", "I", ""]


def forward(tables: list[Table], entry: int) -> list[tuple[int, int] | None]:
    """Cost and place among equals of the best way into each state."""
    best: list = [None] * 4
    best[entry] = (0, 0)
    for table in tables:
        ways: list = [None] * 4
        for a in range(4):
            if best[a] is not None:
                cost, place = best[a]
                for b, way in enumerate(table[a]):
                    if way is not None:
                        new = (cost + way[0], place, way[1])
                        if ways[b] is None or new < ways[b]:
                            ways[b] = new
        order = sorted((w[1:], b) for b, w in enumerate(ways) if w is not None)
        best = [None] * 4
        for k, (_, b) in enumerate(order):
            best[b] = (ways[b][0], k)
    return best


def backward(tables: list[Table], leave: int) -> list[int | None]:
    """Cost of the best way from each state to ``leave``."""
    best: list = [None] * 4
    best[leave] = 0
    for table in reversed(tables):
        best = [min((w[0] + best[b] for b, w in enumerate(row) if w is not None and best[b] is not None), default=None) for row in table]
    return best


def crossings(tables: list[Table], entry: int, leave: int) -> list[int]:
    """The state after each table on the cheapest way from ``entry`` to ``leave``, the least audit among equals."""
    out, todo = [leave] * len(tables), [(0, len(tables), entry, leave)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left, right = forward(tables[lo:mid], a), backward(tables[mid:hi], b)
        at = min((left[s][0] + right[s], left[s][1], s) for s in range(4) if left[s] is not None and right[s] is not None)[2]
        out[mid - 1] = at
        todo += [(lo, mid, a, at), (mid, hi, at, b)]
    return out


def _best_end(ends: list[tuple[int, int] | None]) -> tuple[int, int]:
    """Cost with the turns that must follow, and the last state."""
    cost, _, state = min((w[0] + INSERT * len(TAIL[s]), w[1], s) for s, w in enumerate(ends) if w is not None)
    return cost, state


# ---- tables as columns -------------------------------------------------------------------------------------------


def _flat(tables: list[list[tuple[int, int] | None]]) -> list[int]:
    return [x for row in tables for w in row for x in ((-1, -1) if w is None else w)]


def _deep(flat: list[int]) -> Table:
    return [[None if flat[k] < 0 else (flat[k], flat[k + 1]) for k in range(8 * a, 8 * a + 8, 2)] for a in range(4)]


def _streamed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], work: Callable[[tuple, list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Groups of rows that stand together, handed to ``work`` one by one. Groups are bounded by the caller's keys."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    out: list[dict] = []
    for key, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
        out += work(key, list(group))
        if len(out) >= 8192:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _by_group(df: DataFrame, keys: tuple[str, ...], order: str, work: Callable, schema: str) -> DataFrame:
    arrow = _arrow(df, schema)
    dealt = df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(lambda batches: _streamed(batches, keys, work, arrow), schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


# ---- facts of rows -----------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the fixed damage by crc32 of ``conv_id:turn``; null texts, roles and key parts are one space."""
    one = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")))
    rows = rows.withColumn("hurt", F.pmod(F.crc32(key.cast("binary")), F.lit(20))).where("hurt > 0")
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("hurt") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """All rows with their place ``pos`` by conversation, turn (nulls first), role and text, written once.

    The order is dealt by range over all tasks, so a long conversation spans several of them.
    """
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    by = ("conv_id", "turn", "role", "text")
    placed = rows.select(*by).repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return stored(
        placed.withColumn("pos", F.monotonically_increasing_id())
        .withColumn("initial", _initial())
        .withColumn("blank", kept == "")
        .withColumn("truncated", ~F.right(kept, F.lit(1)).isin(".", "!", "?"))
        .withColumn("said", F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    )


def facts(placed: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, turn, pos, block, initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated) of every row.

    First places of repeated turns are found by a sum per task before the shuffle; only they reach the join.
    """
    narrow = placed.select("conv_id", "turn", "pos", "initial", "blank", "truncated", "said")
    first = narrow.where(~F.col("blank")).groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("own"), F.col("said").alias("again"), "first")
    joined = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("said") == F.col("again")) & (F.col("pos") > F.col("first")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNotNull(), 2).when(F.col("truncated"), 3).otherwise(0)
    index = F.col("pos").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    block = F.shiftleft(F.shiftright("pos", _INDEX_BITS), _INDEX_BITS - block_bits) + F.shiftright(index, block_bits)
    return joined.select("conv_id", "turn", "pos", block.alias("block"), "initial", fault.alias("fault"))


def _row(r: dict) -> Table:
    return ROW[r["initial"]][{0: 0, 1: 1, 2: 1, 3: 2}[r["fault"]]]


_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _joined(items: list[dict]) -> dict:
    """First and last initial of neighbouring runs, and the illegal pairs in and between them."""
    between = sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(items, items[1:], strict=False))
    return {"first": items[0]["first"], "last": items[-1]["last"], "illegal": between + sum(x["illegal"] for x in items)}


# ---- runs, from the bottom up and back ------------------------------------------------------------------------------


def _runs(rows: DataFrame, kind: str) -> DataFrame:
    """One row per conversation and block: its table, first and last initial, illegal pairs."""

    def work(key: tuple, group: list[dict]) -> list[dict]:
        tables = [_row(r) for r in group]
        ends = _joined([{"first": r["initial"], "last": r["initial"], "illegal": 0} for r in group])
        return [{"conv_id": key[1], "run": key[0], "ways": _flat([forward(tables, a) for a in range(4)])} | ends]

    return _by_group(rows.select("block", "conv_id", "pos", "initial", "fault"), ("block", "conv_id"), "pos", work, f"conv_id {kind}, run bigint, ways array<bigint>, first int, last int, illegal bigint")


def _wider(runs: DataFrame, bits: int, kind: str) -> DataFrame:
    """Runs of one conversation whose numbers agree but for ``bits`` become one run."""

    def work(key: tuple, group: list[dict]) -> list[dict]:
        tables = [_deep(r["ways"]) for r in group]
        return [{"conv_id": key[0], "run": key[1], "ways": _flat([forward(tables, a) for a in range(4)])} | _joined(group)]

    return _by_group(runs.withColumn("wide", F.shiftright("run", bits)), ("conv_id", "wide"), "run", work, f"conv_id {kind}, run bigint, ways array<bigint>, first int, last int, illegal bigint")


def _tops(runs: DataFrame, kind: str) -> DataFrame:
    """Of each conversation with few runs: cost, illegal pairs, and the states that its runs start and end in."""

    def work(key: tuple, group: list[dict]) -> list[dict]:
        tables = [_deep(r["ways"]) for r in group]
        cost, last = _best_end(forward(tables, START))
        states = crossings(tables, START, last)
        illegal = _joined(group)["illegal"]
        return [{"conv_id": key[0], "run": r["run"], "entry": a, "leave": b, "ends": k == len(group) - 1, "cost": cost, "illegal": illegal} for k, (r, a, b) in enumerate(zip(group, [START, *states], states, strict=False))]

    return _by_group(runs, ("conv_id",), "run", work, f"conv_id {kind}, run bigint, entry int, leave int, ends boolean, cost bigint, illegal bigint")


def _narrower(runs: DataFrame, chosen: DataFrame, bits: int, kind: str) -> DataFrame:
    """States of the runs inside wider runs whose states are known."""

    def work(key: tuple, group: list[dict]) -> list[dict]:
        states = crossings([_deep(r["ways"]) for r in group], group[0]["entry"], group[0]["leave"])
        last = len(group) - 1
        return [{"conv_id": key[0], "run": r["run"], "entry": a, "leave": b, "ends": r["ends"] and k == last} for k, (r, a, b) in enumerate(zip(group, [group[0]["entry"], *states], states, strict=False))]

    wide = chosen.select(F.col("conv_id").alias("own"), F.col("run").alias("wide_run"), "entry", "leave", "ends")
    held = runs.withColumn("wide", F.shiftright("run", bits))
    held = held.join(wide, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("wide") == F.col("wide_run"))).drop("own", "wide_run")
    return _by_group(held, ("conv_id", "wide"), "run", work, f"conv_id {kind}, run bigint, entry int, leave int, ends boolean")


def chosen_edits(rows: DataFrame, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` are ``facts``. First: pos and its edits (letter, new role or null). Second: conv_id, cost, illegal."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    levels = [stored(_runs(rows, kind))]
    while (levels[-1].groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:
        levels.append(stored(_wider(levels[-1], fan_bits, kind)))
    top = stored(_tops(levels[-1], kind))
    chosen = top
    for runs in reversed(levels[:-1]):
        chosen = _narrower(runs, chosen, fan_bits, kind)

    def work(key: tuple, group: list[dict]) -> list[dict]:
        states = crossings([_row(r) for r in group], group[0]["entry"], group[0]["leave"])
        out = []
        for k, (r, a, b) in enumerate(zip(group, [group[0]["entry"], *states], states, strict=False)):
            letters, edits = _row(r)[a][b][1], []
            if r["ends"] and k == len(group) - 1:
                letters += TAIL[b]
            for x in letters:
                edits.append({"edit": x, "role": ROLES[_next(a)] if x in "RI" else None})
                a = _next(a) if x in "RI" else {"K": r["initial"], "D": a}[x]
            out.append({"pos": r["pos"], "edits": edits})
        return out

    own = chosen.select(F.col("conv_id").alias("own"), "run", "entry", "leave", "ends")
    held = rows.select("block", "conv_id", "pos", "initial", "fault").join(own, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("block") == F.col("run")))
    edits = _by_group(held.drop("own", "run"), ("block", "conv_id"), "pos", work, "pos bigint, edits array<struct<edit: string, role: string>>")
    return edits, top.select("conv_id", "cost", "illegal").distinct()


# ---- operators ---------------------------------------------------------------------------------------------------


def _audited(placed: DataFrame, edits: DataFrame) -> DataFrame:
    rows = placed.select("conv_id", "turn", "pos", F.col("role").alias("own_role"), "text").join(edits, "pos")
    each = rows.select("conv_id", "turn", "pos", "own_role", "text", F.posexplode("edits").alias("part", "e"))
    return each.select("conv_id", "pos", "part", "turn", F.col("e.edit").alias("edit"), F.coalesce("e.role", "own_role").alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per edit: conv_id, pos and part (their order), turn, edit (Keep, Rerole, Delete, Insert), role, text.

    ``rows`` has conv_id, turn, role and text; others are ignored. The repaired conversation is all but the D rows.
    Null turns come first, turns that repeat are ordered by role and text, null roles and texts count as one space;
    rows with a null conv_id are one conversation. No rows give no rows.
    """
    one = F.lit(" ")
    placed = ordered(rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text")))
    return _audited(placed, chosen_edits(stored(facts(placed)))[0])


def _digests(rows: DataFrame, kind: str) -> DataFrame:
    """Audit and digest of each conversation. A digest reads its texts in order, so each conversation streams
    through one task; nothing is held but the audit's letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done, now = ("conv_id", "audit", "repaired_sha256"), [], None
        for batch in batches:
            for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append((now[0], "".join(now[1]), now[2].hexdigest()))
                    now = (conv, [], hashlib.sha256(), [])
                now[1].append(edit)
                if edit != "D":
                    now[2].update(f"{chr(10) if now[3] else ''}{role}:{text}".encode())
                    now[3][:] = [True]
            if len(done) >= 8192:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema)
                done = []
        if now is not None:
            done.append((now[0], "".join(now[1]), now[2].hexdigest()))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema)

    form = f"conv_id {kind}, audit string, repaired_sha256 string"
    schema = _arrow(rows, form)
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "part")
    return dealt.select("conv_id", "edit", "role", "text").mapInArrow(work, form)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The fixed damage, then per original conv_id its faults, and cost, audit and digest of its repair.

    A conversation that lost all rows has zeros, an empty audit and the empty digest; an empty table gives no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    placed = ordered(damaged(conversations))
    rows = stored(facts(placed))
    edits, costs = chosen_edits(rows)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    counts = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.count_if(F.col("fault") == k).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))))
    out = conversations.select("conv_id").distinct()
    for side in (counts, costs, _digests(_audited(placed, edits), kind)):
        side = side.withColumnRenamed("conv_id", "own")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    zero = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
