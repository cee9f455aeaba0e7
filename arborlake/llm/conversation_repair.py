"""Conversation structure repair by square-root checkpointed dynamic programming.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and empty rows are
inserted; of the cheapest ways the one whose edit initials are ASCII-least is taken.

The state is what the last remaining row was: nothing yet, system, user, assistant. Going backward over the rows gives
for each state the least cost of the rest. Only every square-root-th of these cost vectors is kept; going forward, the vectors
of one block at a time are computed again from the checkpoint at its end, and the least tight edit is emitted. Memory is two square roots of
a conversation's length.

Conversations of at most ``PIECE`` rows are settled one after another in a sorted stream. Longer ones, which may
hold a third of all rows, are cut into pieces of ``PIECE`` rows by exact row numbers and settled in three passes: every piece gives its
table of least costs from state to state; these are chained backward into each piece's end vector; every piece gives the
state that it leads to from each state; these are chained forward; then every piece emits its edits. What is chained is one
row a piece. Only SHA-256, which has no parallel form, reads the repaired pieces of a conversation in order, as a stream.

Defined results: null roles and texts are one space; a null conv_id is a conversation like any other; rows are in
order of turn (nulls first), then role, then text; a row that stands several times is a duplicate of its first; an
empty role has an empty initial, which no conversation allows; a conversation whose rows are all gone has zeros, an empty
audit and no repaired row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .ranks import MOST, ranked

PIECE = MOST
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = 1 << 60
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a new row becomes, and where a kept initial leads.
_NEXT, _NEW = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = {"su", "ua", "au"}
_TURN = "array<struct<role:string,text:string>>"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the checksum of ``conv_id:turn``."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    rows = rows.withColumn("fault", F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("one")).drop("one")


def _closed(v: list[int]) -> tuple[int, int, int, int]:
    """Costs to the end where rows may be inserted first."""
    user = min(v[2], INSERT + v[3])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, min(v[3], INSERT + v[2])


END = _closed([0, _FAR, _FAR, 0])


def _before(row: tuple, after: tuple) -> tuple:
    """The cost vector in front of a row (initial, must go, truncated) from the one behind it."""
    initial, must_go, late = row
    v = [DELETE + c for c in after]
    if must_go:
        return tuple(v)
    add, keep = TRUNCATED * late, _KEEP.get(initial, {})
    for s in range(4):
        v[s] = min(v[s], REROLE + add + after[_NEXT[s]], add + after[keep[s]] if s in keep else _FAR)
    return _closed(v)


def _walk(rows: list[tuple], state: int, end: tuple, last: bool) -> tuple[str, list[tuple[int | None, str | None]], int]:
    """Edit initials, the remaining rows as (row number or None, new role or None), and the state reached."""
    n = len(rows)
    block = isqrt(n) + 1
    marks, v = {n: end}, end
    for i in reversed(range(n)):
        v = _before(rows[i], v)
        if i % block == 0:
            marks[i] = v
    edits, left = [], []
    for a in range(0, n, block):
        b = min(a + block, n)
        costs = [marks[b]]
        for i in reversed(range(a, b)):
            costs.append(_before(rows[i], costs[-1]))
        costs.reverse()
        for i in range(a, b):
            (initial, must_go, late), here, after = rows[i], costs[i - a], costs[i - a + 1]
            keep = _KEEP.get(initial, {})
            while here[state] != DELETE + after[state] and here[state] == INSERT + here[_NEXT[state]]:
                edits.append("I")
                left.append((None, _NEW[state]))
                state = _NEXT[state]
            if here[state] == DELETE + after[state]:
                edits.append("D")
            elif state in keep and here[state] == TRUNCATED * late + after[keep[state]]:
                edits.append("K")
                left.append((i, None))
                state = keep[state]
            else:
                edits.append("R")
                left.append((i, _NEW[state]))
                state = _NEXT[state]
    while last and end[state]:
        edits.append("I")
        left.append((None, _NEW[state]))
        state = _NEXT[state]
    return "".join(edits), left, state


def _turns(left: list, rows: list[tuple]) -> list[dict]:
    return [{"role": new or rows[i][0], "text": "" if i is None else rows[i][1]} for i, new in left]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _streamed(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of equal keys in sorted batches; only one batch is held."""
    names = None

    def rows():
        nonlocal names
        for b in batches:
            names = b.schema.names
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    return groupby(rows(), key=lambda r: tuple(r[names.index(k)] for k in key))


def _packed(rows: Iterator[tuple], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``chars`` characters of text."""
    held, size = [], 0
    for r, weight in rows:
        held.append(r)
        size += weight + 100
        if size > chars:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


_LONG, _STR = pa.int64(), pa.string()
_SETTLED = pa.schema([("conv_id", _LONG), ("piece", _LONG), *[(c, _LONG) for c in _COUNTS], ("audit", _STR), ("turns", pa.list_(pa.struct([("role", _STR), ("text", _STR)])))])
_SETTLED_SQL = "conv_id long, piece long, " + ", ".join(f"{c} long" for c in _COUNTS) + f", audit string, turns {_TURN}"


def _settle_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations: conv_id, turn, role, text, blank, late, here (false: the row only names the conversation)."""

    def settled():
        for (conv,), rows in _streamed(batches, ["conv_id"]):
            rows = [r for r in rows if r[6]]
            seen, coded, faults = set(), [], [0, 0, 0]
            for _, _, role, text, blank, late, _ in rows:
                again = not blank and (role, text) in seen
                seen.add((role, text))
                late = late and not blank and not again
                for k, fault in enumerate((blank, again, late)):
                    faults[k] += fault
                coded.append((role[:1], blank or again, late))
            turns = {r[1] for r in rows} - {None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            audit, left, _ = _walk(coded, 0, END, True)
            cost = sum(DELETE * (e == "D") + INSERT * (e == "I") + REROLE * (e == "R") for e in audit) + TRUNCATED * sum(i is not None and coded[i][2] for i, _ in left)
            yield (conv, 0, gaps, *faults, _illegal([c[0] for c in coded]), cost, audit, _turns(left, [(r[2], r[3]) for r in rows])), sum(len(r[3]) for r in rows)

    return _packed(settled(), _SETTLED)


def _chained(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the rows (conv_id, piece, ...) of each conversation in order of ``by``, as a stream."""
    return df.mapInArrow(fn, schema)


def _settle_long(rows: DataFrame, piece: int) -> DataFrame:
    """Long conversations in pieces: the columns of ``_SETTLED``, counts on the first piece."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    at = ranked(rows, "conv_id", order, "at", piece).withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    at = materialise(at, "long-rows")
    first = at.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("at").alias("first"))
    at = at.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    again = ~F.col("blank") & (F.col("at") > F.col("first"))
    cut = at.select("conv_id", F.floor((F.col("at") - 1) / F.lit(piece)).cast("long").alias("piece"), "at", "turn", "role", "text", "blank", again.alias("again"), (F.col("late") & ~F.col("blank") & ~again).alias("late"))
    cut = materialise(cut, "pieces")
    codes = cut.select("conv_id", "piece", "at", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("again")).alias("must_go"), "late")

    def coded(table: pa.Table) -> list[tuple]:
        t = table.sort_by("at")
        return list(zip(t["initial"].to_pylist(), t["must_go"].to_pylist(), t["late"].to_pylist(), strict=True))

    def tables(table: pa.Table) -> pa.Table:
        rows, found = coded(table), []
        for t in range(4):
            v = _closed([0 if s == t else _FAR for s in range(4)])
            for r in reversed(rows):
                v = _before(r, v)
            found.append(v)
        ends = [rows[0][0], rows[-1][0]]
        return pa.table({"conv_id": table["conv_id"][:1], "piece": table["piece"][:1], "costs": pa.array([[found[t][s] for s in range(4) for t in range(4)]], pa.list_(_LONG)), "illegal": pa.array([_illegal([r[0] for r in rows])], _LONG), "ends": pa.array([ends], pa.list_(_STR))})

    def backward(batches):
        def rows():
            for _, run in _streamed(batches, ["conv_id"]):
                end = END
                for conv, k, costs in run:
                    yield (conv, k, list(end)), 0
                    end = tuple(min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4))

        return _packed(rows(), pa.schema([("conv_id", _LONG), ("piece", _LONG), ("end", pa.list_(_LONG))]))

    def leads(table: pa.Table) -> pa.Table:
        rows, end = coded(table), tuple(table["end"][0].as_py())
        return pa.table({"conv_id": table["conv_id"][:1], "piece": table["piece"][:1], "to": pa.array([[_walk(rows, s, end, False)[2] for s in range(4)]], pa.list_(_LONG))})

    def forward(batches):
        def rows():
            for _, run in _streamed(batches, ["conv_id"]):
                state = 0
                for conv, k, to in run:
                    yield (conv, k, state), 0
                    state = to[state]

        return _packed(rows(), pa.schema([("conv_id", _LONG), ("piece", _LONG), ("state", _LONG)]))

    def with_piece(df: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnsRenamed({"conv_id": "c", "piece": "k"})
        return df.join(more, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("k"))).drop("c", "k")

    def chain(df: DataFrame, fn, schema: str, down: bool, name: str) -> DataFrame:
        by = F.col("piece").desc() if down else F.col("piece")
        return materialise(df.repartition("conv_id").sortWithinPartitions("conv_id", by).mapInArrow(fn, schema), name)

    found = materialise(codes.groupBy("conv_id", "piece").applyInArrow(tables, "conv_id long, piece long, costs array<long>, illegal long, ends array<string>"), "piece-costs")
    ends = chain(found.select("conv_id", "piece", "costs"), backward, "conv_id long, piece long, end array<long>", True, "piece-ends")
    led = with_piece(codes, ends).groupBy("conv_id", "piece").applyInArrow(leads, "conv_id long, piece long, to array<long>")
    states = chain(led, forward, "conv_id long, piece long, state long", False, "piece-states")
    far = found.groupBy(F.col("conv_id").alias("c")).agg(F.max("piece").alias("far"))

    def emit(table: pa.Table) -> pa.Table:
        t = table.sort_by("at")
        rows, said = coded(table), list(zip(t["role"].to_pylist(), t["text"].to_pylist(), strict=True))
        k = t["piece"][0].as_py()
        audit, left, _ = _walk(rows, t["state"][0].as_py(), tuple(t["end"][0].as_py()), k == t["far"][0].as_py())
        cost = sum(DELETE * (e == "D") + INSERT * (e == "I") + REROLE * (e == "R") for e in audit) + TRUNCATED * sum(i is not None and rows[i][2] for i, _ in left)
        return pa.Table.from_pylist([{"conv_id": t["conv_id"][0].as_py(), "piece": k, "cost": cost, "audit": audit, "turns": _turns(left, said)}], pa.schema([_SETTLED.field(c) for c in ("conv_id", "piece", "cost", "audit", "turns")]))

    whole = with_piece(with_piece(cut.withColumn("initial", F.substring("role", 1, 1)).withColumn("must_go", F.col("blank") | F.col("again")), ends), states)
    whole = whole.join(far, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    emitted = materialise(whole.groupBy("conv_id", "piece").applyInArrow(emit, f"conv_id long, piece long, cost long, audit string, turns {_TURN}"), "piece-edits")

    step = found.select(F.col("conv_id").alias("c"), F.col("piece").alias("k"), "ends", "illegal")
    after = found.select(F.col("conv_id").alias("c2"), (F.col("piece") - 1).alias("k2"), F.col("ends").alias("next"))
    pair = F.concat(F.col("ends")[1], F.col("next")[0])
    step = step.join(after, F.col("c").eqNullSafe(F.col("c2")) & (F.col("k") == F.col("k2")), "left")
    step = step.groupBy("c").agg(F.sum(F.col("illegal") + F.when(F.col("next").isNotNull() & ~pair.isin(*_LEGAL), 1).otherwise(0)).alias("illegal"))
    tell = cut.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.count_if(F.col(c)).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("late", "truncated"))])
    tell = tell.join(step, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv_id", "c")
    tell = tell.withColumn("k", F.lit(0).cast("long"))
    met = emitted.join(tell, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("k")), "left")
    return met.select("conv_id", "piece", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS], "audit", "turns")


def settled(rows: DataFrame, known: DataFrame | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame | None]:
    """The repaired conversations (conv_id, piece, counts, audit, turns): whole ones, and the pieces of long ones or None.

    ``rows``: conv_id, turn, role, text. ``known``: conv_ids to tell of even if no row of theirs is left.
    """
    ship(rows.sparkSession)
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role"), told("text"))
    rows = rows.withColumns({"blank": bare == "", "late": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "here": F.lit(True)})
    long = materialise(rows.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece).select("c"), "long-conversations")
    same, some = F.col("conv_id").eqNullSafe(F.col("c")), not long.isEmpty()
    marks = known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct() if known is not None else None
    every = rows if marks is None else rows.unionByName(marks.withColumn("here", F.lit(False)), allowMissingColumns=True)
    short = every.join(long, same, "left_anti") if some else every
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    whole = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_settle_whole, _SETTLED_SQL)
    return whole, _settle_long(rows.join(long, same, "left_semi").drop("here"), piece) if some else None


def repaired_turns(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, at, role, text: the repaired rows; their order is that of piece and at."""
    whole, long = settled(rows, piece=piece)
    both = whole if long is None else whole.unionByName(long)
    return both.select("conv_id", "piece", F.posexplode("turns").alias("at", "t")).select("conv_id", "piece", "at", "t.role", "t.text")


def repair(rows: DataFrame, known: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """One row per conversation: conv_id, the counts, cost, audit, repaired_sha256."""
    whole, long = settled(rows, known, piece)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = whole.select("conv_id", *_COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    if long is None:
        return out
    long = materialise(long, "long-conversations-settled")

    def hashed(batches):
        def rows():
            for (conv,), run in _streamed(batches, ["conv_id"]):
                sha, any_yet = hashlib.sha256(), False
                for _, _, line, n in run:
                    if n:
                        sha.update((b"\n" if any_yet else b"") + line.encode("utf-8", "surrogatepass"))
                        any_yet = True
                yield (conv, sha.hexdigest()), 0

        return _packed(rows(), pa.schema([("c", _LONG), ("repaired_sha256", _STR)]))

    order = [F.col("conv_id").asc_nulls_first(), "piece"]
    sums = long.select("conv_id", "piece", lines.alias("line"), F.size("turns").alias("n")).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(hashed, "c long, repaired_sha256 string")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "")
    told = long.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _COUNTS], audit.alias("audit"))
    return out.unionByName(told.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).select(*out.columns))
