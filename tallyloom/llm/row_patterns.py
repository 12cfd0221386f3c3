"""Row pattern matching: `A D+ U+ P` over each key's rows in order, by one reverse scan with monotonic stacks.

Rows are cut by range of (key, time, row) into as many chunks as spark.sql.shuffle.partitions says, so a hot key spans many chunks.
A task streams its chunk from the last row to the first. D and U exclude each other on a row, so from any first row the D rows
are all that follow it and the U rows all that follow those; only P is open. The scan keeps the run of U rows ahead and a stack
of its goals (rows that may be P):

- reluctant P, the first goal that is enough for A: a stack of next greater or equal goals; a goal that a nearer one reaches is popped;
- greedy P, the last such goal: the records of the maxima from the run's end, searched by bisection.

A match that may go on beyond its chunk's end isn't answered yet: its rows are left over as the chunk's tail, and every chunk gives
the state of its scan at its first row. The state of the chunk behind continues the scan over the tail. A chunk that is all
tail (one valley through thousands of rows) waits a round for the chunk behind it, so each row is scanned twice at most.
States are few (one a chunk); tails, matches and their numbers never meet in one task.

Rows with a null key or time are dropped, and of equal rows one stays. A row whose amount is null, not finite or beyond 2**62
fits no letter. A null row id sorts first. Rows that tie in time and row id are ordered by amount (null first), fits and goal.
Empty tables give no matches. Other columns of the table only tell rows apart.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, partitions, ship_package

MATCH, TAIL, STATE = 0, 1, 2
_FIELDS = ("tag", "part", "seq", "key", "time", "row", "last_row", "amount", "fits", "goal", "n_rows", "n_down", "n_up", "total", "state")


class Scan:
    """The reverse scan. `known` tells whether what follows the first row fed is known (an end, or a loaded state)."""

    def __init__(self, gap: int, greedy: bool, known: bool):
        self.gap, self.greedy = gap, greedy
        self.edge = None if known else "U"  # the letters between the row at hand and an unknown end, or None beyond them
        self.last = None  # the row fed last: key, time, row, amount, fits, goal
        self.ahead = None  # the row behind it: whether it may be P, its id, amount, place, and the sum of what follows it
        self.down = self.up = self.place = self.total = 0
        self.caps: list[int] = []  # amounts of the stack's goals: ascending if greedy, else descending
        self.goals: list[tuple] = []  # their row ids, places, and sums of what follows

    def state(self) -> bytes:
        return pickle.dumps((self.last, self.ahead, self.down, self.up, self.place, self.total, self.caps, self.goals))

    def load(self, state: bytes) -> Scan:
        self.last, self.ahead, self.down, self.up, self.place, self.total, self.caps, self.goals = pickle.loads(state)
        return self

    def push(self, goal: tuple) -> None:
        _, row, amount, place, after = goal
        if self.greedy:
            if self.caps and amount <= self.caps[-1]:
                return  # a later goal reaches as far
        else:
            amount = -amount
            while self.caps and self.caps[-1] >= amount:
                self.caps.pop()
                self.goals.pop()
        self.caps.append(amount)
        self.goals.append((row, place, after))

    def found(self, amount: int) -> tuple | None:
        if self.greedy:  # ascending to the left: the first from the right that is enough
            k = bisect_left(self.caps, amount)
            return self.goals[k] if k < len(self.caps) else None
        k = bisect_left(self.caps, -amount + 1) - 1  # negated and ascending to the left: the leftmost that is enough
        return self.goals[k] if k >= 0 else None

    def feed(self, rows, relations, matches: list, tail: list) -> None:
        """rows: (key, time, row, amount, fits, goal), last row first; relations: of the row fed before to each: -1 D, 1 U, 0 neither; and whether it may be P."""
        for (key, time, row, amount, fits, goal), (letter, may_end) in zip(rows, relations, strict=True):
            after = self.total
            before = self.last
            if before is not None:
                ending = (may_end, before[2], before[3], self.place, after - (before[3] or 0))
                if letter > 0:
                    if self.down or not self.up:
                        self.caps.clear()
                        self.goals.clear()
                        self.up = self.down = 0
                    self.up += 1
                    if self.ahead is not None and self.ahead[0]:
                        self.push(self.ahead)
                elif letter < 0:
                    self.down += 1
                else:
                    self.down = self.up = 0
                if self.edge is not None:
                    self.edge = "D" if letter < 0 else "U" if letter > 0 and self.edge == "U" else None
                self.ahead = ending
            self.place += 1
            self.total = after + (amount or 0)
            if self.edge is not None:
                tail.append((self.place, key, time, row, amount, fits, goal))
            elif self.down and self.up and letter < 0 and (hit := self.found(amount)) is not None:
                last, place, beyond = hit
                n = self.place - place + 1
                matches.append((self.place, key, time, row, last, n, self.down, n - self.down - 2, self.total - beyond))
            self.last = (key, time, row, amount, fits, goal)


def relations(scan: Scan, key, time, amount, valid, fits, goal) -> list[tuple[int, bool]]:
    """For each row of a batch (last row first): how the row fed before it, the next one in order, follows it."""
    n = len(time)
    if not n:
        return []
    later = lambda x, first: np.concatenate([[first], x[:-1]])
    last = scan.last
    same = np.empty(n, bool)
    same[0] = last is not None and key[0].as_py() == last[0]
    same[1:] = pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    no = last is None
    next_time, next_amount = later(time, time[0] if no else last[1]), later(amount, 0 if no else last[3] or 0)
    near = same & valid & later(valid, not no and last[3] is not None) & (next_time - time <= scan.gap)
    run = near & later(fits, not no and last[4])
    letters = np.where(run, np.sign(next_amount - amount), 0).astype(np.int8)
    return list(zip(letters.tolist(), (near & later(goal, not no and last[5])).tolist(), strict=True))


def fed(scan: Scan, key, time, row, amount, fits, goal, matches: list, tail: list) -> None:
    """Feeds arrays of a batch to the scan."""
    valid = amount.is_valid().to_numpy(zero_copy_only=False)
    flat = amount.fill_null(0).to_numpy(zero_copy_only=False)
    micros = time.to_numpy(zero_copy_only=False)
    flags = [x.fill_null(False).to_numpy(zero_copy_only=False) for x in (fits, goal)]
    how = relations(scan, key, micros, flat, valid, *flags)
    rows = zip(key.to_pylist(), micros.tolist(), row.to_pylist(), amount.to_pylist(), flags[0].tolist(), flags[1].tolist(), strict=True)
    scan.feed(rows, how, matches, tail)


def _rows_out(part: int, matches: list, tail: list, state: tuple | None, schema: pa.Schema) -> pa.RecordBatch:
    """Matches, rows of the tail, and the state (its sequence number and bytes) as rows of one schema."""
    rows = [(MATCH, part, seq, key, time, row, last, None, None, None, n, down, up, total, None) for seq, key, time, row, last, n, down, up, total in matches]
    rows += [(TAIL, part, seq, key, time, row, None, amount, fits, goal, None, None, None, None, None) for seq, key, time, row, amount, fits, goal in tail]
    if state is not None:
        rows.append((STATE, part, 0, *[None] * 11, state[0]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), schema, strict=True)], schema=schema)


def _schema(key_type: str, row_type: str) -> str:
    return f"tag int, part int, seq long, key {key_type}, time long, row {row_type}, last_row {row_type}, amount long, fits boolean, goal boolean, n_rows long, n_down long, n_up long, total decimal(38,0), state binary"


def _chunks(gap: int, greedy: bool, schema: pa.Schema):
    """Each task's rows are one chunk, last row first."""

    def run(batches):
        scan, part = Scan(gap, greedy, False), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            matches: list = []
            tail: list = []
            time = batch.column("time").cast(pa.timestamp("us", batch.schema.field("time").type.tz)).cast(pa.int64())
            fed(scan, batch.column("key"), time, batch.column("row"), batch.column("amount"), batch.column("fits"), batch.column("goal"), matches, tail)
            yield _rows_out(part, matches, tail, None, schema)
        if part is not None:  # a null state: the chunk is all tail, so the chunk behind it decides
            yield _rows_out(part, [], [], (None if scan.edge is not None else scan.state(),), schema)

    return run


def _tails(gap: int, greedy: bool, schema: pa.Schema):
    """The scan over one chunk's tail, from the state of the chunk behind."""

    def run(table: pa.Table, round_: pa.Table) -> pa.Table:
        if not table.num_rows or not round_.num_rows:  # a chunk of another round
            return pa.Table.from_batches([], schema=schema)
        table = table.sort_by("seq").combine_chunks()
        carry, whole = round_.column("carry")[0].as_py(), round_.column("whole")[0].as_py()
        scan = Scan(gap, greedy, True)
        if carry is not None:
            scan.load(carry)
        start = scan.place
        matches: list = []
        names = ("key", "time", "row", "amount", "fits", "goal")
        for batch in table.to_batches(max_chunksize=65_536):
            fed(scan, *(batch.column(c) for c in names), matches, [])
        found = [(seq - start, *rest) for seq, *rest in matches]
        out = _rows_out(table.column("part")[0].as_py(), found, [], (scan.state(),) if whole else None, schema)
        return pa.Table.from_batches([out], schema=schema)

    return run


def valleys(df: DataFrame, key: str, time: str, row: str, amount: Column, fits: Column, goal: Column, *, gap: timedelta = timedelta(minutes=5), greedy: bool = True) -> DataFrame:
    """Every first row's match of `A D+ U+ P` (of `A D+ U+? P`, up to the first P, with greedy=False).

    amount: what D falls and U rises in, whole numbers (null: no letter); fits: whether
    a row may be D or U; goal: whether it may be P, which also needs an amount no less than A's. D, U and P follow their
    previous row within `gap`. One row per match: key, match_no (from 1 for each key, in order of first rows), first_row,
    last_row, n_rows, n_down, n_up, total (sum of amounts), all named so; key and row ids keep their types.
    """
    spark = df.sparkSession
    ship_package(spark)
    kinds = {c: df.schema[c].dataType for c in (key, row)}
    text = _schema(*(kinds[c].simpleString() for c in (key, row)))
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "decimal(38,0)": pa.decimal128(38, 0)}
    schema = pa.schema([(name, to_arrow_type(kinds[key]) if name == "key" else to_arrow_type(kinds[row]) if name in ("row", "last_row") else arrow[part.split(" ")[1]]) for name, part in zip(_FIELDS, text.split(", "), strict=True)])
    gap_us = gap // timedelta(microseconds=1)

    # What tells rows apart beside the columns used is one hash, nulls included, so that little is shuffled.
    others = [F.col(f"`{c}`") if "map<" not in kind else F.to_json(F.col(f"`{c}`")) for c, kind in df.dtypes if c not in (key, time, row)]
    apart = F.xxhash64(F.lit(0), *others, *(F.coalesce(c.isNull(), F.lit(True)) for c in others))
    whole = F.when(F.abs(amount) < float(2**62), amount.cast("double")).cast("long")
    own = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{time}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("time"), F.col(f"`{row}`").alias("row"), whole.alias("amount"), F.coalesce(fits, F.lit(False)).alias("fits"), F.coalesce(goal, F.lit(False)).alias("goal"), apart.alias("apart")
    )
    order = ("key", "time", "row", "amount", "fits", "goal")
    chunks = own.distinct().drop("apart").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*(F.desc(c) for c in order))
    with Scratch(spark) as scratch:
        made = scratch.written(chunks.withColumn("part", F.spark_partition_id()).mapInArrow(_chunks(gap_us, greedy, schema), text), "scanned")
        matched = made.filter(F.col("tag") == MATCH)
        states = made.filter(F.col("tag") == STATE).select("part", "state")
        # One row a chunk: as many as the setting says, however large the table.
        ring = Window.orderBy(F.desc("part"))
        follows = scratch.written(states.select("part", F.col("state").isNull().alias("whole"), F.lag("part").over(ring).alias("behind"), F.lag(F.col("state").isNull()).over(ring).alias("waits")), "follows")
        tails = made.filter(F.col("tag") == TAIL).select("part", "seq", "key", "time", "row", "amount", "fits", "goal")
        waiting = F.coalesce("waits", F.lit(False))
        ready, rest = follows.filter(~waiting), follows.filter(waiting)
        left = rest.count()
        while True:
            round_ = ready.join(states.select(F.col("part").alias("behind"), F.col("state").alias("carry")), "behind", "left").select("part", "whole", "carry")
            done = scratch.written(tails.groupBy("part").cogroup(round_.groupBy("part")).applyInArrow(_tails(gap_us, greedy, schema), text), "tails")
            matched = matched.unionByName(done.filter(F.col("tag") == MATCH))
            if not left:
                break
            states = done.filter(F.col("tag") == STATE).select("part", "state")
            ready = rest.join(states.select(F.col("part").alias("behind")), "behind", "left_semi").select("part", "whole", "behind")
            rest = scratch.written(rest.join(states.select(F.col("part").alias("behind")), "behind", "left_anti"), "rest")
            left = rest.count()
        return scratch.result(_numbered(matched), "matches")


def _numbered(matched: DataFrame) -> DataFrame:
    """match_no over keys whose matches lie in many chunks: the number within (key, chunk), and the matches in chunks before."""
    counts = matched.groupBy("key", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("key", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("seq")))
    own = matched.withColumn("within", within).join(offsets, ["key", "part"])
    return own.select("key", (F.col("within") + F.col("before")).alias("match_no"), F.col("row").alias("first_row"), "last_row", "n_rows", "n_down", "n_up", F.col("total").cast("long").alias("total"))
