"""Patterns over ordered rows, matched by an automaton.

A pattern is a row of steps that must follow one another, with any other rows in between. How far an
attempt has come is the state of an automaton, and each row moves every state on. What
a stretch of rows does to all states is a small table, and two tables after one another
make one: so a group too large for a task is cut into stretches, whose tables are worked out
side by side, put together in order, and then every stretch is read again from the
state in which it really begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkbeam.operators.skew import HotGroups, apart, hot_groups, ordering, segmented

#: Steps of the attempt that is open, as marks, and the number of attempts before it.
State = tuple[list, int]


class Automaton:
    """What rows do to an attempt of ``steps`` steps.

    Bit i of a row's mask says that it may be step i, the bit above all steps that it ends an attempt.
    """

    def __init__(self, steps: int):
        self.steps, self.reset = steps, 1 << steps

    def read(self, marks: list, done: int, mask: int, mark: Any, ended: list) -> State:
        """The state after a row. Attempts that the row ends are added to ``ended``."""
        if mask & self.reset and marks:
            ended.append((done + 1, marks))
            marks, done = [], done + 1
        if mask >> len(marks) & 1 and len(marks) < self.steps:
            marks = [*marks, mark]
            if len(marks) == self.steps:
                ended.append((done + 1, marks))
                marks, done = [], done + 1
        return marks, done


class Table:
    """What a stretch of rows does to an attempt that has come to any step.

    ``rows[i]`` is for i steps before it: the marks after it, whether the first of them are
    those from before, and how many attempts ended.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.rows: list[tuple[list, bool, int]] = [([], True, 0) for _ in range(automaton.steps)]

    def read(self, mask: int, mark: Any) -> None:
        for i, (marks, kept, done) in enumerate(self.rows):
            ended: list = []
            before = [None] * i if kept else []
            after, ends = self.automaton.read([*before, *marks], 0, mask, mark, ended)
            kept = kept and not ended
            self.rows[i] = after[i:] if kept else after, kept, done + ends

    @staticmethod
    def follow(rows: list[tuple[list, bool, int]], state: State) -> State:
        """The state after a stretch that begins in ``state``."""
        marks, done = state
        new, kept, ended = rows[len(marks)]
        return [*marks, *new] if kept else new, done + ended


def attempts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, Column],
    mark: str,
    reset: Column | None = None,
    rows_per_group: int | None = None,
) -> DataFrame:
    """Every attempt in a group to go through ``steps``, which are conditions in the order in which they must be met.

    One row an attempt: ``keys``, ``nth`` from 1, ``complete``, and for each step the value of ``mark`` at
    the row that met it, null if none did. In the order of the group, an attempt begins with the first row
    that meets the first step, takes for each further step the first later row that
    meets it, and is over with the last one, with a row that meets ``reset``, or
    with the group. The next begins after it; a row that meets ``reset`` may begin it. A row is one step at
    most, and conditions that are null are not met. Null keys are a group like others, and groups without an attempt
    have no rows. ``order`` should tell the rows of a group apart, else equal ones are taken in any order; descending columns have a leading minus.
    Groups over ``rows_per_group`` are cut along ``order``, which then must be numbers, dates or times.
    """
    mask = F.lit(0).cast("long")
    for i, met in enumerate([*steps.values(), *([] if reset is None else [reset])]):
        mask = mask.bitwiseOR(F.when(met, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    columns = [o.lstrip("-") for o in order]
    names = {c: f"_by{i}" for i, c in enumerate(columns)}
    read = df.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(c).alias(n) for c, n in names.items()],
        F.col(mark).alias("_mark"), mask.alias("_mask"),
    ).where("_mask != 0")  # other rows change nothing
    inner = [f"_key{i}" for i in range(len(keys))]
    by = [o.replace(o.lstrip("-"), names[o.lstrip("-")]) for o in order]
    hot = hot_groups(read, inner, rows_per_group)
    if hot is None:
        found = _ended(read, inner, by, len(steps))
    else:
        cold, rows, hot = apart(read, inner, hot)
        found = _in_pieces(rows, inner, by, len(steps), hot)
        if cold is not None:
            found = _ended(cold, inner, by, len(steps)).union(found)
    return found.select(
        *[F.col(i).alias(k) for i, k in zip(inner, keys)], "nth", (F.size("marks") == len(steps)).alias("complete"),
        *[F.get("marks", F.lit(i)).alias(name) for i, name in enumerate(steps)],
    )


def _grouped(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _written(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _ended(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: int) -> DataFrame:
    """All attempts. Rows may have ``_state``, with which their group begins; it is on a row of its own.

    ``_last`` of that row says that the group ends there; else an open attempt goes on elsewhere.
    """
    marks = T.ArrayType(df.schema["_mark"].dataType)
    schema = T.StructType([*_key_fields(df, keys), T.StructField("nth", T.LongType()), T.StructField("marks", marks)])
    arrow = to_arrow_schema(schema)
    n, begins = len(keys), "_state" in df.columns

    def attempts_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton, group, state, last = Automaton(steps), None, ([], 0), True
        for row in rows:
            if row[: n + begins] != group:
                if group is not None and last and state[0]:
                    yield *group[:n], state[1] + 1, state[0]
                group, state, last = row[: n + begins], ([], 0), True
            if begins and row[-1] is not None:
                state, last = (row[-1]["marks"], row[-1]["done"]), row[-1]["last"]
                continue
            ended: list = []
            state = automaton.read(*state, row[n + begins + 1], row[n + begins], ended)
            for nth, own in ended:
                yield *group[:n], nth, own
        if group is not None and last and state[0]:
            yield *group[:n], state[1] + 1, state[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(attempts_of(_rows(batches)), arrow)

    if begins:
        rows = _grouped(df, [*keys, "_seg"], F.col("_state").isNull(), *ordering(order))
        return rows.select(*keys, "_seg", "_mark", "_mask", "_state").mapInArrow(run, schema)
    return _grouped(df, keys, *ordering(order)).select(*keys, "_mark", "_mask").mapInArrow(run, schema)


def _in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: int, hot: HotGroups) -> DataFrame:
    cut = segmented(df, order, hot)
    n = len(keys)
    fields = _key_fields(df, keys)
    mark = T.ArrayType(df.schema["_mark"].dataType)
    one = T.StructType([T.StructField("marks", mark), T.StructField("kept", T.BooleanType()), T.StructField("done", T.LongType())])
    tables = T.StructType([*fields, T.StructField("_seg", cut.schema["_seg"].dataType), T.StructField("_table", T.ArrayType(one))])
    state = T.StructType(
        [T.StructField("marks", mark), T.StructField("done", T.LongType()), T.StructField("last", T.BooleanType())]
    )
    states = T.StructType([*tables.fields[:-1], T.StructField("_state", state)])
    to_tables, to_states = to_arrow_schema(tables), to_arrow_schema(states)

    def tables_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        group, table = None, None
        for row in rows:
            if row[: n + 1] != group:
                if table:
                    yield *group, [dict(zip(("marks", "kept", "done"), r)) for r in table.rows]
                group, table = row[: n + 1], Table(Automaton(steps))
            table.read(row[-1], row[-2])
        if table:
            yield *group, [dict(zip(("marks", "kept", "done"), r)) for r in table.rows]

    def states_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: tuple | None = None  # a piece is given out once it is known whether another follows
        group, now = None, ([], 0)
        for row in rows:
            if held:
                yield *held[:-1], {**held[-1], "last": row[:n] != group}
            if row[:n] != group:
                group, now = row[:n], ([], 0)
            held = (*row[: n + 1], {"marks": now[0], "done": now[1]})
            now = Table.follow([(r["marks"], r["kept"], r["done"]) for r in row[-1]], now)
        if held:
            yield *held[:-1], {**held[-1], "last": True}

    pieces = _grouped(cut, [*keys, "_seg"], *ordering(order)).select(*keys, "_seg", "_mark", "_mask")
    made = pieces.mapInArrow(lambda batches: _written(tables_of(_rows(batches)), to_tables), tables)
    # a few rows for each group: one a piece
    begun = _grouped(made, keys, F.col("_seg")).mapInArrow(lambda batches: _written(states_of(_rows(batches)), to_states), states)
    both = cut.unionByName(begun, allowMissingColumns=True)
    return _ended(both, keys, order, steps)
