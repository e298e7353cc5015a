"""Attempts against a plain loop, in one piece and in many."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkbeam.operators.patterns import Automaton, Table, attempts

def steps():
    return {"seen": F.col("kind") == "a", "tried": F.col("kind").isin("b", "ab"), "bought": F.col("kind") == "c"}


def plain(rows):
    """Rows of key, order, kind and mark, as the docstring says."""
    met = {"a": [0], "b": [1], "ab": [1], "c": [2]}
    out = []
    for key in {r[0] for r in rows}:
        marks, nth = [], 0
        for _, _, kind, mark in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if kind == "x" and marks:
                nth += 1
                out.append((key, nth, False, *marks, *[None] * (3 - len(marks))))
                marks = []
            elif len(marks) in met.get(kind, []):
                marks.append(mark)
                if len(marks) == 3:
                    nth += 1
                    out.append((key, nth, True, *marks))
                    marks = []
        if marks:
            out.append((key, nth + 1, False, *marks, *[None] * (3 - len(marks))))
    return sorted(out, key=repr)


def check(spark, rows, limit, order="at"):
    df = spark.createDataFrame(rows, "k int, at int, kind string, mark string").repartition(3)
    got = attempts(df, ["k"], [order], steps(), "mark", F.col("kind") == "x", limit)
    want = plain([(k, -at if order[0] == "-" else at, kind, mark) for k, at, kind, mark in rows])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    return want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, None]), st.sampled_from(["a", "b", "ab", "c", "x", "y", None])), max_size=60),
    limit=st.sampled_from([None, 1, 4, 9]),
    order=st.sampled_from(["at", "-at"]),
)
def test_any_rows(spark, rows, limit, order):
    check(spark, [(k, i, kind, f"m{i}") for i, (k, kind) in enumerate(rows)], limit, order)


def test_hot_group_over_many_pieces(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 else rnd.randrange(40), i, rnd.choice("aabbcxyyyyyyyyy"), f"m{i}") for i in range(6000)]
    # an attempt that is open over many pieces
    rows += [(0, 10_000 + i, "a" if i == 0 else "y" if i < 2000 else "b", f"n{i}") for i in range(2001)]
    want = check(spark, rows, 200)
    assert sum(r[2] for r in want) > 50


def test_tables_put_together_are_those_of_the_whole():
    rnd = random.Random(2)
    for steps in (1, 2, 4):
        automaton = Automaton(steps)
        for _ in range(200):
            rows = [(rnd.randrange(1 << (steps + 1)), i) for i in range(rnd.randint(0, 20))]
            state = ([], 0)
            for row in rows:
                state = automaton.read(*state, *row, [])
            cut, joined = sorted(rnd.choices(range(len(rows) + 1), k=2)), ([], 0)
            for part in (rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]):
                table = Table(automaton)
                for row in part:
                    table.read(*row)
                joined = Table.follow(table.rows, joined)
            assert joined == state


@pytest.mark.parametrize("limit", [None, 1])
def test_no_keys_null_marks_and_empty(spark, limit):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", None), (4, "a", 7)], "at int, kind string, mark int")
    got = attempts(df, [], ["at"], steps(), "mark", None, limit).orderBy("nth").collect()
    assert [tuple(r) for r in got] == [(1, True, None, 5, None), (2, False, 7, None, None)]
    assert attempts(df.limit(0), [], ["at"], steps(), "mark", None, limit).count() == 0
