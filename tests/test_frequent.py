"""Frequent values against counts of all values."""

import random
from collections import Counter

import pytest

from larkbeam.operators import frequent as module
from larkbeam.operators.frequent import Summary, frequent


def plain(rows, a, b):
    sizes, counts = Counter(k for k, _ in rows), Counter(rows)
    return sorted(((k, v, n, sizes[k]) for (k, v), n in counts.items() if n * b > sizes[k] * a), key=repr)


def test_summary_bounds_hold_when_added():
    rnd = random.Random(1)
    for size in (1, 3, 20):
        total, summaries = Counter(), []
        for _ in range(5):
            own = Summary(size)
            for _ in range(rnd.randint(0, 30)):
                counts = Counter(int(rnd.paretovariate(1)) for _ in range(rnd.randint(1, 40)))
                own.add(counts)
                total += counts
            summaries.append(own)
            assert len(own.counters) <= size and own.lost * (size + 1) <= own.rows
        rows, lost = sum(s.rows for s in summaries), sum(s.lost for s in summaries)
        assert rows == sum(total.values()) and lost * (size + 1) <= rows
        for value, n in total.items():
            found = sum(s.counters.get(value, 0) for s in summaries)
            assert found <= n <= found + lost


@pytest.mark.parametrize("over", [(1, 50), (1, 4), (2, 3)])
def test_frequent_values(spark, monkeypatch, over):
    monkeypatch.setattr(module, "HELD", 300)
    rnd = random.Random(2)
    kinds = ["a", "a", "a", "b", None]
    rows = [(rnd.choice(kinds), rnd.choice(["x", f"v{int(rnd.paretovariate(0.5))}", None])) for _ in range(8000)]
    rows += [("one", "only"), ("half", "p"), ("half", "q")]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "k string, v string, n int, n_rows int").repartition(5)
    got = sorted((tuple(r) for r in frequent(df, ["k"], "v", over).collect()), key=repr)
    assert got == plain(rows, *over)
    whole = sorted((tuple(r) for r in frequent(df, [], "v", over).collect()), key=repr)
    assert whole == sorted((r[1:] for r in plain([(0, v) for _, v in rows], *over)), key=repr)
    assert frequent(df.limit(0), ["k"], "v", over).count() == 0
