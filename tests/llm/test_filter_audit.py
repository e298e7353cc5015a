"""Diagrams against filters applied one after another."""

import itertools
import random
import re
from collections import Counter

import pytest

from check import connect, difference
from larkbeam.llm import filter_audit, queries

LETTERS = "ABCDE"


def test_swaps_reach_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        for level in [*filter_audit.swaps(n), None]:
            seen.add(tuple(order))
            if level is not None:
                order[level], order[level + 1] = order[level + 1], order[level]
        assert seen == set(itertools.permutations(range(n)))
        assert len(filter_audit.swaps(n)) == len(seen) - 1


def test_diagram_keeps_counts_through_swaps():
    rnd = random.Random(1)
    for _ in range(20):
        counts = {rnd.randrange(32): (rnd.randint(1, 9), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 12))}
        for order, steps in filter_audit.walked(filter_audit.Diagram(5, counts, 2)):
            left = dict(counts)
            for (one, removed, kept), want in zip(steps, order, strict=True):
                assert one == want
                gone = [w for m, w in left.items() if m >> one & 1]
                left = {m: w for m, w in left.items() if not m >> one & 1}
                assert removed == tuple(sum(w[i] for w in gone) for i in (0, 1))
                assert kept == tuple(sum(w[i] for w in left.values()) for i in (0, 1))


def test_equal_parts_are_shared():
    alike = {m: (1,) for m in range(32)}
    assert len(filter_audit.Diagram(5, alike).nodes) == 6


def plain(rows, labels):
    """The contract, word for word."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations(LETTERS):
            left, seen = [d for d in docs if d[0] == part], set()
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(d[0] == part and f in d[1] and bool(d[1] & seen) for d in docs)
                only = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, only, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
                seen.add(f)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.failure_counts(docs.repartition(3), marks), LETTERS, ["good", "toxic"])
    rows = found.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_filters_one_by_one(spark):
    rnd = random.Random(3)
    words = ["a", "b", "c", "Dd", "EEE", "漢", "é#", "f|"]
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "ABC", long, long + " #", long.upper(), "a " * 70, "\x1c" + long, "x" * 200_000]
    texts += [" ".join(rnd.choices([*words, *map(str, range(60))], k=rnd.randint(0, 120))) for _ in range(40)]
    rows = [(i, rnd.choice(texts), rnd.choice(["s", "s", "t", "", None])) for i in range(150)]
    rows += [(7, "twice", "s"), (7, "twice", "t"), (None, "twice", "s"), (None, None, None), (8, "twice", "s")]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 150, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, "a", None)], [])) == 600


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit"])
def test_query_equals_oracle(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert difference(got, connect(small).execute(queries.ORACLES[name]).df()) is None
