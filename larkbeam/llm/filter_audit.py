"""How filters overlap and what their order changes, from one diagram per part.

What a set of filters does to a part of a corpus depends only on how many rows
fail which of them: one count for each mask of failures. A decision diagram
holds these counts, with one filter on each level and equal parts shared. In any
order of the levels, the path on which everything passes shows what each step
removes and keeps. Neighbouring levels are swapped from one order to the next,
which changes only the nodes of the upper of the two.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Weight = tuple[int, ...]

_SPACES = "[\\x20\\x09-\\x0D]+"


class Diagram:
    """Counts of rows by which of ``filters`` fail, as a decision diagram.

    ``counts`` maps masks, bit i set if filter i fails, to tallies; a mask
    left out counts nothing. A node is a pair of numbers of nodes one level lower, the
    first if the filter of the level passes and the second if it fails. Nodes with
    equal pairs are one. ``weights`` has what lies below a node.
    """

    def __init__(self, filters: int, counts: dict[int, Weight], tallies: int = 1):
        self.order = list(range(filters))
        self.none = (0,) * tallies
        self.nodes: list[tuple[int, int] | None] = []
        self.weights: list[Weight] = []
        self._known: dict[tuple, int] = {}
        self.root = self._build(0, counts)

    def _node(self, level: int, pair: tuple[int, int]) -> int:
        key = (level, *pair)
        if key not in self._known:
            self._known[key] = len(self.nodes)
            self.nodes.append(pair)
            self.weights.append(tuple(map(sum, zip(*(self.weights[i] for i in pair)))))
        return self._known[key]

    def _leaf(self, weight: Weight) -> int:
        key = ("leaf", weight)
        if key not in self._known:
            self._known[key] = len(self.nodes)
            self.nodes.append(None)
            self.weights.append(weight)
        return self._known[key]

    def _build(self, level: int, counts: dict[int, Weight]) -> int:
        if level == len(self.order):
            return self._leaf(next(iter(counts.values()), self.none))
        sides: tuple[dict, dict] = ({}, {})
        for mask, weight in counts.items():
            sides[mask >> level & 1][mask] = weight
        return self._node(level, tuple(self._build(level + 1, side) for side in sides))

    def _at(self, level: int) -> set[int]:
        found = {self.root}
        for _ in range(level):
            found = {child for i in found for child in self.nodes[i]}
        return found

    def swap(self, level: int) -> None:
        """Exchange a level and the next one below.

        Nodes of the level keep their number and what they stand for, so that
        nothing above them changes.
        """
        upper = self._at(level)
        for key in [k for k in self._known if k[0] in (level, level + 1)]:
            del self._known[key]
        for i in upper:
            (pp, pf), (fp, ff) = (self.nodes[child] for child in self.nodes[i])
            self.nodes[i] = self._node(level + 1, (pp, fp)), self._node(level + 1, (pf, ff))
            self._known[level, *self.nodes[i]] = i
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """Filter, what it removes and what it keeps, along the path on which all pass."""
        out, node = [], self.root
        for one in self.order:
            node, failed = self.nodes[node]
            out.append((one, self.weights[failed], self.weights[node]))
        return out


def swaps(n: int) -> list[int]:
    """Upper levels of the swaps that lead through all orders of ``n`` levels, each once.

    The last one moves through all places, down and up in turn, and between two
    runs the others go on to their next order.
    """
    if n < 2:
        return []
    out: list[int] = []
    for i, inner in enumerate([*swaps(n - 1), None]):
        down = i % 2 == 0
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            out.append(inner + down)
    return out


def walked(diagram: Diagram) -> Iterator[tuple[tuple[int, ...], list[tuple[int, Weight, Weight]]]]:
    """Every order of the filters, with its steps."""
    yield tuple(diagram.order), diagram.steps()
    for level in swaps(len(diagram.order)):
        diagram.swap(level)
        yield tuple(diagram.order), diagram.steps()


def audit(counts: DataFrame, letters: str, tallies: Sequence[str] = ()) -> DataFrame:
    """What each filter does at each step of each order, for every ``part``.

    ``counts`` has a row for each ``part`` and ``mask``, with ``n`` rows and further
    ``tallies`` of them; a mask that is there twice is added up. The result has ``part``, ``filter_order``, ``step`` from 1,
    ``kept``, ``removed``, ``redundant`` (fails this filter, but was removed before),
    ``unique_fails`` (fails this one only), ``<tally>_lost`` for each tally, and
    ``shapley``, what the filter removes summed over all orders. There is a row
    for every order and step, also where nothing is removed. No parts give no
    rows. A part has at most one row for each mask, so one is small whatever the table.
    """
    names = ["n", *tallies]
    lost = [f"{t}_lost" for t in tallies]
    numbers = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = ", ".join(["part string", "filter_order string", "step int", *[f"{c} long" for c in numbers]])

    def work(group: pa.Table) -> pa.Table:
        found = {row.pop("mask"): tuple(row[c] for c in names) for row in group.to_pylist()}
        orders = list(walked(Diagram(len(letters), found, len(names))))
        fails, only, total = {}, {}, [0] * len(letters)
        for order, steps in orders:
            fails[order[0]] = steps[0][1][0]  # nothing was removed before the first
            only[order[-1]] = steps[-1][1][0]  # and all others passed before the last
            for one, removed, _ in steps:
                total[one] += removed[0]
        part = group.column("part")[0].as_py()
        rows = [
            (
                part, "".join(letters[i] for i in order), step, kept[0], removed[0],
                fails[one] - removed[0], only[one], *removed[1:], total[one],
            )
            for order, steps in orders
            for step, (one, removed, kept) in enumerate(steps, 1)
        ]
        columns = ["part", "filter_order", "step", *numbers]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(numbers)]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=columns)

    merged = counts.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return merged.groupBy("part").applyInArrow(work, schema)


def text_failures(text: Column) -> list[Column]:
    """Whether a text has under 50 words, under 65 of 100 words different, over 5 of 100
    characters from A to Z, or one of ``#$%&*|``."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def failure_counts(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Rows of ``docs`` by ``part`` and ``mask`` of failed filters, with ``n``, ``good`` and ``toxic``.

    Bits 0 to 3 are those of ``text_failures``; bit 4 is set if a row with a smaller
    id anywhere in the table has the same text. Null texts and parts count as empty ones.
    A null id is not smaller than others and has no smaller ones; rows that
    share the smallest id of their text all pass. ``good`` counts rows with a label
    of quality 1, ``toxic`` those with toxic 1; of several labels of an id, one is
    enough. Columns beside the named ones are ignored. An empty table gives an empty one.

    Texts are compared by 128 bits of hashes. Rows are merged by text and part
    before anything is joined, so that copies of one text count once however many there are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mask = F.lit(0)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("text"))
    for i, failed in enumerate(text_failures(F.col("text"))):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = read.select(
        "doc_id", "part", mask.alias("mask"),
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"),
    )
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")]
    )
    # rows that repeat are counted before they are joined; adaptive execution splits what null ids are left
    both = rows.groupBy("doc_id", "part", "k1", "k2", "mask").agg(F.count("*").alias("n"))
    both = both.join(marks, "doc_id", "left").select(
        "doc_id", "part", "k1", "k2", "mask", "n",
        (F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    tallies = ["n", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    by_part = both.groupBy("part", "k1", "k2", "mask").agg(
        F.min(F.when(known, F.struct("doc_id", *tallies))).alias("first"),
        *[F.sum(t).alias(t) for t in tallies],
        *[F.sum(F.when(~known, F.col(t)).otherwise(0)).alias(f"unnamed_{t}") for t in tallies],
    )
    # a text has as many rows here as parts it is in
    heads = by_part.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.min("first.doc_id").alias("head"))
    met = by_part.join(heads, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    owns = F.col("first.doc_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull()
    passed = {t: F.when(owns, F.col(f"first.{t}")).otherwise(0) + F.col(f"unnamed_{t}") for t in tallies}
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), *[passed[t].cast("long").alias(t) for t in tallies]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(t) - passed[t]).cast("long").alias(t) for t in tallies]),
    )
    counted = met.select("part", F.explode(sides).alias("_side")).select("part", "_side.*").where("n > 0")
    return counted.groupBy("part", "mask").agg(*[F.sum(t).cast("long").alias(t) for t in tallies])
