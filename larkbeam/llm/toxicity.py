"""Severity of abuse by cumulative-link ordinal regression over sparse text features.

Grades are ordered, and one weight vector serves all thresholds between them:
the chance of a grade k or worse is the logistic of the text's sum of weights
less the k-th threshold. What is given out is the expected grade.

Labels only say whether a text is toxic. So grades of toxic texts are made from
the labelled texts: by how many different features that mark toxic texts occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkbeam.llm.batches import filter_batches, held_out, map_batches, slices_of
from larkbeam.llm.spans import mixed, span_hashes, spans
from larkbeam.operators.reduce import bloom, maybe_in
from larkbeam.sources.files import rewritten

#: Bits of a feature's number.
BITS = 22

#: Lengths in bytes of the beginnings of words that are features beside the words.
STARTS = (4, 5)

#: Features that get a weight: those which tell toxic from other texts best.
FEATURES = 256

#: At most so many labelled rows are learned from, chosen by a hash of their ids.
TRAINING_ROWS = 20_000

#: Grades of toxic texts begin at so many different marks.
GRADES = (0, 3, 6)

_PLAIN = bytes.maketrans(bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~", b" " * 32)


def features(text: str | None) -> np.ndarray:
    """Numbers of the different words and beginnings of words of the whole text."""
    data = np.frombuffer((text or "").encode().lower().translate(_PLAIN), np.uint8)
    starts, ends = spans(data)
    found = [span_hashes(data, starts, ends)]
    for n in STARTS:
        long = ends - starts > n
        begins = starts[long]
        found.append(mixed(span_hashes(data, begins, begins + n) + np.uint64(n)))
    return np.unique(np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Ordinal:
    """Weights by feature number, and rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, found: np.ndarray) -> np.ndarray:
        """The chance of each grade from 1 on, or a worse one."""
        total = float(self.weights[found].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - total, -60, 60)))


def fit(rows: Sequence[np.ndarray], grades: np.ndarray, size: int, steps: int = 300, decay: float = 1e-5) -> Ordinal:
    """Maximum likelihood with a penalty on the weights, by full gradient steps with momentum.

    ``rows`` hold numbers below ``size``. The thresholds are a first one and the
    logarithms of the gaps above it, so they stay in order.
    """
    levels = len(GRADES)
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cuts = np.zeros(levels)
    w = np.zeros(size)
    mean, square = np.zeros(size + levels), np.zeros(size + levels)

    def thresholds() -> np.ndarray:
        return cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))])

    for step in range(1, steps + 1 if len(rows) else 1):
        total = np.bincount(owner, w[flat], len(rows))
        edges = np.concatenate([[-np.inf], thresholds(), [np.inf]])
        upper = 1 / (1 + np.exp(np.clip(total - edges[grades + 1], -60, 60)))
        lower = 1 / (1 + np.exp(np.clip(total - edges[grades], -60, 60)))
        chance = np.maximum(upper - lower, 1e-12)
        rise, fall = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        pull = (rise - fall) / len(rows)  # derivative of the loss by a row's total
        by_cut = np.bincount(grades, -rise, levels + 1)[:levels] + np.bincount(grades, fall, levels + 1)[1:]
        by_cut /= len(rows)
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([np.bincount(flat, pull[owner], size) + decay * w, [tail[0]], tail[1:] * np.exp(cuts[1:])])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, cuts = w - move[:size], cuts - move[size:]
    return Ordinal(w, thresholds())


def _counted(labelled: DataFrame) -> DataFrame:
    """In how many toxic and other texts each feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in slices_of(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label, features(text)] += 1
        found = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()) for x in (found, seen[1, found], seen[0, found])],
            names=["feature", "toxic", "other"],
        )

    parts = labelled.select("text", "label").mapInArrow(count, "feature int, toxic int, other int")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """Learn from the rows of ``docs`` that have a label and are not held out.

    Features are chosen by counts over all of them: those with the largest
    chi-squared that are more frequent in toxic texts. Weights are fitted on at
    most ``TRAINING_ROWS`` rows and ``FEATURES`` features, which bounds what
    reaches the driver. Without labels of both kinds nothing is toxic.
    """
    known = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    # labels grow with the corpus, so they are never broadcast; a filter of bounded size leaves out most other texts
    read = maybe_in(docs.select("doc_id", "text"), "doc_id", bloom(known, "doc_id"))
    labelled = read.join(known.hint("merge"), "doc_id")
    labelled = rewritten(labelled, name="labelled")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Ordinal(np.zeros(1 << BITS, np.float32), np.full(len(GRADES), 60.0))
    n = toxic + other
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    cross = a * (other - b) - b * (toxic - a)
    chi = n * cross * cross / (toxic * float(other) * (a + b) * (n - a - b + 1))
    more = F.col("toxic") * F.lit(other) > 2 * F.col("other") * F.lit(toxic)
    best = _counted(labelled).where(more).select("feature", "toxic", "other", chi.alias("chi"))
    chosen = best.orderBy(F.desc("chi"), "feature").limit(FEATURES).toPandas()
    numbers = np.sort(chosen["feature"].to_numpy())
    marks = chosen.loc[(chosen["toxic"] >= 2) & (chosen["other"] * 20 * toxic <= chosen["toxic"] * other), "feature"].to_numpy()

    def work() -> Callable[[list], list[tuple]]:
        return lambda texts: [(np.flatnonzero(np.isin(numbers, features(t))),) for t in texts]

    # the last hash of the sample is found without the texts, so that none is shuffled again
    hashed = labelled.withColumn("_hash", F.xxhash64("doc_id"))
    last = hashed.select("_hash").orderBy("_hash").limit(TRAINING_ROWS).agg(F.max("_hash")).first()[0]
    found = map_batches(
        hashed.where(F.col("_hash") <= last), ["_hash", "doc_id", "label"], "text", work, "found array<int>"
    )
    sample = found.orderBy("_hash", "doc_id", "label", "found").limit(TRAINING_ROWS).toPandas()
    rows = [np.asarray(r, np.int64) for r in sample["found"]]
    is_mark = np.isin(numbers, marks)
    grade = np.searchsorted(GRADES, [is_mark[r].sum() for r in rows], "right")
    model = fit(rows, np.where(sample["label"].to_numpy() == 1, grade, 0), len(numbers))
    weights = np.zeros(1 << BITS, np.float32)
    weights[numbers] = model.weights
    return Ordinal(weights, model.thresholds)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``severity`` (the expected grade), ``toxic_chance`` and ``predicted``.

    ``predicted`` is 1 where a grade over 0 is likelier than not. Null and empty
    texts have no features; equal texts have equal values. Labels other than 0
    and 1 are ignored, and a document with both counts for both. Other columns
    are ignored. An empty table gives an empty one.
    """
    model = train(docs, labels)

    def work() -> Callable[[list], list[tuple]]:
        def score(texts: list) -> list[tuple]:
            chances = [model.at_least(features(t)) for t in texts]
            return [(float(c.sum()), float(c[0]), int(c[0] >= 0.5)) for c in chances]

        return score

    scored = map_batches(
        docs, ["doc_id"], "text", work, "severity double, toxic_chance double, predicted int"
    )
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "severity", "toxic_chance", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are likelier grade 0 than not, with all their columns."""
    model = train(docs, labels)

    def work() -> Callable[[list], Sequence[bool]]:
        return lambda texts: [bool(model.at_least(features(t))[0] < 0.5) for t in texts]

    return filter_batches(docs, "text", work)
