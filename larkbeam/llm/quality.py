"""Document quality by a quadratic discriminant with shrunken class covariances.

Statistics of a text are transformed so that they are roughly normal. Each class
has a mean and a covariance, drawn towards the pooled one and a multiple of
the unit matrix. A score is the logistic of the difference of log densities; the
inverses of the Cholesky factors are worked out once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkbeam.llm.batches import filter_batches, held_out, map_batches
from larkbeam.llm.spans import span_hashes, spans
from larkbeam.operators.reduce import bloom, maybe_in
from larkbeam.sources.files import rewritten

_BYTES = {
    "upper": range(0x41, 0x5B), "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B)],
    "digit": range(0x30, 0x3A), "stop": b".?!", "comma": b",;:", "mark": b"!?", "other": b"#$%&*+/<=>@[\\]^_`{|}~",
    "wide": range(0x80, 0x100), "line": b"\n",
}
_IS = {name: np.isin(np.arange(256), list(values)) for name, values in _BYTES.items()}

#: A share is drawn to that of usual text as if so many more words or bytes had been seen.
PRIOR = 20

STATISTICS = 13


def _share(n: float, of: float, usual: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, (n + PRIOR * usual) / (of + PRIOR)))))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of the whole text; null counts as empty."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    n = {name: int(counts[is_].sum()) for name, is_ in _IS.items()}
    starts, ends = spans(data)
    words, lengths = len(starts), ends - starts
    hashes = span_hashes(data, starts, ends)
    _, times = np.unique(hashes, return_counts=True)
    kinds, most = len(times), int(times.max(initial=0))
    # whether a word was seen among the last few
    near = sum(int((hashes[k:] == hashes[:-k]).sum()) for k in (1, 2)) if words > 2 else 0
    lines = [line for line in raw.split(b"\n") if line.strip()]
    size = len(raw)
    return [
        np.log1p(words),
        np.log((lengths.sum() + PRIOR * 4.5) / (words + PRIOR)),
        np.log((float(((lengths - 4.5) ** 2).sum()) + PRIOR * 6) / (words + PRIOR)),
        np.log((kinds + PRIOR) / (words**0.8 + PRIOR)),
        _share(most, words, 0.05),
        _share(near, 2 * words, 0.01),
        _share(len(lines) - len(set(lines)), len(lines), 0.01),
        _share(n["upper"], n["letter"], 0.03),
        _share(n["digit"], size, 0.005),
        _share(n["other"], size, 0.001),
        _share(n["mark"], size, 0.001),
        _share(n["stop"], words, 0.1),
        _share(n["comma"], words, 0.06),
    ]


@dataclass
class Discriminant:
    """Means, inverses of Cholesky factors and log densities at the mean, worst class first."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        density = self.offsets[:, None] - 0.5 * np.array(far)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(sums: Sequence[tuple[int, np.ndarray, np.ndarray]], pooled: float, unit: float) -> Discriminant:
    """From count, sum and sum of outer products of each of the two classes.

    ``pooled`` and ``unit`` are the shares of the pooled covariance and of the
    variances alone. A class without rows takes the other's place, so that all
    scores are the prior; with no rows at all, they are one half.
    """
    size = STATISTICS
    total = sum(n for n, _, _ in sums)
    if not total:
        return Discriminant(np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2))
    whole = sum(s for _, s, _ in sums) / total
    scatter = [q - np.outer(s, s) / n if n else np.zeros((size, size)) for n, s, q in sums]
    within = sum(scatter) / total + 1e-6 * np.eye(size)
    means, factors, offsets = [], [], []
    for (n, s, _), own in zip(sums, scatter):
        one_class = min(m for m, _, _ in sums) == 0
        means.append(whole if one_class else s / n)
        cov = within if one_class else (1 - pooled) * own / n + pooled * within
        cov = (1 - unit) * cov + unit * np.diag(np.diag(within))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log((n + 1) / (total + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def train(stats: DataFrame, labels: DataFrame, pooled: float = 0.1, unit: float = 0.1) -> Discriminant:
    """Learn from ``doc_id, x`` and the labels ``doc_id, label`` of 0 and 1, all rows that match.

    What reaches the driver is one matrix for each class.
    """
    size = STATISTICS * (STATISTICS + 1) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for label in (0, 1):
                own = x[y == label]
                sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(sums.ravel())],
            names=["label", "at", "value"],
        )

    known = labels.where("label IN (0, 1)").distinct()
    rows = stats.join(known, "doc_id").select("x", F.col("label").cast("int").alias("label"))
    parts = rows.mapInArrow(add, "label int, at int, value double")
    sums = np.zeros((2, size))
    for row in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        sums[row["label"], row["at"]] = row["value"]
    d = STATISTICS
    return fit([(int(s[0]), s[1 : d + 1], s[d + 1 :].reshape(d, d)) for s in sums], pooled, unit)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the transformed statistics, of every row."""

    def work() -> Callable[[list], list[tuple]]:
        return lambda texts: [(statistics(t),) for t in texts]

    return map_batches(docs, ["doc_id"], "text", work, "x array<double>")


def _known(labels: DataFrame, column: str) -> DataFrame:
    return labels.where(~held_out("doc_id")).select("doc_id", F.col(column).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` from 0 to 1 and ``predicted`` for every row of ``docs``.

    ``labels`` holds ``doc_id`` and ``quality``; other values than 0 and 1 are
    ignored, and so are labels of documents held out. A document with several
    different labels counts for each. Null and empty texts have statistics and a
    score like others; equal texts have equal ones. Other columns are ignored.
    Without labels of both classes all scores are the same.
    """
    stats = rewritten(document_statistics(docs), name="statistics")
    model = train(stats, _known(labels, "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores)], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns."""
    known = _known(labels, "quality")
    # statistics are worked out before the shuffle, of labelled texts and few others; they are written, as a task that
    # goes on to sum them up would hold two Python workers, which then stay beside all later stages
    stats = document_statistics(maybe_in(docs, "doc_id", bloom(known, "doc_id")))
    model = train(rewritten(stats, name="statistics"), known)

    def work() -> Callable[[list], Sequence[bool]]:
        def good(texts: list) -> np.ndarray:
            x = np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)
            return model.scores(x) >= 0.5

        return good

    return filter_batches(docs, "text", work)
