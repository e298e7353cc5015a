"""Packing documents into sequences by minimum bin slack.

For each sequence, the fullest combination of the lengths still there is found
by subset sums over bits and then removed. How many pieces have each length is
all this needs, at most as many numbers as a sequence has tokens, so it is done
on the driver at any size of the corpus; a combination is removed as often as
the counts allow, which keeps the number of steps in the order of the number
of lengths. Pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkbeam.llm.batches import _parse, slices_of, small_batches
from larkbeam.llm.bpe import encoder
from larkbeam.sources.files import rewritten

PIECE = "piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that ``room`` is filled as far as it can be.

    Bit n of ``sums`` says that some combination has length n. Long pieces are
    tried first, which keeps short ones for the gaps that come later.
    """
    sums, taken, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left and not sums & full:
            times = min(times, left)
            taken.append((length, times, sums))
            sums |= (sums << (length * times)) & mask
            left -= times
            times *= 2
        if sums & full:
            break
    best, combination = sums.bit_length() - 1, Counter()
    for length, times, before in reversed(taken):
        if not before >> best & 1:
            combination[length] += times
            best -= length * times
    return combination


def combinations(counts: dict[int, int], size: int) -> Iterator[tuple[dict[int, int], int]]:
    """Combinations for sequences of ``size``, and for how many sequences each.

    The longest piece left is always in, so each sequence has one and the rest
    is filled around it.
    """
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        use = Counter({longest: 1}) + Counter(fullest(left, size - longest))
        left[longest] += 1
        times = min(left[length] // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        yield use, times


def places(counts: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """By length: rows of first rank, sequences, first sequence, offset; ranks rising."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for use, times in combinations(counts, size):
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            out.setdefault(length, []).append((used[length], times, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pieces(df: DataFrame, keep: list[str], text: str, path: str, size: int) -> DataFrame:
    """The pieces of every text's ids with an id 0 after them, and where each came from.

    ``_part`` and ``_rank`` number the pieces of a length within a task. They
    hold only for one run of the task, so write the result before use.
    """
    schema = StructType(
        [*df.select(*keep).schema.fields, *_parse(f"{PIECE}, _part int, _rank long").fields]
    )
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()
        part = TaskContext.get().partitionId()
        for batch in slices_of(batches):
            source, rows = [], []
            for i, own in enumerate(enc.encode_all([t or "" for t in batch.column(n).to_pylist()])):
                ids = memoryview(own.astype("<u4").tobytes() + b"\0\0\0\0")
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    length = len(cut) // 4
                    source.append(i)
                    rows.append((piece, at // 4, length, zlib.crc32(cut), part, seen[length]))
                    seen[length] += 1
            kept = [batch.column(k).take(pa.array(source, pa.int64())) for k in range(n)]
            made = zip(*rows) if rows else [[]] * 6
            new = [pa.array(list(v), f.type) for v, f in zip(made, list(arrow)[n:])]
            yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return small_batches(df).select(*keep, F.col(text).alias("_value")).mapInArrow(run, schema)


def pack(df: DataFrame, keep: list[str], text: str, path: str, size: int = 2048) -> DataFrame:
    """Every piece of every text with ``sequence_id`` and ``offset``, beside ``keep``.

    No sequence is longer than ``size`` tokens or has a gap. Texts of more ids
    are cut into pieces of ``size``; the last may be shorter. Null and empty
    texts are a piece of the one id 0. Equal rows are packed as often as they
    occur, rows with null keys like others. Columns other than ``keep`` are
    ignored. An empty table gives an empty one.
    """
    made = rewritten(pieces(df, keep, text, path, size), name="pieces")
    sizes = made.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    sizes = rewritten(sizes, name="piece-counts")
    # at most one row for each length up to size
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = places(counts, size)
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = made.join(before, ["length", "_part"]).select(
        *keep, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank")
    )
    schema = StructType([*ranked.schema.fields[:-1], *_parse("sequence_id long, offset long").fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(n + 2).to_numpy(), batch.column(n + 4).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                rows = table[int(length)]
                first, times, base, at = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1].T
                copy, nth = np.divmod(ranks[own] - first, times)
                sequence[own], offset[own] = base + nth, at + copy * length
            arrays = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return ranked.mapInArrow(run, schema)
