"""Fill-in-middle rearrangement by rotating blocks of a text in place.

A text of parts prefix, middle, suffix gets a sentinel before each part, as bytes
of one buffer. Exchanging two neighbouring blocks is a rotation, done by three
reversals without a second copy of the text. A rotation by the same cut undoes
it, so the text comes back exactly from the output and its form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkbeam.llm.batches import _parse, slices_of, small_batches

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

#: Bytes that a reversal holds beside the buffer.
STEP = 1 << 16

#: Bytes of text that one batch to Spark may have, or one text if that is longer.
BATCH = 1 << 22


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 bytes begin: runs of A-Z and a-z, and every other character."""
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    after_letter = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    first = (data & 0xC0) != 0x80
    return np.flatnonzero(np.where(letter, ~after_letter, first))


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def reverse(data: np.ndarray, start: int, stop: int) -> None:
    """Reverse ``data[start:stop]`` in place, ends first."""
    while stop - start > 1:
        n = min(STEP, (stop - start) // 2)
        head = data[start : start + n].copy()
        data[start : start + n] = data[stop - n : stop][::-1]
        data[stop - n : stop] = head[::-1]
        start, stop = start + n, stop - n


def rotate(data: np.ndarray, start: int, cut: int, stop: int) -> None:
    """Exchange the blocks ``start:cut`` and ``cut:stop`` in place."""
    reverse(data, start, cut)
    reverse(data, cut, stop)
    reverse(data, start, stop)


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The parts before ``first``, up to ``second`` and after it, in the order of ``form``, with sentinels."""
    buffer = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(buffer, np.uint8)
    if form == "psm":
        rotate(view, middle, suffix, len(buffer))
    else:
        rotate(view, 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text that ``rearrange`` got, for texts without sentinels of their own."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    view = np.frombuffer(buffer, np.uint8)
    if form == "psm":
        start, cut = buffer.index(SUFFIX), buffer.index(MIDDLE)
    else:
        start, cut = 0, buffer.index(PREFIX)
    rotate(view, start, cut, len(buffer))
    del view  # a buffer that is looked at cannot shrink
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _row(text: str | None, draws: list[int], plain_from: int, spm_below: int) -> tuple:
    data = (text or "").encode()
    array = np.frombuffer(data, np.uint8)
    starts = unit_starts(array)
    n = len(starts)
    if not data or any(mark in data for mark in SENTINELS) or draws[2] % 100 >= plain_from:
        return data.decode(), n, "plain", None, None
    form = "spm" if draws[3] % 100 < spm_below else "psm"
    units = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    first, second = (int(starts[u]) if u < n else len(data) for u in units)
    made = rearrange(data, first, second, form).decode()
    return made, n, form, characters(array[:first]), characters(array[first:second])


def _by_rows(df: DataFrame, keep: list[str], inputs: list[Column], work: Callable[..., tuple], added: str) -> DataFrame:
    """Columns ``keep``, and those that ``work`` makes of the values of a row, in batches bounded by bytes."""
    schema = StructType([*df.select(*keep).schema.fields, *_parse(added).fields])
    arrow = to_arrow_schema(schema)
    n, fields = len(keep), list(arrow)[len(keep) :]

    def batch_of(source: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
        kept = [c.slice(start, len(rows)) for c in source.columns[:n]]
        columns = zip(*rows) if rows else [[]] * len(fields)
        made = [pa.array(list(v), f.type) for v, f in zip(columns, fields)]
        return pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 200):
            rows, start, size = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(work(*[c[i].as_py() for c in batch.columns[n:]]))
                size += len(rows[-1][0])
                if size >= BATCH:
                    yield batch_of(batch, start, rows)
                    rows, start, size = [], i + 1, 0
            yield batch_of(batch, start, rows)

    named = [c.alias(f"_value{i}") for i, c in enumerate(inputs)]
    return small_batches(df).select(*keep, *named).mapInArrow(run, schema)


def draws(key: Column, seed: int = 1) -> Column:
    """Four numbers of 32 bits from the hash of ``seed:key``; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def fill_in_middle(
    df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text",
    seed: int = 1, plain_from: int = 90, spm_below: int = 20,
) -> DataFrame:
    """``output``, ``n``, ``form``, ``prefix_chars`` and ``middle_chars`` for every row, beside ``keep``.

    A text is cut between units, which are runs of A-Z and a-z and every other
    character, at two places that ``key`` and ``seed`` decide. ``form`` is psm for
    prefix, suffix, middle, spm for suffix, prefix, middle, and plain where the
    text stays as it is: if it is empty or null, holds a sentinel, or is among
    the share from ``plain_from`` percent on. Equal rows give equal rows; rows
    with a null key are cut as for an empty key. Both cuts may be the same, which leaves the middle
    empty. Texts of any length are rearranged whole, within one buffer. ``keep`` must not
    hold names of the result; other columns are ignored. An empty table gives an empty one.
    """

    def work(value: str | None, numbers: list[int]) -> tuple:
        return _row(value, numbers, plain_from, spm_below)

    return _by_rows(
        df, keep, [F.col(text), draws(F.col(key), seed)], work,
        "output string, n long, form string, prefix_chars long, middle_chars long",
    )


def restored(df: DataFrame, keep: list[str], output: str = "output", form: str = "form") -> DataFrame:
    """``restored``, the text that each row of ``fill_in_middle`` was made from, beside ``keep``.

    A null output gives an empty text.
    """

    def work(value: str | None, kind: str) -> tuple:
        return (restore((value or "").encode(), kind).decode(),)

    return _by_rows(df, keep, [F.col(output), F.col(form)], work, "restored string")
