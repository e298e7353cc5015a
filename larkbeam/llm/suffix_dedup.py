"""Strings that repeat anywhere in a corpus, by sorting sampled suffixes.

A suffix array sorts all suffixes, and neighbours in it show what repeats. Only
repeats of a stated length are asked for here, so suffixes are sorted as far as
that, and only where they can still have an equal. Which are sorted is told by the
strings themselves: the anchor of a start is that of the v places from it whose
tuple has the least hash. Equal strings have their anchors at the same distance, so:

1. The tuples of all anchors get names and are sorted; neighbours with equal names are
   kept. All else is out: a string that repeats has an equal tuple at its anchor. Of
   natural text, two places of v + 1 are anchors.
2. Of the kept anchors, the names of the strings that all their starts cover
   are sorted as well. Where those are equal, all these starts repeat. If that is so of all
   anchors with a tuple, no other start can equal one of theirs, and they are done.
   Else the first of each name goes on as well, for others to be compared with.
3. Starts that go on are looked at by a difference cover of small modulus v: any two
   have a shift below v at which both fall on sampled places, those whose number modulo v
   is in the cover. Starts without an equal tuple are out.
4. At last every start that is left is merged in with its whole prefix, and
   neighbours with equal prefixes repeat.

Names are hashes, which sort as well as ranks do where only equal ones matter:
64 bits to find places that are looked at again, 128 bits to decide. Equal texts
are one text from the start on. Sorting is Spark's; a task holds a batch of texts at a time
and a few batches of names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkbeam.llm.batches import _parse, small_batches
from larkbeam.llm.spans import mixed, slices, tuple_hashes
from larkbeam.operators.joins import salted_join
from larkbeam.operators.reduce import bloom, maybe_in
from larkbeam.sources.files import rewritten

#: Bytes of text whose names a task looks at together, or one text if that is longer.
BLOCK = 1 << 22

#: Starts that are hashed at a time.
PIECE = 1 << 16

#: Rows of a batch of names.
ROWS = 1 << 18

#: Places of a name in a block, beyond which one row stands for them.
OFTEN = 4

#: Of a place: bits of the text's hash, then bits of the offset. Only candidates are found by these.
#: Two texts of equal bits that have a tuple at the same offset, and share it with no third one, are missed; for
#: a billion of such pairs the probability is 6 in 100,000.
_PLACE = 19
_TEXT_BITS = (1 << 44) - 1

Cover = tuple[int, np.ndarray]


def difference_cover(q: int) -> Cover:
    """A modulus v = q * q + q + 1 and q + 1 numbers with every difference modulo v, for a prime q.

    The powers of a generator of a field of q ** 3 elements that lie in one plane.
    """
    v = q * q + q + 1
    for c in itertools.product(range(q), repeat=3):
        power, plane = (1, 0, 0), []
        for i in range(v):
            if power[2] == 0:
                plane.append(i)
            a, b, top = power
            power = (top * c[0] % q, (a + top * c[1]) % q, (b + top * c[2]) % q)
        if len(plane) == q + 1 and len({(x - y) % v for x in plane for y in plane}) == v:
            return v, np.array(plane)
    raise ValueError(f"no cover for {q}")


def anchor_window(length: int) -> int:
    """Places that an anchor is chosen from: the power of two next to a third of ``length`` from below."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def cover(length: int) -> Cover:
    """The cover for starts that anchors left open."""
    return difference_cover(3) if 2 * 13 <= length else (1, np.zeros(1, np.int64))


def joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges ``first`` to ``last``, both included, as ranges that do not touch."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + 1])) if len(first) else np.empty(0, np.int64)
    ends = np.append(new[1:], len(first)) - 1 if len(new) else new
    return first[new], last[ends]


def without(first: np.ndarray, last: np.ndarray, gone_first: np.ndarray, gone_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges less other ranges; both are in order and do not touch."""
    edges = np.concatenate([first, last + 1, gone_first, gone_last + 1])
    kind = np.repeat([1, -1, -2, 2], [len(first), len(last), len(gone_first), len(gone_last)])
    order = np.argsort(edges, kind="stable")
    edges, level = edges[order], np.cumsum(kind[order])
    at = np.flatnonzero(level[:-1] == 1) if len(edges) else np.empty(0, np.int64)
    first, last = edges[at], edges[at + 1] - 1
    real = last >= first
    return joined(first[real], last[real])


def places_in(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return slices(last - first + 1, first) if len(first) else np.empty(0, np.int64)


def reachable(kept: np.ndarray, v: int, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the starts that have one of the kept places among their first v."""
    kept = np.sort(kept)
    first, last = np.maximum(kept - v + 1, 0), np.minimum(kept, size - length)
    real = last >= first
    return joined(first[real], last[real])


def sampled(first: np.ndarray, last: np.ndarray, cover: Cover, size: int, length: int) -> np.ndarray:
    """The sampled places among the first v of any start in the ranges."""
    v, residues = cover
    places = places_in(*joined(first, np.minimum(last + v - 1, size - length + v - 1)))
    return places[np.isin(places % v, residues)]


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of every anchor in texts that follow each other: its first and last start, its place, and the name of its tuple.

    Starts are those of strings of ``length`` bytes within a text. Of equal tuples the leftmost counts, and so it does
    of those whose hashes are equal in all but the lowest bits.
    """
    v = anchor_window(length)
    t = length - v + 1
    bits = (PIECE + length).bit_length()
    number, low = np.arange(PIECE + v, dtype=np.uint64), np.uint64((1 << bits) - 1)
    found = [(np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)]
    for at in range(0, len(data) - length + 1, PIECE):
        hashes = tuple_hashes(data[at : at + PIECE + length - 1], t)
        least = hashes ^ (hashes >> np.uint64(29))
        least *= np.uint64(0xD6E8FEB86659FD93)
        least &= ~low
        least |= number[: len(least)]
        width = 1
        while width < v:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        place = (least & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place = place[new]
        found.append((new + at, place + at, mixed(hashes[place])))
    first, place, name = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else first
    last = np.append(first[new][1:], max(0, len(data) - length + 1)) - 1 if len(new) else new
    first, place, name = first[new], place[new], name[new]
    own = np.searchsorted(ends, place, "right")
    first, last = np.maximum(first, np.append(0, ends)[own]), np.minimum(last, ends[own] - length)
    real = last >= first
    return first[real], last[real], place[real], name[real].view(np.int64)


def _ranges(found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    return joined(*(np.array([x[side] for x in found or []], np.int64) for side in ("first", "last")))


# --- names of tuples, and which of them are there more than once


def _names(data: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits for each of the strings."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    found = b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2).astype(np.int64)


def _tuple_names(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64 bits for each of the strings of ``length`` bytes; ``places`` are in order."""
    found = [np.empty(0, np.uint64)]
    for at in range(0, len(data) - length + 1, PIECE):
        here = places[slice(*np.searchsorted(places, [at, at + PIECE]))]
        if len(here):
            found.append(tuple_hashes(data[at : at + PIECE + length - 1], length)[here - at])
    return mixed(np.concatenate(found)).view(np.int64)[:, None]


def _alike(values: np.ndarray, more: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose value no other has, in most cases nearly all, and the rest, to which ``more`` are added."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    some = np.zeros(len(values), bool) | more
    some[order[1:][same]] = some[order[:-1][same]] = True
    return np.flatnonzero(~some), np.flatnonzero(some)


def _odd(place: list[np.ndarray], bits: np.ndarray, width: int) -> np.ndarray:
    """Names that no other place has."""
    own = np.full(len(bits), 0x2545F491, np.int64)
    for column in place:
        own = (own ^ column.astype(np.int64)) * np.int64(0x5851F42D4C957F2D)
        own ^= (own >> 29) & 0x7FFFFFFFF
    odd = np.zeros((len(bits), width), np.int64)
    odd[:, 0] = own & ~3 | bits
    return odd


def _dealt(names: np.ndarray, sure: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names to sort, of which a block has each ``OFTEN`` times at most, however often it occurs there.

    The places of a name that a block has more often get odd names of their own, which
    spread over all tasks; the first has the second bit set. One even name
    stands for all of them. So a name that is everywhere does not fill one task.
    The same is done if one of the places is ``sure`` to have an equal, or if two of the block are
    written alike, as copies of a text look so elsewhere.
    """
    names = names.copy()
    names[:, 0] &= ~3
    once, order = _alike(names[:, 0], sure)
    order = order[np.lexsort([*(c[order] for c in place), *names[order].T[::-1]])]
    again = np.concatenate([[False], (names[order][1:] == names[order][:-1]).all(axis=1)])[: len(order)]
    known = sure[order]
    for_all = again.copy()
    for column in place:
        for_all[1:] &= column[order][1:] == column[order][:-1]
    begin = np.flatnonzero(~again)
    count = np.diff(np.append(begin, len(order)))
    any_ = np.add.reduceat(for_all | known, begin) > 0 if len(begin) else np.zeros(0, bool)
    often = np.repeat((count > OFTEN) | any_, count)
    plain, equal = np.concatenate([once, order[~often | ~again]]), order[often]
    odd = _odd([c[equal] for c in place], np.where(again[often], 1, 3), names.shape[1])
    rows = np.concatenate([plain, equal])
    return np.concatenate([names[plain], odd]), [c[rows] for c in place]


def _sent(names: np.ndarray, place: list[np.ndarray], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    columns = [*names.T, *place]
    for at in range(0, len(names), ROWS):
        arrays = [pa.array(np.ascontiguousarray(c[at : at + ROWS]), f.type) for c, f in zip(columns, arrow)]
        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _named(df: DataFrame, inputs: list[str], work: Callable[..., tuple], wide: bool, place: str) -> DataFrame:
    """Names of the places that ``work`` gives for a text and the values of its other columns.

    It gives names, which of them are sure to have an equal, the columns ``place``, and these columns for places
    that have an equal in the same text and need not be compared. The last input tells different texts apart.
    """
    names = ["a", "b"] if wide else ["a"]
    schema = StructType([*_parse(", ".join(f"{n} long" for n in names)).fields, *_parse(place).fields])
    arrow = to_arrow_schema(schema)

    def out(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        names, sure, *_ = (np.concatenate(x) for x in list(zip(*block))[:2])
        where, more = ([np.concatenate(c) for c in zip(*(x[i] for x in block))] for i in (2, 3))
        with np.errstate(over="ignore"):
            yield from _sent(*_dealt(names, sure, where), arrow)
            yield from _sent(_odd(more, np.ones(len(more[0]), np.int64), names.shape[1]), more, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                found = work(data, *[c[i].as_py() for c in batch.columns[1:]])
                if not len(found[0]):
                    continue
                block.append(found)
                size += len(data) + 16 * len(found[0])
                if size >= BLOCK:
                    yield from out(block)
                    block, size = [], 0
        yield from out(block)

    return small_batches(df).select(*inputs).mapInArrow(run, schema)


def _repeated(named: DataFrame, names: list[str], others: bool = False) -> DataFrame:
    """The places whose name another place has: sorted, and compared with their neighbours.

    A place that is there more than once, from copies of a text, counts once.
    ``head`` is set for the first place of a name, and of those that a block has often.
    With ``others``, places without an equal stay as well; ``equal`` is not set for these.
    """
    place = [c for c in named.columns if c not in names]
    schema = named.select(*place).schema.add("equal", "boolean").add("head", "boolean")
    arrow = to_arrow_schema(schema)
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, until its next neighbour is known
        matched = False  # whether the one before it has its name
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            once = np.zeros(len(columns[0]), bool)
            once[0] = True
            for c in columns:
                once[1:] |= c[1:] != c[:-1]
            columns = [c[once] for c in columns]
            same = np.ones(len(columns[0]) - 1, bool)
            for c in columns[:n]:
                same &= c[1:] == c[:-1]
            odd, after, before = columns[0] & 3, np.append(same, False), np.concatenate([[matched], same])
            equal, head = after | before | (odd > 0), (after & ~before) | (odd == 3)
            given = equal | others
            held, matched, given[-1] = [c[-1:] for c in columns], bool(before[-1]), False
            if odd[-1]:  # known, and no neighbour changes that
                given[-1], held, matched = True, None, False
            yield out([c[given] for c in columns[n:]], equal[given], head[given])
        if held is not None and (matched or others):
            yield out(held[n:], np.array([matched]), np.zeros(1, bool))

    def out(columns: list[np.ndarray], *flags: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *flags], arrow)], schema=arrow)

    return named.repartition(names[0]).sortWithinPartitions(*named.columns).mapInArrow(run, schema)


def _lists(places: DataFrame, name: str, *columns: str) -> DataFrame:
    """The places of each text, which may be there twice."""
    value = F.struct(*columns) if len(columns) > 1 else F.col(*columns)
    return places.groupBy("nid").agg(F.collect_list(value).alias(name))


# --- the steps


def keyed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_k1`` and ``_k2``, 128 bits for a text, and its length in bytes; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {"_k1": F.xxhash64(body), "_k2": F.xxhash64(F.lit(1), body), "_bytes": F.octet_length(body).cast("long")}
    )


def _short_key(k1: Column) -> Column:
    return k1.bitwiseAND(F.lit(_TEXT_BITS))


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of some texts, one after another, where each ends, and the second column; copies only once."""
    for batch in batches:
        _, one = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True)
        batch = batch.take(pa.array(np.sort(one)))
        texts, keys = batch.column(0).cast(pa.binary()), batch.column(1).to_numpy(zero_copy_only=False)
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(edges[:-1] // BLOCK)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield np.frombuffer(data, np.uint8)[edges[a] : edges[b]], edges[a + 1 : b + 1] - edges[a], keys[a:b]


def _first_level(texts: DataFrame, length: int) -> DataFrame:
    """Kept places of the first level: ``key``, a part of ``_k1``, and ``pos``, the last bits of a place.

    Of equal tuples of one text only the first is named.
    """
    schema = _parse("a long, loc long")
    arrow = to_arrow_schema(schema)
    low = (1 << _PLACE) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ends, keys in _text_blocks(batches):
            *_, place, name = anchors(data, ends, length)
            own = np.searchsorted(ends, place, "right")
            new, sure = _first_of_equal([name, own])
            at = place - np.append(0, ends)[own]
            loc = (keys[own] & _TEXT_BITS) << _PLACE | at & low
            with np.errstate(over="ignore"):
                yield from _sent(*_dealt(name[new, None], sure[new], [loc[new]]), arrow)

    kept = _repeated(small_batches(texts).select("text", "_k1").mapInArrow(run, schema), ["a"])
    return kept.select(
        F.shiftrightunsigned("loc", _PLACE).alias("key"), F.col("loc").bitwiseAND(F.lit(low)).alias("pos")
    )


def _first_of_equal(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of those equal to them, and which have an equal."""
    new, sure = np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), bool)
    order = _alike(columns[0])[1]
    order = order[np.lexsort([c[order] for c in columns[::-1]])]
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    new[order[1:][same]] = False
    sure[order[1:][same]] = sure[order[:-1][same]] = True
    return new, sure


def repeated_spans(df: DataFrame, text: str = "text", length: int = 400) -> tuple[DataFrame, DataFrame]:
    """Where texts repeat strings of ``length`` bytes: ``spans`` of the texts that do, and the copies.

    The first table has ``_k1``, ``_k2``, ``text`` and ``spans``, maximal ranges ``start`` to ``stop`` of the bytes
    covered by such strings, one row a text. The second has ``_k1`` and ``_k2`` of the texts that occur more than
    once and are long enough, which are covered whole. Both are written.
    """
    docs = keyed(df.select(F.col(text).alias("text")), "text").where(F.col("_bytes") >= length)
    keys = rewritten(docs.groupBy("_k1", "_k2").agg(F.count("*").alias("n")), name="text-keys")
    copies = keys.where("n > 1").select("_k1", "_k2")

    kept = rewritten(_first_level(docs, length).groupBy("key").agg(F.collect_set("pos").alias("kept")), name="kept")
    marks = keys.withColumn("key", _short_key(F.col("_k1"))).join(kept.hint("merge"), "key").select("_k1", "_k2", "kept")
    marks = rewritten(marks, name="marks")
    # texts of which nothing was kept are not shuffled, and of copies one a task
    some = maybe_in(docs, "_k1", bloom(marks, "_k1")).groupBy("_k1", "_k2").agg(F.any_value("text").alias("text"))
    open_ = some.join(marks.hint("merge"), ["_k1", "_k2"]).withColumn("nid", F.monotonically_increasing_id())
    open_ = rewritten(open_, name="open")

    low = (1 << _PLACE) - 1

    def whole(data: bytes, kept: list, nid: int) -> tuple:
        first, last, place, name = anchors(np.frombuffer(data, np.uint8), np.array([len(data)]), length)
        # in texts of more places than its bits tell, every place with such bits counts as kept
        here = np.isin(name, name[np.isin(place & low, kept)])
        first, last, name = first[here], last[here], name[here]
        names = _names(data, first, last + length)
        new, sure = _first_of_equal([*names.T])
        more = joined(first[~new], last[~new])
        number = np.full(len(first) + 1, nid)
        places = [name[new], number[: new.sum()], first[new], last[new]]
        return names[new], sure[new], places, [np.zeros(len(more[0]), np.int64), number[: len(more[0])], *more]

    named = _named(open_, ["text", "kept", "nid"], whole, True, "tuple long, nid long, first long, last long")
    met = rewritten(_repeated(named, ["a", "b"], others=True), name="met")
    equal = _lists(met.where("equal"), "equal", "first", "last")
    lone = met.where("NOT equal")
    heads = met.where("head").join(lone.select("tuple").distinct().hint("merge"), "tuple", "left_semi")
    left = rewritten(_lists(lone.union(heads.select(*lone.columns)), "left", "first", "last"), name="left")

    finer = v, _ = cover(length)

    def numbered(places: np.ndarray, names: np.ndarray, nid: int) -> tuple:
        none = np.empty(0, np.int64)
        return names, np.zeros(len(places), bool), [np.full(len(places), nid), places], [none, none]

    def narrowing(data: bytes, left: list, nid: int) -> tuple:
        places = sampled(*_ranges(left), finer, len(data), length)
        return numbered(places, _tuple_names(np.frombuffer(data, np.uint8), places, length - v + 1), nid)

    def last_level(data: bytes, left: list, *values) -> tuple:
        starts = _ranges(left)
        if v > 1:
            near = reachable(np.array(values[0], np.int64), v, len(data), length)
            starts = without(*starts, *without(np.zeros(1, np.int64), np.array([len(data)]), *near))
        places = places_in(*starts)
        return numbered(places, _names(data, places, places + length), values[-1])

    inputs = ["text", "left"]
    if v > 1:
        state = open_.select("nid", "text").join(left.hint("merge"), "nid")
        named = _named(state, [*inputs, "nid"], narrowing, False, "nid long, pos long")
        narrow = rewritten(_lists(_repeated(named, ["a"]), "narrow", "pos"), name="narrow")
        left, inputs = left.join(narrow.hint("merge"), "nid"), [*inputs, "narrow"]

    state = open_.select("nid", "text").join(left.hint("merge"), "nid")
    named = _named(state, [*inputs, "nid"], last_level, True, "nid long, pos long")
    exact = _lists(_repeated(named, ["a", "b"]), "exact", "pos")

    spans = _spans(equal.join(exact.hint("merge"), "nid", "full"), length)
    return rewritten(open_.select("nid", "_k1", "_k2", "text").join(spans.hint("merge"), "nid").drop("nid"), name="spans"), copies


def _spans(found: DataFrame, length: int) -> DataFrame:
    schema = _parse("nid long, spans array<struct<start: long, stop: long>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for equal, exact in zip(batch.column(1), batch.column(2)):
                first, last = _ranges(equal.as_py())
                own = np.array(exact.as_py() or [], np.int64)
                first, end = joined(np.concatenate([first, own]), np.concatenate([last, own]) + length - 1)
                rows.append([{"start": a, "stop": b + 1} for a, b in zip(first.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow.field(1).type)], schema=arrow)

    return small_batches(found).select("nid", "equal", "exact").mapInArrow(run, schema)


def _kept_parts(data: bytes, spans: list[dict]) -> bytes:
    edges = [0, *[x for s in spans for x in (s["start"], s["stop"])], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for every row.

    Every byte of UTF-8 covered by a string of ``length`` bytes that also starts anywhere else is
    removed, in the same text or in that of another row; the digest is that of
    what is left. Rows that repeat a text of that length lose all of it, whatever their ids.
    Null texts count as empty ones, and texts shorter than ``length`` keep everything.
    Ids are only passed on: they may be null or repeat. Texts are read whole at any length. Other columns are ignored. An
    empty table gives an empty one.
    """
    spans, copies = repeated_spans(df, text, length)
    schema = _parse("_k1 long, _k2 long, n_removed long, n_spans long, kept_sha256 string")
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, own = batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()
                left = _kept_parts(data, own)
                rows.append((len(data) - len(left), len(own), hashlib.sha256(left).hexdigest()))
            made = [pa.array(list(v), f.type) for v, f in zip(zip(*rows) if rows else [[]] * 3, list(arrow)[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], schema=arrow)

    partly = small_batches(spans.join(copies.hint("merge"), ["_k1", "_k2"], "left_anti"))
    partly = partly.select("_k1", "_k2", "text", "spans").mapInArrow(cut, schema)
    none = F.sha2(F.lit(""), 256)
    whole = copies.select(
        "_k1", "_k2", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("kept_sha256")
    )
    known = rewritten(partly.union(whole), name="cut")
    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = keyed(named, "text").withColumn("_sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).drop("text")
    met = salted_join(rows, known, ["_k1", "_k2"], "left")
    return met.select(
        "doc_id", F.col("_bytes").alias("n_bytes"),
        F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("_sha"))).alias("kept_sha256"),
    )
