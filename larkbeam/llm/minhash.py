"""Near duplicates by circulant MinHash, banding, and a check of the full sets.

1. Every text becomes a set of shingles and a signature; texts with equal sets
   form a class, and from then on a class counts once.
2. Classes with an equal band share a bucket. Of each bucket, the class with the
   smallest number leads, and all others are compared with it.
3. Links so far give components. In buckets that hold several, all pairs of
   different components are compared as well, so that no link is missed that a
   bucket shows. Such pairs are never written: classes that meet are brought
   together in blocks and counted by lists of which class has which shingle.

With 40 bands of 6 coordinates, a pair with a similarity of 0.8 shares no
bucket with a probability of 5 in a million; pairs closer than that, less.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbeam.llm.batches import map_batches, per_worker
from larkbeam.llm.components import components
from larkbeam.llm.shingles import Circulant, band_hashes, shingle_sets
from larkbeam.llm.spans import slices
from larkbeam.operators.reduce import bloom, maybe_in, reduced_semi_join
from larkbeam.sources.files import rewritten

BANDS, ROWS = 40, 6

#: Classes that are compared with one another in one task, and shingles of them; either makes a new block.
BLOCK, SHINGLES = 1000, 1 << 20

#: Words of 64 bits of each class that are compared together, and classes.
STRETCH = 256
ROWS_AT_ONCE = 512


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(df: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    def work() -> Callable[[list], list[tuple]]:
        make = per_worker(("circulant", bands * rows), lambda: Circulant(bands * rows))

        def sign(texts: list) -> list[tuple]:
            out = []
            for s in shingle_sets(texts, width):
                found = band_hashes(make.signature(s), bands).view(np.int64) if len(s) else None
                out.append((len(s), _key(s), found))
            return out

        return sign

    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(named, ["doc_id"], "text", work, "n_shingles long, key binary, bands array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    def work() -> Callable[[list], list[tuple]]:
        return lambda texts: [(_key(s), s.view(np.int64)) for s in shingle_sets(texts, width)]

    return map_batches(df, [], "text", work, "key binary, shingles array<long>")


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    lists = group.column("shingles").combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    size = np.diff(lists.offsets.to_numpy())
    nodes, parts = group.column("nid").to_numpy(), group.column("part").to_numpy()
    return nodes, parts, size, flat


def _by_bits(rows: np.ndarray, number: np.ndarray, owner: np.ndarray, same: np.ndarray) -> None:
    """Add to ``same`` how many of the numbered shingles ``rows`` and every class have in common.

    Sets are rows of bits, 64 shingles to a word, of which a stretch of words is looked at together.
    """
    for base in range(0, int(number.max(initial=-1)) + 1, 64 * STRETCH):
        own = np.flatnonzero((number >= base) & (number < base + 64 * STRETCH))
        place = number[own] - base
        bits = np.zeros((same.shape[1], STRETCH), np.uint64)
        np.bitwise_or.at(bits, (owner[own], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        bits = bits[:, bits.any(axis=0)]
        for i, row in enumerate(rows.tolist()):
            same[i] += np.bitwise_count(bits & bits[row]).sum(axis=1, dtype=np.int32)


def _by_lists(rows: np.ndarray, number: np.ndarray, owner: np.ndarray, same: np.ndarray) -> None:
    """The same from lists of the classes of each shingle, which is less work where these are short."""
    n = same.shape[1]
    order = np.argsort(number, kind="stable")
    has, count = owner[order], np.bincount(number)
    begin = np.cumsum(count) - count
    upto = np.append(0, np.cumsum(np.bincount(owner, minlength=n)))
    for i, row in enumerate(rows.tolist()):
        own = number[upto[row] : upto[row + 1]]
        same[i] += np.bincount(has[slices(count[own], begin[own])], minlength=n).astype(np.int32)


def links_of_group(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between classes of different parts among the rows of a group.

    All but the largest part are compared with everything else. Of the links of
    a class to one part, the first is given; the part hangs together anyway.
    """

    def find(group: pa.Table) -> pa.Table:
        nodes, parts, size, flat = _columns(group)
        names, members = np.unique(parts, return_counts=True)
        rows = np.flatnonzero(parts != names[np.argmax(members)])
        _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(nodes)), size)
        # shingles of one class only are in no intersection
        often = 64 * count >= len(nodes)
        kinds = [((count > 1) & often, _by_bits), ((count > 1) & ~often, _by_lists)]
        found: list[tuple[int, int]] = []
        for at in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[at : at + ROWS_AT_ONCE]
            overlaps = np.zeros((len(some), len(nodes)), np.int32)
            for kind, add in kinds:
                taken = kind[number]
                if taken.any():
                    add(some, (np.cumsum(kind) - 1)[number[taken]], owner[taken], overlaps)
            for i, same in zip(some.tolist(), overlaps):
                good = (100 * same >= percent * (size + size[i] - same)) & (parts != parts[i])
                hits = np.flatnonzero(good)
                _, first = np.unique(parts[hits], return_index=True)
                found += [(int(nodes[i]), int(nodes[j])) for j in hits[first]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return find


def _pieces(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(BLOCK), shingles / F.lit(SHINGLES))).cast("int")


def _led(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Which of the pairs (lead, nid) are links. A lead's pairs are dealt to blocks."""
    sizes = pairs.groupBy("lead").agg(_pieces(F.count("*"), F.sum("n")).alias("_n"))
    spread = F.pmod(F.xxhash64("nid"), F.col("_n")).cast("int")
    # the lead forms the larger part, so that only the others are compared with it
    others = pairs.join(sizes, "lead").select("lead", spread.alias("block"), "nid", F.lit(0).alias("part"))
    leads = sizes.select(
        "lead", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("block"),
        F.col("lead").alias("nid"), F.lit(1).alias("part"),
    )
    rows = others.union(leads).join(sets, "nid")

    def find(group: pa.Table) -> pa.Table:
        _, parts, size, flat = _columns(group)
        nodes = group.column("nid")
        lead = int(np.argmax(parts))
        ends = np.cumsum(size)
        own = flat[ends[lead] - size[lead] : ends[lead]]
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        same = np.add.reduceat((own[place] == flat).astype(np.int64), ends - size)
        good = (100 * same >= percent * (size + size[lead] - same)) & (parts == 0)
        kept = nodes.filter(pa.array(good))
        return pa.table({"a": pa.array([nodes[lead].as_py()] * len(kept), pa.int64()), "b": kept})

    return rows.groupBy("lead", "block").applyInArrow(find, "a long, b long")


def _crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components that meet in a bucket."""
    parts = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select(
        "bucket", "nid", "n", F.coalesce("label", "nid").alias("part")
    )
    parts = rewritten(parts, name="parts")
    counts = parts.groupBy("bucket", "part").agg(F.count("*").alias("_n"))
    several = counts.groupBy("bucket").agg(
        F.max(F.struct("_n", "part"))["part"].alias("main"), F.count("*").alias("_parts")
    )
    open_ = several.where("_parts > 1").select("bucket", "main")
    # buckets with the same main component are worked on together, as they mostly hold the same
    met = rewritten(parts.join(open_, "bucket").select("main", "nid", "n", "part").distinct(), name="met")
    sizes = met.groupBy("main").agg(_pieces(F.count("*"), F.sum("n")).alias("_n"))
    dealt = met.join(sizes, "main").select(
        "main", "nid", "part", "_n", F.pmod(F.xxhash64("nid"), F.col("_n")).cast("int").alias("_i")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j")
    cells = dealt.select("main", "nid", "part", "_i", other).select(
        "main", "nid", "part", F.least("_i", "_j").alias("low"), F.greatest("_i", "_j").alias("high")
    )
    return cells.join(sets, "nid").groupBy("main", "low", "high").applyInArrow(
        links_of_group(percent), "a long, b long"
    )


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Rows whose sets of shingles have ``percent`` of their union in common are
    linked; ``component_id`` is the smallest id that links lead to, and the row
    with that id is kept. Texts without words, empty or null, are linked with
    nothing. Rows that occur several times are all given. Ids that are null
    don't count as smallest; where a class of equal sets has no other, it is linked
    with nothing and its rows have a null ``component_id`` and are kept. Other
    columns are ignored. An empty table gives an empty one.
    """
    signed = rewritten(_signed(df, doc_id, text, width, bands, rows), name="signed")
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.max("n_shingles").cast("int").alias("n"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    classes = rewritten(classes, name="classes")
    named = classes.where("first IS NOT NULL")
    entries = named.select("nid", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("nid").alias("lead"), F.max("nid").alias("_last"))
    shared = rewritten(shared.where("lead < _last").select("bucket", "lead"), name="shared")
    # most buckets hold one class, and those of others need no second shuffle
    members = rewritten(maybe_in(entries, "bucket", bloom(shared, "bucket")).join(shared, "bucket"), name="members")
    pairs = rewritten(members.where("nid != lead").select("lead", "nid", "n").distinct(), name="pairs")

    candidates = members.select("nid").distinct().join(named.select("nid", "key", "first"), "nid")
    candidates = rewritten(candidates, name="candidates")
    source = df.select(F.col(doc_id).alias("first"), F.col(text).alias("text"))
    # candidates grow with the corpus, so they are never broadcast; a filter of bounded size
    # keeps most other texts away from the shuffle
    texts = reduced_semi_join(source, candidates, "first", "first")
    # a key has one class; dealt by key for this, sets are not shuffled again for the join
    sets = _sets(texts, width).dropDuplicates(["key"]).join(candidates.select("nid", "key"), "key")
    sets = rewritten(sets.select("nid", "shingles"), name="sets")

    links = rewritten(_led(pairs, sets, percent), name="links")
    # written, as both directions of a link are read
    more = rewritten(_crossing(members, components(links), sets, percent), name="crossing")
    labels = components(links.union(more))
    known = labels.withColumnRenamed("node", "nid").join(named.select("nid", "key", "first"), "nid")
    least = known.groupBy("label").agg(F.min("first").alias("component"))
    grouped = known.join(least, "label").select("nid", "component")
    all_classes = classes.join(grouped, "nid", "left").select(
        "key", F.coalesce("component", "first").alias("component")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return signed.join(all_classes, "key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
