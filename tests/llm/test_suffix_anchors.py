"""Which places of a corpus are sorted to find repeated strings: few, and none too few."""

import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from test_suffix_dedup import compare

from larkbeam.llm import suffix_dedup


@pytest.fixture
def sent(monkeypatch):
    """Counts of the names that each level sorts."""
    counts, repeated = [], suffix_dedup._repeated

    def counted(named, *args, **kwargs):
        counts.append(named.count())
        return repeated(named, *args, **kwargs)

    monkeypatch.setattr(suffix_dedup, "_repeated", counted)
    return counts


def test_few_names_are_sorted(spark, small, sent):
    texts = ds.dataset(f"{small}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    compare(spark, texts, 400)
    size = sum(len((t or "").encode()) for t in texts)
    assert sent[0] < 0.03 * size and sum(sent) < 0.1 * size


def test_runs_do_not_make_every_place_a_name(spark, sent):
    texts = ["a" * 30_000, "x" + "a" * 20_000 + "y", "ab" * 10_000, "seventeen letters" * 1_000, "-" * 401, "b" * 400]
    compare(spark, texts, 400)
    assert sum(sent) < 0.1 * sum(map(len, texts))


@pytest.mark.parametrize("length, piece", [(26, 1 << 16), (64, 256), (400, 1000)])
def test_families_of_near_copies(spark, monkeypatch, length, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    rnd = random.Random(length)
    texts = []
    for family in range(12):
        letters = "ab" if family % 3 == 0 else "abcdefgh é漢"
        base = "".join(rnd.choices(letters, k=6 * length))
        for _ in range(rnd.choice([2, 3, 12])):
            text = list(base[rnd.randrange(2 * length) : rnd.randrange(3 * length, 6 * length)])
            for _ in range(rnd.randrange(3)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["!", "ab", "a" * length, base[: length + 3]]))
            texts.append("".join(text))
    want = compare(spark, texts, length)
    assert any(0 < gone < size for size, gone, _, _ in want)


def test_anchors_are_told_by_the_string_alone():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 100, 3_000).astype(np.uint8)
    data[500:1_200] = 97
    other = np.concatenate([rnd.integers(97, 100, 77).astype(np.uint8), data])
    for length in (1, 5, 30, 400):
        found = []
        for x, skip in ((data, 0), (other, 77)):
            first, last, place, name = suffix_dedup.anchors(x, np.array([len(x)]), length)
            at = suffix_dedup.places_in(first, last)
            assert at.tolist() == list(range(len(x) - length + 1))
            each = np.repeat(place, last - first + 1) - at, np.repeat(name, last - first + 1)
            assert each[0].min() >= 0 and each[0].max() < suffix_dedup.anchor_window(length)
            found.append([c[skip:].tolist() for c in each])
        assert found[0] == found[1]
