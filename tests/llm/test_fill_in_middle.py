"""Rotations against joining the parts."""

import hashlib
import random
import re

import numpy as np

from check import connect
from larkbeam.llm import fill_in_middle, queries

ODD = [
    None, "", "a", "ab", "é", "漢字 and words", "a1b2", "x<P>y", "<S", "S>", "P>a<", "<M>", "<", "\0\n\t ", "😀" * 3,
    "word " * 40, "word " * 40, "Zz[`{@" * 9, "x" * 300_000, "漢" * 100_000,
]


def plain(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, len(units), "plain", None, None
    if h[3] % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", len(units), "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", len(units), "psm", len(prefix), len(middle)


def test_rotation(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "STEP", 3)
    for n in range(12):
        for start in range(n + 1):
            for stop in range(start, n + 1):
                for cut in range(start, stop + 1):
                    data = np.arange(n)
                    fill_in_middle.rotate(data, start, cut, stop)
                    want = [*range(start), *range(cut, stop), *range(start, cut), *range(stop, n)]
                    assert data.tolist() == want


def test_every_cut_comes_back():
    text = "<a é漢😀>".encode()
    edges = [i for i in range(len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80]
    for form in ("psm", "spm"):
        for a in edges:
            for b in [e for e in edges if e >= a]:
                made = bytes(fill_in_middle.rearrange(text, a, b, form))
                parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
                assert made == b"".join(b"<%s>" % m.encode() + parts[m] for m in ("PSM" if form == "psm" else "SPM"))
                assert fill_in_middle.restore(made, form) == text


def test_rows_and_round_trip(spark, monkeypatch):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choices("ab é漢<>PSM", k=rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "no id", 5, "x"), (3, "ab", 5, "x"), (3, "ab", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, output string").repartition(2)
    made = fill_in_middle.fill_in_middle(df, ["doc_id"])
    key = lambda r: repr(tuple(r))
    want = sorted((key((i, *plain(i, t))) for i, t, _, _ in rows))
    assert sorted(map(key, made.collect())) == want
    assert len({r.form for r in made.collect()}) == 3
    back = fill_in_middle.restored(made, ["doc_id"])
    assert sorted(map(key, back.collect())) == sorted(key((i, t or "")) for i, t, _, _ in rows)
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(df.limit(0), ["doc_id"]), []).count() == 0


def test_query_equals_oracle(spark, small):
    name = "op12_fill_in_middle"
    got = [tuple(r) for r in queries.QUERIES[name](spark, small).orderBy("doc_id").collect()]
    assert got == connect(small).execute(queries.ORACLES[name] + " ORDER BY doc_id").fetchall()
