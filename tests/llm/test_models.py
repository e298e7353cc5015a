"""The two classifiers against their formulas, worked out plainly."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from larkbeam.llm import quality, toxicity


def kept_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_scores_are_ratios_of_plain_densities(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if not kept_out(r.doc_id)}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    own = [np.array([x[i] for i, y in marks.items() if y == label and i in x]) for label in (0, 1)]
    total = sum(map(len, own))
    within = sum((len(o) * np.cov(o.T, bias=True) for o in own)) / total + 1e-6 * np.eye(len(own[0][0]))

    def density(v, rows):
        cov = 0.9 * np.cov(rows.T, bias=True) + 0.1 * within
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(within))
        away = v - rows.mean(axis=0)
        return math.log((len(rows) + 1) / (total + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * away @ np.linalg.solve(cov, away)

    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, v in x.items():
        want = 1 / (1 + math.exp(max(-500, min(500, density(v, own[0]) - density(v, own[1])))))
        assert abs(got[i].score - want) < 1e-6
        assert got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == kept_out(i)


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, x int, label string, score int"
    rows = [(1, None, 1, "a", 1), (2, "", 1, "a", 1), (None, "no id", 1, "a", 1), (2, "", 1, "a", 1), (4, "word " * 400_000, 1, "a", 1)]
    docs = spark.createDataFrame(rows, schema)
    for labels in ([], [(1, 0), (2, 1), (4, 1), (7, 0), (None, 1)], [(2, 1), (2, 0), (4, None)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality.quality_scores(docs, marks).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert quality.quality_scores(docs.limit(0), marks).count() == 0
        kept = quality.keep_good(docs, marks)
        assert kept.columns == docs.columns and kept.count() <= 5


def loss(rows, grades, weights, thresholds, decay):
    edges = [-math.inf, *thresholds, math.inf]
    out = 0.5 * decay * float(weights @ weights)
    for found, grade in zip(rows, grades):
        total = sum(weights[j] for j in found)
        below = [1 / (1 + math.exp(min(700, total - e))) if e > -math.inf else 0.0 for e in edges]
        out -= math.log(max(below[grade + 1] - below[grade], 1e-12)) / len(rows)
    return out


def test_ordinal_fit_finds_the_least_plain_loss():
    rnd = random.Random(4)
    rows = [np.array(sorted(rnd.sample(range(5), rnd.randint(0, 4))), np.int64) for _ in range(120)]
    true = [1.5, -1.0, 0.5, 2.0, 0.0]
    grades = np.array([sum(sum(true[j] for j in r) + rnd.gauss(0, 1) > t for t in (0.5, 1.5, 3.0)) for r in rows])
    model = toxicity.fit(rows, grades, 5, steps=3000, decay=1e-2)
    assert list(model.thresholds) == sorted(model.thresholds)
    best = loss(rows, grades, model.weights, model.thresholds, 1e-2)
    for i in range(8):  # no step along any one number makes it less
        for step in (-0.05, 0.05):
            weights, thresholds = model.weights.copy(), model.thresholds.copy()
            (weights if i < 5 else thresholds)[i if i < 5 else i - 5] += step
            assert loss(rows, grades, weights, thresholds, 1e-2) > best - 1e-5
    for found in rows[:20]:
        total = sum(model.weights[j] for j in found)
        plain = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert np.allclose(model.at_least(found), plain, atol=1e-6)


def test_severity_is_the_sum_of_the_chances_of_its_features(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    for r in toxicity.severity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        total = float(sum(np.float64(model.weights[j]) for j in toxicity.features(r.text)))
        plain = [1 / (1 + math.exp(max(-60, min(60, t - total)))) for t in model.thresholds]
        assert abs(r.severity - sum(plain)) < 1e-4 and r.predicted == (r.toxic_chance >= 0.5)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate([None, "", "a b", "a b", "vile " * 300_000])] + [(None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity int, label string")
    marks = spark.createDataFrame([(0, 0), (2, 1), (3, 0), (4, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.severity(docs, marks).collect()
    assert len(got) == 6 and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.severity(docs.limit(0), marks).count() == 0
    assert toxicity.keep_clean(docs, marks.limit(0)).count() == 6
    assert toxicity.keep_clean(docs, marks).select(F.count("*")).first()[0] <= 6
