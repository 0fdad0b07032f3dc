"""The ordinal classifier: gradient, order, held-out accuracy and awkward input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import quality_classifier as q
from parlance.llm.queries import GOOD, rated_grade

FOLDER = "/root/testdata/sf0.1"


def test_thresholds_are_ordered_and_scores_rise_with_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 600)
    rows = [np.flatnonzero(rng.random(6) < 0.15 + 0.2 * g * (np.arange(6) < 3)) for g in grades]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    weights, thresholds = q.fit_thresholds_and_weights(grades, bounds, np.concatenate(rows), 6, 4)
    assert (np.diff(thresholds) > 0).all() and weights[:3].min() > weights[3:].max()
    model = q.OrdinalModel(weights, thresholds)
    tails = model.tails(np.array([weights[x].sum() for x in rows]))
    assert (np.diff(tails, axis=1) < 0).all()
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.5


def test_fit_finds_a_maximum():
    """No small step from the fitted parameters raises the penalised likelihood."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 90)
    buckets = np.where(rng.random(90) < 0.7, grades, rng.integers(0, 3, 90))
    weights, thresholds = q.fit_thresholds_and_weights(grades, np.arange(91), buckets, 3, 3, penalty=1.0, steps=3000, rate=0.02)

    def value(w, t):
        tails = np.column_stack([np.ones(90), q.OrdinalModel(w, t).tails(w[buckets]), np.zeros(90)])
        chance = tails[np.arange(90), grades] - tails[np.arange(90), grades + 1]
        return (np.log(chance) / 90).sum() - 1.0 / 200 * (w**2).sum()

    best = value(weights, thresholds)
    for i in range(3):
        for step in (-0.05, 0.05):
            assert value(weights + step * (np.arange(3) == i), thresholds) < best + 1e-6
    for i in range(2):
        for step in (-0.05, 0.05):
            assert value(weights, thresholds + step * (np.arange(2) == i)) < best + 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    model = q.fit(docs, labels.filter("not held"), rated_grade())
    scored = q.score(docs, model, GOOD).join(labels.filter("held").withColumn("grade", rated_grade()), "doc_id").toPandas()
    kept = scored.groupby("grade").kept.mean()
    assert kept[2] > 0.98 and kept[0] < 0.1 and kept[1] < 0.1
    assert scored.expected_grade.corr(scored.grade) > 0.8


@pytest.mark.parametrize("ratings", [[], [(1, 1, 0)], [(None, 1, 0), (1, None, None)]])
def test_too_few_ratings_keep_everything(spark, ratings):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame(ratings, "doc_id bigint, quality int, toxic int")
    model = q.fit(docs, labels, rated_grade())
    assert model is None
    assert [(r["kept"], r["score"]) for r in q.score(docs, model, GOOD).collect()] == [(True, None)] * 2


def test_awkward_rows(spark):
    texts = ["good words here"] * 30 + ["vile trash"] * 30 + [None, "", "vile " * 9000, "??!! ###"]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)] + [(None, "good words")], "doc_id bigint, text string")
    docs = docs.withColumn("kept", F.lit("mine")).withColumn("score", F.lit(0))
    labels = spark.createDataFrame(
        [(i, 1, int(i >= 30)) for i in range(60)] + [(0, 1, 0), (None, 1, 1), (61, None, None)], "doc_id bigint, quality int, toxic int")
    model = q.fit(docs.drop("kept", "score"), labels, rated_grade())
    found = q.score(docs, model, GOOD).toPandas()
    assert len(found) == 65 and sorted(found.columns) == sorted(["doc_id", "text", "kept", "score", "expected_grade", "tail_probability"])
    assert found.kept[:30].all() and not found.kept[30:60].any() and not found[found.doc_id == 62].kept.any()
    assert found[found.doc_id < 30].score.nunique() == 1
    assert q.score(docs.limit(0), model, GOOD).collect() == []
