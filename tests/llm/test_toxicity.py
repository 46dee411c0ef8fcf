"""Toxicity scores: the risk's behaviour, held-out accuracy, and rows out of the ordinary."""

from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.toxicity import BUCKETS, Model, drop_toxic, features, fit, risk, toxicity

TABLES = "/root/testdata/sf0.1"


def test_positives_among_the_unlabelled_are_found():
    rng = np.random.default_rng(0)
    noise = lambda: set(rng.integers(0, 4000, 40).tolist())
    marked = lambda: np.array(sorted(noise() | {5000 + int(k) for k in rng.choice(6, 2, replace=False)}), np.int32)
    clean = lambda: np.array(sorted(noise()), np.int32)
    unlabelled = [marked() if k % 5 == 0 else clean() for k in range(2000)]
    model = fit([marked() for _ in range(300)], unlabelled, 0.2)
    logits = [model.weights[d].sum() + model.bias for d in unlabelled]
    predicted = np.array(logits) >= 0
    truth = np.arange(2000) % 5 == 0
    assert (predicted == truth).mean() > 0.98


def plain_risk(margins, positive, prior):
    """(risk, negative part) text by text, as the estimator is written."""
    loss = lambda m, y: 1 / (1 + np.exp(y * m))
    mine = [m for m, p in zip(margins, positive) if p]
    rest = [m for m, p in zip(margins, positive) if not p]
    mean = lambda values: sum(values) / len(values)
    negative = mean([loss(m, -1) for m in rest]) - prior * mean([loss(m, -1) for m in mine])
    return prior * mean([loss(m, 1) for m in mine]) + max(0.0, negative), negative


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=6), st.lists(st.floats(-5, 5), min_size=1, max_size=6), st.floats(0.05, 0.95))
def test_risk_and_slopes_are_those_of_the_estimator(mine, rest, prior):
    margins, positive = np.array(mine + rest), np.array([True] * len(mine) + [False] * len(rest))
    value, slope = risk(margins, positive, prior)
    want, negative = plain_risk(margins, positive, prior)
    assert abs(value - want) < 1e-12
    if abs(negative) < 1e-4:
        return
    for k in range(len(margins)):
        up, down = margins.copy(), margins.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        (risk_up, part_up), (risk_down, part_down) = plain_risk(up, positive, prior), plain_risk(down, positive, prior)
        numeric = (risk_up - risk_down if negative > 0 else part_down - part_up) / 2e-5
        assert abs(slope[k] - numeric) < 1e-6


def test_fit_lowers_the_plain_risk():
    rng = np.random.default_rng(4)
    mark = lambda k, n: np.array(sorted(set(rng.integers(0, 300, 20).tolist()) | {400 + int(x) for x in rng.integers(0, 4, n)}), np.int32)
    mine = [mark(k, 3) for k in range(120)]
    rest = [mark(k, 3 if k % 4 == 0 else 0) for k in range(400)]
    before, after = fit(mine, rest, 0.25, steps=0), fit(mine, rest, 0.25, steps=300)
    margins = lambda model: [float(model.weights[d].sum() + model.bias) for d in mine + rest]
    kinds = [True] * 120 + [False] * 400
    assert plain_risk(margins(after), kinds, 0.25)[0] < 0.5 * plain_risk(margins(before), kinds, 0.25)[0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert len(rows) > 500
    assert sum(r.toxic == r.predicted for r in rows) >= 0.97 * len(rows)
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_rows_out_of_the_ordinary(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    rows = [(1, None, "en", "x", 1), (2, "", None, None, None), (3, "bad words", "en", "x", 1), (3, "bad words", "en", "x", 1),
            (None, "a text", "en", "x", 1), (4, "w " * 200_000, "en", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(3, 1), (3, 0), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for labels in (marks, marks.limit(0)):
        got = toxicity(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        for r in got:
            assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert drop_toxic(docs, labels).columns == docs.columns
    assert toxicity(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity(docs, marks.limit(0)).collect()} == {0}


def test_scores_depend_on_whole_texts():
    weights = np.zeros(BUCKETS, np.float32)
    weights[features(b"marker")] = 3.0
    model = Model(weights, -1.0)
    assert model.score(b"x " * 100_000 + b"MARKER") > 0.5 > model.score(b"x " * 100_000) == model.score(b"")
