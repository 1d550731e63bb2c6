import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tarnsearch.llm import quality

from .conftest import prose


def test_held_out_scores_and_edges(spark, edge, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 1
        text = prose(rng, rng.randint(20, 80))
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    got = quality.scored(docs, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    kept = quality.keep_good(docs.selectExpr("doc_id as score", "text", "doc_id"), marks)
    assert kept.columns == ["score", "text", "doc_id"]
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in {k["doc_id"] for k in kept.collect()})
    model = quality.fit(docs, marks)
    found = quality.score_column(edge, model).collect()
    assert len(found) == edge.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_column(none, model).count() == 0
    untaught = quality.fit(none, marks.limit(0))
    assert {r["score"] for r in quality.score_column(edge, untaught).collect()} == {0.5}


def test_dual_descent_reaches_the_optimum():
    """The gap between the primal and the dual objective closes, as it does at the optimum only."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(60, rng.integers(1, 12), replace=False)) for _ in range(200)]
    to, flat = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    values, y = rng.normal(size=len(flat)), np.where(rng.random(200) < 0.6, 1.0, -1.0)
    cost = np.where(y > 0, 1.0, 2.0)
    w, bias = quality.dual_descent(flat, values, to, np.arange(200), y, 60, cost, epochs=3000, least=1e-10)
    margins = np.array([w[flat[a:b]] @ values[a:b] + bias for a, b in zip(to, to[1:])])
    loss = (cost * np.maximum(0, 1 - y * margins)).sum()
    primal = (w @ w + bias * bias) / 2 + loss
    # At the optimum the dual objective, sum(alpha) - |w|^2 / 2, equals it, and sum(alpha) = |w|^2 + loss then.
    for _ in range(300):
        move = rng.normal(size=61) * 10 ** rng.uniform(-4, 0)
        v, c = w + move[:60], bias + move[60]
        m = np.array([v[flat[a:b]] @ values[a:b] + c for a, b in zip(to, to[1:])])
        assert (v @ v + c * c) / 2 + (cost * np.maximum(0, 1 - y * m)).sum() >= primal - 1e-6


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("stage", ["score_column", "keep_good"])
def test_memory_of_a_batch_has_a_bound(spark, monkeypatch, stage):
    """A batch of 8 MB of text takes a worker a few MB more than its texts, whichever function reads it."""
    rng = random.Random(3)
    text = prose(rng, 300)
    batch = pa.RecordBatch.from_arrays([pa.array([text[k % 50 :] for k in range((8 << 20) // len(text))])], ["text"])
    model = quality.Model(np.zeros((1 << quality.BITS) + quality.SHARES), np.zeros((1 << quality.BITS) + quality.SHARES), 0.0, 1.0, 0.0)
    ran = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *_: ran.append(f) or self.limit(0))
    monkeypatch.setattr(quality, "fit", lambda docs, labels: model)
    docs = spark.createDataFrame([], "text string")
    if stage == "score_column":
        quality.score_column(docs, model, keep=())
        batch = batch.rename_columns(["__text"])
    else:
        quality.keep_good(docs, None)
    got = []
    assert _peak(lambda: got.extend(x.num_rows for x in ran[0](iter([batch])))) < 64 << 20
    assert sum(got) == batch.num_rows


def test_memory_of_a_fit_has_a_bound():
    """Besides the rows a fit holds two flat copies of 4 bytes a feature, and tables of a fixed size."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(1 << quality.BITS, 20_000, replace=False)).astype(np.int32) for _ in range(300)]
    n, labels = sum(map(len, rows)), np.arange(300) % 2
    assert _peak(lambda: quality.fit_rows(rows, labels)) < 8 * n + 16 * 8 * (1 << quality.BITS)
