import re
from collections import defaultdict

from tarnsearch.llm import mixing


def model_targets(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Water-filling step by step: clamp, reshare, until none is above."""
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(most * sizes[s] for s in clamped)
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in clamped else share[s] for s in sizes}
        clamped |= over


def test_targets_and_taken_words(spark):
    rows = []
    for k, (source, n) in enumerate([("a", 400), ("b", 3), ("c", 50), (None, 20), ("d", 120)]):
        rows += [(1000 * k + i, " ".join(["w"] * (i % 9 + 1)), source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs).collect()
    sizes = defaultdict(int)
    source_of = {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = model_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)
    assert sorted(got) == sorted(mixing.mixed_documents(docs.repartition(5)).collect())


def test_edge_cases(spark, edge, none):
    with_source = edge.withColumnRenamed("score", "source")
    assert mixing.mixed_documents(with_source).count() == edge.count()
    assert mixing.mixed_documents(none.withColumnRenamed("score", "source")).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mixed_documents(blank).collect()} == {(0.0, 0)}
