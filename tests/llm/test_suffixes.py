import hashlib
import random
from collections import Counter

import pytest

from tarnsearch.llm import suffixes

from .conftest import prose


def brute(rows, length):
    seen = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 120])
def test_agrees_with_all_windows(spark, edge_rows, length):
    rng = random.Random(9)
    passage = prose(rng, 130)
    rows = [(i, t) for i, t, _ in edge_rows if i != 6]
    for i in range(100, 125):
        own = prose(rng, rng.randint(20, 160))
        if i % 3 == 0:
            at, size = rng.randrange(len(own)), rng.randint(300, len(passage))
            own = own[:at] + passage[:size] + own[at:]
        if i % 5 == 0:
            own += "lo " * rng.randint(100, 300)
        if i % 7 == 0:
            own = own + rows[-1][1][: rng.randint(200, 900)]
        rows.append((i, own))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffixes.remove_repeats(docs, length=length).collect())
    assert got == brute([(i, (t or "").encode()) for i, t in rows], length)


def test_empty(none):
    assert suffixes.remove_repeats(none).count() == 0


def test_small_buckets_and_hot_passages(spark, monkeypatch):
    """Many buckets, whose bounds fall among equal keys: a passage that all texts share, and copies."""
    monkeypatch.setattr(suffixes, "BUCKET", 40)
    rng = random.Random(3)
    passage = prose(rng, 200)
    rows = [(i, prose(rng, rng.randint(5, 40)) + passage + prose(rng, rng.randint(5, 40))) for i in range(40)] + [(7, passage)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffixes.remove_repeats(docs).collect())
    assert got == brute([(i, t.encode()) for i, t in rows], 400)


def test_many_repeated_rows(spark):
    """2,000 rows with the same text and no id, and one that contains it."""
    text = prose(random.Random(4), 2000)
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    docs = docs.unionAll(spark.createDataFrame([(1, "before " + text + " after")], "doc_id long, text string")).repartition(5)
    got = suffixes.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text)
    assert {tuple(r) for r in got} == {(None, n, n, 1, 2000), (1, n + 13, n, 1, 1)}


def test_shared_tokens_equal_a_sort():
    import numpy as np

    rng = np.random.default_rng(1)
    seqs = [[int(x) for x in rng.integers(0, 3, rng.integers(1, 6))] for _ in range(300)]
    head = np.array([q[0] << 40 for q in seqs], dtype=np.uint64)
    rest = np.array([x for q in seqs for x in q[1:]], dtype=np.uint32)
    keys = suffixes.Keys(head, np.array([len(q) for q in seqs], np.uint8), rest, np.zeros(300, suffixes._ID))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert keys.shared().tolist() == [max(common(a, b) for j, b in enumerate(seqs) if j != i) for i, a in enumerate(seqs)]


def test_a_group_of_many_texts_is_split(spark):
    """Half of all groups have the same key: its rows go to several tasks, and none is lost."""
    small = {"adaptive.enabled": "true", "adaptive.coalescePartitions.enabled": "false", "shuffle.partitions": "8", "autoBroadcastJoinThreshold": "-1"}
    small |= {"adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        key = "if(id % 2 = 0, 0, id div 4) as key"
        groups = spark.range(0, 40_000, 1, 8).selectExpr("id as rid", "1000L as n", "cast(id % 7 as int) as b", "10 as e", key, "1L as members", "id % 8 != 3 as open")
        spans = suffixes.asked(groups)
        got = {r["rid_"]: [tuple(s) for s in r["spans"]] for r in spans.collect()}
        plan = spans._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert "skew=true" in plan
    assert got == {i: [(i % 7, 10)] for i in range(40_000)}
