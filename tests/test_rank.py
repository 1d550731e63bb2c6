import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsearch.functions import vectors as vf
from tarnsearch.functions.text import tokens_of
from tarnsearch.operators import index as ix
from tarnsearch.operators import rank, vectors

TEXTS = {
    1: "red fox jumps over lazy dog. red fox runs.",
    2: "lazy dog sleeps; brown dog barks",
    3: "the of and",
    4: "fox red fox",
    5: " ".join(f"filler{i} red." for i in range(80)) + " fox tail",
}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, f"d{i}.txt", t) for i, t in TEXTS.items()], "doc_id long, file_name string, text string")
    return ix.build(docs)


def model_proximity(lists: list[list[int]]) -> float:
    if len(lists) < 2:
        return 0.0
    best = 1_000_000
    for a in lists[0]:
        nexts = [min((p for p in one if p >= a), default=None) for one in lists]
        if None not in nexts:
            best = min(best, max(nexts) - a)
    return 1 / (1 + best)


def model_search(query: str) -> dict[int, tuple[float, float]]:
    docs = {i: tokens_of(t) for i, t in TEXTS.items()}
    q, n = tokens_of(query), len(docs)
    average = sum(len(set(t)) for t in docs.values()) / n
    out = {}
    for i, t in docs.items():
        total, lists = 0.0, []
        for w in q:
            if w in t:
                df = sum(w in x for x in docs.values()) * Counter(q)[w]
                tf = t.count(w)
                total += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (1.5 * (0.25 + 0.75 * len(set(t)) / average) + tf)
                lists.append([p for p, x in enumerate(t) if x == w])
        if lists:
            out[i] = total, total * (1 + model_proximity(lists))
    return out


@pytest.mark.parametrize("query", ["red fox", "fox red", "fox fox", "lazy dog zebra", "dog", "the red"])
def test_keyword_search_agrees_with_the_model(index, query):
    got = {r["doc_id"]: (r["bm25_score"], r["score"]) for r in rank.keyword_top(index, query, 10).collect()}
    want = model_search(query)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], abs=1e-8)


def test_a_query_without_tokens_finds_nothing(index):
    assert rank.keyword_top(index, "the of", 5).collect() == []


def test_documents_without_tokens_count_in_the_average(index):
    row = index.corpus_stats.first()
    assert row["n_docs"] == 5
    assert row["avg_length"] == pytest.approx(sum(len(set(tokens_of(t))) for t in TEXTS.values()) / 5)


@pytest.mark.parametrize(("lists", "want"), [([[3]], 0.0), ([[3], [3]], 1.0), ([[5], [1]], 1 / 1_000_001), ([[1, 10], [12], [2, 11]], 1 / 3)])
def test_proximity_cases(spark, lists, want):
    row = spark.createDataFrame([(lists,)], "l array<array<int>>").select(rank.proximity(F.col("l")).alias("p")).first()
    assert row["p"] == pytest.approx(want)
    assert model_proximity(lists) == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_context_windows_shift_at_the_ends(spark, n):
    rows = [(10 + i, 1, i, c) for i, c in enumerate("abcd")] + [(20, 2, 0, "z")]
    got = {r["chunk_id"]: r["context"] for r in ix.contexts(spark.createDataFrame(rows, "chunk_id long, doc_id long, chunk_no long, text string"), n).collect()}
    for i in range(4):
        width = min(n, 4)
        begin = max(0, min(i - n // 2, 4 - width))
        assert got[10 + i] == " ".join("abcd"[begin : begin + width])
    assert got[20] == ("z" if n else "")


def test_chunks_apart(spark):
    rows = spark.createDataFrame([([5, 6, 9, 8, 20, 30],), ([],)], "c array<bigint>").select(ix.spread_apart(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in rows] == [[5, 9, 20], []]


def test_weights_are_checked():
    rank.check_weights(0.3, 0.7)
    for bad in ((0.5, 0.6), (-0.1, 1.1)):
        with pytest.raises(ValueError):
            rank.check_weights(*bad)


def test_deleting_documents_gives_the_statistics_of_the_others(spark, index):
    left = ix.without(index, spark.createDataFrame([(5,)], "doc_id long"))
    docs = spark.createDataFrame([(i, "x", t) for i, t in TEXTS.items() if i != 5], "doc_id long, file_name string, text string")
    fresh = ix.build(docs)
    assert left.corpus_stats.collect() == fresh.corpus_stats.collect()
    assert sorted(left.term_stats.collect()) == sorted(fresh.term_stats.collect())


def test_fusion_keeps_to_the_candidates(spark, index):
    rows = index.chunks.select("chunk_id", "doc_id", vf.hashed(F.col("text")).alias("embedding"))
    store = vectors.prepared(rows, 64)
    got = rank.hybrid(index, store, "red fox", vf.hashed_of("red fox"), 3).collect()
    assert len(got) == 3 and got[0]["combined_score"] >= got[-1]["combined_score"]
    assert all(r["chunk_text"] for r in got)
    assert rank.hybrid(index, store, "zebra", vf.hashed_of("zebra"), 3).collect() == []
    only = rank.fused(index, store, "red fox", vf.hashed_of("red fox"), 4, 1.0, 0.0).collect()
    assert [r["bm25_score"] for r in only] == sorted((r["bm25_score"] for r in only), reverse=True)


def test_vector_tables(spark):
    rows = spark.createDataFrame([(0, 1, [3.0, 4.0]), (1, 1, [0.0, 0.0]), (2, 2, [-1.0, 0.0]), (2, 2, [-1.0, 0.0])], "chunk_id long, doc_id long, embedding array<float>")
    store = vectors.prepared(rows, 2)
    assert store.count() == 3
    assert vectors.vector_of(store, 0).first()["embedding"] == pytest.approx([0.6, 0.8])
    assert [r["chunk_id"] for r in vectors.search(store, [1.0, 0.0], 9).collect()] == [0, 1, 2]
    assert vectors.search(store, [], 3).collect() == []
    blocks = vectors.search_blocks(store, [[1.0, 0.0], [-1.0, 0.0]], 1).collect()
    assert {(r["query_no"], r["chunk_id"]) for r in blocks} == {(0, 0), (1, 2)}
    assert vectors.without(store, doc_ids=spark.createDataFrame([(1,)], "doc_id long")).count() == 1
    with pytest.raises(Exception, match="expected dimension"):
        vectors.prepared(rows, 3).collect()
    with pytest.raises(Exception, match="expected dimension"):
        vectors.search(store, [1.0, 0.0, 0.0], 3).collect()


def test_table_of_queries_in_blocks(spark):
    rng = np.random.default_rng(4)
    table = rng.normal(size=(90, 6))
    table[7] = table[3]  # a tie
    rows = spark.createDataFrame([(i, i % 4, [float(x) for x in v]) for i, v in enumerate(table)], "chunk_id long, doc_id long, embedding array<double>")
    store = vectors.prepared(rows, 6)
    asked = store.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    unit = table / np.linalg.norm(table, axis=1)[:, None]
    scores = np.round(unit @ unit.T, vectors.PLACES)
    want = {(q, int(i)) for q in range(0, 90, 3) for i in np.lexsort((np.arange(90), -scores[q]))[:4]}
    for sizes in ((1 << 16, 1 << 12), (20, 7)):
        assert {(r["query_id"], r["chunk_id"]) for r in vectors.search_table(store, asked, 4, rows=sizes[0], asked=sizes[1]).collect()} == want
    assert vectors.search_table(store.limit(0), asked, 4).count() == vectors.search_table(store, asked.limit(0), 4).count() == vectors.search_table(store, asked, 0).count() == 0


def test_running_total_of_sparse_ids(spark):
    rng = random.Random(9)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)} | {-(1 << 63), -1, 0, 1, 4095, 4096, (1 << 63) - 1} | set(range(5000, 5100)))
    counts = {i: rng.randrange(5) for i in ids}
    rows = spark.createDataFrame(list(counts.items()), "id long, n int")
    got = {r["id"]: r["start"] for r in ix.running_total(rows, "id", "n", "start").collect()}
    total = 0
    for i in ids:
        assert got[i] == total
        total += counts[i]


def test_results_are_numbered(spark):
    rows = spark.createDataFrame([(5, [2], 0.1), (4, [1], 0.7), (3, [0], 0.7)], "doc_id long, chunk_id array<long>, combined_score double")
    assert [(r["number"], r["doc_id"]) for r in rank.numbered(rows).orderBy("number").collect()] == [(1, 3), (2, 4), (3, 5)]
