"""Keyword, semantic and fused ranking."""

from __future__ import annotations

from collections import Counter
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.functions.text import TokenOptions, tokens_of
from tarnsearch.functions.vectors import bound
from tarnsearch.operators.index import Index, contexts, spread_apart
from tarnsearch.operators.vectors import search as nearest

K1, B = 1.5, 0.75
CANDIDATES = 10
PLACES = 9
NO_TEXT = "No relevant chunk identified"
FAR = 1_000_000


class SearchMode(Enum):
    HYBRID = "hybrid"
    SEMANTIC = "semantic"
    KEYWORD = "keyword"


def term_weights(index: Index, query: list[str]) -> DataFrame:
    """(doc_id, tok, tf, positions, weight): BM25 of one occurrence of each query token in each document that has it.

    A token that the query has m times counts as in m times as many documents, as its occurrences are counted each.
    """
    times = Counter(query)
    hits = index.postings.where(F.col("tok").isin(*times))
    m = F.element_at(F.create_map(*(F.lit(x) for t, n in times.items() for x in (t, n))), F.col("tok"))
    frequency = F.broadcast(hits.groupBy("tok").agg(F.count("*").alias("df")))  # a row a query token
    rows = hits.join(frequency, "tok").join(index.doc_stats, "doc_id").crossJoin(F.broadcast(index.corpus_stats))  # one row
    df = F.col("df") * m
    idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (K1 * (1 - B + B * F.col("length") / F.col("avg_length")) + F.col("tf"))
    return rows.select("doc_id", "tok", "tf", "positions", (idf * tf).alias("weight"))


def proximity(lists: Column) -> Column:
    """1 / (1 + d): from an occurrence of the first list to the last of the others' next ones, the least such distance d.

    Only order forwards from the first list counts. Fewer than two lists give 0; if there is no such occurrence, d is FAR.
    """

    def of(lists: Column) -> Column:
        reach = lambda a: F.array_max(F.transform(lists, lambda one: F.array_min(F.filter(one, lambda p: p >= a)))) - a
        possible = lambda a: F.forall(lists, lambda one: F.element_at(one, -1) >= a)
        spans = F.transform(F.element_at(lists, 1), lambda a: F.when(possible(a), reach(a)))
        least = F.coalesce(F.array_min(F.filter(spans, lambda x: x.isNotNull())), F.lit(FAR))
        return F.when(F.size(lists) < 2, F.lit(0.0)).otherwise(1.0 / (1 + least))

    return bound(lists, of)


def keyword_hits(index: Index, query: list[str]) -> DataFrame:
    """(doc_id, bm25_score, proximity, score, positions, all_terms_present) of every document with a query token."""
    times = Counter(query)
    weighted = term_weights(index, query)
    m = F.element_at(F.create_map(*(F.lit(x) for t, n in times.items() for x in (t, n))), F.col("tok"))
    entry = F.struct("tok", F.struct("positions", F.col("tf").cast("int").alias("term_frequency")))
    found = weighted.groupBy("doc_id").agg(F.sum(F.col("weight") * m).alias("bm25"), F.map_from_entries(F.collect_list(entry)).alias("positions"), F.count("*").alias("n"))
    lists = F.filter(F.transform(F.array(*map(F.lit, query)), lambda t: F.col("positions")[t]["positions"]), lambda x: x.isNotNull())
    found = found.withColumn("proximity", proximity(lists))
    return found.select(
        "doc_id", F.round("bm25", PLACES).alias("bm25_score"), "proximity", F.round(F.col("bm25") * (1 + F.col("proximity")), PLACES).alias("score"),
        "positions", (F.col("n") == len(times)).alias("all_terms_present"),
    )


def _nothing(index: Index) -> DataFrame:
    schema = "doc_id long, bm25_score double, proximity double, score double, positions map<string,struct<positions:array<int>,term_frequency:int>>, all_terms_present boolean"
    return index.docs.sparkSession.createDataFrame([], schema)


def keyword_top(index: Index, query: str, n: int = 5, options: TokenOptions = TokenOptions()) -> DataFrame:
    """The n best by BM25 with proximity; ties go to the lesser doc_id. A query without tokens finds nothing."""
    words = tokens_of(query, options)
    return keyword_hits(index, words).orderBy(F.desc("score"), "doc_id").limit(n) if words and n > 0 else _nothing(index)


RESULT = ("doc_id", "file_name", "bm25_score", "semantic_score", "combined_score", "positions", "all_terms_present", "chunk_id", "chunk_text")
_POSITIONS = "map<string,struct<positions:array<int>,term_frequency:int>>"


def _named(index: Index, rows: DataFrame) -> DataFrame:
    named = rows.join(index.docs, "doc_id", "left")
    return named.withColumn("file_name", F.coalesce("file_name", F.lit("Unknown")))


def keyword(index: Index, query: str, k: int = 3) -> DataFrame:
    """Cut to k by score with proximity, then in the order of BM25 without. Keyword hits carry no chunks."""
    rows = _named(index, keyword_top(index, query, k))
    rows = rows.withColumns({"semantic_score": F.lit(None).cast("double"), "combined_score": F.col("bm25_score"), "chunk_id": F.array().cast("array<bigint>"), "chunk_text": F.array().cast("array<string>")})
    return rows.select(*RESULT).orderBy(F.desc("bm25_score"), "doc_id")


def semantic(index: Index, vectors: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """The k nearest chunks, a result each, best first; ids without a document are dropped after the cut."""
    found = nearest(vectors.select("chunk_id", "doc_id", "embedding"), query, k).select("chunk_id", "similarity")
    rows = _named(index, found.join(index.chunks.select("chunk_id", "doc_id", "text"), "chunk_id"))
    rows = rows.select(
        "doc_id", "file_name", F.lit(0.0).alias("bm25_score"), F.col("similarity").alias("semantic_score"), F.col("similarity").alias("combined_score"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<positions:array<int>,term_frequency:int>>")).alias("positions"),
        F.lit(False).alias("all_terms_present"), F.array("chunk_id").alias("chunk_id"), F.array("text").alias("chunk_text"),
    )
    return rows.orderBy(F.desc("combined_score"), F.col("chunk_id")[0])


def numbered(results: DataFrame, order: str = "combined_score") -> DataFrame:
    """Results, k rows at most, with their number from 1 on, the best first."""
    place = F.row_number().over(Window.orderBy(F.desc(order), "doc_id", "chunk_id"))
    return results.select(place.cast("long").alias("number"), *results.columns)


def check_weights(keyword_weight: float, semantic_weight: float) -> None:
    if not (0 <= keyword_weight <= 1 and 0 <= semantic_weight <= 1):
        raise ValueError("weights must be between 0 and 1")
    if abs(keyword_weight + semantic_weight - 1) > 1e-6:
        raise ValueError("weights must add up to 1")


def fused(index: Index, vectors: DataFrame, query: str, vector: list[float], k: int = 3, keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """(doc_id, bm25_score, semantic_score, combined_score, positions, all_terms_present, candidates), the k best.

    Both sides give CANDIDATES * k candidates, so the result for a k isn't the start of that for a larger one. Without
    keyword candidates there is no result. BM25, without proximity, is scaled by the candidates' best; a document's
    semantic score is the mean of its best three chunks with a score of 0 or more. ``candidates`` are those in order.
    """
    check_weights(keyword_weight, semantic_weight)
    left = keyword_top(index, query, k * CANDIDATES)
    top = left.agg(F.max("bm25_score").alias("best"))
    right = nearest(vectors.select("chunk_id", "doc_id", "embedding"), vector, k * CANDIDATES).select("chunk_id", "similarity").where("similarity >= 0")
    right = right.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "chunk_id"))
    right = right.withColumn("place", place).where("place <= 3").groupBy("doc_id").agg(
        F.avg("similarity").alias("near"), F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("candidates"))
    rows = left.join(right, "doc_id", "full").crossJoin(F.broadcast(top)).where("best is not null")
    bm25, near = F.coalesce("bm25_score", F.lit(0.0)), F.coalesce("near", F.lit(0.0))
    scaled = bm25 / F.coalesce(F.nullif("best", F.lit(0.0)), F.lit(1.0))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<positions:array<int>,term_frequency:int>>"))
    rows = rows.select(
        "doc_id", bm25.alias("bm25_score"), near.alias("semantic_score"), F.round(scaled * keyword_weight + near * semantic_weight, PLACES).alias("combined_score"),
        F.coalesce("positions", empty.cast(_POSITIONS)).alias("positions"), F.coalesce("all_terms_present", F.lit(False)).alias("all_terms_present"),
        F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"),
    )
    return rows.orderBy(F.desc("combined_score"), "doc_id").limit(k)


def hybrid(index: Index, vectors: DataFrame, query: str, vector: list[float], k: int = 3, keyword_weight: float = 0.5, semantic_weight: float = 0.5, around: int = 3) -> DataFrame:
    """fused() with names and context: of each document up to three chunks apart, each with its neighbours."""
    rows = fused(index, vectors, query, vector, k, keyword_weight, semantic_weight).withColumn("chunk_id", spread_apart(F.col("candidates")))
    found_in = (F.col("bm25_score") > 0) | (F.size(F.map_keys("positions")) > 0)
    rows = _named(index, rows).withColumn("file_name", F.when(found_in, F.col("file_name")).otherwise(F.lit("Unknown")))
    wanted = rows.select("doc_id", F.posexplode("chunk_id").alias("place", "one"))
    texts = contexts(index.chunks.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi"), around)  # k rows at most
    texts = wanted.join(texts.select(F.col("chunk_id").alias("one"), "context"), "one").withColumn("context", F.trim("context")).where("context <> ''")
    texts = texts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "context"))), lambda x: x["context"]).alias("chunk_text"))
    rows = rows.join(texts, "doc_id", "left").withColumn("chunk_text", F.coalesce("chunk_text", F.array(F.lit(NO_TEXT))))
    return rows.select(*RESULT).orderBy(F.desc("combined_score"), "doc_id")
