"""Named vector tables and exact search by inner product of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.functions.vectors import checked, dot, literal, norm, unit

PLACES = 9  # scores that agree so far are ties, broken by id


def prepared(rows: DataFrame, dimension: int, index_name: str = "data") -> DataFrame:
    """(index_name, chunk_id, doc_id, embedding) from (chunk_id, doc_id, embedding): checked, unit length, an id once."""
    rows = rows.select(F.lit(index_name).alias("index_name"), "chunk_id", "doc_id", unit(checked(F.col("embedding"), dimension)).alias("embedding"))
    return rows.dropDuplicates(["chunk_id"])


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").partitionBy("index_name").parquet(path)


def load(spark: SparkSession, path: str, index_name: str, dimension: int) -> DataFrame:
    """One index; rows of another dimension are skipped."""
    return spark.read.parquet(path).where((F.col("index_name") == index_name) & (F.size("embedding") == dimension))


def search(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id") -> DataFrame:
    """(id, doc_id, similarity) of the k nearest, best first. An empty query vector or k < 1 finds nothing.

    The query is a literal, so the plan is a scan, a projection and a top-k; negative scores are kept. Vectors of another
    dimension than the query's are an error.
    """
    if not query or k < 1:
        return vectors.select(id_col, "doc_id", F.lit(0.0).alias("similarity")).limit(0)
    q = unit_list(query)
    scored = vectors.select(id_col, "doc_id", F.round(dot(checked(F.col("embedding"), len(q)), literal(q)), PLACES).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def search_blocks(vectors: DataFrame, queries: list[list[float]], k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_no, id, doc_id, similarity) for many queries at once: a matrix product for each Arrow batch.

    A task sends its k best a query; a final top-k joins them. Vectors should be of unit length.
    """
    wanted = np.array([unit_list(q) for q in queries], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in wanted]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(flat.reshape(batch.num_rows, -1) @ wanted.T, PLACES)
            ids, docs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for j in range(len(wanted)):
                at = np.lexsort((ids, -scores[:, j]))[:k]
                best[j] = sorted(best[j] + [(-float(scores[i, j]), int(ids[i]), int(docs[i])) for i in at])[:k]
        rows = [(j, i, d, -s) for j, found in enumerate(best) for s, i, d in found]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_no", id_col, "doc_id", "similarity"])

    from pyspark.sql import Window

    part = vectors.select(F.col(id_col).cast("long"), F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"))
    found = part.mapInArrow(run, f"query_no long, {id_col} long, doc_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search_table(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", rows: int = 1 << 16, asked: int = 1 << 12) -> DataFrame:
    """(query_id, id, doc_id, similarity): of each query vector (query_id, embedding) the k best of all vectors.

    Vectors lie in blocks of about ``rows``, queries in blocks of about ``asked``, by hashes of their ids. Each pair of
    blocks is one matrix product in a task, which sends its k best a query; a window joins them. Nothing goes to the
    driver but two counts. Ids of each side are distinct, vectors of unit length; ties go to the lesser id.
    """
    from pyspark.sql import Window

    schema = f"query_id long, {id_col} long, doc_id long, similarity double"
    n, m = (max(1, -(-x.count() // size)) for x, size in ((vectors, rows), (queries, asked)))
    block = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = vectors.select(block(id_col, n).alias("g"), every(m).alias("h"), F.col(id_col).cast("long"), F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"))
    right = queries.select(every(n).alias("g"), block("query_id", m).alias("h"), F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))

    def run(part: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", id_col, "doc_id", "similarity"]
        if not part.num_rows or not wanted.num_rows or k < 1:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names)
        a, b = (np.asarray(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (part, wanted))
        ids, docs = (np.asarray(part.column(c), np.int64) for c in (id_col, "doc_id"))
        found = []
        for at in range(0, len(b), 64):
            scores = np.round(b[at : at + 64] @ a.T, PLACES)
            found += [(np.lexsort((ids, -s))[:k], s) for s in scores]
        best = np.concatenate([x for x, _ in found])
        asker = np.repeat(np.asarray(wanted.column("query_id"), np.int64), [len(x) for x, _ in found])
        return pa.table([pa.array(asker), pa.array(ids[best]), pa.array(docs[best]), pa.array(np.concatenate([s[x] for x, s in found]))], names)

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def unit_list(v: list[float]) -> list[float]:
    n = float(np.sqrt(np.square(np.asarray(v, dtype=np.float64)).sum()))
    return [float(x) / n for x in v] if n else [float(x) for x in v]


def without(vectors: DataFrame, chunk_ids: DataFrame | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """Without some chunks, or if none are named, without some documents."""
    if chunk_ids is not None:
        return vectors.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return vectors.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") if doc_ids is not None else vectors


def count_of(vectors: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """How many vectors a deletion removes."""
    return vectors.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("n"))


def vector_of(vectors: DataFrame, chunk_id: int) -> DataFrame:
    return vectors.where(F.col("chunk_id") == chunk_id).select("chunk_id", "embedding")


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("chunk_id", norm(F.col("embedding")).alias("norm"))
