"""The positional inverted index: its tables and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsearch.functions.text import TokenOptions, chunks, tokens

BLOCK_BITS = (12, 24, 24)


@dataclass(frozen=True)
class Index:
    """docs (doc_id, file_name), postings (doc_id, tok, tf, positions), chunks (chunk_id, doc_id, chunk_no, text),
    doc_stats (doc_id, length). Statistics of terms and of the corpus are views of these, so they can't drift."""

    docs: DataFrame
    postings: DataFrame
    chunks: DataFrame
    doc_stats: DataFrame

    @property
    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("tok").agg(F.sum("tf").cast("long").alias("total_tf"), F.count("*").alias("df"))

    @property
    def corpus_stats(self) -> DataFrame:
        return corpus_stats(self.doc_stats)


def postings(docs: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """A row for each document and token: frequency and ordered positions. One shuffle, by document and token."""
    found = docs.select("doc_id", tokens(F.col("text"), options).alias("t"))
    placed = found.select("doc_id", F.posexplode("t").alias("pos", "tok"))
    return placed.groupBy("doc_id", "tok").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_stats(docs: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """A document's length is its number of distinct tokens; documents without tokens have 0 and count."""
    return docs.select("doc_id", F.size(F.array_distinct(tokens(F.col("text"), options))).cast("long").alias("length"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))


def running_total(counts: DataFrame, by: str, of: str, name: str, bits: tuple[int, ...] = BLOCK_BITS) -> DataFrame:
    """Adds the sum of ``of`` over rows of lesser ``by``, which are distinct 64-bit integers, sparse or dense.

    Ids share a block where they differ only in the first of ``bits`` low bits, blocks share one where they differ in the
    next, and so on: a task never holds more rows of a level than its bits allow, whatever the ids are.
    """
    level, total, base = f"block_{len(bits)}", f"sum_{len(bits)}", f"base_{len(bits)}"
    inside = (Window.partitionBy(level) if bits else Window).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(of).over(inside), F.lit(0))
    if not bits:
        return counts.withColumn(name, own.cast("long"))
    rows = counts.withColumn(level, F.shiftright(F.col(by).cast("long"), bits[0]))
    sums = running_total(rows.groupBy(level).agg(F.sum(of).alias(total)), level, total, base, bits[1:]).select(level, base)
    return rows.withColumn(name, own).join(sums, level).withColumn(name, (F.col(name) + F.col(base)).cast("long")).drop(level, base)


def chunk_table(docs: DataFrame, first_id: int = 0) -> DataFrame:
    """(chunk_id, doc_id, chunk_no, text): ids are dense and increase by document, then by place."""
    cut = docs.select("doc_id", chunks(F.col("text")).alias("c"))
    starts = running_total(cut.select("doc_id", F.size("c").alias("n")), "doc_id", "n", "start").select("doc_id", "start")
    placed = cut.select("doc_id", F.posexplode("c").alias("chunk_no", "text")).join(starts, "doc_id")
    return placed.select((F.col("start") + F.col("chunk_no") + first_id).cast("long").alias("chunk_id"), "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


def build(docs: DataFrame, options: TokenOptions = TokenOptions(), first_chunk: int = 0) -> Index:
    """The index of (doc_id, file_name, text)."""
    return Index(docs.select("doc_id", "file_name"), postings(docs, options), chunk_table(docs, first_chunk), doc_stats(docs, options))


def save(index: Index, path: str) -> None:
    """Postings lie by token, so that a query's tokens prune row groups."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.postings.repartitionByRange("tok").sortWithinPartitions("tok", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "chunks", "doc_stats")))


def without(index: Index, doc_ids: DataFrame) -> Index:
    """The index without some documents (a table of doc_id); statistics follow."""
    drop = lambda t: t.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return Index(*map(drop, (index.docs, index.postings, index.chunks, index.doc_stats)))


def merged(a: Index, b: Index) -> Index:
    return Index(*(x.unionByName(y) for x, y in zip((a.docs, a.postings, a.chunks, a.doc_stats), (b.docs, b.postings, b.chunks, b.doc_stats), strict=True)))


def has_docs(index: Index, doc_ids: DataFrame) -> DataFrame:
    return doc_ids.join(index.docs.select("doc_id"), "doc_id", "left_semi")


def chunk_text(index: Index, doc_id: int, chunk_id: int) -> DataFrame:
    """A pure lookup: no row if there is no such chunk."""
    return index.chunks.where((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id)).select("chunk_id", "doc_id", "text")


def whole_texts(chunk_rows: DataFrame) -> DataFrame:
    """(doc_id, text): a document's chunks in order without separator, which is its normal form."""
    placed = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    return chunk_rows.groupBy("doc_id").agg(F.array_join(F.transform(placed, lambda x: x["text"]), "").alias("text"))


def contexts(chunk_rows: DataFrame, n: int = 3, separator: str = " ") -> DataFrame:
    """(chunk_id, doc_id, context): the n chunks around each, shifted at a document's ends, so min(n, chunks) of them.

    n of 0 or less gives the empty string.
    """
    if n <= 0:
        return chunk_rows.select("chunk_id", "doc_id", F.lit("").alias("context"))
    by_place = Window.partitionBy("doc_id").orderBy("chunk_no")
    near = by_place.rowsBetween(-(n - 1), n - 1)
    rows = chunk_rows.select(
        "chunk_id", "doc_id", "chunk_no",
        F.collect_list("text").over(near).alias("around"), F.min("chunk_no").over(near).alias("first"),
        F.min("chunk_no").over(Window.partitionBy("doc_id")).alias("zero"), F.count("*").over(Window.partitionBy("doc_id")).alias("count"),
    )
    begin = F.greatest(F.col("zero"), F.least(F.col("chunk_no") - n // 2, F.col("zero") + F.col("count") - n))
    kept = F.slice("around", (begin - F.col("first") + 1).cast("int"), F.least(F.lit(n), F.col("count")).cast("int"))
    return rows.select("chunk_id", "doc_id", F.array_join(kept, separator).alias("context"))


def spread_apart(candidates: Column, most: int = 3) -> Column:
    """Of chunk ids in rank order those that aren't one of or next to a kept one, up to ``most``."""
    keep = lambda acc, c: F.when(F.exists(acc, lambda p: F.abs(p - c) <= 1) | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(c)))
    return F.aggregate(candidates, F.array().cast("array<bigint>"), keep)
