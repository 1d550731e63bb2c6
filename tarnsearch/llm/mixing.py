"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size. The mix's total is shared by weight; no source is taken more than ``max_epochs``
times, and what a clamped source can't take is reshared by weight among the others until none is above its clamp. With
sources in the order of clamp/weight this level is found in one pass of prefix sums, in whole numbers until one last
division. A source's target becomes whole repetitions of all its documents and one fractional repetition: the documents
that come first in a seeded hash order, up to the target.

No task holds a whole source: prefix sums run over hash buckets of a source, then over the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.llm._spark import settle

WORD = r"[^\x20\x09-\x0D]+"
HEX_OF_BUCKET = 3  # 4096 buckets a source


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): size counts the words; null is 0."""
    size = F.coalesce(F.expr(f"regexp_count({'`' + text_col + '`'}, r'{WORD}')"), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size, weight); the total is the sum of the sizes.

    All windows run over the table of sources, a row each. Empty sources get 0.
    """
    m = max_epochs
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") * m / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = sources.select(
        "*",
        F.row_number().over(order).alias("k"),
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), zero).alias("clamped"),
        F.coalesce(F.sum("weight").over(before), zero).alias("clamped_weight"),
    )
    left, share = F.col("total") - F.col("clamped") * m, F.col("weights") - F.col("clamped_weight")
    fits = left * F.col("weight") <= F.col("source_size") * m * share
    out = out.withColumn("at", F.min(F.when(fits, F.col("k"))).over(every))
    out = out.withColumn("level", F.max(F.when(F.col("k") == F.col("at"), left / share)).over(every))
    cap = (F.col("source_size") * m).cast("double")
    return out.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, repeating, to sources by code point with null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("long"))


def mix(sizes: DataFrame, weights=cyclic_weights, max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of (doc_id, source, size).

    ``weights`` adds ``weight`` to the table (source, source_size). ``copies`` is how many times the document is taken.
    A null source is a source; null ids, repeated rows and size 0 are allowed; an empty table gives an empty one. Each
    source's taken words differ from its target by half a document's size at most. The same rows give the same mix.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sizes.select("doc_id", "source", "size", key.alias("key")).withColumn("bucket", F.substring("key", 1, HEX_OF_BUCKET))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = water_fill(weights(sources), max_epochs).withColumnRenamed("source", "of")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0).cast("long")))
    buckets = buckets.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("bucket").alias("bucket_"), "earlier", "source_size", "target"
    )
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("bucket_")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("before", before)
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    more = (F.col("whole") < max_epochs) & (F.col("before") * 2 + F.col("size") <= wanted * 2)
    copies = F.col("whole") + more.cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """mix() over documents; the sizes are counted once and kept in the shared folder."""
    return mix(settle(sized(docs)))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {{docs}}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
c AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
  coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clamped,
  coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clamped_weight
  FROM w WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
f AS (SELECT *, (total - clamped * 3)::DOUBLE / (weights - clamped_weight) AS lvl,
  min(CASE WHEN (total - clamped * 3) * weight <= source_size * 3 * (weights - clamped_weight) THEN k END) OVER () AS here FROM c),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE,
  max(CASE WHEN k = here THEN lvl END) OVER () * weight) AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, whole + CASE WHEN whole < 3 AND before * 2 + size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM p
"""
