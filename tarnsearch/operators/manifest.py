"""Incremental re-indexing: what a scan of sources changes in the manifest of what is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions.text import base_name
from tarnsearch.operators.index import running_total

SCHEMA = "path string, sha256 string, size long, mtime double, doc_id long, model string"
SKIP, PROCESS = ("unchanged", "missing"), ("new", "changed", "model_changed")


def diff(scan: DataFrame, manifest: DataFrame, model: str, force: bool = False, scope: str | None = None) -> DataFrame:
    """(path, sha256, size, mtime, doc_id, action) of (path, sha256, size, mtime) against the manifest.

    Files and literal texts alike are found by path; a text's path holds its hash, so a changed text is a new source, and
    known content under another path is one too. Modification times don't matter. ``force`` processes what is unchanged.
    ``scope`` limits what can be missing to paths that begin with it. New sources have no doc_id yet.
    """
    old = manifest if scope is None else manifest.where(F.col("path").startswith(scope))
    old = old.select("path", F.col("sha256").alias("old_hash"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), "doc_id", F.col("model").alias("old_model"), F.lit(True).alias("known"))
    both = scan.select("path", "sha256", "size", "mtime", F.lit(True).alias("seen")).join(old, "path", "full")
    action = (
        F.when(F.col("seen").isNull(), "missing").when(F.col("known").isNull(), "new")
        .when(F.col("sha256") != F.col("old_hash"), "changed").when(~F.col("old_model").eqNullSafe(F.lit(model)), "model_changed")
        .otherwise("model_changed" if force else "unchanged")
    )
    return both.select("path", F.coalesce("sha256", "old_hash").alias("sha256"), F.coalesce("size", "old_size").alias("size"), F.coalesce("mtime", "old_mtime").alias("mtime"), "doc_id", action.alias("action"))


def next_id(manifest: DataFrame) -> int:
    return int(manifest.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0])


def numbered(changes: DataFrame, first: int) -> DataFrame:
    """Gives new sources ids from ``first`` on, in the order of a hash of their paths; the others keep theirs."""
    new = changes.where("action = 'new'").withColumn("h", F.xxhash64("path"))
    ones = running_total(new.groupBy("h").agg(F.count("*").alias("n")), "h", "n", "before").select("h", "before")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("h").orderBy("path")) - 1
    new = new.join(ones, "h").withColumn("doc_id", (F.col("before") + place + first).cast("long")).select(*changes.columns)
    return changes.where("action <> 'new'").unionByName(new)


def applied(manifest: DataFrame, changes: DataFrame, model: str) -> DataFrame:
    """The manifest after the changes, which have ids: processed sources replaced or added, missing ones removed."""
    gone = changes.where(~F.col("action").isin("unchanged")).select("path")
    put = changes.where(F.col("action").isin(*PROCESS))
    hashed = F.coalesce("sha256", F.concat(F.lit("empty_hash_"), F.col("doc_id").cast("string")))
    put = put.select("path", hashed.alias("sha256"), "size", "mtime", "doc_id", F.lit(model).alias("model"))
    return manifest.join(gone, "path", "left_anti").unionByName(put)


def changed_anything(changes: DataFrame) -> bool:
    """Whether there is something to write."""
    return not changes.where("action <> 'unchanged'").isEmpty()


def source_type(path: Column, exists: Column) -> Column:
    return (
        F.when(path.startswith("text_input/"), "text").when(path.rlike("^https?://"), "url")
        .when(exists.isNull(), "unknown").when(exists, "file").otherwise("file (missing)")
    )


def sources(manifest: DataFrame, chunks: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, name, size, mtime, chunk_count, type, model) by path; ``present`` has the paths that still exist."""
    counts = chunks.groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))
    rows = manifest.join(counts, "doc_id", "left")
    if present is None:
        rows = rows.withColumn("exists", F.lit(True))
    else:
        rows = rows.join(present.select("path", F.lit(True).alias("exists")).distinct(), "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    rows = rows.select("doc_id", "path", base_name(F.col("path")).alias("name"), "size", "mtime", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), source_type(F.col("path"), F.col("exists")).alias("type"), "model")
    return rows.orderBy("path")


def paths_of(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, path) of the documents named that the manifest has."""
    return manifest.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "path")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def stored(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest as written: with each document's chunk ids in order."""
    return manifest.join(chunk_ids(chunks), "doc_id", "left").withColumn("saved_at", F.current_timestamp())


def loaded(rows: DataFrame, model: str) -> DataFrame:
    """Rows with all that is needed; no model means the stored default."""
    needed = ("path", "sha256", "size", "mtime", "doc_id")
    return rows.where(" and ".join(f"{c} is not null" for c in needed)).select(*needed, F.coalesce("model", F.lit(model)).alias("model"))
