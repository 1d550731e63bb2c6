"""Continuous ingestion: new files reach the engine in micro-batches through the same diff as a batch scan.

File streams report neither deletions nor edits in place; a batch scan of the folder stays the authority for these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnsearch.api import Engine
from tarnsearch.functions.text import decoded
from tarnsearch.functions.web import html_text
from tarnsearch.sources.files import handler

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start(engine: Engine, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Ingest text, Markdown and HTML files as they appear; ``once`` stops after what is there."""
    stream = engine.spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        kind = handler(F.col("path"))
        text = F.when(kind == "html", html_text(decoded(F.col("content")))).otherwise(decoded(F.col("content")))
        rows = batch.where(kind.isin("txt", "markdown", "html")).select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), text.alias("text"),
        )
        engine.ingest(rows)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
