"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

The index is built and stored once, as in use; searches read the stored tables.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from tarnsearch.functions import vectors as vf
from tarnsearch.operators import index as ix
from tarnsearch.operators import rank, vectors
from tarnsearch.plans.queries import QUERIES
from tarnsearch.session import local_session

TABLE_QUERIES = ("doc_frequency", "chunk_documents", "close_chunks", "vector_topk", "page_links", "html_text", "manifest_diff", "duplicate_content")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # start-up isn't measured
    home = tempfile.mkdtemp(prefix="tarnsearch-bench-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("file_name"), "text")
    timed("index_build", lambda: ix.save(ix.build(docs), f"{home}/index"))
    index = ix.load(spark, f"{home}/index")
    embedded = index.chunks.select("chunk_id", "doc_id", vf.hashed(F.col("text")).alias("embedding"))
    timed("embed_chunks", lambda: vectors.save(vectors.prepared(embedded, vf.HASH_DIMENSION), f"{home}/vectors"))
    store = vectors.load(spark, f"{home}/vectors", "data", vf.HASH_DIMENSION)
    ask = "that que des"
    timed("keyword_search", lambda: rank.keyword(index, ask, 10).collect())
    timed("semantic_search", lambda: rank.semantic(index, store, vf.hashed_of(ask), 10).collect())
    timed("hybrid_search", lambda: rank.hybrid(index, store, ask, vf.hashed_of(ask), 10).collect())
    for name in TABLE_QUERIES:
        timed(name, lambda n=name: done(QUERIES[n](spark, sf_dir)))
    shutil.rmtree(home, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
