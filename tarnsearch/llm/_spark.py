"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: While settling: shuffle files go when a write ends, and descriptions of plans, which the driver keeps, are short.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tarnsearch.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarnsearch-")
        spark.conf.set("tarnsearch.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and any executor can be lost.

    The write's own shuffle files go when it ends, by Spark's setting for that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what settle() wrote, once nothing lazy refers to it any more."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x._settled_at)
        path.getFileSystem(x.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once it has a third of the heap. Left alone, the JVM first takes all the heap it may,
    and keeps broadcasts, shuffles and generated classes that only garbage refers to."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    heap = jvm.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    if used() > max(heap.maxMemory() // 3, 2 * getattr(context, "_tarnsearch_live", 0)):
        jvm.System.gc()
        context._tarnsearch_live = used()


def settle_tidy(df: DataFrame) -> DataFrame:
    """settle(), and then tidy(): for long chains of small writes."""
    out = settle(df)
    tidy(df.sparkSession)
    return out


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, so that they need not have it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_tarnsearch_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.suffix == ".zip" or not root.is_dir():
        return
    out = Path(tempfile.mkdtemp(prefix="tarnsearch-ship-")) / "tarnsearch_ship.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(out))
    context._tarnsearch_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
