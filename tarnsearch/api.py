"""The engine: sources in, ranked results out. State is tables in versioned folders; every search is a lazy DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch import qa
from tarnsearch.functions.text import snippet
from tarnsearch.functions.vectors import HASHED, Provider
from tarnsearch.operators import index as ix
from tarnsearch.operators import manifest as mf
from tarnsearch.operators import rank, vectors
from tarnsearch.operators.rank import SearchMode
from tarnsearch.sources import crawl, files

_TABLES = {
    "docs": "doc_id long, file_name string",
    "postings": "doc_id long, tok string, tf long, positions array<int>",
    "chunks": "chunk_id long, doc_id long, chunk_no long, text string",
    "doc_stats": "doc_id long, length long",
    "vectors": "index_name string, chunk_id long, doc_id long, embedding array<double>",
    "manifest": mf.SCHEMA,
}
KEPT = 2  # versions before the one in force


def temporary(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``. Where that is unset, one of this machine on a local master, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("without a path a store needs spark.checkpoint.dir, a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tarnsearch-store-")


class Engine:
    """A store in a folder that all executors reach; without one it is temporary.

    A change writes new tables beside the old and then creates an empty file, current-<number>-<name>; the greatest
    number is the version in force, so no path that is read is overwritten and a crash leaves the last version whole. The
    KEPT versions before it stay, for results that still refer to them. One process changes a store at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, provider: Provider = HASHED, keyword_weight: float = 0.5, semantic_weight: float = 0.5):
        self.spark, self.provider = spark, provider
        self.path = (path or temporary(spark)).rstrip("/")
        self.set_weights(keyword_weight, semantic_weight)
        self.version = self._pointer()

    # State

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str) -> dict[int, list[str]]:
        """Names in the folder that begin with a prefix, by the number after it."""
        jvm, fs = self._hadoop()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        found: dict[int, list[str]] = {}
        for x in fs.listStatus(at) if fs.exists(at) else ():
            name = x.getPath().getName()
            if name.startswith(prefix):
                found.setdefault(int(name.split("-")[1]), []).append(name)
        return found

    def _pointer(self) -> str | None:
        found = self._numbers("current-")
        return "v-" + min(found[max(found)])[len("current-") :] if found else None

    def _table(self, name: str) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{self.version}/{name}")

    @property
    def index(self) -> ix.Index:
        return ix.Index(*(self._table(t) for t in ("docs", "postings", "chunks", "doc_stats")))

    @property
    def manifest(self) -> DataFrame:
        return self._table("manifest")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")

    def _commit(self, index: ix.Index, vector_rows: DataFrame, manifest: DataFrame) -> None:
        n = max(self._numbers("current-"), default=0) + 1
        if n != (int(self.version.split("-")[1]) if self.version else 0) + 1:
            raise RuntimeError("another process has changed the store; open it again")
        name = f"{n:012d}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/v-{name}"
        ix.save(index, at)
        vectors.save(vector_rows, f"{at}/vectors")
        manifest.write.mode("overwrite").parquet(f"{at}/manifest")
        jvm, fs = self._hadoop()
        path = jvm.org.apache.hadoop.fs.Path
        fs.createNewFile(path(f"{self.path}/current-{name}"))
        if self._pointer() != f"v-{name}":
            raise RuntimeError("another process has changed the store; open it again")
        self.version = f"v-{name}"
        for prefix in ("current-", "v-"):
            for k, names in self._numbers(prefix).items():
                for old in names if k < n - KEPT else ():
                    fs.delete(path(f"{self.path}/{old}"), True)

    # Sources

    def ingest(self, scan: DataFrame, scope: str | None = None, remove_missing: bool = False, force: bool = False) -> dict[str, int]:
        """Index (path, sha256, size, mtime, text) by the manifest's diff; returns the number of sources by action.

        With ``remove_missing`` known sources (under ``scope``) that the scan doesn't have are deleted. Sources of 0 bytes
        are tracked but not indexed. Nothing is written if nothing changed.
        """
        scan = scan.dropDuplicates(["path"]).persist()
        changes = mf.diff(scan, self.manifest, self.provider.name, force, scope)
        if not remove_missing:
            changes = changes.where("action <> 'missing'")
        changes = mf.numbered(changes, mf.next_id(self.manifest)).persist()
        counts = {r[0]: r[1] for r in changes.groupBy("action").count().collect()}
        if set(counts) - {"unchanged"}:
            gone = changes.where("action <> 'unchanged' and doc_id is not null").select("doc_id")
            put = changes.where(F.col("action").isin(*mf.PROCESS)).select("path", "doc_id").join(scan.where("size > 0"), "path")
            docs = put.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.coalesce("text", F.lit("")).alias("text"))
            kept = self.index
            first = int(kept.chunks.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0])
            new = ix.build(docs, first_chunk=first)
            rows = new.chunks.select("chunk_id", "doc_id", self.provider.column(F.col("text")).cast("array<double>").alias("embedding"))
            rows = vectors.prepared(rows.where("embedding is not null"), self.provider.dimension)
            old = vectors.without(self.vectors, doc_ids=gone)
            self._commit(ix.merged(ix.without(kept, gone), new), old.unionByName(rows), mf.applied(self.manifest, changes, self.provider.name))
        changes.unpersist()
        scan.unpersist()
        return counts

    def add_source(self, item: str | list[str], domain: bool = False, fetch: Callable[[str], bytes | None] | None = None, max_pages: int = crawl.PAGES) -> dict[str, int]:
        """A folder, file, URL, domain or literal text, or a list of these."""
        if isinstance(item, list):
            total: dict[str, int] = {}
            for one in item:
                for k, n in self.add_source(one, domain, fetch, max_pages).items():
                    total[k] = total.get(k, 0) + n
            return total
        kind = files.dispatch(item, domain)
        if kind == "folder":
            return self.ingest(files.read(self.spark, item), scope=item.rstrip("/"), remove_missing=True)
        if kind == "file":
            return self.ingest(files.read(self.spark, item))
        if kind == "text":
            return self.add_text(item)
        if fetch is None:
            raise ValueError("a URL needs a fetch function")
        host = item.split("/")[2]
        if kind == "domain":
            pages = crawl.online(self.spark, item, [host], fetch, max_pages=max_pages)
        else:
            from tarnsearch.functions.web import html_text

            one = self.spark.createDataFrame([(item,)], "url string")
            pages = crawl.fetched(one, fetch).select("url", html_text(F.col("html")).alias("text"))
        return self.ingest(files.from_texts(pages))

    def add_text(self, text: str) -> dict[str, int]:
        if not text.strip():
            raise ValueError("blank text")
        return self.ingest(files.from_texts(self.spark.createDataFrame([(text,)], "text string")))

    def add_pages(self, pages: DataFrame, start_url: str, domains: list[str], max_pages: int = crawl.PAGES) -> dict[str, int]:
        """Crawl a table of pages (url, html)."""
        return self.ingest(files.from_texts(crawl.from_pages(pages, start_url, domains, max_pages=max_pages)))

    def reembed(self, doc_id: int) -> bool:
        """Embed a document's chunks again."""
        chosen = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        index = self.index
        if ix.has_docs(index, chosen).isEmpty():
            return False
        rows = index.chunks.where(F.col("doc_id") == doc_id).select("chunk_id", "doc_id", self.provider.column(F.col("text")).cast("array<double>").alias("embedding"))
        new = vectors.prepared(rows, self.provider.dimension)
        model = F.when(F.col("doc_id") == doc_id, F.lit(self.provider.name)).otherwise(F.col("model"))
        self._commit(index, vectors.without(self.vectors, doc_ids=chosen).unionByName(new), self.manifest.withColumn("model", model))
        return True

    def delete(self, doc_id: int) -> bool:
        """Remove a source everywhere."""
        chosen = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        if self.manifest.join(chosen, "doc_id", "left_semi").isEmpty():
            return False
        self._commit(ix.without(self.index, chosen), vectors.without(self.vectors, doc_ids=chosen), self.manifest.join(chosen, "doc_id", "left_anti"))
        return True

    def clear(self) -> None:
        """Drop all tables; sources stay."""
        jvm, fs = self._hadoop()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)
        self.version = None

    def sources(self) -> DataFrame:
        return mf.sources(self.manifest, self._table("chunks"))

    def content(self, doc_id: int) -> DataFrame:
        return ix.whole_texts(self._table("chunks").where(F.col("doc_id") == doc_id))

    def chunk(self, doc_id: int, chunk_id: int) -> DataFrame:
        return ix.chunk_text(self.index, doc_id, chunk_id)

    # Search

    def set_weights(self, keyword_weight: float, semantic_weight: float) -> None:
        rank.check_weights(keyword_weight, semantic_weight)
        self.keyword_weight, self.semantic_weight = keyword_weight, semantic_weight

    def search(self, query: str, k: int = 3, mode: SearchMode | str = SearchMode.HYBRID, index_name: str = "data") -> DataFrame:
        """The k best results; an unknown mode is hybrid, a blank query an error."""
        if not query.strip():
            raise ValueError("blank query")
        mode = mode if isinstance(mode, SearchMode) else SearchMode(mode) if mode in {m.value for m in SearchMode} else SearchMode.HYBRID
        if mode is SearchMode.KEYWORD:
            return rank.keyword(self.index, query, k)
        rows = self.vectors.where(F.col("index_name") == index_name)
        vector = self.provider.one(query)
        if mode is SearchMode.SEMANTIC:
            return rank.semantic(self.index, rows, vector, k)
        return rank.hybrid(self.index, rows, query, vector, k, self.keyword_weight, self.semantic_weight)

    def answer(self, question: str, model: Callable[[str, str], str], k: int = 3) -> str:
        return qa.answer(self.search(question, k), question, model)


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("*")).alias("json"))


def show(results: DataFrame) -> None:
    """Print results, numbered from 1 on."""
    rank.numbered(results).orderBy("number").withColumn("chunk_text", F.transform("chunk_text", snippet)).show(truncate=200)


def simple_search(spark: SparkSession, sources: str | list[str], query: str, k: int = 3, mode: SearchMode | str = SearchMode.HYBRID) -> DataFrame:
    """Search in sources once, in a temporary store."""
    engine = Engine(spark)
    engine.add_source(sources)
    return engine.search(query, k, mode)


def simple_qa(spark: SparkSession, sources: str | list[str], question: str, model: Callable[[str, str], str], k: int = 3) -> str:
    engine = Engine(spark)
    engine.add_source(sources)
    return engine.answer(question, model, k)
