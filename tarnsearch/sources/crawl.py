"""Pages of a domain, breadth first, as joins of a frontier with links and without what was visited."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnsearch.functions.text import safe_name
from tarnsearch.functions.web import PARTS, absolute, banned, html_text, in_scope, links, normal_url

LINKS_A_PAGE, PAGES = 100, 20


def accepted_links(pages: DataFrame, domains: list[str] | None, prefix: str = "") -> DataFrame:
    """(src, dst, place): normal, in scope, not banned links of (url, html) to other pages, each at its first place.

    ``domains`` None: the hosts of the table's own pages.
    """
    found = pages.select(normal_url(F.col("url")).alias("src"), F.posexplode(links(F.col("html"))).alias("place", "href"), "url")
    found = found.select("src", "place", normal_url(absolute(F.col("href"), F.col("url"))).alias("dst")).where(~banned(F.col("dst")) & (F.col("dst") != F.col("src")))
    if domains is None:
        hosts = pages.select(F.regexp_extract("url", PARTS, 2).alias("host")).distinct()
        found = found.join(hosts, F.regexp_extract("dst", PARTS, 2) == F.col("host"), "left_semi")
        found = found.where(F.regexp_extract("dst", PARTS, 3).startswith(prefix))
    else:
        found = found.where(in_scope(F.col("dst"), domains, prefix))
    return found.groupBy("src", "dst").agg(F.min("place").alias("place"))


def first_links(rows: DataFrame, most: int = LINKS_A_PAGE) -> DataFrame:
    """The first ``most`` links of each page."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("place"))
    return rows.withColumn("n", place).where(F.col("n") <= most).select("src", "dst")


def page_links(pages: DataFrame, domains: list[str] | None, prefix: str = "", most: int = LINKS_A_PAGE) -> DataFrame:
    """(src, dst): the first ``most`` accepted links of each page; links that aren't accepted don't count."""
    return first_links(accepted_links(pages, domains, prefix), most)


def frontier(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what is reached from ``start`` (url) in at most ``depth`` steps, at its least depth."""
    visited = start.select("url").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        edge = visited.where(F.col("depth") == d - 1)
        new = edge.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        new = new.join(visited.select("url"), "url", "left_anti")
        visited = visited.unionByName(new.withColumn("depth", F.lit(d)))
    return visited


def from_pages(pages: DataFrame, start_url: str, domains: list[str], prefix: str = "", max_pages: int = PAGES, depth: int | None = None) -> DataFrame:
    """(url, text) of the pages reached over a table of pages, at most ``max_pages``, nearest first. State is this call's.

    Levels are followed until one brings no page or there are pages enough; ``depth`` sets an end before that. Of a page's
    accepted links those count that no level before has seen.
    """
    spark = pages.sparkSession
    edges = accepted_links(pages, domains, prefix).persist()
    known = pages.select(normal_url(F.col("url")).alias("url"), html_text(F.col("html"), " ").alias("text")).where("text <> ''").persist()
    level = spark.createDataFrame([(start_url,)], "url string").select(normal_url(F.col("url")).alias("url"))
    reached, d, n = [(level.first()[0], 0)], 0, 0
    seen = spark.createDataFrame(reached, "url string, depth int")
    while True:
        n += level.join(known, "url", "left_semi").count()
        if n >= max_pages or d == depth:
            break
        d += 1
        new = edges.join(level, F.col("src") == F.col("url"), "left_semi").join(seen, F.col("dst") == F.col("url"), "left_anti")
        # Fewer than max_pages pages are followed, so urls here are at most LINKS_A_PAGE times that: their plans are cut.
        found = [(r[0],) for r in first_links(new).select("dst").distinct().collect()]
        if not found:
            break
        level = spark.createDataFrame(found, "url string")
        reached += [(url, d) for (url,) in found]
        seen = spark.createDataFrame(reached, "url string, depth int")
    out = seen.join(known, "url").orderBy("depth", "url").limit(max_pages).select("url", "text")
    rows = out.collect()  # max_pages at most
    edges.unpersist()
    known.unpersist()
    return spark.createDataFrame(rows, "url string, text string")


def fetched(urls: DataFrame, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """(url, html) by a caller's fetch function on the executors; a failed request gives the empty page."""

    def get(url: str) -> str:
        try:
            return (fetch(url) or b"").decode("utf-8", "replace")
        except Exception:
            return ""

    @F.pandas_udf(StringType())
    def run(url: pd.Series) -> pd.Series:
        return url.map(get)

    return urls.select("url", run(F.col("url")).alias("html"))


def online(spark: SparkSession, start_url: str, domains: list[str], fetch: Callable[[str], bytes | None], prefix: str = "", max_pages: int = PAGES, depth: int | None = None) -> DataFrame:
    """from_pages() over the network: each level's pages are fetched in parallel, once, and kept."""
    begin = spark.createDataFrame([(start_url,)], "url string").select(normal_url(F.col("url")).alias("url"))
    pages, level, seen, kept, d = None, begin, begin, [], 0
    while True:
        kept.append(got := fetched(level, fetch).withColumn("depth", F.lit(d)).persist())
        pages = got if pages is None else pages.unionByName(got)
        if (left := max_pages - pages.where("html <> ''").count()) <= 0 or d == depth:
            break
        d += 1
        new = accepted_links(got, domains, prefix).join(seen, F.col("dst") == F.col("url"), "left_anti")
        level = first_links(new).groupBy(F.col("dst").alias("url")).agg(F.lit(1).alias("one")).orderBy("url").limit(left).select("url")
        seen = seen.unionByName(level)
        if level.isEmpty():
            break
    out = pages.select("depth", "url", html_text(F.col("html"), " ").alias("text")).where("text <> ''").orderBy("depth", "url").limit(max_pages)
    rows = out.select("url", "text").collect()  # max_pages at most
    for x in kept:
        x.unpersist()
    return spark.createDataFrame(rows, "url string, text string")


def as_sources(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, text): by a safe file name in a folder, or if none by the hash of the text."""
    if folder is None:
        from tarnsearch.functions.text import text_path

        return pages.select(text_path(F.col("text")).alias("path"), "text").dropDuplicates(["path"])
    return pages.select(F.concat(F.lit(folder.rstrip("/") + "/"), safe_name(F.col("url")), F.lit(".txt")).alias("path"), "text")


def saved(pages: DataFrame, folder: str) -> None:
    pages.write.mode("overwrite").parquet(folder)


def ranked_links(pages: DataFrame) -> DataFrame:
    """(url, place, href) of all links of (url, html), as written."""
    return pages.select("url", F.posexplode(links(F.col("html"))).alias("place", "href"))
