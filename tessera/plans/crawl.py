"""Crawls as level-by-level plans: a page with its documents, breadth-first over a site, numbered addresses, and previews.

A fetch function is supplied by the caller and runs on the executors; tests and replays use a table of pages instead. Each
level is written through `save`, so a deep crawl neither fetches a page twice nor grows its plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.cluster import kept
from tessera.functions.text import host, without_fragment
from tessera.operators import crawl, versioning
from tessera.sources.files import fetched
from tessera.sources.lake import Table

Fetch = Callable[[str], tuple[int, str | None, bytes]]
Save = Callable[[DataFrame, str], DataFrame]
PAGES_AT_MOST = 50


def from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Reads pages (url, html) instead of fetching them."""
    by_url = pages.groupBy(without_fragment(F.col("url")).alias("url")).agg(F.min("html").alias("html"))
    return lambda urls: urls.join(by_url, "url").select("url", F.lit(200).alias("status"), "html")


def from_web(fetch: Fetch) -> Callable[[DataFrame], DataFrame]:
    return lambda urls: fetched(urls, fetch).select("url", "status", F.decode("content", "UTF-8").alias("html"))


def breadth_first(seeds: DataFrame, read: Callable[[DataFrame], DataFrame], save: Save, depth: int = 2, most: int = PAGES_AT_MOST, hosts: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(pages with depth, documents with the page they were found on, whether the limit cut the crawl short)."""
    front = seeds.select(without_fragment(F.col("url")).alias("url")).distinct()
    pages = links = None
    left, cut = most, False
    for level in range(depth + 1):
        waiting = save(front, f"front-{level}")
        n = waiting.count()
        if not n or left <= 0:
            cut = cut or n > 0
            break
        cut = cut or n > left
        chosen = waiting.orderBy("url").limit(left)
        got = save(read(chosen).withColumn("depth", F.lit(level)), f"pages-{level}")
        left -= min(n, left)
        numbered = got.filter("status = 200").select(F.xxhash64("url").alias("page_id"), "url", "html")
        found = save(crawl.links(numbered), f"links-{level}")
        pages = got if pages is None else pages.unionByName(got)
        links = found if links is None else links.unionByName(found)
        further = crawl.page_links(found).select(F.col("target").alias("url")).distinct()
        if hosts is not None:
            further = further.filter(host(F.col("url")).isin([h.lower() for h in hosts]))
        front = further.join(pages.select("url"), "url", "left_anti")
    documents = crawl.document_links(links).groupBy("target").agg(F.min_by(F.struct("url", "anchor_text", "extension"), F.struct("url", "place")).alias("d"))
    return pages, documents.select("target", F.col("d.url").alias("source_url"), "d.anchor_text", "d.extension"), cut


def by_host(waiting: DataFrame, most: int) -> DataFrame:
    """waiting (url, found) with `turn`: true for the first `most` addresses of each host, by level and then by name."""
    first = Window.partitionBy(host(F.col("url"))).orderBy("found", "url")
    turns = waiting.select("url", F.row_number().over(first).alias("nth")).filter(F.col("nth") <= most).select("url", F.lit(True).alias("turn"))
    return waiting.join(turns, "url", "left").withColumn("turn", F.coalesce("turn", F.lit(False)))


def crawl_sites(seeds: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str, rounds: int, per_host: int, hosts: list[str] | None = None, buckets: int = 16) -> Table:
    """A crawl of many sites at once, round by round: at most `per_host` addresses of each host a round, the others wait for the next.

    What is known stands in a table under the folder, by address: url, the round in which it was found, the round in which it was visited and
    its status (null while it waits). A crawl that was stopped, or given more rounds, goes on from there; its seeds are added to what is
    known. Nothing is counted or sorted over all hosts: turns are taken within a host, and a round is read dealt by host.
    """
    spark = seeds.sparkSession
    schema = StructType.fromDDL("url string, found int, visited int, status int")
    known = Table(spark, f"{folder}/known")
    if not known.exists():
        known = Table.create(spark, f"{folder}/known", "url", schema, buckets)
    fresh = seeds.select(without_fragment(F.col("url")).alias("url")).distinct().join(known.read().select("url"), "url", "left_anti")
    begun = known.read().agg(F.max("visited")).first()[0]
    begin = 0 if begun is None else begun + 1
    known.append(fresh.select("url", F.lit(begin).alias("found"), F.lit(None).cast("int").alias("visited"), F.lit(None).cast("int").alias("status")))
    for level in range(begin, begin + rounds):
        waiting = known.read().filter("visited IS NULL").select("url", "found")
        chosen = kept(by_host(waiting, per_host).filter("turn").select("url"), "chosen")
        if chosen.isEmpty():
            break
        got = kept(read(chosen.repartition(host(F.col("url")))), "fetched")
        links = crawl.links(got.filter("status = 200").select(F.xxhash64("url").alias("page_id"), "url", "html"))
        further = crawl.page_links(links).select(F.col("target").alias("url")).distinct()
        if hosts is not None:
            further = further.filter(host(F.col("url")).isin([h.lower() for h in hosts]))
        # an address that couldn't be read has no row; it is visited all the same
        seen = chosen.join(got.groupBy("url").agg(F.min("status").alias("status")), "url", "left").select("url", F.coalesce("status", F.lit(404)).alias("s"))
        rows = kept(seen.withColumn("was", F.lit(True)).unionByName(further.join(known.read().select("url"), "url", "left_anti").withColumn("was", F.lit(False)), allowMissingColumns=True), "round")
        known.change(rows, lambda old: _after_round(old, rows, level), f"round {level}")
    return known


def _after_round(old: DataFrame, rows: DataFrame, level: int) -> DataFrame:
    """What is known after a round: visited addresses with their status, and those found, which wait for the next."""
    both = old.join(rows, "url", "full_outer")
    return both.select("url", F.coalesce("found", F.lit(level + 1)).alias("found"), F.when(F.col("was"), level).otherwise(F.col("visited")).alias("visited"), F.when(F.col("was"), F.col("s")).otherwise(F.col("status")).alias("status"))


def missed(status: Column, body: Column, marker: str, num: Column, width: int) -> Column:
    """Whether a numbered page is missing: by its status or a text that says so (`{}` in it stands for the number)."""
    texts = [F.lit(marker)]
    if "{}" in marker:
        texts += [F.replace(F.lit(marker), F.lit("{}"), n) for n in (num.cast("string"), F.lpad(num.cast("string"), width, "0"))]
    out = status != 200
    for text in texts:
        out = out | F.coalesce(F.contains(body, text), F.lit(False))
    return out


def numbered(spark: SparkSession, pattern: str, start: int, end: int, width: int, marker: str, gaps: int, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(num, url, status, html, hit, misses) of numbered pages up to the first run of misses; what isn't there counts as 404."""
    tries = crawl.pattern_addresses(spark, pattern, start, end, width)
    got = tries.join(read(tries.select("url")), "url", "left").withColumn("status", F.coalesce("status", F.lit(404)))
    marked = got.withColumns({"pattern": F.lit(pattern), "hit": ~missed(F.col("status"), F.col("html"), marker, F.col("num"), width)})
    return crawl.until_gap(marked, gaps).drop("pattern")


def events(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """What a crawl did, as (seq, kind, url) rows for an event stream."""
    rows = pages.select(F.lit(1).alias("part"), F.when(F.col("status") == 200, "page").otherwise("page_failed").alias("kind"), "url", "depth")
    rows = rows.unionByName(documents.select(F.lit(2).alias("part"), F.lit("document").alias("kind"), F.col("target").alias("url"), F.lit(None).cast("int").alias("depth")))
    return rows.select(F.struct("part", "depth", "url").alias("order"), "kind", "url")


def swept(documents: DataFrame, found: DataFrame, source_url: str, at: Column) -> DataFrame:
    """documents after a crawl of a page: those found are seen now, those of the page that weren't are archived as orphaned."""
    ids = documents.join(found.select(F.col("target").alias("download_url")).distinct(), "download_url", "left_semi").select("doc_id")
    gone = versioning.orphaned(documents, source_url, ids).select("doc_id", F.lit(True).alias("_gone"))
    seen = ids.distinct().withColumn("_seen", F.lit(True))
    marked = documents.join(gone, "doc_id", "left").join(seen, "doc_id", "left")
    out = versioning.archived(marked.withColumn("last_seen_at", F.when(F.col("_seen"), at).otherwise(F.col("last_seen_at"))), F.coalesce("_gone", F.lit(False)), "orphaned", at)
    return out.select(*documents.columns)
