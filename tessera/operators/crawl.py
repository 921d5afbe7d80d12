"""Links of pages, bounded breadth-first crawls over a table of pages, numbered address patterns and conditional fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_anchor_text, document_extension, host, norm_text, resolve, unwrapped_mailto, without_fragment

#: An address in double quotes, in single ones, or bare; then what stands in the element.
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, place, href, target, anchor_text, extension) of every link of pages (page_id, url, html)."""
    at = lambda n: F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(n))
    found = pages.select("page_id", "url", F.posexplode(F.arrays_zip(at(1).alias("h1"), at(2).alias("h2"), at(3).alias("h3"), at(4).alias("inner"))).alias("place", "a"))
    href = F.concat("a.h1", "a.h2", "a.h3")  # two of them are empty
    hrefs = found.select("page_id", "url", "place", F.replace(F.trim(href), F.lit("&amp;"), F.lit("&")).alias("href"), norm_text(F.regexp_replace("a.inner", "<[^>]*>", " ")).alias("inner"))
    real = hrefs.withColumn("real", unwrapped_mailto(F.col("href"))).filter("real IS NOT NULL")
    out = real.withColumn("target", resolve(F.col("url"), F.col("real")))
    return out.select("page_id", "url", "place", "href", "target", clean_anchor_text(F.col("inner")).alias("anchor_text"), document_extension(F.col("target")).alias("extension"))


def document_links(found: DataFrame) -> DataFrame:
    """The first link of each page to each document."""
    first = F.row_number().over(Window.partitionBy("page_id", "target").orderBy("place"))
    return found.filter("extension IS NOT NULL").withColumn("nth", first).filter("nth = 1").drop("nth")


def page_links(found: DataFrame) -> DataFrame:
    """Each page's links to other pages of its host, without fragments, once each."""
    own = found.filter("extension IS NULL").withColumn("target", without_fragment(F.col("target")))
    return own.filter((host(F.col("target")) == host(F.col("url"))) & (F.col("target") != without_fragment(F.col("url")))).select("page_id", "url", "target").distinct()


def frontier(edges: DataFrame, seeds: DataFrame, depth: int, most: int, save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(url, depth) reached from seeds along (src, dst), nearest first, at most `most`; one join a level, without what was seen.

    save may write each level, which keeps the plan of deep crawls short.
    """
    seen = save(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        found = front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        front = save(found)
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(most)


def pattern_addresses(spark, pattern: str, start: int, end: int, width: int) -> DataFrame:
    """(num, url) for every number of a pattern, padded with zeros."""
    return spark.range(start, end + 1).select(F.col("id").alias("num"), F.replace(F.lit(pattern), F.lit("{}"), F.lpad(F.col("id").cast("string"), width, "0")).alias("url"))


def until_gap(tries: DataFrame, gaps: int) -> DataFrame:
    """tries (pattern, num, hit) up to the first run of `gaps` misses, with the misses in a row so far.

    Misses since the last hit are a difference of two running counts; what lies behind the first full gap is cut off.
    """
    order = Window.partitionBy("pattern").orderBy("num")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(order)
    counted = tries.withColumn("nth", nth).withColumn("misses", F.col("nth") - F.coalesce(F.max(F.when(F.col("hit"), F.col("nth"))).over(so_far), F.lit(0)))
    stop = F.min(F.when(F.col("misses") >= gaps, F.col("nth"))).over(Window.partitionBy("pattern"))
    return counted.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("nth") <= F.col("stop"))).drop("nth", "stop")


def to_fetch(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (url, etag, size) that are new or changed and not too large: what a conditional fetch would transfer."""
    known = documents.filter("http_etag IS NOT NULL").select(F.col("download_url").alias("url"), F.col("http_etag").alias("etag")).distinct()
    return found.filter(F.coalesce(F.col("size") <= 100 << 20, F.lit(True))).join(known, ["url", "etag"], "left_anti")
