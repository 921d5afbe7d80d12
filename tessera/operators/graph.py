"""The citation graph as a table of edges: bounded traversal, expansion and resolution of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cluster import kept
from tessera.operators.similarity import contained


#: Neighbours of a node that one task takes; nodes with more are split.
HUB = 100_000


def split_adjacency(step: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """step (a, b) with a part for each edge, and (a, parts) of nodes with more than `hub` neighbours: a node has a part for each `hub` of them."""
    hubs = step.groupBy("a").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")).filter("parts > 1")
    dealt = step.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt, hubs


def reached(edges: DataFrame, start: DataFrame, depth: int, incoming: bool = False, hub: int = HUB) -> DataFrame:
    """(start, doc_id, distance) for all documents within `depth` steps along (src, dst), at their least distance.

    One join a step; what has been seen is taken out before the next, so paths don't multiply. The neighbours of a hub are dealt over
    several tasks, and a path that comes to it goes on in each. Every step is written, so plans don't grow with the depth.
    """
    step = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if incoming else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    dealt, hubs = (kept(t, "adjacency") for t in split_adjacency(step.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), hub))
    front = start.select(F.col("doc_id").alias("start"), F.col("doc_id").alias("a")).distinct()
    out = None
    for distance in range(1, depth + 1):
        ways = front.join(hubs, "a", "left").select("start", "a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        found = ways.join(dealt, ["a", "part"]).select("start", F.col("b").alias("doc_id")).distinct()
        if out is not None:
            found = found.join(out.select("start", "doc_id"), ["start", "doc_id"], "left_anti")
        found = kept(found.withColumn("distance", F.lit(distance)), "reached")
        out = found if out is None else out.unionByName(found)
        front = found.select("start", F.col("doc_id").alias("a"))
    return out


def expansion(edges: DataFrame, hits: DataFrame, depth: int = 2, most: int = 4) -> DataFrame:
    """The nearest documents that hits cite (up to depth) or that cite them (one step further away), without the hits."""
    out = reached(edges, hits, depth).select("doc_id", "distance")
    into = reached(edges, hits, 1, incoming=True).select("doc_id", (F.col("distance") + 1).alias("distance"))
    near = out.unionByName(into).groupBy("doc_id").agg(F.min("distance").alias("distance"))
    return near.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("distance", "doc_id").limit(most)


def anchors_in(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors on the pages of hits (doc_id, page_start, page_end): an equal-key join with a range, each anchor once."""
    on = [hits["doc_id"] == anchors["doc_id"], anchors["page_no"].between(hits["page_start"], hits["page_end"])]
    return anchors.join(hits.select("doc_id", "page_start", "page_end"), on, "left_semi")


def anchor_ids(hits: DataFrame, anchors: DataFrame, first: int = 6) -> DataFrame:
    """One row, `ids`: the anchors (anchor_id, doc_id, page_no) on the pages of the first hits (rank), each once, in order."""
    found = anchors_in(hits.filter(F.col("rank") <= first), anchors)
    return found.agg(F.sort_array(F.collect_set("anchor_id")).alias("ids"))


def anchors_by_id(ids: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors that a row of ids names."""
    return anchors.join(ids.select(F.explode("ids").alias("anchor_id")).distinct(), "anchor_id", "left_semi")


def resolved_urls(references: DataFrame, documents: DataFrame) -> DataFrame:
    """URL references with the least document of that uri or download_url."""
    places = documents.select("doc_id", F.explode(F.array("uri", "download_url")).alias("target")).filter("target IS NOT NULL")
    targets = places.groupBy("target").agg(F.min("doc_id").alias("target_doc_id"))
    return references.join(targets, references["ref"] == targets["target"], "left").drop("target")


def resolved_titles(references: DataFrame, documents: DataFrame, least: int = 10, gram: int = 10) -> DataFrame:
    """References of at least `least` characters with the least document whose title holds their first fifty; letters' case doesn't count.

    Titles are found by the rarest run of `gram` characters of each reference, on ids alone (see similarity.contained).
    """
    asked = references.select("ref").distinct().filter(F.char_length("ref") >= max(least, gram)).select("ref", F.lower(F.substring("ref", 1, 50)).alias("text"))
    titles = documents.filter(F.char_length("title") >= least).select(F.col("doc_id").alias("id"), F.lower("title").alias("text"))
    best = asked.join(contained(asked.select("text"), titles, gram), "text").select("ref", F.col("id").alias("target_doc_id"))
    return references.join(best, "ref", "left")
