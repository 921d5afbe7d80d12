"""Files into the versioned tables: extract, identify, detect changes, segment, find and resolve references, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.references import find
from tessera.functions.text import norm_text, old_version_reason
from tessera.operators import graph, segments, versioning
from tessera.sources import files
from tessera.sources.tables import Store

DOCUMENT = "doc_id string, title string, uri string, sha256 string, categories array<string>, is_current boolean, archived_at timestamp, archive_reason string, source_url string, download_url string, last_seen_at timestamp, created_at timestamp"
CHILDREN = ("pages", "windows", "anchors", "citations")


def ingest(store: Store, folder: str, category: str | None = None) -> DataFrame:
    """Brings the tables of a store up to date with a folder; returns what became of each file (doc_id, uri, status, error)."""
    spark = store.spark
    documents = store.read("documents") if store.version("documents") else spark.createDataFrame([], DOCUMENT)
    raw = files.scan(spark, folder)
    now = F.lit(spark.sql("SELECT current_timestamp()").first()[0])
    read = files.extracted(raw).join(raw.select("path", F.sha2("content", 256).alias("sha256")), "path")
    store.write("extracted", read)
    read = store.read("extracted")
    sound = read.filter("error IS NULL").select("sha256", "title", F.col("path").alias("uri"), "pages", F.lit(None).cast("string").alias("download_url"), F.lit(None).cast("string").alias("source_url"), now.alias("last_seen_at"), F.lit(category).cast("string").alias("category"))
    store.write("incoming", versioning.changes(versioning.identified(sound, documents).dropDuplicates(["doc_id"]), documents))
    incoming = store.read("incoming")
    fresh = incoming.filter("status <> 'unchanged'")
    after = versioning.upserted(documents, incoming)
    store.write("documents", after.withColumns({"created_at": F.coalesce("created_at", now), "archived_at": F.when(~F.col("is_current"), F.coalesce("archived_at", now))}))
    numbered = fresh.select("doc_id", F.posexplode("pages").alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")
    pages = numbered.select("doc_id", "page_no", norm_text(F.col("text")).alias("text")).filter("text <> ''")
    found = pages.select("doc_id", "page_no", F.explode(find(F.col("text"))).alias("r")).select("doc_id", "page_no", "r.*")
    known = store.read("documents")
    targets = known.select("doc_id", "title", "uri", "download_url")
    urls = graph.resolved_urls(found.filter("kind = 'url'"), targets)
    titles = graph.resolved_titles(found.filter("kind = 'internal_ref'"), targets)
    rest = found.filter("kind NOT IN ('url', 'internal_ref')").withColumn("target_doc_id", F.lit(None).cast("string"))
    citations = urls.unionByName(titles).unionByName(rest).withColumn("resolved", F.col("target_doc_id").isNotNull())
    for name, rows in zip(CHILDREN, (pages, _windows(fresh), segments.anchors(numbered), citations)):
        old = store.read(name) if store.version(name) else None
        store.write(name, rows if old is None else versioning.replaced_children(old, rows, fresh))
    done = incoming.select("doc_id", "uri", F.when(old_version_reason(F.col("uri")).isNotNull() & (F.col("status") == "new"), "archived").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("error"))
    failed = read.filter("error IS NOT NULL").select(F.lit(None).cast("string").alias("doc_id"), F.col("path").alias("uri"), F.lit("failed").alias("status"), "error")
    return done.unionByName(failed)


def _windows(fresh: DataFrame, size: int = 2) -> DataFrame:
    """Page windows from page arrays; pages that are blank count but give no text."""
    pages = F.transform("pages", norm_text)
    spans = F.transform(pages, lambda p, i: F.struct((i + 1).alias("page_start"), F.least(F.size("pages"), i + size).alias("page_end"), segments.clamp(F.array_join(F.filter(F.slice(pages, i + 1, size), lambda x: x != ""), "\n\n"), segments.WINDOW_CHARS).alias("text")))
    return fresh.select("doc_id", F.explode(spans).alias("w")).select("doc_id", "w.*").filter("text <> ''")
