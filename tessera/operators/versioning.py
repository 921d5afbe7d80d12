"""Keyed changes of document tables as snapshots: upsert, replace, archive, orphans, duplicates and overlap.

Parquet tables can't be changed in place, so every operator takes the old table and gives the new one; `sources.tables`
writes it beside the old and moves a pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import kept
from tessera.functions.text import document_id, jaccard, old_version_reason, set_append, word_set
from tessera.operators.vectors import batch_top_k

SIMILAR, OVERLAP, NEAREST = 0.95, 0.80, 5


def identified(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """incoming (uri, sha256, download_url) with the id that it has or gets: by download_url, then by content, else from the uri."""
    by_url = documents.filter("download_url IS NOT NULL").groupBy("download_url").agg(F.min("doc_id").alias("id_url"))
    by_hash = documents.groupBy("sha256").agg(F.min("doc_id").alias("id_hash"))
    joined = incoming.join(by_url, "download_url", "left").join(by_hash, "sha256", "left")
    return joined.withColumn("doc_id", F.coalesce("id_url", "id_hash", document_id(F.col("uri")))).drop("id_url", "id_hash")


def changes(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """incoming (doc_id, sha256) with status new, changed or unchanged."""
    old = documents.select("doc_id", F.col("sha256").alias("old_sha256"))
    status = F.when(F.col("old_sha256").isNull(), "new").when(F.col("old_sha256") == F.col("sha256"), "unchanged").otherwise("changed")
    return incoming.join(old, "doc_id", "left").withColumn("status", status).drop("old_sha256")


def upserted(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after an upsert: content is replaced, addresses are kept where none come, categories grow, is_current stays."""
    replaced, kept = ["title", "uri", "sha256"], ["source_url", "download_url", "last_seen_at"]
    new = incoming.select("doc_id", "category", *[F.col(c).alias(f"n_{c}") for c in [*replaced, *kept]]).withColumn("_new", F.lit(True))
    both = documents.join(new, "doc_id", "full_outer")
    out = {c: F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in replaced}
    out |= {c: F.coalesce(f"n_{c}", c) for c in kept}
    out["categories"] = F.when(F.col("category").isNull(), F.coalesce("categories", F.array().cast("array<string>"))).otherwise(set_append(F.col("categories"), F.col("category")))
    out["is_current"] = F.coalesce("is_current", old_version_reason(F.col("n_uri")).isNull())
    out["archive_reason"] = F.when(F.col("is_current").isNull(), old_version_reason(F.col("n_uri"))).otherwise(F.col("archive_reason"))
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in documents.columns])


def replaced_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Children without those of the parents, and with the fresh ones."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without_documents(children: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """A cascade: rows whose document is gone go with it."""
    return children.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")


def archived(documents: DataFrame, which: Column, reason: str, at: Column) -> DataFrame:
    """Current documents that fit become archived, for a reason."""
    hit = which & F.col("is_current")
    return documents.withColumns({"archive_reason": F.when(hit, reason).otherwise(F.col("archive_reason")), "archived_at": F.when(hit, at).otherwise(F.col("archived_at")), "is_current": F.col("is_current") & ~F.coalesce(which, F.lit(False))})


def restored(documents: DataFrame, which: Column) -> DataFrame:
    """Archived documents that fit become current again."""
    hit = which & ~F.col("is_current")
    clear = lambda c: F.when(~F.coalesce(hit, F.lit(False)), F.col(c))
    return documents.withColumns({"archive_reason": clear("archive_reason"), "archived_at": clear("archived_at"), "is_current": F.col("is_current") | F.coalesce(hit, F.lit(False))})


def superseded(documents: DataFrame, pairs: DataFrame, at: Column) -> DataFrame:
    """documents after new ones took the place of others by name: pairs (new_id, old_id); a document can't supersede itself, nor can one that isn't there."""
    there = documents.select(F.col("doc_id").alias("new_id"))
    gone = pairs.filter("new_id <> old_id").join(there, "new_id", "left_semi").select(F.col("old_id").alias("doc_id"), F.lit(True).alias("_gone")).distinct()
    marked = archived(documents.join(gone, "doc_id", "left"), F.coalesce("_gone", F.lit(False)), "superseded", at)
    return marked.select(*documents.columns)


def orphaned(documents: DataFrame, source_url: str, seen: DataFrame) -> DataFrame:
    """Current documents found on a page before that weren't seen on it now."""
    return documents.filter(F.col("is_current") & (F.col("source_url") == source_url)).join(seen.select("doc_id").distinct(), "doc_id", "left_anti")


def unseen(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Current local documents (without a download address) that weren't seen now."""
    return documents.filter(F.col("is_current") & F.col("download_url").isNull()).join(seen.select("doc_id").distinct(), "doc_id", "left_anti")


def replaced_by_url(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """For each incoming (doc_id, download_url, sha256): the newest current document of that address with other content.

    An address keeps a row of five candidates, whatever the number of its documents: the newest one, the newest of other content and of another
    id than that, and what comes after those where an incoming document has their id or content as well.
    """
    old = documents.filter("is_current AND download_url IS NOT NULL AND sha256 IS NOT NULL AND doc_id IS NOT NULL")
    # read three times, and a hash of a text is dear
    rows = kept(old.select("download_url", F.struct("created_at", F.col("doc_id").alias("id"), F.col("sha256").alias("sha")).alias("d")), "by-url")
    newest = lambda known, **rules: known.groupBy("download_url").agg(*[F.max(F.when(rule, F.col("d"))).alias(name) for name, rule in rules.items()])
    other = lambda what, than: F.col(f"d.{what}") != F.col(f"{than}.{what}")
    first = newest(rows, first=F.lit(True))
    second = first.join(newest(rows.join(first, "download_url"), sha=other("sha", "first"), id=other("id", "first")), "download_url")
    third = newest(rows.join(second, "download_url"), sha_id=other("sha", "first") & other("id", "sha"), id_sha=other("id", "first") & other("sha", "id"))
    met = incoming.select("doc_id", "download_url", "sha256").join(second.join(third, "download_url"), "download_url")
    fits = lambda name: (F.col(f"{name}.sha") != F.col("sha256")) & (F.col(f"{name}.id") != F.col("doc_id"))
    # every candidate is of this address, so the newest that fits is the answer
    best = F.greatest(*[F.when(fits(name), F.struct(f"{name}.created_at", f"{name}.id")) for name in ("first", "sha", "id", "sha_id", "id_sha")])
    found = met.withColumn("best", best).filter("best IS NOT NULL")
    return found.groupBy("doc_id").agg(F.max("best").alias("best")).select("doc_id", F.col("best.id").alias("replaced_id"))


def kept_duplicates(documents: DataFrame, newest: bool = False) -> DataFrame:
    """Documents without those that an older (or newer) one has the content of; all of equal age stay."""
    ends = documents.groupBy("sha256").agg((F.max if newest else F.min)("created_at").alias("end"))
    return documents.join(ends, "sha256").filter(F.col("created_at") == F.col("end")).drop("end")


def duplicate_hashes(documents: DataFrame, most: int = 20) -> DataFrame:
    return documents.groupBy("sha256").agg(F.count("*").alias("cnt")).filter("cnt > 1").orderBy(F.desc("cnt"), "sha256").limit(most)


def similar_documents(means: DataFrame, asked: DataFrame, least: float = SIMILAR, nearest: int = NEAREST) -> DataFrame:
    """For each asked document (doc_id, mean): up to `nearest` others whose mean vector is alike.

    The asked set is a batch of newly ingested documents; it passes over the means in bounded broadcasts.
    """
    queries = asked.select(F.col("doc_id").alias("qid"), F.col("mean").alias("qvec"))
    near = batch_top_k(means, queries, nearest + 1, key="doc_id", vector="mean").filter((F.col("doc_id") != F.col("qid")) & (F.col("score") >= least))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= nearest).select(F.col("qid").alias("new_id"), F.col("doc_id").alias("old_id"), F.col("score").alias("similarity"), "rank")


def overlaps(pairs: DataFrame, texts: DataFrame, least: float = OVERLAP) -> DataFrame:
    """pairs (new_id, old_id) with the word overlap of their texts, those that reach `least`, and what follows from it."""
    own = texts.select("doc_id", "created_at", word_set(F.col("text")).alias("set"))
    a = own.select(F.col("doc_id").alias("new_id"), F.col("created_at").alias("new_at"), F.col("set").alias("new_set"))
    b = own.select(F.col("doc_id").alias("old_id"), F.col("created_at").alias("old_at"), F.col("set").alias("old_set"))
    joined = pairs.join(a, "new_id").join(b, "old_id").withColumn("text_overlap", jaccard(F.col("new_set"), F.col("old_set")))
    loser = F.when(F.col("old_at") < F.col("new_at"), F.col("old_id")).otherwise(F.col("new_id"))
    return joined.filter(F.col("text_overlap") >= least).select(*pairs.columns, "text_overlap", loser.alias("archived_id"))


def archive_listing(documents: DataFrame, most: int = 50, skip: int = 0) -> DataFrame:
    return documents.filter(~F.col("is_current")).orderBy(F.desc_nulls_first("archived_at"), "doc_id").offset(skip).limit(most)
