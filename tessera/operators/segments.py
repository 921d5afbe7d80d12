"""Documents into pages, overlapping page windows and anchors. Pages and windows are made within the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import anchor_hash, clamp, norm_text

PAGE_SLOTS = 100_000
WINDOW_CHARS, ANCHOR_CHARS = 24_000, 2_000


def page_list(text: Column, between: str = "\n") -> Column:
    """The normalised pages of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, between), norm_text), lambda p: p != "")


def pages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, page_no (from 1), text and sha256 of every page."""
    out = docs.select(key, F.posexplode(page_list(F.col(text))).alias("at", "text"))
    return out.select(F.col(key).alias("doc_id"), (F.col("at") + 1).alias("page_no"), "text", F.sha2("text", 256).alias("sha256"))


def windows(docs: DataFrame, size: int = 2, stride: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Runs of `size` pages from every stride-th page; the last ones are shorter."""

    def cut(own: Column) -> Column:
        n = F.size(own)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct((i + 1).alias("page_start"), F.least(n, i + size).alias("page_end"), clamp(F.array_join(F.slice(own, i + 1, size), "\n\n"), WINDOW_CHARS).alias("text")),
        )

    # the pages are made once and bound by the outer transform; a column would be worked out again for every window
    spans = F.element_at(F.transform(F.array(page_list(F.col(text))), cut), 1)
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(spans).alias("w"))
    out = rows.select((F.col("doc_id").cast("long") * PAGE_SLOTS + F.col("w.page_start")).alias("window_id"), "doc_id", "w.page_start", "w.page_end", "w.text")
    return out.withColumn("sha256", anchor_hash(F.col("text")))


def anchors(pages_raw: DataFrame, text: str = "text") -> DataFrame:
    """The parts of each raw page (doc_id, page_no, text): its lines if there are three, else the whole; with running offsets."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\r|\n"), norm_text), lambda p: p != "")
    whole = F.filter(F.array(norm_text(F.col(text))), lambda p: p != "")
    parts = pages_raw.select("doc_id", "page_no", F.posexplode(F.when(F.size(lines) < 3, whole).otherwise(lines)).alias("at", "part"))
    cut = parts.withColumn("text", clamp(F.col("part"), ANCHOR_CHARS)).drop("part")
    before = Window.partitionBy("doc_id", "page_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("int")
    kind = F.when(F.contains("text", F.lit("\t")), "table").when(F.regexp_like("text", F.lit("^[-•*]")), "list_item").otherwise("paragraph")
    placed = cut.withColumn("start_offset", start)
    return placed.select("doc_id", "page_no", (F.col("at") + 1).alias("anchor_no"), kind.alias("anchor_type"), "start_offset", (F.col("start_offset") + F.char_length("text")).alias("end_offset"), "text", anchor_hash(F.col("text")).alias("sha256"))
