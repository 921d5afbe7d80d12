"""Line dedup: lines that many documents share are dropped everywhere.

Normalised lines are exploded and hashed, documents are counted per hash, hashes at the threshold lose their lines, and
texts are put together again by position. Only hashes and positions are shuffled for the decision; each text moves once.
Lines are told apart by a 64-bit hash of their key.

Nulls: a null text is one empty line and comes back as an empty text; any other column may be null. A line counts once for
each distinct id whose rows hold it, however often it stands there; rows without an id don't count, and lose shared lines like
all others. Empty lines (below
min_chars) stay. An empty table gives an empty table. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tessera.llm.common import SPACES, ascii_lower, let, unpack, written


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (a struct of docs' columns, with the cleaned text), n_lines and n_dropped."""
    packed = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col("row")[text], F.lit(""))
    keyed = packed.select(
        "row",
        F.split(body, "\n").alias("lines"),
        # a row is found again by two hashes of all that it holds; rows that are equal have equal decisions
        F.col("row")[key].alias("id"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.lit(1), *[F.col("row")[f.name] for f in docs.schema if isinstance(f.dataType, AtomicType)]).alias("k2"),
    )
    # A to Z are lowered in the whole text at once; hashes and places are read twice, so they are written
    lines = written(keyed.select("id", "k1", "k2", F.transform(F.split(ascii_lower(body), "\n"), _hashed(min_chars)).alias("hashes")), "line-hashes")
    hot = written(
        lines.select("id", F.explode(F.array_distinct("hashes")).alias("h"))
        .filter("h IS NOT NULL")
        .groupBy("h")
        .agg(F.count_distinct("id").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("h"),
        "line-hot",  # written, so that the join below can be split where one line is in very many documents
    )
    dropped = (
        lines.select("k1", "k2", F.posexplode("hashes").alias("at", "h"))
        .filter("h IS NOT NULL")
        .join(hot, "h")
        .groupBy("k1", "k2")
        .agg(F.collect_set("at").alias("gone"))
    )
    joined = keyed.join(dropped, ["k1", "k2"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.size("gone") == 0, F.col("row")[text]).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n")
    )
    return joined.select(
        F.col("row").withField(f"`{text}`", F.coalesce(kept, F.lit(""))).alias("row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )


def _hashed(min_chars: int):
    """The hash of a lowered line's key: the line without white space around it; null for keys that are too short."""

    def hashed(line: Column) -> Column:
        return let(F.btrim(line, F.lit(SPACES)), lambda key: F.when(F.char_length(key) >= min_chars, F.xxhash64(key)))

    return hashed


def clean_documents(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with its own columns, shared lines removed from text and n_chars brought up to date."""
    cleaned = drop_shared_lines(docs, min_docs, min_chars)
    out = cleaned.select(*unpack(cleaned))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
