"""The driver's tables as the entities that the operators work on, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import fresh_folder, spread
from tessera.operators import segments
from tessera.operators.inverted import Index
from tessera.operators.vector_index import VectorIndex

_INDEXES: dict[tuple[str, str], Index] = {}
_VECTORS: dict[tuple[str, str], VectorIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a versioned table: hash, address, age, currency by a rule on the id."""
    docs = table(spark, sf_dir, "documents")
    current = F.col("doc_id") % 7 != 0
    return docs.select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("/corpus/"), "source", F.when(F.col("doc_id") % 11 == 0, "/archiv/").otherwise("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 13 == 0, "_alt.txt").otherwise(".txt")).alias("uri"),
        F.sha2("text", 256).alias("sha256"),
        F.array("lang").alias("categories"),
        "lang",
        "source",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://"), "source", F.lit(".example.org/"))).alias("source_url"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), (F.col("doc_id") % 500).cast("string"))).alias("download_url"),
        current.alias("is_current"),
        F.when(~current, F.when(F.col("doc_id") % 2 == 0, "replaced").otherwise("manual")).alias("archive_reason"),
        (F.col("doc_id") % 97).alias("created"),
        "text",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.windows(spread(table(spark, sf_dir, "documents")))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the windows of a folder of tables, built once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(windows(spark, sf_dir), fresh_folder(spark, "index"), shards=16)
    return _INDEXES[key]


def vector_table(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored vector index of a folder of tables, built once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VECTORS:
        _VECTORS[key] = VectorIndex.build(table(spark, sf_dir, "embeddings"), fresh_folder(spark, "vectors"))
    return _VECTORS[key]


DOCUMENTS = """
docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
  '/corpus/' || source || CASE WHEN doc_id % 11 = 0 THEN '/archiv/' ELSE '/' END || doc_id || CASE WHEN doc_id % 13 = 0 THEN '_alt.txt' ELSE '.txt' END AS uri,
  sha256(text) AS sha256, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example.org/' END AS source_url,
  CASE WHEN doc_id % 2 = 0 THEN 'https://' || source || '.example.org/d/' || (doc_id % 500) END AS download_url,
  doc_id % 7 <> 0 AS is_current,
  CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'replaced' ELSE 'manual' END END AS archive_reason,
  doc_id % 97 AS created, text FROM documents)"""

PAGES = r"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
normed AS (SELECT doc_id, pos, trim(regexp_replace(replace(raw, chr(0), ' '), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS text FROM raw_lines),
pgs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS page_no, text FROM normed WHERE text <> '')"""

WINDOWS = PAGES + """,
wins AS (SELECT a.doc_id * 100000 + a.page_no AS window_id, a.doc_id, a.page_no AS page_start, coalesce(b.page_no, a.page_no) AS page_end,
  CASE WHEN length(a.text || coalesce(chr(10) || chr(10) || b.text, '')) <= 24000 THEN a.text || coalesce(chr(10) || chr(10) || b.text, '')
       ELSE rtrim(substr(a.text || coalesce(chr(10) || chr(10) || b.text, ''), 1, 24000), ' ' || chr(10)) END AS text
  FROM pgs a LEFT JOIN pgs b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1)"""
