"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The stages
are written as Parquet in the shared folder and read again between steps.

What holds for all of them: nulls may stand in any column, texts may be empty or very long (nothing is cut), rows may repeat,
columns beside those of documents are carried along under their own names, whatever those are, and an empty table gives an
empty table. Each stage says what becomes of the cases that are its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, quality, simhash
from tessera.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain limits and are no outliers of their language and source; the others go.

    Null and empty texts have no words and go; equal rows share their fate; null languages and sources are groups of their own.
    """
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text.

    A null text comes back empty; a document may lose all its lines and stays with an empty text; repeated rows count as documents each.
    """
    return line_dedup.clean_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group alike to 0.8 or more in shingles of five words.

    Texts without words are one group; of equal rows one stays; a null id comes after all others; ties go by content.
    """
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of 0.7 of all tokens, in which those of every source, language and topic are as many, in expectation, as its target says:
    the square root of what came in, but no more than 0.95 of it.

    A document stays or goes whole, by a hash of its id; without any word all rows stay; null margins are values of their own.
    """
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document: doc_id, lang, source, n_tokens, hashes of the ids and of what they decode to, and the ids.

    Null and empty texts have no tokens; every row gives one row.
    """
    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_dedup),
    ("mixing", mixing_stage),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the estimates, the covering or the merges; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
