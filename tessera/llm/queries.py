"""The registered queries of the training-data operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, hard_negatives, html_text, katz, license_scan, line_dedup, mixing, quality, sharding, simhash, suffix_dedup, topk, whitening
from tessera.llm.common import unpack, written
from tessera.llm.license_rules import PLAIN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"), order=3)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_rows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    stats = written(quality.statistics(docs, carry={"doc_id": F.col("doc_id")}), "quality-stats")
    return quality.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = written(mixing.margins(docs, carry={"doc_id": F.col("doc_id")}), "mix-margins")
    return mixing.decide(rows).select("doc_id", F.col("m_source").alias("source"), F.col("m_lang").alias("lang"), F.col("m_topic").alias("topic"), "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("row.text"), 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    derive = {"n_bytes": F.col("n_bytes"), "n_removed": F.col("n_bytes") - F.octet_length("kept"), "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200, keep="none", derive=derive).select(F.col("row.doc_id").alias("doc_id"), *derive)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=16)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"), n_positives=5, n_negatives=3, every=50, label=moved)


QUERIES = {f.__name__: f for f in (op1_katz_scores, op2_byte_bpe, op3_simhash, op4_ring_sharding, op5_topk_search, op6_quality_rules, op7_mixing, op8_line_dedup, op9_html_text, op10_license_scan, op11_suffix_dedup, op12_whitening, op13_hard_negatives)}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"



def _mixing_sql() -> str:
    """The same fit with one table for each update of a margin's factors; factors stay as they are once a round has met the tolerance."""
    dims = ("s", "l", "t")
    parts = [
        r"""words AS (SELECT doc_id, '=' || source AS s, '=' || lang AS l, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)""",
        f"""rows_ AS (SELECT doc_id, s, l, len(ws) AS n, list_min([w FOR w IN ws IF length(w) >= {mixing.LONG_WORD}]) AS w FROM words)""",
        f"""topical AS MATERIALIZED (SELECT doc_id, s, l, n, coalesce('t' || (('0x' || substr(md5(w), 1, 4))::INT % {mixing.TOPICS}), 'none') AS t FROM rows_)""",
        """cells AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n FROM topical GROUP BY ALL)""",
    ]
    for d in dims:
        own = f"PARTITION BY 1 ORDER BY have, {d} ROWS BETWEEN"
        parts.append(f"h_{d} AS (SELECT {d}, sum(n) AS have, round(sqrt(sum(n)), 9) AS root FROM cells GROUP BY {d})")
        scarcer, rest = f"coalesce(sum(have) OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)", f"sum(root) OVER ({own} CURRENT ROW AND UNBOUNDED FOLLOWING)"
        parts.append(f"r_{d} AS (SELECT *, CASE WHEN {rest} > 0 THEN round(({mixing.KEEP}::DOUBLE * sum(have) OVER () - {mixing.MOST}::DOUBLE * {scarcer}) / {rest}, 9) END AS factor FROM h_{d})")
        whole = f"{mixing.MOST}::DOUBLE * have"
        parts.append(f"f_{d}_0 AS MATERIALIZED (SELECT {d}, coalesce(least({whole}, (SELECT max(factor) FROM r_{d}) * root), {whole}) AS goal, 1.0::DOUBLE AS f, 0.0::DOUBLE AS off FROM r_{d})")
    parts.append("done_0 AS (SELECT false AS done)")
    now = dict.fromkeys(dims, 0)
    for k in range(1, mixing.ROUNDS + 1):
        for d in dims:
            joins = " ".join(f"JOIN f_{e}_{now[e]} f{e} ON c.{e} = f{e}.{e}" for e in dims)
            have = f"SELECT c.{d}, sum(c.n * least(1.0, fs.f * fl.f * ft.f)) AS have, sum(CASE WHEN fs.f * fl.f * ft.f >= 1 THEN c.n ELSE 0.0 END) AS whole FROM cells c {joins} GROUP BY c.{d}"
            plain = "(CASE WHEN have > 0 THEN goal / have ELSE 1.0 END)"
            ratio = f"(CASE WHEN have - whole > 0 AND goal - whole > 0 THEN (goal - whole) / (have - whole) ELSE {plain} END)"
            parts.append(f"f_{d}_{k} AS MATERIALIZED (SELECT o.{d}, goal, CASE WHEN done THEN f ELSE round(f * {ratio}, 9) END AS f, CASE WHEN done THEN off ELSE abs({plain} - 1) END AS off FROM f_{d}_{k - 1} o JOIN ({have}) g ON o.{d} = g.{d}, done_{k - 1})")
            now[d] = k
        parts.append(f"done_{k} AS MATERIALIZED (SELECT max(off) <= {mixing.TOLERANCE} AS done FROM (" + " UNION ALL ".join(f"SELECT off FROM f_{d}_{k}" for d in dims) + "))")
    joins = " ".join(f"JOIN f_{d}_{mixing.ROUNDS} f{d} ON r.{d} = f{d}.{d}" for d in dims)
    parts.append(f"fitted AS (SELECT r.*, round(least(1.0, fs.f * fl.f * ft.f), 9) AS p FROM topical r {joins})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, s AS source, l AS lang, t AS topic, n AS n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS kept FROM fitted"""


SQL = {
    "op7_mixing": _mixing_sql(),
    "op5_topk_search": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.c::DOUBLE[], c.c::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.c::DOUBLE[], c.c::DOUBLE[])::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT n.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM near n JOIN pairs p ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op8_line_dedup": f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM texts),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_SPACES}), {_UPPER}, {_LOWER}) AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
