"""Retrieval and citation metrics over tables of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], case: str = "case_id") -> DataFrame:
    """(case, metric, k, value): precision, recall, hit and ndcg at every k, and the reciprocal rank (k 0).

    ranked: case, rank (from 1), doc_id; relevant: case, doc_id. Cases without results or without relevant documents have
    no rows but a reciprocal rank of zero. Repeated results count each time.
    """
    marked = ranked.join(relevant.select(case, "doc_id").distinct().withColumn("hit", F.lit(1)), [case, "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    wanted = relevant.select(case, "doc_id").distinct().groupBy(case).agg(F.count("*").alias("wanted"))
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(F.lit(0)))
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    found = marked.groupBy(case).agg(F.count("*").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), *[at(k, F.col("hit")).alias(f"hits{k}") for k in ks], *[at(k, gain).alias(f"gain{k}") for k in ks])
    both = found.join(wanted, case, "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = [F.struct(F.lit("mrr").alias("metric"), F.lit(0).alias("k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("value"))]
    for k in ks:
        hits = F.col(f"hits{k}")
        for metric, value in (("precision", hits / k), ("recall", hits / F.col("wanted")), ("hit", F.when(hits > 0, 1.0).otherwise(0.0)), ("ndcg", F.col(f"gain{k}") / ideal(k))):
            rows.append(F.struct(F.lit(metric).alias("metric"), F.lit(k).alias("k"), F.when(F.col("wanted") > 0, value.cast("double")).alias("value")))
    return both.select(case, F.explode(F.array(*rows)).alias("m")).select(case, "m.*").filter("value IS NOT NULL")


def mean_metrics(metrics: DataFrame, cases: int) -> DataFrame:
    """Averages over all cases; one that lacks a value counts as zero."""
    return metrics.groupBy("metric", "k").agg(F.try_divide(F.sum("value"), F.lit(float(cases))).alias("value"))


def cited_numbers(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))


def citation_metrics(answer: Column, sources: Column) -> dict[str, Column]:
    """precision, recall, coverage, confidence and diversity of an answer's [n] marks; sources: array of (index, doc_id, confidence)."""
    marks = cited_numbers(answer)
    known = F.array_distinct(F.transform(sources, lambda s: s["index"]))
    right = F.size(F.array_intersect(marks, known))
    sentences = F.filter(F.split(answer, r"[.!?]"), lambda s: F.trim(s) != "")
    cited = F.filter(sentences, lambda s: F.regexp_like(s, F.lit(r"\[\d+\]")))
    docs = F.array_distinct(F.filter(F.transform(sources, lambda s: s["doc_id"]), lambda d: d.isNotNull() & (d != "")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    total = F.aggregate(F.transform(sources, lambda s: s["confidence"].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return {
        "precision": ratio(right, F.size(marks)),
        "recall": ratio(right, F.size(known)),
        "coverage": ratio(F.size(cited), F.size(sentences)),
        "confidence": ratio(total, F.size(sources)),
        "diversity": ratio(F.size(docs), F.size(sources)),
    }


def passed(hit_at_10: Column, answer: Column, keywords: Column) -> Column:
    return (hit_at_10 > 0) & F.forall(keywords, lambda w: F.contains(F.lower(answer), F.lower(w)))


def by_category(results: DataFrame) -> DataFrame:
    """Cases, passed cases and mean latency of every category."""
    return results.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.avg("latency_ms").alias("avg_latency_ms"))

