"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by source, language and topic. Factors of the three margins are fitted in turn, until the expected
tokens of every source, language and topic meet their targets; a document's calibrated probability is the product of its
three factors, one at most, and it is kept where a hash of its id falls below that. The bound of one is part of the fit: what
documents that stay whole can't give, others of their margins make up for, so the targets hold for the sample itself, without
weights. The sample has KEEP of all tokens. Targets follow the square root of a margin's tokens, which lifts what is rare,
but none asks for more than MOST of what there is; what scarce margins can't give is shared by the others in the same way.
Rounds end when no margin is off by more than TOLERANCE, or after ROUNDS; `residuals` reports by how much each margin is off.

The topic is a column where one is named. Without one there is nothing to tell topics by, and texts are parted into TOPICS
by the hash of their alphabetically least long word (`none` without any), which keeps copies together.

Only the table of cells is fitted, one row for each combination that occurs; its sums combine before the shuffle, and the
factors are written to the shared folder after every round.

Nulls: null texts have no words, and null margins are a value of their own (a null id hashes like an empty one). Where no
text has a word, all rows are kept. Rows with equal ids in equal cells are kept or dropped together. Very long texts are one
row like any other, and stay or go whole. An empty table gives an empty table. Extra columns don't matter to the query and
are kept by `mixed_documents`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unpack, words, written

DIMENSIONS = ["m_source", "m_lang", "m_topic"]
TOPICS, LONG_WORD, DIGITS = 8, 6, 9
KEEP, MOST = 0.7, 0.95
ROUNDS, TOLERANCE = 16, 0.005


def topic_of(text: Column) -> Column:
    """The bucket of the alphabetically least word of at least six code points; `none` without one."""
    least = F.array_min(F.filter(words(text), lambda w: F.char_length(w) >= LONG_WORD))
    bucket = F.conv(F.substring(F.md5(least.cast("binary")), 1, 4), 16, 10).cast("int") % TOPICS
    return F.coalesce(F.concat(F.lit("t"), bucket.cast("string")), F.lit("none"))


def chance(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def _named(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def margins(docs: DataFrame, topic: str | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """Tokens and the three margins of every row, beside what carry names."""
    topics = _named(F.col(topic)) if topic else topic_of(F.col("text"))
    return docs.select(
        *[c.alias(n) for n, c in (carry or {}).items()],
        _named(F.col("source")).alias("m_source"),
        _named(F.col("lang")).alias("m_lang"),
        topics.alias("m_topic"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )


def _with_factors(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """cells with f_dimension for each dimension."""
    for d in DIMENSIONS:
        cells = cells.join(factors[d].select(d, F.col("f").alias(f"f_{d}")), d)
    return cells


def _product() -> Column:
    return F.least(F.lit(1.0), F.col("f_m_source") * F.col("f_m_lang") * F.col("f_m_topic"))


def goals(cells: DataFrame) -> DataFrame:
    """(dimension, value, goal): the tokens that each margin should have in the sample."""
    sums = reduce(DataFrame.unionByName, [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("have")) for d in DIMENSIONS])
    roots = sums.withColumn("root", F.round(F.sqrt("have"), DIGITS))
    # from the scarcest margin up: the factor of the root, were all scarcer ones given whole; it grows up to the first that it suits
    own = Window.partitionBy("dimension")
    order = own.orderBy("have", "value")
    scarcer = F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("root").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = roots.withColumn("all", F.sum("have").over(own)).withColumn("factor", F.when(rest > 0, F.round((KEEP * F.col("all") - MOST * scarcer) / rest, DIGITS)))
    factor = F.max("factor").over(own)
    return tried.select("dimension", "value", F.coalesce(F.least(MOST * F.col("have"), factor * F.col("root")), MOST * F.col("have")).alias("goal"))


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The probability for each combination of margins, and the goals (dimension, value, goal); both are written."""
    with Scratch(rows.sparkSession, "mix") as scratch:
        cells = scratch.written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
        wanted = written(goals(cells), "mix-goals")
        factors = {d: wanted.filter(F.col("dimension") == d).select(F.col("value").alias(d), "goal", F.lit(1.0).alias("f")) for d in DIMENSIONS}
        for _ in range(ROUNDS):
            for d in DIMENSIONS:  # each update sees those before it
                share = F.col("tokens") * _product()
                have = _with_factors(cells, factors).groupBy(d).agg(F.sum(share).alias("have"), F.sum(F.when(_product() >= 1, F.col("tokens")).otherwise(F.lit(0.0))).alias("whole"))
                free, due = F.col("have") - F.col("whole"), F.col("goal") - F.col("whole")  # what is whole already can't grow
                plain = F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(F.lit(1.0))
                ratio = F.when((free > 0) & (due > 0), due / free).otherwise(plain)
                updated = factors[d].join(have, d).select(d, "goal", F.round(F.col("f") * ratio, DIGITS).alias("f"), F.abs(plain - 1).alias("off"))
                factors[d] = scratch.written(updated, f"factors-{d}")
            # one look at all three a round: every action leaves a plan in the driver
            off = reduce(DataFrame.unionByName, [factors[d].select("off") for d in DIMENSIONS]).agg(F.max("off").alias("off")).first()["off"]
            if (off or 0.0) <= TOLERANCE:
                break
        return written(_with_factors(cells, factors).select(*DIMENSIONS, F.round(_product(), DIGITS).alias("probability")), "mix-factors"), wanted


def decide(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (margins with a key) with probability and kept. rows is read twice, so it should be a written table."""
    return rows.join(fit(rows)[0], DIMENSIONS).withColumn("kept", chance(F.col(key)) < F.col("probability"))


def residuals(rows: DataFrame) -> DataFrame:
    """(dimension, value, goal, expected): the tokens that the sample of rows should have and is expected to have."""
    probabilities, wanted = fit(rows)
    expected = [rows.join(probabilities, DIMENSIONS).groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")) for d in DIMENSIONS]
    return wanted.join(reduce(DataFrame.unionByName, expected), ["dimension", "value"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    cells = written(margins(docs).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), "mix-sums")
    row = F.col("row")
    packed = docs.select(F.struct("*").alias("row")).withColumns({"m_source": _named(row["source"]), "m_lang": _named(row["lang"]), "m_topic": topic_of(row["text"])})
    kept = packed.join(fit(cells)[0], DIMENSIONS).filter(chance(row["doc_id"]) < F.col("probability"))
    return kept.select(*unpack(kept))
