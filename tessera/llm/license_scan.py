"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes lower-case words with one space between them. Only texts that hold what some rule needs are scanned, each of
them only by the rules whose keywords it holds. A hit is an interval of words. Hits that lie inside a hit of higher
priority, or inside a longer or earlier-ruled hit of the same priority, are suppressed; the labels of the rest count. Three
plain phrases are counted at every place beside that, and their labels always stay.

Nulls: a null text has no words. Other columns are not read, so clashing names can't matter; a null doc_id is kept. Equal
rows have equal results, one for each. An empty table gives an empty table. Very long texts cost time in proportion to
their words and to the rules whose keyword they hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, written
from tessera.llm.license_rules import PLAIN, gate, rules

#: Everything in ASCII but digits and letters separates words; A to Z are lower-case by then.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, a space before, between and after them; one space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(ascii_lower(text), F.lit("")), F.lit(" ")), BREAK, " ")


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _literal_rules() -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("order", "label", "priority", "sure", "keyword", "needed", "expression"), r)]) for r in rules()])


def _places(text: Column, rule: Column) -> Column:
    """First and last word of each match of a rule, found by marks set around the matches."""
    marked = F.split(F.regexp_replace(text, rule["expression"], F.lit("\x01$0\x02")), " ")
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
    pairs = F.arrays_zip(at(lambda w: F.startswith(w, F.lit("\x01"))).alias("a"), at(lambda w: F.endswith(w, F.lit("\x02"))).alias("b"))
    return F.transform(
        pairs,
        lambda p: F.struct(p["a"].alias("first"), p["b"].alias("last"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["sure"].alias("sure")),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        spaced(F.col(text)).alias("s"),
    )
    pieces = [F.split("s", f"(?<= ){phrase}(?= )", -1) for _, phrase in PLAIN]
    start = lambda p: F.when(F.size(p) > 1, _spaces(F.element_at(p, 1)) - 1)
    end = lambda p, phrase: F.when(F.size(p) > 1, _spaces(F.col("s")) - _spaces(F.element_at(p, -1)) - 1 - phrase.count(" "))
    based = rows.withColumn("some", reduce(lambda a, b: a | b, [F.contains("s", F.lit(phrase)) for _, phrase in PLAIN])).select(
        "doc_id",
        "s",
        F.xxhash64("s").alias("k1"),
        F.crc32(F.col("s").cast("binary")).alias("k2"),
        (_spaces(F.col("s")) - 1).cast("long").alias("n_words"),
        *[F.when(F.col("some"), F.struct((F.size(p) - 1).alias("n"), start(p).alias("first"), end(p, phrase).alias("last"))).alias(f"p{i}") for i, (p, (_, phrase)) in enumerate(zip(pieces, PLAIN))],
    )
    facts = [F.col(f"p{i}") for i in range(len(PLAIN))]
    counted = based.select(
        "doc_id",
        "k1",
        "k2",
        "n_words",
        reduce(lambda a, b: a + b, [F.coalesce(f["n"], F.lit(0)) for f in facts]).cast("long").alias("n_base"),
        F.least(*[f["first"] for f in facts]).cast("long").alias("first_word"),
        F.greatest(*[f["last"] for f in facts]).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(f["n"] > 0, F.lit(label)) for f, (label, _) in zip(facts, PLAIN)])).alias("base"),
    )
    # written: what is found is small beside the texts, and a text of many copies can be joined in parts
    found = written(_labels(rows.filter(F.col("s").rlike(gate())).select("s", F.xxhash64("s").alias("k1"), F.crc32(F.col("s").cast("binary")).alias("k2"))), "license-labels")
    joined = counted.join(found, ["k1", "k2"], "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("extra", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.col("sure") / 100, F.lit(0.0))).alias("score"),
    )


def detections(texts: DataFrame) -> DataFrame:
    """Every hit of every rule in texts (k1, k2, s), once for equal texts: k1, k2, first, last, priority, order, label, sure, kept."""
    # every expression is a literal behind its keyword, so it is compiled once for a task; only rules that match are looked up
    every, by = rules(), {}
    for rule in every:
        by.setdefault(rule[4], []).append(rule)
    s = F.col("s")
    found = [F.when(F.contains(s, F.lit(keyword)), F.array(*[F.when(F.contains(s, F.lit(r[5])) & s.rlike(r[6]), F.lit(r[0])) for r in own])) for keyword, own in by.items()]
    numbers = F.array_compact(F.flatten(F.array_compact(F.array(*found))))
    matched = texts.select("k1", "k2", "s", F.explode(numbers).alias("number"))
    hits = matched.select("k1", "k2", F.explode(_places(s, F.element_at(_literal_rules(), F.col("number") + 1))).alias("hit")).select("k1", "k2", "hit.*").distinct()
    # A hit is inside another if that one starts no later and ends no earlier. Longer hits come first among equal starts,
    # so that running maxima of the ends seen, by priority, tell in one pass.
    order = Window.partitionBy("k1", "k2").orderBy("first", F.desc("last"), F.desc("priority"), "order").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("k1", "k2").orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    over = F.lit(False)
    for level in sorted({r[2] for r in rules()}):
        higher = F.max(F.when(F.col("priority") > level, F.col("last"))).over(from_here)
        same = F.max(F.when(F.col("priority") == level, F.col("last"))).over(order)
        hit = F.coalesce(higher >= F.col("last"), F.lit(False)) | F.coalesce(same >= F.col("last"), F.lit(False))
        over = over | ((F.col("priority") == level) & hit)
    return hits.withColumn("kept", ~over)


def _labels(texts: DataFrame) -> DataFrame:
    """Labels and the surest confidence of the hits that stay, for each distinct text."""
    return detections(texts).filter("kept").groupBy("k1", "k2").agg(F.collect_set("label").alias("extra"), F.max("sure").alias("sure"))
