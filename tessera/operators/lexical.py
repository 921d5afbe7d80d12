"""Full-text match and rank on windows: web-style queries, cover density, BM25, and a postings table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.functions.text import word_array

WEIGHT = 0.1  # of an unlabelled position, a fixed value


@dataclass(frozen=True)
class Query:
    """Groups of alternatives; each is a list of word runs that must all stand in a text, and of runs that must not."""

    groups: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({w for wanted, _ in self.groups for run in wanted for w in run.split(" ")})


def parse(text: str) -> Query:
    """Bare words are all needed, quoted ones as a phrase, `or` separates alternatives, a minus excludes."""
    groups: list[tuple[list[str], list[str]]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            groups.append(([], []))
            continue
        run = " ".join(re.findall(r"\w+", (phrase or word).lower()))
        if run:
            groups[-1][bool(minus)].append(run)
    return Query(tuple((tuple(a), tuple(b)) for a, b in groups if a or b))


def spaced_words(text: Column) -> Column:
    """All words with a space before and after each, so that a run of words is a substring."""
    return F.concat(F.lit(" "), F.array_join(word_array(text), " "), F.lit(" "))


def matches(spaced: Column, query: Query) -> Column:
    """Whether a spaced text fits the query. One pass over the row: no join, no shuffle."""
    has = lambda run: F.contains(spaced, F.lit(f" {run} "))
    out = F.lit(False)
    for wanted, unwanted in query.groups:
        one = F.lit(True)
        for run in wanted:
            one = one & has(run)
        for run in unwanted:
            one = one & ~has(run)
        out = out | one
    return out


def term_rank(text: Column, term: str) -> Column:
    """Cover density of a single term: a tenth for each place."""
    return F.size(F.filter(word_array(text), lambda w: w == term)) * F.lit(WEIGHT)


def cover_score(places: list[Column]) -> Column:
    """The sum over minimal covers of all terms, given the places of each: weight over one plus the words in a cover that are none of the terms.

    One sweep over the merged places keeps where each term stood last. A cover ends where the least of those has moved on.
    """
    k = len(places)
    tag = lambda i: lambda x: F.struct(x.cast("int").alias("at"), F.lit(i).alias("term"))
    tagged = [F.transform(p, tag(i)) for i, p in enumerate(places)]
    start = F.struct(F.array_repeat(F.lit(-1), k).alias("last"), F.lit(0.0).alias("total"), F.lit(-1).alias("floor"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == x["term"], x["at"]).otherwise(v))
        moved = F.transform(F.array(last), lambda own: F.struct(own.alias("last"), F.array_min(own).alias("begin")))
        return F.element_at(
            F.transform(
                moved,
                lambda m: F.struct(
                    m["last"].alias("last"),
                    F.when(m["begin"] > s["floor"], s["total"] + F.lit(WEIGHT) / (1 + (x["at"] - m["begin"]) - (k - 1))).otherwise(s["total"]).alias("total"),
                    F.greatest(m["begin"], s["floor"]).alias("floor"),
                ),
            ),
            1,
        )

    return F.aggregate(F.array_sort(F.flatten(F.array(*tagged))), start, step, lambda s: s["total"]) if k else F.lit(0.0)


def cover_rank(words: Column, terms: list[str]) -> Column:
    """The cover score of an array of words."""
    at = lambda t: F.filter(F.transform(words, lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull())
    return cover_score([at(t) for t in terms])


def search(windows: DataFrame, text: str, k: int = 120) -> DataFrame:
    """The k best windows for a web-style query: window_id, doc_id, page_start, page_end, text and score."""
    query = parse(text)
    found = windows.withColumn("words", word_array(F.col("text"))).filter(matches(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), query))
    single = len(query.terms) == 1
    score = F.size(F.filter("words", lambda w: w == query.terms[0])) * F.lit(WEIGHT) if single else cover_rank(F.col("words"), query.terms)
    return found.withColumn("score", score).drop("words").orderBy(F.desc("score"), "window_id").limit(k)


def runs(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts by term: the distinct terms; the term and the text of each run, in that order; where in `at` each run begins
    and, last, ends; and the places of the words, run by run in ascending order."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    text = np.repeat(np.arange(len(words)), lengths)
    at = (np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)[order]
    code, text = code[order], text[order]
    begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (text[1:] != text[:-1]))[: len(code)])
    return flat.dictionary, code[begins], text[begins], np.append(begins, len(code)).astype(np.int32), at


def postings(windows: DataFrame) -> DataFrame:
    """(term, window_id, tf, positions): an inverted index, made within the row; write it partitioned by a hash of the term for repeated use."""
    shipped(windows.sparkSession)
    rows = windows.select("window_id", word_array(F.col("text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, term, text, ends, at = runs(batch.column("words"))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at))
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(term)), batch.column("window_id").take(pa.array(text)), pa.array(np.diff(ends).astype(np.int64)), places], ["term", "window_id", "tf", "positions"])

    return rows.mapInArrow(run, f"term string, window_id {rows.schema['window_id'].dataType.simpleString()}, tf long, positions array<int>")


def bm25(windows: DataFrame, terms: list[str], k: int = 120, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best windows by BM25 over the terms. Corpus figures are one row, whatever the corpus."""
    rows = windows.select("window_id", "doc_id", word_array(F.coalesce("text", F.lit(""))).alias("words"))
    times = lambda term: F.size(F.filter("words", lambda w: w == term))
    counted = rows.select("window_id", "doc_id", F.size("words").alias("length"), *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    facts = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, n = facts[f"df{i}"] or 0, facts["n"]
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(facts["mean"] or 1.0)))
    return counted.select("window_id", "doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "window_id").limit(k)
