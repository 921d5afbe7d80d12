"""Hits, anchors and cited documents into numbered evidence, a prompt, answers and event streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.functions.questions import Limits
from tessera.functions.text import answer_fields, event_text, location, preview, salvaged_json

# Labels and messages of answers.
UNKNOWN, CITED = "Unbekannt", "zitiert von Hauptquellen"
NO_EVIDENCE = "Nicht genügend belastbare Belege im Korpus gefunden."
ONE_SOURCE = "Nur eine Quelle gefunden. Für eine zuverlässige Antwort werden mindestens zwei unabhängige Belege benötigt."
NEXT_STEPS = "\n\nMögliche nächste Schritte:\n• Versuchen Sie eine spezifischere Formulierung der Frage\n• Prüfen Sie, ob relevante Dokumente bereits im System erfasst sind\n• Erweitern Sie die Suche auf verwandte Themen oder Begriffe"
FALLBACK_SOURCES, FALLBACK_CHARS, SNIPPET_CHARS, CITED_DOCS = 3, 3000, 200, 2


def packed(hits: DataFrame, anchors: DataFrame, cited: DataFrame, limits: Limits = Limits(), cited_docs: int = CITED_DOCS) -> DataFrame:
    """Sources numbered from 1: windows (doc_id, rank, title, page_start, page_end, text), then anchors, then cited documents."""
    n, m = limits.sources, limits.source_chars
    shape = lambda section, order, title, place, text: [F.lit(section).alias("section"), order.cast("int").alias("place"), F.col("doc_id"), title.alias("title"), place.alias("location"), text.alias("text")]
    pages = location(F.col("page_start"), F.col("page_end"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNKNOWN))
    cut = preview(F.col("text"), m)
    dotted = F.when(F.char_length("text") > m, F.concat(cut, F.lit("..."))).otherwise(cut)
    first = hits.filter(F.col("rank") <= n).select(*shape(1, F.col("rank"), title, pages, dotted))
    second = anchors.select(*shape(2, F.col("rank"), F.lit(None).cast("string"), F.format_string("Seite %d, %s", "page_no", "anchor_type"), cut))
    third = cited.filter(F.col("rank") <= cited_docs).select(*shape(3, F.col("rank"), title, pages, cut))
    # at most `sources` windows and anchors and two cited documents: a bounded table, numbered in one place
    bounded = first.unionByName(second.orderBy("place").limit(n))
    order = Window.partitionBy(F.lit(0)).orderBy("section", "place")
    numbered = bounded.withColumn("source_index", F.row_number().over(order)).filter(F.col("source_index") <= n)
    return numbered.drop("source_index").unionByName(third).withColumn("source_index", F.row_number().over(order))


def prompt(sources: DataFrame, question: str, limits: Limits = Limits(), cited: bool = False) -> DataFrame:
    """One row with the text that a model is asked: the question and the evidence; cited documents only if wanted."""
    order = Window.partitionBy("section").orderBy("source_index")
    shown = sources.withColumn("nth", F.row_number().over(order)).filter(((F.col("section") == 1) & (F.col("nth") <= limits.windows)) | ((F.col("section") == 2) & (F.col("nth") <= limits.anchors)) | (F.lit(cited) & (F.col("section") == 3)))
    head = F.when(F.col("section") == 2, "Anchor").otherwise(F.col("title"))
    text = F.when(F.col("section") == 2, preview(F.col("text"), limits.anchor_chars)).otherwise(preview(F.col("text"), limits.window_chars))
    part = F.concat(F.lit("\n["), F.col("source_index").cast("string"), F.lit("] "), head, F.lit(" ("), F.col("location"), F.lit(")\n"), text)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", part.alias("part")))), lambda s: s["part"]), "\n")
    return shown.agg(F.concat(F.lit(f"FRAGE: {question}\n\nQUELLEN:\n"), body).alias("prompt"))


def history(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The turns of each conversation as one text, in order."""
    line = F.concat(F.when(F.col("role") == "user", "Nutzer: ").otherwise("Assistent: "), "text")
    return turns.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n").alias("history"))


def answer_kind(reply: Column) -> Column:
    """cited, fallback or insufficient: what becomes of a model's reply."""
    fields = answer_fields(reply)
    plain = salvaged_json(reply).isNull()
    return (
        F.when(plain & (F.char_length(reply) > 100), "fallback")
        .when(plain, "insufficient")
        .when(fields["n_sources"] >= 1, "cited")
        .when(F.char_length(fields["answer"]) > 50, "fallback")
        .otherwise("insufficient")
    )


def insufficient(n_sources: Column) -> Column:
    """What is answered where there is too little evidence."""
    return F.concat(F.when(n_sources == 1, ONE_SOURCE).otherwise(NO_EVIDENCE), F.lit(NEXT_STEPS))


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]], sources: str = "sources") -> DataFrame:
    """prompts (prompt, sources: array of structs) with the model's reply and what becomes of it.

    A reply that isn't JSON but has something to say is the answer itself, with the first sources as its evidence.
    """

    shipped(prompts.sparkSession)

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.tolist()))

    reply = F.col("reply")
    fields = prompts.withColumn("reply", ask(F.col("prompt"))).withColumns({"kind": answer_kind(reply), "f": answer_fields(reply)})
    answer = F.when(F.col("kind") == "cited", F.col("f.answer")).when(F.col("kind") == "fallback", preview(F.coalesce("f.answer", "reply"), FALLBACK_CHARS)).otherwise(insufficient(F.col("f.n_sources")))
    shown = F.when(F.col("kind") == "fallback", F.slice(F.col(sources), 1, FALLBACK_SOURCES)).when(F.col("kind") == "cited", F.col(sources))
    confidence = F.when(F.col("kind") == "insufficient", "low").when(F.col("kind") == "fallback", "medium").otherwise(F.col("f.confidence"))
    return fields.withColumns({"answer": answer, "confidence": confidence, "evidence": shown}).drop("f")


def event_rows(answers: DataFrame) -> DataFrame:
    """The events of each answer (qid, sources, chunks): sources, a chunk for each part, done; as (qid, seq, event)."""
    parts = F.concat(F.array(F.struct(F.lit("sources").alias("kind"), F.to_json("sources").alias("data"))), F.transform("chunks", lambda c: F.struct(F.lit("chunk").alias("kind"), c.alias("data"))), F.array(F.struct(F.lit("done").alias("kind"), F.lit("{}").alias("data"))))
    return answers.select("qid", F.posexplode(parts).alias("seq", "e")).select("qid", "seq", event_text(F.col("e.kind"), F.col("e.data")).alias("event"))
