"""References in page texts: addresses, standards, laws and German cross-references, with their places.

`find` needs places of every match, which Spark's functions don't give, so it is one Arrow-batched function; the `*_refs`
columns list normalised references alone and stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.cluster import shipped

# What the classes of references look like, and how sure each is.
URL = r"https?://[^\s<>\"')\]]+"
URL_END = ".,;:)]}\"'"
ISO = r"\b(?:DIN\s*(?:EN\s*)?)?ISO\s*(\d{4,5})(?:[-:]\d+)?\b"
LAWS = [
    ("DSGVO", r"\b(?:Art\.?\s*)?(\d+)\s*(?:Abs\.?\s*\d+)?\s*(?:DSGVO|GDPR|DS-GVO)\b"),
    ("BDSG", r"\b§?\s*(\d+[a-z]?)\s*(?:Abs\.?\s*\d+)?\s*BDSG\b"),
]
SECTION = r"§\s*(\d+[a-z]?)\s*(?:Abs\.?\s*\d+)?\s*([A-Z]{2,6})\b"
CROSS = [
    r"(?:siehe|s\.)\s+(?:auch\s+)?[„\"]?(.{10,100}?)[\"]?(?:\.|,|\n|$)",
    r"gemäß\s+[„\"]?(.{10,100}?)[\"]?(?:\.|,|\n|$)",
    r"laut\s+[„\"]?(.{10,100}?)[\"]?(?:\.|,|\n|$)",
    r"nach\s+(?:Maßgabe\s+)?[„\"]?(.{10,100}?)[\"]?(?:\.|,|\n|$)",
]
SURE = {"link": 1.0, "url": 0.95, "iso": 0.95, "law": 0.9, "internal_ref": 0.7}
SHAPE = "array<struct<kind:string,raw:string,ref:string,at:int,sure:double>>"

_URL, _ISO = re.compile(URL, re.I), re.compile(ISO, re.I)
_LAWS = [(name, re.compile(p, re.I)) for name, p in LAWS]
_CROSS = [re.compile(p, re.I) for p in CROSS]


def references(text: str, compat: bool = False) -> list[dict]:
    """References of one page, the first of each normalised form, by class in a fixed order.

    compat: a section sign counts only right behind a word character, as in the pattern that this follows.
    """
    section = re.compile((r"\b" if compat else r"(?<!\w)") + SECTION)
    found: dict[str, dict] = {}

    def add(kind: str, key: str, match: re.Match, ref: str) -> None:
        found.setdefault(key, {"kind": kind, "raw": match[0], "ref": ref, "at": match.start(), "sure": SURE[kind]})

    for m in _URL.finditer(text):
        url = m[0].rstrip(URL_END)
        add("url", url, m, url)
    for m in _ISO.finditer(text):
        add("iso", f"ISO {m[1]}", m, f"ISO {m[1]}")
    for name, pattern in _LAWS:
        for m in pattern.finditer(text):
            add("law", f"{name} {m[1]}", m, f"{name} {m[1]}")
    for m in section.finditer(text):
        add("law", m[0].strip(), m, m[0].strip())
    for pattern in _CROSS:
        for m in pattern.finditer(text):
            ref = m[1].strip()
            if len(ref) >= 15 and ref.count(" ") <= 15:
                add("internal_ref", ref.lower(), m, ref)
    return list(found.values())


def find(text: Column, compat: bool = False) -> Column:
    """All references of a page with their places, as an array of structs."""

    shipped()

    @F.pandas_udf(SHAPE)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([references(t, compat) if t is not None else None for t in batch])

    return run(text)


def url_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({URL})"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:)\]}\"']+$", "")))


def iso_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + ISO), F.lit(1)), lambda n: F.concat(F.lit("ISO "), n)))


def law_refs(text: Column) -> Column:
    named = lambda name, p: F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), lambda n: F.concat(F.lit(name + " "), n))
    return F.array_distinct(F.concat(*[named(*law) for law in LAWS], F.regexp_extract_all(text, F.lit(rf"(?<!\w)({SECTION})"), F.lit(1))))


def cross_refs(text: Column) -> Column:
    """Cross-references of at least 15 characters and at most 15 spaces, one for each lower-case form and lead."""
    every = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), lambda r: F.trim(r)) for p in CROSS])
    return F.filter(every, lambda r: (F.char_length(r) >= 15) & (F.char_length(r) - F.char_length(F.replace(r, F.lit(" "), F.lit(""))) <= 15))


def link_refs(links: Column, page_no: Column) -> Column:
    """References by the embedded links (page_no, uri, text) of one page: web addresses, surest of all, the first of each."""
    web = F.filter(links, lambda x: (x["page_no"] == page_no) & (x["uri"].startswith("http://") | x["uri"].startswith("https://")))
    first = F.filter(web, lambda x, i: ~F.array_contains(F.transform(F.slice(web, 1, i), lambda y: y["uri"]), x["uri"]))
    named = lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["uri"])
    return F.transform(first, lambda x: F.struct(F.lit("url").alias("kind"), named(x).alias("raw"), x["uri"].alias("ref"), F.lit(-1).alias("at"), F.lit(SURE["link"]).alias("sure")))


def with_links(found: Column, links: Column, page_no: Column) -> Column:
    """All references of a page: those of its links, then those of its text that aren't among them. Links have no place (-1)."""
    own = F.coalesce(link_refs(links, page_no), F.array().cast(SHAPE))
    rest = F.filter(F.coalesce(found, F.array().cast(SHAPE)), lambda r: ~F.exists(own, lambda x: (x["ref"] == r["ref"]) & (r["kind"] == "url")))
    return F.concat(own, rest)
