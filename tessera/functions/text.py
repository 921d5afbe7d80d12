"""Scalar text, URL, hash and array functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the rules count it, download marks in link texts, and marks of old versions in names.
WHITE = r"(?U)[\s\x1c-\x1f]+"
DOWNLOAD_MARKS = r"(?i)\s*(?:[(\[](?:PDF|Download|DOCX?|XLSX?)[)\]]|►|↓|⬇)\s*"
OLD_FILE = [r"[\s_]alt\d*\.[^.]+$", r"[\s_]alt[\s_]", r"^alt[\s_]", r"[\s_]old\d*\.[^.]+$", r"^old[\s_]", r"[\s_]archiv\d*\.[^.]+$", r"^archiv[\s_]", r"_v\d+\.[^.]+$"]
OLD_FOLDER = ["alt", "old", "archiv", "archive", "archived", "deprecated"]
DOCUMENT_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".html", ".htm", ".aspx", ".asp"]


def norm_text(text: Column) -> Column:
    """Any run of white space (or NUL) becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "\0", " "), WHITE, " "))


def clamp(text: Column, n: int) -> Column:
    """At most n code points; a cut text loses white space at its end."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.regexp_replace(F.substring(text, 1, n), r"(?U)[\s\x1c-\x1f]+\z", ""))


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def document_id(uri: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(uri, 256), 1, 16))


def anchor_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def cache_key(*parts: Column) -> Column:
    """The first 32 hex digits of the hash of all parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def location(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("Seite %d", first)).otherwise(F.format_string("Seite %d-%d", first, last))


def clean_anchor_text(text: Column) -> Column:
    """A link's text without download marks; null if nothing is left."""
    return F.nullif(norm_text(F.regexp_replace(text, DOWNLOAD_MARKS, " ")), F.lit(""))


def word_array(text: Column) -> Column:
    """Lower-case words: letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(word_array(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; zero if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def set_append(old: Column, new: Column) -> Column:
    """old with new at its end, unless it is there already."""
    return F.when(old.isNull(), F.array(new)).when(F.array_contains(old, new), old).otherwise(F.concat(old, F.array(new)))


def labelled_row(headers: list[str], values: list[Column]) -> Column:
    """`Header: value` for every value that isn't blank, joined by bars; blank headers are numbered."""
    parts = []
    for i, (header, value) in enumerate(zip(headers, values), 1):
        name = header.strip() or f"Spalte{i}"
        bare = F.trim(value.cast("string"))
        parts.append(F.when(bare != "", F.concat(F.lit(name + ": "), bare)))
    return F.concat_ws(" | ", *parts)


def packed_parts(text: Column, most: int = 12_000, between: str = "\n\n") -> Column:
    """Parts of a text put greedily into pages: a new one starts where the parts' lengths would pass `most`."""
    start = F.struct(F.array().cast("array<string>").alias("pages"), F.lit("").alias("page"), F.lit(0).alias("size"))

    def add(a: Column, part: Column) -> Column:
        full = (a["size"] + F.char_length(part) > most) & (a["size"] > 0)
        grown = F.when(a["size"] > 0, F.concat(a["page"], F.lit(between), part)).otherwise(part)
        return F.struct(
            F.when(full, F.concat(a["pages"], F.array(a["page"]))).otherwise(a["pages"]).alias("pages"),
            F.when(full, part).otherwise(grown).alias("page"),
            F.when(full, F.char_length(part)).otherwise(a["size"] + F.char_length(part)).alias("size"),
        )

    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(parts, start, add, lambda a: F.when(a["size"] > 0, F.concat(a["pages"], F.array(a["page"]))).otherwise(F.array(F.lit(""))))


# ---- URLs


def category_from_url(url: Column, categories: dict[str, str]) -> Column:
    """The category that the first v (or V) parameter stands for, by a map of known values."""
    value = F.nullif(F.regexp_extract(url, r"[?&][vV]=([^&#]*)", 1), F.lit(""))
    if not categories:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in sorted(categories.items()) for x in kv])
    return F.try_element_at(table, value)


def category_map(setting: str) -> dict[str, str]:
    """`A:Alpha,B:Beta` as a map; pairs without a colon don't count."""
    pairs = (p.split(":", 1) for p in setting.split(",") if ":" in p)
    return {k.strip(): v.strip() for k, v in pairs}


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def without_dots(url: Column) -> Column:
    """An absolute address whose path has no `.` and `..` segments; what would lead above the root stays at it."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    parts = F.split(path, "/")
    up = lambda own: F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(1)))  # noqa: E731  the empty part before the first slash stays
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda own, x: F.when(x == ".", own).when(x == "..", up(own)).otherwise(F.concat(own, F.array(x))))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(?:/|$)")), F.concat(origin, F.array_join(closed, "/"), tail)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """An absolute address from a page's and a link's."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.regexp_like(plain, F.lit(r"://[^/]*/")), F.regexp_replace(plain, "[^/]*$", "")).otherwise(F.concat(plain, F.lit("/")))
    joined = (
        F.when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(folder, href))
    )
    return F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href).otherwise(without_dots(joined))


def document_extension(url: Column, allowed: list[str] = DOCUMENT_EXTENSIONS) -> Column:
    """The document extension of the path, else the longest one in the query string, else null."""
    path = F.lower(F.regexp_extract(without_fragment(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?]*)", 1))
    query = F.lower(F.regexp_extract(without_fragment(url), r"\?(.*)$", 1))
    ending = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    out = F.when(ending.isin(allowed), ending)
    for extension in sorted(allowed, key=lambda e: (-len(e), e)):
        out = out.when(F.contains(query, F.lit(extension)), F.lit(extension))
    return out


def unwrapped_mailto(href: Column) -> Column:
    """The web address inside a mailto link; null for other mail links and schemes that aren't the web's."""
    inner = F.nullif(F.regexp_extract(href, r"(https?://[^\s&\"']+)", 1), F.lit(""))
    lower = F.lower(href)
    other = F.regexp_like(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")) & ~lower.startswith("http://") & ~lower.startswith("https://")
    return F.when(lower.startswith("mailto:"), inner).when(other, F.lit(None)).otherwise(href)


def old_version_reason(uri: Column) -> Column:
    """filename_pattern or folder_pattern where a path names an old version, else null."""
    name = F.lower(F.element_at(F.split(uri, "/"), -1))
    return F.when(F.regexp_like(name, F.lit("|".join(OLD_FILE))), F.lit("filename_pattern")).when(F.regexp_like(F.lower(uri), F.lit(f"/(?:{'|'.join(OLD_FOLDER)})/")), F.lit("folder_pattern"))


def local_to_url(path: Column, root: str, base: str, renamed: dict[str, str]) -> Column:
    """The address of a local file: its path under root, folders renamed, forward slashes, joined to base."""
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + root.rstrip("/") + "/", "")
    for old, new in sorted(renamed.items()):
        out = F.regexp_replace(out, rf"(^|/){old}/", f"$1{new}/")
    return F.concat(F.lit(base.rstrip("/") + "/"), out)


def html_title(source: Column) -> Column:
    return F.nullif(norm_text(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


# ---- answers


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def salvaged_json(text: Column) -> Column:
    """The first of these that is JSON: the text, a fenced block in it, the first flat object in it; else null."""
    bare = F.trim(without_thoughts(text))
    fenced = F.trim(F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    flat = F.regexp_extract(bare, r"(\{[^{}]*\})", 1)
    sound = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x)
    return F.coalesce(sound(bare), sound(fenced), sound(flat))


#: Keys of a reply that never are the answer.
OTHER_KEYS = ["sources", "source", "overall_confidence", "confidence"]


def answer_fields(text: Column) -> Column:
    """answer, confidence and number of sources of a salvaged reply. An answer under another name is the first other key with a string."""
    doc = salvaged_json(text)
    fields = F.from_json(doc, "map<string,variant>")
    named = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(OTHER_KEYS) & (F.schema_of_variant(e["value"]) == "STRING"))
    first = F.try_element_at(F.transform(named, lambda e: F.variant_get(e["value"], "$", "string")), F.lit(1))
    answer = F.when(F.map_contains_key(fields, "answer"), F.get_json_object(doc, "$.answer")).otherwise(first)
    sources = F.from_json(F.coalesce(F.get_json_object(doc, "$.sources"), F.get_json_object(doc, "$.source")), "array<string>")
    confidence = F.coalesce(F.get_json_object(doc, "$.overall_confidence"), F.get_json_object(doc, "$.confidence"), F.lit("medium"))
    return F.struct(answer.alias("answer"), confidence.alias("confidence"), F.coalesce(F.size(sources), F.lit(0)).alias("n_sources"))


def event_text(kind: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def stream_chunks(body: Column) -> Column:
    """The payloads of the data lines of an event stream up to its end mark."""
    lines = F.split(F.split_part(body, F.lit("data: [DONE]"), F.lit(1)), "\n")
    return F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.substring(x, 7, 1 << 30))
