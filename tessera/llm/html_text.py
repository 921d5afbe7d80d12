"""HTML extraction: markup first, then substrings that a whole host repeats.

A page is read into blocks, each with a zone. What the markup itself names as something else than the article (navigation,
headers, footers, sidebars, forms, scripts, notices, adverts, comments, by element or by a word in class, id or role) is
outside (within an article only if the whole name says so: a section about comments is text); what stands in an article or
main element is inside; the rest is open. A page with inside blocks consists of those, another one of its open blocks, less the
boilerplate of its host.

Boilerplate is found by suffix arrays. The token streams of a host's pages, parted into chunks of bounded size, are
concatenated (a token of its own between blocks, so that no substring crosses them), suffixes are sorted by prefix doubling,
and neighbours in the suffix array with a common prefix of WINDOW tokens or more mark substrings that recur. Those that stand
in SHARE or more of a host's pages, and in MIN_PAGES at least, are boilerplate. What stands in that share of a host's pages
stands in that share of some chunk's, so chunks only propose; what a host of several chunks really repeats is then counted
over all of its pages, and results don't depend on how pages are dealt. A block goes where more than COVERED of its tokens lie
in boilerplate; blocks of MIN_TOKENS to WINDOW tokens count as a whole, and shorter ones are never judged. A page that would
keep less than LEFT of its tokens is a copy of others, not a frame, and stays whole.

Substrings that only some pages share are text: lines and passages that many articles quote are no boilerplate. Tokens are
told apart by 16-bit hashes, a window so by 128 bits.

Nulls: a null html is empty and has an empty text; a null url is a host of its own. Repeated rows count as pages each and are
extracted one by one; equal pages have equal texts. Very long pages are whole, in a chunk of their own. Ties can't arise. An
empty table gives an empty table. Only the id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, written

MIN_TOKENS, WINDOW, MIN_PAGES, SHARE, COVERED, LEFT = 4, 8, 5, 0.8, 0.5, 0.1
CHUNK_BYTES = 4 << 20
#: Fills up a short block's window; separators are numbered from the next one.
PAD = 1 << 16
STEP = np.uint64(0x9E3779B97F4A7C15)
INSIDE, OPEN, OUTSIDE = 2, 1, 0

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW_TAGS = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN_TAGS = frozenset("head script style template noscript iframe object svg math canvas audio video noframes noembed".split())
OUTSIDE_TAGS = frozenset("nav aside footer form menu dialog button select textarea fieldset label datalist search".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Elements that a later one of their kind closes, and what bounds that.
CLOSES = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Words of class, id or role that name something else than the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead header footer foot copyright legal comment comments commentlist reply replies respond disqus "
    "share sharing social related recommended recommendations trending popular pagination pager tags toc complementary contentinfo search".split()
)
#: Words of names that say how or where something stands, not what it is.
PLAIN = frozenset("list section box block container wrapper wrap area item items inner outer left right top bottom small large wide inline row col column group panel unit slot sticky fixed float active visible mobile desktop main content body text".split())
PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


def _zone(tag: str, attributes: str, zone: int, depth_inside: bool) -> int:
    if zone == OUTSIDE or tag in OUTSIDE_TAGS or (tag == "header" and not depth_inside):
        return OUTSIDE
    if tag in ARTICLE_TAGS:
        zone = INSIDE
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and "true" in values):
                return OUTSIDE
            if name in ("class", "id", "role"):
                value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower()
                words = set(WORD.findall(value))
                if depth_inside:
                    # within an article a section may be about comments or notices: only names that say nothing else count
                    words -= PLAIN | {"header"}  # an article's own header is its title
                    if words and words <= HINTS:
                        return OUTSIDE
                elif not HINTS.isdisjoint(words):
                    return OUTSIDE
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values).lower()):
                return OUTSIDE
    return zone


def blocks(source: str) -> list[tuple[str, int]]:
    """(text, zone) of every block of a page that isn't empty, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, zone and whether its text is unseen
    run: list[str] = []
    zone, unseen, at = OPEN, False, 0
    inside = 0

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append((text, zone))
        run.clear()

    def pop() -> None:
        nonlocal zone, unseen, inside
        tag = stack.pop()[0]
        if tag in ARTICLE_TAGS:
            inside -= 1
        zone, unseen = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    while True:
        piece = PIECES.search(source, at)
        end = piece.start() if piece else len(source)
        if end > at and not unseen:
            run.append(entities.unescape(source[at:end]))
        if not piece:
            break
        at = piece.end()
        name = piece[2]
        if not name:
            continue
        tag, closing = name.lower(), piece[1]
        if closing:
            if any(x[0] == tag for x in stack):
                while True:
                    top = stack[-1]
                    if top[0] in BLOCK_TAGS or top[1] != (stack[-2][1] if len(stack) > 1 else OPEN):
                        flush()
                    pop()
                    if top[0] == tag:
                        break
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "br":
            run.append(" ")
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            for open_, closers in CLOSES.items():
                if tag in closers:
                    _close(open_, stack, pop)
        own = _zone(tag, piece[3], zone, inside > 0)
        hidden = unseen or tag in UNSEEN_TAGS
        if piece[3].endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if own != zone:
            flush()
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            if not hidden and own != OUTSIDE and tag == "xmp":
                run.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
            continue
        stack.append((tag, own, hidden))
        zone, unseen = own, hidden
        inside += tag in ARTICLE_TAGS
    flush()
    return out


def _close(open_: str, stack: list, pop) -> None:
    """Closes an open element of that name, unless a block that may hold another one stands between."""
    for back in range(len(stack) - 1, -1, -1):
        tag = stack[back][0]
        if tag == open_:
            while len(stack) > back:
                pop()
            return
        if tag in BLOCK_TAGS and not (open_ in ("td", "th") and tag in ("p",)) and not (open_ == "tr" and tag in ("td", "th", "p")) and not (open_ in ("li", "dd", "dt") and tag == "p"):
            return


def own_text(page: list[tuple[str, int]]) -> list[str]:
    """The blocks that a page consists of before boilerplate is removed."""
    inside = any(z == INSIDE for _, z in page)
    return [text for text, z in page if z == (INSIDE if inside else OPEN)]


# ---- suffix arrays


def _places(key: np.ndarray) -> np.ndarray:
    """Places in ascending order of whole numbers below 2**40 or so, equal ones as they stand."""
    bits = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()) >> (63 - bits) == 0:
        return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order by prefix doubling, and the rank of every suffix by its first 1, 2, 4 ... tokens.

    A rank is the place of the first suffix of its group, and only groups of several suffixes are sorted further.
    """
    n = len(tokens)
    order = _places(tokens)
    ranks, width = [], 1
    rank = np.empty(n, np.int64)
    first = np.append(True, tokens[order][1:] != tokens[order][:-1])[:n]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.arange(n)
    while n:
        ranks.append(rank)
        open_ = open_[np.bincount(rank, minlength=n)[rank[open_]] > 1]
        if not len(open_) or width >= n:
            break
        after = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        groups = np.unique(rank[open_], return_inverse=True)[1]  # few bits for the sort's key
        at = _places(groups * (n + 1) + after)
        open_, groups, after = open_[at], groups[at], after[at]
        place = np.arange(len(open_))
        starts = np.append(True, groups[1:] != groups[:-1])
        parts = starts | np.append(True, after[1:] != after[:-1])
        begin = np.maximum.accumulate(np.where(starts, place, 0))
        rank = rank.copy()
        rank[open_] += np.maximum.accumulate(np.where(parts, place, 0)) - begin
        width *= 2
    return _places(rank), ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many tokens each suffix of the array shares with the one before it (none for the first)."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = order[1:] + shared[1:], order[:-1] + shared[1:]
        there = np.maximum(a, b) < n
        same = there & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        shared[1:] += np.where(same, 1 << k, 0)
    return shared


def windows(tokens: np.ndarray) -> np.ndarray:
    """A hash of every run of WINDOW tokens."""
    n = len(tokens) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = x * STEP + tokens[k : k + n].astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def recurring(streams: list[np.ndarray], pages: list[int], least: float) -> np.ndarray:
    """Hashes of the windows of token streams (one a block) that stand in `least` distinct pages or more, by suffix array."""
    if not streams:
        return np.empty(0, np.uint64)
    sizes = np.array([len(s) + 1 for s in streams])
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(sizes.sum(), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = np.concatenate(streams)
    tokens[ends] = PAD + 1 + np.arange(len(streams))  # each a token of its own
    page = np.repeat(np.array(pages), sizes)
    order, ranks = suffix_array(tokens)
    group = np.cumsum(common_prefixes(order, ranks) < WINDOW) - 1
    met = np.unique(group * (len(streams) + 1) + page[order]) // (len(streams) + 1)
    often = np.bincount(met, minlength=group[-1] + 1) >= least
    starts = order[np.flatnonzero(np.append(True, group[1:] != group[:-1]) & often[group])]
    starts = starts[ends[np.searchsorted(ends, starts)] >= starts + WINDOW]  # the rest of a block is shorter
    return np.unique(windows(tokens)[starts])


def hashed(texts: list[str]) -> list[np.ndarray]:
    """The tokens of blocks as 16-bit hashes; a short block is filled up to one window."""
    split = [t.split(" ") for t in texts]
    coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) & 0xFFFF for w in coded.dictionary.to_pylist()], np.int64)
    flat = names[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    out = np.split(flat, np.cumsum([len(words) for words in split])[:-1]) if split else []
    return [np.append(t, [PAD] * (WINDOW - len(t))) if MIN_TOKENS <= len(t) < WINDOW else t for t in out]


def main_text(own: list[str], hot: np.ndarray) -> str:
    """The blocks of a page without those that lie in the sorted windows hot."""
    if len(hot):
        sizes, stay = [t.count(" ") + 1 for t in own], []
        for tokens, size in zip(hashed(own), sizes):
            value = windows(tokens)
            begins = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value) if len(value) else []
            covered = np.zeros(max(len(tokens), WINDOW), bool)
            for k in range(WINDOW if len(begins) else 0):
                covered[begins + k] = True
            stay.append(covered[:size].mean() <= COVERED)
        if sum(n for n, s in zip(sizes, stay) if s) >= LEFT * sum(sizes):
            own = [t for t, s in zip(own, stay) if s]
    return "\n".join(own)


# ---- plans


def _streams(pages: DataFrame) -> DataFrame:
    """(grp, host_key, parts, sizes, tokens) of pages (host_key, parts, grp, html): block lengths and 16-bit tokens as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [own_text(blocks(h)) for h in batch.column("html").to_pylist()]
            made = hashed([t for page in own for t in page])
            sizes, tokens, at = [], [], 0
            for page in own:
                mine = made[at : at + len(page)]
                at += len(page)
                sizes.append(np.array([len(m) for m in mine], "<u4").tobytes())
                tokens.append(b"".join(np.where(m == PAD, 0, m).astype("<u2").tobytes() for m in mine))
            pads = [np.array([np.count_nonzero(m == PAD) for m in made[a:b]], "u1").tobytes() for a, b in _spans([len(p) for p in own])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("grp", "host_key", "parts")], *[pa.array(x, pa.binary()) for x in (sizes, pads, tokens)]], ["grp", "host_key", "parts", "sizes", "pads", "tokens"])

    return pages.mapInArrow(run, "grp long, host_key long, parts int, sizes binary, pads binary, tokens binary")


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = 0
    for n in sizes:
        yield at, at + n
        at += n


def proposed(streams: DataFrame) -> DataFrame:
    """(host_key, window, sure): what SHARE of a chunk's pages repeat; sure where the chunk is all of a host."""

    def run(group: pa.Table) -> pa.Table:
        rows, found, of = group.num_rows, [], []
        host, whole = group.column("host_key")[0].as_py(), group.column("parts")[0].as_py() == 1
        if rows >= MIN_PAGES or not whole:
            for page, (sizes, pads, tokens) in enumerate(zip(*(group.column(c).to_pylist() for c in ("sizes", "pads", "tokens")))):
                flat, pad = np.frombuffer(tokens, "<u2").astype(np.int64), np.frombuffer(pads, "u1").tolist()
                for (a, b), n in zip(_spans(np.frombuffer(sizes, "<u4").tolist()), pad):
                    found.append(np.append(flat[a : b - n], [PAD] * n) if n else flat[a:b])
                    of.append(page)
        out = recurring(found, of, max(MIN_PAGES, SHARE * rows) if whole else SHARE * rows).view(np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(out), host)), pa.array(out), pa.array(np.full(len(out), whole))], ["host_key", "window", "sure"])

    return streams.groupBy("grp").applyInArrow(run, "host_key long, window long, sure boolean")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host_key").agg(F.sort_array(F.collect_set("window")).alias("hot"))


def counted(pages: DataFrame, open_: DataFrame) -> DataFrame:
    """(host_key, window, n): in how many pages of their host the windows of open_ (host_key, window) stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, values = [], []
            for host, html, hot in zip(*(batch.column(c).to_pylist() for c in ("host_key", "html", "hot"))):
                own = hashed(own_text(blocks(html)))
                mine = np.intersect1d(np.concatenate([windows(t) for t in own]).view(np.int64) if own else np.empty(0, np.int64), np.array(hot, np.int64))
                values.append(mine)
                hosts.append(np.full(len(mine), host))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hosts)), pa.array(np.concatenate(values))], ["host_key", "window"])

    met = pages.join(_listed(open_), "host_key").select("host_key", "html", "hot").mapInArrow(run, "host_key long, window long")
    return met.groupBy("host_key", "window").agg(F.count("*").alias("n"))


def extract(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = pages.sparkSession
    shipped(spark)
    read = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    read = read.withColumn("host_key", F.xxhash64(F.coalesce(host, F.lit(""))))
    with Scratch(spark, "html") as scratch:
        size = read.groupBy("host_key").agg(F.sum(F.octet_length("html")).alias("size"), F.count("*").alias("pages"))
        # hosts of several chunks are few and written, so the planner knows their size and moves no page for the join
        large = scratch.written(size.select("host_key", "pages", F.ceil(F.col("size") / chunk_bytes).cast("int").alias("parts")).filter("parts > 1"), "hosts")
        dealt = read.join(large.select("host_key", "parts"), "host_key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        chunk = F.xxhash64("host_key", F.pmod(F.xxhash64("page_id", "html"), F.col("parts")))
        found = scratch.written(proposed(_streams(dealt.select(chunk.alias("grp"), "host_key", "parts", "html"))), "proposed")
        open_ = found.filter("NOT sure").select("host_key", "window").distinct()
        split = dealt.filter("parts > 1").select("host_key", "html")
        real = counted(split, open_).join(large, "host_key").filter((F.col("n") >= SHARE * F.col("pages")) & (F.col("n") >= MIN_PAGES))
        hot = written(_listed(found.filter("sure").select("host_key", "window").unionByName(real.select("host_key", "window"))), "html-boilerplate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.sort(np.array(h or [], np.int64).view(np.uint64)) for h in batch.column("hot").to_pylist()]
            texts = [main_text(own_text(blocks(s)), h) for s, h in zip(batch.column("html").to_pylist(), lists)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    schema = read.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return read.join(hot, "host_key", "left").select("page_id", "url", "html", "hot").mapInArrow(run, schema)
