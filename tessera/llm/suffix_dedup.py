"""Removal of long repeated byte strings by suffix arrays and longest-previous-factor arrays.

A text is its UTF-8 bytes; what is judged are its windows, all strings of `length` bytes within one text. A window is removed
if an equal one starts anywhere else (keep="none"), or anywhere earlier (keep="first": by the least id of a text, then by
place), and a byte goes if any removed window covers it. Windows are judged on the input, not on what is left.

All texts together don't fit one suffix array, so windows are dealt by their anchor: of the grams (short strings) that a window
holds, the leftmost one with the least hash. Equal windows have equal anchors, so all that may match meets. Neighbouring windows
with one anchor form a segment, a string that is moved whole. The steps, each a Spark job over tables in the shared folder:

1. Equal texts become one, with their number. The table is dealt by a hash of the text, once; texts move no more after that.
2. Anchors are counted over all different texts; texts learn which of their own occur more than once, and where their segments lie.
   The rest needs no more work: what stands once in a text and in no other text is repeated by that text's copies only.
3. Segments of those anchors are grouped by content, so that copies become one row with a count before they are shuffled.
4. Different segments that share an anchor are cut to what may be repeated: equal windows lie alike around their anchor, so a segment
   keeps as many bytes on either side of it as it has in common with any other; without `length` of them it has no such window. The
   cut segments are concatenated, arrays of bounded size at a time. The suffix order of all window
   starts is made by prefix doubling; neighbours in it have common prefixes; and the nearest smaller places on both sides of a suffix
   give its longest previous factor, the nearest greater places its longest later one. Windows are removed where such a factor has
   `length` bytes.
5. Texts learn which of their segments have such windows, and bytes are removed.

An anchor of CROWD different segments or more would make an unbounded chunk. Its segments, one of each content, are cut into bands
of BAND windows, by how far a window begins before the anchor. What all windows of a band have in common, all but BAND - 1 of their
bytes, is the anchor of the next round. Where even that is crowded windows are keyed by all of their bytes: then what meets are equal
windows only, which counting has made one row. Copies never come to this, since they are one segment with a count, and a text meets
its segments by a row for each of them, however many windows that has. Keys of segments and texts are 128-bit hashes of their bytes.

Nulls: a null text is empty; null ids stay and count as least. Empty texts and those shorter than `length` stay. Repeated rows
are texts of their own: with keep="none" they lose all windows, with keep="first" rows that share both id and text all stay. Very
long texts are read in pieces that overlap. Ties can't arise. An empty table gives an empty table. Other columns go along in
`row` and can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, written

LENGTH, GRAM, CROWD, BAND = 200, 32, 10_000, 16
#: Bytes that are hashed together (so few that their arrays stay in a core's cache), of segments that one task takes at a time, and of anchors' segments in one suffix array.
PIECE, CHUNK, BATCH = 1 << 18, 4 << 20, 1 << 17
MULTIPLY, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
SPAN = "array<struct<begin:int,end:int>>"


# ---- anchors and segments


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number that orders as they do, with zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes at every place that has so many; gram is a multiple of eight."""
    words = _words(data)[: max(0, len(data) - 7)]
    n = max(0, len(data) - gram + 1)
    x = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        x = (x ^ words[at : at + n]) * MULTIPLY
        x ^= x >> FOLD
    return x * MULTIPLY


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each window, and the hash of the gram at each place. Takes up to two million bytes."""
    hashes = _grams(data, gram)
    held = hashes >> np.uint64(21) << np.uint64(21) | np.arange(len(hashes), dtype=np.uint64)  # equal hashes by place
    wide, width = length - gram + 1, 1
    while 2 * width <= wide:
        held = np.minimum(held[:-width], held[width:]) if len(held) > width else held[:0]
        width *= 2
    n = max(0, len(data) - length + 1)
    held = np.minimum(held[:n], held[wide - width : wide - width + n])
    return (held & np.uint64((1 << 21) - 1)).astype(np.int64), hashes


def gram_of(length: int) -> int:
    return max(8, min(GRAM, length // 2 // 8 * 8))


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first, last, anchor): runs of windows with one anchor, by the places of their first and last window, and its hash."""
    for text, first, last, _, anchor in led(texts, length):
        yield text, first, last, anchor


def led(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first, last, lead, anchor): segments, and how far the anchor lies behind the first window's begin."""
    gram = gram_of(length)
    for group in _pieces([len(t) for t in texts], length):
        data = np.frombuffer(b"".join(texts[k][begin:end] for k, begin, end in group), np.uint8)
        text, begin, end = (np.array(x, np.int64) for x in zip(*group))
        stop = np.cumsum(end - begin)
        at, hashes = anchors(data, length, gram)
        # a segment ends where the anchor changes and with its piece; what lies across two pieces is no window
        edges = np.unique(np.concatenate([np.flatnonzero(at[1:] != at[:-1]) + 1, stop - (end - begin), stop - length + 1]))
        edges = edges[edges <= len(at)]
        own = np.searchsorted(stop, edges[:-1], side="right")
        inside = edges[:-1] + length <= stop[own]
        first, last, own = edges[:-1][inside], edges[1:][inside] - 1, own[inside]
        moved = begin[own] - (stop - end + begin)[own]
        yield text[own], first + moved, last + moved, at[first] - first, hashes[at[first]].view(np.int64)


def _pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) in groups of about PIECE bytes; long texts in pieces that share all but one byte of a window."""
    group, held = [], 0
    for k, size in enumerate(sizes):
        for begin in range(0, max(0, size - length + 1), PIECE):
            end = min(size, begin + PIECE + length - 1)
            if group and held + end - begin > PIECE + length:
                yield group
                group, held = [], 0
            group.append((k, begin, end))
            held += end - begin
    if group:
        yield group


def named(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(text, first, last, lead, anchor), in order, of the segments in lists of {h, at}, one list for each text; at: first, last and lead of each as bytes."""
    one = lists.flatten()
    at = one.field("at").to_pylist()
    many = np.array([len(x) // 12 for x in at], np.int64)
    first, last, lead = np.frombuffer(b"".join(at), "<i4").reshape(-1, 3).T
    text = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), many)
    order = np.lexsort((first, text))
    return tuple(x[order] for x in (text, first, last, lead, np.repeat(one.field("h").to_numpy(), many)))


def bands(text: bytes, length: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, what they share) of runs of up to `width` windows of a segment that begin as far before its anchor as those of any other.

    Equal windows of segments with one anchor share the same; a width of one takes windows by themselves.
    """
    at = int(anchors(np.frombuffer(text[:length], np.uint8), length, gram_of(length))[0][0]) if width > 1 else len(text) - length
    first, n = 0, len(text) - length + 1
    while first < n:
        latest = at - (at - first) // width * width
        yield first, min(n - 1, latest), text[latest : latest - width + 1 + length]
        first = latest + 1


# ---- suffix order and factors


def _places(key: np.ndarray, below: int) -> np.ndarray:
    """Places in ascending order of whole numbers from 0 up to `below`, equal ones as they stand."""
    bits = max(1, (len(key) - 1).bit_length())
    if below.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    # sorting numbers is much faster than sorting places, so the place goes along in the low bits
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by what a rank stands for now, then by the rank `step` places on; only groups of several places are sorted.

    A rank is where the group of equal strings begins in order.
    """
    n = len(rank)
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    if not len(open_):
        return rank
    after = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
    many = size > 1
    group = (np.cumsum(many) - 1)[rank[open_]]
    key = group * (n + 1) + after
    order = _places(key, int(many.sum()) * (n + 1))
    open_, key, group = open_[order], key[order], group[order]
    place = np.arange(len(open_))
    begins = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), place, 0))
    parts = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
    out = rank.copy()
    out[open_] += parts - begins
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the `length` bytes from there on, equal ones by place, and the common prefix of each with the one before.

    Every start has `length` bytes. Prefixes are counted up to `length`.
    """
    words, width = _words(data), 5
    first = (words >> np.uint64(24)).astype(np.int64)
    order = _places(first, 1 << 40)
    rank = np.empty(len(order), np.int64)
    held = first[order]
    rank[order] = np.maximum.accumulate(np.where(np.append(True, held[1:] != held[:-1])[: len(held)], np.arange(len(held)), 0))
    ranks = [(width, rank)]
    while 2 * width <= length:
        ranks.append((2 * width, _doubled(ranks[-1][1], width)))
        width *= 2
    if width < length:  # the last step overlaps: it compares what is known to be equal once more
        ranks.append((length, _doubled(ranks[-1][1], length - width)))
    final = ranks[-1][1][starts]
    by = _places(final, len(data))
    ordered, final = starts[by], final[by]
    common = np.zeros(len(ordered), np.int64)
    equal = np.append(False, final[1:] == final[:-1])[: len(final)]
    near = np.flatnonzero(~equal)[1:]  # the first has none before it
    a, b, shared = ordered[near - 1], ordered[near], np.zeros(len(near), np.int64)
    for width, rank in reversed([r for r in ranks if r[0] < length]):
        at, bt = np.minimum(a + shared, len(data) - 1), np.minimum(b + shared, len(data) - 1)
        shared += np.where((shared + width <= length) & (rank[at] == rank[bt]), width, 0)
    at, bt = np.minimum(a + shared, len(data) - 1), np.minimum(b + shared, len(data) - 1)
    differ = words[at] ^ words[bt]
    for k in range(1, 8):
        shared += differ >> np.uint64(64 - 8 * k) == 0
    common[near], common[equal] = np.minimum(shared, length), length
    return ordered, common


def _nearest(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it in order that has a smaller place; 0 where it is below `least`.

    Each suffix looks at the one before it and, while that has a greater place, goes on to where that one looks: what lies between
    is greater than both. Paths halve each round.
    """
    to, held = np.arange(len(place)) - 1, common.copy()
    open_ = np.flatnonzero((to >= 0) & (held >= least))
    while len(open_):
        open_ = open_[place[to[open_]] > place[open_]]
        back = to[open_]
        to[open_], held[open_] = to[back], np.minimum(held[open_], held[back])
        open_ = open_[(to[open_] >= 0) & (held[open_] >= least)]
    return np.where((to >= 0) & (held >= least), held, 0)


def previous_factors(place: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest prefix that each suffix, in order, shares with one of a smaller place; 0 where it is below `least`."""
    back = np.append(common[1:], 0)[::-1] if len(common) else common
    back = np.append(0, back[1:])[: len(back)]
    return np.maximum(_nearest(place, common, least), _nearest(place[::-1], back, least)[::-1])


def reach(parts: list[bytes], group: list[int]) -> np.ndarray:
    """The longest prefix that each string has in common with another one of its group. In order, neighbours have it."""
    order = sorted(range(len(parts)), key=lambda k: (group[k], parts[k]))
    size, own = (np.array(x, np.int64)[order] for x in ([len(p) for p in parts], group))
    wide = int(size.max()) + 1
    rows = np.frombuffer(b"".join(parts[k].ljust(wide, b"\0") for k in order), np.uint8).reshape(-1, wide)
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    shared = np.minimum(shared, np.minimum(size[1:], size[:-1])) * (own[1:] == own[:-1])
    out = np.empty(len(parts), np.int64)
    out[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
    return out


def cores(pieces: list[bytes], lead: list[int], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of what each segment, whose anchor lies at lead, may share with another one of its group: no window beyond that is in both."""
    before = reach([p[at - 1 :: -1] if at else b"" for p, at in zip(pieces, lead)], group)
    return np.array(lead) - before, np.array(lead) + reach([p[at:] for p, at in zip(pieces, lead)], group)


def repeated_windows(pieces: list[bytes], length: int, keep: str) -> list[np.ndarray]:
    """Whether each window of each of the strings, in the order that makes earlier and later, is repeated."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(ends, sizes))
    order, common = suffix_order(data, starts, length)
    hit = previous_factors(order, common, length) > 0
    if keep == "none":
        hit |= previous_factors(-order, common, length) > 0
    found = np.zeros(len(data), bool)
    found[order[hit]] = True
    return [found[e - n : e - length + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


# ---- the jobs


def _texts(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(sha, n, first, text) of every distinct text, dealt by sha."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(_sha(body), F.col(key).alias("first"), body.alias("text"))
    # in a struct null comes first
    one = rows.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct(F.col("first").alias("id"))).alias("first"), F.any_value("text").alias("text"))
    return scratch.bucketed(one, "texts", "sha", compression="zstd")


def _sha(body: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("sha")


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(h, sha, places, at): the anchors of every text, in how many of its segments each stands, and first, last and lead of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, first, last, lead, anchor in led(batch.column("text").to_pylist(), length):
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                begins = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])))
                ends = np.append(begins, len(text))
                at = np.stack([first, last, lead], axis=1)[order].astype("<i4")
                at = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((12 * ends).astype(np.int32)), pa.py_buffer(at.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[begins]), batch.column("sha").take(pa.array(text[begins])), pa.array(np.diff(ends)), at], ["h", "sha", "places", "at"])

    return texts.select("sha", "text").mapInArrow(run, "h long, sha binary, places long, at binary")


def _segments(asked: DataFrame, length: int, whole: bool) -> DataFrame:
    """(s1, s2, place, and with whole: times, h, lead and bytes, else: last) of the segments in the lists of asked (sha, n, first, text, list).

    s1 and s2 are a segment's key; place is its text and its first window, in a form that orders. With whole a text's equal segments are one row.
    """
    names = ["s1", "s2", "sha", "at", "first"] + (["times", "h", "lead", "bytes"] if whole else ["last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            of, first, last, lead, h = named(batch.column("list"))
            if not len(of):
                continue
            own = [texts[k][a:b] for k, a, b in zip(of.tolist(), first.tolist(), (last + length).tolist())]
            keys = [xxhash.xxh3_128_digest(x) for x in own]
            times = batch.column("n").to_numpy()[of]
            if whole:
                met: dict[tuple, int] = {}
                row = np.array([met.setdefault(x, len(met)) for x in zip(of.tolist(), keys)])
                new = np.unique(row, return_index=True)[1]
                times = np.bincount(row, weights=times).astype(np.int64)
                of, first, lead, h, own, keys = of[new], first[new], lead[new], h[new], [own[k] for k in new.tolist()], [keys[k] for k in new.tolist()]
            ids, by = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2), pa.array(of)
            columns = [pa.array(ids[:, 0]), pa.array(ids[:, 1]), batch.column("sha").take(by), pa.array(first), batch.column("first").take(by)]
            columns += [pa.array(times), pa.array(h), pa.array(lead), pa.array(own, pa.binary())] if whole else [pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = asked.schema["first"].dataType.simpleString()
    found = asked.select("sha", "n", "first", "text", "list").mapInArrow(run, f"s1 long, s2 long, sha binary, at int, first {kind}, " + ("times long, h long, lead int, bytes binary" if whole else "last int"))
    return found.select("s1", "s2", F.struct("first", "sha", "at").alias("place"), *names[5:])


def _factors(distinct: DataFrame, length: int, keep: str, chunk: int) -> DataFrame:
    """(s1, s2, place, windows): the removed windows, as bits, of every segment that others of its anchor share windows with."""
    size = distinct.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    schema = distinct.select("s1", "s2", "place").withColumn("windows", F.lit(None).cast("binary")).schema

    def order(row: tuple) -> tuple:
        first = row[0]["first"]["id"]
        return first is not None, first, bytes(row[0]["sha"]), row[0]["at"]

    def run(group: pa.Table) -> pa.Table:
        # groups of one anchor, several of them to an array
        _, own, many = np.unique(group.column("h").to_numpy(), return_inverse=True, return_counts=True)
        sorted_ = np.argsort(own, kind="stable")
        sorted_ = sorted_[many[own[sorted_]] > 1]
        places, n, pieces, leads = (group.column(c).to_pylist() for c in ("place", "n", "bytes", "lead"))
        hit, marks, batch, held = [], [], {}, 0
        if len(sorted_):
            begin, end = cores([pieces[k] for k in sorted_], [leads[k] for k in sorted_], own[sorted_].tolist())
            some = np.flatnonzero(end - begin >= length)
            of = own[sorted_[some]]
            ends = np.append(of[1:] != of[:-1], True)[: len(of)]
            for k, a, b, full in zip(sorted_[some].tolist(), begin[some].tolist(), end[some].tolist(), ends.tolist()):
                batch[k] = a, b
                held += b - a
                if not full or (held < BATCH and k != sorted_[some[-1]]):
                    continue
                order_ = sorted(batch, key=lambda k: order((places[k],)))
                for k, found in zip(order_, repeated_windows([pieces[k][slice(*batch[k])] for k in order_], length, keep)):
                    if found.any() and (keep == "first" or n[k] == 1):
                        all_ = np.zeros(len(pieces[k]) - length + 1, bool)
                        all_[batch[k][0] : batch[k][0] + len(found)] = found
                        hit.append(k)
                        marks.append(np.packbits(all_).tobytes())
                batch, held = {}, 0
        return group.select(["s1", "s2", "place"]).take(pa.array(hit, pa.int64())).append_column("windows", pa.array(marks, pa.binary()))

    dealt = distinct.withColumn("chunk", F.pmod(F.xxhash64("h"), F.lit(-(-size // chunk) or 1)))
    return dealt.select("chunk", "h", "s1", "s2", "n", "place", "lead", "bytes").groupBy("chunk").applyInArrow(run, schema)


def _counted(parts: DataFrame) -> DataFrame:
    """(s1, s2, n, place, h, lead, bytes): one row for each content, with its number and its first place. Equal segments have equal anchors."""
    return parts.groupBy("s1", "s2").agg(F.sum("times").alias("n"), F.min("place").alias("place"), *[F.any_value(c).alias(c) for c in ("h", "lead", "bytes")])


def _parts(crowded: DataFrame, length: int, width: int) -> DataFrame:
    """(o1, o2, owner, all, s1, s2, place, at, last, times, h, lead and bytes) of the bands of segments; o1, o2, owner and all: the segment's key, place and number of windows."""
    names = ["o1", "o2", "all", "s1", "s2", "first", "sha", "begin", "at", "last", "times", "h", "lead", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (own, h, lead) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bytes", "h", "lead")))):
                for first, last, shared in bands(own, length, width):
                    anchor = xxhash.xxh3_64_digest(shared + h.to_bytes(8, "little", signed=True))
                    rows.append((k, len(own) - length + 1, first, last, own[first : last + length], anchor, lead - first))
            of, every, at, last, own, anchor, lead = zip(*rows) if rows else [()] * 7
            ids, of = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, own)), "<i8").reshape(-1, 2), pa.array(of, pa.int32())
            taken = {c: batch.column(c).take(of) for c in ("s1", "s2", "first", "sha", "begin", "n")}
            columns = [taken["s1"], taken["s2"], pa.array(every, pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), taken["first"], taken["sha"], taken["begin"]]
            columns += [pa.array(at, pa.int32()), pa.array(last, pa.int32()), taken["n"], pa.array(np.frombuffer(b"".join(anchor), "<i8")), pa.array(lead, pa.int32()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    read = crowded.select("s1", "s2", "n", "h", "place.first", "place.sha", F.col("place.at").alias("begin"), "lead", "bytes")
    kind = read.schema["first"].dataType.simpleString()
    found = read.mapInArrow(run, f"o1 long, o2 long, all int, s1 long, s2 long, first {kind}, sha binary, begin int, at int, last int, times long, h long, lead int, bytes binary")
    place = lambda at: F.struct("first", "sha", at.alias("at"))
    return found.select("o1", "o2", place(F.col("begin")).alias("owner"), "all", "s1", "s2", place(F.col("begin") + F.col("at")).alias("place"), "at", "last", "times", "h", "lead", "bytes")


def _hit(keep: str) -> Column:
    """Whether what was told of a segment (owner, windows) holds for one at `place`."""
    return F.lit(True) if keep == "none" else (F.col("place") == F.col("owner")) == F.col("windows").isNotNull()


def _gathered(found: DataFrame) -> DataFrame:
    """(s1, s2, place, windows) of segments (o1, o2, owner, all, found): the bits of their bands put together."""
    schema = found.select(F.col("o1").alias("s1"), F.col("o2").alias("s2"), F.col("owner").alias("place"), F.lit(b"").alias("windows")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_marked(own, n)).tobytes() for own, n in zip(batch.column("found").to_pylist(), batch.column("all").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("o1", "o2", "owner")], pa.array(bits, pa.binary())], ["s1", "s2", "place", "windows"])

    return found.mapInArrow(run, schema)


def _marked(found: list[dict] | None, n: int) -> np.ndarray:
    """Which of n windows are named by found: the first and last window of segments, and which of them: bits, or null for all."""
    mark = np.zeros(n, bool)
    for x in found or ():
        size = x["last"] + 1 - x["at"]
        mark[x["at"] : x["last"] + 1] |= True if x["windows"] is None else np.unpackbits(np.frombuffer(x["windows"], np.uint8))[:size].astype(bool)
    return mark


def _told(distinct: DataFrame, length: int, keep: str, crowd: int, chunk: int, scratch: Scratch, widths: tuple[int, ...] = (BAND, 1)) -> DataFrame:
    """(s1, s2, owner, windows) of segments with removed windows: null for all windows of all places but the owner (keep="none": of all places), or bits of the owner's.

    distinct is a written table; widths are those of the bands that segments of crowded anchors are cut into, round after round.
    """
    # what is found in several places goes whole, but for the first of them; what shares windows goes in part
    out = distinct.filter("n > 1").select("s1", "s2", F.col("place").alias("owner"), F.lit(None).cast("binary").alias("windows"))
    if not widths:
        return out
    hot = scratch.written(distinct.groupBy("h").count().filter(F.col("count") >= crowd).select("h"), "crowded")
    split = not hot.isEmpty()
    factors = scratch.written(_factors(distinct.join(hot, "h", "left_anti") if split else distinct, length, keep, chunk), "factors")
    out = out.unionByName(factors.withColumnRenamed("place", "owner"))
    if not split:
        return out
    parts = scratch.written(_parts(distinct.join(hot, "h", "left_semi"), length, widths[0]), "parts", compression="zstd")
    told = _told(scratch.written(_counted(parts), "bands", compression="zstd"), length, keep, crowd, chunk, scratch, widths[1:])
    mine = parts.filter("times = 1") if keep == "none" else parts
    met = mine.select("o1", "o2", F.col("owner").alias("of"), "all", "s1", "s2", "place", "at", "last").join(told, ["s1", "s2"]).filter(_hit(keep))
    found = met.groupBy("o1", "o2").agg(F.any_value("of").alias("owner"), F.any_value("all").alias("all"), F.collect_list(F.struct("at", "last", "windows")).alias("found"))
    return out.unionByName(scratch.written(_gathered(found), "gathered").withColumnRenamed("place", "owner"))


def covered(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that lie in marked windows."""
    at = np.flatnonzero(windows)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + length).tolist()))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(b for b, _ in spans), len(text)]))


def _judged(told: DataFrame, length: int, keep: str) -> DataFrame:
    """(sha, first, later, n_bytes, spans, kept) of texts (sha, n, first, text, found). later: what becomes of copies after the first.

    found has the first and last window of segments with removed windows, and which of them those are: bits, or null for all.
    """
    schema = told.select("sha", "first").withColumns({"later": F.lit(False), "n_bytes": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPAN), "kept": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for k, (text, n, found) in enumerate(zip(texts, batch.column("n").to_pylist(), batch.column("found").to_pylist())):
                if not (n > 1 and keep == "none"):
                    rows.append((k, False, covered(_marked(found, max(0, len(text) - length + 1) if found else 0), length)))
                if n > 1:
                    rows.append((k, keep == "first", [(0, len(text))] if len(text) >= length else []))
            of = pa.array([r[0] for r in rows], pa.int32())
            spans = pa.array([[{"begin": b, "end": e} for b, e in r[2]] for r in rows], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            columns = [batch.column("sha").take(of), batch.column("first").take(of), pa.array([r[1] for r in rows], pa.bool_()), pa.array([len(texts[r[0]]) for r in rows], pa.int64()), spans, pa.array([_cut(texts[r[0]], r[2]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["sha", "first", "later", "n_bytes", "spans", "kept"])

    return told.select("sha", "n", "first", "text", "found").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", derive: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """`row` with all columns of every row, and what derive names, made of n_bytes, spans (begin and end in bytes) and kept (bytes).

    Without derive it is those three. derive is evaluated once for each distinct text, before texts meet their rows.
    """
    if keep not in ("none", "first") or length < 16:
        raise ValueError("keep is none or first, and length is 16 bytes at least")
    spark = docs.sparkSession
    shipped(spark)
    derive = derive or {c: F.col(c) for c in ("n_bytes", "spans", "kept")}
    with Scratch(spark, "repeats") as scratch:
        texts = _texts(docs, key, text, scratch)
        long = texts.filter(F.octet_length("text") >= length)
        found = scratch.written(_anchors(long, length), "anchors")
        often = found.groupBy("h").agg(F.sum("places").alias("places")).filter("places > 1")
        mine = found.select("h", "sha", "at").join(often.select("h"), "h")
        asked = scratch.written(mine.groupBy("sha").agg(F.collect_list(F.struct("h", "at")).alias("list")), "asked")
        theirs = long.join(asked, "sha")
        distinct = scratch.written(_counted(_segments(theirs, length, True)), "segments", compression="zstd")
        told = _told(distinct, length, keep, crowd, chunk, scratch)
        own = _segments(theirs.filter("n = 1") if keep == "none" else theirs, length, False)
        met = own.join(told, ["s1", "s2"]).filter(_hit(keep)).groupBy(F.col("place.sha").alias("sha")).agg(F.collect_list(F.struct("place.at", "last", "windows")).alias("found"))
        judged = _judged(texts.join(met, "sha", "left"), length, keep)
        result = written(judged.select("sha", "first", "later", *[c.alias(f"d_{name}") for name, c in derive.items()]), "repeats")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), _sha(body), F.col(key).alias("own"))
    copy = F.lit(False) if keep == "none" else ~F.col("own").eqNullSafe(F.col("first.id"))
    return rows.join(result, (rows["sha"] == result["sha"]) & (F.col("later") == copy)).select("row", *[F.col(f"d_{name}").alias(name) for name in derive])
