"""SimHash near-dedup by anchor-point covering.

A fingerprint has one bit for each bit of a shingle hash, by majority over the text's shingles. Anchors are the words of a
covering code: each block of a fingerprint's bits is covered by a perfect code (binary Golay or Hamming), so that every
fingerprint lies within the code's radius of exactly one code word in each block, its home. If x and y differ in at most t
bits of the blocks, y lies within the radius and its share of t of x's home in every block; so y is sent to all anchors
within covering radius plus threshold in that sense, it meets x where x is at home, and no pair is missed. Rows are dealt by
anchor, and in each anchor those at home there are compared with all that were sent.

STRICT is the contract's rule: two Golay blocks over 46 bits, threshold two (about 61 anchors each), links at two differing
bits or fewer, none missed. SIMILAR finds texts whose sets of word shingles are alike to 0.8 or more, which differ in about
15 % of the bits: 17 tables of a Golay and a Hamming block over a fingerprint of 512 bits, threshold one in each table (about
8 anchors), candidates at 54 differing bits of the first 256 and 100 of all. A pair at similarity 0.8 meets in some table
with a chance of about 0.97 (measured in the tests). A candidate is linked only if the shingles of its two texts are alike to
0.8, so short texts whose fingerprints happen to be near stay apart, and texts without words are linked only with each other.

Candidates are verified in two passes: first the stars of each chunk of comparisons, then all pairs whose nodes are not
connected by then. So every candidate pair is verified or connected already, and a large group of near copies doesn't give
all of its pairs. Whatever has a candidate is in some star, so only ends of stars take part in the second pass; they bring
all lanes along, and each pair leaves the first anchor where it meets and no other. Either pass deals TABLES tables at a time,
so the disk holds the anchors of those and not of all tables; which pairs are found doesn't depend on that.

Equal fingerprints are one node from the start, so a group of copies of any size is one row. Within a chunk of comparisons
linked nodes are joined into stars, so a group of near copies gives as many edges as it has members, not pairs. Anchors that
are home to more than CELL nodes are split into a grid of cells (a share of those at home by a share of those sent), so no
task holds an unbounded anchor and no pair is lost.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null id is never the smallest of a component
(a component of null ids alone has a null id). Repeated rows come back as often as they went in, except from `one_of_each`,
which keeps one. An empty table gives an empty table; clashing names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tessera.cluster import shipped
from tessera.llm.common import Scratch, unpack, written
from tessera.llm.graph import components

SEED, CELL, PAIRS = 42, 16384, 1 << 20
#: Tables whose rows are dealt at once; the shuffles of those before are gone by then.
TABLES = 5
#: Characters and shingles that a task which verifies pairs may remember.
SETS = 8 << 20
#: Odd numbers that turn one shingle hash into further ones (the golden ratio's fraction and its multiples).
STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Code:
    """A perfect binary cyclic code: generator polynomial, length and covering radius (fixed values of coding theory)."""

    generator: int
    length: int
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        """Remainders modulo the generator polynomial."""
        out = words.copy()
        for bit in range(self.length - 1, self.checks - 1, -1):
            out ^= np.where(out >> bit & 1, self.generator << (bit - self.checks), 0)
        return out


GOLAY, HAMMING = Code(0b110001110101, 23, 3), Code(0b1011, 7, 1)


@dataclass(frozen=True)
class Layout:
    """How fingerprints are covered: blocks in each table, the number of tables, and what makes a link."""

    shingle: int
    lanes: int
    codes: tuple[Code, ...]
    tables: int
    threshold: int
    compared: int  # lanes
    limit: int  # differing bits in those
    near: int = 0  # differing bits in all lanes, tested before texts are moved
    alike: float = 0.0  # Jaccard similarity of the shingles that a link needs besides


STRICT = Layout(shingle=3, lanes=1, codes=(GOLAY, GOLAY), tables=1, threshold=2, compared=1, limit=2)
SIMILAR = Layout(shingle=5, lanes=8, codes=(GOLAY, HAMMING), tables=17, threshold=1, compared=4, limit=54, near=100, alike=0.8)


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> list[int]:
    """The majority fingerprint of a text as signed 64-bit numbers."""
    return _majority(shingles(text, shingle), lanes)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of a text; a shorter text is one shingle, one without words has none."""
    terms = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(terms) <= shingle:
        hashes = [digest(join(terms), SEED)] if terms else []
    else:
        hashes = [digest(join(t), SEED) for t in zip(*[terms[i:] for i in range(shingle)])]
    return np.array(hashes, dtype=np.uint64)


def _majority(own: np.ndarray, lanes: int) -> list[int]:
    if not len(own):
        return [0] * lanes
    totals = np.zeros(64 * lanes, np.int64)
    for first in range(0, len(own), 255 * 16):
        part = _lanes(own[first : first + 255 * 16], lanes).view(np.uint8)
        bits = np.unpackbits(part.reshape(len(part), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # 255 ones at most fit a byte
            totals += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * totals > len(own), bitorder="little").view("<i8").tolist()


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The hash itself and further ones made of it, as rows of little-endian numbers."""
    out = np.empty((len(hashes), lanes), "<u8")
    out[:, 0] = hashes
    for k in range(1, lanes):
        x = hashes + np.uint64(k * STEP % (1 << 64))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ x >> np.uint64(31)
    return out


def with_fingerprints(docs: DataFrame, carry: list[str], layout: Layout, text: str = "text") -> DataFrame:
    """The carried columns and `fps` (array of longs) of every row of docs."""
    shipped(docs.sparkSession)
    read = docs.select(*carry, F.col(text).alias("_text"))
    schema = read.drop("_text").withColumn("fps", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), layout.shingle, layout.lanes) for t in batch.column("_text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], fps], [*carry, "fps"])

    return read.mapInArrow(run, schema)


_PATTERNS: dict[tuple[Code, int], list] = {}


def _patterns(code: Code, threshold: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By excess over the radius: error patterns sorted by syndrome, where each syndrome begins, and how many it has."""
    if (code, threshold) not in _PATTERNS:
        every = np.arange(1 << code.length, dtype=np.int64)
        weight = np.bitwise_count(every)
        out = []
        for excess in range(threshold + 1):
            own = every[weight <= code.radius] if excess == 0 else every[weight == code.radius + excess]
            syndrome = code.syndromes(own)
            count = np.bincount(syndrome, minlength=1 << code.checks)
            out.append((own[np.argsort(syndrome, kind="stable")], np.cumsum(count) - count, count))
        _PATTERNS[code, threshold] = out
    return _PATTERNS[code, threshold]


def _bits(fps: np.ndarray, offset: int, length: int) -> np.ndarray:
    """Bits offset to offset + length of fingerprints (rows of uint64)."""
    lane, shift = divmod(offset, 64)
    out = fps[:, lane] >> np.uint64(shift)
    if shift + length > 64:
        out |= fps[:, lane + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << length) - 1)).astype(np.int64)


def anchors(fps: np.ndarray, layout: Layout, table: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the row's home) for every anchor of a table that each fingerprint is sent to."""
    first, second = layout.codes
    offset = table * (first.length + second.length)
    words = [_bits(fps, offset, first.length), _bits(fps, offset + first.length, second.length)]
    syndromes = [c.syndromes(w) for c, w in zip(layout.codes, words)]
    rows, ids, homes = [], [], []
    for e0 in range(layout.threshold + 1):
        for e1 in range(layout.threshold + 1 - e0):
            (p0, at0, n0), (p1, at1, n1) = _patterns(first, layout.threshold)[e0], _patterns(second, layout.threshold)[e1]
            a, b = n0[syndromes[0]], n1[syndromes[1]]
            total = a * b
            row = np.repeat(np.arange(len(fps)), total)
            inner, wide = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total), b[row]
            c0 = words[0][row] ^ p0[at0[syndromes[0][row]] + inner // wide]
            c1 = words[1][row] ^ p1[at1[syndromes[1][row]] + inner % wide]
            # the upper bits of a code word, as many as it has of its own, determine it
            ids.append(c0 >> first.checks | c1 >> second.checks << (first.length - first.checks))
            rows.append(row)
            homes.append(np.full(len(row), e0 + e1 == 0))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(homes)


def _sent(nodes: DataFrame, layout: Layout, carry: tuple[str, ...] = (), tables: range | None = None) -> DataFrame:
    """(anchor, home, f0 and the other compared lanes) and carried longs for every anchor of the tables (none named: all) that a node (column fps) is sent to; anchors of different tables differ."""
    span, names = sum(c.length - c.checks for c in layout.codes), [f"f{k}" for k in range(layout.compared)]
    tables = range(layout.tables) if tables is None else tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.array(batch.column("fps").to_pylist(), dtype=np.int64).reshape(-1, layout.lanes).view(np.uint64)
            carried = [batch.column(c).to_numpy(zero_copy_only=False) for c in carry]
            for first in range(0, len(every), 2000):
                part = every[first : first + 2000]
                signed = part.view(np.int64)
                for table in tables:
                    row, anchor, home = anchors(part, layout, table)
                    columns = [anchor | table << span, home, *[signed[row, k] for k in range(layout.compared)], *[c[first + row] for c in carried]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "home", *names, *carry])

    return nodes.select("fps", *carry).mapInArrow(run, ", ".join(["anchor long, home boolean", *[f"{c} long" for c in (*names, *carry)]]))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the pairs (a, b) to the least node that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _compared(rows: list[np.ndarray], layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of near rows among whole runs of rows (anchor and cell, home, lanes, ...), compared in chunks of bounded size."""
    anchor, home, *lanes = rows[: 2 + layout.compared]
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(begin, len(anchor)))
    run = np.repeat(np.arange(len(begin)), size)
    at_home = np.flatnonzero(home & (size[run] > 1))
    total = size[run[at_home]]
    ends = np.cumsum(total)
    first = 0
    while first < len(at_home):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        own, n = at_home[first:last], total[first:last]
        x = np.repeat(own, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + begin[run[x]]
        far = sum(np.bitwise_count(f[x] ^ f[y]).astype(np.int64) for f in lanes)
        near = far <= layout.limit
        yield x[near], y[near]
        first = last


def _met(sent: DataFrame, layout: Layout, cell: int, key: str, pairs) -> DataFrame:
    """Edges (a, b) that `pairs` makes of the near rows (columns, x, y) of every anchor; key is a long that tells nodes apart."""
    columns = sent.columns
    others = [c for c in columns if c not in ("anchor", "home")]
    sent = sent.withColumn("cell", F.lit(0))
    rows = sent.groupBy("anchor").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("guests"))
    # a grid of homes by guests: each cell holds `cell` of either kind, so its comparisons are bounded as well
    sides = rows.select("anchor", F.ceil(F.greatest(F.col("homes"), F.lit(1)) / cell).cast("int").alias("rows"), F.ceil(F.col("guests") / cell).cast("int").alias("columns")).filter("columns > 1")
    crowded = written(sides, "simhash-crowded")
    if not crowded.isEmpty():
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64(key), F.col(n))
        wide = sent.drop("cell").join(crowded, "anchor")
        home = wide.filter("home").withColumn("k", every("columns")).select(*columns, (mine("rows") * F.col("columns") + F.col("k")).cast("int").alias("cell"))
        guest = wide.withColumn("home", F.lit(False)).withColumn("k", every("rows")).select(*columns, (F.col("k") * F.col("columns") + mine("columns")).cast("int").alias("cell"))
        sent = sent.join(crowded, "anchor", "left_anti").unionByName(home).unionByName(guest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []  # batches of rows whose last run may go on
        for batch in _with_end(batches):
            if batch is not None:
                own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "home", *others)}
                waiting.append([own["anchor"] << 24 | own["cell"], own["home"], *[own[c].view(np.uint64) if c[0] == "f" else own[c] for c in others]])
                last = waiting[-1][0]
                if sum(len(w[0]) for w in waiting) < 200_000 or not len(last) or last[0] == last[-1] == waiting[0][0][-1]:
                    continue
            elif not waiting:
                return
            rest = [np.concatenate(p) for p in zip(*waiting)]
            if batch is None:
                whole, waiting = rest, []
            else:
                changes = np.flatnonzero(rest[0][1:] != rest[0][:-1])
                cut = int(changes[-1]) + 1 if len(changes) else 0
                whole, waiting = [p[:cut] for p in rest], [[p[cut:] for p in rest]]
            for x, y in _compared(whole, layout):
                a, b = pairs(whole, x, y)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return sent.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, layout: Layout, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between first lanes that connect all near nodes (column fps, one row for each first lane)."""
    shipped(nodes.sparkSession)

    def pairs(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = rows[2][x], rows[2][y]
        return _stars(a[a != b], b[a != b])

    return _met(_sent(nodes, layout), layout, cell, "f0", pairs)


def _first_meetings(lanes: list[np.ndarray], node: np.ndarray, table: np.ndarray, x: np.ndarray, y: np.ndarray, layout: Layout) -> np.ndarray:
    """Which of the meetings of y at the home of x are the first of their pair: by table, then at the home of the lesser node.

    Needs all lanes that the tables are cut from. Every place that a pair meets at follows from its two fingerprints, so all
    meetings but one are left out where they happen, and no pair is."""
    ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    fps = np.stack([f[ends] for f in lanes], axis=1)
    first = np.ones(len(x), bool)
    for t in range(layout.tables):
        offset, excess = t * sum(c.length for c in layout.codes), [np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)]
        for code in layout.codes:
            word = _bits(fps, offset, code.length)
            pattern, begins, _ = _patterns(code, layout.threshold)[0]
            home = word ^ pattern[begins[code.syndromes(word)]]
            for k, (own, other) in enumerate(((i, j), (j, i))):
                excess[k] += np.maximum(np.bitwise_count(home[own] ^ word[other]).astype(np.int64) - code.radius, 0)
            offset += code.length
        here, there = (e <= layout.threshold for e in excess)
        first &= ~((table[x] > t) & (here | there)) & ~((table[x] == t) & (node[x] > node[y]) & there)
    return first


def candidates(nodes: DataFrame, layout: Layout, stars: bool, cell: int = CELL, tables: range | None = None) -> DataFrame:
    """Distinct pairs (a, b) of near nodes (node, root, fps) of different roots that meet in the tables (none named: all), or a star for those of each chunk that hang together.

    Pairs are near in all lanes, and each leaves the first anchor that it meets at and no other; stars go by the compared lanes."""
    if not stars:
        layout = replace(layout, compared=layout.lanes, limit=layout.near)
    span = sum(c.length - c.checks for c in layout.codes)

    def pairs(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, root = rows[2 + layout.compared :]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        if stars:
            return _stars(node[x], node[y])
        first = _first_meetings(rows[2 : 2 + layout.compared], node, rows[0] >> (24 + span), x, y, layout)
        a, b = node[x[first]], node[y[first]]
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    return _met(_sent(nodes, layout, ("node", "root"), tables), layout, cell, "node", pairs).distinct()


def verified(pairs: DataFrame, texts: DataFrame, layout: Layout) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are alike enough in their sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # of texts that come again and again in a group
        room = SETS

        def sets(text: str) -> np.ndarray:
            nonlocal room
            if (own := known.get(text)) is None:
                own = np.unique(shingles(text, layout.shingle))
                if (room := room - len(text) - len(own)) < 0:
                    known.clear()
                    room = SETS - len(text) - len(own)
                known[text] = own
            return own

        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = []
            for s, t in zip(x, y):
                own, other = sets(t), sets(s)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both >= layout.alike * (len(own) + len(other) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    first, second = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def grouped(rows: DataFrame, layout: Layout) -> DataFrame:
    """(fp, root, component_id) of every distinct first lane of rows (doc_id, fps); rows should be a written table."""
    nodes = written(rows.groupBy(F.col("fps")[0].alias("fp")).agg(F.min("doc_id").alias("least"), F.min("fps").alias("fps")), "simhash-nodes")
    roots = written(components(links(nodes, layout), "simhash-edges").select(F.col("node").alias("fp"), "root"), "simhash-roots")
    named = nodes.select("fp", "least").join(roots, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "root").select("fp", "root", "component_id")
    out = nodes.select("fp", "least").join(linked, "fp", "left")
    named_all = out.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return written(named_all, "simhash-groups")  # written, so that a join with many copies of one fingerprint can be split


def near_duplicates(docs: DataFrame, layout: Layout = STRICT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = written(with_fingerprints(docs, ["doc_id"], layout), "simhash-rows")
    out = rows.withColumn("fp", F.col("fps")[0]).join(grouped(rows, layout), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(rows: DataFrame, keyed: DataFrame, layout: Layout, scratch: Scratch) -> DataFrame:
    """(node, root) of every distinct set of shingles among rows (k1, k2, node, fps); keyed has the texts."""
    write = scratch.written
    nodes = write(rows.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("at"), F.min("fps").alias("fps")), "nodes")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        first, second = (nodes.select(F.col("node").alias(n), F.col("fps").alias(f"{n}_fps")) for n in ("a", "b"))
        far = sum((F.bit_count(F.col("a_fps")[k].bitwiseXOR(F.col("b_fps")[k])) for k in range(1, layout.lanes)), F.bit_count(F.col("a_fps")[0].bitwiseXOR(F.col("b_fps")[0])))
        return write(pairs.join(first, "a").join(second, "b").filter(far <= layout.near).select("a", "b"), "near")

    def alike(pairs: DataFrame) -> DataFrame:
        places = write(nodes.join(ends(pairs), "node").select("node", "at.k1", "at.k2"), "places")
        texts = write(keyed.join(places, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "texts")
        out = write(verified(pairs, texts, layout), "alike")
        scratch.drop(texts)
        scratch.tidy()
        return out

    def roots(edges: DataFrame) -> DataFrame:
        found = write(components(edges, "edges", write), "roots")
        return write(nodes.select("node", "fps").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")

    def meetings(nodes: DataFrame, stars: bool, name: str) -> DataFrame:
        parts = []
        for first in range(0, layout.tables, TABLES):
            parts.append(write(candidates(nodes, layout, stars, tables=range(first, min(first + TABLES, layout.tables))), name))
            scratch.tidy()
        return write(reduce(DataFrame.unionByName, parts).distinct(), name)

    met = meetings(nodes.withColumn("root", F.col("node")), True, "stars")
    stars = alike(near(met))
    open_ends = write(roots(stars).join(ends(met), "node", "left_semi"), "open")
    pairs = alike(meetings(open_ends, False, "pairs"))
    return roots(stars.unionByName(pairs)).select("node", "root")


def one_of_each(docs: DataFrame, layout: Layout = SIMILAR) -> DataFrame:
    """The rows of docs that are the first of their group (by id, then by content), with all their columns; equal rows count as one."""
    shipped(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"))
    atoms = [F.col("row")[f.name] for f in docs.schema if isinstance(f.dataType, AtomicType)]
    keyed = packed.withColumns({"k1": F.xxhash64(F.lit(1), *atoms), "k2": F.xxhash64(F.lit(2), *atoms)})
    inner = keyed.select("k1", "k2", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), layout.shingle) for t in batch.column("text")]
            node = pa.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in own], pa.uint64()).view(pa.int64())
            fps = pa.array([_majority(h, layout.lanes) for h in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k1", "k2", "doc_id")], node, fps], ["k1", "k2", "doc_id", "node", "fps"])

    schema = inner.drop("text").withColumns({"node": F.lit(0).cast("long"), "fps": F.array(F.lit(0).cast("long"))}).schema
    with Scratch(docs.sparkSession, "simhash") as scratch:
        rows = scratch.written(inner.mapInArrow(run, schema), "rows")
        placed = rows.join(_placed(rows, inner, layout, scratch), "node")
        first = written(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("x")).select("x.k1", "x.k2"), "simhash-first")
    kept = keyed.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*unpack(kept))
