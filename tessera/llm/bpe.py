"""Byte-level BPE by rounds over padded matrices.

A text is split by the pattern; each distinct piece that a worker doesn't know yet is encoded once, together with others of
its length bucket: pieces are the rows of a padded matrix of token ids, beside a matrix of the ranks of neighbouring pairs.
In each round every row merges its leftmost pair of least rank and is compacted by one place; rows without a ranked pair
leave the matrix. Ranks come from an open-addressing hash table of id pairs. Pieces too long for a matrix are merged by a
heap, in the same order (least rank first, leftmost among equals), so that one very long piece costs n log n.

Whole texts are encoded, row by row, without a shuffle; memory is bounded by a batch of rows and a cache of known short pieces.
Nulls: a null text is empty and has no tokens; a null id stays null. Equal rows get equal results. An empty table gives an
empty table. Only the text and the columns asked for are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cluster import shipped

NONE = np.int32(2**31 - 1)
#: The longest piece in bytes that goes into a matrix, the most cells of a matrix, the most pieces that a worker remembers and their length.
LONGEST, CELLS, KNOWN, SHORT = 512, 1 << 20, 600_000, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines `base64 rank`."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Encoder:
    """Encodes and decodes by a rank table. Ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the ranks must hold every single byte")
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._hash_pairs(np.array(pairs, np.int64).reshape(-1, 3))
        self.known: dict[str, bytes] = {}

    def _hash_pairs(self, pairs: np.ndarray) -> None:
        """Open addressing with linear probing; all pairs that don't find their place free try the next one together."""
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2].astype(np.int32)
        slots, self.probes = self._slots(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where there is none (or where an id is negative)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return np.where((left < 0) | (right < 0), NONE, out).reshape(shape)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONGEST:
                out[i] = np.array(self._merge_long(piece), "<u4").tobytes()
            else:
                buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for first in range(0, len(members), step):
                self._merge_bucket(pieces, members[first : first + step], width, out)
        return out

    def _merge_bucket(self, pieces: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
        sizes = np.array([len(pieces[i]) for i in members])
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[flat], np.int32(-1))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        owner = np.array(members)
        while len(owner):
            least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(owner), NONE)
            done = least == NONE
            if done.any():
                lengths = (ids[done] >= 0).sum(axis=1)
                for i, row, n in zip(owner[done].tolist(), ids[done].astype("<u4"), lengths.tolist()):
                    out[i] = row[:n].tobytes()
                ids, ranks, owner, least = ids[~done], ranks[~done], owner[~done], least[~done]
                if not len(owner):
                    break
            at, rows = ranks.argmin(axis=1), np.arange(len(owner))  # argmin: the leftmost
            ids[rows, at] = least  # a token's id is its rank
            stay = np.ones(ids.shape, bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(len(owner), -1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(owner), -1)
            # pair `at` is now (merged, next), pair `at - 1` is (previous, merged)
            right = at < ranks.shape[1]
            ranks[rows[right], at[right]] = self.pair_ranks(ids[rows[right], at[right]], ids[rows[right], at[right] + 1])
            left = at > 0
            ranks[rows[left], at[left] - 1] = self.pair_ranks(ids[rows[left], at[left] - 1], ids[rows[left], at[left]])

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of (rank, place) over a linked list; outdated entries are passed over."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids, now = ids.tolist(), first.tolist() + [int(NONE)]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)
        rank, tokens, end = self.ranks, self.tokens, len(ids)

        def refresh(i: int) -> None:
            r = rank.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < end else None
            now[i] = int(NONE) if r is None else r
            if r is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r or ids[i] < 0:
                continue
            gone = after[i]
            ids[i], ids[gone], now[gone] = r, -1, int(NONE)
            after[i] = after[gone]
            if after[i] < end:
                before[after[i]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return [i for i in ids if i >= 0]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [self.find(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        new = list({p for pieces in split for p in pieces if p not in self.known})
        made = dict(zip(new, self.merge([p.encode("utf-8") for p in new])))
        long = {p: code for p, code in made.items() if len(p) > SHORT}  # seldom met again, and memory must stay bounded
        self.known.update((p, code) for p, code in made.items() if len(p) <= SHORT)
        if not long:
            get = self.known.__getitem__
            return [b"".join(map(get, pieces)) for pieces in split]
        return [b"".join([long[p] if p in long else self.known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file, made once in each worker process."""
    name = hashlib.sha256(data + pattern.encode()).hexdigest()
    return _ENCODERS.get(name) or _ENCODERS.setdefault(name, Encoder(read_ranks(data), pattern))


def _chunks(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in order, in runs of about `most` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_rows(docs: DataFrame, vocabulary: str, pattern: str, carry: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """The carried columns with n_tokens, ids_sha256 and decoded_sha256 (and the ids) of every row.

    vocabulary names a rank file that the driver can read; its bytes (under a megabyte) go to the executors as a broadcast.
    """
    shipped(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    read = docs.select(*carry, F.col(text).alias("_text"))
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})
    schema = read.drop("_text").withColumns({n: F.lit(None).cast(t) for n, t in made.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(data.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            sizes, hashes, decoded, ids = [], [], [], []
            for part in _chunks(texts):
                for code in coder.encode(part):
                    sizes.append(len(code) // 4)
                    hashes.append(hashlib.sha256(code).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(code)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(code, "<i4"))
            out = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *out], [*carry, *made])

    return read.mapInArrow(run, schema)
