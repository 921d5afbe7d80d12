"""Katz backoff language model: training, partitioned n-gram tables and scoring.

P(w | h) is d(c) c(h, w) / c(h) for n-grams seen in training, with Good-Turing discounts d for counts up to CUTOFF, and
alpha(h) P(w | h') for the others, where h' is h without its first word. alpha(h) is what the discounts of h leave, divided
by one minus the lower-order probabilities of all words seen after h, so that every distribution sums to one exactly. At the
bottom stand discounted unigrams; what they leave is the probability of the one unknown word. Discounts that the counts of
counts don't support (outside zero to one) are replaced by an absolute discount for that order; a history without any
discounted count keeps 1 / (c(h) + 1) back. Orders are one to three.

How it runs. Texts are read into blocks of bounded size, whole documents each, which are written. Blocks and buckets then
exchange packed messages, in up to three rounds. In the first a block sends its distinct words and the words' buckets answer
with counts and a number for each word (its place by frequency there, and the bucket); with these the block is written again,
dealt by block, so that it never moves afterwards. In the last round it sends its
distinct trigrams (v before w, u before v) to the bucket of v, which so holds all that is needed of both upper orders: it
adds up c(u v w) and c(v w), stores its part of the model, and answers with the counts and with what alpha(u v) and alpha(v)
are made of. A frequent v would make a bucket large, so bigrams after words with more training tokens than a bucket should
hold have a round of their own, dealt by v and a share of the words after it; trigrams around such a v are then dealt by
(u, v), and those of a pair that is too frequent itself by a share of the words after it too. Statistics of a history that
is dealt over several buckets are asked from all of them and added up. With all answers a block evaluates its tokens,
recursively from the lowest order up. Nothing of the model is broadcast or collected but the counts of counts.

The lower-order mass of a pair's followers depends on discounts that are known only when all buckets are done; it is linear
in them, so buckets send the number of followers by their bigram count instead, which is exact.

The model is a folder of tables partitioned by round and kind: `kind=model` holds words (hash, number, count), n-grams and
the statistics of histories by order and bucket; `ngrams` and `backoffs` read them as rows. Words are told apart by 64-bit
hashes. Messages number blocks times buckets, so on corpora beyond some terabytes both sizes should be raised.

Nulls: a null text is empty and consists of its end alone; the text of a null id is empty too, for the split. Repeated rows
count as often as they stand there. With no training rows every token is the unknown word, with probability one. An empty
table gives an empty table. Very long texts make a block of their own. Ties can't arise: equal texts have equal scores. Only
id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import shipped
from tessera.llm.common import Scratch, fresh, removed, written
from tessera.llm.packed import pack, steps, unpack, unsteps

CUTOFF, BLOCK_TOKENS, BUCKET_TOKENS = 5, 1_000_000, 600_000
MODULUS, HELD = 5, 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: The hash of a text's end. A text's begin is the word number 0, others are numbered from 1.
END = np.uint64(0x27D4EB2F165667C5)
BLOCK = "block long, ids array<long>, data binary"
SENT = "bucket long, block long, data binary"
MADE = "kind string, n int, bucket long, block long, stats array<long>, data binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NGRAM = "n int, history array<long>, word long, count long"
WEIGHT = "n int, history array<long>, count long, kept double, mass double"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of numbers."""
    x = (a.astype(np.uint64) ^ (b.astype(np.uint64) * _A + _C)) * _B
    x ^= x >> np.uint64(29)
    x *= _A
    return x ^ (x >> np.uint64(32))


def held_out(key: int | None) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % MODULUS == HELD


# ---- discounts


@dataclass
class Level:
    """What is known of an order: tokens, types, and discounts by count from 1 to CUTOFF."""

    total: int
    types: int
    discounts: list[float]
    kept: float = 0.0  # the mass that seen types keep

    @staticmethod
    def of(stats: list[int]) -> Level:
        """From total, types and the counts of counts from 1 to CUTOFF + 1."""
        total, types, *n = stats
        d = discounts(n)
        return Level(total, types, d, total - sum(n[r] * (r + 1) * (1 - x) for r, x in enumerate(d)))


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts after Katz from counts of counts, or absolute ones where those are no fractions."""
    k = len(n) - 1
    if all(n):
        common = (k + 1) * n[k] / n[0]
        if common < 1:
            d = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d
    lost = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return [(r - lost) / r for r in range(1, k + 1)]


def discounted(c: np.ndarray, level: Level) -> np.ndarray:
    """d(c) c for an array of counts."""
    return np.array([1.0, *level.discounts, 1.0])[np.minimum(c, len(level.discounts) + 1)] * c


def left_over(by_count: np.ndarray, level: Level) -> np.ndarray:
    """What the discounts leave, from the numbers of types by count (columns 1 to CUTOFF)."""
    r = np.arange(1, len(level.discounts) + 1)
    return (by_count * r * (1 - np.array(level.discounts))).sum(axis=-1)


def unigrams(count: np.ndarray, level: Level) -> np.ndarray:
    """Probabilities of words by their count; zero counts stand for the unknown word."""
    if not level.total:
        return np.ones(len(count))
    left = level.total - level.kept
    if left <= 0:
        return np.where(count > 0, count, 1) / (level.total + 1)
    return np.where(count > 0, discounted(count, level), left) / level.total


def _seen(count: np.ndarray, history: np.ndarray, plain: np.ndarray, level: Level) -> np.ndarray:
    """Probabilities of seen n-grams from their counts and their histories'."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(plain, count / (history + 1), discounted(count, level) / history)


def _alpha(history: np.ndarray, by_count: np.ndarray, mass: np.ndarray, level: Level) -> np.ndarray:
    """The backoff weight of histories; one for those that training hasn't seen."""
    left = left_over(by_count, level)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = np.where(left > 0, left / history, 1 / (history + 1))
    return np.where(history > 0, kept / np.maximum(1 - mass, 1e-300), 1.0)


def _pair_mass(history: np.ndarray, plain: np.ndarray, by_lower: np.ndarray, large: np.ndarray, lower: Level) -> np.ndarray:
    """The lower-order probability of all followers of pairs (u, v): from c(v), and c(v w) of the followers by count."""
    r = np.arange(1, len(lower.discounts) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(plain, ((by_lower * r).sum(axis=1) + large) / (history + 1), ((by_lower * r * np.array(lower.discounts)).sum(axis=1) + large) / history)


# ---- sorting


def _order(key: np.ndarray) -> np.ndarray:
    """Places of numbers from 0 up in ascending order, equal ones as they stand (sorted together with their places where both fit)."""
    bits = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()) >> (63 - bits) == 0:
        return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each number among them."""
    order = _order(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places in order) for each distinct value."""
    order = _order(values)
    cut = np.flatnonzero(np.diff(values[order])) + 1
    for mine in np.split(order, cut) if len(values) else ():
        yield int(values[mine[0]]), mine


def _sums(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=n).astype(np.int64)


def _by_count(group: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """How many members of each group have each count from 1 to CUTOFF."""
    small = (count > 0) & (count <= CUTOFF)
    return np.bincount(group[small] * CUTOFF + count[small] - 1, minlength=n * CUTOFF).reshape(n, CUTOFF)


# ---- blocks


def _hashes(values: pa.BinaryArray) -> list[int]:
    """The hash of each value, read from the array's own buffers."""
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    data, digest = values.buffers()[2].to_pybytes(), xxhash.xxh64_intdigest
    return [digest(data[a:b]) for a, b in zip(ends, ends[1:])]


def _blocks(docs: DataFrame, key: str, text: str, block_tokens: int) -> DataFrame:
    """Runs of whole documents: their ids, token counts, vocabulary (hashes by frequency) and tokens (places in the vocabulary)."""
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[int] = []
        words: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal ids, counts, words, made
            coded = pa.array(words, pa.binary()).dictionary_encode()
            vocabulary = np.array(_hashes(coded.dictionary) + [int(END)], np.uint64)
            lengths = np.array(counts, np.int64)
            tokens = np.full(int(lengths.sum()), len(vocabulary) - 1)  # ends, until words are put between them
            tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), lengths - 1)] = coded.indices.to_numpy(zero_copy_only=False) if words else 0
            often = np.bincount(tokens, minlength=len(vocabulary))
            order = _order(often.max() - often)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            data = pack(lengths, vocabulary[order], rank[tokens])
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "ids", "data"])
            ids, counts, words, made = [], [], [], made + 1
            return out

        for batch in batches:
            for key_, body in zip(batch.column("id").to_pylist(), batch.column("body")):
                own = (body.as_py() or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
                ids.append(key_)
                counts.append(len(own) + 1)
                words += own
                if len(words) >= block_tokens:
                    yield block()
        if ids:
            yield block()

    return read.mapInArrow(run, BLOCK)


@dataclass
class Setting:
    """What holds for a whole run."""

    order: int
    buckets: int
    capacity: int  # training tokens that a bucket should hold
    trained: int = 0  # training texts


class Raw:
    """A block as it was read: it asks what its words are."""

    def __init__(self, row: dict, setting: Setting) -> None:
        self.id, self.setting = row["block"], setting
        self.lengths, self.vocabulary, self.tokens = unpack(row["data"])
        self.train = np.repeat([not held_out(i) for i in row["ids"]], self.lengths)

    def _runs(self) -> Iterator[tuple[int, np.ndarray]]:
        by_hash = np.argsort(self.vocabulary)
        where = (self.vocabulary % np.uint64(self.setting.buckets)).astype(np.int64)
        for bucket, mine in _runs(where[by_hash]):
            yield bucket, by_hash[mine]

    def ask(self) -> Iterator[tuple[int, bytes]]:
        own = np.bincount(self.tokens[self.train], minlength=len(self.vocabulary))
        for bucket, mine in self._runs():
            yield bucket, pack(self.vocabulary[mine], own[mine])

    def settled(self, answers: dict[int, bytes]) -> bytes:
        """The block with the numbers and counts of its words, in the order of the numbers; a text's begin is the first."""
        size = len(self.vocabulary) + 1
        count, number = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for bucket, mine in self._runs():
            count[mine], place = unpack(answers[bucket])
            number[mine] = place * self.setting.buckets + bucket + 1
        count[-1] = self.setting.trained  # a text's begin, as often as there are training texts
        order = _order(number)
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        return pack(self.lengths, place[self.tokens], number[order], count[order])


class Block:
    """A settled block, what it asks the buckets and what it has heard. Words are places by number, 0 is a text's begin."""

    def __init__(self, row: dict, setting: Setting) -> None:
        self.id, self.ids, self.setting = row["block"], row["ids"], setting
        self.lengths, self.tokens, self.number, self.count = unpack(row["data"])
        self.size, self.starts = len(self.number), np.cumsum(self.lengths) - self.lengths
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.v, self.u = np.zeros_like(self.tokens), np.zeros_like(self.tokens)
        for before, of in ((self.v, self.tokens), (self.u, self.v)):
            before[1:] = of[:-1]
            before[self.starts] = 0
        self.hot = self.count > setting.capacity
        self.by, self.mass = np.zeros((self.size, CUTOFF), np.int64), np.zeros(self.size)
        self.plain = np.zeros(self.size, bool)

    # -- messages

    def _messages(self, where: np.ndarray, columns: list[np.ndarray], own: np.ndarray, known: np.ndarray, asked_at: np.ndarray, asked: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(bucket, message): the words that it uses with their counts, n-grams as places among those, and histories whose statistics are asked for."""
        mark, place = np.zeros(self.size, bool), np.empty(self.size, np.int64)
        wide, nothing = dict(_runs(asked_at)), np.empty(0, np.int64)

        def message(mine: np.ndarray, more: np.ndarray) -> bytes:
            grams, histories = [c[mine] for c in columns], [c[more] for c in asked]
            for p in grams + histories:
                mark[p] = True
            words = np.flatnonzero(mark)
            mark[words] = False
            place[words] = np.arange(len(words))
            return pack(self.number[words], self.count[words], own[mine], known[mine], *steps([place[p] for p in grams]), *[place[p] for p in histories])

        for bucket, mine in _runs(where):
            yield bucket, message(mine, wide.pop(bucket, nothing))
        for bucket, more in wide.items():
            yield bucket, message(nothing, more)

    def _spread(self, base: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(history, bucket) for every share of the histories with several; base is a hash of each history."""
        many = np.flatnonzero(shares > 1)
        row = np.repeat(many, shares[many])
        share = np.arange(len(row)) - np.repeat(np.cumsum(shares[many]) - shares[many], shares[many])
        return row, (mixed(base[row], share) % np.uint64(self.setting.buckets)).astype(np.int64)

    # -- bigrams: all of them for a model of order 2, those after frequent words for order 3

    def _bigrams(self) -> None:
        at = np.flatnonzero((self.hot if self.setting.order > 2 else self.count > 0)[self.v])
        self.bigram, place = _distinct(self.v[at] * self.size + self.tokens[at])
        self.bigram_own = np.bincount(place[self.train[at]], minlength=len(self.bigram))
        self.bigram_v, self.bigram_w = np.divmod(self.bigram, self.size)
        self.shares = np.where(self.hot, 1 + self.count // self.setting.capacity, 1)
        share = self.number[self.bigram_w] % self.shares[self.bigram_v]
        self.bigram_at = (mixed(self.number[self.bigram_v], share) % np.uint64(self.setting.buckets)).astype(np.int64)

    def ask_bigrams(self) -> Iterator[tuple[int, bytes]]:
        self._bigrams()
        used = np.zeros(self.size, bool)
        used[self.bigram_v] = True
        asked, asked_at = self._spread(self.number, np.where(used, self.shares, 1))
        yield from self._messages(self.bigram_at, [self.bigram_v, self.bigram_w], self.bigram_own, np.zeros(len(self.bigram), np.int64), asked_at, [asked])

    def hear_bigrams(self, answers: dict[int, bytes]) -> None:
        self._bigrams()
        self.bigram_count = np.zeros(len(self.bigram), np.int64)
        for bucket, mine in _runs(self.bigram_at):
            code = unpack(answers[bucket])[0]
            self.bigram_count[mine], self.plain[self.bigram_v[mine]] = code >> 1, code & 1
        self._add_words(data for data in answers.values())
        many = self.shares > 1
        self.plain[many] = self.by[many].sum(axis=1) == 0

    def _add_words(self, answers: Iterable[bytes], first: int = 1) -> None:
        for data in answers:
            numbers, by, mass = unpack(data)[first : first + 3]
            at = np.searchsorted(self.number, numbers)
            self.by[at] += by.reshape(-1, CUTOFF)
            self.mass[at] += mass

    # -- trigrams

    def _trigrams(self) -> None:
        """The distinct trigrams, by v, u and w, and where each is dealt to."""
        n, buckets = self.size, np.uint64(self.setting.buckets)
        self.pair, pair_of = _distinct(self.v * n + self.u)
        gram, self.gram_of = _distinct(pair_of * n + self.tokens)
        self.gram_pair, self.gram_w = np.divmod(gram, n)
        self.pair_of, (self.pair_v, self.pair_u) = pair_of, np.divmod(self.pair, n)
        self.gram_v = self.pair_v[self.gram_pair]
        self.own = np.bincount(self.gram_of[self.train], minlength=len(gram))
        hot = self.hot[self.pair_v]
        # how often a pair occurs is known here where both of its words are frequent, and others are no larger than a bucket
        often = np.where(hot & self.hot[self.pair_u], self._bigram_counts(self.pair_u * n + self.pair_v), 0)
        often[(self.pair == 0) & hot] = self.setting.trained  # the begin of a text
        self.pair_shares = 1 + often // self.setting.capacity
        self.pair_base = mixed(self.number[self.pair_v], np.where(hot, self.number[self.pair_u] + 1, 0))
        p, share = self.gram_pair, self.number[self.gram_w] % self.pair_shares[self.gram_pair]
        self.gram_at = (np.where(self.pair_shares[p] > 1, mixed(self.pair_base[p], share), self.pair_base[p]) % buckets).astype(np.int64)
        self.gram_at[self.count[self.gram_v] == 0] = -1  # nothing is known after a word that training hasn't seen

    def _bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of bigrams after frequent words."""
        if not len(self.bigram):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.bigram, keys), len(self.bigram) - 1)
        return np.where(self.bigram[at] == keys, self.bigram_count[at], 0)

    def ask_trigrams(self) -> Iterator[tuple[int, bytes]]:
        self._trigrams()
        known = np.where(self.hot[self.gram_v], self._bigram_counts(self.gram_v * self.size + self.gram_w) << 1 | self.plain[self.gram_v], 0)
        asked, asked_at = self._spread(self.pair_base, self.pair_shares)
        sent = np.flatnonzero(self.gram_at >= 0)
        columns = [c[sent] for c in (self.gram_v, self.pair_u[self.gram_pair], self.gram_w)]
        yield from self._messages(self.gram_at[sent], columns, self.own[sent], known[sent], asked_at, [self.pair_v[asked], self.pair_u[asked]])

    def hear_trigrams(self, answers: dict[int, bytes]) -> None:
        self._trigrams()
        g, p, hot = len(self.gram_w), len(self.pair), self.hot[self.gram_v]
        self.c3, self.c2, self.plain3 = np.zeros(g, np.int64), np.zeros(g, np.int64), np.zeros(p, bool)
        for bucket, mine in _runs(self.gram_at):
            if bucket >= 0:
                three, two = unpack(answers[bucket])[:2]
                self.c3[mine], self.plain3[self.gram_pair[mine]] = three >> 1, three & 1
                self.c2[mine] = two >> 1
                mine, two = mine[~hot[mine]], two[~hot[mine]]
                self.plain[self.gram_v[mine]] = two & 1
        self.c2[hot] = self._bigram_counts(self.gram_v * self.size + self.gram_w)[hot]
        self._add_words(answers.values(), 2)
        self.by3, self.by2, self.large = np.zeros((p, CUTOFF), np.int64), np.zeros((p, CUTOFF), np.int64), np.zeros(p, np.int64)
        for data in answers.values():
            v, u, three, two, large = unpack(data)[5:]
            at = np.searchsorted(self.pair, np.searchsorted(self.number, v) * self.size + np.searchsorted(self.number, u))
            self.by3[at] += three.reshape(-1, CUTOFF)
            self.by2[at] += two.reshape(-1, CUTOFF)
            self.large[at] += large
        many = self.pair_shares > 1
        self.plain3[many] = self.by3[many].sum(axis=1) == 0

    # -- evaluation

    def probabilities(self, levels: list[Level]) -> np.ndarray:
        """The probability of every token, order by order from the lowest."""
        one = unigrams(self.count, levels[0])
        if self.setting.order == 1:
            return one[self.tokens]
        if self.setting.order == 2:
            v, w, c2 = self.v, self.tokens, self._bigram_counts(self.v * self.size + self.tokens)
        else:
            v, w, c2 = self.gram_v, self.gram_w, self.c2
        two = np.where(c2 > 0, _seen(c2, self.count[v], self.plain[v], levels[1]), _alpha(self.count, self.by, self.mass, levels[1])[v] * one[w])
        if self.setting.order == 2:
            return two
        often = np.empty(len(self.pair), np.int64)  # a pair's count is that of the bigram one place before
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = c2[self.gram_of[:-1]]
        before[self.starts] = self.setting.trained
        often[self.pair_of] = before
        mass = _pair_mass(self.count[self.pair_v], self.plain[self.pair_v], self.by2, self.large, levels[1])
        alpha, own = _alpha(often, self.by3, mass, levels[2]), self.gram_pair
        return np.where(self.c3 > 0, _seen(self.c3, often[own], self.plain3[own], levels[2]), alpha[own] * two)[self.gram_of]

    def scores(self, levels: list[Level]) -> pa.Table:
        known, first = self.count[self.tokens], levels[0]
        base = np.log10((known + 0.5) / (first.total + 0.5 * (first.types + 1)))
        add = lambda x: np.add.reduceat(x, self.starts) if len(self.starts) else np.empty(0)
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.held), pa.array(self.lengths, pa.int64()), pa.array(add((known > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(self.ids), first.total), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(np.log10(self.probabilities(levels))), pa.float64())]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


# ---- buckets


class Bucket:
    """The messages that met in a bucket, with the words of all of them in one order."""

    def __init__(self, rows: list[dict], width: int) -> None:
        parts = [unpack(r.pop("data")) for r in rows]
        for p in parts:
            p[4 : 4 + width] = unsteps(p[4 : 4 + width])
        self.rows, offset = rows, np.cumsum([0] + [len(p[0]) for p in parts])
        self.words, at = _distinct(np.concatenate([p[0] for p in parts]))
        self.count = np.empty(len(self.words), np.int64)
        self.count[at] = np.concatenate([p[1] for p in parts])
        self.own, self.known = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        column = lambda i: at[np.concatenate([p[i] + o for p, o in zip(parts, offset)])]
        self.columns = [column(4 + i) for i in range(width)]
        self.asked = [column(4 + width + i) for i in range(width - 1)]
        self.ends = np.cumsum([len(p[2]) for p in parts])
        self.asked_ends = np.cumsum([len(p[4 + width]) for p in parts])

    def each(self, *arrays: np.ndarray) -> Iterator[tuple[dict, list[np.ndarray], list[np.ndarray]]]:
        """(row, its part of the arrays, the histories that it asks for)."""
        start = asked_start = 0
        for r, end, asked_end in zip(self.rows, self.ends, self.asked_ends):
            yield r, [a[start:end] for a in arrays], [a[asked_start:asked_end] for a in self.asked]
            start, asked_start = end, asked_end



def _answer(row: dict, data: bytes) -> dict:
    return {"kind": "answer", "n": None, "bucket": row["bucket"], "block": row["block"], "stats": None, "data": data}



def _model(n: int, bucket: int, count: np.ndarray, arrays: list[np.ndarray], hot: int = 0) -> dict:
    """A part of the model: the statistics of an order and what is stored (for bigrams of the last round, with the trigrams)."""
    of = np.bincount(count[count <= CUTOFF + 1], minlength=CUTOFF + 2)
    return {"kind": "model", "n": n, "bucket": bucket, "block": None, "stats": [int(count.sum()), int((count > 0).sum()), *of[1:].tolist(), hot], "data": pack(*arrays)}


def _merge_words(rows: list[dict], setting: Setting) -> Iterator[dict]:
    """Adds up one bucket of words: its part of the model, and for each block counts and places by frequency."""
    parts = [unpack(r["data"]) for r in rows]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = _sums(at, np.concatenate([p[1] for p in parts]), len(keys))
    place = np.empty(len(keys), np.int64)
    place[np.lexsort((keys, -total))] = np.arange(len(keys))  # frequent words get small numbers
    bucket, seen = rows[0]["bucket"], total > 0
    yield _model(1, bucket, total, [keys[seen], total[seen], place[seen] * setting.buckets + bucket + 1], int((total > setting.capacity).sum()))
    for r, mine in zip(rows, np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])):
        yield _answer(r, pack(total[mine], place[mine]))


def _followers(v: np.ndarray, w: np.ndarray, c2: np.ndarray, count: np.ndarray, first: Level) -> tuple[np.ndarray, np.ndarray]:
    """Of each word v: how many bigrams after it have each count, and the unigram probability of all that follow it."""
    seen = c2 > 0
    return _by_count(v, c2, len(count)), np.bincount(v[seen], weights=unigrams(count, first)[w[seen]], minlength=len(count))


def _merge_bigrams(rows: list[dict], first: Level) -> Iterator[dict]:
    """Adds up one bucket of bigrams."""
    b = Bucket(rows, 2)
    key, at = _distinct(b.columns[0] * len(b.words) + b.columns[1])
    v, w = np.divmod(key, len(b.words))
    c2 = _sums(at, b.own, len(key))
    by, mass = _followers(v, w, c2, b.count, first)
    plain, seen = by.sum(axis=1) == 0, c2 > 0
    yield _model(2, rows[0]["bucket"], c2, [b.words, b.count, c2[seen], *steps([v[seen], w[seen]])])
    code, unseen = c2 << 1 | plain[v], c2 == 0
    for r, (mine,), (asked,) in b.each(at):
        wanted = np.unique(np.concatenate([v[mine[unseen[mine]]], asked]))
        yield _answer(r, pack(code[mine], b.words[wanted], by[wanted].ravel(), mass[wanted]))


def _merge_trigrams(rows: list[dict], first: Level, setting: Setting) -> Iterator[dict]:
    """Adds up one bucket of trigrams, and of the bigrams in them after words that aren't frequent."""
    b = Bucket(rows, 3)
    n = max(1, len(b.words))
    pair, pair_at = _distinct(np.concatenate([b.columns[0], b.asked[0]]) * n + np.concatenate([b.columns[1], b.asked[1]]))
    asked_pair, pair_at = pair_at[len(b.own) :], pair_at[: len(b.own)]
    b.asked = [asked_pair]
    gram, at = _distinct(pair_at * n + b.columns[2])
    of, w = np.divmod(gram, n)
    pair_v, pair_u = np.divmod(pair, n)
    v, c3 = pair_v[of], _sums(at, b.own, len(gram))
    known = np.zeros(len(gram), np.int64)
    known[at] = b.known
    hot = b.count > setting.capacity
    bigram, to = _distinct(v * n + w)
    bigram_v, bigram_w = np.divmod(bigram, n)
    c2 = np.where(hot[bigram_v], 0, _sums(to, c3, len(bigram)))
    by, mass = _followers(bigram_v, bigram_w, c2, b.count, first)
    plain = by.sum(axis=1) == 0
    plain[v[hot[v] & (known & 1 > 0)]] = True
    plain[v[hot[v] & (known & 1 == 0)]] = False
    lower = np.where(hot[v], known >> 1, c2[to])
    there = c3 > 0
    by3, by2 = _by_count(of, c3, len(pair)), _by_count(of[there], lower[there], len(pair))
    large = _sums(of[there], np.where(lower[there] > CUTOFF, lower[there], 0), len(pair))
    plain3 = by3.sum(axis=1) == 0
    met, seen, bucket = np.unique(of[there]), c2 > 0, rows[0]["bucket"]
    yield _model(2, bucket, c2, [])
    wide = met[hot[pair_v[met]]]  # what the bigrams here don't tell
    yield _model(
        3, bucket, c3, [b.words, b.count, c2[seen], *steps([bigram_v[seen], bigram_w[seen]]), c3[there], *steps([np.searchsorted(met, of[there]), w[there]]), *steps([pair_v[met], pair_u[met]]), hot[pair_v[met]].astype(np.int64), by2[wide].ravel(), large[wide], plain.astype(np.int64)]
    )
    often = np.zeros(len(pair), bool)
    often[met] = True
    three, two = c3 << 1 | plain3[of], lower << 1 | plain[v]
    missed, missed_two = (c3 == 0) & often[of], (lower == 0) & ~hot[v]
    for r, (mine,), (asked,) in b.each(at):
        words = np.unique(v[mine[missed_two[mine]]])
        pairs = np.unique(np.concatenate([of[mine[missed[mine]]], asked]))
        yield _answer(r, pack(three[mine], two[mine], b.words[words], by[words].ravel(), mass[words], b.words[pair_v[pairs]], b.words[pair_u[pairs]], by3[pairs].ravel(), by2[pairs].ravel(), large[pairs]))


_MADE = pa.schema([("kind", pa.string()), ("n", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("stats", pa.list_(pa.int64())), ("data", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
WORDS, BIGRAMS, TRIGRAMS = 1, 2, 3


def _heard(row: dict, told: pa.Table | None, setting: Setting) -> Block:
    """A block after the answers of the rounds so far."""
    out = Block(row, setting)
    by: dict[int, dict[int, bytes]] = {}
    for r in told.to_pylist() if told is not None else ():
        by.setdefault(r["round"], {})[r["bucket"]] = r["data"]
    if setting.order > 1:
        out.hear_bigrams(by.get(BIGRAMS, {}))
    if setting.order > 2:
        out.hear_trigrams(by.get(TRIGRAMS, {}))
    return out


def _messages(asked: Iterator[tuple[int, bytes]], block: int) -> pa.Table:
    return pa.Table.from_pylist([{"bucket": b, "block": block, "data": d} for b, d in asked], schema=_SENT)


def _sent(blocks: DataFrame, ask) -> DataFrame:
    """What ask(row) makes of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                yield from _messages(ask(row), row["block"]).to_batches()

    return blocks.mapInArrow(run, SENT)


def _met(blocks: DataFrame, answers: DataFrame, make, schema: str) -> DataFrame:
    """make(row, answers) of every block; none of it moves where blocks are dealt by block already."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda block, told: make(block.to_pylist()[0], told), schema)


def _merged(sent: DataFrame, merge) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(merge(table.to_pylist())), schema=_MADE)

    return sent.groupBy("bucket").applyInArrow(run, MADE)


def _stats(model: DataFrame, n: int) -> list[int]:
    """The statistics of an order over all buckets: a fixed number of values."""
    sums = model.filter((F.col("kind") == "model") & (F.col("n") == n)).agg(*[F.sum(F.col("stats")[i]) for i in range(CUTOFF + 4)]).first()
    return [int(x or 0) for x in sums]


def score(docs: DataFrame, order: int = 3, key: str = "doc_id", text: str = "text", model_path: str | None = None, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Scores every row by a model of the rows that aren't held out: SCORED, a written table.

    The model's tables go to model_path (in the shared folder if none is named), which must not exist; blocks and messages
    are removed when the scores are written.
    """
    if order not in (1, 2, 3):
        raise ValueError("the order of a model is 1, 2 or 3")
    spark = docs.sparkSession
    shipped(spark)
    root = model_path or fresh(spark, "katz-model")
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    facts = docs.agg(F.sum(F.octet_length(text)).alias("size"), F.count(F.when(crc % MODULUS != HELD, 1)).alias("trained")).first()
    setting = Setting(order, max(1, (facts["size"] or 0) // 6 // bucket_tokens), bucket_tokens, facts["trained"])

    with Scratch(spark, "katz") as scratch:

        def exchange(number: int, sent: DataFrame, merge) -> tuple[DataFrame, DataFrame]:
            """A round: its part of the model, and the answers."""
            place = f"{root}/round={number}"
            _merged(sent, merge).write.partitionBy("kind").parquet(place)
            scratch.tidy()
            made = spark.read.schema(MADE).option("basePath", place).parquet(place)
            return made, made.filter("kind = 'answer'").select("block", F.lit(number).alias("round"), "bucket", "data")

        def forget(number: int) -> None:
            removed(spark, f"{root}/round={number}/kind=answer")

        raw = scratch.written(_blocks(docs, key, text, block_tokens), "raw")
        own, answers = exchange(WORDS, _sent(raw, lambda row: Raw(row, setting).ask()), lambda rows: _merge_words(rows, setting))
        *first, frequent = _stats(own, 1)
        levels, base = [Level.of(first)], Level.of(first)

        def settled(row: dict, told: pa.Table) -> pa.Table:
            data = Raw(row, setting).settled(dict(zip(told.column("bucket").to_pylist(), told.column("data").to_pylist())))
            return pa.Table.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "ids", "data"])

        # dealt by block once, so that only messages are shuffled when blocks meet their answers
        blocks = scratch.bucketed(_met(raw, answers, settled, BLOCK), "blocks", "block")
        scratch.drop(raw)
        forget(WORDS)
        scratch.tidy()
        two, answers = [0] * len(first), spark.createDataFrame([], "block long, round int, bucket long, data binary")
        if order == 2 or order == 3 and (frequent or setting.trained > bucket_tokens):
            own, answers = exchange(BIGRAMS, _sent(blocks, lambda row: Block(row, setting).ask_bigrams()), lambda rows: _merge_bigrams(rows, base))
            two = _stats(own, 2)[:-1]
        if order == 3:

            def trigrams(row: dict, told: pa.Table) -> pa.Table:
                block = Block(row, setting)
                block.hear_bigrams({r["bucket"]: r["data"] for r in told.to_pylist()})
                return _messages(block.ask_trigrams(), row["block"])

            own, last = exchange(TRIGRAMS, _met(blocks, answers, trigrams, SENT), lambda rows: _merge_trigrams(rows, base, setting))
            answers = answers.unionByName(last)
            levels += [Level.of([a + b for a, b in zip(two, _stats(own, 2)[:-1])]), Level.of(_stats(own, 3)[:-1])]
        elif order == 2:
            levels.append(Level.of(two))
        rows = [(n, x.total, x.types, x.discounts, x.kept) for n, x in enumerate(levels, 1)]
        spark.createDataFrame(rows, "n int, total long, types long, discounts array<double>, kept double").coalesce(1).write.parquet(f"{root}/levels")
        out = written(_met(blocks, answers, lambda row, told: _heard(row, told, setting).scores(levels), SCORED), "katz-scores")
        forget(BIGRAMS)
        forget(TRIGRAMS)
    return out


# ---- the stored model as rows


def levels(spark: SparkSession, model_path: str) -> list[Level]:
    """The totals and discounts of a model, by order."""
    rows = spark.read.parquet(f"{model_path}/levels").orderBy("n").collect()  # three at most
    return [Level(r["total"], r["types"], list(r["discounts"]), r["kept"]) for r in rows]


def _stored(spark: SparkSession, model_path: str, read, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
                parts = unpack(data)
                for columns in read(n, parts) if parts else ():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=pa.schema(list(zip(names, kinds))))

    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}.get(f.split()[1], pa.list_(pa.int64())) for f in schema.split(", ")]
    shipped(spark)
    rows = spark.read.schema(MADE).option("basePath", model_path).parquet(f"{model_path}/round=*/kind=model")
    return rows.select("n", "data").mapInArrow(run, schema)


def _histories(*columns: np.ndarray) -> list[list[int]]:
    return np.stack(columns, axis=1).tolist()


def vocabulary(spark: SparkSession, model_path: str) -> DataFrame:
    """(hash, word, count) of every word: its 64-bit hash as text, its number and its count."""

    def read(n: int, p: list[np.ndarray]) -> Iterator[list]:
        if n == 1:
            yield [[f"{x:016x}" for x in p[0].tolist()], p[2], p[1]]

    return _stored(spark, model_path, read, "hash string, word long, count long")


def ngrams(spark: SparkSession, model_path: str) -> DataFrame:
    """NGRAM: every n-gram of two words or more with its count; the history's words stand in the order of the text."""

    def read(n: int, p: list[np.ndarray]) -> Iterator[list]:
        if n > 1:
            words, (v, w) = p[0], unsteps(p[3:5])
            yield [np.full(len(v), 2, np.int32), _histories(words[v]), words[w], p[2]]
        if n > 2:
            (of, w), (v, u) = unsteps(p[6:8]), unsteps(p[8:10])
            yield [np.full(len(w), 3, np.int32), _histories(words[u[of]], words[v[of]]), words[w], p[5]]

    return _stored(spark, model_path, read, NGRAM)


def backoffs(spark: SparkSession, model_path: str) -> DataFrame:
    """(n, history, count, alpha): the weight with which a history of n - 1 words backs off."""
    known = levels(spark, model_path)

    def read(n: int, p: list[np.ndarray]) -> Iterator[list]:
        if n > 1:
            words, (v, w) = p[0], unsteps(p[3:5])
            by, mass = _followers(v, w, p[2], p[1], known[0])
            own = np.unique(v)
            yield [np.full(len(own), 2, np.int32), _histories(words[own]), _sums(v, p[2], len(words))[own], left_over(by[own], known[1]).astype(float), mass[own]]
        if n > 2:
            (of, w), (v, u) = unsteps(p[6:8]), unsteps(p[8:10])
            left = left_over(_by_count(of, p[5], len(v)), known[2]).astype(float)
            wide, n_words = p[10] > 0, len(words)
            (bigram_v, bigram_w), own = unsteps(p[3:5]), v[of] * n_words + w
            bigram = bigram_v * n_words + bigram_w
            at = np.minimum(np.searchsorted(bigram, own), max(0, len(bigram) - 1))
            lower = np.where(wide[of], 0, p[2][at]) if len(bigram) else np.zeros(len(w), np.int64)
            by2, large = _by_count(of, lower, len(v)), _sums(of, np.where(lower > CUTOFF, lower, 0), len(v))
            by2[wide], large[wide] = p[11].reshape(-1, CUTOFF), p[12]
            mass = _pair_mass(p[1][v], p[13][v] > 0, by2, large, known[1])
            yield [np.full(len(v), 3, np.int32), _histories(words[u], words[v]), _sums(of, p[5], len(v)), left, mass]

    # what a split history has in several buckets adds up
    parts = _stored(spark, model_path, read, WEIGHT).groupBy("n", "history").agg(F.sum("count").alias("count"), F.sum("kept").alias("kept"), F.sum("mass").alias("mass"))
    kept = F.when(F.col("kept") > 0, F.col("kept") / F.col("count")).otherwise(1 / (F.col("count") + 1))
    return parts.select("n", "history", "count", (kept / (1 - F.col("mass"))).alias("alpha"))
