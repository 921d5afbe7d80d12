import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import katz


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Plain:
    """The model by definition, over all n-grams in memory."""

    def __init__(self, rows, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for key, text in rows:
            if zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 1:
                w = ["<s>"] * (order - 1) + tokens(text)
                for i in range(order - 1, len(w)):
                    for n in range(1, order + 1):
                        self.counts[n][tuple(w[i - n + 1 : i + 1])] += 1
        self.levels = [None]
        for n in range(1, order + 1):
            of = Counter(self.counts[n].values())
            self.levels.append(katz.discounts([of[r] for r in range(1, 7)]))
        self.total = sum(self.counts[1].values())
        self.unknown = sum(c - self.less(1, c) for c in self.counts[1].values()) / self.total if self.total else 1.0
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]].append((g[-1], c))

    def less(self, n, c):
        return c * self.levels[n][c - 1] if c <= 5 else c

    def p(self, h, w):
        if not h:
            c = self.counts[1][(w,)]
            return self.less(1, c) / self.total if c else self.unknown
        n = len(h) + 1
        if h not in self.after[n]:
            return self.p(h[1:], w)
        own = self.after[n][h]
        all_ = sum(c for _, c in own)
        plain = all(c > 5 for _, c in own)
        c = self.counts[n][h + (w,)]
        if c:
            return c / (all_ + 1) if plain else self.less(n, c) / all_
        kept = 1 / (all_ + 1) if plain else sum(c - self.less(n, c) for _, c in own) / all_
        return kept / (1 - sum(self.p(h[1:], x) for x, _ in own)) * self.p(h[1:], w)

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


#: Several blocks and buckets; words, and with the smallest also pairs and the begin of texts, frequent enough to be split.
@pytest.mark.parametrize(("order", "bucket"), [(1, 1_500), (2, 1_500), (3, 1_500), (3, 40), (3, 10**9)])
def test_scores_are_those_of_the_definition(spark, sf, order, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 120")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain(rows, order)
    got = {r.doc_id: r for r in katz.score(docs, order, block_tokens=9_000, bucket_tokens=bucket).collect()}
    assert len(got) == len(rows)
    types = len(plain.counts[1])
    for key, text in rows[::7]:
        own, r = tokens(text), got[key]
        assert r.score == pytest.approx(plain.score(text), rel=1e-9)
        assert (r.n_tokens, r.train_tokens) == (len(own), plain.total)
        assert r.n_known == sum(plain.counts[1][(t,)] > 0 for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((plain.counts[1][(t,)] + 0.5) / (plain.total + 0.5 * (types + 1))) for t in own), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(key).encode()) % 5 == 1)


def test_every_distribution_sums_to_one():
    rows = [(i, "a b c a b d e a b c f g a c") for i in range(4)] + [(10, "b a c d"), (12, "z y x")]
    plain = Plain(rows, 3)
    words = [g[0] for g in plain.counts[1]] + ["never seen"]
    for h in [(), ("a",), ("<s>",), ("a", "b"), ("nothing",), ("<s>", "<s>")]:
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1.0, abs=1e-12)


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in katz.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_odd_rows(spark, odd, none):
    got = katz.score(odd).collect()
    assert len(got) == odd.count() and all(r.score <= 0 and r.score == r.score for r in got)
    assert katz.score(none).count() == 0


def test_without_training_rows_all_is_unknown(spark):
    key = next(i for i in range(100) if katz.held_out(i))
    r = katz.score(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).first()
    assert (r.score, r.base_score, r.n_known, r.train_tokens) == (0.0, 0.0, 0, 0)


@pytest.mark.parametrize("bucket", [30, 10**9])
def test_stored_model_has_all_counts_and_weights(spark, tmp_path, bucket):
    rows = [(i, "a b c a b d e a b c f g a c A B " + "x y " * (i % 7)) for i in range(40)] + [(50, "b a c d"), (52, "z y x"), (53, None)]
    rows += [(60 + i, f"rare{i} a") for i in range(8)]  # so that discounts leave something for the unknown word
    path = f"file://{tmp_path}/model"
    katz.score(spark.createDataFrame(rows, "doc_id long, text string"), 3, model_path=path, block_tokens=60, bucket_tokens=bucket)
    plain = Plain(rows, 3)
    hashes = {f"{xxhash.xxh64_intdigest(w.encode()):016x}": w for (w,) in plain.counts[1] if w != "</s>"} | {f"{int(katz.END):016x}": "</s>"}
    words = {r.word: hashes[r.hash] for r in katz.vocabulary(spark, path).collect()} | {0: "<s>"}
    assert {hashes[r.hash]: r["count"] for r in katz.vocabulary(spark, path).collect()} == {w: c for (w,), c in plain.counts[1].items()}
    grams = Counter()
    for r in katz.ngrams(spark, path).collect():
        grams[(*[words[h] for h in r.history], words[r.word])] += r["count"]
    assert grams == plain.counts[2] + plain.counts[3]
    weights = {tuple(words[h] for h in r.history): (r["count"], r.alpha) for r in katz.backoffs(spark, path).collect()}
    assert set(weights) == set(plain.after[2]) | set(plain.after[3])
    for h, (count, alpha) in weights.items():
        own = plain.after[len(h) + 1][h]
        assert count == sum(c for _, c in own)
        unseen = next(w for (w,) in plain.counts[1] if w not in dict(own))
        assert plain.p(h, unseen) == pytest.approx(alpha * plain.p(h[1:], unseen), rel=1e-9)
