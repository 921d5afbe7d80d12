import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.graph import components


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(items, linked):
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in items:
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_anchors_miss_no_pair(bits):
    rng = random.Random(bits)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), bits):
            y ^= 1 << b
        row, anchor, home = simhash.anchors(np.array([[x], [y]], np.uint64), simhash.STRICT)
        assert home.sum() == 2
        assert anchor[(row == 0) & home][0] in anchor[row == 1]


def test_codes_are_perfect():
    for code in (simhash.GOLAY, simhash.HAMMING):
        patterns, _, count = simhash._patterns(code, 1)[0]
        assert len(patterns) == 1 << code.checks and (count == 1).all()


def test_groups_are_those_of_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    wanted = plain_groups(list(rows), lambda a, b: (rows[a] ^ rows[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{rows[i]:016x}", wanted[i]) for i in rows}


def test_crowded_anchors_are_split_without_losing_links(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(40, 62), 3)) for _ in range(60)} | {rng.getrandbits(63) for _ in range(60)})
    nodes = spark.createDataFrame([([f],) for f in fps], "fps array<long>")
    wanted = plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for cell in (2, 4096):
        roots = {r.node: r.root for r in components(simhash.links(nodes, simhash.STRICT, cell)).collect()}
        assert {f: roots.get(f, f) for f in fps} == wanted


def test_similar_texts_are_found_and_others_left_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, near = [], {}
    for i in range(60):
        text = [word() for _ in range(300)]
        copy = list(text)
        for at in rng.sample(range(300), 5):  # about 0.85 alike in shingles of five
            copy[at] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(60)} <= kept
    assert sum(2 * i + 1 in kept for i in range(60)) <= 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    once = simhash.one_of_each(odd)
    assert once.columns == odd.columns
    ids = [r.doc_id for r in once.select("doc_id").collect()]
    assert len(ids) == len(set(ids))


def test_first_lane_is_the_contract_fingerprint(spark):
    for text in ("a b c d", "A B", "", None, "x " * 1000):
        assert simhash.fingerprint(text)[0] & (1 << 64) - 1 == plain_fingerprint(text)


def jaccard(a, b):
    x, y = (set(zip(*[t.split()[i:] for i in range(5)])) or {tuple(t.split())} for t in (a, b))
    return len(x & y) / len(x | y)


def test_only_texts_alike_in_their_shingles_are_grouped(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    short = [" ".join(word() for _ in range(6)) for _ in range(200)]
    rows = [(0, ""), (1, None), *enumerate(short, 2)]
    for i in range(60):
        text = [word() for _ in range(300)]
        copy = list(text)
        for at in (20, 60, 100, 140, 180, 220, 260, 290)[: 4 if i % 2 else 8]:
            copy[at] = word()
        assert (jaccard(" ".join(text), " ".join(copy)) >= 0.8) == (i % 2 == 1)
        rows += [(1000 + 2 * i, " ".join(text)), (1001 + 2 * i, " ".join(copy))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {0, *range(2, 202)} <= kept and 1 not in kept
    assert {1000 + 2 * i for i in range(60)} <= kept
    assert {1001 + 2 * i for i in range(0, 60, 2)} <= kept
    assert sum(1001 + 2 * i in kept for i in range(1, 60, 2)) <= 2


def test_a_pair_leaves_the_first_anchor_it_meets_at_and_no_other(spark, monkeypatch):
    rng = random.Random(12)
    base = [rng.getrandbits(512) for _ in range(3)]
    flipped = [b ^ sum(1 << k for k in rng.sample(range(512), 30)) for b in base for _ in range(40)]
    rows = [(i, i, [(f >> 64 * k & (1 << 64) - 1) - ((f >> 64 * k + 63 & 1) << 64) for k in range(8)]) for i, f in enumerate(flipped)]
    nodes = spark.createDataFrame(rows, "node long, root long, fps array<long>").cache()
    meets, every = set(), np.array([r[2] for r in rows], np.int64).view(np.uint64)
    for table in range(simhash.SIMILAR.tables):
        row, anchor, home = simhash.anchors(every, simhash.SIMILAR, table)
        at = {}
        for r, a, h in zip(row.tolist(), anchor.tolist(), home.tolist()):
            at.setdefault(a, []).append((r, h))
        meets |= {(max(x, y), min(x, y)) for group in at.values() for x, h in group if h for y, _ in group if x != y}
    wanted = {(x, y) for x, y in meets if (flipped[x] ^ flipped[y]).bit_count() <= simhash.SIMILAR.near}
    assert len(wanted) > 1000
    met = simhash._met
    monkeypatch.setattr(simhash, "_met", lambda *a: emitted.append(met(*a)) or emitted[-1])
    emitted = []
    assert {(r.a, r.b) for r in simhash.candidates(nodes, simhash.SIMILAR, False).collect()} == wanted
    assert emitted[0].count() == len(wanted)
    assert {(r.a, r.b) for r in simhash.candidates(nodes, simhash.SIMILAR, False, 8).collect()} == wanted


def test_few_tables_are_dealt_at_once_and_none_is_left_out(spark, monkeypatch):
    rng = random.Random(13)
    base = rng.getrandbits(512)
    flipped = [base ^ sum(1 << k for k in rng.sample(range(512), 40)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, i, [(f >> 64 * k & (1 << 64) - 1) - ((f >> 64 * k + 63 & 1) << 64) for k in range(8)]) for i, f in enumerate(flipped)], "node long, root long, fps array<long>").cache()
    pairs = lambda tables: [(r.a, r.b) for r in simhash.candidates(nodes, simhash.SIMILAR, False, tables=tables).collect()]
    parts = [p for first in range(0, 17, 5) for p in pairs(range(first, min(first + 5, 17)))]
    assert sorted(parts) == sorted(pairs(None)) and len(parts) > 100
    dealt, sent = [], simhash._sent
    monkeypatch.setattr(simhash, "_sent", lambda nodes, layout, carry, tables: dealt.append(tables) or sent(nodes, layout, carry, tables))
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(100)) for _ in range(10)]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate([t + " end" for t in texts], 10)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == list(range(10))
    assert max(len(t) for t in dealt) <= simhash.TABLES < simhash.SIMILAR.tables
    assert sorted(t for group in dealt for t in group) == sorted([*range(17)] * 2)
