"""Sharding, quality rules, mixing, line dedup and license scan against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import license_rules, license_scan, line_dedup, mixing, quality, sharding
from tessera.llm.common import written
from tessera.llm.queries import QUERIES, SQL

SPACE = "[\\x20\\x09-\\x0D]"


# ---- sharding


def test_shards_hold_as_many_rows_and_slots_have_no_gap(spark, sf):
    rows = QUERIES["op4_ring_sharding"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def plain_ring(cells, shards, vnodes, room):
    """One key after the other, clockwise: to the first virtual node whose shard has room."""
    nodes, used, out = sharding.ring(shards, vnodes), [0] * shards, []
    for cell in cells:
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), len(nodes))
        while used[nodes[at % len(nodes)][1]] >= room[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        out.append((cell, shard, used[shard]))
        used[shard] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_settling_counts_equals_placing_keys_one_by_one(slack):
    counts = {c: 1 + c % 4 for c in range(0, sharding.CELLS, 97)}
    total = sum(counts.values())
    room = [math.ceil((1 + slack) * total / 7)] * 7 if slack else [total // 7 + (s < total % 7) for s in range(7)]
    wanted = plain_ring([c for c in sorted(counts) for _ in range(counts[c])], 7, 16, room)
    got = [(cell, shard, slot + k - first) for cell, first, end, shard, slot in sharding.settle(counts, 7, 16, slack) for k in range(first, end)]
    assert got == wanted


def test_a_further_shard_moves_few_keys():
    counts = {c: 1 for c in range(sharding.CELLS)}
    where = lambda n: {(cell, k): shard for cell, a, b, shard, _ in sharding.settle(counts, n, 64, 0.25) for k in range(a, b)}
    before, after = where(40), where(41)
    assert sum(before[k] != after[k] for k in before) < 0.15 * len(before)


def test_sharding_odd_rows(odd, none):
    rows = sharding.shard_rows(odd, shards=4).collect()
    assert len(rows) == odd.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_rows(none).count() == 0


# ---- quality rules


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), n < 10 or 100 * len(covered) > 20 * n


def test_base_statistics(spark, sf, odd, none):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        got = quality.statistics(docs, carry={"text0": F.col("text")}).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_full_lines, r.base_failed) == plain_statistics(r.text0)
    assert quality.statistics(none).count() == 0


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a a a", "a b c d e f a b c d e x a b c d e", "a b c d", ""])
def test_repeated_windows(spark, text):
    docs = spark.createDataFrame([(text, "en", "s")], "text string, lang string, source string")
    assert quality.statistics(docs).first().n_repeat_words == plain_statistics(text)[4]


def floored(core, scale=None):
    """Center and floored covariance of a subset."""
    center = core.mean(axis=0)
    cov = (core - center).T @ (core - center) / len(core) * (scale or quality.CONSISTENT)
    return center, cov + np.diag(np.array(quality.FLOORS, float) ** 2)


def least_determinant(z, h):
    """The estimate of the subset of h rows with the least determinant, by trying all."""
    return min((floored(z[list(rest)]) for rest in itertools.combinations(range(len(z)), h)), key=lambda m: np.linalg.det(m[1]))


def distances(z, model):
    return ((z - model[0]) @ np.linalg.inv(model[1]) * (z - model[0])).sum(axis=1)


def judged(spark, groups, prior):
    """Distances, weights and verdicts of vectors by (lang, source)."""
    rows = [(lang, source, False, *map(int, v)) for (lang, source), z in groups.items() for v in z]
    stats = spark.createDataFrame(rows, "g_lang string, g_source string, base_failed boolean, z1 long, z2 long, z3 long, z4 long")
    return {(r.g_lang, r.g_source, r.z1, r.z2, r.z3, r.z4): (r.distance, r.own, r.kept) for r in quality.judge(written(stats, "test-stats"), prior=prior).collect()}


def test_small_groups_have_the_least_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for k in range(6):
        z = rng.normal([1500, 100, 50, 30], [80, 300, 150, 120], (12, 4)).round()
        z[:k % 4] += rng.normal(0, 1, (k % 4, 4)) * 40 + np.array([2500, 4000, 2000, 3000])  # up to a quarter lies far off
        groups["en", f"s{k}"] = z
    got = judged(spark, groups, 0)
    for (lang, source), z in groups.items():
        own = [got[lang, source, *map(int, v)] for v in z]
        wanted = distances(z, least_determinant(z, 9))
        assert all(weight == 1 for _, weight, _ in own)
        found = np.array([d for d, _, _ in own])
        assert [k for _, _, k in own] == (wanted <= 23.51).tolist()
        # concentration may end beside the least of all subsets, but not far from it
        assert np.linalg.det(floored(z[found.argsort()[:9]])[1]) <= 1.1 * np.linalg.det(least_determinant(z, 9)[1])


def test_estimates_of_small_groups_lean_on_their_language_and_that_on_all(spark):
    rng = np.random.default_rng(6)
    draw = lambda n, at: rng.normal([at, 100, 50, 30], [40, 200, 100, 100], (n, 4)).round()
    groups = {("en", "a"): draw(8, 1500), ("en", "b"): draw(4, 1500), ("de", "c"): draw(4, 1800)}
    got, leaning = judged(spark, groups, 20), lambda n, own, above: tuple(n / (n + 20) * x + 20 / (n + 20) * y for x, y in zip(own, above))
    best = lambda z: least_determinant(z, int(np.ceil(0.75 * len(z))))
    every = best(np.vstack(list(groups.values())))
    for lang in ("en", "de"):
        whole = np.vstack([z for (own, _), z in groups.items() if own == lang])
        above = leaning(len(whole), best(whole), every)
        for (own, source), z in groups.items():
            if own == lang:
                wanted = distances(z, leaning(len(z), best(z), above))
                assert [got[own, source, *map(int, v)][0] for v in z] == pytest.approx(wanted, rel=0.25)
                assert all(got[own, source, *map(int, v)][1] == pytest.approx(len(z) / (len(z) + 20)) for v in z)


def test_outliers_of_small_groups_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(4)
    draw = lambda n, at: rng.normal([at, 100, 50, 30], [40, 200, 100, 100], (n, 4)).round()
    groups = {("en", "large"): draw(60, 1500), ("en", "small"): draw(5, 1500), ("de", "a"): draw(30, 1800), ("de", "b"): draw(30, 1800), ("fr", "few"): draw(3, 1600)}
    odd = (9000, 100, 50, 30)
    groups["en", "small"] = np.vstack([groups["en", "small"], [odd]])
    groups["en", "one"] = np.array([odd], float)
    for (lang, source, *z), (_, weight, kept) in judged(spark, groups, quality.PRIOR).items():
        assert 0 < weight < 1 and kept == (tuple(z) != odd), (lang, source, z)


def test_query_judges_every_document_that_passes_the_plain_limits(spark, sf):
    rows = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.distance is not None for r in rows)
    assert any(not r.base_failed and not r.kept for r in rows)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*plain_statistics(texts[r.doc_id].text)[:5], plain_statistics(texts[r.doc_id].text)[6])
        assert r.kept == (not r.base_failed and r.distance <= 23.51)


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    failed = {r.doc_id for r in docs.collect() if plain_statistics(r.text)[6]}
    assert all(r.doc_id in ids for r in labels if r.quality == 1 and r.doc_id not in failed)
    junk = [r for r in labels if r.quality == 0]
    assert sum(r.doc_id not in ids for r in junk) > 0.8 * len(junk)


def test_quality_odd_rows(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not plain_statistics(r.text)[6] for r in odd.collect())
    assert quality.keep_good(none).count() == 0


# ---- mixing


def plain_goals(have):
    """Shares of the square roots, scarce values at most nearly whole: filled up from the scarcest."""
    order = sorted(have, key=lambda v: (have[v], v))
    size, goals = mixing.KEEP * sum(have.values()), {}
    for k, v in enumerate(order):
        factor = (size - sum(goals.values())) / (sum(math.sqrt(have[x]) for x in order[k:]) or 1.0)
        goals[v] = min(mixing.MOST * have[v], factor * math.sqrt(have[v]))
        if goals[v] < mixing.MOST * have[v]:
            return goals | {x: factor * math.sqrt(have[x]) for x in order[k:]}
    return goals


def plain_fit(cells):
    """Probabilities by cell, fitted in memory, and the goals of the three margins."""
    goals, factors = [], []
    for d in range(3):
        have = Counter()
        for c, n in cells.items():
            have[c[d]] += n
        goals.append(plain_goals(have))
        factors.append(dict.fromkeys(have, 1.0))
    p = lambda c: min(1.0, math.prod(factors[d][c[d]] for d in range(3)))
    for _ in range(mixing.ROUNDS):
        off = 0.0
        for d in range(3):
            have, whole = Counter(), Counter()
            for c, n in cells.items():
                have[c[d]] += n * p(c)
                whole[c[d]] += n if p(c) == 1 else 0
            for v, n in have.items():
                if n:
                    free, due = n - whole[v], goals[d][v] - whole[v]
                    factors[d][v] = round(factors[d][v] * (due / free if free > 0 and due > 0 else goals[d][v] / n), 9)
                    off = max(off, abs(goals[d][v] / n - 1))
        if off <= mixing.TOLERANCE:
            break
    return {c: p(c) for c in cells}, goals


def plain_topic(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") if len(w) >= 6]
    return f"t{int(hashlib.md5(min(words, key=str.encode).encode()).hexdigest()[:4], 16) % 8}" if words else "none"


def test_mixing_is_the_plain_fit_and_meets_its_margins(spark, same):
    sf = "/root/testdata/sf0.01"
    same(QUERIES["op7_mixing"](spark, sf), SQL["op7_mixing"], sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    of = {r.doc_id: ("=" + r.source, "=" + r.lang, plain_topic(r.text)) for r in docs}
    cells = Counter()
    for r in docs:
        cells[of[r.doc_id]] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    probability, goals = plain_fit(cells)
    expected = Counter()
    for r in QUERIES["op7_mixing"](spark, sf).collect():
        assert (r.source, r.lang, r.topic) == of[r.doc_id]
        assert r.probability == pytest.approx(probability[of[r.doc_id]], abs=2e-6)
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) / 16**12
        assert r.kept == (u < probability[of[r.doc_id]]) or abs(u - r.probability) < 1e-6
        for d, value in enumerate((r.source, r.lang, r.topic)):
            expected[d, value] += r.n_tokens * r.probability
    for d in range(3):
        for value, goal in goals[d].items():
            assert expected[d, value] == pytest.approx(goal, rel=0.01)


def test_skewed_margins_are_met(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "word " * int(rng.integers(5, 200)), "en" if rng.random() < 0.8 else ["de", "fr", None][i % 3], "hot" if rng.random() < 0.5 else f"s{i % 12}", f"t{int(rng.integers(0, 4)) ** 2 % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string")
    off = [r.expected / r.goal for r in mixing.residuals(mixing.margins(docs, "theme")).collect()]
    assert len(off) > 15 and all(abs(x - 1) < 0.01 for x in off)


def test_mixing_odd_rows(odd, none):
    kept = mixing.mixed_documents(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert mixing.mixed_documents(none).count() == 0


# ---- line dedup


def plain_clean(texts, least, ids=None):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(f"^{SPACE}+|{SPACE}+\\Z", "", line))
    held = {(k, i) for t, i in zip(texts, ids or range(len(texts))) if i is not None for k in {key(x) for x in (t or "").split("\n")}}
    found = Counter(k for k, _ in held)
    hot = {k for k, n in found.items() if k and n >= least}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in hot]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_line_dedup_and_its_sql(spark, same):
    same(QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.01"), SQL["op8_line_dedup"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_odd_rows(odd, none, least):
    rows = line_dedup.drop_shared_lines(odd, min_docs=least).collect()
    wanted = plain_clean([r.text for r in odd.collect()], least, [r.doc_id for r in odd.collect()])
    assert sorted((r["row"].text, r.n_lines, r.n_dropped) for r in rows) == sorted(wanted)
    assert line_dedup.drop_shared_lines(none).count() == 0
    cleaned = line_dedup.clean_documents(odd, min_docs=least)
    assert cleaned.columns == odd.columns
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())


def test_rows_of_one_id_are_one_document(spark, same):
    docs = spark.createDataFrame([(1, f"shared\nown {i}") for i in range(10)] + [(2, "other"), (None, "shared")], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.drop_shared_lines(docs).collect())
    assert sum(r.n_dropped for r in line_dedup.drop_shared_lines(docs, min_docs=1).collect()) == 22


# ---- license scan


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    places, base = [], set()
    for label, phrase in license_rules.PLAIN:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                base.add(label)
    s = " " + " ".join(words) + " "
    hits = []
    for order, label, priority, sure, _, _, expression in license_rules.rules():
        for m in re.finditer(expression, s):
            first = s[: m.start()].count(" ") - 1
            hits.append((first, first + m[0].count(" "), priority, order, label, sure))
    beats = lambda o, h: o[2] > h[2] or (o[2] == h[2] and (o[1] - o[0] > h[1] - h[0] or (o[1] - o[0] == h[1] - h[0] and o[3] < h[3])))
    kept = [h for h in hits if not any(o is not h and o[0] <= h[0] and o[1] >= h[1] and beats(o, h) for o in hits)]
    labels = base | {h[4] for h in kept}
    sure = max([1.0 if base else 0.0, *(h[5] / 100 for h in kept)])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), sure


LICENSED = [
    "Released under the MIT License.",
    "under the MIT license under the mit license. Apache License, Version 2.0; CC BY-NC 4.0 cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0 and then some; Copyright (c) 2019-2021 X. All rights reserved.",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. 3-clause BSD license",
    "creative commons attribution non-commercial share alike 4.0 international license",
    "licensed under the terms of the GNU Lesser General Public License version 2.1 or the Mozilla Public License 2.0",
    "mit mitten license",
]


def test_rules_are_hundreds_and_compile():
    assert len([x for x in (license_rules.NAMED + license_rules.PHRASES).split("\n") if x]) > 250  # lines written by hand
    gate = re.compile(license_rules.gate())
    for *_, keyword, needed, expression in license_rules.rules():
        re.compile(expression)
    for text in LICENSED[:-1]:
        assert gate.search(" " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " ")


def test_license_scan_is_the_plain_scan(spark, sf, odd, none):
    literal = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    for docs in (literal, spark.read.parquet(f"{sf}/documents.parquet"), odd):
        texts = [r.text for r in docs.select("text").collect()]
        got = license_scan.scan(docs).collect()
        row = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert sorted(map(repr, map(row, got))) == sorted(map(repr, map(plain_scan, texts)))
    assert license_scan.scan(none).count() == 0
