"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from test_native import plain_clean, plain_fit, plain_statistics, plain_topic

import __spark_entry__
import corpus_pipeline
from tessera.llm import bpe
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Connected pairs of texts with a similarity of 0.8 or more, by counting what every pair shares; texts without words are one group."""
    own = {i: shingles(t) for i, t in rows}
    holders, shared = defaultdict(list), Counter()
    for i, s in own.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in own}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = defaultdict(list)
    for i, s in own.items():
        same[frozenset(s)].append(i)
    for ids in same.values():
        for i in ids[1:]:
            parent[find(i)] = find(ids[0])
    first = {ids[0] for ids in same.values()}
    for ids in holders.values():
        ids = [i for i in ids if i in first]
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(own[a]) + len(own[b]) - n):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in own:
        groups[find(i)].append(i)
    return list(groups.values())


def test_run_is_the_plain_pipeline(spark, monkeypatch):
    kept, write = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda rows, name: kept.append(write(rows, name)) or kept[-1])
    last = corpus_pipeline.run(spark, SF).collect()
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, cleaned, once, mixed = ({r.doc_id: r for r in rows.collect()} for rows in kept)
    # quality rules: what the query keeps; every document is judged, and some go by distance alone
    judged = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert set(good) == {i for i, r in judged.items() if r.kept} and all(r.distance is not None for r in judged.values())
    assert any(not r.kept and not plain_statistics(documents[i].text)[6] for i, r in judged.items())
    assert all(good[i] == documents[i] for i in good)
    # line dedup
    order = sorted(good)
    assert [cleaned[i].text for i in order] == [t for t, _, _ in plain_clean([good[i].text for i in order], 10)]
    assert all(r.n_chars == len(r.text) for r in cleaned.values())
    # near-dedup: the least of each group stays; no document goes without its group, and hardly a group is missed
    groups = plain_groups([(i, r.text) for i, r in cleaned.items()])
    wanted = {min(ids) for ids in groups}
    assert wanted <= set(once) <= set(cleaned) and len(set(once) - wanted) <= 0.05 * (len(cleaned) - len(wanted))
    assert len(cleaned) - len(wanted) > 20 and all(once[i] == cleaned[i] for i in once)
    # mixing
    cell = {i: ("=" + r.source, "=" + r.lang, plain_topic(r.text)) for i, r in once.items()}
    tokens = Counter()
    for i, r in once.items():
        tokens[cell[i]] += len(r.text.encode().split())
    probability, _ = plain_fit(tokens)
    assert set(mixed) == {i for i in once if int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 16**12 < probability[cell[i]]}
    # encoding
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: (r.ids, r.n_tokens) for r in last} == {i: (x, len(x)) for i, r in mixed.items() for x in [library.encode_ordinary(r.text)]}


def test_stages_keep_the_columns_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "byte-level BPE"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_survive_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert docs.columns == columns or stage is corpus_pipeline.byte_bpe
        docs.count()
