import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup
from tessera.llm.queries import QUERIES


def plain(rows, length, keep):
    """(id, spans, kept) of rows (id, text), by a table of all windows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    places: dict[bytes, list] = {}
    for r, (i, b) in enumerate(data):
        for at in range(len(b) - length + 1):
            places.setdefault(b[at : at + length], []).append(((i is not None, i, hashlib.sha256(b).hexdigest(), at), r))
    out = []
    for r, (i, b) in enumerate(data):
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            own = places[b[at : at + length]]
            if keep == "none":
                hit = len(own) > 1
            else:
                least = min(p for p, _ in own)
                hit = least != (i is not None, i, hashlib.sha256(b).hexdigest(), at)
            if hit:
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(x for x, g in zip(b, gone) if not g)))
    return out


def found(docs, **how):
    return [(r.row.doc_id, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.without_repeats(docs, **how).collect()]


def by_id(rows):
    return sorted(rows, key=repr)


def test_query_equals_all_windows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = {i: (sum(e - b for b, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, spans, kept in plain([tuple(r) for r in rows], 200, "none")}
    got = QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == wanted
    assert all(r.n_bytes == len((t.text or "").encode()) for r in got for t in rows if t.doc_id == r.doc_id)
    assert sum(n for n, _, _ in wanted.values()) > 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(20), prose(4)
    rows = [(i, prose(rng.randint(5, 60))) for i in range(30)]
    rows += [(i, prose(rng.randint(0, 9)) + " " + passage + prose(rng.randint(0, 9))) for i in range(30, 60)]  # one passage, many surroundings
    rows += [(i, prose(8) + short + prose(8)) for i in range(60, 80)]
    rows += [(80, "ab" * 200), (81, "x" * 500), (82, None), (83, ""), (84, passage), (85, passage), (86, prose(300) + passage + prose(10) + passage)]
    rows += [(None, prose(20)), (None, passage + "!"), (87, "é" * 100), (88, "é" * 40)]
    return rows + [rows[3], rows[3], rows[40], (3, passage)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length,crowd,chunk", [(40, 10_000, 1 << 20), (40, 3, 200), (33, 10_000, 2000), (200, 5, 1 << 20)])
def test_passages_copies_and_odd_rows(spark, texts, keep, length, crowd, chunk):
    docs = spark.createDataFrame([(i, t, 1, 2, "s", 3) for i, t in texts], "doc_id long, text string, n long, dk long, sha string, later int").repartition(3)
    assert by_id(found(docs, length=length, keep=keep, crowd=crowd, chunk=chunk)) == by_id(plain(texts, length, keep))


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert by_id(found(odd, length=200, keep="none")) == by_id(plain(rows, 200, "none"))
    assert suffix_dedup.without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(none, keep="last")


def test_a_third_of_all_rows_alike(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same passage, "), 20)).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    for keep in ("none", "first"):
        assert by_id(found(docs, length=100, keep=keep, crowd=50)) == by_id(plain(rows, 100, keep))


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd ", k=n)).encode() for n in (5000, 10, 700, 3000, 41)]
    whole = {(t, w, h) for text, first, last, anchor in suffix_dedup.segments(texts, 40) for t, a, b, h in zip(text, first, last, anchor) for w in range(a, b + 1)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    cut = {(t, w, h) for text, first, last, anchor in suffix_dedup.segments(texts, 40) for t, a, b, h in zip(text, first, last, anchor) for w in range(a, b + 1)}
    assert cut == whole and len(whole) == sum(max(0, len(t) - 39) for t in texts)


def test_suffix_order_and_factors_equal_a_plain_sort():
    rng = random.Random(7)
    for length in (8, 16, 20, 33, 64):
        data = np.frombuffer("".join(rng.choices("ab", k=400)).encode() + b"abab" * 60 + bytes(50), np.uint8)
        starts = np.sort(np.array(rng.sample(range(len(data) - length + 1), 300)))
        raw = data.tobytes()
        order, common = suffix_dedup.suffix_order(data, starts, length)
        assert order.tolist() == sorted(starts.tolist(), key=lambda s: (raw[s : s + length], s))
        shared = lambda a, b: next((k for k in range(length) if raw[a + k] != raw[b + k]), length)  # noqa: E731, B023
        assert common.tolist() == [0, *(shared(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist()))]
        earlier = suffix_dedup.previous_factors(order, common)
        assert earlier.tolist() == [max((shared(s, t) for t in starts.tolist() if t < s), default=0) for s in order.tolist()]
        least = length // 2
        assert suffix_dedup.previous_factors(-order, common, least).tolist() == [max((x for t in starts.tolist() if t > s and (x := shared(s, t)) >= least), default=0) for s in order.tolist()]


def test_a_crowded_passage_gives_rows_for_its_segments_not_for_its_windows(spark, monkeypatch):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(400)
    rows = [(i, passage + prose(150)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    most, segments = [], suffix_dedup._segments

    def counted(*how):
        made = segments(*how)
        most.append(made.count())
        return made

    monkeypatch.setattr(suffix_dedup, "_segments", counted)
    for keep in ("none", "first"):
        assert by_id(found(docs, length=100, keep=keep, crowd=20)) == by_id(plain(rows, 100, keep))
    runs = sum(len(first) for _, first, _, _ in suffix_dedup.segments([t.encode() for _, t in rows], 100))
    assert runs < 60 * 451 / 10 and max(most) <= runs


def test_bands_hold_every_window_once_and_equal_windows_share_the_same():
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    texts = [("".join(rng.choices("abcdefgh ", k=50)) + passage + "".join(rng.choices("abcdefgh ", k=90))).encode() for _ in range(8)]
    for width in (16, 1):
        shares = {}
        for text, first, last, anchor in suffix_dedup.segments(texts, 100):
            for t, a, b, h in zip(text.tolist(), first.tolist(), last.tolist(), anchor.tolist()):
                own = texts[t][a : b + 100]
                seen = []
                for begin, end, shared in suffix_dedup.bands(own, 100, width):
                    assert end - begin < width and len(shared) == 101 - width
                    for w in range(begin, end + 1):
                        assert shared in own[w : w + 100]
                        shares.setdefault((h, own[w : w + 100]), set()).add(shared)
                        seen.append(w)
                assert seen == list(range(b - a + 1))
        assert all(len(x) == 1 for x in shares.values()) and len(shares) < sum(len(t) - 99 for t in texts)


def test_a_text_and_its_copies_alone_move_no_segments(spark, monkeypatch):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    copied, passage = prose(600), prose(300)
    rows = [(i, copied) for i in range(3)] + [(i, prose(500)) for i in range(3, 9)]
    moved, segments = [], suffix_dedup._segments

    def counted(*how):
        made = segments(*how)
        moved.append(made.count())
        return made

    monkeypatch.setattr(suffix_dedup, "_segments", counted)
    for keep in ("none", "first"):
        assert by_id(found(spark.createDataFrame(rows, "doc_id long, text string"), length=100, keep=keep)) == by_id(plain(rows, 100, keep))
    assert max(moved) == 0
    more = rows + [(9, prose(90) + copied[200:500] + prose(90)), (10, passage), (11, passage), (12, "x" + passage)]  # now others have windows of the copies
    for keep in ("none", "first"):
        assert by_id(found(spark.createDataFrame(more, "doc_id long, text string"), length=100, keep=keep)) == by_id(plain(more, 100, keep))
    assert max(moved) > 0


def test_segments_are_cut_to_what_they_may_share():
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [prose(n) for n in (60, 101, 150, 400)]  # the first is too short for a window of 100, but long enough for a common anchor
    texts = [(prose(rng.randint(0, 150)) + passages[i % 4] + prose(rng.randint(0, 150))).encode() for i in range(40)] + [b"ab" * 120, b"ab" * 90, b"x" * 300]
    pieces, leads, group, places = [], [], [], {}
    for text, first, last, lead, anchor in suffix_dedup.led(texts, 100):
        for t, a, b, at, h in zip(text.tolist(), first.tolist(), last.tolist(), lead.tolist(), anchor.tolist()):
            for w in range(a, b + 1):
                places.setdefault(texts[t][w : w + 100], set()).add(len(pieces))
            pieces.append(texts[t][a : b + 100])
            leads.append(at)
            group.append(h)
    begin, end = suffix_dedup.cores(pieces, leads, group)
    for k, (own, a, b) in enumerate(zip(pieces, begin.tolist(), end.tolist())):
        assert 0 <= a <= leads[k] <= b <= len(own)
        for w in range(len(own) - 99):
            assert len(places[own[w : w + 100]]) == 1 or a <= w and w + 100 <= b
    several = [k for k in range(len(pieces)) if group.count(group[k]) > 1]
    none = [k for k in several if end[k] - begin[k] < 100]
    assert len(several) > len(none) > 5 and sum((end - begin)[k] for k in several if k not in none) < sum(len(pieces[k]) for k in several if k not in none)


def test_segments_travel_by_their_places():
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcd ", k=n)).encode() for n in (500, 60, 3, 900)] + [b"x" * 80]
    lists, wanted = [[] for _ in texts], []
    for text, first, last, lead, anchor in suffix_dedup.led(texts, 40):
        for row in zip(text.tolist(), first.tolist(), last.tolist(), lead.tolist(), anchor.tolist()):
            wanted.append(row)
            lists[row[0]].append({"h": row[4], "at": np.array(row[1:4], "<i4").tobytes()})
    for own in lists:
        rng.shuffle(own)
    lists = suffix_dedup.pa.array(lists, suffix_dedup.pa.list_(suffix_dedup.pa.struct([("h", suffix_dedup.pa.int64()), ("at", suffix_dedup.pa.binary())])))
    assert list(zip(*(x.tolist() for x in suffix_dedup.named(lists)))) == wanted
    assert [len(x) for x in suffix_dedup.named(lists[2:3])] == [0] * 5
