"""Literal cases of the rules that the driver's tables never meet."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import questions, references
from tessera.functions import text as tx
from tessera.operators.lexical import cover_rank, parse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,clean",
    [("a b c\u001cd\u0085e", "a b c d e"), (" \r\n a \t b ", "a b"), ("", ""), ("\0x", "x")],
)
def test_white_space_is_one_space(spark, raw, clean):
    assert one(spark, tx.norm_text(F.lit(raw))) == clean


@pytest.mark.parametrize("text,n,cut", [("abc", 3, "abc"), ("ab cd", 3, "ab"), ("äöü", 2, "äö")])
def test_clamp(spark, text, n, cut):
    assert one(spark, tx.clamp(F.lit(text), n)) == cut


@pytest.mark.parametrize("path,reason", [("/x/plan_alt.pdf", "filename_pattern"), ("/archiv/plan.pdf", "folder_pattern"), ("/x/plan.pdf", None), ("/x/plan_v2.pdf", "filename_pattern"), ("/x/alt text.pdf", "filename_pattern")])
def test_old_versions(spark, path, reason):
    assert one(spark, tx.old_version_reason(F.lit(path))) == reason


@pytest.mark.parametrize(
    "text,kind,refs",
    [
        ("nach DIN EN ISO 9001 und ISO 27001-2", "iso", ["ISO 9001", "ISO 27001"]),
        ("Art. 5 Abs. 1 DSGVO; § 26 BDSG; gilt§ 433 BGB", "law", ["DSGVO 5", "BDSG 26", "§ 26 BDSG"]),
        ("(https://example.org/a.pdf).", "url", ["https://example.org/a.pdf"]),
        ("siehe auch das Handbuch zur Wartung.", "internal_ref", ["das Handbuch zur Wartung"]),
        ("siehe kurz hier.", "internal_ref", []),
    ],
)
def test_references(text, kind, refs):
    assert [r["ref"] for r in references.references(text) if r["kind"] == kind] == refs


def test_section_sign_behind_a_word_counts_in_compat_mode_only():
    refs = lambda compat: [r["ref"] for r in references.references("gilt§ 433 BGB", compat)]
    assert refs(True) == ["§ 433 BGB"] and refs(False) == []


def test_references_keep_their_place():
    assert references.references("x ISO 9001")[0]["at"] == 2


@pytest.mark.parametrize("q,simple", [('"Datenschutz im Betrieb heute"', True), ("ISO 27001", True), ("Urlaub beantragen", True), ("Was ist das?", False), ("Wie lange gilt die Frist", False)])
def test_simple_questions(spark, q, simple):
    assert one(spark, questions.is_simple(F.lit(q))) is simple
    assert (questions.plan(q, lambda _: {"rewrites": ["x"]}).rewrites == [q]) is simple


@pytest.mark.parametrize("q,score", [("Vergleich der DSGVO Anforderungen 2023 und 2024", 1.25), ("Was ist eine Richtlinie?", 0.8), ("Wie unterscheiden sich alle Fristen?", 1.1)])
def test_complexity(spark, q, score):
    assert one(spark, questions.complexity(F.lit(q))) == pytest.approx(score)


def test_limits_follow_the_question():
    base = questions.Limits()
    low, high = base.scaled(0.8), base.scaled(2.0)
    assert (low.windows, low.window_chars, low.anchors, low.sources, low.source_chars, low.answer_tokens) == (3, 800, 1, 6, 2400, 500)
    assert (high.windows, high.window_chars, high.anchors, high.sources, high.source_chars, high.answer_tokens) == (6, 1500, 3, 12, 4500, 750)


def test_a_failing_planner_leaves_the_question():
    def broken(_):
        raise OSError

    assert questions.plan("Wie lange gilt die Frist?", broken).rewrites == ["Wie lange gilt die Frist?"]
    assert questions.plan("Wie lange gilt die Frist?", lambda _: {"rewrites": ["a", "b", "c"]}).rewrites == ["Wie lange gilt die Frist?", "a", "b"]


def test_greedy_packing(spark):
    text = "\n\n".join(["a" * 6, "b" * 5, "c" * 3])
    assert one(spark, tx.packed_parts(F.lit(text), 10)) == ["a" * 6, "b" * 5 + "\n\n" + "c" * 3]
    assert one(spark, tx.packed_parts(F.lit(""), 10)) == [""]


def test_row_labels(spark):
    assert one(spark, tx.labelled_row(["A", " ", "C"], [F.lit("1"), F.lit(2), F.lit(" ")])) == "A: 1 | Spalte2: 2"


@pytest.mark.parametrize("base,href,target", [("http://e.org/a/b?x#y", "c", "http://e.org/a/c"), ("http://e.org", "/c", "http://e.org/c"), ("http://e.org/a/", "?q=1", "http://e.org/a/?q=1"), ("http://e.org/a", "//f.org/x", "http://f.org/x"), ("http://e.org/a", "https://g.org", "https://g.org")])
def test_resolve(spark, base, href, target):
    assert one(spark, tx.resolve(F.lit(base), F.lit(href))) == target


def test_local_files_and_addresses(spark):
    assert one(spark, tx.local_to_url(F.lit("/data/docs/old name/a.html"), "/data/docs", "https://e.org/", {"old name": "new"})) == "https://e.org/new/a.html"


def test_event_streams(spark):
    assert one(spark, tx.event_text(F.lit("done"), F.lit("{}"))) == "event: done\ndata: {}\n\n"
    assert one(spark, tx.stream_chunks(F.lit('data: {"a":1}\n\ndata: x\n\ndata: [DONE]\n\ndata: no'))) == ['{"a":1}', "x"]


def test_web_queries():
    assert parse('a "b c" -d or e').groups == ((("a", "b c"), ("d",)), (("e",), ()))
    assert parse("").groups == ()


def cover_density(words, terms):
    """The sum over minimal covers, by a plain sweep."""
    wanted, last, total, floor = set(terms), {}, 0.0, -1
    for at, word in enumerate(words):
        if word in wanted:
            last[word] = at
            if len(last) == len(wanted) and min(last.values()) > floor:
                floor = min(last.values())
                total += 0.1 / (1 + (at - floor) - (len(wanted) - 1))
    return total


def test_cover_density_of_known_texts(spark):
    rng = random.Random(1)
    texts = [["a", "b"], ["a", "x", "b"], ["a", "b", "a"], ["a", "x"], [], ["a"] * 5] + [rng.choices("abcxy", k=rng.randint(0, 40)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, words array<string>")
    for terms in (["a", "b"], ["a", "b", "c"], ["a"]):
        got = [r[0] for r in rows.orderBy("i").select(cover_rank(F.col("words"), terms)).collect()]
        assert got == pytest.approx([cover_density(t, terms) for t in texts])
    assert [r[0] for r in rows.orderBy("i").limit(4).select(cover_rank(F.col("words"), ["a", "b"])).collect()] == pytest.approx([0.1, 0.05, 0.2, 0.0])


@pytest.mark.parametrize(
    "base,href,target",
    [
        ("http://h/a/b/c", "../x", "http://h/a/x"),
        ("http://h/a/b/c", "../../../x", "http://h/x"),
        ("http://h/a/b/c", "./x?y=../z", "http://h/a/b/x?y=../z"),
        ("http://h/a/b/c", "..", "http://h/a/"),
        ("http://h/a/b/", ".", "http://h/a/b/"),
        ("http://h/a/b/c", "/p/./q/../r#f", "http://h/p/r#f"),
        ("http://h/a/b/c", ".hidden/..x", "http://h/a/b/.hidden/..x"),
        ("http://h", "x/../y", "http://h/y"),
        ("http://h/a", "https://o/a/../b", "https://o/a/../b"),
    ],
)
def test_dot_segments(spark, base, href, target):
    assert one(spark, tx.resolve(F.lit(base), F.lit(href))) == target


@pytest.mark.parametrize(
    "reply,answer",
    [
        ('{"ergebnis": "x"}', "x"),
        ('{"sources": ["a"], "n": 5, "result": "y", "other": "z"}', "y"),
        ('{"answer": "a", "text": "b"}', "a"),
        ('{"confidence": "high"}', None),
        ("no json", None),
    ],
)
def test_the_first_other_string_is_the_answer(spark, reply, answer):
    assert one(spark, tx.answer_fields(F.lit(reply)))["answer"] == answer


def test_limits_of_one_question_and_of_many_agree(spark):
    for score in (0.3, 0.5, 0.8, 1.0, 1.2, 1.21, 1.5, 2.0):
        columns = questions.limit_columns(F.lit(score))
        got = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()
        assert got == {n: getattr(questions.Limits().scaled(score), n) for n in columns}


def test_embedded_links_come_first_and_are_surest(spark):
    links = [{"page_no": 1, "uri": "https://a/b", "text": "here"}, {"page_no": 1, "uri": "https://a/b", "text": "again"}, {"page_no": 2, "uri": "https://c", "text": ""}, {"page_no": 1, "uri": "mailto:x", "text": "m"}, {"page_no": 1, "uri": "http://d", "text": None}]
    rows = spark.createDataFrame([("see https://a/b and https://e/f.", links), ("plain", None)], "text string, links array<struct<page_no:int,uri:string,text:string>>")
    got = [[(r.kind, r.raw, r.ref, r.at, r.sure) for r in x[0]] for x in rows.select(references.with_links(references.find(F.col("text")), F.col("links"), F.lit(1))).collect()]
    assert got == [[("url", "here", "https://a/b", -1, 1.0), ("url", "http://d", "http://d", -1, 1.0), ("url", "https://e/f.", "https://e/f", 20, 0.95)], []]


def test_replies_of_known_forms(spark):
    from tessera.operators import packing

    replies = [
        ('<think>a\nb</think>  {"answer":"x"}', ("x", "medium", 0, "insufficient")),
        ('```json\n{"antwort":"x","source":["a","b"]}\n```', ("x", "medium", 2, "cited")),
        ('text before {"response": "y", "confidence": "high"} and after', ("y", "high", 0, "insufficient")),
        ("no json at all", (None, "medium", 0, "insufficient")),
        ("long " * 30, (None, "medium", 0, "fallback")),
        ('{"answer": "an answer that is longer than fifty characters, surely it is", "sources": []}', ("an answer that is longer than fifty characters, surely it is", "medium", 0, "fallback")),
    ]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, reply string").orderBy("i")
    got = rows.select(tx.answer_fields(F.col("reply")).alias("f"), packing.answer_kind(F.col("reply")).alias("kind")).collect()
    assert [(*r.f, r.kind) for r in got] == [w for _, w in replies]


def test_citation_metrics_of_known_answers(spark):
    from tessera.operators import evaluate

    answers = [
        ("Laut [1] gilt X. Gemäß [2] gilt Y. Siehe auch [3].", [(1, "doc1", 0.9), (2, "doc2", 0.8), (3, "doc3", 0.7)], (1.0, 1.0, 1.0, 0.8, 1.0)),
        ("Laut [1] gilt X. Gemäß [5] gilt Y.", [(1, "doc1", 0.9), (2, "doc2", 0.8)], (0.5, 0.5, 1.0, 0.85, 1.0)),
        ("Laut [1] gilt X.", [(1, "doc1", 0.9), (2, "doc2", 0.8), (3, "doc3", 0.7)], (1.0, 1 / 3, 1.0, 0.8, 1.0)),
        ("Laut [1] und [2].", [(1, "doc1", 0.9), (2, "doc1", 0.8)], (1.0, 1.0, 1.0, 0.85, 0.5)),
        ("Some answer", [], (0.0, 0.0, 0.0, 0.0, 0.0)),
        ("Punkt eins [1]. Punkt zwei. Punkt drei [2].", [(1, "doc1", 0.9), (2, "doc2", 0.8)], (1.0, 1.0, 2 / 3, 0.85, 1.0)),
    ]
    rows = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(answers)], "i int, answer string, sources array<struct<index:int,doc_id:string,confidence:double>>").orderBy("i")
    for r, (_, _, wanted) in zip(rows.select(*evaluate.citation_metrics(F.col("answer"), F.col("sources")).values()).collect(), answers):
        assert tuple(r) == pytest.approx(wanted)
