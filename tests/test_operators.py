"""Operators on small tables, with results written out by hand."""

import datetime
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.questions import Limits
from tessera.operators import crawl, evaluate, graph, packing, ranking, segments, vectors, versioning
from tessera.plans.ingest import ingest
from tessera.sources import files
from tessera.sources.tables import Store, cache_misses, feedback, graph_views
from tessera.streaming import events as streams


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# ---- segments


def test_three_pages_give_three_windows(spark):
    docs = spark.createDataFrame([(1, "a\n\n b \nc"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(segments.windows(docs).select("doc_id", "page_start", "page_end", "text")) == [(1, 1, 2, "a\n\nb"), (1, 2, 3, "b\n\nc"), (1, 3, 3, "c")]
    assert rows(segments.windows(docs, size=3, stride=2).select("page_start", "page_end")) == [(1, 3), (3, 3)]


def test_anchors_are_lines_or_the_whole(spark):
    pages = spark.createDataFrame([(1, 1, "x\n- y\nzz"), (1, 2, "only\none"), (1, 3, " ")], "doc_id long, page_no int, text string")
    got = rows(segments.anchors(pages).select("page_no", "anchor_no", "anchor_type", "start_offset", "end_offset", "text"))
    assert got == [(1, 1, "paragraph", 0, 1, "x"), (1, 2, "list_item", 2, 5, "- y"), (1, 3, "paragraph", 6, 8, "zz"), (2, 1, "paragraph", 0, 8, "only one")]


# ---- ranking and vectors


def test_merge_takes_the_greatest_vector_score(spark):
    lexical = spark.createDataFrame([(1, 0.4)], "window_id long, score double")
    vector = spark.createDataFrame([(1, 0.2), (1, 0.6), (2, 0.5)], "window_id long, score double")
    got = ranking.blended(ranking.merged(lexical, vector, ["window_id"])).select("window_id", "bm25", "vec", F.round("blend", 6))
    assert rows(got) == [(1, 0.4, 0.6, 0.51), (2, 0.0, 0.5, 0.275)]


def test_hits_of_each_question_are_diverse(spark):
    data = [(q, w, w % 3, 0.0, 1.0 - w / 100) for q in (1, 2) for w in range(12)]
    got = ranking.hits_of(spark.createDataFrame(data, "qid int, window_id long, doc_id long, bm25 double, vec double"), n=4, per=["qid"])
    assert rows(got.select("qid", "rank", "window_id")) == [(q, r, r - 1) for q in (1, 2) for r in (1, 2, 3, 4)]


def test_zero_vectors_have_no_cosine(spark):
    data = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    assert rows(vectors.top_k(data, [1.0, 0.0])) == [(2, 1.0)]


def test_many_queries_are_answered_in_passes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BATCH", 3)
    data = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<float>")
    asked = data.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = vectors.batch_top_k(data, asked, 1).collect()
    assert sorted(r.qid for r in got) == list(range(10)) and all(r.score == pytest.approx(1.0) for r in got)


def test_embedding_of_another_length_is_an_error(spark):
    data = spark.createDataFrame([(1, "a", None)], "id int, text string, embedding array<float>")
    with pytest.raises(Exception, match="length 4"):
        vectors.embedded(data, 4, model=lambda texts: [[1.0] for _ in texts]).collect()


def test_codes_of_more_than_one_word(spark):
    row = spark.range(1).select(vectors.binary_code(F.array(*[F.lit(1.0 if i in (0, 63, 64) else -1.0) for i in range(70)]), 70).alias("c")).first()
    assert [x & (1 << 64) - 1 for x in row.c] == [1 | 1 << 63, 1]


def test_reranking_reads_at_most_1500_characters(spark):
    data = spark.createDataFrame([("q", "x" * 2000)], "q string, text string")
    assert vectors.rescored(data, lambda q, t: [float(len(x)) for x in t], "q", "text").first().rerank == 1500


# ---- graph


def test_expansion_prefers_near_documents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (1, 1), (2, 4)], "src long, dst long")
    hits = spark.createDataFrame([(1,)], "doc_id long")
    assert [tuple(r) for r in graph.expansion(edges, hits).collect()] == [(2, 1), (3, 2), (4, 2), (9, 2)]
    assert rows(graph.reached(edges, hits, 3)) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2)]


def test_titles_resolve_by_substring(spark):
    docs = spark.createDataFrame([(1, "Das Handbuch zur Wartung 2024"), (2, "Anderes Dokument"), (3, "das handbuch zur wartung")], "doc_id long, title string")
    refs = spark.createDataFrame([("Handbuch zur Wartung",), ("kurz",), ("gibt es nicht hier",)], "ref string")
    assert rows(graph.resolved_titles(refs, docs)) == [("Handbuch zur Wartung", 1), ("gibt es nicht hier", None), ("kurz", None)]


# ---- versions


DOCS = "doc_id string, title string, uri string, sha256 string, categories array<string>, is_current boolean, archived_at timestamp, archive_reason string, source_url string, download_url string, last_seen_at timestamp, created_at timestamp"
NOW = datetime.datetime(2024, 1, 1)


def test_identity_by_address_then_content_then_path(spark):
    docs = spark.createDataFrame([("d1", "t", "u", "h1", None, True, None, None, None, "http://a", None, NOW), ("d2", "t", "u", "h2", None, True, None, None, None, None, None, NOW)], DOCS)
    new = spark.createDataFrame([("x", "h9", "http://a"), ("y", "h2", None), ("z", "h3", None)], "uri string, sha256 string, download_url string")
    got = {r.uri: r.doc_id for r in versioning.identified(new, docs).collect()}
    assert got["x"] == "d1" and got["y"] == "d2" and got["z"].startswith("doc_") and len(got["z"]) == 20


def test_archived_documents_stay_archived_and_old_paths_arrive_archived(spark):
    docs = spark.createDataFrame([("d1", "t", "u", "h", ["a"], False, NOW, "manual", None, None, None, NOW)], DOCS)
    come = spark.createDataFrame([("d1", "new", "u", "h2", None, None, None, "b"), ("d2", "old", "/x/p_alt.pdf", "h3", None, None, None, None)], "doc_id string, title string, uri string, sha256 string, source_url string, download_url string, last_seen_at timestamp, category string")
    got = {r.doc_id: r for r in versioning.upserted(docs, come).collect()}
    assert (got["d1"].title, got["d1"].is_current, got["d1"].categories) == ("new", False, ["a", "b"])
    assert (got["d2"].is_current, got["d2"].archive_reason, got["d2"].categories) == (False, "filename_pattern", [])


def test_children_are_replaced_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, n int")
    fresh = spark.createDataFrame([("a", 2)], "doc_id string, n int")
    assert rows(versioning.replaced_children(old, fresh, fresh)) == [("a", 2), ("b", 1)]
    assert rows(versioning.without_documents(old, fresh)) == [("b", 1)]


def test_the_older_of_two_overlapping_documents_is_archived(spark):
    texts = spark.createDataFrame([("n", "a b c d e", 5), ("o", "a b c d e", 3), ("p", "a b x", 9)], "doc_id string, text string, created_at int")
    pairs = spark.createDataFrame([("n", "o"), ("n", "p"), ("o", "n")], "new_id string, old_id string")
    assert rows(versioning.overlaps(pairs, texts).select("new_id", "old_id", "archived_id")) == [("n", "o", "o"), ("o", "n", "o")]


# ---- metrics


@pytest.mark.parametrize(
    "found,wanted,k,metric,value",
    [
        ([1, 2, 3], [1, 2, 3], 1, "precision", 1.0), ([1, 2, 3], [1, 2, 3], 5, "precision", 0.6), ([1, 2, 3], [1, 2, 3], 1, "recall", 1 / 3), ([1, 2, 3], [1, 2, 3], 5, "recall", 1.0), ([1, 2, 3], [1, 2, 3], 5, "ndcg", 1.0),
        ([4, 5, 6], [1, 2, 3], 1, "precision", 0.0), ([4, 5, 6], [1, 2, 3], 5, "hit", 0.0), ([4, 5, 6], [1, 2, 3], 0, "mrr", 0.0),
        ([1, 4, 2, 5, 6], [1, 2, 3], 5, "precision", 0.4), ([4, 5, 1, 6], [1], 0, "mrr", 1 / 3), ([1], [], 0, "mrr", 0.0), ([1], [], 1, "precision", None),
    ],
)
def test_retrieval_metrics(spark, found, wanted, k, metric, value):
    ranked = spark.createDataFrame([(0, r, d) for r, d in enumerate(found, 1)], "case_id int, rank int, doc_id long")
    relevant = spark.createDataFrame([(0, d) for d in wanted], "case_id int, doc_id long")
    got = {(r.metric, r.k): r.value for r in evaluate.retrieval_metrics(ranked, relevant, [1, 5]).collect()}
    assert got.get((metric, k)) == (pytest.approx(value) if value is not None else None)


def test_a_case_passes_with_a_hit_and_all_keywords(spark):
    data = spark.createDataFrame([(1.0, "Die DSGVO gilt", ["dsgvo"]), (1.0, "nein", ["dsgvo"]), (0.0, "dsgvo", ["dsgvo"]), (1.0, "x", [])], "hit double, answer string, words array<string>")
    assert [r.p for r in data.select(evaluate.passed(F.col("hit"), F.col("answer"), F.col("words")).alias("p")).collect()] == [True, False, False, True]


# ---- packing


def test_anchors_fill_what_hits_leave(spark):
    hits = spark.createDataFrame([(1, r, None, 1, 1, "t" * 9) for r in (1, 2)], "doc_id long, rank int, title string, page_start int, page_end int, text string")
    anchors = spark.createDataFrame([(2, r, 3, "list_item", "a" * 9) for r in (1, 2, 3)], "doc_id long, rank int, page_no int, anchor_type string, text string")
    cited = spark.createDataFrame([(3, r, "C", 1, 2, "c") for r in (1, 2, 3)], "doc_id long, rank int, title string, page_start int, page_end int, text string")
    got = [(r.source_index, r.section, r.title, r.location, r.text) for r in packing.packed(hits, anchors, cited, Limits(sources=3, source_chars=5)).orderBy("source_index").collect()]
    assert got == [(1, 1, "Unbekannt", "Seite 1", "ttttt..."), (2, 1, "Unbekannt", "Seite 1", "ttttt..."), (3, 2, None, "Seite 3, list_item", "aaaaa"), (4, 3, "C", "Seite 1-2", "c"), (5, 3, "C", "Seite 1-2", "c")]


# ---- crawling


def test_links_pages_and_documents(spark):
    html = "<a href='/f/a.pdf'>A (PDF)</a><a href='b#x'>B</a><a href=\"mailto:x@y.z?body=https://e.org/c.docx\">C</a><a href='javascript:0'>D</a><a href='/f/a.pdf'>again</a><a href='http://o.org/p'>O</a>"
    found = crawl.links(spark.createDataFrame([(1, "http://e.org/d/", html)], "page_id long, url string, html string"))
    assert rows(crawl.document_links(found).select("target", "anchor_text", "extension")) == [("http://e.org/f/a.pdf", "A", ".pdf"), ("https://e.org/c.docx", "C", ".docx")]
    assert rows(crawl.page_links(found).select("target")) == [("http://e.org/d/b",)]


def test_gap_stop(spark):
    tries = spark.createDataFrame([("p", n, n in (1, 2, 5)) for n in range(1, 21)], "pattern string, num long, hit boolean")
    assert max(r.num for r in crawl.until_gap(tries, 3).collect()) == 8


def test_pattern_addresses(spark):
    assert rows(crawl.pattern_addresses(spark, "http://e.org/{}.html", 9, 10, 3)) == [(10, "http://e.org/010.html"), (9, "http://e.org/009.html")]


# ---- sources


def _docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    head = lambda t: f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = f"{head('One')}<w:p><w:r><w:t>text</w:t></w:r></w:p><w:p/>{head('Two')}"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def _xlsx(path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Name</t></si><si><t>Ada</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.0</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>')


def test_files_of_every_readable_kind(spark, tmp_path):
    _docx(tmp_path / "a.docx")
    _xlsx(tmp_path / "b.xlsx")
    (tmp_path / "c.html").write_bytes("<html><head><meta charset=windows-1252><title>T t</title></head><body><nav>menu</nav><p>Größe</p><table><tr><td>x</td><td>y</td></tr></table></body></html>".encode("windows-1252"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.txt").write_text("not read")
    got = {r.path.rpartition("/")[2]: r for r in files.extracted(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.docx", "b.xlsx", "c.html", "d.docx"}
    assert got["a.docx"].pages == ["One\ntext", "Two"]
    assert got["b.xlsx"].pages == ["Sheet: S (Zeilen 2-2)\nName: Ada | Spalte3: 3"]
    assert (got["c.html"].title, got["c.html"].pages) == ("T t", ["Größe\n\nx | y"])
    assert got["d.docx"].pages is None and "BadZipFile" in got["d.docx"].error


def test_lists_and_cases(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a\n\n# no\n  http://b \n")
    (tmp_path / "c.json").write_text('{"test_cases": [{"query": "q", "category": "c"}, {"query": "r", "relevant_doc_ids": ["d"]}], "_instructions": "x"}')
    assert rows(files.url_list(spark, str(tmp_path / "u.txt"))) == [("http://a",), ("http://b",)]
    assert rows(files.evaluation_cases(spark, str(tmp_path / "c.json"))) == [(0, "q", [], [], "c"), (1, "r", ["d"], [], "general")]


def test_ingest_twice_and_changed(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.html").write_text("<title>Erstes Dokument hier</title><p>siehe Zweites Dokument dort.</p>")
    (inbox / "b_alt.html").write_text("<title>Zweites Dokument dort</title><p>mit ISO 9001 geprüft</p>")
    store = Store(spark, str(tmp_path / "store"))
    assert sorted(r.status for r in ingest(store, str(inbox), "cat").collect()) == ["archived", "new"]
    assert {r.is_current for r in store.read("documents").collect()} == {True, False}
    assert rows(store.read("citations").select("kind", "ref", "resolved")) == [("internal_ref", "Zweites Dokument dort", True), ("iso", "ISO 9001", False)]
    assert {r.status for r in ingest(store, str(inbox)).collect()} == {"unchanged"}
    (inbox / "a.html").write_text("<title>Erstes Dokument hier</title><p>ganz neu</p>")
    assert sorted(r.status for r in ingest(store, str(inbox)).collect()) == ["changed", "unchanged"]
    assert rows(store.read("pages").select("text")) == [("ganz neu",), ("mit ISO 9001 geprüft",)]
    assert store.read("documents").count() == 2


def test_views_feedback_and_cache(spark):
    pages = spark.createDataFrame([("d", 1)], "doc_id string, page_no int")
    anchors = spark.createDataFrame([("d", 1, 1)], "doc_id string, page_no int, anchor_no int")
    cites = spark.createDataFrame([("d", "e", "url", 1, True), ("d", None, "iso", 1, False)], "source_doc_id string, target_doc_id string, citation_type string, page_no int, resolved boolean")
    assert rows(graph_views(pages, anchors, cites)["cites"]) == [("d", "e", "url", 1)]
    assert feedback(spark.createDataFrame([(["x"], [])], "sources array<string>, history array<string>")).first() == ('["x"]', None)
    cache = spark.createDataFrame([("a", 5), ("b", 1)], "key string, expires_at int")
    assert rows(cache_misses(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), cache, F.lit(3))) == [("b",), ("c",)]


def test_fetching_by_a_function(spark):
    got = files.fetched(spark.createDataFrame([("u",)], "url string"), lambda u: (200, "e", b"x" * 5), most=3).first()
    assert (got.status, got.etag, got.content) == (200, "e", None)


# ---- streams


def _stream(spark, tmp_path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "src"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "src"))


def _drained(frame, name, mode="append"):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name)


T = "ts timestamp, user string, value double"


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    data = [(datetime.datetime(2024, 1, d, h), "u", float(h)) for d in (1, 2, 9) for h in (1, 5)]
    stream = _stream(spark, tmp_path, data, T)
    table = rows(streams.windowed(spark.createDataFrame(data, T), "1 day").select("window_start", "n", "total"))
    assert rows(_drained(streams.windowed(stream, "1 day"), "w1", "complete").select("window_start", "n", "total")) == table


def test_first_events_and_expiring_cache(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    data = [(at(0), "u", 1.0), (at(5), "u", 2.0), (at(100), "u", 3.0), (at(1), "v", 4.0)]
    stream = _stream(spark, tmp_path, data, T)
    assert rows(_drained(streams.unexpired(stream, "user", 60), "w2")) == [("u", False), ("u", False), ("u", True), ("v", False)]
    assert len(rows(_drained(streams.first_of(stream, ["user"]), "w3"))) == 2


def test_micro_batch_ingest_resumes(spark, tmp_path):
    schema = "k int, h string"
    out = str(tmp_path / "out")
    spark.createDataFrame([(1, "a")], schema).write.parquet(str(tmp_path / "src"))
    save = lambda batch, i: batch.write.mode("append").parquet(out)
    run = lambda: streams.ingest_stream(spark, str(tmp_path / "src"), schema, save, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "b")], schema).write.mode("append").parquet(str(tmp_path / "src"))
    run()
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b")]
    assert rows(streams.changed_only(spark.read.parquet(out), spark.createDataFrame([(1, "a"), (2, "x")], schema), "k", "h")) == [(2, "b")]


# ---- crawl plans and answers


def test_breadth_first_over_a_table(spark, tmp_path):
    from tessera.plans import crawl as plan

    link = lambda *t: "".join(f"<a href='{x}'>{x}</a>" for x in t)
    site = {"http://e.org/": link("a", "b", "http://o.org/x", "d.pdf"), "http://e.org/a": link("c", "/"), "http://e.org/b": link("a", "e.pdf"), "http://e.org/c": link("z")}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")

    def save(frame, name):
        path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    seeds = spark.createDataFrame([("http://e.org/#top",)], "url string")
    got, docs, cut = plan.breadth_first(seeds, plan.from_table(pages), save, depth=2)
    assert rows(got.select("depth", "url")) == [(0, "http://e.org/"), (1, "http://e.org/a"), (1, "http://e.org/b"), (2, "http://e.org/c")]
    assert rows(docs.select("target", "source_url")) == [("http://e.org/d.pdf", "http://e.org/"), ("http://e.org/e.pdf", "http://e.org/b")] and not cut
    few, _, cut = plan.breadth_first(seeds, plan.from_table(pages), save, depth=2, most=2)
    assert few.count() == 2 and cut
    assert {r.kind for r in plan.events(got, docs).collect()} == {"page", "document"}
    web = plan.from_web(lambda u: (200, None, site[u].encode()) if u in site else (404, None, b""))
    assert rows(plan.breadth_first(seeds, web, save, depth=1)[0].select("depth", "url")) == [(0, "http://e.org/"), (1, "http://e.org/a"), (1, "http://e.org/b")]


def test_numbered_pages_stop_at_a_gap(spark):
    from tessera.plans import crawl as plan

    pages = spark.createDataFrame([("http://e.org/01", "ok"), ("http://e.org/02", "Nr. 2 fehlt"), ("http://e.org/03", "Nr. 03 fehlt"), ("http://e.org/09", "ok")], "url string, html string")
    got = plan.numbered(spark, "http://e.org/{}", 1, 9, 2, "Nr. {} fehlt", 3, plan.from_table(pages))
    assert rows(got.select("num", "hit", "misses")) == [(1, True, 0), (2, False, 1), (3, False, 2), (4, False, 3)]


def test_sweep_archives_what_a_page_no_longer_has(spark):
    from tessera.plans import crawl as plan

    docs = spark.createDataFrame([("a", "t", "u", "h", None, True, None, None, "p", "x", None, NOW), ("b", "t", "u", "h", None, True, None, None, "p", "y", None, NOW)], DOCS)
    found = spark.createDataFrame([("x",)], "target string")
    got = {r.doc_id: r for r in plan.swept(docs, found, "p", F.lit(NOW)).collect()}
    assert (got["a"].is_current, got["a"].last_seen_at) == (True, NOW)
    assert (got["b"].is_current, got["b"].archive_reason, got["b"].last_seen_at) == (False, "orphaned", None)


def test_answers_and_fallbacks(spark):
    data = spark.createDataFrame([(1, "json", [(1, "d"), (2, "e")]), (2, "prose", [(i, "d") for i in range(5)]), (3, "nothing", [])], "id int, prompt string, sources array<struct<index:int,doc_id:string>>")
    replies = {"json": '{"answer": "ja", "sources": ["d"], "confidence": "high"}', "prose": "lang " * 40, "nothing": "?"}
    got = {r.id: r for r in packing.answered(data, lambda prompts: [replies[p] for p in prompts]).collect()}
    assert (got[1].kind, got[1].answer, got[1].confidence, len(got[1].evidence)) == ("cited", "ja", "high", 2)
    assert (got[2].kind, got[2].confidence, len(got[2].evidence)) == ("fallback", "medium", 3)
    assert got[3].kind == "insufficient" and got[3].answer.startswith("Nicht genügend") and "nächste Schritte" in got[3].answer


def test_a_failing_reranker_keeps_the_order_by_blend(spark):
    def broken(questions, texts):
        raise OSError

    data = spark.createDataFrame([(1, 0.2, "q", "a"), (2, 0.9, "q", "b")], "window_id long, blend double, q string, text string")
    got = ranking.reranked(vectors.rescored(data, broken, "q", "text"), 2)
    assert [r.window_id for r in got.orderBy("rank").collect()] == [2, 1]


def test_links_without_quotes_and_in_single_ones(spark):
    html = "<a class=x href=/a/b.pdf>A</a><a href='../c'>C <b>c</b></a><A HREF=\"/d?x=1&amp;y=2\" id=i>D</A><a data-href='/no'>n</a>"
    got = crawl.links(spark.createDataFrame([(1, "http://h/p/q", html)], "page_id long, url string, html string")).orderBy("place").collect()
    assert [(r.target, r.anchor_text) for r in got] == [("http://h/a/b.pdf", "A"), ("http://h/c", "C c"), ("http://h/d?x=1&y=2", "D")]


def test_fetch_errors_are_rows(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("no route")
        return 204, None, None

    got = {r.url: (r.status, r.content, r.error) for r in files.fetched(spark.createDataFrame([("bad",), ("none",)], "url string"), fetch).collect()}
    assert got == {"bad": (0, None, "OSError: no route"), "none": (204, None, None)}


def test_hubs_are_split_and_lose_no_neighbour(spark):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [(f"n{i}", "end") for i in range(5)] + [("a", "hub"), (None, "x"), ("x", None)], "src string, dst string")
    dealt, hubs = graph.split_adjacency(edges.toDF("a", "b").dropna(), hub=8)
    assert [(r.a, r.parts) for r in hubs.collect()] == [("hub", 7)] and dealt.filter("a = 'hub'").select("part").distinct().count() > 3
    got = {r.doc_id: r.distance for r in graph.reached(edges, spark.createDataFrame([("a",)], "doc_id string"), 3, hub=8).collect()}
    assert got == {"hub": 1, **{f"n{i}": 2 for i in range(50)}, "end": 3}


def test_a_superseded_document_needs_another_one(spark):
    docs = spark.createDataFrame([(i, True, None, None) for i in (1, 2, 3)], "doc_id long, is_current boolean, archive_reason string, archived_at timestamp")
    pairs = spark.createDataFrame([(2, 1), (3, 3), (9, 2)], "new_id long, old_id long")
    assert rows(versioning.superseded(docs, pairs, F.current_timestamp()).select("doc_id", "is_current", "archive_reason")) == [(1, False, "superseded"), (2, True, None), (3, True, None)]


def test_evaluated_cases_and_their_summary_are_written(spark, tmp_path):
    results = spark.createDataFrame([(1, "q", "a", True, 10.0, 0.5), (2, "r", "a", False, 30.0, None), (3, "s", "b", True, 5.0, 1.0)], "case_id int, query string, category string, passed boolean, latency_ms double, mrr double")
    files.evaluation_results(results, str(tmp_path / "r"))
    assert rows(spark.read.json(str(tmp_path / "r/cases")).select("case_id", "passed", "mrr")) == [(1, True, 0.5), (2, False, None), (3, True, 1.0)]
    summary = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (summary.total, summary.passed, summary.avg_latency_ms) == (3, 2, 15.0) and summary.by_category.a.passed == 1 and summary.by_category.b.avg_latency_ms == 5.0


def test_replacements_by_address_equal_all_pairs_and_meet_few_rows(spark):
    import random

    from tessera.operators import versioning

    rng = random.Random(2)
    pick = lambda *of: rng.choice(of)
    docs = [(rng.randrange(6), pick("u", "v", None), pick("a", "b", "c", None), pick(1, 2, None), rng.random() < 0.9) for _ in range(40)]
    come = [(i, u, s) for i in (*range(7), None) for u in ("u", "v", "w", None) for s in ("a", "b", "c", "d", None)]
    for take in (come[::3], come):
        wanted = {}
        for i, u, s in take:
            fit = [((c is not None, c or 0, o)) for o, v, t, c, now in docs if now and None not in (u, s, t, i) and u == v and s != t and i != o]
            if fit:
                wanted[i] = max(wanted.get(i, fit[0]), max(fit))
        got = versioning.replaced_by_url(spark.createDataFrame(take, "doc_id long, download_url string, sha256 string"), spark.createDataFrame(docs, "doc_id long, download_url string, sha256 string, created_at int, is_current boolean"))
        assert {r.doc_id: r.replaced_id for r in got.collect()} == {i: w[2] for i, w in wanted.items()}


def test_batch_top_k_equals_all_pairs_and_moves_few_rows(spark, monkeypatch):
    """Ties, zero and odd vectors, several passes; before, every pair of a query and a row went to the window."""
    import numpy as np

    monkeypatch.setattr(vectors, "BATCH", 7)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (200, 4)).astype(float).tolist()  # many equal directions
    data = [*enumerate(rows), (200, [0.0] * 4), (201, None), (202, [1.0, 2.0]), (203, [1.0, None, 2.0, 3.0]), (204, [float("nan"), 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    asked = table.filter("vec_id % 10 = 0 OR vec_id > 200").selectExpr("vec_id AS qid", "embedding AS qvec")
    score = vectors.cosine(F.col("embedding"), F.col("qvec"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    wanted = asked.crossJoin(table).select("qid", "vec_id", score.alias("score")).filter("score IS NOT NULL").withColumn("rank", rank).filter("rank <= 5")
    frame = vectors.batch_top_k(table, asked, 5)
    assert "NestedLoopJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.qid, r["rank"], r.vec_id, repr(r.score))
    assert sorted(map(key, frame.collect())) == sorted(map(key, wanted.collect()))
    assert vectors.batch_top_k(table, asked.limit(0), 5).count() == 0
