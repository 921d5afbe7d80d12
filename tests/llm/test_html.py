import numpy as np

from tessera.llm import html_text


def text(source):
    return html_text.main_text(html_text.own_text(html_text.blocks(source or "")), np.empty(0, np.uint64))


def test_article_without_its_surroundings():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body>"
        "<header>site</header><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy</div><div id='cookie-notice'>ok?</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>One  two<br>three <b>bold</b><p>Next&nbsp;one &#8212; end<aside>side</aside>"
        "<form><input>name</form><div class='comments'><p>first!</p></div><!-- <p>no</p> --><ul><li>a<li>b</ul><table><tr><td>x<td>y</table></article>"
        "<div class=sidebar>more</div><footer>&copy; me</footer></body></html>"
    )
    assert text(page) == "Title & more\nOne two three bold\nNext one — end\na\nb\nx\ny"


def test_unclosed_and_broken_markup():
    assert text("<article><p><b>A<br><p>B</p><p>C") == "A\nB\nC"
    assert text("<p>a < b & c</p>") == "a < b & c"
    assert text("") == text(None) == ""
    assert text("<main><p>in</p></main><p>out</p>") == "in"


def extracted(spark, sources, chunk_bytes=1 << 22):
    rows = [(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(sources)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, chunk_bytes).collect()}
    return [got[k] for k in range(len(rows))]


def plain_texts(sources):
    """Boilerplate by counting every window of every page of a host."""
    own = [html_text.own_text(html_text.blocks(html)) for _, html in sources]
    split = [[t.split(" ") + [None] * ((8 - t.count(" ") - 1) if 3 <= t.count(" ") < 7 else 0) for t in page] for page in own]
    grams = lambda words: {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
    hosts = {}
    for (host, _), page in zip(sources, split):
        n, seen = hosts.setdefault(host, [0, {}])
        hosts[host][0] = n + 1
        for g in set().union(*map(grams, page)):
            seen[g] = seen.get(g, 0) + 1
    out = []
    for (host, _), texts, page in zip(sources, own, split):
        n, seen = hosts[host]
        stay = []
        for t, words in zip(texts, page):
            covered = [False] * len(words)
            for i in range(len(words) - 7):
                if seen[tuple(words[i : i + 8])] >= max(5, 0.8 * n):
                    covered[i : i + 8] = [True] * 8
            size = t.count(" ") + 1
            stay.append(sum(covered[:size]) <= 0.5 * size)
        left = [t for t, s in zip(texts, stay) if s]
        whole = sum(t.count(" ") + 1 for t in left) < 0.1 * sum(t.count(" ") + 1 for t in texts)
        out.append("\n".join(texts if whole else left))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def test_frames_go_and_quotes_and_copies_stay(spark):
    rng = np.random.default_rng(7)
    frame, short, quote, story = prose(rng, 20), prose(rng, 5), prose(rng, 60), [prose(rng, 40) for _ in range(3)]
    article = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    own = [prose(rng, 40) for _ in range(30)]
    # a.org frames most of its pages; some of them quote a passage; b.org has the frame's words as text; c.org copies one page
    sources = [("a.org", article(short, t, frame) if k < 27 else article(t)) for k, t in enumerate(own)]
    sources[3:9] = [("a.org", f"<div>{short}</div><p>{t}</p><p>{quote}</p><p>{frame}</p>") for t in own[3:9]]
    sources += [("b.org", article(prose(rng, 30), frame)) for _ in range(3)]
    sources += [("c.org", article(prose(rng, 6), *story)) for _ in range(12)]
    got = extracted(spark, sources)
    assert got[:3] == own[:3] and got[9:30] == own[9:30]
    assert got[3:9] == [t + "\n" + quote for t in own[3:9]]
    assert all(t.endswith(frame) for t in got[30:33])
    assert all(t.count("\n") == 0 or t.split("\n")[1:] == story for t in got[33:])
    assert got == plain_texts(sources)


def test_chunks_of_any_size_give_what_counting_gives(spark):
    rng = np.random.default_rng(9)
    frames = [prose(rng, k) for k in (4, 7, 8, 9, 25)]
    sources = []
    for host, n in (("a.org", 40), ("b.org", 23), ("c.org", 6), ("d.org", 5), ("e.org", 4)):
        for _ in range(n):
            blocks = [f for f in frames if rng.random() < 0.85] + [prose(rng, int(rng.integers(1, 400))) for _ in range(3)]
            sources.append((host, "<main>" + "".join(f"<p>{blocks[i]}</p>" for i in rng.permutation(len(blocks))) + "</main>"))
    wanted = plain_texts(sources)
    without = ["\n".join(html_text.own_text(html_text.blocks(html))) for _, html in sources]
    assert sum(a != b for a, b in zip(wanted, without)) > 30
    for chunk_bytes in (1 << 22, 5000, 300):
        assert extracted(spark, sources, chunk_bytes) == wanted


def test_suffixes_and_their_common_prefixes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 200):
        for kinds in (1, 2, 4):
            tokens = rng.integers(0, kinds, n)
            order, ranks = html_text.suffix_array(tokens)
            wanted = sorted(range(n), key=lambda i: tokens[i:].tolist())
            assert order.tolist() == wanted
            shared = html_text.common_prefixes(order, ranks)
            for k in range(1, n):
                a, b = tokens[wanted[k - 1] :].tolist(), tokens[wanted[k] :].tolist()
                assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_rows(spark):
    rows = [(1, "http://a.org/x", "<article><p>x  y</p></article>", "t"), (None, None, None, None), (2, "no url", "", "t"), (1, "http://a.org/x", "<article><p>x  y</p></article>", "t"), (3, "http://a.org/y", "<p>" + "w " * 50_000 + "</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((repr(r.page_id), r.n_chars) for r in html_text.extract(pages, 60).collect())
    assert got == [("1", 3), ("1", 3), ("2", 0), ("3", 99_999), ("None", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark, sf):
    """The table's articles are documents under a title; lines that many documents share must stay."""
    rows = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    docs = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and all(r.n_chars == len(r.text) for r in rows)
    assert all(" ".join(r.text.partition("\n")[2].split()) in docs for r in rows)


def test_sections_of_an_article_about_comments_and_notices_stay():
    kept = '<section id="comments-on-method"><p>We comment on the method.</p></section><div class="related-work notice"><p>Related work.</p></div><p class="ad-hoc">Ad hoc.</p>'
    gone = '<div class="comments">c</div><div id="comment-list">l</div><div class="ad">a</div><aside>s</aside><div class="ad banner sticky">b</div><div class="cookie-notice">n</div><div class="relatedItems">r</div>'
    page = f"<html><body><article><h1>Title</h1>{kept}{gone}</article></body></html>"
    assert html_text.own_text(html_text.blocks(page)) == ["Title", "We comment on the method.", "Related work.", "Ad hoc."]
