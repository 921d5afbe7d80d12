"""Rounds over several sites: turns within a host, and a crawl that goes on where it stopped."""

from tessera.plans import crawl

PAGES = [
    ("http://a/", "<a href=/1>1</a><a href=/2>2</a><a href=/3>3</a><a href='http://b/'>b</a>"),
    ("http://a/1", "<a href=/4>4</a><a href=/>home</a>"),
    ("http://a/2", ""),
    ("http://b/", "<a href=x>x</a>"),
    ("http://b/x", None),
]


def test_turns_and_resumption(spark, tmp_path):
    read = crawl.from_table(spark.createDataFrame(PAGES, "url string, html string"))
    seeds = spark.createDataFrame([("http://a/#top",), ("http://b/",)], "url string")
    folder = f"file://{tmp_path}/c"
    known = crawl.crawl_sites(seeds, read, folder, rounds=2, per_host=1)
    got = {r.url: (r.found, r.visited, r.status) for r in known.read().collect()}
    assert got == {"http://a/": (0, 0, 200), "http://b/": (0, 0, 200), "http://a/1": (1, 1, 200), "http://a/2": (1, None, None), "http://a/3": (1, None, None), "http://b/x": (1, 1, 200), "http://a/4": (2, None, None)}
    again = crawl.crawl_sites(seeds, read, folder, rounds=9, per_host=2)
    got = {r.url: (r.found, r.visited, r.status) for r in again.read().collect()}
    assert got["http://a/2"] == (1, 2, 200) and got["http://a/3"] == (1, 2, 404) and got["http://a/4"] == (2, 3, 404)
    assert all(v is not None for _, v, _ in got.values()) and again.history()[-1]["op"] == "round 3"
    assert crawl.crawl_sites(seeds, read, folder, rounds=2, per_host=2).read().count() == len(got)


def test_hosts_that_are_allowed(spark, tmp_path):
    read = crawl.from_table(spark.createDataFrame(PAGES, "url string, html string"))
    seeds = spark.createDataFrame([("http://a/",)], "url string")
    known = crawl.crawl_sites(seeds, read, f"file://{tmp_path}/c", rounds=3, per_host=10, hosts=["A"])
    assert {r.url for r in known.read().collect()} == {"http://a/", "http://a/1", "http://a/2", "http://a/3", "http://a/4"}
