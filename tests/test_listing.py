"""Listings: goldens by hand, edge cases, and every query against its SQL."""

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import urls
from tidemark.functions.html import hrefs, open_paragraphs, toplevel_paragraphs
from tidemark.functions.score import similarity
from tidemark.operators import content, links, order, pagination, select
from tidemark.plans import catalogs
from tidemark.sources import items

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, same_rows, name):
    same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_every_query_runs(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, DATA).count() > 0


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "decoded"),
    [("a+b", "a+b"), ("a%20b", "a b"), ("%zz%41", "%zzA"), ("%2520", "%20"), ("100%", "100%"), ("%FF", "�"), (None, None), ("", "")],
)
def test_percent_decode(spark, raw, decoded):
    assert one(spark, raw, urls.percent_decode) == decoded


def test_url_components(spark):
    p = one(spark, "https://Ex.com/a%20b//c/?q=1/", lambda u: F.struct(urls.normalise(u).alias("url"), urls.parts(urls.normalise(u)).alias("p")))
    assert (p.url, p.p.hostname, p.p.path, p.p.query, p.p.split_path, p.p.path_params) == ("https://Ex.com/a b//c/?q=1", "ex.com", "/a b//c/", "q=1", ["a b", "c"], "/a b//c/?q=1")
    p = one(spark, "http://h", lambda u: urls.parts(urls.normalise(u)))
    assert (p.path, p.path_params, p.split_path) == ("", "?", [])
    p = one(spark, "http://u:p@[::1]:80/x;v=1", lambda u: urls.parts(u))
    assert (p.hostname, p.path) == ("::1", "/x")
    assert one(spark, "mailto:a@b", lambda u: urls.parts(u)["hostname"]) is None


def test_fill_in(spark):
    rows = spark.createDataFrame([("/a",), ("c-1",), ("http://o/z",), ("mailto:q@w",)], "href string")
    got = rows.select(links.resolve(F.col("href"), F.lit("h"), F.lit("https")).alias("x")).select("x.url", "x.hostname").collect()
    assert [tuple(r) for r in got] == [("https:///a", "h"), ("https://c-1", "h"), ("http://o/z", "o"), ("hmailto:q@w", "h")]
    got = rows.select(links.resolve(F.col("href"), F.lit("h"), F.lit("https"), "rfc3986").alias("x")).select("x.url").collect()
    assert [r[0] for r in got] == ["https://h/a", "https://h/c-1", "http://o/z", "mailto:q@w"]


@pytest.mark.parametrize(("a", "b", "score"), [("/abc", "/abc", 6), ("/abc", "/abd", 5), ("/abcdef", "/abc", 6), ("/a/b", "/a/c", 2), ("/abc/x", "/abd/x", 11), ("/en/825", "/en/817", 9), ("/", "/abc", 0)])
def test_similarity(spark, a, b, score):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(similarity(urls.split_path(F.col("a")), urls.split_path(F.col("b")))).first()[0] == score


def scored(spark, scores):
    return spark.createDataFrame([(1, 1, i, f"u{i}", "h", f"/{i}", s) for i, s in enumerate(scores)], "catalog_id int, page_no int, pos int, url string, hostname string, path string, score long")


@pytest.mark.parametrize(("scores", "kept"), [([1, 1, 4], [4]), ([1, 2, 3], [3]), ([5, 5], [5, 5]), ([7], [7])])
def test_filter_links(spark, scores, kept):
    assert sorted(r.score for r in select.filter_links(scored(spark, scores)).collect()) == kept


def test_flat_catalogs_keep_duplicates(spark):
    rows = spark.createDataFrame([(1, 1, i, "u", "h", "/x", 5) for i in range(3)], "catalog_id int, page_no int, pos int, url string, hostname string, path string, score long")
    assert select.filter_links(rows).count() == 3


def test_mean_filter(spark):
    assert sorted(r.score for r in select.mean_filter(scored(spark, [10, 8, 2])).collect()) == [8, 10]


def test_keep_last(spark):
    rows = spark.createDataFrame([(1, 1, i, u, None, "/" + u) for i, u in enumerate("abac")], "catalog_id int, page_no int, pos int, url string, hostname string, path string")
    assert [r.url for r in select.keep_last(rows).orderBy("pos").collect()] == ["b", "a", "c"]


@pytest.mark.parametrize(("params", "found"), [("/en/825?page=2&ref=x", [2, 825]), ("/x?page=2", []), ("/a/1-22-3?", [1, 3, 22]), ("/c-01/v-1?", [1]), ("/99999999999999999999?", [99999999999999999999]), ("/000/0007/7?", [0, 7]), ("/9/1" + "0" * 60 + "/10?", [9, 10, 10**60])])
def test_numbers(spark, params, found):
    assert one(spark, params, lambda p: urls.digits(urls.numbers(p))) == [str(n) for n in found]


@pytest.mark.parametrize(
    ("rows", "measure"),
    [([], 0), ([[7]], 0), ([[1], [2]], 1), ([[2], [1]], 1), ([[1], [2], [3]], 1), ([[3], [2], [1]], 2), ([[3], [3], [3]], 1), ([[1], [2], [1]], 2),
     ([[1, 2021], [2, 2021], [3, 2021]], 2), ([[3, 2021], [2, 2021], [1, 2021]], 2), ([[5], [1, 2, 9]], 1)],
)
def test_fold(spark, rows, measure):
    assert spark.createDataFrame([(rows,)], "r array<array<long>>").select(order.fold(F.col("r"))).first()[0] == measure


@pytest.mark.parametrize(("given", "out"), [([1, 2, 3], [3, 2, 1]), ([3, 2, 1], [3, 2, 1]), ([1, 2], [2, 1]), ([2, 1], [1, 2])])
def test_series_order(spark, given, out):
    rows = [(1, 1, i, f"http://h/c/{n}/", "h", f"/c/{n}", ["c", str(n)], f"/c/{n}?") for i, n in enumerate(given)]
    catalog = spark.createDataFrame(rows, "catalog_id long, page_no int, pos int, url string, hostname string, path string, split_path array<string>, path_params string")
    got = catalogs.get_links(catalog, spark.createDataFrame([(1, ["zzz"])], "catalog_id long, target_path array<string>"))
    assert [int(r.url.split("/")[4]) for r in got.orderBy("rank").collect()] == out


def test_pagination(spark):
    cases = spark.createDataFrame(queries.RESPONSE_CASES, "catalog_id long, page_no int, request_url string, final_url string, status int, body string")
    assert sorted((r.catalog_id, r.page_no) for r in pagination.until_end(cases).collect()) == [(1, 1), (1, 2), (2, 1), (4, 1), (5, 1), (5, 2), (5, 3)]
    listing = spark.createDataFrame([("http://h/x", ""), ("http://h/x?s=1", "s=1")], "url string, query string")
    got = pagination.page_urls(listing, 2).where("page_no = 2").collect()
    assert sorted(r.page_url for r in got) == ["http://h/x?page=2", "http://h/x?s=1&page=2"]


def test_whole_listing(spark):
    body = '<script>"<a href=/no>"</script><!-- <a href="/no"> --><a class=x href="/c/1">1</a><A HREF=\'/c/2\'>2</A><a href=/c/3?a=1&amp;b=2>3</a><a>none</a><a href="">no</a>'
    responses = spark.createDataFrame([(7, 1, "http://h/c", "http://h/c", 200, body)], "catalog_id long, page_no int, request_url string, final_url string, status int, body string")
    listing = spark.createDataFrame([(7, "http://h/c", "http://h/c/9/")], "catalog_id long, source_url string, target_url string")
    found = catalogs.listing_links(responses, listing)
    assert [r.href for r in found.orderBy("pos").collect()] == ["/c/1", "/c/2", "/c/3?a=1&b=2"]
    assert catalogs.get_links(found, catalogs.targets(listing)).count() == 3
    assert catalogs.batch(found, catalogs.targets(listing)).count() == 3


def test_paragraphs(spark):
    html = "<p>a<p class=x>b</p><pre></pre><script>'<p>'</script><P>c</P>"
    assert one(spark, html, open_paragraphs) == 3
    assert one(spark, html, toplevel_paragraphs) == 1
    assert one(spark, "<p>a</p><p>b</p>", toplevel_paragraphs) == 2
    assert one(spark, None, open_paragraphs) == one(spark, None, toplevel_paragraphs) == 0
    assert one(spark, "", hrefs) == []


@pytest.mark.parametrize(("n", "status", "there"), [(40, 404, False), (29, 200, False), (30, 200, True), (40, 500, True)])
def test_content(spark, n, status, there):
    rows = spark.createDataFrame([(1, "<p>x</p>" * n, status)], "page_id long, html string, status int")
    assert content.page_content(rows).first().has_content is there


def test_no_text_is_no_content(spark):
    rows = spark.createDataFrame([(1, None)], "page_id long, html string")
    for how in ("open", "toplevel"):
        assert tuple(content.page_content(rows, how).first()) == (1, 0, False)


def brute_toplevel(html):
    """Paragraphs that begin while no other is open, read tag by tag."""
    import re

    found = depth = 0
    for m in re.finditer(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)p(?:\s[^>]*)?(/?)>", html):
        if m[0].startswith("<!--") or m[1]:
            continue
        if m[2]:
            depth = max(0, depth - 1)
        else:
            found += depth == 0
            depth += not m[3]
    return found


def test_toplevel_paragraphs_against_brute_force(spark):
    import random

    rng = random.Random(1)
    parts = ["<p>", "</p>", "<p class='x'>", "<P>", "</P>", "<p/>", "<pre>", "</pre>", "text", "<!-- <p> -->", "<script>'<p>'</script>", "<div>", "</div>", "<style>p{}</style>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = {r.page_id: r.paragraphs for r in content.page_content(rows, "toplevel").collect()}
    assert got == {i: brute_toplevel(t) for i, t in enumerate(texts)}
    pages = queries.snapshot(spark, DATA).toPandas()
    got = {r.page_id: r.paragraphs for r in queries.paragraph_count_toplevel(spark, DATA).collect()}
    assert got == {i: brute_toplevel(t) for i, t in zip(pages.page_id, pages.html, strict=True)}


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_directions_by_ranges(spark, ranges):
    """What ranges of rows do, put together, is what the whole walk gives."""
    import random

    rng = random.Random(ranges)
    rows = [(c, p, i, f"/{'/'.join(str(rng.randint(0, 6)) for _ in range(rng.randint(0, 3)))}/x") for c in range(12) for p in (1, 2) for i in range(c * 2)]
    links = spark.createDataFrame(rows, "catalog_id long, page_no int, pos int, path_params string")
    got = {r.catalog_id: (r.forward, r.backward) for r in order.directions(links, ranges).collect()}
    seqs = {}
    for c, _, _, params in rows:
        if found := sorted({int(x) for x in params.split("/") if x.isdigit()}):
            seqs.setdefault(c, []).append(found)
    whole = spark.createDataFrame(list(seqs.items()), "c long, r array<array<long>>").select("c", order.fold(F.col("r")).alias("a"), order.fold(F.reverse("r")).alias("b"))
    assert got == {r.c: (r.a, r.b) for r in whole.collect()} == {c: (walk(s), walk(s[::-1])) for c, s in seqs.items()}


def walk(rows):
    """The fold, slot by slot."""
    slots = [0] * (len(rows[0]) + 1)
    for last, now in zip(rows, rows[1:], strict=False):
        upto = lambda row, x: sum(e <= x for e in row)
        begin = max(upto(now, last[0]) - 1, 0)
        slots = [1 + slots[upto(last, x)] if k >= begin else 0 for k, x in enumerate(now)] + [0]
    return max(slots)


def test_ranks(spark):
    rows = spark.createDataFrame([(None if i % 3 else "g", i * 7 % 50, i) for i in range(50)], "g string, x int, y int")
    got = [tuple(r) for r in order.ranked(rows.repartition(5), "g", "x", "y").collect()]
    for g in (None, "g"):
        own = sorted((x, y, rank) for h, x, y, rank in got if h == g)
        assert [r for _, _, r in own] == list(range(1, len(own) + 1))


def test_catalogs_without_a_host(spark):
    """They are catalogs like others: their links are scored, filtered and ordered."""
    pages = spark.createDataFrame([(1, "mailto:a", "x"), (2, "mailto:b", "x"), (3, "http://h/a", "x")], "page_id long, url string, html string")
    site = catalogs.site_catalogs(pages)
    assert sorted((r.catalog_id or "", r.rank) for r in catalogs.get_links(site, catalogs.first_targets(site)).collect()) == [("", 1), ("h", 1)]
    assert catalogs.batch(site, catalogs.first_targets(site)).count() >= 1


@pytest.fixture(scope="module")
def server():
    """A site of listings: pages end by redirect, by status, by an empty body; some addresses fail."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    seen = []

    class Site(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            seen.append((self.path, self.client_address))
            parts = urlsplit(self.path)
            page = int(parse_qs(parts.query).get("page", ["1"])[0])
            path = unquote(parts.path)
            status, body, to = 200, f'<a href="/c/{page}">x</a>', None
            if path == "/a b" and page == 4:
                status, to = 302, "/a%20b"
            elif path == "/x" and page == 3:
                status = 404
            elif path == "/empty" and page == 2:
                body = ""
            elif path == "/loop":
                status, to = 302, "/loop"
            elif path == "/item/get-items":
                body = '{"success": true, "data": [{"_id": "1", "name": "n", "originUrl": "o", "currUrl": null}]}'
            elif path == "/broken":
                self.close_connection = True
                return
            data = body.encode()
            self.send_response(status)
            if to:
                self.send_header("Location", to)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((self.path, body))
            data = b'{"success": true}'
            self.send_response(201)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_PUT = do_POST

        def log_message(self, *a):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{site.server_port}", seen
    site.shutdown()


def test_live_listings(spark, server):
    from tidemark.sources.pages import listings

    base, seen = server
    asked = ["/a%20b", "/a b/", "/x/", "/x", "/empty", "/q?s=1", "/loop", "/broken"]
    urls_ = [base + a for a in asked] + ["http://[x", "no address", "ftp://127.0.0.1/x", "http://127.0.0.1:1/x"]
    answers = listings(spark, urls_, 5)
    rows = answers.collect()
    by = lambda i: [(r.page_no, r.status) for r in sorted(rows, key=lambda r: r.page_no) if r.catalog_id == i]
    assert by(0) == by(1) == [(1, 200), (2, 200), (3, 200), (4, 200)]
    assert by(2) == by(3) == [(1, 200), (2, 200), (3, 404)]
    assert by(4) == [(1, 200), (2, 200)] and by(5) == [(i, 200) for i in range(1, 6)]
    assert all(by(i) == [(1, None)] for i in range(6, 12))
    kept = sorted((r.catalog_id, r.page_no) for r in pagination.until_end(spark.createDataFrame(rows, answers.schema)).collect())
    assert kept == [(c, p) for c, n in ((0, 3), (1, 3), (2, 2), (3, 2), (4, 1), (5, 5)) for p in range(1, n + 1)]
    assert "/x?page=2" in {p for p, _ in seen} and "/q?s=1&page=2" in {p for p, _ in seen}
    # One connection served all pages of a listing.
    assert len({c for p, c in seen if p.startswith("/q")}) == 1
    pairs = spark.createDataFrame([(i, u, base + "/c/9") for i, u in enumerate(urls_)], "catalog_id long, source_url string, target_url string")
    found = catalogs.whole_listings(spark.createDataFrame(rows, answers.schema), pairs)
    assert sorted((r.catalog_id, r.url.split("/")[-1]) for r in found.collect() if r.catalog_id == 0) == [(0, "1"), (0, "2"), (0, "3")]


def test_items(spark, tmp_path):
    path = f"{tmp_path}/items"
    items.append(spark.createDataFrame([("1", "n", "o", ""), ("2", "", "o", "c")], "_id string, name string, originUrl string, currUrl string"), path)
    items.append(spark.createDataFrame([("3", "m", "o", "c")], "_id string, name string, originUrl string, currUrl string"), path)
    stored = items.read(spark, path)
    assert sorted((r["_id"], r.currUrl) for r in stored.collect()) == [("1", "o"), ("3", "c")]
    assert items.one(stored, "3").count() == 1
    assert stored.select(items.to_answer(stored)).count() == 2


def test_small_functions(spark):
    assert one(spark, "/x", lambda u: urls.with_origin(u, "http://o")) == "http://o/x"
    assert one(spark, "https://y", lambda u: urls.with_origin(u, "http://o")) == "https://y"
    assert spark.createDataFrame([(["a", "", "b"],)], "c array<string>").select(urls.join_classes(F.col("c"))).first()[0] == "a b"
    assert spark.range(1).select(urls.same_page(F.lit(None), F.lit("/a"), F.lit(None), F.lit("/a"))).first()[0] is True


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    site = catalogs.site_catalogs(pages)
    assert catalogs.get_links(site, catalogs.first_targets(site)).count() == 0
    assert catalogs.nav_catalogs(pages).count() == 0
    assert content.page_content(pages).count() == 0


def test_stream(spark, tmp_path):
    from tidemark.streaming.watch import arriving_pages, content_updates

    spark.createDataFrame([(1, "u", "<p>x</p>" * 30)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    content_updates(arriving_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 30, True)]


def test_scratch_tables(spark, monkeypatch):
    """They lie in the shared folder and go when they are no longer needed; a cluster without one is an error."""
    from pathlib import Path

    from tidemark import storage

    root = Path(storage.shared_root(spark).removeprefix("file://")) / "tidemark"
    with storage.scratch_until_end(spark):
        table = storage.written(spark.range(3).selectExpr("id", "id * 2 as id_2"), "test")
        assert table.count() == 3 and list(root.glob("test-*"))
    assert not list(root.glob("test-*"))

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    assert storage.shared_root(Session("local[2]")).startswith("file:///")
    with pytest.raises(ValueError, match=storage.SETTING):
        storage.shared_root(Session("local-cluster[3,2,3000]"))


def test_items_of_a_server(spark, server):
    import json

    from tidemark.sources import web

    base, seen = server
    assert [tuple(r) for r in items.fetch(spark, base).collect()] == [("1", "n", "o", None)]
    assert items.fetch(spark, "http://127.0.0.1:1").count() == 0
    rows = spark.createDataFrame([("1", "é", "o", ""), ("2", "", "o", "c"), ("3", "m", "o", "c")], "_id string, name string, originUrl string, currUrl string")
    answers = items.create(rows, base).collect()
    assert sorted((r["_id"], r.status, r.answer) for r in answers) == [("1", 201, '{"success": true}'), ("3", 201, '{"success": true}')]
    sent = sorted((json.loads(b)["name"], json.loads(b)["currUrl"]) for p, b in seen if p == "/item/create-item")
    assert sent == [("m", "c"), ("é", "o")]
    put = web.request(spark.createDataFrame([("/x", 1), ("nowhere", 2)], "answer_to string, n int"), F.col("answer_to"), "PUT", F.lit("{}"), base).collect()
    assert [(r.n, r.status) for r in put] == [(1, 201), (2, None)]


def test_database(spark):
    """A table of a database that runs inside the driver."""
    from tidemark.sources.pages import database

    url, driver = "jdbc:derby:memory:items;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").write.format("jdbc").options(url=url, dbtable="items", driver=driver).save()
    assert sorted(map(tuple, database(spark, url, "items", driver=driver).collect())) == [(1, "a"), (2, None)]
