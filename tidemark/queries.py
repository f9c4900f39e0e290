"""The named queries over the pages tables, and SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls
from .functions.score import similarity
from .operators import content, links, order, pagination, select
from .plans import catalogs
from .sources import items as item_source
from .sources.pages import EXAMPLE_PAIRS, pairs, snapshot
from .storage import scratch, written

#: Addresses with escapes, ports, user data, parameters and trailing slashes.
URL_CASES = [
    "https://Ex.com/a%20b//c/?q=1/", "http://h", "http://h/a+b", "http://h/%zz", "http://h/a%2520b", "HTTP://USER:pw@Host.ORG:8080/X/y///",
    "http://h/a;p=1?x=2#f", "?only=query", "mailto:a@b.c", "//cdn.x/y", "/rooted/path/", "#top", "http://h/%C3%A9t%C3%A9",
]
#: catalog, page, requested, final, status, body.
RESPONSE_CASES = [
    (1, 1, "http://a/x", "http://a/x", 200, "b"), (1, 2, "http://a/x?page=2", "http://a/x?page=2", 200, "b"), (1, 3, "http://a/x?page=3", "http://a/x", 200, "b"), (1, 4, "http://a/x?page=4", "http://a/x?page=4", 200, "b"),
    (2, 1, "http://b/x", "http://b/y", 200, "b"), (2, 2, "http://b/x?page=2", "http://b/x?page=2", 200, ""), (2, 3, "http://b/x?page=3", "http://b/x?page=3", 200, "b"),
    (3, 1, "http://c/x", "http://c/x", 404, "b"), (3, 2, "http://c/x?page=2", "http://c/x?page=2", 200, "b"), (4, 1, "http://d/x", "http://d/x", 200, "b"), (4, 2, "http://d/x?page=2", "http://d/x?page=2", 500, "b"),
    (5, 1, "http://e/a%20b", "http://e/a%20b", 200, "b"), (5, 2, "http://e/a%20b?page=2", "http://e/a%20b?page=2", 200, "b"), (5, 3, "http://e/a%20b?page=3", "http://e/a%20b?page=3/", 200, "b"), (5, 4, "http://e/a%20b?page=4", "http://e/a%20b", 200, "b"),
]
HREF_CASES = ["/watch?v=1", "/about", "https://y/watch/2", "", "watch"]
ITEM_CASES = [("1", "first", "http://o/1", ""), ("2", "second", "http://o/2", "http://c/2"), ("3", "third", "http://o/3", None)]


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    return rows.select("page_id", "url", "hostname", "path", "query", "protocol", F.array_join("split_path", "|").alias("segments"), "path_params")


def url_decode_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URL_CASES)], "id long, raw string")
    url = urls.normalise(F.col("raw"))
    return rows.select("id", url.alias("url"), urls.parts(url).alias("p")).select("id", "url", "p.hostname", "p.path", "p.query", "p.protocol", "p.path_params")


def url_equality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    return rows.groupBy("hostname", "path").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


def url_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    return order.ranked(rows.select("page_id", "hostname", "path"), "hostname", "path", "page_id").withColumnRenamed("rank", "place")


def page_url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pagination.page_urls(catalogs.page_parts(snapshot(spark, sf_dir)).select("page_id", "url", "query"))
    return rows.select("page_id", F.col("page_no").cast("long").alias("page_no"), "page_url")


def pagination_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RESPONSE_CASES, "catalog_id long, page_no int, request_url string, final_url string, status int, body string")
    return pagination.until_end(rows).select("catalog_id", F.col("page_no").cast("long").alias("page_no"), "request_url")


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract(snapshot(spark, sf_dir).select("page_id", "html")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.nav_catalogs(snapshot(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "hostname", "path", "query", "protocol", "path_params")


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = catalogs.site_catalogs(snapshot(spark, sf_dir))
    return rows, catalogs.first_targets(rows)


def _nav(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(catalogs.nav_catalogs(snapshot(spark, sf_dir)), "links")  # pages are parsed once
    return rows, catalogs.first_targets(rows)


def similarity_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.scored(*_site(spark, sf_dir)).select(F.col("catalog_id").alias("hostname"), "page_id", "score")


def similarity_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.scored(*_nav(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), "score")


def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.scored(*_site(spark, sf_dir)).groupBy(F.col("catalog_id").alias("hostname"))
    return rows.agg(
        F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.countDistinct("score").alias("n_scores"), F.round(F.stddev_pop("score"), 6).alias("deviation"),
    )


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.z_scores(select.scored(*_site(spark, sf_dir)))
    return rows.select(F.col("catalog_id").alias("hostname"), "page_id", F.round("z", 6).alias("z"))


def filter_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_links(select.scored(*_site(spark, sf_dir))).select(F.col("catalog_id").alias("hostname"), "page_id", "score")


def filter_above_mean_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_links(select.scored(*_nav(spark, sf_dir))).select("page_id", F.col("pos").cast("long").alias("pos"), "score")


def mask_long_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    return select.where_value(rows, F.length("path"), lambda n: n > 6).select("page_id", "path")


def mean_filter_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.batch(*_site(spark, sf_dir)).select(F.col("catalog_id").alias("hostname"), F.col("pos").alias("page_id"), "url", "score")


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.keep_last(catalogs.host_nav_catalogs(snapshot(spark, sf_dir)))
    return rows.select(F.col("catalog_id").alias("hostname"), "url", "path", "page_id", F.col("pos").cast("long").alias("pos"))


def path_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    return rows.select("page_id", F.array_join(urls.digits(urls.numbers(F.col("path_params"))), ",").alias("numbers"))


def numbering_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.directions(catalogs.site_catalogs(snapshot(spark, sf_dir)))
    return rows.select(F.col("catalog_id").alias("hostname"), F.col("forward").cast("long").alias("forward"), F.col("backward").cast("long").alias("backward"), "ascending")


def get_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.get_links(*_site(spark, sf_dir)).withColumnRenamed("catalog_id", "hostname")


def youtube_watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "".join(f'<a href="{h}">x</a>' for h in HREF_CASES)
    return links.extract(spark.createDataFrame([(1, html)], "page_id long, html string"), title="YouTube").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot as if it were fetched: each host a listing of its pages, some not found, some led elsewhere; and its first and last address as a pair."""
    rows = catalogs.page_parts(snapshot(spark, sf_dir))
    first = rows.groupBy(F.col("hostname").alias("catalog_id")).agg(F.min_by("url", "page_id").alias("source_url"), F.max_by("url", "page_id").alias("target_url"), F.min_by("query", "page_id").alias("source_query"))
    numbered = order.ranked(rows.select("page_id", F.col("hostname").alias("catalog_id"), "html"), "catalog_id", "page_id").withColumnRenamed("rank", "page_no")
    later = urls.page_url(F.col("source_url"), F.col("source_query"), F.col("page_no"))
    asked = select.by_catalog(numbered, first).withColumn("request_url", F.when(F.col("page_no") == 1, F.col("source_url")).otherwise(later))
    final = F.when(F.col("page_id") % 13 == 5, F.col("source_url")).otherwise(F.concat("request_url", F.lit("/")))
    status = F.when(F.col("page_id") % 11 == 7, 404).otherwise(200)
    return asked.select("catalog_id", "page_no", "request_url", final.alias("final_url"), status.alias("status"), F.col("html").alias("body")), first.drop("source_query")


def whole_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.whole_listings(*_answers(spark, sf_dir)).withColumnRenamed("catalog_id", "hostname")


def batch_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogs.batch_of_pairs(*_answers(spark, sf_dir))
    return rows.select(F.col("catalog_id").alias("hostname"), "page_no", F.col("pos").cast("long").alias("pos"), "url", "score")


def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pairs, with what their catalogs start from: host, address of the second page, segments and numbers of the target, and how similar both are."""
    part = lambda c: urls.parts(urls.normalise(F.col(c)))
    rows = pairs(spark).withColumns({"source": part("source_url"), "target": part("target_url")})
    second = urls.page_url(urls.normalise(F.col("source_url")), F.col("source.query"), F.lit(2))
    numbers = F.array_join(urls.digits(urls.numbers(F.col("target.path_params"))), ",")
    return rows.select("catalog_id", "source.hostname", second.alias("second_page"), F.size("target.split_path").cast("long").alias("segments"), numbers.alias("numbers"), similarity(F.col("target.split_path"), F.col("source.split_path")).alias("score"))


def paragraph_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_content(snapshot(spark, sf_dir)).select("page_id", "paragraphs")


def content_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_content(snapshot(spark, sf_dir)).select("page_id", "has_content")


def content_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages as if they were not found, or an error, and some without a text."""
    k = F.col("page_id") % 5
    pages = snapshot(spark, sf_dir).select("page_id", F.when(k == 1, 404).when(k == 2, 500).otherwise(200).alias("status"), F.when(k != 3, F.col("html")).alias("html"))
    return content.page_content(pages).select("page_id", "paragraphs", "has_content")


def paragraph_count_toplevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_content(snapshot(spark, sf_dir), how="toplevel").select("page_id", "paragraphs", "has_content")


def _items(spark: SparkSession) -> DataFrame:
    import json

    good = json.dumps({"success": True, "data": [dict(zip(("_id", "name", "originUrl", "currUrl"), x, strict=True)) for x in ITEM_CASES]})
    bad = json.dumps({"success": False, "data": [{"_id": "9", "name": "no"}]})
    return item_source.from_answers(spark.createDataFrame([(good,), (bad,)], "body string"))


def item_curr_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark).select(F.col("_id").alias("item_id"), urls.current_url(F.col("currUrl"), F.col("originUrl")).alias("curr_url"))


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_source.names(_items(spark))


def item_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they are added and listed again: those that are valid, with the answers that create them."""
    path = scratch(spark, "items")
    rows = snapshot(spark, sf_dir).select(F.col("page_id").cast("string").alias("_id"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.regexp_extract("url", "/([^/?#]*)[^/]*$", 1)).alias("name"), F.col("url").alias("originUrl"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/9"))).otherwise("").alias("currUrl"))
    item_source.append(rows, path)
    stored = item_source.read(spark, path)
    return stored.select(F.col("_id").alias("item_id"), "name", F.col("originUrl").alias("origin_url"), F.col("currUrl").alias("curr_url"), F.get_json_object(item_source.to_answer(stored), "$.currUrl").alias("answer_url"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        get_links, scan_pages, url_parts, url_decode_once, url_equality_groups, url_path_order, page_url_variants, pagination_prefix, extract_links,
        resolve_links, similarity_site, similarity_nav, score_stats, z_scores, filter_above_mean, filter_above_mean_nav, mask_long_paths, mean_filter_80,
        dedup_keep_last, path_numbers, numbering_direction, youtube_watch_filter, paragraph_count, content_present, paragraph_count_toplevel, item_curr_url, item_names,
        whole_listing, batch_of_pairs, example_pairs, content_by_status, item_create,
    )
}


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


_URL = urls.URL


def _parts(source: str) -> str:
    """SQL: the columns of source (which has url) and its components."""
    return f"""(SELECT *, path || '?' || query AS path_params, list_filter(string_split(path, '/'), lambda s: s <> '') AS split_path FROM (
        SELECT *, nullif(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[^:]*$', '')), '') AS hostname,
            CASE WHEN protocol IN ('', 'http', 'https', 'ftp') THEN regexp_replace(path_0, ';[^/]*$', '') ELSE path_0 END AS path
        FROM (SELECT *, lower(regexp_extract(url, '{_URL}', 1)) AS protocol, regexp_extract(url, '{_URL}', 2) AS authority,
                regexp_extract(url, '{_URL}', 3) AS path_0, regexp_extract(url, '{_URL}', 4) AS query FROM {source})))"""


_PAGES = "pg AS (SELECT page_id, html, rtrim(url_decode(url), '/') AS url FROM pages), pp AS (SELECT * FROM " + _parts("pg") + ")"
_SITE = f"""{_PAGES},
    site_l AS (SELECT hostname AS catalog_id, 1 AS page_no, page_id AS pos, page_id, url, hostname, path, split_path, path_params FROM pp),
    site_t AS (SELECT catalog_id, arg_min(split_path, pos) AS target_path FROM site_l GROUP BY catalog_id)"""
_HREF = r"""regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?i)<a(?:\s[^>]*?)?\shref\s*=\s*"([^"]*)"', 1)"""
_ANCHORS = f"an AS (SELECT page_id, hostname AS page_host, protocol AS page_protocol, unnest({_HREF}) AS raw, unnest(range(0, len({_HREF}))) AS pos FROM pp)"
_UNESCAPE = "replace(replace(replace(replace(replace(raw, '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_HREFS = f"{_PAGES}, {_ANCHORS}, hr AS (SELECT page_id, pos, page_host, page_protocol, {_UNESCAPE} AS href, rtrim(url_decode({_UNESCAPE}), '/') AS url FROM an WHERE raw <> '')"


def _resolved(source: str) -> str:
    return f"""(SELECT * REPLACE (CASE WHEN protocol = '' THEN page_protocol || '://' || href WHEN hostname IS NULL THEN page_host || href ELSE url END AS url,
        coalesce(hostname, page_host) AS hostname, CASE WHEN protocol = '' THEN page_protocol ELSE protocol END AS protocol) FROM {_parts(source)})"""


_NAV = f"""{_HREFS}, nl AS (SELECT * FROM {_resolved("hr")}),
    nav_l AS (SELECT page_id AS catalog_id, 1 AS page_no, pos, page_id, url, hostname, path, split_path, path_params, query, protocol FROM nl),
    nav_t AS (SELECT catalog_id, arg_min(split_path, pos) AS target_path FROM nav_l GROUP BY catalog_id)"""


def _scored(name: str) -> str:
    return f"""{name}_s AS (SELECT l.*, CAST(coalesce(list_sum(list_transform(range(0, least(len(target_path), len(split_path))), lambda p:
            (least(len(target_path), len(split_path)) - p) * list_transform([len(list_filter(range(1, least(length(target_path[p + 1]), length(split_path[p + 1])) + 1),
                lambda c: left(target_path[p + 1], c) = left(split_path[p + 1], c)))], lambda k: k * least(length(target_path[p + 1]), length(split_path[p + 1])) - k * (k - 1) // 2)[1])), 0) AS BIGINT) AS score
        FROM {name}_l l JOIN {name}_t t ON l.catalog_id = t.catalog_id)"""


def _filtered(name: str) -> str:
    return f"""{name}_f AS (SELECT * FROM (SELECT *, min(score) OVER (PARTITION BY catalog_id) = max(score) OVER (PARTITION BY catalog_id) AS flat,
            score * count(*) OVER (PARTITION BY catalog_id) > sum(score) OVER (PARTITION BY catalog_id) AS above FROM {name}_s) WHERE flat OR above
        QUALIFY flat OR row_number() OVER (PARTITION BY catalog_id, url, hostname, path ORDER BY page_no DESC, pos DESC) = 1)"""


def _directions(source: str) -> str:
    """SQL (recursive): dir has catalog_id, forward, backward."""
    step = """list_transform(range(0, m + 1), lambda k: CASE WHEN k >= greatest(len(list_filter(x[i + 1], lambda e: e <= x[i][1])) - 1, 0) AND k < len(x[i + 1])
            THEN 1 + dp[len(list_filter(x[i], lambda e: e <= x[i + 1][k + 1])) + 1] ELSE 0 END)"""
    return f"""nums AS (SELECT catalog_id, page_no, pos, list_sort(list_distinct(list_transform(regexp_extract_all(path_params, '([0-9]+)[^0-9]', 1), lambda v: CAST(v AS HUGEINT)))) AS n FROM {source}),
    seqs AS (SELECT catalog_id, list(n ORDER BY page_no, pos) AS x, max(len(n)) AS m FROM nums WHERE len(n) > 0 GROUP BY catalog_id),
    both_ways AS (SELECT catalog_id, 1 AS way, x, m FROM seqs UNION ALL SELECT catalog_id, 2, list_reverse(x), m FROM seqs),
    walk AS (SELECT catalog_id, way, x, m, CAST(1 AS BIGINT) AS i, list_transform(range(0, m + 1), lambda k: CAST(0 AS BIGINT)) AS dp FROM both_ways
        UNION ALL SELECT catalog_id, way, x, m, i + 1, {step} FROM walk WHERE i < len(x)),
    ends AS (SELECT catalog_id, way, CASE WHEN len(x) < 2 THEN 0 ELSE list_max(dp) END AS v FROM walk WHERE i = len(x)),
    dir AS (SELECT catalog_id, CAST(max(v) FILTER (way = 1) AS BIGINT) AS forward, CAST(max(v) FILTER (way = 2) AS BIGINT) AS backward FROM ends GROUP BY catalog_id)"""


_ANSWERS = f"""{_PAGES},
    fa AS (SELECT hostname, arg_min(url, page_id) AS source_url, arg_max(url, page_id) AS target_url, arg_min(query, page_id) AS source_query FROM pp GROUP BY hostname),
    na AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY page_id) AS page_no FROM pp),
    ra AS (SELECT page_id, hostname, page_no, html, source_url, CASE WHEN page_no = 1 THEN source_url ELSE source_url || CASE WHEN source_query = '' THEN '?' ELSE '&' END || 'page=' || page_no END AS request_url FROM na JOIN fa USING (hostname)),
    ea AS (SELECT *, max(CASE WHEN page_id % 11 = 7 OR coalesce(html, '') = '' OR page_no <> 1 AND rtrim(url_decode(request_url), '/') <> rtrim(url_decode(CASE WHEN page_id % 13 = 5 THEN source_url ELSE request_url || '/' END), '/') THEN 1 ELSE 0 END)
        OVER (PARTITION BY hostname ORDER BY page_no) AS ended FROM ra),
    su AS (SELECT hostname, source_url AS url FROM fa), sp AS (SELECT * FROM """ + _parts("(SELECT hostname AS catalog_id, url FROM su)") + f"""),
    tu AS (SELECT hostname AS catalog_id, target_url AS url FROM fa), whole_t AS (SELECT catalog_id, split_path AS target_path FROM """ + _parts("tu") + f"""),
    xa AS (SELECT e.hostname AS catalog_id, e.page_no, sp.hostname AS page_host, sp.protocol AS page_protocol, unnest({_HREF}) AS raw, unnest(range(0, len({_HREF}))) AS pos FROM ea e JOIN sp ON sp.catalog_id = e.hostname WHERE ended = 0 AND page_no <= 19),
    ha AS (SELECT catalog_id, page_no, pos, page_host, page_protocol, {_UNESCAPE} AS href, rtrim(url_decode({_UNESCAPE}), '/') AS url FROM xa WHERE raw <> ''),
    whole_l AS (SELECT catalog_id, page_no, pos, url, hostname, path, split_path, path_params FROM {_resolved("ha")})"""

_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
_P = rf"CAST(len(regexp_extract_all({_VISIBLE}, '(?i)<p(?:\s[^>]*)?/?>')) AS BIGINT)"

#: Tags of paragraphs as numbers (0 begins, 1 ends, 2 does both), walked with depth * 1000000 + found.
_TOPLEVEL = rf"""CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regexp_extract_all({_VISIBLE}, '(?i)</?p(?:\s[^>]*)?/?>'), lambda t: CAST(CASE WHEN starts_with(t, '</') THEN 1 WHEN ends_with(t, '/>') THEN 2 ELSE 0 END AS BIGINT))),
    lambda a, c: CASE WHEN c = 1 THEN CASE WHEN a >= 1000000 THEN a - 1000000 ELSE a END ELSE a + CASE WHEN a < 1000000 THEN 1 ELSE 0 END + CASE WHEN c = 0 THEN 1000000 ELSE 0 END END) % 1000000 AS BIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "paragraph_count_toplevel": f"SELECT page_id, {_TOPLEVEL} AS paragraphs, {_TOPLEVEL} >= 30 AS has_content FROM pages",
    "scan_pages": "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages",
    "url_parts": f"WITH {_PAGES} SELECT page_id, url, hostname, path, query, protocol, array_to_string(split_path, '|') AS segments, path_params FROM pp",
    "url_decode_once": f"""WITH v AS (SELECT id, rtrim(url_decode(raw), '/') AS url FROM (VALUES {_values(enumerate(URL_CASES))}) AS v(id, raw))
        SELECT CAST(id AS BIGINT) AS id, url, hostname, path, query, protocol, path_params FROM {_parts("v")}""",
    "url_equality_groups": f"WITH {_PAGES} SELECT hostname, path, count(*) AS n, min(page_id) AS first_page FROM pp GROUP BY hostname, path HAVING count(*) > 1",
    "url_path_order": f"WITH {_PAGES} SELECT page_id, hostname, path, row_number() OVER (PARTITION BY hostname ORDER BY path, page_id) AS place FROM pp",
    "page_url_variants": f"""WITH {_PAGES} SELECT page_id, n AS page_no, CASE WHEN n = 1 THEN url WHEN query = '' THEN url || '?page=' || n ELSE url || '&page=' || n END AS page_url
        FROM pp, (SELECT unnest(range(1, 20)) AS n)""",
    "pagination_prefix": f"""SELECT catalog_id, page_no, request_url FROM (SELECT *, max(CASE WHEN status <> 200 OR body = '' OR page_no <> 1 AND rtrim(url_decode(request_url), '/') <> rtrim(url_decode(final_url), '/') THEN 1 ELSE 0 END)
            OVER (PARTITION BY catalog_id ORDER BY page_no) AS ended
        FROM (SELECT CAST(catalog_id AS BIGINT) AS catalog_id, CAST(page_no AS BIGINT) AS page_no, request_url, final_url, status, body FROM (VALUES {_values(RESPONSE_CASES)}) AS v(catalog_id, page_no, request_url, final_url, status, body))) WHERE ended = 0""",
    "extract_links": f"WITH {_HREFS} SELECT page_id, pos, href FROM hr",
    "resolve_links": f"WITH {_NAV} SELECT page_id, pos, url, hostname, path, query, protocol, path_params FROM nav_l",
    "similarity_site": f"WITH {_SITE}, {_scored('site')} SELECT catalog_id AS hostname, page_id, score FROM site_s",
    "similarity_nav": f"WITH {_NAV}, {_scored('nav')} SELECT page_id, pos, score FROM nav_s",
    "score_stats": f"""WITH {_SITE}, {_scored('site')} SELECT catalog_id AS hostname, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, min(score) AS least, max(score) AS most,
        count(DISTINCT score) AS n_scores, round(stddev_pop(score), 6) AS deviation FROM site_s GROUP BY catalog_id""",
    "z_scores": f"""WITH {_SITE}, {_scored('site')} SELECT catalog_id AS hostname, page_id,
        round((score - avg(score) OVER (PARTITION BY catalog_id)) / nullif(stddev_pop(score) OVER (PARTITION BY catalog_id), 0), 6) AS z FROM site_s""",
    "filter_above_mean": f"WITH {_SITE}, {_scored('site')}, {_filtered('site')} SELECT catalog_id AS hostname, page_id, score FROM site_f",
    "filter_above_mean_nav": f"WITH {_NAV}, {_scored('nav')}, {_filtered('nav')} SELECT page_id, pos, score FROM nav_f",
    "mask_long_paths": f"WITH {_PAGES} SELECT page_id, path FROM pp WHERE length(path) > 6",
    "mean_filter_80": f"""WITH {_SITE}, {_scored('site')}, {_filtered('site')} SELECT catalog_id AS hostname, page_id, url, score FROM site_f
        QUALIFY 5 * score * count(*) OVER (PARTITION BY catalog_id) > 4 * sum(score) OVER (PARTITION BY catalog_id)""",
    "dedup_keep_last": f"""WITH {_HREFS}, fp AS (SELECT hostname AS page_host, arg_min(protocol, page_id) AS page_protocol FROM pp GROUP BY hostname),
        h2 AS (SELECT hr.page_id, hr.pos, hr.page_host, fp.page_protocol, hr.href, hr.url FROM hr JOIN fp USING (page_host))
        SELECT page_host AS hostname, url, path, page_id, pos FROM {_resolved("h2")} AS r(page_id, pos, page_host, page_protocol, href, url, protocol, authority, path_0, query, own_host, path, path_params, split_path)
        QUALIFY row_number() OVER (PARTITION BY page_host, url, own_host, path ORDER BY page_id DESC, pos DESC) = 1""",
    "path_numbers": f"""WITH {_PAGES} SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(path_params, '([0-9]+)[^0-9]', 1), lambda v: CAST(v AS HUGEINT)))), ',') AS numbers FROM pp""",
    "numbering_direction": f"WITH RECURSIVE {_SITE}, {_directions('site_l')} SELECT catalog_id AS hostname, forward, backward, forward > backward AS ascending FROM dir",
    "get_links": f"""WITH RECURSIVE {_SITE}, {_scored('site')}, {_filtered('site')}, {_directions('site_f')}
        SELECT f.catalog_id AS hostname, row_number() OVER (PARTITION BY f.catalog_id ORDER BY CASE WHEN coalesce(forward > backward, false) THEN pos ELSE -pos END) AS rank, url, score
        FROM site_f f LEFT JOIN dir d ON f.catalog_id = d.catalog_id""",
    "youtube_watch_filter": f"SELECT CAST(1 AS BIGINT) AS page_id, CAST(pos AS BIGINT) AS pos, href FROM (VALUES {_values(enumerate(HREF_CASES))}) AS v(pos, href) WHERE contains(href, 'watch')",
    "whole_listing": f"""WITH RECURSIVE {_ANSWERS}, {_scored('whole')}, {_filtered('whole')}, {_directions('whole_f')}
        SELECT f.catalog_id AS hostname, row_number() OVER (PARTITION BY f.catalog_id ORDER BY CASE WHEN coalesce(forward > backward, false) THEN page_no ELSE -page_no END, CASE WHEN coalesce(forward > backward, false) THEN pos ELSE -pos END) AS rank, url, score
        FROM whole_f f LEFT JOIN dir d ON f.catalog_id = d.catalog_id""",
    "batch_of_pairs": f"""WITH {_ANSWERS}, {_scored('whole')}, {_filtered('whole')} SELECT catalog_id AS hostname, page_no, pos, url, score FROM whole_f
        QUALIFY 5 * score * count(*) OVER (PARTITION BY catalog_id) > 4 * sum(score) OVER (PARTITION BY catalog_id)""",
    "example_pairs": f"""WITH g AS (SELECT CAST(i AS BIGINT) AS catalog_id, s, t FROM (VALUES {_values((i, *r) for i, r in enumerate(EXAMPLE_PAIRS))}) AS v(i, s, t)),
        gs AS (SELECT catalog_id, rtrim(url_decode(s), '/') AS url FROM g), gt AS (SELECT catalog_id, rtrim(url_decode(t), '/') AS url FROM g),
        ex_l AS (SELECT catalog_id, url, hostname, query, split_path FROM {_parts("gs")}), ex_p AS (SELECT * FROM {_parts("gt")}), ex_t AS (SELECT catalog_id, split_path AS target_path FROM ex_p), {_scored('ex')}
        SELECT x.catalog_id, x.hostname, x.url || CASE WHEN x.query = '' THEN '?' ELSE '&' END || 'page=2' AS second_page, CAST(len(p.split_path) AS BIGINT) AS segments,
            array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p.path_params, '([0-9]+)[^0-9]', 1), lambda v: CAST(v AS HUGEINT)))), ',') AS numbers, score
        FROM ex_s x JOIN ex_p p ON x.catalog_id = p.catalog_id""",
    "content_by_status": f"""SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 0 ELSE {_P} END AS paragraphs, page_id % 5 NOT IN (1, 3) AND {_P} >= 30 AS has_content FROM pages""",
    "item_create": """SELECT CAST(page_id AS VARCHAR) AS item_id, name, url AS origin_url, curr AS curr_url, curr AS answer_url
        FROM (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '' ELSE regexp_extract(url, '/([^/?#]*)[^/]*$', 1) END AS name, CASE WHEN page_id % 3 = 0 THEN url || '/9' ELSE url END AS curr FROM pages) WHERE name <> '' AND url <> ''""",
    "paragraph_count": f"SELECT page_id, {_P} AS paragraphs FROM pages",
    "content_present": f"SELECT page_id, {_P} >= 30 AS has_content FROM pages",
    "item_curr_url": f"SELECT item_id, coalesce(nullif(curr, ''), origin) AS curr_url FROM (VALUES {_values(ITEM_CASES)}) AS v(item_id, name, origin, curr)",
    "item_names": f"SELECT name FROM (VALUES {_values(ITEM_CASES)}) AS v(item_id, name, origin, curr)",
}
