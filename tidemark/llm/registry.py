"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents")).drop("rejected_by")  # which of several rules rejects first depends on the order


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), **_ROOMY)


#: Where encoding is all that a worker does, it may hold more.
_ROOMY = {"slice_bytes": 8_000_000, "memory": 300_000}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, summary

    return summary(find_secrets(_table(spark, sf_dir, "documents")))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    return read_warc(write_warc(_table(spark, sf_dir, "pages"))).drop("url", "record_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), **_ROOMY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_ngram_jaccard_join, op4_quality_rules, op5_best_fit_packing, op6_benchmark_decontamination, op7_suffix_array_dedup, op8_secret_scan, op9_warc_archive, op10_token_files)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\x0B\x0C]+', ' ', 'g')) AS form FROM l),
        u AS (SELECT form, length(form) AS n, min((doc_id, i)) AS first_place FROM f WHERE form <> '' GROUP BY form),
        k AS (SELECT *, n AS b FROM u WHERE n >= 20 UNION ALL SELECT *, n - 1 AS b FROM u WHERE n >= 20),
        c AS (SELECT x.form AS a, y.form AS o FROM k x JOIN k y ON x.b = y.b AND left(x.form, (x.b - 1) // 2) = left(y.form, (y.b - 1) // 2) AND y.first_place < x.first_place
              UNION SELECT x.form, y.form FROM k x JOIN k y ON x.b = y.b AND right(x.form, (x.b - 1) // 2) = right(y.form, (y.b - 1) // 2) AND y.first_place < x.first_place),
        g AS (SELECT DISTINCT a AS form FROM c WHERE abs(length(a) - length(o)) <= 1 AND levenshtein(a, o) <= 1),
        r AS (SELECT f.*, form <> '' AND ((doc_id, i) <> first_place OR g.form IS NOT NULL) AS gone FROM f LEFT JOIN u USING (form) LEFT JOIN g USING (form))
        SELECT d.doc_id, CAST(count(r.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (r.gone) AS BIGINT) AS n_removed,
            CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (NOT coalesce(r.gone, false)), '') END AS text
        FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, d.text""",
    "op3_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
        e AS (SELECT doc_id, len(g) AS m, unnest(g) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.m) AS ma, any_value(b.m) AS mb, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * n >= 75 * (ma + mb - n)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a)
        SELECT x AS doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(y) AS component_id FROM reach JOIN s ON s.doc_id = x GROUP BY x""",
    "op4_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        g AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM w)),
        r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
            SELECT doc_id, unnest(range(s, s + 8)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
        c AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
                length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
                length(regexp_replace(text, '[^!?]', '', 'g')) AS n_loud, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
                len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter
            FROM w LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND 5 * n_symbols <= 2 * n_words AND 10 * n_dup_lines <= 3 * n_lines AND word_chars BETWEEN 2 * n_words AND 15 * n_words
            AND 2 * n_upper <= n_letters AND 2 * n_loud <= n_words AND 2 * n_digits <= word_chars AND 10 * n_stutter <= 3 * n_words AS kept
        FROM b""",
    "op6_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        k AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
        g AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM k)),
        p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g))),
        m AS (SELECT doc_id, item_id, n, s FROM p JOIN g USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id),
        o AS (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
        f AS (SELECT term, count(*) AS n FROM o GROUP BY term),
        t AS (SELECT DISTINCT item_id, w, least(len(list_distinct(w)), 3) AS needs, unnest(list_distinct(w)) AS term FROM b WHERE item_id IS NOT NULL),
        c AS (SELECT * FROM t JOIN f USING (term) QUALIFY row_number() OVER (PARTITION BY item_id, w ORDER BY n, term) <= 3),
        q AS (SELECT doc_id, item_id, needs, count(DISTINCT term) OVER (PARTITION BY doc_id, item_id, w ORDER BY p RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS seen FROM o JOIN c USING (term)),
        v AS (SELECT doc_id, count(*) AS n_near, string_agg(t, ',' ORDER BY t) AS near FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM q WHERE seen >= needs) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN v USING (doc_id)""",
    "op7_suffix_array_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM w)),
        r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
        m AS (SELECT *, CASE WHEN s <= max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
        t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m)
        SELECT doc_id, min(s) AS start, max(s) + 50 AS stop, max(s) + 50 - min(s) AS n_words FROM t GROUP BY doc_id, run""",
}
