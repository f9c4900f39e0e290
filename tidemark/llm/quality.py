"""Quality rules as a short-circuit cascade, cheapest rejection first.

Only DataFrame functions. Each rule says of a document, from its text or the counts of `counts`, whether it is kept.
On a sample of documents each rule's cost is measured, with the counts that it reads and without what a job costs that
does nothing, and which rules reject which documents. The first rule is the one with most rejections per second; the
next one that with most per second among the documents that are left, and so on. A document is tested by a rule only
if all before kept it. The order changes the cost, not the verdict, as a document is kept if all rules keep it.

Counts of whole texts (words are runs outside 0x20 and 0x09-0x0D): n_words; word_chars, code points in words; n_symbols,
characters of #*$%&|<>; n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in windows of
8 words that the text has twice or more. base_failed: fewer than 20 words, or more than 30 % of words repeated.

Defined results: a null text counts as empty; an empty text has no words, so it fails; repeated rows are rows of their
own, also without an id (the sample has each of them once); other columns are ignored by `judge` and kept by
`filter_documents`; with an empty table the rules keep the order in which they are given.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, materialize

#: Words in a window of n_repeat_words.
REPEAT_WINDOW = 8
#: Documents of the sample on which the rules are measured, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2_000, 16_000_000
#: How often a job tests each document of the sample, and how often it is timed.
TIMES, RUNS = 4, 3
#: Files of the sample, at most, whatever the number of shuffle partitions: an executor starts processes for each file it writes.
SAMPLE_FILES = 8
_SPACES = " \t\n\x0b\x0c\r"

Rule = tuple[str, Callable[[], Column]]


def _count(characters: str) -> Column:
    """How many characters of the text are in a class. (Replacing is many times faster than counting matches.)"""
    return F.length("text") - F.length(F.regexp_replace("text", characters + "+", ""))


#: (name, keeps). All are comparisons of whole numbers.
RULES: list[Rule] = [
    ("symbols", lambda: F.col("n_symbols") * 5 <= F.col("n_words") * 2),
    ("duplicate lines", lambda: F.col("n_dup_lines") * 10 <= F.size(F.split("text", "\n", -1)) * 3),
    ("word length", lambda: F.col("word_chars").between(F.col("n_words") * 2, F.col("n_words") * 15)),
    ("capitals", lambda: _count(r"\p{Lu}") * 2 <= _count(r"\p{L}")),
    ("exclamations", lambda: _count("[!?]") * 2 <= F.col("n_words")),
    ("digits", lambda: _count("[0-9]") * 2 <= F.col("word_chars")),
    ("stutter", lambda: F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))) * 10 <= F.col("n_words") * 3),
]


def _repeated(hashes: Column) -> Column:
    """Words that windows cover whose hash occurs twice or more; a window begins at each place of the array."""
    k = REPEAT_WINDOW

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(k), x - a["last"])).alias("total")), lambda a: a["total"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.get(F.transform(F.array(ordered), covered), 0))


def _words(docs: DataFrame) -> DataFrame:
    """docs with text (null as empty), words and n_words."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")).withColumn("n_words", F.size("words").cast("long"))


def _counted(docs: DataFrame) -> DataFrame:
    """docs (of _words) with the counts that are not words."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(_SPACES)) != "")
    docs = docs.withColumn("lines", lines)
    return docs.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": _count("[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")


def counts(docs: DataFrame) -> DataFrame:
    """docs with text (null as empty), words and the counts added."""
    k = REPEAT_WINDOW
    docs = _words(docs).withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*(F.get("codes", i + j) for j in range(k)))
    docs = docs.withColumn("windows", F.when(F.size("codes") < k, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("codes") - k), window)))
    return _counted(docs.withColumn("n_repeat_words", _repeated(F.col("windows")).cast("long")).drop("codes", "windows"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def measure(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> tuple[dict[str, float], dict[tuple[str, ...], int]]:
    """Seconds of each rule on the sample, and how many of its documents exactly these rules reject."""
    few = bounded_texts(docs.select("doc_id", "text"), sample, SAMPLE_BYTES, "text", "doc_id", "text").coalesce(SAMPLE_FILES)
    part = materialize(_words(few).select("text", "words", "n_words"), "sample")
    names = F.filter(F.array(*(F.when(~keeps(), F.lit(name)) for name, keeps in rules)), lambda x: x.isNotNull())
    rejected = {tuple(r["names"]): r["count"] for r in _counted(part).select(names.alias("names")).groupBy("names").count().collect()}  # a row for each set of rules
    again = part.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(keeps: Column) -> float:
        job, took = _counted(again).agg(F.count_if(~keeps).alias("n")), []
        for _ in range(RUNS):  # the first run compiles
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds((F.length("text") >= 0) & (F.size("words") >= 0) & (F.col("n_words") >= 0))
    return {name: max(1e-4, seconds(keeps()) - nothing) for name, keeps in rules}, rejected


def ordered(seconds: dict[str, float], rejected: dict[tuple[str, ...], int]) -> list[str]:
    """Rule names by rejections per second, each among the documents that all before keep; the cheaper one of equals."""
    order, left = [], dict(rejected)
    while len(order) < len(seconds):
        found = {name: sum(n for names, n in left.items() if name in names) for name in seconds if name not in order}
        order.append(max(found, key=lambda name: (found[name] / seconds[name], -seconds[name])))
        left = {names: n for names, n in left.items() if order[-1] not in names}
    return order


def verdict(order: list[str], rules: list[Rule] = RULES) -> Column:
    """The first rule that rejects, or null."""
    by_name = dict(rules)
    out = F.when(base_failed(), F.lit("base"))
    for name in order:
        out = out.when(~by_name[name](), F.lit(name))
    return out


def judge(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by of every document."""
    order = ordered(*measure(docs, rules, sample))
    rows = counts(docs.select("doc_id", "text")).withColumn("rejected_by", verdict(order, rules))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def filter_documents(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The documents that all rules keep, all their columns unchanged."""
    order = ordered(*measure(docs, rules, sample))
    names = docs.columns
    whole = F.struct(*(F.col(c) for c in names)).alias("row")
    return counts(docs.select(whole, F.col("text"))).where(verdict(order, rules).isNull()).select("row.*")
