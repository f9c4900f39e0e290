"""Passages of a benchmark in training documents, by a distributed positional inverted index.

Only DataFrame functions. The index has the postings (term, document, position) of those training tokens that a search
begins with. Each window of an item starts from its two rarest terms, by their counts in the whole corpus: their lists
are taken from the index, moved back by the term's place in the item, and intersected, so that what remains are
alignments of an item with a document. At those alignments the words are compared, which gives the exact matches of
every window; a window with a term that the corpus lacks is not searched.

The same index answers proximity searches: an item is near in a document where its NEAR rarest terms, of those that the
corpus has, stand within SPAN words of each other in any order. An item of fewer different terms needs all of them, and
one of which the corpus has fewer terms than it needs is near nowhere.

Words are runs of 0-9, a-z and characters beyond 0x7F, after A-Z became a-z. A window has `window` consecutive words of
an item; an item of fewer words is one window.

Defined results: a null or empty text has no words and no hits; items without words match nothing; repeated items
count once, different texts under one item_id are searched for each under that id, and items without an id are not
searched for. Every row is a document of its own, also rows that share a doc_id or have none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .copies import keyed, named

WINDOW = 10
#: Terms of a window that the search starts from.
RAREST = 2
#: Terms of an item that proximity needs, and words within which they stand.
NEAR, SPAN = 3, 30
#: Tables of the benchmark's terms, and of alignments, are broadcast up to so many rows; beyond, the other side is shuffled.
BROADCAST_TERMS, BROADCAST_ALIGNMENTS = 1_000_000, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: str) -> Column:
    """The words as they stand, A-Z included. (split is several times faster here than extracting all matches.)"""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")


def fold(word: Column) -> Column:
    """A-Z as a-z and nothing else; only words with letters of both kinds need the slow way."""
    low = F.lower(word)
    return F.when(low == word, word).when(F.octet_length(word) == F.length(word), low).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: str) -> Column:
    return F.transform(raw_words(text), fold)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (term, doc_id, pos) of the given terms in documents (doc_id, words as they stand)."""
    return docs.select("doc_id", F.posexplode("words").alias("pos", "word")).select("doc_id", "pos", fold(F.col("word")).alias("term")).join(_small(terms, BROADCAST_TERMS), "term").select("term", "doc_id", "pos")


def _search(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to search documents (doc_id, words as they stand) for, and the postings of its terms.

    (item_id, key, item, width of its windows, starts: for each window the places of its rarest terms), (item_id, key,
    term, needs: how many of the item's terms are needed), (term, doc_id, pos). The key is a hash of the item's words.
    """
    items = materialize(benchmark.where("item_id is not null").select("item_id", words("text").alias("item")).distinct().where(F.size("item") > 0), "items")
    vocabulary = items.select(F.explode("item").alias("term")).distinct()
    counts = materialize(docs.select(F.explode("words").alias("word")).select(fold(F.col("word")).alias("term")).join(_small(vocabulary, BROADCAST_TERMS), "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
    placed = items.select("item_id", "item", F.posexplode("item").alias("i", "term")).join(counts, "term", "left")
    ordered = placed.groupBy("item_id", "item").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("by_place"))
    width = F.least(F.size("item"), F.lit(window))
    rarest = F.transform(
        F.sequence(F.lit(0), F.size("item") - F.col("width")),
        lambda s: F.slice(F.array_sort(F.transform(F.slice("by_place", s + 1, F.col("width")), lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i")))), 1, RAREST),
    )
    searched = F.array_distinct(F.filter("rarest", lambda w: w[0]["n"] > 0))
    windows = materialize(ordered.withColumn("width", width).withColumn("rarest", rarest).select("item_id", F.xxhash64("item").alias("key"), "item", "width", F.transform(searched, lambda w: F.transform(w, lambda x: x["i"])).alias("starts")), "windows")

    own = items.select("item_id", F.xxhash64("item").alias("key"), F.least(F.size(F.array_distinct("item")), F.lit(NEAR)).alias("needs"), F.explode(F.array_distinct("item")).alias("term"))
    ranked = own.join(counts, "term").withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "key").orderBy("n", "term")))
    near = materialize(ranked.where(F.col("rank") <= NEAR).select("item_id", "key", "term", "needs"), "near")

    terms = _places(windows).select("term").union(near.select("term")).distinct()
    return windows, near, materialize(index(docs, terms), "postings")


def _places(windows: DataFrame) -> DataFrame:
    """(item_id, key, i, term): the terms that windows start from, with their places in the item."""
    return windows.select("item_id", "key", "item", F.explode(F.array_distinct(F.flatten("starts"))).alias("i")).select("item_id", "key", "i", F.element_at("item", F.col("i") + 1).alias("term"))


def _alignments(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, item_id, key, n words of the item, shift): where all the rarest terms of some window of the item stand as in the item."""
    met = postings.join(_places(windows), "term").groupBy("doc_id", "item_id", "key", (F.col("pos") - F.col("i")).alias("shift")).agg(F.collect_set("i").alias("seen"))
    whole = F.exists("starts", lambda w: F.forall(w, lambda i: F.array_contains("seen", i)))
    return met.join(windows.select("item_id", "key", "starts", F.size("item").alias("n")), ["item_id", "key"]).where(whole).select("doc_id", "item_id", "key", "n", "shift")


def _matches(docs: DataFrame, windows: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, item_id and the places of document words that are inside an occurrence of a window of the item."""
    found = _alignments(windows, postings)
    by_doc = materialize(found.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "key", "n", "shift")).alias("at")), "alignments")
    part = F.transform("at", lambda x: x.withField("part", F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: fold(F.get("words", x["shift"] + i)))))
    parts = docs.join(_small(by_doc, BROADCAST_ALIGNMENTS), "doc_id").select("doc_id", F.explode(part).alias("x")).select("doc_id", "x.*")
    same = F.filter(F.sequence(F.lit(0), F.size("item") - F.col("width")), lambda s: F.slice("item", s + 1, F.col("width")) == F.slice("part", s + 1, F.col("width")))
    hits = F.array_distinct(F.flatten(F.transform(same, lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("width") - 1))))
    return parts.join(windows.select("item_id", "key", "item", "width"), ["item_id", "key"]).select("doc_id", "item_id", hits.alias("hits")).where(F.size("hits") > 0)


def _near(near: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the proximity matches."""
    ahead = Window.partitionBy("doc_id", "item_id", "key").orderBy("pos").rangeBetween(0, SPAN - 1)
    return postings.join(near, "term").withColumn("seen", F.size(F.collect_set("term").over(ahead))).where(F.col("seen") >= F.col("needs")).select("doc_id", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id and hits, the places of document words that are inside an occurrence of a window of the item."""
    docs, names = keyed(docs)
    docs = docs.select("doc_id", raw_words("text").alias("words"))
    windows, _, postings = _search(docs, benchmark, window)
    return named(_matches(docs, windows, postings), names)


def near_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Proximity matches: doc_id, item_id."""
    docs, names = keyed(docs)
    _, near, postings = _search(docs.select("doc_id", raw_words("text").alias("words")), benchmark, WINDOW)
    return named(_near(near, postings), names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids of items found), contaminated, and of proximity n_near and near_sha256."""
    docs, names = keyed(docs)
    split = docs.select("doc_id", raw_words("text").alias("words"))
    windows, near, postings = _search(split, benchmark, window)
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    found = _matches(split, windows, postings).groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), ids.alias("items"))
    found = materialize(found.join(_near(near, postings).groupBy("doc_id").agg(ids.alias("close")), "doc_id", "full"), "found")
    rows = split.select("doc_id", F.size("words").cast("long").alias("n_words")).join(found, "doc_id", "left")
    n, none = F.coalesce(F.col("n_hit"), F.lit(0).cast("long")), F.array().cast("array<string>")
    items, close = F.coalesce(F.col("items"), none), F.coalesce(F.col("close"), none)
    count, digest = lambda x: F.size(x).cast("long"), lambda x: F.sha2(F.array_join(x, ","), 256)
    out = rows.select("doc_id", "n_words", n.alias("n_hit"), count(items).alias("n_items"), digest(items).alias("items_sha256"), (n > 0).alias("contaminated"), count(close).alias("n_near"), digest(close).alias("near_sha256"))
    return named(out, names)


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a window, all their columns unchanged."""
    docs, _ = keyed(docs, whole=True)
    split = docs.select("doc_id", raw_words("text").alias("words"))
    windows, _, postings = _search(split, benchmark, window)
    found = materialize(_matches(split, windows, postings).select("doc_id").distinct(), "found")
    return docs.join(_small(found, BROADCAST_TERMS), "doc_id", "left_anti").select("row.*")
