"""Repeated lines of a corpus, up to one edit, by joining deletion neighbourhoods.

A line is compared in a normal form: A-Z as a-z, runs of ASCII white space as one space, none at the ends. A line goes
when an earlier one, by (doc_id, place in the text), has the same form; the earliest stays. Every line with a form that
is not empty takes part. Forms of `least_chars` code points or more also go when an earlier one of that length is within
an edit distance of 1: in shorter ones a single character often is the meaning ("1.", "a)", "No" and "So"), so their
edit bound is 0. `exact_chars` may exclude short forms from exact repeats as well.

Two forms at distance 1 share a variant: equal forms after a deletion at the same place (a substitution), or one form
and the other after a deletion (an insertion). So each form emits itself and all its deletions, as hashes with the
place; equal ones meet. In a group, forms with the same place differ by that one character, so each needs only the
earliest of them; the form that is the variant itself is paired with each other member. Candidates are therefore as
many as the group's members, and each is verified by Spark's levenshtein.

Only forms that can have such a partner emit variants: of two forms at distance 1 the first or the last half is the
same, so each line first gives hashes of a prefix and a suffix of a length that both would choose. Lines that share
none with a different line have no partner.

Defined results: a null text stays null and has no lines; an empty text keeps its one empty line; a document all of
whose lines go keeps an empty text in dedup_lines, and is left out by filter_documents if nothing but white space is
left. Every row is a document of its own: of rows with one doc_id those with the lesser hash of the text come first,
rows without a doc_id come last. Other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lean, materialize, shuffle_width, slices
from .copies import keyed, named
from .hashing import mix

#: Code points from which a form is also compared up to one edit, and from which its exact repeats count.
LEAST_CHARS, EXACT_CHARS = 20, 1
_SPACES = " \t\n\x0b\x0c\r"
#: Lists of lines are broadcast to the documents up to so many bytes; beyond, the documents are shuffled.
BROADCAST_BYTES = 64_000_000
#: Variants that a task sorts at once, about.
BLOCK_VARIANTS = 1_000_000
_HALVES = [2]
while _HALVES[-1] < 1 << 40:
    _HALVES.append(max(_HALVES[-1] + 1, _HALVES[-1] * 3 // 2))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal_form(line: bytes) -> str:
    return b" ".join(line.lower().split()).decode("utf-8", "replace")


def _half(size: int) -> int:
    """The length of prefix or suffix that a form of this size shares with one of the same size or one more."""
    return _HALVES[max(0, bisect_right(_HALVES, (size - 1) // 2) - 1)]


def half_keys(form: str) -> set[int]:
    """Hashes of which two different forms at distance 1 have one in common."""
    import xxhash

    n = len(form)
    out = set()
    for h in {_half(n), _half(n - 1)}:
        out.add(xxhash.xxh3_64_intdigest(f"p{h} {form[:h]}"))
        out.add(xxhash.xxh3_64_intdigest(f"s{h} {form[n - h :]}"))
    return out


def variants(form: str) -> np.ndarray:
    """Hashes of the form with each place deleted in turn, then of the form itself."""
    points = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    powers, inverse = np.full(n + 1, _BASE, np.uint64), np.uint64(_INVERSE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * powers[:-1])))
    # What follows the deleted place moves one power down.
    return mix(np.append(sums[:-1] + (sums[-1] - sums[1:]) * inverse, sums[-1]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lines(docs: DataFrame, least_chars: int, exact_chars: int) -> DataFrame:
    """key, form, doc_id, line: two rows or more for each line that takes part, one for a short one."""
    least = max(1, min(exact_chars, least_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            keys, forms, ids, places = [], [], [], []
            for k, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for i, line in enumerate((text or "").encode().split(b"\n")):
                    if len(line) >= least and len(form := normal_form(line)) >= least:
                        h = _signed(xxhash.xxh3_64_intdigest(form))
                        own = half_keys(form) if len(form) >= least_chars else {xxhash.xxh3_64_intdigest(f"e {form}")}
                        keys += map(_signed, own)
                        forms += [h] * len(own)
                        ids += [k] * len(own)
                        places += [i] * len(own)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(forms, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], names=["key", "form", "doc_id", "line"])

    return docs.mapInArrow(run, "key long, form long, doc_id long, line int")


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Joins lists (doc_id, lines array<int>) to documents; broadcast only after their size is known."""
    size = lists.agg(F.coalesce(F.sum(F.size("lines") * 4 + 40), F.lit(0))).first()[0]
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "doc_id", how)


def _texts_of(docs: DataFrame, active: DataFrame) -> DataFrame:
    """doc_id, line, near, form and two hashes of the form for the active lines (doc_id, lines, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            rows = []
            for k, text, lines, near in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "lines", "near")), strict=True):
                whole, near = (text or "").encode().split(b"\n"), set(near)
                for i in lines:
                    form = normal_form(whole[i])
                    h = xxhash.xxh3_128_intdigest(form)
                    rows.append((k, i, i in near, form, _signed(h >> 64), _signed(h & (1 << 64) - 1)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "line", "near", "form", "h1", "h2"])

    return _with_lists(docs, active, "inner").select("doc_id", "text", "lines", "near").mapInArrow(run, "doc_id long, line int, near boolean, form string, h1 long, h2 long")


_BLOB = "block int, docs binary, lines binary, who binary, place binary, hash binary"


def _emit(forms: DataFrame, blocks: int) -> DataFrame:
    """All variants of the forms (doc_id, line, form), packed and dealt by hash."""

    def flush(ids: list, places: list, hashes: list) -> pa.RecordBatch:
        n = np.fromiter(map(len, hashes), np.int64, len(hashes))
        who, h = np.repeat(np.arange(len(ids)), n), np.concatenate(hashes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        place[np.cumsum(n) - 1] = -1  # the form itself
        block = (h >> np.uint64(20)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        ids, places, rows = np.array(ids, "<i8"), np.array(places, "<i4"), []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[b] : cuts[b + 1]]
            local, at = np.unique(who[own], return_inverse=True)
            rows.append((b, ids[local].tobytes(), places[local].tobytes(), at.astype("<u4").tobytes(), place[own].astype("<i4").tobytes(), h[own].astype("<u8").tobytes()))
        return pa.record_batch([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(6)], names=["block", "docs", "lines", "who", "place", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, hashes, n = [], [], [], 0
        for batch in slices(batches, "form", 1_000_000):
            for k, i, form in zip(*(batch[c].to_pylist() for c in ("doc_id", "line", "form")), strict=True):
                ids.append(k)
                places.append(i)
                hashes.append(variants(form))
                n += len(form)
                if n >= BLOCK_VARIANTS:
                    yield flush(ids, places, hashes)
                    ids, places, hashes, n = [], [], [], 0
        if ids:
            yield flush(ids, places, hashes)

    return forms.select("doc_id", "line", "form").mapInArrow(run, _BLOB)


def _meet(emitted: DataFrame) -> DataFrame:
    """(doc_id, line, with_doc, with_line): candidate pairs of forms, the second one earlier."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
        who = read("who", "<u4")
        doc = np.concatenate([d[w] for d, w in zip(read("docs", "<i8"), who, strict=True)])
        line = np.concatenate([d[w] for d, w in zip(read("lines", "<i4"), who, strict=True)]).astype(np.int64)
        place, h = np.concatenate(read("place", "<i4")).astype(np.int64), np.concatenate(read("hash", "<u8"))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((line[order], doc[order], place[order], h[order]))]
        h, place, doc, line = h[order], place[order], doc[order], line[order]
        if not len(h):
            return pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "line", "with_doc", "with_line")})
        new_hash = np.concatenate(([True], h[1:] != h[:-1]))
        new_place = new_hash | np.concatenate(([True], place[1:] != place[:-1]))
        hub = np.maximum.accumulate(np.where(new_place, np.arange(len(h)), 0))  # earliest of the same place
        itself = np.maximum.accumulate(np.where(new_hash, np.arange(len(h)), 0))
        pairs = [(np.flatnonzero(~new_place), hub[~new_place])]
        other = np.flatnonzero((place[itself] == -1) & (place != -1))  # the form that is the variant, with the others
        pairs.append((other, itself[other]))
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        rows = np.stack((doc[a], line[a], doc[b], line[b]), axis=1)
        later = (rows[:, 0] > rows[:, 2]) | (rows[:, 0] == rows[:, 2]) & (rows[:, 1] > rows[:, 3])
        rows = np.where(later[:, None], rows, rows[:, [2, 3, 0, 1]])
        rows = np.unique(rows[(rows[:, :2] != rows[:, 2:]).any(axis=1)], axis=0)
        return pa.table({k: pa.array(rows[:, i], pa.int64()) for i, k in enumerate(("doc_id", "line", "with_doc", "with_line"))})

    return emitted.groupBy("block").applyInArrow(lean(run), "doc_id long, line long, with_doc long, with_line long").distinct()


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc_id and lines, the places (from 0) of the lines that go, of documents (doc_id, text) with ids of their own."""
    lines = materialize(_lines(docs, least_chars, exact_chars), "lines")
    # Keys that more than one line has; near: more than one form.
    shared = materialize(lines.groupBy("key").agg(F.count("*").alias("n"), F.min("form").alias("a"), F.max("form").alias("b")).where("n > 1").select("key", "n", (F.col("a") != F.col("b")).alias("near")), "keys")
    active = join_counted(lines, shared, ["key"]).groupBy("doc_id", "line").agg(F.max("near").alias("near"))
    lists = materialize(active.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near")), "active")
    forms = materialize(_texts_of(docs, lists), "forms")
    firsts = forms.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), F.max("near").alias("near"))
    firsts = materialize(firsts.select("h1", "h2", "first.doc_id", "first.line", "n", "near"), "firsts")
    again = firsts.where("n > 1").select("h1", "h2", "n", F.col("doc_id").alias("d"), F.col("line").alias("l"))
    exact = join_counted(forms.select("h1", "h2", "doc_id", "line"), again, ["h1", "h2"]).where("doc_id <> d or line <> l").select("doc_id", "line")

    near = materialize(firsts.where("near").select("doc_id", "line").join(forms.select("doc_id", "line", "form"), ["doc_id", "line"]), "near")
    total = near.agg(F.coalesce(F.sum(F.length("form")), F.lit(0))).first()[0]
    blocks = max(shuffle_width(docs.sparkSession), -(-total // BLOCK_VARIANTS))
    pairs = materialize(_meet(_emit(near, blocks)), "pairs")
    mine, theirs = near.select("doc_id", F.col("line").cast("long").alias("line"), "form"), near.select(F.col("doc_id").alias("with_doc"), F.col("line").cast("long").alias("with_line"), F.col("form").alias("other"))
    close = pairs.join(mine, ["doc_id", "line"]).join(theirs, ["with_doc", "with_line"]).where(F.levenshtein("form", "other", 1) >= 0)
    gone = exact.unionByName(close.select("doc_id", F.col("line").cast("int").alias("line")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _kept(text: str) -> F.Column:
    """The text without the lines at the places in lines, in time linear in its lines."""
    whole = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), "lines")
    # An array of one, so that the lines are split once and not for each place.
    once = F.transform(F.array(F.struct(whole.alias("whole"), left.alias("left"))), lambda x: F.array_join(F.transform(x["left"], lambda i: F.get(x["whole"], i)), "\n"))
    return F.when(F.col("lines").isNull(), F.col(text)).otherwise(F.get(once, F.lit(0)))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text of the lines that stay, of every document."""
    docs, names = keyed(docs)
    gone = materialize(repeated_lines(docs, least_chars, exact_chars), "gone")
    rows = _with_lists(docs, gone, "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return named(rows.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), _kept("text").alias("text")), names)


def filter_documents(docs: DataFrame, least_chars: int = LEAST_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """The documents without repeated lines (n_chars follows the text); those of which only white space is left are left out."""
    names, schema = docs.columns, docs.schema
    docs, _ = keyed(docs, whole=True)
    gone = materialize(repeated_lines(docs.select("doc_id", "text"), least_chars, exact_chars), "gone")
    rows = _with_lists(docs, gone, "left").withColumn("kept", _kept("text")).where(F.col("lines").isNull() | (F.trim("kept", F.lit(_SPACES)) != ""))
    new = {"text": F.col("kept")}
    if "n_chars" in names:
        new["n_chars"] = F.length("kept").cast(schema["n_chars"].dataType)
    return rows.select(*(F.when(F.col("lines").isNull(), F.col("row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in names))
