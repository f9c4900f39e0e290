"""Passages that a corpus repeats, by a sparse suffix array of word positions.

Words are runs outside 0x20 and 0x09-0x0D, A-Z as a-z. Of the suffixes that begin at each word, only those are retained
whose first GRAM words are the minimiser (least hash, leftmost of equals) of some window of consecutive grams. Windows
are so wide that every passage of `least` words has a minimiser, and as it depends on the words alone, all occurrences
of the passage retain the same places.

Suffixes whose gram nothing else has are dropped by a count. The rest are sorted by their words, by range, so that even
one gram that a third of all suffixes have is spread over tasks. Each suffix is compared with its next NEIGHBOURS in
that order, and matches are extended left and right; together at least `least` words make a repeated passage. Where
more suffixes share a gram than these, what they may hide is completed by looking up all windows around a suffix. The
first and last suffixes of each range are compared once more with those of the next one. Contexts of `least` words on
both sides suffice (as 40-bit hashes of the words): passages that are longer have more minimisers, and what each finds
is merged. Of equal texts only one takes part; all of them are one passage each.

Defined results: null and empty texts have no passages; a passage that a text repeats in itself counts; every row is a
document of its own, also rows that share a doc_id or have none (their passages come under that id); an empty table
gives no rows. Other columns are ignored, and kept by drop_copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, lean, materialize, release, slices
from .copies import exact_copies, keyed, named, only
from .hashing import mix, word_hashes

#: Words of a repeated passage, at least.
LEAST = 50
#: Words of the grams whose hashes are compared.
GRAM = 6
#: How many following suffixes each is compared with; a group of more is completed otherwise.
NEIGHBOURS = 4
#: Lists of suffixes are broadcast to the documents up to so many bytes; beyond, the documents are shuffled.
BROADCAST_BYTES = 4_000_000
#: Bytes of a word's hash in a context.
BYTES = 5
#: Suffixes in a range, about.
RANGE = 30_000
#: Suffixes whose contexts are compared at once.
STEP = 10_000


def minimisers(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, hash of the gram there) of the minimisers of every window of least - GRAM + 1 grams."""
    width = least - GRAM + 1
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams += words[j : j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    grams = mix(grams)
    counts = np.diff(ends, prepend=0)
    chosen = []
    for b, c in zip((ends - counts).tolist(), counts.tolist(), strict=True):
        if c < least:
            continue
        own = grams[b : b + c - GRAM + 1]
        # The least of each window, by doubling; ties go left.
        size, best = 1, np.arange(len(own))
        while size < width:
            step = min(size, width - size)
            x, y = best[: len(best) - step], best[step:]
            best = np.where(own[y] < own[x], y, x)
            size += step
        chosen.append(b + np.unique(best))
    at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    return at, grams[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _retain(docs: DataFrame, least: int) -> DataFrame:
    """gram, doc_id, pos of the retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=1_000_000):
            words, ends = word_hashes(batch["text"])
            at, grams = minimisers(words, ends, least)
            doc = np.searchsorted(ends, at, side="right")
            begins = ends - np.diff(ends, prepend=0)
            yield pa.record_batch([pa.array(_signed(grams)), pa.array(np.asarray(batch["doc_id"])[doc], pa.int64()), pa.array(at - begins[doc], pa.int32())], names=["gram", "doc_id", "pos"])

    return docs.mapInArrow(run, "gram long, doc_id long, pos int")


def _contexts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """gram, doc_id, pos, ahead (hashes of the words from pos) and behind (of those before it, backwards)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=1_000_000):
            words, ends = word_hashes(batch["text"])
            cut = lambda x: np.ascontiguousarray(x.astype(">u8")[:, None].view(np.uint8)[:, -BYTES:]).tobytes()
            raw, back = cut(words), cut(words[::-1])
            total, begin, rows = len(words), 0, []
            for doc, places, end in zip(batch["doc_id"].to_pylist(), batch["places"].to_pylist(), ends.tolist(), strict=True):
                for p in places:
                    at = begin + p["pos"]
                    rows.append((p["gram"], doc, p["pos"], raw[BYTES * at : BYTES * min(end, at + least)], back[BYTES * (total - at) : BYTES * (total - max(begin, at - least))]))
                begin = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["gram", "doc_id", "pos", "ahead", "behind"])

    size = wanted.agg(F.coalesce(F.sum(F.size("places") * 16 + 40), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "doc_id")
    return joined.select("doc_id", "text", "places").mapInArrow(run, "gram long, doc_id long, pos int, ahead binary, behind binary")


def _matrix(column: pa.Array, least: int, salt: int) -> np.ndarray:
    """Hashes as rows of `least`; places past a text's end differ from all else."""
    size = np.asarray(pc.binary_length(column)).astype(np.int64) // BYTES
    out = (np.arange(len(size), dtype=np.uint64) * np.uint64(2) + np.uint64(salt) + np.uint64(1 << 60))[:, None].repeat(least, axis=1)
    flat = np.zeros((int(size.sum()), 8), np.uint8)
    flat[:, -BYTES:] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)
    flat = flat.view(">u8").ravel().astype(np.uint64)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _compare(table: pa.Table, least: int) -> list[np.ndarray]:
    """Rows (doc_id, start, end, 1 if of the later of two) from suffixes in order."""
    gram, doc, pos = (np.asarray(table[c]).astype(np.int64) for c in ("gram", "doc_id", "pos"))
    ahead = _matrix(table["ahead"].combine_chunks(), least, 0)
    behind = _matrix(table["behind"].combine_chunks(), least, 1)
    out = []
    for d in range(1, min(NEIGHBOURS, len(gram) - 1) + 1):
        i = np.flatnonzero((gram[:-d] == gram[d:]) & ((doc[:-d] != doc[d:]) | (pos[:-d] != pos[d:])))
        j = i + d
        right = np.where((same := ahead[i] == ahead[j]).all(axis=1), least, same.argmin(axis=1))
        left = np.where((same := behind[i] == behind[j]).all(axis=1), least, same.argmin(axis=1))
        hit = left + right >= least
        i, j, left, right = i[hit], j[hit], left[hit], right[hit]
        later = (doc[j] > doc[i]) | (doc[j] == doc[i]) & (pos[j] > pos[i])
        out.append(np.stack((doc[i], pos[i] - left, pos[i] + right, ~later), axis=1))
        out.append(np.stack((doc[j], pos[j] - left, pos[j] + right, later), axis=1))
    return out


def _complete(table: pa.Table, least: int, chosen: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows as of _compare, and all (hash, doc_id, start), for the windows of `least` words around the chosen suffixes.

    Where more suffixes share a gram than are compared, the next in order may agree further ahead and less behind than
    one beyond them. So all windows around a suffix are looked up too, those with o words before it for each o.
    """
    table = table.take(pa.array(chosen))
    doc, pos = np.asarray(table["doc_id"]).astype(np.int64), np.asarray(table["pos"]).astype(np.int64)
    sides = []
    for column, salt in (("ahead", 0), ("behind", 1)):
        x = table[column].combine_chunks()
        factors = mix(np.arange(1, least + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(salt)) | np.uint64(1)
        sums = np.zeros((len(doc), least + 1), np.uint64)
        np.cumsum(_matrix(x, least, salt) * factors, axis=1, out=sums[:, 1:])
        sides.append((sums, np.asarray(pc.binary_length(x)).astype(np.int64) // BYTES))
    (ahead, n_ahead), (behind, n_behind) = sides
    most, fewest = np.full(len(doc), -1), np.full(len(doc), least)
    copies = np.zeros(len(doc), bool)
    every: list[list[np.ndarray]] = [[], [], []]
    for o in range(least - GRAM + 1):
        own = np.flatnonzero((n_behind >= o) & (n_ahead >= least - o))
        key = mix(ahead[own, least - o] + mix(behind[own, o] + np.uint64(o)))
        order = np.lexsort((pos[own], doc[own], key))
        own, key = own[order], key[order]
        same = key[1:] == key[:-1]
        later = np.concatenate(([False], same))
        hit = later | np.concatenate((same, [False])) if len(own) else later[:0]
        most[own[hit]] = np.maximum(most[own[hit]], o)
        fewest[own[hit]] = np.minimum(fewest[own[hit]], o)
        copies[own[later[: len(own)]]] = True
        first = own[~later[: len(own)]]
        for to, x in zip(every, (key[~later[: len(own)]], doc[first], pos[first] - o), strict=True):
            to.append(x)
    hit = most >= 0
    return [np.stack((doc[hit], (pos - most)[hit], (pos - fewest + least)[hit], copies[hit]), axis=1)], tuple(np.concatenate(x) for x in every)


_FOUND = "kind int, edge int, gram long, doc_id long, pos int, ahead binary, behind binary, start int, stop int, copy boolean"


def _found(rows: list[np.ndarray]) -> pa.RecordBatch:
    x = np.unique(np.concatenate([r.astype(np.int64) for r in rows]), axis=0) if rows else np.zeros((0, 4), np.int64)
    n = len(x)
    nulls = lambda t: pa.nulls(n, t)
    return pa.record_batch([pa.array(np.zeros(n), pa.int32()), nulls(pa.int32()), nulls(pa.int64()), pa.array(x[:, 0]), nulls(pa.int32()), nulls(pa.binary()), nulls(pa.binary()), pa.array(x[:, 1], pa.int32()), pa.array(x[:, 2], pa.int32()), pa.array(x[:, 3] == 1)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _edges(table: pa.Table, edge: int, kind: int) -> pa.RecordBatch:
    n = table.num_rows
    own = [table[c].combine_chunks() for c in ("gram", "doc_id", "pos", "ahead", "behind")]
    return pa.record_batch([pa.array([kind] * n, pa.int32()), pa.array([edge] * n, pa.int32()), *own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], names=[c.split()[0] for c in _FOUND.split(", ")])


def repeated_passages(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, stop (places of words, from 0, stop exclusive) and n_words of each repeated passage."""
    docs, names = keyed(docs, key, text)
    return named(_passages(docs, least), names)


def _passages(docs: DataFrame, least: int, copies_only: bool = False) -> DataFrame:
    """As repeated_passages, of documents (doc_id, text) with ids of their own.

    copies_only: only of those occurrences for which an earlier one (by doc_id and place) was met in the comparison; the
    earliest is never among them.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    copies, _ = exact_copies(whole)
    docs = only(whole, copies.select("doc_id"), "left_anti")
    retained = materialize(_retain(docs, least), "suffixes")
    twice = materialize(retained.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    wanted = join_counted(retained, twice, ["gram"]).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "gram"))).alias("places"))
    suffixes = materialize(_contexts(docs, materialize(wanted, "wanted"), least), "contexts")
    ranges = max(1, -(-suffixes.count() // RANGE))
    order = ["gram", "ahead", "behind", "doc_id", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, parts = TaskContext.get().partitionId(), list(batches)  # a range of bounded size
        if not sum(b.num_rows for b in parts):
            return
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        yield _edges(table.slice(0, NEIGHBOURS), part, 2)
        yield _edges(table.slice(max(0, n - NEIGHBOURS)), part + 1, 1)
        for k in range(0, n, STEP):
            yield _found(_compare(table.slice(max(0, k - NEIGHBOURS), STEP + NEIGHBOURS), least))
        gram = np.asarray(table["gram"])
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        size = np.diff(np.append(first, n))
        size[[0, -1]] = NEIGHBOURS + 2  # the first and last may go on in other ranges
        for at in np.array_split(first, max(1, n // STEP)):
            if len(at):
                last = np.searchsorted(first, at[-1], side="right")
                rows = np.arange(at[0], first[last] if last < len(first) else n)
                rows = rows[np.repeat(size, np.diff(np.append(first, n)))[rows] > NEIGHBOURS + 1]
                if len(rows):
                    yield _found(_complete(table, least, rows)[0])
        outer = np.flatnonzero((gram == gram[0]) | (gram == gram[-1]))
        key, doc, start = _complete(table, least, outer)[1]
        order = np.argsort(key % np.uint64(ranges), kind="stable")
        key, doc, start = key[order], doc[order], start[order]
        cuts = np.searchsorted(key % np.uint64(ranges), np.arange(ranges + 1).astype(np.uint64))
        rows = [(3, b, key[x:y].tobytes(), np.stack((doc[x:y], start[x:y])).tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
        k = len(rows)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_())], names=names)
        release()

    def outer(table: pa.Table) -> pa.Table:
        """Windows that two or more ranges have."""
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in table["ahead"].to_pylist()])
        place = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in table["behind"].to_pylist()], axis=1)
        order = np.lexsort((place[1], place[0], key))
        key, place = key[order], place[:, order]
        same = key[1:] == key[:-1]
        later = np.concatenate(([False], same))
        hit = later | np.concatenate((same, [False]))
        return pa.Table.from_batches([_found([np.stack((place[0][hit], place[1][hit], place[1][hit] + least, later[hit]), axis=1)])])

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("gram", "ascending"), ("ahead", "ascending"), ("behind", "ascending"), ("doc_id", "ascending"), ("pos", "ascending")])
        return pa.Table.from_batches([_found(_compare(table, least))])

    met = materialize(suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, _FOUND), "matches")
    spans = met.where("kind = 0").unionByName(met.where("kind in (1, 2)").groupBy("edge").applyInArrow(lean(across), _FOUND)).unionByName(met.where("kind = 3").groupBy("edge").applyInArrow(lean(outer), _FOUND)).select("doc_id", "start", "stop", "copy").distinct()
    # A text that has copies is one passage itself.
    ids = copies.select("doc_id") if copies_only else copies.select(F.explode(F.array("doc_id", "rep")).alias("doc_id")).distinct()
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    equal = only(whole, ids).select("doc_id", F.lit(0).alias("start"), n_words.alias("stop"), F.lit(True).alias("copy")).where(F.col("stop") >= least).distinct()
    spans = spans.unionByName(equal)
    # Overlapping matches of a document become one passage.
    by_doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    own = (spans.where("copy") if copies_only else spans).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    own = own.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = own.groupBy("doc_id", "run").agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"))
    return merged.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"))


def drop_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without the passages that are copies of earlier ones; the words that stay keep the white space after them."""
    import re

    names, kinds = docs.columns, docs.schema
    rows, _ = keyed(docs, whole=True)
    gone = _passages(rows.select("doc_id", "text"), least, copies_only=True).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                if spans:
                    drop = np.zeros(max(s["stop"] for s in spans), bool)
                    for s in spans:
                        drop[s["start"] : s["stop"]] = True
                    parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
                    text = "".join(p for i, p in enumerate(parts) if i >= len(drop) or not drop[i])
                texts.append(text)
            row = batch["row"]
            columns = [pa.array(texts, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(names)]
            yield pa.record_batch(columns, names=names)

    return rows.join(gone, "doc_id", "left").select("text", "gone", "row").mapInArrow(run, kinds)
