"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's ids (and an end id) are cut into pieces no longer than a sequence; pieces are placed in sequences of
fixed capacity. With N(g) open sequences that have a gap of g ids, a piece goes where the sum of N(g)**2 becomes
smallest; ties go to the smallest remaining gap. A sequence is opened only for a piece that fits in none.

Pieces are dealt at random into groups of about GROUP, each packed by one task. Of two sequences that can be joined
one is at most half full. So those of all groups are packed again, as whole blocks, with as many of the fuller ones,
of which those with most room; in groups of that size too, until one group holds them or nothing can be joined.

Groups are dealt by a number that each piece gets when it is written, so that repeated or missing ids do not meet in
one group, whatever their share.

Defined results: a null or empty text has one piece, the end id alone. Repeated document ids are packed as rows of
their own, also those without an id. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .encoding import MEMORY, SLICE_BYTES, encoder

CAPACITY = 4096
#: Pieces that one task packs.
GROUP = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size, largest sizes placed first."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    bins = 0
    never = np.int64(1) << 40
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        gap = capacity
        if s < capacity:
            # Leaving gap g for g - s changes the sum by 2 (N(g - s) - N(g)) + 2; filling it, by 1 - 2 N(s). A new sequence
            # would often give a smaller sum, but costs a sequence: it is opened only where none has room.
            change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
            change[0] -= 1
            change[count[s:capacity] == 0] = never
            best = int(change.argmin())
            if change[best] < never:
                gap = s + best
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            open_by_gap[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, slice_bytes: int = SLICE_BYTES, memory: int = MEMORY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32 and, if asked for, its ids (uint32, little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, memory)
        for batch in slices(batches, chars=slice_bytes, remember=True):
            ids, ends = words.encode(batch["text"])
            begin, rows = 0, []
            for k, end in zip(batch["key"].to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                begin = end
                for p, at in enumerate(range(0, len(own), capacity)):
                    raw = own[at : at + capacity].tobytes()
                    rows.append((k, p, at, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns[: 5 + with_ids], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _packed(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """items (unit, size) with group g, sequence b of the group, offset and the sequence's fill."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")  # the same order in every attempt
        size = pdf["size"].to_numpy()
        where, offset = sum_of_squares(size, capacity)
        fill = np.bincount(where, weights=size).astype(np.int64)
        return pdf.assign(b=where, offset=offset, fill=fill[where])

    dealt = items.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(one, dealt.schema.simpleString()[7:-1].replace(":", " ") + ", b long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items: doc_id, piece, length and more. Adds sequence_id and offset."""
    own, group = items.columns, max(group, 4)  # each group leaves one sequence at most half full, so these fall by half or more
    numbered = materialize(items.withColumn("unit", F.monotonically_increasing_id()), "pieces")
    groups = -(-numbered.count() // group)
    pieces = numbered.withColumn("size", F.col("length"))
    placed = materialize(_packed(pieces, max(1, groups), capacity).withColumn("id", F.shiftleft(F.col("g").cast("long"), 40) + F.col("b")), "packed")
    out = placed.select(*own, F.col("id").alias("sequence_id"), F.col("offset").alias("at"))
    sequences = placed.where("offset = 0").select("id", F.col("fill").alias("size"))
    low, before = F.col("size") * 2 <= capacity, None
    while groups > 1:
        fills = {r["size"]: r["count"] for r in sequences.groupBy("size").count().collect()}
        n_low = sum(n for f, n in fills.items() if 2 * f <= capacity)
        if not n_low or n_low == before:
            break
        # Partners with most room, about as many: whole sizes, and of one size too many a part by the hash of the id.
        room, some, n_both = n_low, low, n_low
        for fill, n in sorted((f, n) for f, n in fills.items() if 2 * f > capacity and f <= capacity - min(fills)):
            part = max(1, n // max(1, room))
            some = some | (F.col("size") == fill) & (F.pmod(F.xxhash64("id"), F.lit(part)) == 0)
            n_both, room = n_both + n // part, room - n
            if room <= 0:
                break
        if n_both < 2:
            break
        before, groups = n_low, -(-n_both // group)
        some = sequences.where(some)
        packed = materialize(_packed(some.select(F.col("id").alias("unit"), "size"), groups, capacity), "packed").withColumnRenamed("unit", "id")
        # What is joined has the id of the block at its begin.
        heads = packed.where("offset = 0").select("g", "b", F.col("id").alias("to"), "fill")
        moves = packed.where("offset > 0").join(heads.drop("fill"), ["g", "b"]).select(F.col("id").alias("sequence_id"), "to", F.col("offset").alias("more"))
        out = out.join(moves, "sequence_id", "left").select(*own, F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
        sequences = materialize(sequences.join(packed.select("id"), "id", "left_anti").union(heads.select("to", "fill")), "sequences") if groups > 1 else None
    return out.select(*own, "sequence_id", F.col("at").alias("offset"))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, group: int = GROUP, slice_bytes: int = SLICE_BYTES, memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    slice_bytes and memory (words) bound what a worker holds; they do not change the result.
    """
    return pack(pieces(docs, tokenizer_path, capacity, end_id, slice_bytes=slice_bytes, memory=memory), capacity, group)
