"""Token ids on disk, by canonical length-limited Huffman codes of their counts in the whole corpus.

A file (all numbers little-endian; bits are packed from the high end of each byte):

    magic TMHUF1\\0\\0 | blocks | footer | footer bytes uint32 | magic
    footer, compressed with zlib: one line of JSON, then the arrays that it lists, one after the other
        lengths   uint8   code length of every id, 0 for ids that do not occur
        keys      int64   document keys in ascending order, then 0 for each document without one
        known     uint8   1 for a key, 0 for none
        counts    int64   ids of each document, its end id included
        offsets   uint64  bit offset of each block (a checkpoint): blocks are decoded on their own

Codes are at most LIMIT bits (package-merge) and canonical, so that the lengths alone define them. Decoding looks a
window of LIMIT bits up in one table, for the same position of many blocks at once.

Documents are dealt by range of their key, a file for each range. Files of failed attempts have other names and are
in no manifest, so they are never read.

Documents with one key, or without one, may be any share of all: ranges go on by the number of the written row.

Defined results: a null or empty text is its end id alone; repeated keys stay next to each other as rows of their own;
rows without a key come last; other columns are ignored; an empty table makes no files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch
from .common import filesystem, materialize, slices
from .encoding import MEMORY, SLICE_BYTES, encoder

MAGIC = b"TMHUF1\0\0"
LIMIT = 20
#: Ids in a block.
BLOCK = 512
#: Ids that a file holds, about.
FILE_IDS = 6_000_000
MANIFEST = "part int, path string, n_docs long, n_ids long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    order = np.flatnonzero(counts)
    order = order[np.argsort(counts[order], kind="stable")]
    n = len(order)
    if n <= 1:
        out[order] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    leaves = counts[order].astype(np.int64)
    levels, merged = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        merged, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def code_table(lengths: np.ndarray) -> np.ndarray:
    """Code and length of each id in one number: code << 5 | length."""
    return (canonical_codes(lengths) << np.uint64(5) | lengths.astype(np.uint64)).astype(np.uint32)


def encode_bits(ids: np.ndarray, table: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed bits, padded to whole words of 64, and the bit offset at which each block begins."""
    known = table[ids]
    n = (known & np.uint32(31)).astype(np.int32)
    end = np.cumsum(n, dtype=np.int32)
    begin = end - n
    word, room = begin >> 6, 64 - (begin & 63) - n
    code = (known >> np.uint32(5)).astype(np.uint64)
    out = np.zeros(int(end[-1] + 63 >> 6), np.uint64)
    over = np.flatnonzero(room < 0)
    head = code << np.maximum(room, 0).astype(np.uint64)
    head[over] = code[over] >> (-room[over]).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), begin[::BLOCK].astype(np.uint64)


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """By the next `limit` bits: id << 5 | code length."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]  # canonical order, so codes follow each other from 0
    table = np.zeros(1 << limit, np.uint32)
    span = np.int64(1) << (limit - lengths[used].astype(np.int64))
    table[: int(span.sum())] = np.repeat(used.astype(np.uint32) << np.uint32(5) | lengths[used], span)
    return table


def decode_blocks(data: bytes, offsets: np.ndarray, n_ids: int, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The first n_ids ids of the blocks that begin at these bit offsets of data."""
    raw = np.frombuffer(data + bytes(BLOCK * limit // 8 + 8), np.uint8).astype(np.uint32)  # the last block may end early
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, mask, down = offsets.astype(np.int64), np.uint32((1 << limit) - 1), np.uint32(32 - limit)
    out = np.zeros((BLOCK, len(at)), np.uint32)
    for step in range(min(BLOCK, n_ids) if len(at) == 1 else BLOCK):
        found = table[(window[at >> 3] >> (down - (at & 7).astype(np.uint32))) & mask]
        out[step] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.T.reshape(-1)[:n_ids]


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int, slice_bytes: int = SLICE_BYTES, memory: int = MEMORY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """kind 0: doc_id, n_tokens and the ids (uint32, or uint16 where all fit) of each document, end id included.

    kind 1: as ids, how often each id occurs in the documents of a task (int64).
    """

    def batch(kind: int, doc_id: pa.Array, n: np.ndarray, width: int, raw: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32) * raw.dtype.itemsize
        ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        return pa.record_batch([pa.array(np.full(len(n), kind, np.int32)), doc_id, pa.array(n, pa.int64()), pa.array(np.full(len(n), width, np.int32)), ids], names=["kind", "doc_id", "n_tokens", "width", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, memory)
        size = max(words.tokenizer.get_vocab_size(), end_id + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        total = np.zeros(size, np.int64)
        for part in slices(batches, chars=slice_bytes, remember=True):
            ids, ends = words.encode(part["text"])
            total += np.bincount(ids, minlength=size)
            total[end_id] += part.num_rows
            own = np.full(len(ids) + part.num_rows, end_id, kind)
            own[np.arange(len(ids)) + np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0))] = ids
            yield batch(0, part["doc_id"], np.diff(ends, prepend=0) + 1, kind.itemsize, own)
        yield batch(1, pa.array([None], pa.int64()), np.array([size]), 8, total)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "kind int, doc_id long, n_tokens long, width int, ids binary")


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    raw = b"".join(batch["ids"].to_pylist())
    return np.frombuffer(raw, "<u2" if batch["width"][0].as_py() == 2 else "<u4")


def global_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; the driver gets one row for each id of the vocabulary at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            total = sum(np.frombuffer(x, "<i8") for x in batch["ids"].to_pylist())
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = ids.where("kind = 1").select("ids").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, file_ids: int = FILE_IDS, slice_bytes: int = SLICE_BYTES, memory: int = MEMORY) -> DataFrame:
    """Writes the files and returns their manifest: part (their order), path, n_docs, n_ids."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    ids = materialize(tokens(docs, tokenizer_path, end_id, slice_bytes, memory).withColumn("row", F.monotonically_increasing_id()), "tokens")
    counts = global_counts(ids)
    lengths = code_lengths(counts)
    known = spark.sparkContext.broadcast((lengths, code_table(lengths)))  # an entry for each id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, table = known.value
        part = TaskContext.get().partitionId()
        store, root = filesystem(folder)
        path, sink, bits = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.huf", None, 0
        keys, counts, offsets, rest = [], [], [], np.zeros(0, np.uint16)

        def put(ids: np.ndarray) -> None:
            nonlocal bits
            for k in range(0, len(ids), 128 * BLOCK):  # parts that stay in the processor's cache
                data, at = encode_bits(ids[k : k + 128 * BLOCK], table)
                sink.write(data)
                offsets.append(at + np.uint64(bits))
                bits += 8 * len(data)

        for batch in slices(batches, "ids"):
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(path, compression=None)
                sink.write(MAGIC)
            keys += batch["doc_id"].to_pylist()
            counts += batch["n_tokens"].to_pylist()
            rest = np.concatenate((rest, _ids(batch)))
            whole = len(rest) // BLOCK * BLOCK
            if whole:
                put(rest[:whole])
                rest = rest[whole:]
        if sink is None:
            return
        if len(rest):
            put(rest)
        arrays = {"lengths": lengths, "keys": np.array([k or 0 for k in keys], "<i8"), "known": np.array([k is not None for k in keys], np.uint8), "counts": np.array(counts, "<i8"), "offsets": np.concatenate(offsets).astype("<u8")}
        head = json.dumps({"limit": LIMIT, "block": BLOCK, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode() + b"\n"
        footer = zlib.compress(head + b"".join(v.tobytes() for v in arrays.values()), 1)
        sink.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        sink.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([sum(counts)], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    parts = max(1, -(-int(counts.sum()) // file_ids))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = ids.where("kind = 0").drop("kind").repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    files = materialize(ranged.mapInArrow(write, MANIFEST), "manifest")
    return files.withColumn("path", F.concat(F.lit(scheme), "path"))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the files."""
    spark: SparkSession = files.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("path", before.alias("base"))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                yield from decode_file(path, base)

    return listed.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_file(path: str, base: int = 0, lanes: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of one file; only `lanes` blocks are in memory at once."""
    store, own = filesystem(path)
    with store.open_input_file(own) as f:
        total = f.size()
        f.seek(total - 12)
        tail = f.read(12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        size = int.from_bytes(tail[:4], "little")
        f.seek(total - 12 - size)
        footer = zlib.decompress(f.read(size))
        head, _, raw = footer.partition(b"\n")
        meta, arrays, at = json.loads(head), {}, 0
        for name, kind, n in meta["arrays"]:
            arrays[name] = np.frombuffer(raw, kind, n, at)
            at += arrays[name].nbytes
        table = decode_table(arrays["lengths"], meta["limit"])
        offsets, counts, keys, known = arrays["offsets"], arrays["counts"], arrays["keys"], arrays["known"]
        n_ids, data_end = int(counts.sum()), total - 12 - size - len(MAGIC)
        stops = np.cumsum(counts)
        crc, doc, done, rows = 0, 0, 0, []
        for b in range(0, len(offsets), lanes):
            lo = int(offsets[b]) >> 3
            hi = min(data_end, (int(offsets[b + lanes]) >> 3) + 8 if b + lanes < len(offsets) else data_end)
            f.seek(len(MAGIC) + lo)
            ids = decode_blocks(f.read(hi - lo), offsets[b : b + lanes].astype(np.int64) - 8 * lo, min(n_ids - done, lanes * BLOCK), table, meta["limit"]).astype("<u4")
            view, begin = memoryview(ids.tobytes()), 0
            while doc < len(stops) and stops[doc] <= done + len(ids):
                stop = int(stops[doc]) - done
                rows.append((int(keys[doc]) if known[doc] else None, base + int(stops[doc] - counts[doc]), int(counts[doc]), zlib.crc32(view[4 * begin : 4 * stop], crc)))
                crc, begin, doc = 0, stop, doc + 1
            crc = zlib.crc32(view[4 * begin :], crc)
            done += len(ids)
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
