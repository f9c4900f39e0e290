"""Web archives of records that are compressed one by one, with a Zstandard dictionary of each file's own records.

A file begins with a skippable frame (magic 0x184D2A5D, length, dictionary), as in the proposal for WARC files with
Zstandard; then each record is a frame of its own. The dictionary is made from the first records of the file, so a
task needs nothing from others; a file with too few records has none and begins with its first record.

Of records with equal payloads (SHA-1 and length) the one with the least page_id is the response, others are revisits
that refer to it. Payloads under `least_bytes` are all responses.

Files are written by the tasks to a shared folder under names of their own; only the manifest says which count, so
what a lost or repeated attempt leaves is never read.

Defined results: null html is an empty payload; a null url is left out of the record; every row is a record with an
identifier of its own. Of rows with the same least page_id and payload one is the response and the others revisit it;
pages without a page_id are responses that carry none; an empty table makes no file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from .common import filesystem, join_counted, materialize, slices

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32_768
#: Bytes of a file's first records from which its dictionary is made.
SAMPLE_BYTES = 1_000_000
#: Uncompressed bytes after which a task begins another file.
FILE_BYTES = 64_000_000
LEVEL = 3
LEAST_BYTES = 0
#: Revisits are broadcast to the writers up to so many; beyond, the pages are shuffled.
BROADCAST_REVISITS = 500_000
MANIFEST = "path string, n_records long, n_bytes long"


def record_id(page_id: int | None, sha1_hex: str, row: int = 0) -> str:
    """The identifier of the record of a page with this payload; row tells rows apart that have both in common."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1_hex}:{row}')}>"


def compose(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, date: str, row: int = 0, refers_row: int = 0) -> bytes:
    """One WARC record."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha1_hex, row)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha1_hex, refers_row)), ("Page-Refers-To", str(refers_to))]
    fields += [("Page-Id", str(page_id))] * (page_id is not None) + [("Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def train(samples: list[bytes]):
    """A dictionary of the samples, or None if they are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples)
    except (zstandard.ZstdError, ValueError):
        return None


class Writer:
    """Writes one file."""

    def __init__(self, sink, samples: list[bytes]):
        import zstandard

        self.sink, trained = sink, train(samples)
        if trained:
            raw = trained.as_bytes()
            sink.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)

    def write(self, record: bytes) -> None:
        self.sink.write(self.compressor.compress(record))


def read_records(source, chunk: int = 16_384) -> Iterator[bytes]:
    """The records of a file, one at a time."""
    import zstandard

    buffer = source.read(8)
    known = None
    if int.from_bytes(buffer[:4], "little") == DICTIONARY_MAGIC:
        known = zstandard.ZstdCompressionDict(source.read(int.from_bytes(buffer[4:], "little")))
        buffer = b""
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while buffer or (buffer := source.read(chunk)):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not buffer and not (buffer := source.read(chunk)):
                raise ValueError("the file ends inside a record")
            parts.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """Fields of a record, its payload, and the payload's own digest (as computed; for a revisit, as stated)."""
    import hashlib

    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(body) != n + 4:
        raise ValueError("a record is not as long as it says")
    payload = body[:n].partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("a payload differs from its digest")
        fields["Payload-Length"] = str(len(payload))
    return fields | {"payload": payload, "digest": digest}


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns their manifest: path, n_records, n_bytes (uncompressed)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.lit(0).cast("long").alias("row"))
    if not pages.groupBy("page_id").count().where("count > 1 or page_id is null").isEmpty():
        # Ids that repeat or are missing: the rows are written with numbers that tell them apart.
        pages = materialize(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    facts = materialize(pages.where("page_id is not null").select("page_id", "row", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")), "digests")
    groups = facts.where(F.col("n") >= least_bytes).groupBy("sha1", "n").agg(F.min(F.struct("page_id", "row")).alias("first"), F.count("*").alias("records")).where("records > 1")
    groups = materialize(groups.select("sha1", "n", "records", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row")), "groups")
    revisits = join_counted(facts, groups, ["sha1", "n"], "records").where("page_id <> refers_to or row <> refers_row")
    revisits = materialize(revisits.select("page_id", "row", "refers_to", "refers_row"), "revisits")
    few = revisits.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    rows = pages.withColumn("sha1", F.sha1("payload")).join(F.broadcast(revisits) if few else revisits, ["page_id", "row"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        state = {"sink": None}

        def begin() -> None:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            state.update(path=path, sink=store.open_output_stream(path, compression=None), n=0, bytes=0)
            state["writer"] = Writer(state["sink"], held)

        def put(record: bytes) -> None:
            state["writer"].write(record)
            state["n"] += 1
            state["bytes"] += len(record)

        def end() -> pa.RecordBatch:
            state["sink"].close()
            state["sink"] = None
            return pa.record_batch([pa.array([state["path"]]), pa.array([state["n"]], pa.int64()), pa.array([state["bytes"]], pa.int64())], names=["path", "n_records", "n_bytes"])

        sampled = 0
        for batch in slices(batches, "payload"):
            for page_id, url, payload, sha1, row, refers_to, refers_row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "row", "refers_to", "refers_row")), strict=True):
                record = compose(page_id, url, payload, sha1, refers_to, date, row, refers_row)
                if state["sink"]:
                    put(record)
                else:
                    held.append(record)
                    sampled += len(record)
                    if sampled >= SAMPLE_BYTES:
                        begin()
                        for r in held:
                            put(r)
                        held, sampled = [], 0
                if state["sink"] and state["bytes"] >= FILE_BYTES:
                    yield end()
        if held:
            begin()
            for r in held:
                put(r)
        if state["sink"]:
            yield end()

    files = materialize(rows.select("page_id", "url", "payload", "sha1", "row", "refers_to", "refers_row").mapInArrow(write, MANIFEST), "manifest")
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return files.withColumn("path", F.concat(F.lit(scheme), "path"))


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files in the manifest."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        for manifest in batches:
            for path in manifest["path"].to_pylist():
                store, own = filesystem(path)
                rows, size = [], 0
                with store.open_input_stream(own, compression=None) as f:
                    for record in read_records(f):
                        x = parse(record)
                        refers = x.get("Page-Refers-To")
                        row = (int(x["Page-Id"]) if "Page-Id" in x else None, x.get("WARC-Target-URI"), int(x["Payload-Length"]), x["digest"], x["WARC-Type"], int(refers) if refers else None, x["WARC-Record-ID"])
                        rows.append(row + (x["payload"],) * with_payload)
                        size += len(record) if with_payload else 300
                        if size >= 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * with_payload
    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(read, schema)
