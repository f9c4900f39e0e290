"""Requests over the network, with connections that each partition keeps open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import with_origin

_REDIRECTS = (301, 302, 303, 307, 308)


class Connections:
    """Connections to hosts, kept open from one request to the next."""

    def __init__(self, timeout: float):
        self.timeout, self.open = timeout, {}

    def _once(self, url: str, method: str, body: str | None):
        import http.client
        from urllib.parse import urlsplit

        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"not an address of the web: {url}")
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        key = parts.scheme, parts.hostname, parts.port
        for fresh in (False, True):  # a connection that was kept may have been closed at the other end
            if fresh or key not in self.open:
                self.open[key] = kind(parts.hostname, parts.port, timeout=self.timeout)
                fresh = True
            try:
                headers = {"User-Agent": "tidemark"} | ({"Content-Type": "application/json"} if body is not None else {})
                self.open[key].request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), body if body is None else body.encode(), headers)
                answer = self.open[key].getresponse()
                return answer.status, answer.headers, answer.read()
            except (http.client.HTTPException, OSError):
                self.open.pop(key).close()
                if fresh or method == "POST":  # which must not be sent twice
                    raise

    def ask(self, url: str, method: str = "GET", body: str | None = None, redirects: int = 3) -> tuple[str, int, str]:
        """(final address, status, body) of an address; redirects of a GET are followed."""
        from urllib.parse import urljoin

        while True:
            status, headers, raw = self._once(url, method, body)
            if method != "GET" or status not in _REDIRECTS or "Location" not in headers:
                try:
                    return url, status, raw.decode(headers.get_content_charset() or "utf-8", "replace")
                except LookupError:  # a character set that there is not
                    return url, status, raw.decode("utf-8", "replace")
            if not redirects:
                raise OSError("too many redirects")
            url, redirects = urljoin(url, headers["Location"]), redirects - 1

    def close(self) -> None:
        for connection in self.open.values():
            connection.close()


def request(rows: DataFrame, url: Column, method: str = "GET", body: Column | None = None, origin: str = "", timeout: float = 30) -> DataFrame:
    """rows with status and answer of a request for each: to url, with the origin before it if it has none of its own, and a body of JSON.

    What fails has no status. Each evaluation asks again; write the result to have asked once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connections = Connections(timeout)
        try:
            for batch in batches:
                status, answer = [], []
                for to, text in zip(batch["url"].to_pylist(), batch["body"].to_pylist(), strict=True):
                    try:
                        _, code, found = connections.ask(to, method, text)
                    except Exception:  # one address must not stop the others
                        code, found = None, None
                    status.append(code)
                    answer.append(found)
                yield pa.record_batch([*batch["row"].flatten(), pa.array(status, pa.int32()), pa.array(answer, pa.string())], names=[*names, "status", "answer"])
        finally:
            connections.close()

    names = rows.columns
    asked = rows.select(F.struct(*(f"`{c}`" for c in names)).alias("row"), with_origin(url, origin).alias("url"), (F.lit(None).cast("string") if body is None else body).alias("body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return asked.mapInArrow(run, f"{schema}, status int, answer string")
