"""Parquet files behind HTTP, read by byte ranges: only the footers and the chosen columns' pages are fetched."""

from __future__ import annotations

import io
import os
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

#: Files of at most so many bytes are fetched whole by one request.
WHOLE_BYTES = 8 << 20
TIMEOUT = 60


class RangeFile(io.RawIOBase):
    """A file behind a URL as a seekable stream of range requests (whole if it is small or the server knows no ranges)."""

    def __init__(self, url: str):
        super().__init__()
        self.url, self.at, self.held = url, 0, None
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
            size, ranges = answer.headers.get("Content-Length"), answer.headers.get("Accept-Ranges", "")
        if size is None or ranges.lower() != "bytes" or int(size) <= WHOLE_BYTES:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                self.held = answer.read()
            size = len(self.held)
        self.size = int(size)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.at = max(0, offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.at, os.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        count = max(0, min(len(buffer), self.size - self.at))
        if count:
            buffer[:count] = self._bytes(self.at, count)
            self.at += count
        return count

    def read(self, size: int = -1) -> bytes:
        count = max(0, self.size - self.at if size is None or size < 0 else min(size, self.size - self.at))
        out = self._bytes(self.at, count) if count else b""
        self.at += count
        return out

    def _bytes(self, start: int, count: int) -> bytes:
        if self.held is not None:
            return self.held[start : start + count]
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{start + count - 1}"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            body = answer.read()
        # A server may answer with the whole file all the same.
        return body[start : start + count] if answer.status == 200 else body


def read_http(spark: SparkSession, urls: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """The rows of Parquet files behind URLs, one task per row group; of ``columns``, in their order, only these are fetched.

    The schema is that of the first file. An unreachable file is an error.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    urls = [urls] if isinstance(urls, str) else list(urls)
    file = pq.ParquetFile(RangeFile(urls[0]))
    schema = file.schema_arrow if columns is None else pa.schema([file.schema_arrow.field(c) for c in columns])

    def groups(batches):
        for batch in batches:
            for url in batch.column(0).to_pylist():
                count = pq.ParquetFile(RangeFile(url)).num_row_groups
                yield pa.RecordBatch.from_arrays([pa.array([url] * count, pa.string()), pa.array(range(count), pa.int32())], ["url", "row_group"])

    def rows(batches):
        for batch in batches:
            for url, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in pq.ParquetFile(RangeFile(url)).iter_batches(row_groups=[group], columns=schema.names):
                    yield part.select(schema.names)

    cores = spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(len(urls), cores)).mapInArrow(groups, "url string, row_group int")
    return listed.repartition(cores, "url", "row_group").mapInArrow(rows, from_arrow_schema(schema))
