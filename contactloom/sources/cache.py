"""A crawler's response cache as a Spark data source, and its writer.

A response is a folder ``<2 hex digits>/<fingerprint>`` with the files ``meta`` (a Python literal with
``url``, ``response_url`` and ``status``) and ``response_body``; other files are not read. The
fingerprint is the SHA-1 of the url that was asked for.

Each folder of two digits is a partition, so the driver lists at most 256 names and every task lists
and reads its own. Of the columns only those of the schema that the reader is given are made: without
``html`` no body is opened. A partly written response, one without ``meta`` or body, is not there yet.
"""

import ast
import hashlib
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CACHE_SCHEMA = "page_id long, url string, requested_url string, status int, html string"
BATCH_BYTES = 1 << 24

# Workers get the source by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def fingerprint(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest()


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        system, base = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [InputPartition(f.base_name) for f in found if f.type == fs.FileType.Directory and len(f.base_name) == 2]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty cache
            return
        system, base = _opened(self.path)
        rows, held = [], 0
        for entry in system.get_file_info(fs.FileSelector(f"{base}/{partition.value}")):
            row = self._response(system, entry.path)
            if row is not None:
                rows.append(row)
                held += len(row.get("html") or "") + 200
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _response(self, system: fs.FileSystem, folder: str) -> dict | None:
        body = f"{folder}/response_body"
        there = system.get_file_info([f"{folder}/meta", body])
        if any(f.type != fs.FileType.File for f in there):
            return None
        meta = ast.literal_eval(_read(system, f"{folder}/meta").decode())
        row = {
            "page_id": int(folder.rsplit("/", 1)[1][:15], 16), "url": meta.get("response_url") or meta["url"],
            "requested_url": meta["url"], "status": meta.get("status"),
        }
        if "html" in self.names:
            row["html"] = _read(system, body).decode("utf-8", "replace")
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        types = {"page_id": pa.int64(), "status": pa.int32()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in self.names], names=self.names
        )


class ResponseCache(DataSource):
    """``spark.read.format("response_cache").load(folder)``; a schema of fewer columns reads less."""

    @classmethod
    def name(cls) -> str:
        return "response_cache"

    def schema(self) -> str:
        return CACHE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def read_cache(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Responses in ``folder``, all columns or the named ones of CACHE_SCHEMA."""
    spark.dataSource.register(ResponseCache)
    known = dict(c.split(" ") for c in CACHE_SCHEMA.split(", "))
    schema = ", ".join(f"{c} {known[c]}" for c in columns or known)
    return spark.read.format("response_cache").schema(schema).load(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, base = _opened(folder)
    for batch in batches:
        written = 0
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = fingerprint(url)
            entry = f"{base}/{key[:2]}/{key}"
            system.create_dir(entry, recursive=True)
            meta = repr({"url": url, "response_url": url, "status": 200}).encode()
            # the body first, each under a name of this attempt, so a response with a meta is whole
            for name, data in (("response_body", (html or "").encode()), ("meta", meta)):
                temporary = f"{entry}/_{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(temporary, compression=None) as sink:
                    sink.write(data)
                system.move(temporary, f"{entry}/{name}")
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])


def write_cache(pages: DataFrame, folder: str) -> int:
    """Write ``(url, html)`` rows, one for a url, as responses; how many. Rows without a url are left out."""
    rows = pages.filter("url IS NOT NULL").select("url", "html")
    return rows.mapInArrow(lambda b: _write(b, folder), "written long").groupBy().sum("written").first()[0] or 0
