"""WARC archives of page tables: a deterministic sharded writer, and a reader.

A shard is a range of page ids; its records are sorted by id and go to gzip files that are rolled
once they reach a compressed size, each record a gzip member of its own. Names, record ids, headers
and digests depend on the records alone. Of records with equal payloads the one with the smallest
page id is a ``response`` with the payload; the others are ``revisit`` records that name it and
carry the HTTP head only.

Files are written under names that only one attempt of a task uses. The rows of the attempts that
count are a table; a second pass of tasks gives the files it names their final names, which may be
tried again, and the manifest is written last. Readers read what the manifest names.

Defined cases: a null html counts as empty; a null url is left out of the header; rows without a
page id come first, in a shard of their own, and revisit a row with an id if there is one; rows
that repeat both id and payload are all of one record type; an empty table gives an archive
without files; other columns are ignored.
"""

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.storage import id_shards, opened, settle
from contactloom.llm.text import whole
from contactloom.sources.shared import new_path, shared_table

ROLL_BYTES = 64_000_000
SHARD_BYTES = 64_000_000
DATE = "1970-01-01T00:00:00Z"  # of all records, since page tables have none
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space for URLs, RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "shard long, part long, temporary string, n_records long, n_bytes long"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {payload_digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(
    page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, payload_digest: str,
    refers_to: int | None, revisit: bool,
) -> bytes:
    """A response with its payload, or a revisit of another page's."""
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    ).encode() + (b"" if revisit else payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, payload_digest)),
               ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^\\`\"<>")))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest)),
                    ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> files under temporary names, one row for each file."""
    system, base = opened(folder)
    sink = shard = name = None
    part = n = size = 0

    def done() -> pa.RecordBatch:
        sink.close()
        return pa.RecordBatch.from_pydict({
            "shard": [shard], "part": [part], "temporary": [name], "n_records": [n], "n_bytes": [size],
        })

    for given in batches:
        columns = [given.column(i) for i in range(given.num_columns)]
        for i in range(given.num_rows):
            own, page_id, url, html, first, n_bytes, payload_digest = (c[i].as_py() for c in columns)
            if sink is not None and (own != shard or size >= roll_bytes):
                yield done()
                sink = None
            if sink is None:
                part = part + 1 if own == shard else 0
                shard, n, size = own, 0, 0
                name = f"_temporary-{shard}-{part}-{uuid.uuid4().hex}"
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
            payload = None if first is not None else (html or "").encode()
            if payload is not None:
                n_bytes, payload_digest = len(payload), digest(payload)
            else:
                payload_digest = base64.b32encode(bytes.fromhex(payload_digest)).decode()
            raw = page_record(page_id, url, payload, n_bytes, payload_digest, first, first is not None)
            member = gzip.compress(raw, 6, mtime=0)
            sink.write(member)
            n, size = n + 1, size + len(member)
    if sink is not None:
        yield done()


def _settle(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        names = []
        for row in frame.itertuples(index=False):
            names.append(f"pages-{row.shard:08d}-{row.part:05d}.warc.gz")
            settle(folder, row.temporary, names[-1], row.n_bytes)
        yield frame.assign(file=names)[["file", "n_records", "n_bytes"]]


def write_archive(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write an archive into ``folder``; its manifest ``(file, n_records, n_bytes)``.

    Equal payloads are found by SHA-256: ids are reduced per payload before they are shuffled, and
    only rows that revisit another one are joined back. Payloads of revisits are dropped before
    the one shuffle that carries html.
    """
    spark = pages.sparkSession
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    body = whole(F.col(html))
    size = F.octet_length(body)
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.sha2(body, 256).alias("payload"), size.cast("long").alias("size"), F.sha1(body).alias("sha1"),
    )
    groups = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("payload").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1 AND first IS NOT NULL")
    revisits = (
        rows.select("id", "payload").join(groups, "payload")
        .filter(~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("_id"), F.col("payload").alias("_payload"), "first").distinct()
    )
    # a table of known size, which Spark broadcasts if it is small, so that html is shuffled once
    revisits = shared_table(revisits, "warc-revisits")
    shard, n = id_shards(rows, "id", F.col("size"), shard_bytes, F.col("payload"))
    told = rows.join(
        revisits, rows["id"].eqNullSafe(revisits["_id"]) & (rows["payload"] == revisits["_payload"]), "left"
    ).select(
        shard.alias("shard"), "id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"),
        "first", "size", "sha1",
    )
    sorted_rows = told.repartitionByRange(n, "shard").sortWithinPartitions(
        "shard", F.col("id").asc_nulls_first(), "sha1", "url"
    )
    written = shared_table(sorted_rows.mapInArrow(lambda b: _write(b, folder, roll_bytes), WRITTEN), "warc-files")
    written.mapInPandas(lambda f: _settle(f, folder), "file string, n_records long, n_bytes long").write.parquet(
        f"{folder}/manifest"
    )
    return spark.read.parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip stream."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while line := lines.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no record at {line[:40]!r}")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                key, _, value = line.partition(b": ")
                headers[key.decode()] = value.decode()
            block = lines.read(int(headers["Content-Length"]))
            lines.read(4)
            yield headers, block


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files that the manifest names, with digests checked.

    Columns: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to.
    """
    fields = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ])
        system, base = opened(folder)
        for given in batches:
            for name in given.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                            raise ValueError(f"{name}: block digest of {headers['WARC-Record-ID']}")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        told = int(head.rpartition(b"Content-Length: ")[2])
                        known = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and (len(payload) != told or digest(payload) != known):
                            raise ValueError(f"{name}: payload of {headers['WARC-Record-ID']}")
                        rows.append({
                            "page_id": int(x) if (x := headers.get("X-Page-ID")) else None,
                            "url": headers.get("WARC-Target-URI"), "payload": payload if response else None,
                            "payload_bytes": told, "payload_digest": known, "record_type": headers["WARC-Type"],
                            "refers_to": int(x) if (x := headers.get("X-Refers-To-Page-ID")) else None,
                        })
                        held += len(block)
                        if held > 1 << 23 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("file").repartition(n, "file").mapInArrow(read, fields)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write to a new folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, **options), folder)
