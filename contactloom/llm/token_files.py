"""Token ids in flat binary files, in ascending order of document, with 64-bit document offsets.

A shard is a range of doc_ids of about SHARD_BYTES of text, however the ids lie. It is three files: ``tokens-<shard>.bin``, the ids as little-endian
unsigned integers of one width; ``offsets-<shard>.bin``, one little-endian unsigned 64-bit number
per document and one more at the end: where the document begins in the whole corpus, in ids; and
``docs-<shard>.bin``, the 64-bit doc_ids. A shard's own base is the sum of all shards before it, so the files of all shards in order
are one flat array that can be memory-mapped shard by shard.

Shards are written under names that only one attempt of a task uses. The rows of the attempts that
count are a table (the manifest), and files that it does not name are never read: a lost executor
or a repeated task leaves a file behind, not a wrong one. Bases are prefix sums over the manifest's
counts; a second pass of tasks writes the offsets with them and moves the ids to their final names.

Defined cases: null texts count as empty (only the end id); null ids come first, in shards of
their own, which texts are dealt to by hash; rows that repeat an id stand side by side, by text; an empty table gives no shards;
other columns are ignored.
"""

import os
import sys
import tempfile
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.storage import id_shards, opened, settle
from contactloom.llm.text import whole
from contactloom.llm.word_bpe import Remembered, chunks, groups, pieces, word_bpe
from contactloom.sources.shared import new_path, shared_table

#: Text bytes of a shard; it decides how many there are.
SHARD_BYTES = 64_000_000
RUN_BYTES = 1 << 17  # text whose new words are encoded together; its words should stay in the processor's cache
CACHE_WORDS, CACHE_CHUNKS = 400_000, 800_000
MANIFEST = "shard long, temporary string, n_docs long, n_tokens long"
#: What a task notes of each document of a shard, in order.
NOTE = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8")])


class Encoder:
    """Ids of whole texts as bytes; new words are encoded by the tokenizers library."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.bpe = word_bpe(path)
        library = Tokenizer.from_file(path)
        if library.get_vocab_size() - 1 > np.iinfo(dtype).max:
            raise ValueError(f"{dtype} is too small for {library.get_vocab_size()} ids")
        self.model, self.dtype = library.model, np.dtype(dtype).newbyteorder("<")
        self.special = {s: self._bytes([i]) for s, i in self.bpe.special.items()}
        self.words = Remembered(self._encode_words, CACHE_WORDS)
        self.chunks = Remembered(self._encode_chunks, CACHE_CHUNKS)

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array(self.dtype.char, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [self._bytes([t.id for t in self.model.tokenize(self.bpe.as_letters(w))]) for w in words]

    def _encode_chunks(self, new: list[str]) -> list[bytes]:
        out, places, words = [b""] * len(new), [], []
        for i, chunk in enumerate(new):
            if not chunk.isascii() and self.bpe.unfamiliar(chunk):
                out[i] = self._bytes(self.bpe.library_ids(chunk))
            elif "<|" in chunk:
                out[i] = b"".join(
                    b"".join(self.words.of(self.bpe.words(text))) + self.special.get(special, b"")
                    for text, special in self.bpe.segments(chunk)
                )
            else:
                places.append(i)
                words.append(self.bpe.words(chunk))
        self.words.learn(*words)
        ids = self.words.known
        for i, own in zip(places, words, strict=True):
            out[i] = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(self.chunks.of(chunks(p))) for p in pieces(text))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text; what is new in several texts is encoded together."""
        for run in groups(texts, RUN_BYTES):
            if len(run) == 1:
                yield self.encode(run[0])
            else:
                yield from (b"".join(ids) for ids in self.chunks.of_each([chunks(t) for t in run]))


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


def _write_shards(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, dtype: str, end_id: int
) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, id, text) rows -> files under temporary names, a manifest row for each shard."""
    own = encoder(path, dtype)
    end = own._bytes([end_id])
    system, base = opened(folder)
    shard = sink = notes = name = None
    n_docs = n_tokens = 0

    def done() -> pa.RecordBatch:
        sink.close()
        notes.close()
        return pa.RecordBatch.from_pydict({
            "shard": [shard], "temporary": [name], "n_docs": [n_docs], "n_tokens": [n_tokens],
        })

    for given in batches:
        shards, doc_ids = given.column(0).to_pylist(), given.column(1).to_pylist()
        texts = [t or "" for t in given.column(2).to_pylist()]
        for own_shard, doc_id, ids in zip(shards, doc_ids, own.encode_all(texts), strict=True):
            if sink is None or own_shard != shard:
                if sink is not None:
                    yield done()
                shard, n_docs, n_tokens = own_shard, 0, 0
                name = f"_temporary-{shard}-{uuid.uuid4().hex}"
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
                notes = system.open_output_stream(f"{base}/{name}-docs", compression=None)
            tokens = ids + end
            sink.write(tokens)
            length = len(tokens) // own.dtype.itemsize
            notes.write(np.array((doc_id or 0, length), NOTE).tobytes())
            n_docs, n_tokens = n_docs + 1, n_tokens + length
    if sink is not None:
        yield done()


def _finish_shards(frames: Iterator[pd.DataFrame], folder: str, dtype: str) -> Iterator[pd.DataFrame]:
    """Write ids and offsets of the documents and give all files their final names."""
    system, base = opened(folder)
    width = np.dtype(dtype).itemsize
    for frame in frames:
        for row in frame.itertuples(index=False):
            notes = mapped(folder, f"{row.temporary}-docs", NOTE)
            offsets = np.zeros(len(notes) + 1, "<u8")
            offsets[1:] = np.cumsum(notes["n_tokens"])
            offsets += np.uint64(row.base)
            for kind, array in (("offsets", offsets), ("docs", np.ascontiguousarray(notes["doc_id"]))):
                name = f"_temporary-{kind}-{row.shard}-{uuid.uuid4().hex}"
                with system.open_output_stream(f"{base}/{name}", compression=None) as sink:
                    sink.write(array.tobytes())
                settle(folder, name, f"{kind}-{row.shard:08d}.bin", array.nbytes)
            settle(folder, row.temporary, f"tokens-{row.shard:08d}.bin", row.n_tokens * width)
        yield frame[["shard", "base", "n_docs", "n_tokens"]]


def write_token_files(
    docs: DataFrame, path: str, folder: str, text: str = "text", id_col: str = "doc_id",
    end_id: int = 2, dtype: str = "uint16", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the shards into ``folder``; the manifest ``(shard, base, n_docs, n_tokens)``.

    Texts are shuffled once, by shard, and sorted inside their task. ``folder`` must be seen by all
    executors. The manifest is also stored as ``folder/manifest``, last of all.
    """
    spark = docs.sparkSession
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    shard, n = id_shards(docs, id_col, F.octet_length(whole(F.col(text))), shard_bytes, F.col(text))
    rows = docs.select(shard.alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sorted_rows = rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")
    written = shared_table(
        sorted_rows.mapInArrow(lambda b: _write_shards(b, folder, path, dtype, end_id), MANIFEST),
        "token-shards",
    )
    # One row per shard; the counts of all shards are summed in one place, nothing else.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    finished = written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest = finished.repartition(max(1, min(n, spark.sparkContext.defaultParallelism)), "shard").mapInPandas(
        lambda f: _finish_shards(f, folder, dtype), "shard long, base long, n_docs long, n_tokens long"
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file of the folder as an array: memory-mapped if it is local, else through a local copy."""
    system, base = opened(folder)
    if system.type_name == "local":
        path = f"{base}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(f"{base}/{name}", compression=None) as source:
        while part := source.read(1 << 22):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, dtype, "r") if copy.tell() else np.empty(0, dtype)


def read_token_files(manifest: DataFrame, folder: str, dtype: str = "uint16") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone.

    One row of the manifest is one shard to read; its documents come in parts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        little = np.dtype(dtype).newbyteorder("<")
        for given in batches:
            for shard, base in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                offsets = mapped(folder, f"offsets-{shard:08d}.bin", "<u8")
                doc_ids = mapped(folder, f"docs-{shard:08d}.bin", "<i8")
                tokens = mapped(folder, f"tokens-{shard:08d}.bin", little)
                if len(tokens) != int(offsets[-1]) - base or len(doc_ids) + 1 != len(offsets):
                    raise ValueError(f"shard {shard}: {len(tokens)} ids, {int(offsets[-1]) - base} by its offsets")
                for at in range(0, len(doc_ids), 10_000):
                    part = offsets[at : at + 10_001].astype(np.int64)
                    names = pa.array(doc_ids[at : at + 10_000])
                    crcs = [
                        zlib.crc32(tokens[a:b].astype("<u4").tobytes())
                        for a, b in zip(part[:-1] - base, part[1:] - base, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [names if shard >= 0 else pa.nulls(len(names), pa.int64()), pa.array(part[:-1]),
                         pa.array(np.diff(part)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.select("shard", "base").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(
    docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", end_id: int = 2,
    dtype: str = "uint16", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write to a new folder and read back: ``id_col``, start, n_tokens, ids_crc32."""
    folder = new_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, folder, text, id_col, end_id, dtype, shard_bytes)
    return read_token_files(manifest, folder, dtype).withColumnRenamed("doc_id", id_col)
