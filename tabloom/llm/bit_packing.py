"""Token ids in fixed-width bit-packed files with block offsets.

File format (little-endian), one file per range of doc_id::

    magic b"TBPK1\\0\\0\\0" | payload | index | footer
    payload  blocks of BLOCK ids, each id in ``width`` bits, least significant
             bit first, a block padded to whole 64-bit words
    index    uint64 arrays: block offsets (bytes), doc ids (as int64),
             document starts (ids before it in the file; one more at the end)
    footer   width, ids, blocks, documents, index offset (uint64 each) | magic

``width`` is the minimum for the vocabulary.  Any block unpacks alone
(vectorised, numpy), so a range of ids is read without the rest.

Defined results: null text counts as empty (one end id); repeated doc_ids are
written one after another; rows of null doc_id come first; an empty table
gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, file_parts, scratch_path, ship_package, written
from .tokens import encoder, groups, trim

MAGIC = b"TBPK1\0\0\0"
#: Ids of one block: a multiple of 64, so blocks of any width fill whole words.
BLOCK = 4096


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, padded with zeros to a whole number of 64-bit words."""
    n = -(-len(ids) // 64) * 64
    padded = np.zeros(n, np.uint32)
    padded[: len(ids)] = ids
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 4), axis=1, bitorder="little", count=width)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole.reshape(-1), bitorder="little").view("<u4").copy()


class Writer:
    """Streams ids into one file; holds a block and the index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.held, self.n_held = [], 0
        self.blocks, self.docs, self.starts, self.n, self.at = [], [], [], 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            data = pack_bits(ids[i : min(i + BLOCK, full)], self.width)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.blocks, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array([*self.starts, self.n], "<u8").tobytes()
        self.out.write(index)
        self.out.write(np.array([self.width, self.n, len(self.blocks), len(self.docs), self.at], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to one file: ``source`` needs seek and read only."""

    def __init__(self, source, size: int):
        self.f = source
        tail = self._at(size - 48, 48)
        if tail[40:] != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.width, self.n, blocks, docs, at = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        index = self._at(at, size - 48 - at)
        self.blocks = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at)).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 * (blocks + docs)).astype(np.int64)

    def _at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file; reads only their blocks."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        data = self._at(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        first = a * BLOCK
        return unpack_bits(data, self.width, min(self.n, b * BLOCK) - first)[start - first : stop - first]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) in file order, some blocks at a time."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + 64 * BLOCK, "right")) - 1)
            j = min(j, len(self.docs))
            got, base = self.ids(int(self.starts[i]), int(self.starts[j])), self.starts[i]
            for k in range(i, j):
                yield int(self.docs[k]), int(self.starts[k]), got[self.starts[k] - base : self.starts[k + 1] - base]
            i = j


def open_store(uri: str):
    """File system and path of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


#: Stands for a null doc_id inside a file.
NULL_ID = -(1 << 63)


def _write(batches, folder: str, path: str, end_id: int):
    """One file per task, under a name of its own: a task that runs twice leaves two, and one manifest row."""
    enc = writer = None
    store, root = open_store(folder)
    name = f"{uuid.uuid4().hex}.tbpk"
    end = None
    first = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            enc = encoder(path)
            store.create_dir(root, recursive=True)
            writer = Writer(store.open_output_stream(f"{root}/{name}"), bits_for(enc.vocab))
            end, first = np.array([end_id], enc.dtype), batch["doc_id"][0].as_py()
        docs = batch["doc_id"].to_pylist()
        for a, b in groups(batch["text"]):
            ids, at = enc.encode(batch["text"].slice(a, b - a))
            for i in range(b - a):
                writer.add(NULL_ID if docs[a + i] is None else docs[a + i], np.concatenate([ids[at[i] : at[i + 1]], end]))
        trim()
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "shard": pa.array([NULL_ID if first is None else first], pa.int64()), "n_docs": [len(writer.docs)], "n_tokens": [writer.n]})


def _read(batches, folder: str):
    store, root = open_store(folder)
    for batch in batches:
        for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
            with store.open_input_file(f"{root}/{name}") as f:
                rows = []
                for doc, start, ids in Reader(f, f.size()).documents():
                    rows.append((None if doc == NULL_ID else doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 20_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write the files in ascending doc_id order; gives the manifest (file, shard, n_docs, n_tokens)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or file_parts(docs)
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id), "file string, shard long, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    # One row per file; their running sum needs one task, and files are of bounded number (the partitions written).
    files = manifest.collect()
    at, rows = 0, []
    for f in sorted(files, key=lambda r: (r["shard"], r["file"])):
        rows.append((f["file"], at))
        at += f["n_tokens"]
    spark = manifest.sparkSession
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "file string, base long")
    return listed.mapInArrow(partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, path: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end_id, partitions), folder)


def remove_tokens(spark, folder: str) -> None:
    drop_path(spark, folder)
