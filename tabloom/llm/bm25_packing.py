"""Lexical retrieval packing: a sharded BM25 index picks what shares a window.

1. Every text is encoded once; ids go to the shared folder with a lexical key
   (the document's largest ids: late merges, hence rare pieces).
2. Document frequencies of every id, and the mean length, over all documents
   (at most one row per id of the vocabulary, so they are safe to send around).
3. Documents are range-partitioned by (key, doc_id), which splits any hot key,
   and each partition is worked off in index shards of bounded size.
4. In a shard the first unused document is the seed; the inverted index gives
   its unused neighbours by BM25; they fill the seed's window greedily, best
   first, those that fit before one that must be cut.  A cut document goes on
   in the next window and is then its seed.
5. What is left at the end of a shard is cut into windows whose lengths are
   powers of two, so no sequence needs padding.

Defined results: null text counts as empty (one end id); repeated rows are
packed one by one; equal scores go by position in the shard; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, written
from .tokens import encoder, forget, groups, trim

#: BM25's usual constants.
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = "doc_id long, key long, n long, ids binary"


def _encode(batches, path: str, end_id: int):
    enc = encoder(path)
    for batch in batches:
        docs = batch["doc_id"]
        for a, b in groups(batch["text"]):
            ids, at = enc.encode(batch["text"].slice(a, b - a))
            sizes = np.diff(at) + 1
            flat = np.insert(ids, at[1:], enc.dtype.type(end_id))
            first = np.cumsum(sizes) - sizes
            most = np.maximum.reduceat(flat, first)
            second = np.maximum.reduceat(np.where(flat == np.repeat(most, sizes), 0, flat), first)
            ends = np.append(first, len(flat)) * enc.dtype.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": docs.slice(a, b - a), "key": pa.array(most.astype(np.int64) << 20 | second.astype(np.int64)), "n": pa.array(sizes), "ids": blobs})
            del ids, flat, blobs
        trim()


def _pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, int]:
    """The pairs of two columns of 32 bits at most as one column, sorted in place (an order beside it takes four times the memory), and the bits of the second."""
    bits = 16 if max(int(high.max(initial=0)), int(low.max(initial=0))) < 1 << 16 else 32
    both = high.astype(np.uint32 if bits == 16 else np.uint64)
    both <<= both.dtype.type(bits)
    both |= low.astype(both.dtype, copy=False)
    both.sort()
    return both, bits


def postings(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and count of every pair that occurs, by term and then document."""
    both, bits = _pairs(flat, np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes))
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    tf = np.diff(at, append=len(both)).astype(np.uint32)
    both = both[at]
    return (both >> both.dtype.type(bits)).astype(np.uint32, copy=False), (both & both.dtype.type((1 << bits) - 1)).astype(np.uint32, copy=False), tf


def _frequencies(batches, dtype: str, vocab: int):
    forget()
    df = np.zeros(vocab, np.int64)
    for batch in batches:
        for a, b in groups(batch["ids"]):
            blobs = [x.as_buffer() for x in batch["ids"].slice(a, b - a)]
            parts = [np.frombuffer(x, dtype) for x in blobs]
            df += np.bincount(postings(np.concatenate(parts), np.array([len(x) for x in parts]))[0], minlength=vocab)
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "df": pa.array(df[seen], pa.int64())})


class Shard:
    """Inverted index of one shard, with BM25 weights from counts over the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        lens = np.array([len(d) for d in docs])
        term, doc, tf = postings(np.concatenate(docs), lens)
        use = idf[term] > 0  # ids of half the corpus or more say nothing about a neighbour
        term, doc, tf = term[use], doc[use], tf[use]
        del use
        self.n = len(docs)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        self.at = np.append(first, len(term))
        # The terms of each document, by their number in the shard.
        number, bits = _pairs(doc, np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(self.at)))
        number &= number.dtype.type((1 << bits) - 1)
        self.doc_terms, self.doc_at = number.astype(np.uint32, copy=False), np.append(0, np.cumsum(np.bincount(doc, minlength=self.n)))
        # idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), with one other array of this size at a time.
        self.weight = idf[term] * tf.astype(np.float64)
        del term
        self.weight *= K1 + 1
        below = (K1 * (1 - B + B * lens / mean))[doc]
        below += tf
        self.weight /= below
        del below, tf
        self.doc = doc.astype(np.intp)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms as query."""
        q = self.doc_terms[self.doc_at[seed] : self.doc_at[seed + 1]]
        start, n = self.at[q], self.at[q + 1] - self.at[q]
        at = np.repeat(start - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Shard(docs, idf, mean)
    left = np.array([len(d) for d in docs])  # ids of each document not placed yet
    done = np.zeros(len(docs), np.int64)
    unused = np.ones(len(docs), bool)
    pieces, sequence, room, next_seed, current = [], 0, window, 0, -1
    total = int(left.sum())
    tail = total % window  # the ids of the windows that are not full
    full = total // window

    def place(d: int, n: int) -> None:
        nonlocal room
        pieces.append((d, int(done[d]), n, sequence, window - room))
        done[d] += n
        left[d] -= n
        room -= n

    while sequence < full:
        if current < 0:
            while not unused[next_seed]:
                next_seed += 1
            current = next_seed
            unused[current] = False
        place(current, min(room, int(left[current])))
        if not room:
            sequence, room = sequence + 1, window
            if not left[current]:
                current = -1
            continue
        order = None
        score = index.scores(current)
        current = -1
        cand = np.flatnonzero(unused)
        order = cand[np.lexsort((cand, -score[cand]))]
        for d in order:
            if left[d] <= room:
                unused[d] = False
                place(int(d), int(left[d]))
                if not room:
                    break
        if room:  # nothing whole fits: the best neighbour left is cut here and goes on
            current = int(next(d for d in order if unused[d]))
            unused[current] = False
            place(current, room)
        sequence, room = sequence + 1, window
        if current >= 0 and not left[current]:
            current = -1
    # The rest, in windows of the powers of two that its length is made of.
    rest = ([current] if current >= 0 else []) + [int(d) for d in np.flatnonzero(unused)]
    sizes = [1 << k for k in range(window.bit_length(), -1, -1) if tail >> k & 1]
    for size in sizes:
        at = 0
        while at < size:
            d = rest[0]
            n = min(size - at, int(left[d]))
            pieces.append((d, int(done[d]), n, sequence, at))
            done[d] += n
            left[d] -= n
            at += n
            if not left[d]:
                rest.pop(0)
        sequence += 1
    return pieces


def _pack(batches, dtype: str, window: int, shard_docs: int, shard_ids: int, idf_of, mean: float):
    from pyspark import TaskContext

    forget()
    idf = idf_of.value
    base = TaskContext.get().partitionId() << 32
    held, size, sequence = [], 0, 0
    for batch in batches:
        for doc, blob in zip(batch["doc_id"].to_pylist(), batch["ids"]):
            held.append((doc, np.frombuffer(blob.as_py(), dtype)))
            size += len(held[-1][1])
            if len(held) >= shard_docs or size >= shard_ids:
                out, sequence = _shard(held, idf, mean, window, base, sequence)
                held, size = [], 0
                yield out
                trim()
    if held:
        yield _shard(held, idf, mean, window, base, sequence)[0]


def _shard(held, idf, mean, window, base, sequence):
    docs = [ids for _, ids in held]
    pieces = pack_shard(docs, idf, mean, window)
    crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
    d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces))
    lens = np.array([len(x) for x in docs], np.int64)
    cols = [pa.array([held[i][0] for i in d], pa.int64()), s, n, np.array(crc, np.int64), lens[d], base + sequence + q, o]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[x.split()[0] for x in PIECE.split(", ")]), sequence + int(q.max()) + 1


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, shard_docs: int = 1024, shard_ids: int = 4_000_000, partitions: int | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    ship_package(spark)
    enc = encoder(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = written(rows.mapInArrow(partial(_encode, path=path, end_id=end_id), ENCODED), "ids")
    dtype = enc.dtype.str
    total = coded.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    # One row per id of the vocabulary at most: bounded, whatever the corpus.
    seen = coded.select("ids").mapInArrow(partial(_frequencies, dtype=dtype, vocab=enc.vocab), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(enc.vocab)
    for r in seen:
        df[r["id"]] = r["df"]
    idf = np.maximum(0, np.log((total["n"] - df + 0.5) / (df + 0.5))).astype(np.float32)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    return dealt.mapInArrow(partial(_pack, dtype=dtype, window=window, shard_docs=shard_docs, shard_ids=shard_ids, idf_of=spark.sparkContext.broadcast(idf), mean=total["mean"] or 1.0), PIECE)
