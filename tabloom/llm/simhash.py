"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits.  For at most ``d`` differing bits it is cut into
``d // 2 + 1`` segments: then one segment differs by one bit at most.  Each
segment is indexed under every variant with one wildcard bit, so two such
segments share a variant; an equality join (here: a shuffle by variant, the
members of a variant side by side) finds the pairs, and the whole fingerprints
verify them.  With d = 4 there are 3 segments and 64 variants.

* Equal fingerprints are one node, so copies never meet each other.
* The members of a variant are linked by a spanning forest, found by growing
  components over the members not yet reached: a dense group gives one link a
  member, never all its pairs.  Variants with more than ``max_bucket`` members
  are dealt into pairs of blocks, which together still compare everything.
* Components of the links: smallest identifiers spread along links, with
  pointer jumping, in the shared folder; nothing is collected.

Cost: texts are read once; 64 narrow rows a different fingerprint.  Random
fingerprints meet by chance n^2 / 2^21 times or so, cheap word operations.

Defined results: null text counts as empty; texts without a word have
fingerprint zero and are linked like any other; rows of one doc_id each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, dropped, join_counted, ship_package, without, written

#: Fingerprints of one variant that a task compares; larger variants are dealt into pairs of blocks.
MAX_BUCKET = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text (see the module's text)."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), seed), "big")
    buf = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    starts, ends = at[: len(words) - shingle + 1].tolist(), (at[shingle:] - 1).tolist()
    counts, total = np.zeros(64, np.int64), len(starts)
    for i in range(0, total, 1 << 16):
        raw = b"".join([xxh64_digest(buf[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])])
        counts += _bit_counts(np.frombuffer(raw, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (8 bytes each) set each of 64 bits, most significant first.

    Bytes are counted by value, then each value's bits: 256 counters a byte
    are cheaper than 8 additions a byte.
    """
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return np.concatenate([np.bincount(rows[:, k], minlength=256) @ bits for k in range(8)])


def _fingerprints(batches, shingle: int, seed: int):
    for batch in batches:
        fps = [fingerprint(t.as_py(), shingle, seed) for t in batch["text"]]
        cols = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in cols), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*cols, "fp"])


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, from the least significant bit."""
    k = distance // 2 + 1
    cuts = [64 * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(distance: int):
    """Array column of the one-wildcard variants of ``fp``: wildcard number above, the other bits of its segment below."""
    out, number = [], 0
    for first, size in segments(distance):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        for bit in range(size):
            rest = part.bitwiseAND(F.lit(((1 << size) - 1) ^ (1 << bit)).cast("long"))
            out.append(rest.bitwiseOR(F.lit(number << 33).cast("long")))
            number += 1
    return F.array(*out)


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (verified) that connect exactly what all pairs within ``distance`` connect."""
    fps = fps.view(np.uint64)
    links, rest = [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block = front[:256]
            front = front[256:]
            hit = np.full(len(rest), -1)
            for i in range(0, len(rest), 65536):
                near = np.bitwise_count(rest[None, i : i + 65536] ^ block[:, None]) <= distance
                some = near.any(axis=0)
                hit[i : i + 65536][some] = near.argmax(axis=0)[some]
            got = hit >= 0
            if got.any():
                links += zip(block[hit[got]].view(np.int64).tolist(), rest[got].view(np.int64).tolist())
                front, rest = np.concatenate([front, rest[got]]), rest[~got]
    return links


def _links(batches, distance: int):
    """Sorted (key, fp) rows in, links out; a key's members are held, 8 bytes each."""
    key, held, out = None, [], []

    def close():
        fps = np.unique(np.concatenate(held))
        if len(fps) == 2:  # by far the most frequent case
            if int(fps[0] ^ fps[1]) & ((1 << 64) - 1) and (int(fps[0] ^ fps[1]) & ((1 << 64) - 1)).bit_count() <= distance:
                out.append((int(fps[0]), int(fps[1])))
        elif len(fps) > 2:
            out.extend(spanning(fps, distance))

    def rows(pairs):
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for s, e in zip(edges, edges[1:]):
            if keys[s] != key:
                if len(held) > 1 or (held and len(held[0]) > 1):
                    close()
                key, held = keys[s], []
            held.append(fps[s:e])
        if len(out) > 50_000:
            yield rows(out)
            out = []
    if len(held) > 1 or (held and len(held[0]) > 1):
        close()
    yield rows(out)


def similarity_links(nodes: DataFrame, distance: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all within ``distance``."""
    n = nodes.count()
    keyed = nodes.select("fp", F.explode(variants(distance)).alias("key"))
    if n > max_bucket:  # else no variant can have more members than there are fingerprints
        large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_bucket), "large")
        split = keyed.join(large, "key", "left").withColumn("k", F.coalesce(F.ceil(2 * F.col("m") / max_bucket), F.lit(1)).cast("long"))
        split = split.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        pair = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        keyed = split.select("fp", pair.alias("key"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(partial(_links, distance=distance), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id): smallest ``id`` reachable.  nodes: fp, id; links: a, b.

    Each round hooks a component's label to the smallest label next to it and
    then jumps pointers, so rounds grow with the logarithm of a chain.
    """
    linked = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp"))).distinct()
    labels = written(nodes.join(linked, "fp", "left_semi").select("fp", F.col("id").alias("label")), "labels")
    edges = links
    start = labels
    # Work on labels from here on: an edge joins two labels.
    pairs = edges.join(start.select(F.col("fp").alias("a"), F.col("label").alias("la")), "a").join(start.select(F.col("fp").alias("b"), F.col("label").alias("lb")), "b")
    pairs = written(pairs.select("la", "lb").where("la <> lb").distinct(), "pairs")
    parent = written(start.select("label", F.col("label").alias("root")).distinct(), "parent")
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        low = both.groupBy("la").agg(F.min("lb").alias("low")).select("la", F.least("la", "low").alias("up"))
        low = written(low, "low")
        jump = low.join(low.select(F.col("la").alias("up"), F.col("up").alias("up2")), "up", "left")
        low = written(jump.select("la", F.coalesce("up2", "up").alias("up")), "jump")
        parent = parent.join(low.select(F.col("la").alias("root"), "up"), "root", "left").select("label", F.coalesce("up", "root").alias("root"))
        parent = written(parent, "parent")
        left = pairs.join(low.select("la", F.col("up").alias("ua")), "la").join(low.select(F.col("la").alias("lb"), F.col("up").alias("ub")), "lb")
        pairs = written(left.select(F.col("ua").alias("la"), F.col("ub").alias("lb")).where("la <> lb").distinct(), "pairs")
    return start.join(parent, "label").select("fp", F.col("root").alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return _grouped(docs, distance, shingle, seed, max_bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp, root (the smallest fingerprint of the group), component_id (its smallest doc_id), and the key of rows that have one.

    Groups are found by fingerprint: identifiers may be null or repeat.
    """
    ship_package(docs.sparkSession)
    key = [ROW] if ROW in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    prints = written(rows.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "doc_id long, " + "".join(c + " binary, " for c in key) + "fp long"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "nodes")
    comp = components(nodes.select("fp", F.col("fp").alias("id")), written(similarity_links(nodes, distance, max_bucket), "links")).withColumnRenamed("component_id", "root")
    comp = written(nodes.join(comp, "fp", "left").select("fp", "id", "rows", F.coalesce("root", "fp").alias("root")), "groups")
    roots = written(comp.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")), "roots")
    comp = written(join_counted(comp.drop("id"), roots, "root", "members", comp.count()).drop("members"), "components")
    return join_counted(prints, comp, "fp", "rows", prints.count()).drop("rows")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of each group (of equal ones the first row), with their own columns."""
    return without(docs, lambda rows: dropped(written(_grouped(rows, **options), "grouped"), ["root"], F.col("doc_id").eqNullSafe(F.col("component_id"))))
