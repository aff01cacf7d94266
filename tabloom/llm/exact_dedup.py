"""Exact deduplication through a log-structured merge index of text digests.

Life of the index, every step a DataFrame or SQL plan:

* **memtable** - the rows one task holds; each (digest, doc_id) is narrow;
* **flush** - the memtable is sorted by digest and written as one run (a
  Parquet file sorted by digest, with min/max statistics and a Parquet Bloom
  filter on the digest), at level 0;
* **compaction** - ``fan_in`` runs at a time merge into one of the next level;
  of equal digests the smallest identifier and the number of rows survive;
* **hits** - digests with more than one row.  A bitmap filter of the hits, 16
  bits a hit up to 4 MB (beyond that it prunes less), keeps other texts from
  the comparison;
* **verification** - texts of hits are compared byte for byte: rows group by
  (digest, normalised text), copies collapsing map-side, so that a digest
  shared by different texts is split again.

Defined results: null text counts as empty; rows of the same doc_id and text
share one decision (``dedup_documents`` keeps the first of them); a null doc_id
never stays while its class has another identifier; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, WS_CLASS, dropped, join_counted, scratch_path, short_batches, whole_text, without, written

#: 64-bit words of the hit filter, at least and at most (4 MB).
FILTER_WORDS = 1 << 10, 1 << 19


def normalised(col: str = "text") -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(whole_text(col), WS_CLASS + "+", " ")


class DigestIndex:
    """LSM index of digests in a shared folder; ``digest_bytes`` < 32 is for tests of verification."""

    def __init__(self, spark, fan_in: int = 256, digest_bytes: int = 32, run_ndv: int = 1 << 16):
        self.spark, self.fan_in, self.run_ndv = spark, fan_in, run_ndv
        self.hex = 2 * digest_bytes
        short_batches(spark)
        self.root = scratch_path(spark, "lsm")
        self.levels: list[str] = []
        self.batches = 0

    def key(self, sha: Column) -> Column:
        return F.unhex(F.substring(sha, 1, self.hex))

    def _flush(self, df: DataFrame, path: str) -> DataFrame:
        (
            df.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(self.run_ndv))
            .parquet(path)
        )
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, docs: DataFrame) -> DataFrame:
        """Flush the memtables of one batch; gives its level-0 runs (digest, doc_id, run, sha, and the rows' keys if they have any)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row(docs), F.sha2(normalised().cast("binary"), 256).alias("sha"))
        rows = rows.select("doc_id", *_row(docs), self.key(F.col("sha")).alias("digest"), F.unhex("sha").alias("sha"), F.spark_partition_id().alias("run"))
        path = f"{self.root}/level0/batch={self.batches}"
        out = self._flush(rows, path)
        self.levels.append(path)
        self.batches += 1
        return out

    def runs(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/level0").parquet(*self.levels)

    def compact(self) -> DataFrame:
        """Merge levels of runs until one is left: (digest, keep_id, n)."""
        level = self.runs().select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), (F.col("run") + 1000003 * F.col("batch")).cast("long").alias("run"))
        runs, step = level.agg(F.max("run")).first()[0] or 0, 0
        runs = 0 if self.batches == 0 else runs + 1
        while True:
            step += 1
            last = runs <= self.fan_in
            level = level.withColumn("run", F.lit(0).cast("long") if last else F.floor(F.col("run") / self.fan_in))
            level = level.groupBy("run", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            level = self._flush(level, f"{self.root}/level{step}")
            if last:
                return level.drop("run")
            runs = (runs + self.fan_in - 1) // self.fan_in

    def find(self, sha256: str) -> DataFrame:
        """Rows of one digest in the runs, for a text that arrives later; runs whose filter or range excludes it are skipped."""
        digest = bytes.fromhex(sha256[: self.hex])
        return self.runs().where(F.col("digest") == F.lit(digest)).select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"))


def filter_words(hits: int) -> int:
    """16 bits a hit, a power of two within FILTER_WORDS."""
    low, high = FILTER_WORDS
    return min(high, max(low, 1 << (hits // 4).bit_length()))


def _slot(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(64 * words))


def hit_filter(hits: DataFrame, words: int) -> DataFrame:
    """One row: ``words``, a bitmap of that many longs.  Full bitmaps prune nothing but stay right."""
    slot = _slot(F.col("digest"), words)
    bits = hits.select((slot / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("b"))
    bits = bits.groupBy("w").agg(F.bit_or("b").alias("b"))
    filled = hits.sparkSession.range(words).withColumnRenamed("id", "w").join(bits, "w", "left")
    packed = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return filled.agg(F.transform(packed, lambda s: s["b"]).alias("words"))


def _row(df: DataFrame) -> list[str]:
    return [ROW] if ROW in df.columns else []


def exact_dedup(docs: DataFrame, fan_in: int = 256, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and the key of rows that have one)."""
    index = DigestIndex(docs.sparkSession, fan_in, digest_bytes)
    runs = index.append(docs)
    hits = written(index.compact().where("n > 1"), "hits")
    # Byte verification: only texts that pass the filter move, and copies collapse before they do.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row(docs), normalised().alias("norm"))
    text = text.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    text = text.withColumn("digest", index.key(F.col("sha")))
    same = _passing(text, hits).groupBy("digest", "sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    same = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.max("n").alias("n"))
    verified = written(same.where("texts > 1 or n > 1"), "verified")
    out = join_counted(runs, verified.where("texts = 1").drop("texts"), "digest", "n", runs.count())
    mixed = verified.where("texts > 1").select("digest")
    if mixed.isEmpty():
        return _decisions(out)
    # Different texts under one digest: these rows, and only these, are matched by their bytes.
    apart = _passing(text, mixed).join(mixed, "digest", "left_semi")
    classes = apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    apart = apart.join(classes, ["digest", "norm"]).withColumn("sha", F.unhex("sha"))
    return _decisions(out.join(mixed, "digest", "left_anti")).unionByName(_decisions(apart))


def _passing(text: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest may be among ``hits``: no false negatives, few false positives."""
    n = filter_words(hits.count())
    words = written(hit_filter(hits, n), "filter").scalar()
    slot = _slot(F.col("digest"), n)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    return text.where(F.get(words, (slot / 64).cast("int")).bitwiseAND(bit) != 0)


def _decisions(rows: DataFrame) -> DataFrame:
    keep = F.coalesce("keep_id", "doc_id")
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *_row(rows),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each text, with their own columns; of equal identifiers (or nulls) the first row stays."""
    return without(docs, lambda rows: dropped(written(exact_dedup(rows), "decisions"), ["text_sha256", "keep_id"], F.col("kept")))
