"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one expected number of copies r = target / size,
between 0 and 2: floor(r) copies are sure, the fraction is the probability of
one more.  The pivotal method makes these probabilities integral: two open
documents exchange mass (probability times size, so that the expected words do
not change), up or down at random with the chances that keep every document's
probability, until one of the two is at 0 or 1.

Distribution: documents are dealt by (source, size class, hashed block) into
blocks of bounded size, so a hot source is many blocks.  A block leaves one
open document; blocks of residuals merge ``fan_in`` at a time up a tree until
one document is open in each size class (powers of two) of a source.  These
few are rounded from large to small so that the source's total ends nearest
its target: the smaller ones make up for the larger ones.

Randomness comes from hashes of (seed, source, class, block), documents are
worked off in the order of doc_id: reruns agree whatever the partitioning.

Defined results: null text has size 0 and takes 0; null is a source of its own
(the last); rows of one doc_id are documents of their own; a source without
words has target 0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD_CLASS, keyed, scratch_path, ship_package, whole_text, written

#: Weights by rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
EPS = 1e-9
#: A row key holds the number of the part that its row was written in above these bits.
PART_BITS = 33
STATE = "row_id long, doc_id long, source string, size long, ratio double, class int, block long, p double, copies long, open boolean"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> the same with target.

    Resharing the excess of capped sources by weight until none is above its
    cap ends where every target is min(cap, level * weight).  The level is
    found in closed form: sources in the order of cap / weight, with running
    sums; the first source that stays under its cap fixes it.
    """
    everything = Window.partitionBy()
    by_code_point = everything.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(by_code_point) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.col("all") - capped) / weight_left)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.max(fits).over(everything))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``p`` in place, keeping sum(p * w); gives the position left open, or -1.

    A probability ends at exactly 0 or 1; w > 0.
    """
    open_at = -1
    draw = rng.random(len(p))
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        up = min((1 - p[i]) * w[i], p[j] * w[j])  # mass from j to i at most
        down = min(p[i] * w[i], (1 - p[j]) * w[j])  # mass from i to j at most
        move = up if draw[i] < down / (up + down) else -down
        p[i] += move / w[i]
        p[j] -= move / w[j]
        for k in (i, j):
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = round(p[k])
        if 0 < p[i] < 1:
            open_at = i
        elif not 0 < p[j] < 1:
            open_at = -1
    return open_at


def _round_block(key, pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    source, cls, block = key
    pdf = pdf.sort_values(["doc_id", "size", "row_id"], kind="stable")
    rng = np.random.default_rng(zlib.crc32(repr((seed, level, source, int(cls), int(block))).encode()))
    p = pdf["p"].to_numpy(copy=True)
    left = pivot(p, pdf["size"].to_numpy(dtype=float), rng)
    still = np.zeros(len(p), bool)
    if left >= 0:
        still[left] = True
    return pdf.assign(p=p, open=still, copies=pdf["copies"].to_numpy() + np.where(still, 0, np.rint(p)).astype(np.int64))


def _round_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """One open document a size class: of all ways to round them, the one that ends nearest the target.

    There are at most as many classes as bits in a size; beyond 16 the largest
    documents are rounded to the nearer side first.
    """
    pdf = pdf.sort_values(["size", "doc_id", "row_id"], ascending=[False, True, True], kind="stable")
    due, take = 0.0, []
    p, w = pdf["p"].to_numpy(), pdf["size"].to_numpy(dtype=float)
    for k in range(max(0, len(p) - 16)):
        one = due + p[k] * w[k] - w[k] >= -w[k] / 2
        due += p[k] * w[k] - (w[k] if one else 0)
        take.append(int(one))
    p, w = p[len(take) :], w[len(take) :]
    due += float((p * w).sum())
    ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    take += ways[np.abs(ways @ w - due).argmin()].tolist()
    return pdf.assign(copies=pdf["copies"].to_numpy() + np.array(take, np.int64), open=False)


def mix(docs: DataFrame, seed: int = 17, block_docs: int = 2048, fan_in: int = 64, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (and row_id, source)."""
    spark = docs.sparkSession
    ship_package(spark)
    size = F.regexp_count(whole_text(), F.lit(WORD_CLASS)).cast("long")
    key = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = written(docs.select(key.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(targets(per_source, **how).withColumnRenamed("source", "__source"), "targets")
    # The size of ``goal`` is known to Spark, which broadcasts it if small and else joins by shuffle.
    per_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")).otherwise(-1)
    every = rows.join(goal, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    every = every.withColumn("class", per_class).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    blocks = rows.groupBy("source", per_class.alias("class")).agg(F.ceil(F.count(F.lit(1)) / block_docs).alias("blocks"))
    blocks = written(blocks.select(F.col("source").alias("__source"), F.col("class").alias("__class"), "blocks"), "blocks")
    known = every.join(blocks, F.col("source").eqNullSafe(F.col("__source")) & (F.col("class") == F.col("__class")))
    sure = F.floor(F.col("ratio") + EPS).cast("long")
    state = known.select(
        "row_id", "doc_id", "source", "size", "ratio", "class",
        F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).alias("block"),
        F.greatest(F.lit(0.0), F.col("ratio") - sure).alias("p"),
        sure.alias("copies"),
        (F.col("size") > 0).alias("open"),
    )
    done = [state.where("not open")]
    level, width = 0, blocks.agg(F.max("blocks")).first()[0] or 0
    todo = state.where("open")
    while width:
        step = written(todo.groupBy("source", "class", "block").applyInPandas(partial(_round_block, seed=seed, level=level), STATE), f"level{level}")
        done.append(step.where("not open"))
        todo = step.where("open").withColumn("block", F.floor(F.col("block") / fan_in))
        if width == 1:
            break
        width = (width + fan_in - 1) // fan_in
        level += 1
    if width:
        done.append(todo.groupBy("source").applyInPandas(_round_rest, STATE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.join(goal, F.col("source").eqNullSafe(F.col("__source")), "inner")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "row_id")


def _copied(batches, folder: str):
    """Rows as often as the plan of their own part of the table says; a task holds the plan of one part."""
    from pyarrow import parquet

    from .bit_packing import open_store

    store, root = open_store(folder)
    part, first, times = None, 0, None
    for batch in batches:
        ids = batch[ROW].to_numpy()
        body = batch.select([c for c in batch.schema.names if c != ROW])
        cuts = np.flatnonzero(np.diff(ids >> PART_BITS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            if ids[a] >> PART_BITS != part:
                part = int(ids[a] >> PART_BITS)
                plan = parquet.read_table(f"{root}/part={part}", columns=["row_id", "times"], filesystem=store, partitioning=None)
                known, many = plan["row_id"].to_numpy(), plan["times"].to_numpy()
                first, times = int(known.min()), np.zeros(int(known.max() - known.min()) + 1, np.int64)
                times[known - first] = many
            yield body.take(pa.array(np.repeat(np.arange(a, b), times[ids[a:b] - first])))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    The plan (key and copies of each row) is dealt by the part of the table that
    a row was written in, and each task reads the plan of its own part: texts
    never move.  Documents without words have nothing to repeat and stay once.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("long")
    plan = mix(rows, **options).select("row_id", times.alias("times"), F.shiftright("row_id", PART_BITS).alias("part"))
    folder = scratch_path(spark, "copies")
    plan.repartition("part").write.partitionBy("part").parquet(folder)
    return rows.mapInArrow(partial(_copied, folder=folder), docs.schema)
