"""Rectangle joins by row buckets.

A bare overlap condition makes Spark compare every pair.  Here each rectangle
is listed under the buckets of rows it touches, buckets join by equality, the
exact overlap is the rest of the condition, and a pair is kept in the first
bucket both touch only, so it comes once.  Rectangles over more than ``tall``
buckets (whole columns) would be listed too often; they go into coarser
buckets, a level for each power of ``tall``, so no rectangle is listed more
than ``tall`` + 1 times at its own level and no side is broadcast unchecked.
At coarser levels a rectangle is a guest: it meets those at home there, never
another guest, so candidates grow with the rectangles that share a bucket of
their own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.a1 import MAX_ROWS, RECT, intersects

BUCKET, TALL = 16, 16


def _levels(bucket: int, tall: int) -> list[int]:
    sizes = [bucket]
    while sizes[-1] * tall < MAX_ROWS:
        sizes.append(sizes[-1] * tall)
    return sizes


def _level(prefix: str, sizes: list[int], tall: int) -> Column:
    """The finest level at which the rectangle touches few buckets."""
    high = F.col(prefix + "row_max") - F.col(prefix + "row_min") + 1
    out = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        out = F.when(high <= sizes[k] * tall, k).otherwise(out)
    return out


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET, tall: int = TALL) -> DataFrame:
    """All pairs of overlapping rectangles with equal ``keys``.

    ``left`` has columns l_row_min.., ``right`` r_row_min..; the result has all
    columns of both and the keys once.
    """
    sizes = _levels(bucket, tall)
    out = None
    for l, r in ((_listed(left, "l_", sizes, tall, False), _listed(right, "r_", sizes, tall, None)), (_listed(left, "l_", sizes, tall, True), _listed(right, "r_", sizes, tall, False))):
        both = candidates(l, r, keys, sizes).where(intersects("l_", "r_")).drop("__level", "__bucket")
        out = both if out is None else out.unionByName(both)
    return out


def _listed(df: DataFrame, p: str, sizes: list[int], tall: int, guests: bool | None) -> DataFrame:
    """Rectangles under (level, bucket): at home, as guests of coarser levels, or both."""
    own, last = _level(p, sizes, tall), F.lit(len(sizes) - 1)
    if guests is None:
        at = F.sequence(own, last)
    elif guests:
        at = F.when(own < last, F.sequence(F.least(own + 1, last), last))
    else:
        at = F.array(own)
    df = df.select("*", F.explode(at).alias("__level"))
    size = F.get(F.array(*map(F.lit, sizes)), F.col("__level"))
    span = F.sequence(F.floor((F.col(p + "row_min") - 1) / size), F.floor((F.col(p + "row_max") - 1) / size))
    return df.select("*", F.explode(span).alias("__bucket"))


def candidates(l: DataFrame, r: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """Pairs that share a bucket, in the first that both touch."""
    size = F.get(F.array(*map(F.lit, sizes)), F.col("__level"))
    first = F.floor((F.greatest("l_row_min", "r_row_min") - 1) / size)
    return l.join(r, [*keys, "__level", "__bucket"]).where(F.col("__bucket") == first)


def prefixed(df: DataFrame, p: str, others: dict[str, str] | None = None) -> DataFrame:
    """Rectangle bounds renamed with a prefix, other columns by the map."""
    others = others or {}
    return df.select(*(F.col(c).alias(p + c if c in RECT else others.get(c, c)) for c in df.columns))


def points(cells: DataFrame, p: str) -> DataFrame:
    """Cells as 1 by 1 rectangles with a prefix."""
    return cells.withColumns({p + "row_min": F.col("row"), p + "row_max": F.col("row"), p + "col_min": F.col("col"), p + "col_max": F.col("col")})


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Left rectangles that overlap some right one (left_semi) or none (left_anti), by their ``id``."""
    hit = overlap_join(prefixed(left.select("id", *keys, *RECT), "l_"), prefixed(right.select(*keys, *RECT), "r_"), keys).select("id").distinct()
    return left.join(hit, "id", how)
