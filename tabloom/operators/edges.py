"""Dependency edges of blocks: references extruded over rectangles, names, 3-D ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.a1 import MAX_COLS, MAX_ROWS, RECT


def _axis(refs: str, lo: str, hi: str, most: int) -> tuple[Column, Column]:
    """Bounds of one axis over a block: a relative term moves with the block, an absolute one stays."""
    ends = []
    for end in ("1", "2"):
        rel, v = F.col(f"{refs}{end}_rel"), F.col(f"{refs}{end}")
        ends += [F.when(rel, F.col(lo) + v).otherwise(v), F.when(rel, F.col(hi) + v).otherwise(v)]
    low, high = F.least(*ends), F.greatest(*ends)
    return F.greatest(low, F.lit(1)), F.least(high, F.lit(most))


def extrude(refs: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """Destination rectangles of references over their block.

    refs has the block's rectangle (row_min ..) and, for each axis, two terms:
    row1, row1_rel, row2, row2_rel, col1, ... (offset if relative, else the
    value).  The union over all cells of the block is the box of the ends,
    clamped to a sheet ``rows`` high; an empty box is an unresolved reference (nulls).
    """
    r1, r2 = _axis("row", "row_min", "row_max", rows)
    c1, c2 = _axis("col", "col_min", "col_max", MAX_COLS)
    ok = (r1 <= r2) & (c1 <= c2)
    return refs.withColumns({"dst_row_min": F.when(ok, r1.cast("int")), "dst_row_max": F.when(ok, r2.cast("int")), "dst_col_min": F.when(ok, c1.cast("int")), "dst_col_max": F.when(ok, c2.cast("int"))})


def expand_sheets(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """3-D references: one row for each sheet between the two named ones, in either direction.

    refs: first, last (sheet names); sheets: sheet_id, name, position.  The
    sheet catalog is joined on names, then by a sequence of positions, so no
    range condition is left for the join.
    """
    at = lambda n: sheets.select(F.col("name").alias(n), F.col("position").alias(f"__{n}"))
    got = refs.join(at("first"), "first").join(at("last"), "last")
    got = got.withColumn("position", F.explode(F.sequence(F.least("__first", "__last"), F.greatest("__first", "__last"))))
    return got.drop("__first", "__last").join(sheets.select("position", F.col("sheet_id").alias("dst_sheet_id"), F.col("name").alias("dst_sheet")), "position").drop("position")


def resolve_names(uses: DataFrame, names: DataFrame) -> DataFrame:
    """Sheet scope before workbook scope, case-insensitive.  uses: sheet_id, name; names: scope_sheet_id, name, kind, refers_to."""
    n = names.withColumn("__k", F.lower("name"))
    local = n.where("scope_sheet_id IS NOT NULL").select(F.col("scope_sheet_id").alias("sheet_id"), "__k", F.struct(F.col("name").alias("defined"), "kind", "refers_to", F.lit("sheet").alias("scope")).alias("__l"))
    book = n.where("scope_sheet_id IS NULL").select("__k", F.struct(F.col("name").alias("defined"), "kind", "refers_to", F.lit("workbook").alias("scope")).alias("__b"))
    got = uses.withColumn("__k", F.lower("name")).join(local, ["sheet_id", "__k"], "left").join(book, ["__k"], "left")
    return got.withColumn("__x", F.coalesce("__l", "__b")).select(*uses.columns, "__x.defined", "__x.kind", "__x.refers_to", "__x.scope")


def decorate(edges: DataFrame, sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges with their source sheet, block and destination sheet; missing ones stay as nulls."""
    src = sheets.select(F.col("sheet_id").alias("src_sheet_id"), F.col("name").alias("src_sheet"))
    dst = sheets.select(F.col("sheet_id").alias("dst_sheet_id"), F.col("name").alias("dst_sheet"))
    b = blocks.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), "r1c1", *(F.col(c).alias("src_" + c) for c in RECT))
    return edges.join(src, "src_sheet_id", "left").join(b, ["src_sheet_id", "src_n"], "left").join(dst, "dst_sheet_id", "left")


def unique_links(blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Column bodies covered by exactly one block.  bodies: id, sheet_id, rectangle."""
    from .overlap import overlap_join, prefixed

    got = overlap_join(prefixed(bodies.select("id", "sheet_id", *RECT), "l_"), prefixed(blocks.select("sheet_id", "n", *RECT), "r_"), ["sheet_id"])
    got = got.where("r_row_min <= l_row_min AND r_row_max >= l_row_max AND r_col_min <= l_col_min AND r_col_max >= l_col_max")
    return got.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("fblock_n")).where("c = 1").drop("c")
