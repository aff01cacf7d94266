"""Rectangular regions of a sparse sheet: runs, components, closure, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.a1 import RECT
from .components import components, materialised
from .overlap import overlap_join, points, prefixed

GAP = 1


def runs(cells: DataFrame, gap: int = 0, barriers: DataFrame | None = None) -> DataFrame:
    """Runs of a row's cells with at most ``gap`` blanks between neighbours: sheet_id, row, col_min, col_max, n.

    ``barriers`` (sheet_id and a rectangle: tables) break a run where one
    spans the whole bridge.
    """
    w = Window.partitionBy("sheet_id", "row").orderBy("col")
    pos = cells.select("sheet_id", "row", "col").withColumn("before", F.lag("col").over(w))
    if barriers is not None:
        bridges = pos.where(F.col("col") - F.col("before") > 1).select("sheet_id", "row", "col", F.col("row").alias("l_row_min"), F.col("row").alias("l_row_max"), (F.col("before") + 1).alias("l_col_min"), (F.col("col") - 1).alias("l_col_max"))
        hit = overlap_join(bridges, prefixed(barriers.select("sheet_id", *RECT), "r_"), ["sheet_id"])
        hit = hit.where("r_col_min <= l_col_min AND r_col_max >= l_col_max").select("sheet_id", "row", "col", F.lit(True).alias("cut")).distinct()
        pos = pos.join(hit, ["sheet_id", "row", "col"], "left")
    else:
        pos = pos.withColumn("cut", F.lit(None).cast("boolean"))
    new = F.when(F.col("before").isNull() | (F.col("col") - F.col("before") - 1 > gap) | F.coalesce("cut", F.lit(False)), 1).otherwise(0)
    island = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pos.withColumn("run", island).groupBy("sheet_id", "row", "run").agg(F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.count(F.lit(1)).alias("n")).drop("run")


def run_links(found: DataFrame, gap: int = GAP) -> DataFrame:
    """Pairs of runs within ``gap`` blank rows and columns.  found: id, sheet_id, row, col_min, col_max.

    Runs of a row are disjoint, so a run is linked to few others; the equality
    key is the row itself, listed gap + 1 rows on.
    """
    below = found.select(F.col("id").alias("b"), "sheet_id", F.col("row").alias("at"), F.col("col_min").alias("bl"), F.col("col_max").alias("bh"))
    above = found.select(F.col("id").alias("a"), "sheet_id", F.explode(F.sequence(F.col("row"), F.col("row") + gap + 1)).alias("at"), F.col("row").alias("ar"), F.col("col_min").alias("al"), F.col("col_max").alias("ah"))
    near = (F.col("ah") + gap + 1 >= F.col("bl")) & (F.col("bh") + gap + 1 >= F.col("al")) & (F.col("a") != F.col("b")) & ((F.col("ar") < F.col("at")) | (F.col("a") < F.col("b")))
    return above.join(below, ["sheet_id", "at"]).where(near).select("a", "b").distinct()


def boxes(found: DataFrame, links: DataFrame) -> DataFrame:
    """Bounding boxes of components of runs: sheet_id and a rectangle."""
    label = components(found.select("id"), links)
    got = found.join(label, "id").groupBy("sheet_id", "label").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"))
    return got.drop("label")


def closure(rects: DataFrame) -> DataFrame:
    """Merge intersecting boxes until none intersect (merged boxes can touch others, hence the loop)."""
    rects = materialised(rects.select("sheet_id", *RECT))
    while True:
        one = materialised(rects.withColumn("id", F.monotonically_increasing_id()))
        pairs = overlap_join(prefixed(one, "l_", {"id": "a"}), prefixed(one, "r_", {"id": "b"}), ["sheet_id"]).where("a < b").select("a", "b")
        pairs = materialised(pairs)
        if pairs.isEmpty():
            return one.drop("id")
        label = components(one.select("id"), pairs)
        rects = materialised(one.join(label, "id").groupBy("sheet_id", "label").agg(F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max")).drop("label"))


def ordinals(rects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n = 0, 1, ... of each sheet in the order of the rectangle's corners."""
    w = Window.partitionBy("sheet_id").orderBy(*(by or ["row_min", "col_min", "row_max", "col_max"]))
    return rects.withColumn("n", (F.row_number().over(w) - 1).cast("int"))


def bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_id").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.count(F.lit(1)).alias("cells"))


def detect(cells: DataFrame, tables: DataFrame | None = None, gap: int = GAP) -> DataFrame:
    """Regions of all sheets: sheet_id, n, rectangle, kind, list_object_name.

    Native tables are regions as they are.  Dense sheets without tables are one
    region, found by an aggregate; only the others go through components.
    """
    b = bounds(cells)
    free = cells
    if tables is not None:
        hit = overlap_join(points(cells.select("sheet_id", "row", "col"), "l_"), prefixed(tables.select("sheet_id", *RECT), "r_"), ["sheet_id"]).select("sheet_id", "row", "col")
        free = cells.join(hit, ["sheet_id", "row", "col"], "left_anti")
        b = b.join(tables.select("sheet_id").distinct().withColumn("t", F.lit(True)), "sheet_id", "left")
    else:
        b = b.withColumn("t", F.lit(None).cast("boolean"))
    dense = materialised(b.withColumn("dense", F.col("t").isNull() & (F.col("cells") == F.col("row_max").cast("long") * F.col("col_max"))))
    whole = dense.where("dense").select("sheet_id", *RECT)
    sparse = free.join(dense.where("NOT dense").select("sheet_id"), "sheet_id", "left_semi")
    found = materialised(runs(sparse, gap, tables).withColumn("id", F.monotonically_increasing_id()))
    links = run_links(found, gap)
    if tables is not None:
        links = _not_across(found, links, tables)
    rects = whole.unionByName(closure(boxes(found, links))).withColumn("kind", F.lit("region")).withColumn("list_object_name", F.lit(None).cast("string"))
    if tables is not None:
        rects = rects.unionByName(tables.select("sheet_id", *RECT, F.lit("table").alias("kind"), F.col("name").alias("list_object_name")))
    return ordinals(rects)


def _not_across(found: DataFrame, links: DataFrame, tables: DataFrame) -> DataFrame:
    """Links whose bounding box meets no table: runs on different sides of a table stay apart."""
    f = found.select("id", "sheet_id", "row", "col_min", "col_max")
    a, b = (f.select(F.col("id").alias(x), F.col("sheet_id").alias("sheet_id" if x == "a" else "__s"), *(F.col(c).alias(x + c) for c in ("row", "col_min", "col_max"))) for x in "ab")
    box = links.join(a, "a").join(b, "b").drop("__s")
    box = box.select("a", "b", "sheet_id", F.least("arow", "brow").alias("l_row_min"), F.greatest("arow", "brow").alias("l_row_max"), F.least("acol_min", "bcol_min").alias("l_col_min"), F.greatest("acol_max", "bcol_max").alias("l_col_max"))
    bad = overlap_join(box, prefixed(tables.select("sheet_id", *RECT), "r_"), ["sheet_id"]).select("a", "b").distinct()
    return links.join(bad, ["a", "b"], "left_anti")
