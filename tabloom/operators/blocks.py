"""Formula blocks: rectangles of one relative formula, and cells that break a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a column that one task looks at together.
BAND = 65_536


def vertical_runs(cells: DataFrame, band: int = BAND) -> DataFrame:
    """Maximal runs down a column of equal r1c1.  cells: sheet_id, row, col, r1c1.

    Runs are found within bands of rows, so no task holds a long column; of
    these the first and last of each band, two at most, meet their neighbours.
    """
    got = cells.select("sheet_id", "col", "r1c1", F.col("row").alias("row_min"), F.col("row").alias("row_max"), F.floor(F.col("row") / band).alias("__band"))
    got = _joined(got)
    edge = (F.pmod("row_min", F.lit(band)) == 0) | (F.pmod("row_max", F.lit(band)) == band - 1)
    return _joined(got.withColumn("__band", F.when(edge, -1).otherwise(F.col("__band")))).drop("__band")


def _joined(runs: DataFrame) -> DataFrame:
    """Runs that follow each other in a column's band with equal r1c1 become one."""
    key = ["sheet_id", "col", "__band"]
    w = Window.partitionBy(*key).orderBy("row_min")
    new = F.when((F.col("row_min") == F.lag("row_max").over(w) + 1) & F.col("r1c1").eqNullSafe(F.lag("r1c1").over(w)), 0).otherwise(1)
    got = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy(*key, "__run").agg(F.first("r1c1").alias("r1c1"), F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max")).drop("__run")


def merge_across(runs: DataFrame) -> DataFrame:
    """Neighbouring columns' runs of equal rows and formula become one rectangle."""
    w = Window.partitionBy("sheet_id", "row_min", "row_max", "r1c1").orderBy("col")
    new = F.when(F.col("col") == F.lag("col").over(w) + 1, 0).otherwise(1)
    got = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy("sheet_id", "row_min", "row_max", "r1c1", "__run").agg(F.min("col").alias("col_min"), F.max("col").alias("col_max")).drop("__run")


def formula_blocks(cells: DataFrame) -> DataFrame:
    """sheet_id, n, r1c1 and a rectangle; blocks cover every formula cell once."""
    w = Window.partitionBy("sheet_id").orderBy("row_min", "col_min", "row_max", "col_max", "r1c1")
    got = merge_across(vertical_runs(cells)).withColumn("n", (F.row_number().over(w) - 1).cast("int"))
    return got.select("sheet_id", "n", "r1c1", "row_min", "row_max", "col_min", "col_max")


def inconsistencies(cells: DataFrame, axis: str = "both", least: int = 5) -> DataFrame:
    """Cells that differ from the dominant formula of a contiguous run inside a region.

    cells: sheet_id, region, row, col, r1c1.  All thresholds are whole-number
    arithmetic: 5 * dominant >= 4 * n, and at most max(3, (n + 19) div 20)
    others.  The best candidate of a cell stays: larger share, longer run,
    vertical before horizontal, smaller pattern.
    """
    parts = []
    for rank, (name, line, at) in enumerate((("vertical", "col", "row"), ("horizontal", "row", "col"))):
        if axis not in ("both", name):
            continue
        w = Window.partitionBy("sheet_id", "region", line).orderBy(at)
        new = F.when(F.col(at) == F.lag(at).over(w) + 1, 0).otherwise(1)
        r = cells.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
        key = ["sheet_id", "region", line, "run"]
        per = r.groupBy(*key, "r1c1").agg(F.count(F.lit(1)).alias("c"))
        top = per.groupBy(*key).agg(F.sum("c").alias("n"), F.max("c").alias("dominant"), F.count(F.lit(1)).alias("kinds"))
        best = per.join(top, key).where("c = dominant").groupBy(*key, "n", "dominant", "kinds").agg(F.min("r1c1").alias("pattern"))
        odd = "n >= %d AND kinds > 1 AND 5 * dominant >= 4 * n AND n - dominant <= greatest(3, (n + 19) DIV 20)" % least
        got = r.join(best.where(odd), key).where("r1c1 <> pattern")
        parts.append(got.select("sheet_id", "region", "row", "col", "r1c1", "pattern", "n", "dominant", F.lit(rank).alias("axis")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("sheet_id", "row", "col").orderBy(F.desc(F.col("dominant") / F.col("n")), F.desc("n"), "axis", "pattern")
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
