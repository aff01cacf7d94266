"""Freshness and incremental scope by comparing part manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts whose change touches every sheet.
SHARED = ("xl/sharedStrings.xml", "xl/styles.xml")


def changed_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """part_name, change (added, removed, changed).  Manifests: part_name, part_hash."""
    o = old.select("part_name", F.col("part_hash").alias("oh"), F.lit(True).alias("o"))
    n = new.select("part_name", F.col("part_hash").alias("nh"), F.lit(True).alias("n"))
    both = o.join(n, "part_name", "full_outer").where(~F.col("oh").eqNullSafe(F.col("nh")))
    return both.select("part_name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


def sheets_to_refresh(changes: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets to index again: all if the structure, shared strings or styles changed, else those whose part did."""
    broad = changes.where(F.col("part_name").isin(*SHARED) | ((F.col("part_name") == "xl/workbook.xml")))
    if not broad.isEmpty():
        return sheets
    return sheets.join(changes.select(F.col("part_name").alias("xml_part")), "xml_part", "left_semi")


def fresh(old: DataFrame, now: DataFrame) -> DataFrame:
    """Workbooks whose path, modification time and length are as recorded."""
    return now.join(old, ["path", "modificationTime", "length"], "left_semi")
