"""Canonical export of an index and plain CSV dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that differ between equal indexes: surrogates, times, revisions, raw link targets.
VOLATILE = frozenset({"id", "region", "generation", "indexed_at", "target", "__id"})


def canonical(df: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """A table with natural keys in place of surrogates, columns and rows in a fixed order."""
    if sheets is not None:
        for c in [c for c in df.columns if c.endswith("sheet_id")]:
            name = sheets.select(F.col("sheet_id").alias(c), F.col("name").alias(c.removesuffix("_id")))
            df = df.join(name, c, "left").drop(c)
    cols = sorted(c for c in df.columns if c not in VOLATILE)
    return df.select(*cols).orderBy(*cols)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table: equal tables have equal ones, whatever their partitions."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("x"), F.coalesce(F.sum(F.shiftrightunsigned("h", 16).cast("decimal(38,0)")), F.lit(0)).alias("s"))


def dump_csv(cells: DataFrame, folder: str) -> None:
    """All cells as CSV, a folder a sheet."""
    cells.write.mode("overwrite").partitionBy("sheet_id").option("header", True).csv(folder)


def write_index(df: DataFrame, folder: str) -> None:
    """Replace the partitions (workbook, sheet) that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workbook", "sheet_id").parquet(folder)
