"""Tables as cell grids, and reads, searches and pages over cells.

``cells`` has sheet_id, row, col, value_type, v_str, v_num, v_bool, formula.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1, values

CELL_COLUMNS = ["sheet_id", "row", "col", "value_type", "v_str", "v_num", "v_bool", "formula"]


def numbered(df: DataFrame, keys: list[str], name: str = "row_no", buckets: int = 64) -> DataFrame:
    """1, 2, ... in the order of ``keys`` without one task for all rows.

    The first key (a number) is cut into ranges between its extremes; rows are
    numbered within a range, and a range starts after the rows of those below.
    Ranges depend on values only, so a repeated task numbers rows alike.
    """
    lead = F.col(keys[0]).cast("double")
    low, high = df.agg(F.min(lead), F.max(lead)).first()
    span = (high - low) / buckets if low is not None and high > low else 1.0
    bucket = F.when(lead.isNull(), -1).otherwise(F.least(F.floor((lead - F.lit(low or 0.0)) / span), F.lit(buckets - 1))).cast("int")
    df = df.withColumn("__b", bucket)
    counts = df.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most buckets + 1 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__b", before.alias("__before"))
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*keys)))
    return out.join(F.broadcast(counts), "__b").withColumn(name, (F.col("__r") + F.col("__before")).cast("long")).drop("__b", "__r", "__before")


def _kind(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return "number"
    return {"boolean": "bool", "date": "date"}.get(dtype, "date" if dtype.startswith("timestamp") else "string")


def to_cells(df: DataFrame, keys: list[str], sheet_id: int, columns: list[str] | None = None) -> DataFrame:
    """A table as a sheet: headers in row 1, data from row 2 in the order of ``keys``; nulls give no cell."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    rows = numbered(df, keys)
    null = F.lit(None)

    def cell(i: int, c: str) -> Column:
        kind = _kind(types[c])
        v = F.col(c)
        text = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if types[c].startswith("timestamp") else v.cast("string")
        return F.struct(
            F.lit(i).alias("col"),
            F.lit(kind).alias("value_type"),
            (text if kind in ("string", "date") else null.cast("string")).alias("v_str"),
            (v.cast("double") if kind == "number" else null.cast("double")).alias("v_num"),
            (v if kind == "bool" else null.cast("boolean")).alias("v_bool"),
            v.isNotNull().alias("filled"),
        )

    body = rows.select((F.col("row_no") + 1).cast("int").alias("row"), F.explode(F.array(*(cell(i + 1, c) for i, c in enumerate(columns)))).alias("c"))
    body = body.where("c.filled").select(F.lit(sheet_id).alias("sheet_id"), "row", "c.col", "c.value_type", "c.v_str", "c.v_num", "c.v_bool", null.cast("string").alias("formula"))
    spark = df.sparkSession
    head = spark.createDataFrame([(sheet_id, 1, i + 1, "string", c, None, None, None) for i, c in enumerate(columns)], body.schema)
    return head.unionByName(body)


def read_grid(cells: DataFrame, sheet_id: int, rect: tuple[int, int, int, int]) -> DataFrame:
    """Every position of a rectangle, row-major: pos, row, col, value (null where no cell is).

    Large rectangles are filled by ranges over the cluster, not by one array.
    """
    r1, r2, c1, c2 = rect
    wide = c2 - c1 + 1
    grid = cells.sparkSession.range((r2 - r1 + 1) * wide).select(F.col("id").alias("pos"), (F.floor(F.col("id") / wide) + r1).cast("int").alias("row"), (F.pmod("id", F.lit(wide)) + c1).cast("int").alias("col"))
    part = cells.where((F.col("sheet_id") == sheet_id) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    shown = values.display(F.col("value_type"), F.col("v_str"), F.col("v_num"), F.col("v_bool"))
    return grid.join(part.select("row", "col", shown.alias("value")), ["row", "col"], "left").select("pos", "row", "col", "value")


def read_page(cells: DataFrame, sheet_id: int, rect: tuple[int, int, int, int], offset: int, count: int, limit: int = 4000) -> DataFrame:
    """Positions offset .. offset + count of a rectangle; long strings are shortened and marked."""
    r1, r2, c1, c2 = rect
    wide, tall = c2 - c1 + 1, r2 - r1 + 1
    stop = min(offset + count, wide * tall)
    if stop <= offset:
        return read_grid(cells, sheet_id, rect).where("false").withColumn("truncated", F.lit(False))
    first, last = r1 + offset // wide, r1 + (stop - 1) // wide
    page = read_grid(cells, sheet_id, (first, last, c1, c2)).withColumn("pos", F.col("pos") + (first - r1) * wide)
    page = page.where((F.col("pos") >= offset) & (F.col("pos") < stop))
    return page.withColumn("truncated", F.coalesce(F.length("value") > limit, F.lit(False))).withColumn("value", values.shorten("value", limit))


def subjects(cells: DataFrame, headers: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """What ``find`` searches: values, formulas, headers, names - in this order (source)."""
    at = a1.cell_ref("row", "col")
    shown = values.display(F.col("value_type"), F.col("v_str"), F.col("v_num"), F.col("v_bool"))
    parts = [
        cells.where("value_type IS NOT NULL").select("sheet_id", "row", "col", F.lit(0).alias("source"), at.alias("ref"), F.lit("value").alias("kind"), shown.alias("subject")),
        cells.where("formula IS NOT NULL").select("sheet_id", "row", "col", F.lit(1).alias("source"), at.alias("ref"), F.lit("formula").alias("kind"), F.col("formula").alias("subject")),
    ]
    if headers is not None:
        parts.append(headers.select("sheet_id", "row", "col", F.lit(2).alias("source"), F.col("ref"), F.lit("header").alias("kind"), F.col("header").alias("subject")))
    if names is not None:
        parts.append(names.select(F.lit(None).cast("int").alias("sheet_id"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(3).alias("source"), F.col("name").alias("ref"), F.lit("name").alias("kind"), F.col("refers_to").alias("subject")))
    return reduce(DataFrame.unionByName, parts)


def find(subject: DataFrame, pattern: str, kinds: list[str] | None = None, sheet_id: int | None = None, limit: int | None = 50, cut: int | None = 1000) -> DataFrame:
    """Regex search: sheet_id, row, col, ref, kind, snippet; ordered, the first ``limit``.

    ``cut`` is the documented reach into a subject (None: all of it).
    """
    if not 1 <= len(pattern) <= 256:
        raise ValueError("E_INVALID_VALUE: a pattern has 1 to 256 characters")
    got = subject if not kinds else subject.where(F.col("kind").isin(kinds))
    if sheet_id is not None:
        got = got.where((F.col("sheet_id") == sheet_id) | (F.col("kind") == "name"))
    if cut:
        got = got.withColumn("subject", F.col("subject").substr(1, cut))
    got = got.where(F.col("subject").rlike(pattern)).withColumn("snippet", values.snippet("subject", pattern))
    order = [F.when(F.col("source") < 2, 0).otherwise(F.col("source")), "sheet_id", "row", "col", "source", "ref"]
    got = got.orderBy(*order)
    return (got.limit(limit) if limit else got).select("sheet_id", "row", "col", "ref", "kind", "snippet")


def symbols(sheets: DataFrame, columns: DataFrame | None = None, regions: DataFrame | None = None, blocks: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """id, kind, description of everything that has a symbol.  Small sides join by sheet."""
    s = sheets.select("sheet_id", F.col("name").alias("sheet"))
    parts = [sheets.select(values.sheet_id(F.col("name")).alias("id"), F.lit("sheet").alias("kind"), F.col("kind").alias("description"))]
    if regions is not None:
        parts.append(regions.join(s, "sheet_id").select(values.region_id(F.col("sheet"), F.col("n")).alias("id"), F.lit("region").alias("kind"), a1.rect_ref().alias("description")))
    if columns is not None:
        parts.append(columns.join(s, "sheet_id").select(values.column_id(F.col("sheet"), F.col("region_n"), F.col("norm_header")).alias("id"), F.lit("column").alias("kind"), F.col("header").alias("description")))
    if blocks is not None:
        parts.append(blocks.join(s, "sheet_id").select(values.block_id(F.col("sheet"), F.col("n")).alias("id"), F.lit("fblock").alias("kind"), F.col("r1c1").alias("description")))
    if names is not None:
        scope = s.select(F.col("sheet_id").alias("scope_sheet_id"), F.col("sheet").alias("scope"))
        parts.append(names.join(scope, "scope_sheet_id", "left").select(values.name_id(F.col("name"), F.col("scope")).alias("id"), F.lit("name").alias("kind"), F.col("refers_to").alias("description")))
    return reduce(DataFrame.unionByName, parts)


def list_symbols(found: DataFrame, query: str = "", kinds: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Case-insensitive substring of id or description; exact total beside the first ``limit``."""
    got = found if not kinds else found.where(F.col("kind").isin(kinds))
    q = query.lower()
    if q:
        got = got.where(F.lower("id").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q))
    ordered = got.orderBy(F.lower("id"), "id")
    return ordered.limit(limit) if limit else ordered


def overlay(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells after edits: edited positions are replaced, others stay."""
    return cells.join(edits.select("sheet_id", "row", "col"), ["sheet_id", "row", "col"], "left_anti").unionByName(edits.select(*cells.columns))


def keyset_page(df: DataFrame, key: str, after: int, size: int = 1000) -> DataFrame:
    """The next page by key; the filter reaches the scan, the limit a top-k."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)
