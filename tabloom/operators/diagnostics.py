"""Typed findings: the report, its counts and the single rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import a1, values

#: Code and severity of every finding; fixed values.
CODES = {
    "E_ERRVAL": "error", "E_CIRCULAR": "error", "E_BROKEN_XLINK": "error", "W_POSSIBLE_CIRCULAR": "warn", "W_INCONSISTENT_FORMULA": "warn", "W_UNKNOWN_NAME": "warn",
    "W_PARSE": "warn", "W_LARGE_SHEET": "warn", "W_REGEX_TIMEOUT": "warn", "I_DYNAMIC_REF": "info", "I_VOLATILE": "info", "I_STALE": "info",
}
COLUMNS = "severity string, code string, sheet_id int, row int, col int, ref string, message string, related string"
LARGE_SHEET = 2_000_000


def _finding(df: DataFrame, code: str, message, row="row", col="col", ref=None, related=None, severity=None) -> DataFrame:
    null = F.lit(None)
    at = lambda c: F.col(c).cast("int") if c else null.cast("int")
    ref = ref if ref is not None else (a1.cell_ref(at(row), at(col)) if row else null.cast("string"))
    return df.select(
        (severity if severity is not None else F.lit(CODES[code])).alias("severity"), F.lit(code).alias("code"), F.col("sheet_id").cast("int").alias("sheet_id"),
        at(row).alias("row"), at(col).alias("col"), ref.alias("ref"), message.alias("message"), (related if related is not None else null.cast("string")).alias("related"),
    )


def error_values(cells: DataFrame) -> DataFrame:
    """DIA1: every error cell; known texts are explained."""
    known = F.create_map(*(F.lit(x) for kv in values.ERROR_TEXTS.items() for x in kv))
    text = F.concat_ws(": ", values.shorten("v_str", 120), F.coalesce(F.try_element_at(known, F.col("v_str")), F.lit("error value")))
    return _finding(cells.where("value_type = 'error'"), "E_ERRVAL", text)


def inconsistent(found: DataFrame) -> DataFrame:
    """DIA4 from ``blocks.inconsistencies``."""
    return _finding(found, "W_INCONSISTENT_FORMULA", F.concat(F.lit("formula differs from its neighbours: "), F.col("pattern")), related=F.to_json(F.struct("pattern", "n", "dominant")))


def volatile_blocks(blocks: DataFrame) -> DataFrame:
    """DIA10: one a block."""
    return _finding(blocks.where("volatile"), "I_VOLATILE", F.lit("recalculated on every calculation"), "row_min", "col_min", ref=a1.rect_ref())


def large_sheets(cells: DataFrame, limit: int = LARGE_SHEET) -> DataFrame:
    """DIA7."""
    n = cells.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return _finding(n, "W_LARGE_SHEET", F.concat(F.col("n").cast("string"), F.lit(" cells")), None, None)


def stale(rects: DataFrame) -> DataFrame:
    """DIA11: one a stale rectangle."""
    return _finding(rects, "I_STALE", F.lit("value is older than an edit it depends on"), "row_min", "col_min", ref=a1.rect_ref())


def possibly_circular(found: DataFrame) -> DataFrame:
    """DIA2 where a component is too large to follow: sheet_id, row, col, blocks."""
    return _finding(found, "W_POSSIBLE_CIRCULAR", F.concat(F.col("blocks").cast("string"), F.lit(" blocks may read each other in a circle")))


def circular(found: DataFrame) -> DataFrame:
    """DIA2 from cycles: sheet_id, row, col, cycle (array of references)."""
    return _finding(found, "E_CIRCULAR", F.concat(F.lit("circular reference: "), F.array_join("cycle", " -> ")), related=F.to_json(F.struct("cycle")))


def issues(found: DataFrame) -> DataFrame:
    """DIA5, DIA6, DIA9, DIA12: issues of analysed formulas, once a block at its smallest anchor."""
    one = found.groupBy("sheet_id", "n", "code", "message").agg(F.min(F.struct("row", "col")).alias("at"))
    parts = [_finding(one.where(F.col("code") == c).select("sheet_id", "message", "at.row", "at.col"), c, F.col("message")) for c in ("W_PARSE", "W_UNKNOWN_NAME", "I_DYNAMIC_REF")]
    return reduce(DataFrame.unionByName, parts)


def links(found: DataFrame) -> DataFrame:
    """DIA3: sheet_id, row, col, target, status; missing is an error, remote and uncheckable a warning."""
    bad = found.where("status <> 'ok'")
    return _finding(bad, "E_BROKEN_XLINK", F.concat_ws(" ", F.col("status"), values.workbook_label("target")), related=F.to_json(F.struct("status")), severity=F.when(F.col("status") == "missing", "error").otherwise("warn"))


def report(parts: list[DataFrame], sheets: DataFrame, severity: str | None = None, code: str | None = None, sheet_id: int | None = None, limit: int | None = 100) -> DataFrame:
    """Findings in order: severity, sheet, row (missing first), column, code, reference, message."""
    got = reduce(DataFrame.unionByName, parts).distinct().join(sheets.select("sheet_id", F.col("name").alias("sheet")), "sheet_id", "left")
    for c, v in (("severity", severity), ("code", code), ("sheet_id", sheet_id)):
        if v is not None:
            got = got.where(F.col(c) == v)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    got = got.orderBy(rank, "sheet", F.coalesce("row", F.lit(-1)), F.coalesce("col", F.lit(-1)), "code", "ref", "message")
    got = got.select("severity", "code", "sheet", "row", "col", "ref", "message", "related")
    return got.limit(limit) if limit else got


def counts(found: DataFrame) -> DataFrame:
    """severity, code, n for every code, zeros too."""
    every = found.sparkSession.createDataFrame([(s, c) for c, s in CODES.items()], "severity string, code string")
    n = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "code", "left").select("severity", "code", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def error_census(cells: DataFrame) -> DataFrame:
    """Error cells by sheet and text."""
    return cells.where("value_type = 'error'").groupBy("sheet", F.col("v_str").alias("text")).agg(F.count(F.lit(1)).alias("cells"), F.min("row").alias("first_row"))
