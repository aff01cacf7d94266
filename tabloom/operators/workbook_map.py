"""The workbook map: ranks, counts, and rendering within a budget of characters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1

#: (regions a sheet, columns a region, names, links, sheets), from rich to poor; None: all.  Fixed values.
TIERS = [(8, None, 20, 10, None), (8, 16, 20, 10, None), (8, 8, 20, 10, None), (4, 8, 20, 10, None), (2, 6, 20, 10, None), (1, 4, 10, 5, None), (0, 0, 5, 3, None), (0, 0, 5, 3, 40), (0, 0, 5, 3, 20), (0, 0, 5, 3, 10), (0, 0, 5, 3, 0)]
LIMIT = 8000


def region_ranks(regions: DataFrame) -> DataFrame:
    """Largest regions of a sheet first; sheets take turns in the overall order."""
    got = regions.withColumn("area", a1.area())
    own = Window.partitionBy("sheet_id").orderBy(F.desc("area"), "row_min", "col_min", "n")
    got = got.withColumn("render_rank", F.row_number().over(own))
    # Few rows: at most as many regions as a map can show are numbered.
    return got.withColumn("source_rank", F.row_number().over(Window.orderBy("render_rank", "sheet_id")))


def counts(sheets: DataFrame, diagnostics: DataFrame) -> dict:
    """Sheets, visibility and findings by severity."""
    s = sheets.agg(F.count(F.lit(1)).alias("sheets"), F.count_if(F.expr("visibility = 'visible'")).alias("visible")).first()
    d = {r["severity"]: r["n"] for r in diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"sheets": s["sheets"], "visible": s["visible"], "diagCounts": {k: d.get(k, 0) for k in ("error", "warn", "info")}}


def render(head: dict, sheets: list[dict], names: list[str], links: list[str], limit: int = LIMIT) -> dict:
    """The first tier whose JSON fits ``limit`` characters."""
    out: dict = {}
    for regions, cols, n_names, n_links, n_sheets in TIERS:
        shown = []
        for s in sheets if n_sheets is None else sheets[:n_sheets]:
            part = s["regions"][:regions]
            cut = [{**r, "cols": r["cols"][:cols], **({"colsMore": len(r["cols"]) - cols} if cols is not None and len(r["cols"]) > cols else {})} for r in part]
            shown.append({**s, "regions": cut, **({"regionsMore": len(s["regions"]) - len(cut)} if len(s["regions"]) > len(cut) else {})})
        out = {**head, "sheetList": shown, "names": names[:n_names], "namesMore": max(0, len(names) - n_names), "externalLinks": links[:n_links], "externalLinksMore": max(0, len(links) - n_links)}
        if n_sheets is not None and len(sheets) > n_sheets:
            out["sheetListMore"] = len(sheets) - n_sheets
        if len(json.dumps(out, ensure_ascii=False, separators=(",", ":"))) <= limit:
            return out
    return out


def bounded(payload: dict, limit: int = LIMIT) -> dict:
    """Halve lists, then shorten strings, until the payload fits."""
    size = lambda p: len(json.dumps(p, ensure_ascii=False, indent=2))

    def shrink(v, lists: int, text: int):
        if isinstance(v, dict):
            return {k: shrink(x, lists, text) for k, x in v.items()}
        if isinstance(v, list):
            return [shrink(x, lists, text) for x in v[:lists]]
        return v[: text - 1] + "…" if isinstance(v, str) and len(v) > text else v

    if size(payload) <= limit:
        return payload
    for text in (256, 80):
        lists = 1 << 12
        while lists:
            lists //= 2
            got = {**shrink(payload, lists, text), "truncated": True}
            if size(got) <= limit:
                return got
    raise ValueError("E_INTERNAL: the response does not fit")


def sheet_ranks(sheets: DataFrame) -> DataFrame:
    """Sheets that need a word first (hidden ones), then by id, within each workbook."""
    w = Window.partitionBy("workbook").orderBy(F.col("visibility") == "visible", "sheet_id")
    return sheets.withColumn("detail_rank", F.row_number().over(w))


def column_ranks(columns: DataFrame, base: int = 16, extra: int = 512) -> DataFrame:
    """Columns a map may show: the first ``base`` of each region, and ``extra`` more of the workbook.

    columns: workbook, region, idx.  All windows are within a workbook.
    """
    own = Window.partitionBy("workbook", "region").orderBy("idx")
    got = columns.withColumn("column_rank", F.row_number().over(own))
    more = F.col("column_rank") > base
    rest = Window.partitionBy("workbook", more).orderBy("region", "idx")
    got = got.withColumn("extra_rank", F.when(more, F.row_number().over(rest)))
    return got.where(~more | (F.col("extra_rank") <= extra))


def link_ranks(links: DataFrame) -> DataFrame:
    """Rank and total of a workbook's links together."""
    w = Window.partitionBy("workbook")
    return links.withColumns({"link_rank": F.row_number().over(w.orderBy("target")), "total": F.count(F.lit(1)).over(w)})
