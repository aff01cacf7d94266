"""The workbook facade: lazily built DataFrames, and one method a tool.

Each tool selects with DataFrames and collects no more than its documented cap.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import a1, formula, values
from ..functions.a1 import RECT
from ..operators import blocks as blocks_op
from ..operators import components, diagnostics, edges, graph, grid, overlap, profile, regions, workbook_map
from ..session import ship
from ..sources import ooxml, ooxml_writer
from ..sources.ooxml import WorkbookError, rect_text

READ_CAP, FIND_CAP, SYMBOL_CAP, TRACE_CAP, DIAG_CAP = 200, 50, 100, 200, 100
#: Cells of one component of blocks that are followed one by one in the search for cycles.
CYCLE_CELLS = 20_000


def allowed(path: str, root: str | None = None) -> str:
    """The real path, if it lies under the allowed root (when one is set)."""
    real = os.path.realpath(path)
    if root and os.path.commonpath([os.path.realpath(root), real]) != os.path.realpath(root):
        raise WorkbookError("E_PATH_DENIED", path)
    return real


class Workbook:
    """One workbook as DataFrames: cells, sheets, regions, columns, fblocks, edges, names, diagnostics."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None):
        ship(spark)
        self.spark, self.path = spark, allowed(path, root)
        self.stale_rects: list[tuple[int, int, int, int, int]] = []
        self._load()

    def _load(self) -> None:
        for k in [k for k, v in vars(type(self)).items() if isinstance(v, cached_property)]:
            self.__dict__.pop(k, None)
        self.package = ooxml.Package(self.path)
        self.sheet_ids = {s.name: s.sheet_id for s in self.package.sheets}
        self.sheet_names = {s.sheet_id: s.name for s in self.package.sheets}
        self.extras = [self.package.extras(s) for s in self.package.sheets]
        self.sha256 = hashlib.sha256(open(self.path, "rb").read()).hexdigest()
        self.generation = int(self.sha256[:12], 16)

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def cells(self) -> DataFrame:
        return components.materialised(ooxml.read_cells(self.spark, self.path))

    @cached_property
    def sheets(self) -> DataFrame:
        return self._frame([(s.sheet_id, s.name, s.kind, s.visibility, s.part) for s in self.package.sheets], "sheet_id int, name string, kind string, visibility string, xml_part string")

    @cached_property
    def tables(self) -> DataFrame:
        return self._frame([x for e in self.extras for x in e["list_objects"]], "sheet_id int, name string, display_name string, row_min int, row_max int, col_min int, col_max int, header_rows int, totals_rows int, columns array<string>")

    @cached_property
    def names(self) -> DataFrame:
        return self._frame([(n, s, t, k) for n, s, t, k in self.package.names_and_areas()[0]], "name string, scope_sheet_id int, refers_to string, kind string")

    @cached_property
    def validations(self) -> DataFrame:
        return self._frame([x for e in self.extras for x in e["validations"]], "sheet_id int, row_min int, row_max int, col_min int, col_max int, vtype string, operator string, formula1 string, formula2 string, allow_blank boolean")

    @cached_property
    def regions(self) -> DataFrame:
        found = regions.detect(self.cells, self.tables if any(e["list_objects"] for e in self.extras) else None)
        found = components.materialised(found.withColumn("region", F.col("sheet_id").cast("long") * (1 << 32) + F.col("n")))
        at = overlap.overlap_join(overlap.points(self.cells.select("sheet_id", "row", "col", "value_type", "v_str", "v_num", "style_idx"), "l_"), overlap.prefixed(found.select("sheet_id", "region", *RECT), "r_"), ["sheet_id"])
        bold = [k for k, b in enumerate(self.package.bold) if b] + [k for k, b in enumerate(self.package.filled) if b]
        at = at.select("region", "row", "col", F.when(F.col("value_type") != "blank", F.col("value_type")).alias("value_type"), "v_str", "v_num", F.col("style_idx").isin(bold).alias("styled") if bold else F.lit(False).alias("styled"))
        heads = profile.infer_header_rows(profile.header_scores(at, found.where("row_max > row_min").select("region", *RECT)))
        t = self.tables.select("sheet_id", F.col("name").alias("list_object_name"), F.col("header_rows").alias("th"), "totals_rows")
        got = found.join(heads, "region", "left").join(t, ["sheet_id", "list_object_name"], "left")
        got = got.withColumn("header_rows", F.coalesce("th", "header_rows", F.lit(0))).withColumn("confidence", F.when(F.col("kind") == "table", 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
        return components.materialised(got.withColumn("totals_rows", F.coalesce("totals_rows", F.lit(0))).drop("th"))

    @cached_property
    def columns(self) -> DataFrame:
        """sheet_id, region_n, idx, col, header, norm_header, dtype, nonnull, distinct_est."""
        r = self.regions.select("sheet_id", "n", "header_rows", "totals_rows", *RECT)
        at = overlap.overlap_join(overlap.points(self.cells, "l_"), overlap.prefixed(r, "r_"), ["sheet_id"])
        head = at.where("row < r_row_min + header_rows AND v_str IS NOT NULL").groupBy("sheet_id", "n", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "v_str"))), lambda x: x["v_str"]), " / ").alias("header"))
        body = at.where("row >= r_row_min + header_rows AND row <= r_row_max - totals_rows")
        p = profile.column_profiles(body, ["sheet_id", "n", "col"])
        every = r.select("sheet_id", "n", "col_min", F.explode(F.sequence("col_min", "col_max")).alias("col"))
        got = every.join(head, ["sheet_id", "n", "col"], "left").join(p, ["sheet_id", "n", "col"], "left")
        fallback = F.concat(F.lit("Column "), a1.column_label("col"))
        got = got.withColumn("header", F.coalesce(F.when(F.trim("header") != "", F.col("header")), fallback))
        got = got.withColumn("norm_header", values.normal_header(values.fold_header("header"), F.lower(F.regexp_replace(fallback, " ", "_"))))
        got = got.select("sheet_id", F.col("n").alias("region_n"), (F.col("col") - F.col("col_min")).alias("idx"), "col", "header", "norm_header", F.coalesce("dtype", F.lit("empty")).alias("dtype"), F.coalesce("nonnull", F.lit(0)).alias("nonnull"), F.coalesce("distinct_est", F.lit(0)).alias("distinct"))
        return components.materialised(profile.deduplicated(got, ["sheet_id", "region_n"]))

    @cached_property
    def fblocks(self) -> DataFrame:
        f = self.cells.where("formula IS NOT NULL").select("sheet_id", "row", "col", "formula", formula.r1c1("formula", "row", "col").alias("r1c1"))
        b = blocks_op.formula_blocks(f)
        b = b.join(f.select("sheet_id", F.col("row").alias("row_min"), F.col("col").alias("col_min"), "formula"), ["sheet_id", "row_min", "col_min"])
        flags = lambda x: any(n in formula.VOLATILE for n in formula.analyze(x, 1, 1).functions)
        rows = [(*(r[c] for c in ("sheet_id", "n", "r1c1", *RECT, "formula")), flags(r["formula"])) for r in b.toLocalIterator()]
        return self._frame(rows, "sheet_id int, n int, r1c1 string, row_min int, row_max int, col_min int, col_max int, formula string, volatile boolean")

    @cached_property
    def references(self) -> DataFrame:
        anchors = self.fblocks.select("sheet_id", "n", F.col("row_min").alias("row"), F.col("col_min").alias("col"), "formula")
        return components.materialised(anchors.mapInPandas(formula.reference_rows, "sheet_id int, n int, " + formula.REFERENCE_SCHEMA + ", ordinal int"))

    @cached_property
    def edges(self) -> DataFrame:
        """One edge a reference of a block: extruded rectangles, 3-D sheets, names, tables, external and opaque ones."""
        b = self.fblocks.select("sheet_id", "n", *RECT)
        s = self.sheets.select(F.lower("name").alias("__k"), F.col("sheet_id").alias("to"))
        r = self.references.withColumn("__k", F.lower("sheet"))
        plain = edges.extrude(r.where("via IN ('ref', 'spill') AND row1 IS NOT NULL").join(b, ["sheet_id", "n"])).join(s, "__k", "left").withColumn("to", F.when(F.col("sheet").isNull(), F.col("sheet_id")).otherwise(F.col("to")))
        out = ["sheet_id", "n", "to", *("dst_" + c for c in RECT), "via", "ordinal"]
        catalog = self.sheets.select("sheet_id", "name", F.col("sheet_id").alias("position"))
        three = r.where("via = '3d'").withColumns({"first": F.split("sheet", ":")[0], "last": F.split("sheet", ":")[1]})
        three = edges.expand_sheets(edges.extrude(three.join(b, ["sheet_id", "n"])), catalog).withColumn("to", F.col("dst_sheet_id"))
        rows = self._indirect_rows()
        null = F.lit(None).cast("int")
        rest = r.where("startswith(via, 'opaque') OR startswith(via, 'external')").withColumns({"to": null, **{"dst_" + c: null for c in RECT}})
        got = plain.select(*out).unionByName(three.select(*out)).unionByName(rest.select(*out)).unionByName(self._frame(rows, "sheet_id int, n int, to int, dst_row_min int, dst_row_max int, dst_col_min int, dst_col_max int, via string, ordinal int"))
        return components.materialised(got.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), F.col("to").alias("dst_sheet_id"), *("dst_" + c for c in RECT), "via").distinct())

    def _indirect_rows(self) -> list[tuple]:
        """Edges through names and tables; both catalogs are as small as the file's own lists."""
        names, areas = self.package.names_and_areas()
        kinds = {(n.casefold(), s): (n, k) for n, s, _, k in names}
        rects: dict[tuple, list] = {}
        for n, s, *rect in areas:
            rects.setdefault((n.casefold(), s), []).append(rect)
        tables = {x[1].casefold(): x for e in self.extras for x in e["list_objects"]}
        bounds = {(r["sheet_id"], r["n"]): r for r in self.fblocks.select("sheet_id", "n", *RECT).toLocalIterator()}
        out, self.name_issues = [], []
        for r in self.references.where("startswith(via, 'name:') OR startswith(via, 'structured:')").toLocalIterator():
            via, sid, n = r["via"], r["sheet_id"], r["n"]
            if via.startswith("name:"):
                key = via[5:].casefold()
                at = next(((key, s) for s in (sid, None) if (key, s) in kinds), None)
                if at is None:
                    self.name_issues.append((sid, n, "W_UNKNOWN_NAME", f"unknown name {via[5:]}"))
                    out.append((sid, n, None, None, None, None, None, "opaque:name", r["ordinal"]))
                for to, *rect in rects.get(at, []) if at else []:
                    out.append((sid, n, to, *rect, f"name:{kinds[at][0]}", r["ordinal"]))
                if at and kinds[at][1] in ("formula", "lambda"):
                    out.append((sid, n, None, None, None, None, None, "name-relative", r["ordinal"]))
            else:
                out.append(self._structured(via, sid, n, r["ordinal"], tables, bounds[sid, n]))
        return out

    def _structured(self, via: str, sid: int, n: int, ordinal: int, tables: dict, block) -> tuple:
        m = re.fullmatch(r"structured:([^\[]*)\[(.*)\]", via, re.S)
        t = tables.get(m[1].casefold()) if m[1] else next((x for x in tables.values() if x[0] == sid and x[3] <= block["row_min"] <= x[4] and x[5] <= block["col_min"] <= x[6]), None)
        items = [i.strip("[]@ ") for i in re.split(r"\]\s*,\s*\[", m[2])] if m[2].startswith("[") else [m[2].lstrip("@")]
        special = {i.casefold() for i in items if i.startswith("#")}
        col = next((i for i in items if i and not i.startswith("#")), None)
        if t is None or (col and col.casefold() not in [c.casefold() for c in t[9]]) or (col and ":" in m[2]):
            self.name_issues.append((sid, n, "W_PARSE", f"table reference {via[11:]}"))
            return (sid, n, None, None, None, None, None, "opaque:parse", ordinal)
        r1, r2, c1, c2 = t[3], t[4], t[5], t[6]
        lo, hi = r1 + t[7], r2 - t[8]
        if "#headers" in special:
            lo, hi = r1, r1 + t[7] - 1
        elif "#totals" in special:
            lo, hi = r2 - t[8] + 1, r2
        elif "#all" in special:
            lo, hi = r1, r2
        elif "#this row" in special or not m[1]:
            lo, hi = max(lo, block["row_min"]), min(hi, block["row_max"])
        if col:
            c1 = c2 = c1 + [c.casefold() for c in t[9]].index(col.casefold())
        return (sid, n, t[0], lo, hi, c1, c2, f"structured:{t[1]}[{col or m[2]}]", ordinal)

    @cached_property
    def diagnostics(self) -> DataFrame:
        self.edges  # noqa: B018  (fills name_issues)
        b = self.fblocks
        found = overlap.overlap_join(overlap.points(self.cells.where("formula IS NOT NULL").select("sheet_id", "row", "col", formula.r1c1("formula", "row", "col").alias("r1c1")), "l_"), overlap.prefixed(self.regions.select("sheet_id", "region", *RECT), "r_"), ["sheet_id"])
        parts = [diagnostics.error_values(self.cells), diagnostics.volatile_blocks(b), diagnostics.large_sheets(self.cells), diagnostics.inconsistent(blocks_op.inconsistencies(found.select("sheet_id", "region", "row", "col", "r1c1")))]
        anchors = {(r["sheet_id"], r["n"]): r for r in b.toLocalIterator()}
        issues = [(s, n, anchors[s, n]["row_min"], anchors[s, n]["col_min"], code, text) for s, n, code, text in self.name_issues]
        for (s, n), r in anchors.items():
            issues += [(s, n, r["row_min"], r["col_min"], code, text) for code, text in formula.analyze(r["formula"], r["row_min"], r["col_min"]).issues]
        parts.append(diagnostics.issues(self._frame(issues, "sheet_id int, n int, row int, col int, code string, message string")))
        parts.append(diagnostics.links(self._frame(self._links(anchors), "sheet_id int, row int, col int, target string, status string")))
        parts.append(diagnostics.stale(self._frame(self.stale_rects, "sheet_id int, row_min int, row_max int, col_min int, col_max int")))
        certain, possible = self._circular(anchors)
        parts.append(diagnostics.circular(self._frame(certain, "sheet_id int, row int, col int, cycle array<string>")))
        parts.append(diagnostics.possibly_circular(self._frame(possible, "sheet_id int, row int, col int, blocks int")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return components.materialised(out.distinct())

    def _links(self, anchors: dict) -> list[tuple]:
        rows = []
        targets = dict(self.package.external_links())
        for r in self.references.where("startswith(via, 'external:')").toLocalIterator():
            book = r["via"][10:-1]
            target = targets.get(int(book)) if book.isdigit() else book
            a = anchors[r["sheet_id"], r["n"]]
            if not target:
                status = "uncheckable"
            elif "://" in target and not target.startswith("file:"):
                status = "remote"
            else:
                local = os.path.join(os.path.dirname(self.path), target.removeprefix("file:///"))
                status = "ok" if os.path.exists(local) else "missing"
            rows.append((r["sheet_id"], a["row_min"], a["col_min"], target, status))
        return rows

    @cached_property
    def own_references(self) -> DataFrame:
        """Cell references of blocks to their own sheet, with terms and extruded rectangles, as edges."""
        b, s = self.fblocks.select("sheet_id", "n", *RECT), self.sheets.select("sheet_id", F.lower("name").alias("own"))
        r = self.references.where("via = 'ref' AND row1 IS NOT NULL").join(s, "sheet_id").where("sheet IS NULL OR lower(sheet) = own")
        return edges.extrude(r.join(b, ["sheet_id", "n"])).drop(*RECT).withColumnsRenamed({"sheet_id": "src_sheet_id", "n": "src_n"}).withColumn("dst_sheet_id", F.col("src_sheet_id"))

    def _circular(self, anchors: dict) -> tuple[list[tuple], list[tuple]]:
        """Cycles between cells, and components too large to say.

        Blocks that read themselves one way only are no cycle alone.  Of each
        other component all cells are followed if there are at most
        CYCLE_CELLS; beyond that a block with a cell in its own range is a
        cycle for certain, any other component a possible one.
        """
        links = components.materialised(graph.block_links(self.fblocks, self.edges))
        node = lambda df: df.select(graph.node("src_sheet_id", "src_n").alias("a"), F.col("src_n").alias("__n"))
        plain = node(graph.one_way(self.fblocks, self.own_references)).join(self.references.where("via <> 'ref' AND NOT startswith(via, 'opaque')").select(graph.node("sheet_id", "n").alias("a")).distinct(), "a", "left_anti").select("a", F.lit(True).alias("__ok"))
        links = links.join(plain, "a", "left").where("a <> b OR __ok IS NULL").select("a", "b")
        groups: dict[int, list[int]] = {}
        for r in graph.strong_components(links).orderBy("component", "id").toLocalIterator():
            groups.setdefault(r["component"], []).append(r["id"])
        certain = {r["a"] for r in node(graph.self_reading(self.fblocks, self.own_references)).toLocalIterator()} if groups else set()
        found, possible = [], []
        for members in groups.values():
            rects = [anchors[v >> 32, v & 0xFFFFFFFF] for v in members]
            if sum((a["row_max"] - a["row_min"] + 1) * (a["col_max"] - a["col_min"] + 1) for a in rects) <= CYCLE_CELLS:
                found += self._cell_cycles(rects)
                continue
            for v, a in zip(members, rects):
                if v in certain:
                    text = f"{self.sheet_names[a['sheet_id']]}!{rect_text(*(a[c] for c in RECT))}"
                    found.append((a["sheet_id"], a["row_min"], a["col_min"], [text, text]))
            if not certain & set(members):
                possible.append((rects[0]["sheet_id"], rects[0]["row_min"], rects[0]["col_min"], len(members)))
        return found, possible

    def _cell_cycles(self, blocks: list) -> list[tuple]:
        """The cells of a component's blocks, with all that each reads: cells, names, tables and runs of sheets."""
        areas: dict[tuple, list] = {}
        for n, scope, *rect in self.package.names_and_areas()[1]:
            areas.setdefault((n.casefold(), scope), []).append(tuple(rect))
        tables = {x[1].casefold(): x for e in self.extras for x in e["list_objects"]}
        ids = {n.casefold(): i for n, i in self.sheet_ids.items()}
        order = [s.sheet_id for s in self.package.sheets]
        cells: dict[tuple, str] = {}
        for a in blocks:
            for r in range(a["row_min"], a["row_max"] + 1):
                for c in range(a["col_min"], a["col_max"] + 1):
                    cells[a["sheet_id"], r, c] = formula.translate(a["formula"], a["row_min"], a["col_min"], r, c)
        back: dict[tuple, list[tuple]] = {}
        for (s, r, c), f in cells.items():
            reads = back.setdefault((s, r, c), [])
            for ref in formula.analyze(f, r, c).references:
                if ref.rect and ref.via in ("ref", "3d"):
                    if ref.via == "3d":
                        ends = sorted(order.index(ids[x.casefold()]) for x in ref.sheet.split(":") if x.casefold() in ids)
                        to = order[ends[0] : ends[-1] + 1] if ends else []
                    else:
                        to = [s if ref.sheet is None else ids.get(ref.sheet.casefold())]
                    (r1, a), (r2, b), (c1, d), (c2, e) = ref.rect
                    rows, cols = sorted((r1 + r * a, r2 + r * b)), sorted((c1 + c * d, c2 + c * e))
                    reads += [(t, *rows, *cols) for t in to]
                elif ref.via.startswith("name:"):
                    key = ref.via[5:].casefold()
                    reads += areas.get((key, s)) or areas.get((key, None), [])
                elif ref.via.startswith("structured:"):
                    got = self._structured(ref.via, s, 0, 0, tables, {"row_min": r, "row_max": r, "col_min": c, "col_max": c})
                    reads += [got[2:7]] if got[2] is not None else []
        by_col: dict[tuple, list[int]] = {}
        for s, r, c in sorted(cells):
            by_col.setdefault((s, c), []).append(r)
        return _cycles(cells, back, by_col, self.sheet_names)

    # Tools.

    def open_workbook(self) -> dict:
        cols: dict[tuple, list] = {}
        for c in self.columns.orderBy("sheet_id", "region_n", "idx").toLocalIterator():
            cols.setdefault((c["sheet_id"], c["region_n"]), []).append({"h": c["header"], "t": c["dtype"]})
        per: dict[int, list] = {}
        for r in workbook_map.region_ranks(self.regions).orderBy("sheet_id", "render_rank").toLocalIterator():
            s = self.sheet_names[r["sheet_id"]]
            per.setdefault(r["sheet_id"], []).append({"id": f"region:{s}:{r['n']}", "range": rect_text(*(r[c] for c in RECT)), "kind": r["kind"], "headerRows": r["header_rows"], "cols": cols.get((r["sheet_id"], r["n"]), []), "rows": r["row_max"] - r["row_min"] + 1, "conf": r["confidence"]})
        dims = {r["sheet_id"]: rect_text(*(r[c] for c in RECT)) for r in regions.bounds(self.cells).collect()}
        sheets = [{"sheet": s.name, "dims": dims.get(s.sheet_id), "regions": per.get(s.sheet_id, []), **({"vis": s.visibility} if s.visibility != "visible" else {})} for s in self.package.sheets]
        head = {"workbook": os.path.basename(self.path), "stale": False, "hasVBA": self.package.has_vba, **{k: v for k, v in workbook_map.counts(self.sheets, self.diagnostics).items() if k != "visible"}}
        links = [self._label(t) for _, t in self.package.external_links()]
        return workbook_map.render(head, sheets, sorted({n for n, _, _ in self.package.defined}, key=str.casefold), links)

    def _label(self, target: str | None) -> str:
        name = re.sub(r"[?#].*$", "", target or "").replace("\\", "/").rpartition("/")[2]
        return f"[{name}]" if re.search(r"(?i)\.(xlsx|xlsm|xltx|xltm|xls|xlsb)$", name) else "[external-workbook]"

    def refresh(self, recalculated: bool = False) -> dict:
        old = self._frame(self.package.part_hashes(), "part_name string, part_hash string")
        if recalculated:
            self.stale_rects = []
        self._load()
        from ..operators.lifecycle import changed_parts, sheets_to_refresh

        changes = changed_parts(old, self._frame(self.package.part_hashes(), "part_name string, part_hash string"))
        return {"reindexed": sorted(r["name"] for r in sheets_to_refresh(changes, self.sheets).collect())}

    def list_symbols(self, query: str = "", kinds: list[str] | None = None) -> dict:
        if kinds and not set(kinds) <= {"sheet", "region", "column", "fblock", "name"}:
            raise WorkbookError("E_INVALID_VALUE", "kinds")
        every = grid.list_symbols(grid.symbols(self.sheets, self.columns, self.regions, self.fblocks, self.names), query, kinds, None)
        total = every.count()
        rows = [r.asDict() for r in every.limit(SYMBOL_CAP).collect()]
        return {"symbols": rows, "total": total, "truncated": total > len(rows)}

    def _area(self, ref: str) -> tuple[int, tuple[int, int, int, int]]:
        """Sheet and rectangle of a reference or symbol."""
        kind, _, rest = ref.partition(":")
        try:
            if kind == "cell":
                return self._area(rest)
            if kind == "sheet" and rest in self.sheet_ids:
                b = regions.bounds(self.cells.where(F.col("sheet_id") == self.sheet_ids[rest])).first()
                return self.sheet_ids[rest], tuple(b[c] for c in RECT) if b else (1, 1, 1, 1)
            if kind in ("fblock", "region") and ":" in rest:
                sheet, _, n = rest.rpartition(":")
                df = self.fblocks if kind == "fblock" else self.regions
                r = df.where((F.col("sheet_id") == self.sheet_ids[sheet]) & (F.col("n") == int(n))).first()
                return r["sheet_id"], tuple(r[c] for c in RECT)
            if kind == "col" and rest.count(":") >= 2:
                sheet, n, header = re.fullmatch(r"(.*):(\d+):(.*)", rest).groups()
                at = (F.col("sheet_id") == self.sheet_ids[sheet]) & (F.col("region_n") == int(n)) & (F.col("norm_header") == header)
                c = self.columns.where(at).first()
                r = self.regions.where((F.col("sheet_id") == c["sheet_id"]) & (F.col("n") == int(n))).first()
                return c["sheet_id"], (r["row_min"] + r["header_rows"], r["row_max"] - r["totals_rows"], c["col"], c["col"])
            if kind == "name":
                scope, _, name = rest.rpartition("!")
                areas = [a for a in self.package.names_and_areas()[1] if a[0].casefold() == name.casefold() and (not scope or a[1] == self.sheet_ids.get(scope))]
                return areas[0][2], tuple(areas[0][3:])
        except (KeyError, TypeError, IndexError, AttributeError):
            raise WorkbookError("E_UNKNOWN_SYMBOL", ref) from None
        sheet, _, area = ref.rpartition("!")
        sheet = sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet
        sid = self.sheet_ids.get(sheet) if sheet else self.package.sheets[0].sheet_id
        row = self._frame([(area,)], "x string").select(a1.parse_rect("x").alias("r")).first()["r"]
        if sid is None or row is None:
            raise WorkbookError("E_INVALID_REF", ref)
        return sid, tuple(row)

    def get_region_schema(self, region_id: str) -> dict:
        sid, rect = self._area(region_id)
        n = int(region_id.rpartition(":")[2])
        r = self.regions.where((F.col("sheet_id") == sid) & (F.col("n") == n)).first()
        cols = [c.asDict() for c in self.columns.where((F.col("sheet_id") == sid) & (F.col("region_n") == n)).orderBy("idx").collect()]
        most = max(0, min(3, 180 // max(1, len(cols))))
        first = r["row_min"] + r["header_rows"]
        rows = self._values(sid, (first, min(first + most - 1, r["row_max"] - r["totals_rows"]), rect[2], rect[3])) if most else []
        blocks = self.fblocks.where((F.col("sheet_id") == sid) & (F.col("row_min") <= rect[1]) & (F.col("row_max") >= rect[0]) & (F.col("col_min") <= rect[3]) & (F.col("col_max") >= rect[2])).orderBy("n").limit(100).collect()
        vals = [v for e in self.extras for v in e["validations"] if v[0] == sid]
        shown = [{"id": f"col:{self.sheet_names[sid]}:{n}:{c['norm_header']}", "header": c["header"], "dtype": c["dtype"], "nonnull": c["nonnull"], "distinct": c["distinct"], "validation": next((v[5] for v in vals if v[3] <= c["col"] <= v[4] and v[1] <= rect[1] and v[2] >= first), None)} for c in cols]
        return {"region": region_id, "sheet": self.sheet_names[sid], "range": rect_text(*rect), "kind": r["kind"], "headerRows": r["header_rows"], "columns": shown, "samples": rows, "formulaBlocks": [{"id": f"fblock:{self.sheet_names[sid]}:{b['n']}", "range": rect_text(*(b[c] for c in RECT)), "r1c1": b["r1c1"], "volatile": b["volatile"]} for b in blocks], "conf": r["confidence"], "stale": self._stale(sid, rect)}

    def _values(self, sid: int, rect: tuple) -> list[list]:
        wide = rect[3] - rect[2] + 1
        if rect[1] < rect[0]:
            return []
        flat = [r["value"] for r in grid.read_grid(self.cells, sid, rect).orderBy("pos").collect()]
        return [flat[i : i + wide] for i in range(0, len(flat), wide)]

    def _stale(self, sid: int, rect: tuple) -> bool:
        return any(s == sid and a <= rect[1] and b >= rect[0] and c <= rect[3] and d >= rect[2] for s, a, b, c, d in self.stale_rects)

    def read_range(self, ref: str, cursor: str | None = None, max_cells: int = READ_CAP) -> dict:
        if not 1 <= max_cells <= READ_CAP:
            raise WorkbookError("E_INVALID_VALUE", "max_cells")
        sid, rect = self._area(ref)
        key = hashlib.sha256(json.dumps(["read_range", ref, max_cells]).encode()).hexdigest()
        offset = 0
        if cursor:
            try:
                c = json.loads(base64.urlsafe_b64decode(cursor))
            except ValueError:
                raise WorkbookError("E_STALE_CURSOR", "unreadable cursor") from None
            if c.get("key") != key or c.get("generation") != self.generation:
                raise WorkbookError("E_STALE_CURSOR", "other parameters or another generation")
            offset = c["offset"]
        total = (rect[1] - rect[0] + 1) * (rect[3] - rect[2] + 1)
        rows = grid.read_page(self.cells, sid, rect, offset, max_cells).orderBy("pos").collect()
        more = offset + len(rows) < total
        token = base64.urlsafe_b64encode(json.dumps({"key": key, "offset": offset + len(rows), "generation": self.generation}).encode()).decode() if more else None
        return {"sheet": self.sheet_names[sid], "range": rect_text(*rect), "page": {"start": offset, "end": offset + len(rows)}, "values": [r["value"] for r in rows], "offset": offset, "totalCells": total, "truncated": more, "cursor": token, "stale": self._stale(sid, rect), **({"valueTruncated": True} if any(r["truncated"] for r in rows) else {})}

    def find(self, pattern: str, kinds: list[str] | None = None, sheet: str | None = None, limit: int = FIND_CAP) -> dict:
        if sheet is not None and sheet not in self.sheet_ids:
            raise WorkbookError("E_INVALID_REF", sheet)
        limit = max(1, min(limit, FIND_CAP))
        heads = self.columns.withColumns({"row": F.lit(None).cast("int"), "ref": F.concat(F.lit("col:"), F.col("region_n").cast("string"), F.lit(":"), F.col("norm_header"))})
        got = grid.find(grid.subjects(self.cells, heads, self.names), pattern, kinds, self.sheet_ids.get(sheet) if sheet else None, limit).collect()
        ref = lambda r: f"{self.sheet_names[r['sheet_id']]}!{r['ref']}" if r["kind"] in ("value", "formula") else r["ref"]
        return {"matches": [{"ref": ref(r), "kind": r["kind"], "snippet": r["snippet"]} for r in got], "truncated": len(got) >= limit}

    def _trace(self, ref: str, dependents: bool, depth: int, max_nodes: int) -> dict:
        if not 0 <= depth <= 8 or not 1 <= max_nodes <= TRACE_CAP:
            raise WorkbookError("E_INVALID_VALUE", "depth or max_nodes")
        sid, rect = self._area(ref)
        order = lambda n: (n[0] is None, (self.sheet_names.get(n[0]) or "").casefold(), n)

        def hops(nodes: list) -> dict:
            areas = self._frame([(i, n[0], *map(int, n[1:5])) for i, n in enumerate(nodes) if n[0] is not None], "id int, sheet_id int, row_min int, row_max int, col_min int, col_max int")
            out: dict = {}
            if dependents:
                got = graph.direct_dependents(graph.concrete(self.edges), areas).join(self.fblocks.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), *RECT), ["src_sheet_id", "src_n"])
                for r in got.toLocalIterator():
                    out.setdefault(nodes[r["id"]], set()).add(((r["src_sheet_id"], *(r[c] for c in RECT)), r["via"]))
            else:
                for r in graph.direct_precedents(self.fblocks, self.edges, areas).toLocalIterator():
                    to = (r["dst_sheet_id"], *(r["dst_" + c] for c in RECT)) if r["dst_row_min"] is not None else (None, r["via"])
                    out.setdefault(nodes[r["id"]], set()).add((to, r["via"]))
            return {k: sorted(v, key=lambda x: (order(x[0])[:2], str(x[0]) if x[0][0] is None else x[0], x[1])) for k, v in out.items()}

        rows, cut = graph.trace(hops, (sid, *rect), depth, max_nodes)
        name = lambda n: f"{self.sheet_names[n[0]]}!{rect_text(*n[1:5])}" if n[0] is not None else n[1]
        nodes = [{"ref": name(r["node"]), "via": r["via"], "childCount": r["child_count"], "children": []} for r in rows]
        for r, n in zip(rows, nodes):
            if r["parent"] is not None:
                nodes[r["parent"]]["children"].append(n)
        return {"direction": "dependents" if dependents else "precedents", "tree": nodes[0], "nodeCount": len(rows), "edgeCount": len(rows) - 1, "truncated": cut}

    def trace_precedents(self, ref: str, depth: int = 3, max_nodes: int = 100) -> dict:
        return self._trace(ref, False, depth, max_nodes)

    def trace_dependents(self, ref: str, depth: int = 3, max_nodes: int = 100) -> dict:
        return self._trace(ref, True, depth, max_nodes)

    def trace_path(self, source: str, target: str, max_paths: int = 5, max_depth: int = 12) -> dict:
        if not 1 <= max_paths <= 50 or not 0 <= max_depth <= 12:
            raise WorkbookError("E_INVALID_VALUE", "max_paths or max_depth")
        (s1, r1), (s2, r2) = self._area(source), self._area(target)
        if s1 == s2 and r1[0] <= r2[1] and r2[0] <= r1[1] and r1[2] <= r2[3] and r2[2] <= r1[3]:
            return {"connected": True, "paths": [[{"symbol": source}]], "truncated": False}
        links = graph.block_links(self.fblocks, self.edges)
        one = lambda i, s, r: self._frame([(i, s, *r)], "id int, sheet_id int, row_min int, row_max int, col_min int, col_max int")
        start = graph.direct_dependents(graph.concrete(self.edges), one(0, s1, r1)).select(F.lit(-1).cast("long").alias("a"), graph.node("src_sheet_id", "src_n").alias("b"))
        ends = overlap.overlap_join(overlap.prefixed(one(0, s2, r2), "l_"), overlap.prefixed(self.fblocks.select("sheet_id", "n", *RECT), "r_"), ["sheet_id"]).select(graph.node("sheet_id", "n").alias("a"), F.lit(-2).cast("long").alias("b"))
        paths = [r["path"] for r in graph.shortest_paths(links.union(start).union(ends), -1, -2, max_depth + 1, max_paths + 1).collect()]
        name = lambda v: f"fblock:{self.sheet_names[v >> 32]}:{v & 0xFFFFFFFF}"
        return {"connected": bool(paths), "paths": [[{"symbol": source}, *({"symbol": name(v)} for v in p[1:-1])] for p in paths[:max_paths]], "truncated": len(paths) > max_paths}

    def explain_formula(self, ref: str) -> dict:
        sid, rect = self._area(ref)
        c = self.cells.where((F.col("sheet_id") == sid) & (F.col("row") == rect[0]) & (F.col("col") == rect[2])).first()
        if c is None or c["formula"] is None:
            raise WorkbookError("E_INVALID_REF", f"{ref} has no formula")
        at = (F.col("row_min") <= rect[0]) & (F.col("row_max") >= rect[0]) & (F.col("col_min") <= rect[2]) & (F.col("col_max") >= rect[2])
        b = self.fblocks.where((F.col("sheet_id") == sid) & at).first()
        a = formula.analyze(c["formula"], rect[0], rect[2])
        ds = self.diagnostics.where((F.col("sheet_id") == sid) & (F.col("row") == rect[0]) & (F.col("col") == rect[2])).limit(DIAG_CAP).collect()
        return {"ref": ref, "a1": c["formula"], "r1c1": b["r1c1"], "block": f"fblock:{self.sheet_names[sid]}:{b['n']}", "extent": rect_text(*(b[x] for x in RECT)), "resolvedNames": [r.via[5:] for r in a.references if r.via.startswith("name:")], "structuredRefs": [r.via[11:] for r in a.references if r.via.startswith("structured:")], "volatile": b["volatile"], "opaque": a.opaque, "diagnostics": [d["code"] for d in ds]}

    def get_diagnostics(self, sheet: str | None = None, severity: str | None = None, code: str | None = None, limit: int = DIAG_CAP) -> dict:
        rows = diagnostics.report([self.diagnostics], self.sheets, severity, code, self.sheet_ids[sheet] if sheet else None, None)
        total = rows.count()
        return {"diagnostics": [r.asDict() for r in rows.limit(min(limit, DIAG_CAP)).collect()], "total": total, "counts": {r["code"]: r["n"] for r in diagnostics.counts(rows.select("code")).where("n > 0").collect()}, "truncated": total > limit}

    def profile_column(self, col: str) -> dict:
        sid, rect = self._area(col)
        part = self.cells.where((F.col("sheet_id") == sid) & F.col("row").between(rect[0], rect[1]) & (F.col("col") == rect[2]))
        shown = values.display(F.col("value_type"), F.col("v_str"), F.col("v_num"), F.col("v_bool")).alias("v")
        full = part.where("value_type <> 'blank'")
        k = part.agg(F.count_if(F.expr("value_type <> 'blank'")).alias("nonnull"), F.count_if(F.expr("value_type <> 'blank' AND value_type <> 'number'")).alias("other"), F.count_if(F.expr("formula IS NOT NULL AND value_type = 'blank'")).alias("uncached")).first()
        out = {"column": col, "sheet": self.sheet_names[sid], "range": rect_text(*rect), "count": rect[1] - rect[0] + 1, "nonnull": k["nonnull"], "distinct": full.select(shown).distinct().count(), "cachedValues": k["uncached"] == 0, "stale": self._stale(sid, rect)}
        if k["nonnull"] and not k["other"]:
            n = profile.profile_numeric(full, "v_num").first()
            return {**out, **{c: n[c] for c in ("sum", "mean", "min", "max")}}
        return {**out, "topValues": [r.asDict() for r in profile.top_values(full.select(shown), "v").collect()]}

    def write_cells(self, edits: list[dict]) -> dict:
        ooxml_writer.check_edits(edits)
        rects = []
        for e in edits:
            if e["sheet"] not in self.sheet_ids:
                raise WorkbookError("E_INVALID_REF", e["sheet"])
            m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", e["ref"])
            r, c = int(m[2]), formula.column_index(m[1])
            rects.append((self.sheet_ids[e["sheet"]], r, r, c, c))
        schema = "sheet_id int, row_min int, row_max int, col_min int, col_max int"
        got = graph.staleness(self.fblocks, self.edges, self._frame(rects, schema)).join(self.fblocks.select("sheet_id", "n", *RECT), ["sheet_id", "n"])
        stale = {(r["sheet_id"], *(r[c] for c in RECT)) for r in got.toLocalIterator()} | {x for x, e in zip(rects, edits) if e.get("formula")}
        ooxml_writer.patch_workbook(self.path, edits, self.sha256)
        self.stale_rects = sorted(set(self.stale_rects) | stale)
        self._load()
        return {"results": [{"ref": f"{e['sheet']}!{e['ref']}", "ok": True} for e in edits], "staleBlocks": len(stale), "generation": self.generation}

    def set_column_formula(self, col: str, text: str, overwrite: bool = False) -> dict:
        sid, rect = self._area(col)
        part = self.cells.where((F.col("sheet_id") == sid) & F.col("row").between(rect[0], rect[1]) & (F.col("col") == rect[2]))
        if not overwrite and part.where("value_type <> 'blank' OR formula IS NOT NULL").count():
            raise WorkbookError("E_INVALID_VALUE", "the column is occupied; pass overwrite")
        rows = range(rect[0], rect[1] + 1)
        first = formula.from_r1c1(text, rect[0], rect[2]) or text
        edits = [{"sheet": self.sheet_names[sid], "ref": f"{formula.column_name(rect[2])}{r}", "formula": formula.translate(first, rect[0], rect[2], r, rect[2])} for r in rows]
        done = {"staleBlocks": 0}
        for i in range(0, len(edits), ooxml_writer.MAX_EDITS):
            done = self.write_cells(edits[i : i + ooxml_writer.MAX_EDITS])
        return {"cellsWritten": len(edits), "staleBlocks": done["staleBlocks"], "generation": self.generation}


def _cycles(cells: dict, back: dict, by_col: dict, names: dict) -> list[tuple]:
    """One cycle a strong component of cells, found by depth-first search with an explicit stack."""
    import bisect

    def reads(v):
        for s, r1, r2, c1, c2 in back.get(v, []):
            for c in range(c1, min(c2, 16384) + 1):
                rows = by_col.get((s, c), [])
                for r in rows[bisect.bisect_left(rows, r1) : bisect.bisect_right(rows, r2)]:
                    yield (s, r, c)

    state: dict = {}
    place: dict = {}
    out, known = [], set()
    for root in sorted(cells):
        if root in state:
            continue
        stack, path = [(root, reads(root))], [root]
        state[root], place[root] = 1, 0
        while stack:
            v, it = stack[-1]
            w = next(it, None)
            if w is None:
                state[v] = 2
                stack.pop()
                path.pop()
            elif state.get(w) == 1:
                loop = path[place[w] :]
                k = loop.index(min(loop))
                loop = loop[k:] + loop[:k]
                text = [f"{names[s]}!{formula.column_name(c)}{r}" for s, r, c in [*loop, loop[0]]]
                if tuple(text) not in known:
                    known.add(tuple(text))
                    out.append((loop[0], tuple(text)))
            elif w not in state:
                state[w], place[w] = 1, len(path)
                stack.append((w, reads(w)))
                path.append(w)
    return [(s, r, c, list(text)) for (s, r, c), text in out]
