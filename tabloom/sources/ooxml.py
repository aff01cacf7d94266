"""OOXML workbooks: a streaming parser and a Spark data source over it.

A sheet is read in one pass that clears what it has seen, so memory follows a
row, the shared strings and the styles.  On Spark, a partition is one sheet of
one workbook.
"""

from __future__ import annotations

import hashlib
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree.ElementTree import ParseError, iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formula import FormulaSyntaxError, column_index, column_name, translate

SUFFIXES = (".xlsx", ".xlsm", ".xltx", ".xltm")
#: Built-in number formats that show dates or times; fixed values.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_OLE = b"\xd0\xcf\x11\xe0"
CELL_SCHEMA = "workbook string, sheet_id int, sheet string, row int, col int, value_type string, v_str string, v_num double, v_bool boolean, formula string, formula_kind string, shared_index int, array_ref string, style_idx int"


class WorkbookError(Exception):
    """Typed failure; ``code`` is one of the documented error codes."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Sheet:
    sheet_id: int
    name: str
    kind: str
    visibility: str
    part: str


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(e, name: str, default=None):
    for k, v in e.attrib.items():
        if _local(k) == name:
            return v
    return default


class Package:
    """ZIP parts, relationships, catalog, strings and styles of one workbook."""

    def __init__(self, path: str):
        self.path = path
        if not path.lower().endswith(SUFFIXES):
            raise WorkbookError("E_UNSUPPORTED_FORMAT", os.path.basename(path))
        try:
            with open(path, "rb") as f:
                if f.read(4) == _OLE:
                    raise WorkbookError("E_ENCRYPTED", "the file is an encrypted container")
            self.zip = zipfile.ZipFile(path)
        except FileNotFoundError:
            raise WorkbookError("E_NOT_FOUND", path) from None
        except PermissionError:
            raise WorkbookError("E_LOCKED", path) from None
        except zipfile.BadZipFile:
            raise WorkbookError("E_CORRUPT", "no ZIP archive") from None
        infos = self.zip.infolist()
        if any(i.flag_bits & 1 for i in infos):
            raise WorkbookError("E_ENCRYPTED", "an archive member is encrypted")
        self.names = {i.filename.lstrip("/"): i.filename for i in infos}
        if len(self.names) != len(infos):
            raise WorkbookError("E_CORRUPT", "two parts of one name")
        self.main = next((t for k, t, m in self.relations("").values() if k.endswith("/officeDocument") and m != "External"), "xl/workbook.xml")
        self._catalog()

    def events(self, part: str, ends=True):
        if part not in self.names:
            raise WorkbookError("E_CORRUPT", f"part {part} is missing")
        try:
            with self.zip.open(self.names[part]) as f:
                yield from iterparse(f, events=("end",) if ends else ("start", "end"))
        except (ParseError, zipfile.BadZipFile, EOFError) as x:
            raise WorkbookError("E_CORRUPT", f"part {part}: {x}") from None

    def relations(self, part: str) -> dict[str, tuple[str, str, str]]:
        """Id -> (type, target, mode) of a part; targets as part names, external ones as they are."""
        folder, _, name = part.rpartition("/")
        rels = f"{folder}/_rels/{name}.rels".lstrip("/") if part else "_rels/.rels"
        out: dict[str, tuple[str, str, str]] = {}
        if rels not in self.names:
            return out
        for _, e in self.events(rels):
            if _local(e.tag) == "Relationship":
                rid, mode, target = e.get("Id"), e.get("TargetMode", "Internal"), e.get("Target", "")
                if rid in out:
                    raise WorkbookError("E_CORRUPT", f"relationship {rid} twice")
                if mode != "External":
                    target = target.lstrip("/") if target.startswith("/") else os.path.normpath(f"{folder}/{target}").lstrip("/")
                out[rid] = (e.get("Type", ""), target, mode)
        return out

    def _catalog(self) -> None:
        rels = self.relations(self.main)
        self.sheets: list[Sheet] = []
        self.date1904, self.calc, self.defined = False, {}, []
        for _, e in self.events(self.main):
            tag = _local(e.tag)
            if tag == "sheet":
                kind, part, _ = rels.get(_attr(e, "id"), ("", "", ""))
                kind = kind.rpartition("/")[2]
                if kind not in ("worksheet", "chartsheet", "dialogsheet", "xlMacrosheet"):
                    raise WorkbookError("E_CORRUPT", f"sheet {e.get('name')} has no part")
                self.sheets.append(Sheet(len(self.sheets) + 1, e.get("name"), kind, e.get("state", "visible"), part))
            elif tag == "workbookPr":
                self.date1904 = e.get("date1904", "0") in ("1", "true")
            elif tag == "calcPr":
                self.calc = dict(e.attrib)
            elif tag == "definedName":
                local = e.get("localSheetId")
                self.defined.append((e.get("name"), None if local is None else int(local) + 1, "".join(e.itertext())))
        if len({s.name.casefold() for s in self.sheets}) != len(self.sheets):
            raise WorkbookError("E_CORRUPT", "two sheets of one name")
        self.strings = self._strings(next((t for k, t, _ in rels.values() if k.endswith("/sharedStrings")), None))
        self.dates, self.bold, self.filled = self._styles(next((t for k, t, _ in rels.values() if k.endswith("/styles")), None))
        self.has_vba = "xl/vbaProject.bin" in self.names

    def _strings(self, part: str | None) -> list[str]:
        out: list[str] = []
        if part is None or part not in self.names:
            return out
        for _, e in self.events(part):
            if _local(e.tag) == "si":
                out.append(_text(e))
                e.clear()
        return out

    def _styles(self, part: str | None) -> tuple[list[bool], list[bool], list[bool]]:
        """Per cell format: shows a date, is bold, is filled."""
        if part is None or part not in self.names:
            return [False], [False], [False]
        formats, fonts, fills, xfs = {}, [], [], []
        for _, e in self.events(part):
            tag = _local(e.tag)
            if tag == "numFmt":
                formats[int(e.get("numFmtId"))] = e.get("formatCode", "")
            elif tag == "fonts":
                fonts = [any(_local(b.tag) == "b" and b.get("val", "1") not in ("0", "false") for b in f) for f in e]
            elif tag == "fills":
                fills = [any(_local(p.tag) == "patternFill" and p.get("patternType", "none") not in ("none", "gray125") for p in f) for f in e]
            elif tag == "cellXfs":
                xfs = [(int(x.get("numFmtId", 0)), int(x.get("fontId", 0)), int(x.get("fillId", 0))) for x in e]
        date = [n in DATE_FORMATS or is_date_format(formats.get(n, "")) for n, _, _ in xfs]
        at = lambda xs, k: k < len(xs) and xs[k]
        return date or [False], [at(fonts, f) for _, f, _ in xfs] or [False], [at(fills, f) for _, _, f in xfs] or [False]

    def part_hashes(self) -> list[tuple[str, str]]:
        return [(n, hashlib.sha256(self.zip.read(raw)).hexdigest()) for n, raw in sorted(self.names.items())]

    def cells(self, sheet: Sheet) -> Iterator[tuple]:
        """Rows of CELL_SCHEMA in the order of row and column."""
        if sheet.kind != "worksheet":
            return
        shared: dict[int, tuple[str, int, int]] = {}
        spans: list[tuple[int, int, int, int, str]] = []
        row = last_row = last_col = 0
        root = None
        for event, e in self.events(sheet.part, ends=False):
            tag = _local(e.tag)
            if event == "start":
                root = e if root is None else root
                if tag == "row":
                    row = int(e.get("r", last_row + 1))
                    if row <= last_row:
                        raise WorkbookError("E_CORRUPT", f"row {row} out of order")
                    last_row, last_col = row, 0
                continue
            if tag == "c":
                ref = e.get("r")
                m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", ref) if ref else None
                col = column_index(m[1]) if m else last_col + 1
                if (ref and not m) or col <= last_col or (m and int(m[2]) != row):
                    raise WorkbookError("E_CORRUPT", f"cell {ref} out of order")
                last_col = col
                got = self._cell(e, sheet, row, col, shared, spans)
                if got:
                    yield got
                e.clear()
            elif tag == "row":
                e.clear()
                if root is not None and len(root) > 1:
                    for child in list(root):
                        if _local(child.tag) == "sheetData":
                            child.clear()
            elif tag == "sheetData":
                return

    def _cell(self, e, sheet, row, col, shared, spans):
        kind, style = e.get("t", "n"), int(e.get("s", 0))
        raw = formula = f = None
        inline = ""
        for c in e:
            tag = _local(c.tag)
            if tag == "v":
                raw = c.text or ""
            elif tag == "f":
                f = c
            elif tag == "is":
                inline = _text(c)
        f_kind = index = span = None
        if f is not None:
            f_kind, index, span = f.get("t", "normal"), f.get("si"), f.get("ref")
            formula = "=" + f.text if f.text else None
            if f_kind == "shared":
                index = int(index)
                if formula and span:
                    shared[index] = (formula, row, col)
                elif index in shared:
                    try:
                        formula = translate(shared[index][0], shared[index][1], shared[index][2], row, col)
                    except FormulaSyntaxError:
                        formula = shared[index][0]
                else:
                    raise WorkbookError("E_CORRUPT", f"shared formula {index} before its master")
            elif f_kind in ("array", "dataTable") and span:
                spans.append((*_rect(span), span))
        if f is None or span is None:
            span = next((s[4] for s in spans if s[0] <= row <= s[1] and s[2] <= col <= s[3]), None if f_kind != "array" else span)
        if raw is None and formula is None and kind != "inlineStr" and f is None:
            return None
        vt, vs, vn, vb = self._value(kind, raw, inline, style)
        return (self.path, sheet.sheet_id, sheet.name, row, col, vt, vs, vn, vb, formula, f_kind, None if index is None else int(index), span, style)

    def _value(self, kind, raw, inline, style):
        if kind == "inlineStr":
            return "string", inline, None, None
        if raw is None or (raw == "" and kind != "str"):
            return "blank", None, None, None
        if kind == "s":
            k = int(raw)
            if not 0 <= k < len(self.strings):
                raise WorkbookError("E_CORRUPT", f"shared string {k}")
            return "string", self.strings[k], None, None
        if kind == "str":
            return "string", raw, None, None
        if kind == "b":
            if raw not in ("0", "1", "true", "false"):
                raise WorkbookError("E_CORRUPT", f"boolean {raw}")
            return "bool", None, None, raw in ("1", "true")
        if kind == "e":
            return "error", raw, None, None
        if kind == "d":
            return "date", raw, None, None
        try:
            v = float(raw)
        except ValueError:
            raise WorkbookError("E_CORRUPT", f"number {raw}") from None
        if v != v or v in (float("inf"), float("-inf")):
            raise WorkbookError("E_CORRUPT", f"number {raw}")
        if style < len(self.dates) and self.dates[style]:
            return "date", from_serial(v, self.date1904), None, None
        return "number", None, v, None

    def extras(self, sheet: Sheet) -> dict[str, list[tuple]]:
        """Merges, validations and tables of one sheet."""
        out: dict[str, list[tuple]] = {"merges": [], "validations": [], "list_objects": []}
        if sheet.kind != "worksheet":
            return out
        for _, e in self.events(sheet.part):
            tag = _local(e.tag)
            if tag == "mergeCell":
                out["merges"].append((sheet.sheet_id, *_rect(e.get("ref"))))
            elif tag == "dataValidation":
                text = {_local(c.tag): c.text for c in e}
                for area in (e.get("sqref") or "").split():
                    out["validations"].append((sheet.sheet_id, *_rect(area), e.get("type", "none"), e.get("operator"), text.get("formula1"), text.get("formula2"), e.get("allowBlank", "0") in ("1", "true")))
            elif tag == "c":
                e.clear()
        for kind, part, mode in self.relations(sheet.part).values():
            if kind.endswith("/table") and mode != "External":
                cols: list[str] = []
                head = None
                for _, e in self.events(part):
                    if _local(e.tag) == "tableColumn":
                        cols.append(e.get("name"))
                    elif _local(e.tag) == "table":
                        head = e
                out["list_objects"].append((sheet.sheet_id, head.get("name", head.get("displayName")), head.get("displayName"), *_rect(head.get("ref")), int(head.get("headerRowCount", 1)), int(head.get("totalsRowCount", 0)), cols))
        return out

    def external_links(self) -> list[tuple[int, str | None]]:
        """Book index -> target, counted in order even where none resolves."""
        rels, out = self.relations(self.main), []
        for _, e in self.events(self.main):
            if _local(e.tag) == "externalReference":
                part = rels.get(_attr(e, "id"), ("", "", ""))[1]
                target = next((t for k, t, _ in self.relations(part).values() if "externalLink" in k), None) if part in self.names else None
                out.append((len(out) + 1, target))
        return out

    def names_and_areas(self) -> tuple[list[tuple], list[tuple]]:
        """Defined names with kind, and the rectangles of range kinds."""
        ids = {s.name.casefold(): s.sheet_id for s in self.sheets}
        names, areas = [], []
        for name, scope, text in self.defined:
            kind, rects = classify_name(text, ids)
            names.append((name, scope, text, kind))
            areas += [(name, scope, *r) for r in rects]
        return names, areas


_AREA = re.compile(r"(?:'((?:[^']|'')+)'|([^'!,()\[\]{}\"]+))!(\$[A-Z]{1,3}\$[0-9]+(?::\$[A-Z]{1,3}\$[0-9]+)?)")


def classify_name(text: str, ids: dict[str, int]) -> tuple[str, list[tuple]]:
    """lambda, range, multi_range, constant or formula; absolute areas only are rectangles."""
    body = text.strip().lstrip("=")
    if re.match(r"(?i)(_xlfn\.)?LAMBDA\(", body):
        return "lambda", []
    parts = re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", body.strip("()") if body.startswith("(") else body)
    rects = []
    for p in parts:
        m = _AREA.fullmatch(p.strip())
        sid = ids.get((m[1] or m[2]).replace("''", "'").casefold()) if m else None
        if sid is None:
            break
        rects.append((sid, *_rect(m[3])))
    else:
        if rects:
            return ("range" if len(rects) == 1 else "multi_range"), rects
    if re.fullmatch(r'[+-]?[0-9.]+([eE][+-]?[0-9]+)?%?|"(?:[^"]|"")*"|TRUE|FALSE|\{.*\}', body, re.S | re.I):
        return "constant", []
    return "formula", []


def is_date_format(code: str) -> bool:
    """Date letters outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and bare.lower() != "general"


def from_serial(v: float, date1904: bool) -> str:
    """ISO text; serials under 60 of the 1900 system are a day off, and a fraction alone is a time."""
    if 0 <= v < 1 and not date1904:
        return (datetime(2000, 1, 1) + timedelta(seconds=round(v * 86400))).strftime("%H:%M:%S")
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 30) + timedelta(days=1 if v < 60 else 0)
    got = base + timedelta(seconds=round(v * 86400))
    return got.strftime("%Y-%m-%d") if v == int(v) else got.strftime("%Y-%m-%dT%H:%M:%S")


def _text(e) -> str:
    """Text of a string item without its phonetic runs."""
    out = []
    for c in e:
        tag = _local(c.tag)
        if tag == "t":
            out.append(c.text or "")
        elif tag == "r":
            out += [t.text or "" for t in c if _local(t.tag) == "t"]
    return "".join(out)


def _rect(ref: str) -> tuple[int, int, int, int]:
    got = [re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]+)", x) for x in ref.split(":")]
    if not all(got):
        raise WorkbookError("E_INVALID_REF", ref)
    rows, cols = [int(m[2]) for m in got], [column_index(m[1]) for m in got]
    return min(rows), max(rows), min(cols), max(cols)


def rect_text(r1: int, r2: int, c1: int, c2: int) -> str:
    a, b = f"{column_name(c1)}{r1}", f"{column_name(c2)}{r2}"
    return a if a == b else f"{a}:{b}"


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet_id: int):
        self.path, self.sheet_id = path, sheet_id


class CellReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [SheetPartition(p, s.sheet_id) for p in self.paths for s in Package(p).sheets] or [SheetPartition("", 0)]

    def read(self, partition):
        if partition.path:
            package = Package(partition.path)
            yield from package.cells(package.sheets[partition.sheet_id - 1])


class WorkbookSource(DataSource):
    """``spark.read.format("tabloom_ooxml").option("paths", "a.xlsx;b.xlsx").load()``: cells of all sheets."""

    @classmethod
    def name(cls):
        return "tabloom_ooxml"

    def schema(self):
        return CELL_SCHEMA

    def reader(self, schema):
        return CellReader([p for p in self.options.get("paths", self.options.get("path", "")).split(";") if p])


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("tabloom_ooxml").option("paths", ";".join(paths)).load()
