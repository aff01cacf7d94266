"""Writing workbooks: new ones from cells, and surgical edits of existing ones."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from ..functions.formula import column_index, column_name
from .ooxml import Package, WorkbookError

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAX_EDITS, MAX_TEXT, MAX_FORMULA = 500, 32767, 8192


def _cell(ref: str, value, formula: str | None, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    f = f"<f>{escape(formula.removeprefix('='))}</f>" if formula else ""
    if value is None:
        return f'<c r="{ref}"{s}>{f}</c>'
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{s}>{f}<v>{value!r}</v></c>'
    if value.startswith("#") and re.fullmatch(r"#[A-Z0-9/]+[!?]?", value):
        return f'<c r="{ref}"{s} t="e">{f}<v>{escape(value)}</v></c>'
    if formula:
        return f'<c r="{ref}"{s} t="str">{f}<v>{escape(value)}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, Iterable[tuple]], names: dict[str, str] | None = None, tables: dict[str, tuple[str, str, list[str], int]] | None = None, merges: dict[str, list[str]] | None = None, states: dict[str, str] | None = None, links: list[str] | None = None, extra: dict[str, bytes] | None = None) -> None:
    """A small workbook: per sheet (row, col, value, formula[, style]) in order; tables: sheet -> (name, ref, columns, totals).

    Style 1 is bold, style 2 a date.
    """
    tables, merges, states, links = tables or {}, merges or {}, states or {}, links or []
    parts: dict[str, bytes] = dict(extra or {})
    over, rels, listed = [], [], []
    for k, (name, cells) in enumerate(sheets.items(), 1):
        rows: dict[int, list[str]] = {}
        for r, c, v, *rest in cells:
            rows.setdefault(r, []).append(_cell(f"{column_name(c)}{r}", v, *rest))
        body = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
        tail = f'<mergeCells>{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merges[name])}</mergeCells>' if name in merges else ""
        if name in tables:
            tname, ref, cols, totals = tables[name]
            tail += f'<tableParts count="1"><tablePart r:id="rId1" xmlns:r="{_REL}"/></tableParts>'
            columns = "".join(f'<tableColumn id="{i}" name="{escape(c)}"/>' for i, c in enumerate(cols, 1))
            parts[f"xl/tables/table{k}.xml"] = f'{_HEAD}<table xmlns="{_MAIN}" id="{k}" name="{tname}" displayName="{tname}" ref="{ref}" totalsRowCount="{totals}"><tableColumns count="{len(cols)}">{columns}</tableColumns></table>'.encode()
            parts[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="{_REL}/table" Target="../tables/table{k}.xml"/></Relationships>'.encode()
            over.append((f"/xl/tables/table{k}.xml", "table"))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{tail}</worksheet>'.encode()
        over.append((f"/xl/worksheets/sheet{k}.xml", "worksheet"))
        rels.append(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        listed.append(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"' + (f' state="{states[name]}"' if name in states else "") + "/>")
    rels.append(f'<Relationship Id="rStyles" Type="{_REL}/styles" Target="styles.xml"/>')
    parts["xl/styles.xml"] = (f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="0" fontId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>').encode()  # fmt: skip
    outside = ""
    for i, target in enumerate(links, 1):
        rels.append(f'<Relationship Id="rLink{i}" Type="{_REL}/externalLink" Target="externalLinks/externalLink{i}.xml"/>')
        outside += f'<externalReference r:id="rLink{i}"/>'
        parts[f"xl/externalLinks/externalLink{i}.xml"] = f'{_HEAD}<externalLink xmlns="{_MAIN}"/>'.encode()
        parts[f"xl/externalLinks/_rels/externalLink{i}.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="{_REL}/externalLinkPath" Target="{escape(target)}" TargetMode="External"/></Relationships>'.encode()
    defined = "".join(f'<definedName name="{escape(n)}">{escape(t)}</definedName>' for n, t in (names or {}).items())
    parts["xl/workbook.xml"] = (f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(listed)}</sheets>' + (f"<externalReferences>{outside}</externalReferences>" if outside else "") + (f"<definedNames>{defined}</definedNames>" if defined else "") + "<calcPr/></workbook>").encode()
    parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PKG}">{"".join(rels)}</Relationships>'.encode()
    parts["_rels/.rels"] = f'{_HEAD}<Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode()
    kinds = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in over)
    parts["[Content_Types].xml"] = f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>'.encode()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in sorted(parts):
            z.writestr(n, parts[n])


def check_edits(edits: list[dict]) -> None:
    """1 to 500 edits of different cells; plain values or formulas of allowed length."""
    if not 1 <= len(edits) <= MAX_EDITS:
        raise WorkbookError("E_INVALID_VALUE", "1 to 500 edits")
    if len({(e["sheet"], e["ref"].upper()) for e in edits}) != len(edits):
        raise WorkbookError("E_INVALID_VALUE", "a cell is edited twice")
    for e in edits:
        if not re.fullmatch(r"[A-Za-z]{1,3}[1-9][0-9]{0,6}", e["ref"]):
            raise WorkbookError("E_INVALID_REF", e["ref"])
        v = e.get("value")
        f = e.get("formula")
        units = lambda s: len(s.encode("utf-16-le")) // 2
        if f is not None and (not f.startswith("=") or units(f) > MAX_FORMULA):
            raise WorkbookError("E_INVALID_VALUE", "formula")
        if v is not None and not isinstance(v, (str, bool, int, float)):
            raise WorkbookError("E_INVALID_VALUE", "only text, numbers and booleans are written")
        if isinstance(v, float) and (v != v or abs(v) == float("inf")):
            raise WorkbookError("E_INVALID_VALUE", "not a finite number")
        if isinstance(v, str) and units(v) > MAX_TEXT:
            raise WorkbookError("E_INVALID_VALUE", "text too long")


def patch_workbook(path: str, edits: list[dict], expected_sha256: str | None = None) -> None:
    """Edit cells in place: other parts keep their bytes, the file is replaced at once.

    Formulas lose their cached value, and the workbook is marked for full
    recalculation; the calculation chain goes.
    """
    import hashlib

    check_edits(edits)
    folder, name = os.path.split(path)
    if os.path.exists(os.path.join(folder, "~$" + name)):
        raise WorkbookError("E_OPEN_IN_EXCEL", name)
    package = Package(path)
    if expected_sha256 and hashlib.sha256(open(path, "rb").read()).hexdigest() != expected_sha256:
        raise WorkbookError("E_CONFLICT", "the file changed meanwhile")
    by_name = {s.name: s for s in package.sheets}
    changed: dict[str, bytes] = {}
    for sheet in {e["sheet"] for e in edits}:
        if sheet not in by_name:
            raise WorkbookError("E_INVALID_REF", sheet)
        _guard_arrays(package, by_name[sheet], [e for e in edits if e["sheet"] == sheet])
        text = package.zip.read(package.names[by_name[sheet].part]).decode("utf-8")
        own = {e["ref"].upper(): e for e in edits if e["sheet"] == sheet}
        changed[by_name[sheet].part] = _patch_sheet(_unshare(text, package, by_name[sheet], own), own).encode("utf-8")
    book = package.zip.read(package.names[package.main]).decode("utf-8")
    if re.search(r"<(\w+:)?calcPr\b", book):
        book = re.sub(r"(<(?:\w+:)?calcPr\b)((?:\s+(?!fullCalcOnLoad)[\w:]+=\"[^\"]*\")*)(?:\s+fullCalcOnLoad=\"[^\"]*\")?", r'\1\2 fullCalcOnLoad="1"', book, count=1)
    else:
        book = re.sub(r"</((?:\w+:)?)workbook>", r'<\1calcPr fullCalcOnLoad="1"/></\1workbook>', book)
    changed[package.main] = book.encode("utf-8")
    gone = {"xl/calcChain.xml"} & set(package.names)
    if gone:
        for part, pattern in (("[Content_Types].xml", r'<Override[^>]*PartName="/xl/calcChain\.xml"[^>]*/>'), ("xl/_rels/workbook.xml.rels", r'<Relationship [^>]*calcChain[^>]*/>')):
            changed[part] = re.sub(pattern, "", package.zip.read(package.names[part]).decode("utf-8")).encode("utf-8")
    fd, temp = tempfile.mkstemp(dir=folder or ".", suffix=os.path.splitext(path)[1])
    os.close(fd)
    try:
        with zipfile.ZipFile(temp, "w") as out:
            for info in package.zip.infolist():
                part = info.filename.lstrip("/")
                if part not in gone:
                    out.writestr(info, changed.get(part, package.zip.read(info)), compress_type=info.compress_type)
        check = Package(temp)
        for s in check.sheets:
            for _ in check.cells(s):
                pass
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def _guard_arrays(package, sheet, edits) -> None:
    """A cell inside an array over several cells can't be edited alone."""
    refs = {e["ref"].upper() for e in edits}
    for c in package.cells(sheet):
        if c[12] and ":" in c[12] and f"{column_name(c[4])}{c[3]}" in refs:
            raise WorkbookError("E_ARRAY_FORMULA", c[12])


def _unshare(text: str, package, sheet, own: dict) -> str:
    """Write out every member of a shared group that an edit touches."""
    cells = [(f"{column_name(c[4])}{c[3]}", c) for c in package.cells(sheet) if c[10] == "shared"]
    groups = {c[11] for ref, c in cells if ref in own}
    for ref, c in cells:
        if c[11] in groups and ref not in own:
            text = re.sub(rf'(<c\b[^>]*\br="{ref}"[^>]*>)(.*?)<f\b[^>]*?(?:/>|>.*?</f>)', lambda m, f=c[9]: f"{m[1]}{m[2]}<f>{escape(f[1:])}</f>", text, count=1, flags=re.S)
    return text


def _patch_sheet(text: str, own: dict) -> str:
    """Replace or insert cells in the sheet's XML; the rest of the text stays."""
    todo: dict[int, dict[int, dict]] = {}
    for ref, e in own.items():
        m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
        todo.setdefault(int(m[2]), {})[column_index(m[1])] = e
    if re.search(r"<sheetData\s*/>", text):
        text = re.sub(r"<sheetData\s*/>", "<sheetData></sheetData>", text, count=1)
    start, stop = re.search(r"<sheetData[^>]*>", text).end(), text.index("</sheetData>")
    rows = [(int(m[1]), m[0]) for m in re.finditer(r'<row\b[^>]*\br="(\d+)"[^>]*?(?:/>|>.*?</row>)', text[start:stop], re.S)]
    have = dict(rows)
    out = []
    for r in sorted({*have, *todo}):
        row = have.get(r, f'<row r="{r}"></row>')
        if r not in todo:
            out.append(row)
            continue
        m = re.fullmatch(r"(<row\b[^>]*?)(?:/>|>(.*)</row>)", row, re.S)
        cells = {column_index(re.match(r"[A-Z]+", x[1])[0]): x[0] for x in re.finditer(r'<c\b[^>]*?\br="([A-Z]+[0-9]+)"[^>]*?(?:/>|>.*?</c>)', m[2] or "", re.S)}
        for c, e in todo[r].items():
            style = re.search(r'<c\b[^>]*?\bs="(\d+)"', cells.get(c, ""))
            if e.get("value") is None and e.get("formula") is None:
                cells.pop(c, None)
            else:
                cells[c] = _cell(f"{column_name(c)}{r}", None if e.get("formula") else e["value"], e.get("formula"), int(style[1]) if style else 0)
        out.append(f"{m[1]}>{''.join(x for _, x in sorted(cells.items()))}</row>")
    return text[:start] + "".join(out) + text[stop:]
