"""Formula language: tokens, relative form, translation, references.

Formulas are never evaluated.  Each *different* formula is worked on once per
Arrow batch (copied formulas are the common case), in functions that Spark
calls on columns.  ``rows`` is the height of the grid: a sheet's, or more for a
table seen as a sheet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .a1 import MAX_COLS, MAX_ROWS

#: Functions recalculated on every calculation; fixed values.
VOLATILE = frozenset({"NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY", "OFFSET", "INDIRECT", "INFO", "CELL"})
#: References computed at run time: always, or where a reference is wanted; fixed values.
DYNAMIC = frozenset({"INDIRECT", "OFFSET"})
CONTEXTUAL = frozenset({"INDEX", "CHOOSE"})

_LEX = re.compile(
    r"""
      (?P<space>\s+)
    | (?P<string>"(?:[^"]|"")*")
    | (?P<error>\#(?:REF!|DIV/0!|N/A|VALUE!|NAME\?|NUM!|NULL!|SPILL!|CALC!|FIELD!|BLOCKED!|GETTING_DATA))
    | (?P<array>\{[^{}]*\})
    | (?P<ref>@?(?:'(?:[^']|'')+'!|(?:\[[^\[\]]+\])?[A-Za-z_\\\u0080-￿][\w.\u0080-￿]*(?::[A-Za-z_\\\u0080-￿][\w.\u0080-￿]*)?!|\[[^\[\]]+\][^!\s(),+*/^&=<>-]*!)
        (?:\$?[A-Za-z]{1,3}\$?[0-9]+(?::\$?[A-Za-z]{1,3}\$?[0-9]+)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?[0-9]+:\$?[0-9]+|\#REF!|[A-Za-z_\\][\w.]*)\#?)
    | (?P<func>@?[A-Za-z_][\w.]*\()
    | (?P<table>@?[A-Za-z_\u0080-￿][\w.\u0080-￿]*\[(?:[^\[\]']|'.|\[(?:[^\[\]']|'.)*\])*\]|\[(?:[^\[\]']|'.|\[(?:[^\[\]']|'.)*\])*\])
    | (?P<cell>@?\$?[A-Za-z]{1,3}\$?[0-9]+(?::\$?[A-Za-z]{1,3}\$?[0-9]+)?\#?(?![\w.(]))
    | (?P<cols>@?\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w.(]))
    | (?P<rows>\$?[0-9]+:\$?[0-9]+(?![\w.(]))
    | (?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<name>@?[A-Za-z_\\\u0080-￿][\w.?\\\u0080-￿]*\#?)
    | (?P<op><>|<=|>=|[-+*/^&=<>%:@])
    | (?P<sep>[,;])
    | (?P<open>\()
    | (?P<close>\))
    """,
    re.X,
)
_CELL = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)")
_R1C1 = re.compile(r"R(\[[+-]?\d+\]|\d+)?C(\[[+-]?\d+\]|\d+)?")


class FormulaSyntaxError(ValueError):
    """The text is no well-formed formula."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def column_index(label: str) -> int:
    n = 0
    for c in label.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@lru_cache(maxsize=50_000)
def tokenize(formula: str, rows: int = MAX_ROWS) -> tuple[Token, ...]:
    """Tokens of a formula (with or without the equals sign); white space is kept."""
    pos, out, depth = int(formula.startswith("=")), [], 0
    while pos < len(formula):
        m = _LEX.match(formula, pos)
        if m is None:
            raise FormulaSyntaxError(f"unexpected {formula[pos]!r} at {pos}")
        kind = m.lastgroup
        if kind == "cell" and not _in_grid(m[0], rows):
            kind = "name"
        depth += (kind in ("func", "open")) - (kind == "close")
        if depth < 0:
            raise FormulaSyntaxError("a closing bracket too many")
        out.append(Token(kind, m[0]))
        pos = m.end()
    if depth or not out:
        raise FormulaSyntaxError("a bracket is not closed" if depth else "empty formula")
    return tuple(out)


def _in_grid(text: str, rows: int) -> bool:
    return all(column_index(c) <= MAX_COLS and 1 <= int(r) <= rows for _, c, _, r in _CELL.findall(text))


def _split(text: str) -> tuple[str, str, str]:
    """Prefix (implicit intersection and sheet), area, suffix (spill)."""
    at = text.rfind("!") + 1
    prefix, area = text[:at], text[at:]
    if not at and area.startswith("@"):
        prefix, area = "@", area[1:]
    return (prefix, area[:-1], "#") if area.endswith("#") and len(area) > 1 else (prefix, area, "")


def _map_cells(formula: str, cell, col, row, rows: int = MAX_ROWS) -> str:
    """Rewrite every reference of a formula; other tokens stay as they are."""
    out = []
    for t in tokenize(formula, rows):
        if t.kind in ("cell", "cols", "rows", "ref"):
            prefix, area, suffix = _split(t.text)
            if suffix:
                out.append(t.text)  # a spill stays at its anchor
                continue
            if re.fullmatch(r"\$?[A-Za-z]{1,3}\$?[0-9]+(:\$?[A-Za-z]{1,3}\$?[0-9]+)?", area):
                area = ":".join(cell(*_CELL.fullmatch(x).groups()) for x in area.split(":"))
            elif re.fullmatch(r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}", area):
                area = ":".join(col(x.startswith("$"), x.lstrip("$")) for x in area.split(":"))
            elif re.fullmatch(r"\$?[0-9]+:\$?[0-9]+", area):
                area = ":".join(row(x.startswith("$"), int(x.lstrip("$"))) for x in area.split(":"))
            out.append(prefix + area + suffix)
        else:
            out.append(t.text)
    return ("=" if formula.startswith("=") else "") + "".join(out)


def to_r1c1(formula: str, at_row: int, at_col: int, rows: int = MAX_ROWS) -> str:
    """Relative form at a cell: R[+n]C[-n] offsets (none if zero), absolute places as numbers."""

    def term(letter: str, fixed: bool, v: int, base: int) -> str:
        return f"{letter}{v}" if fixed else letter + (f"[{v - base:+d}]" if v != base else "")

    def cell(cd, c, rd, r):
        return term("R", bool(rd), int(r), at_row) + term("C", bool(cd), column_index(c), at_col)

    return _map_cells(formula, cell, lambda d, c: term("C", d, column_index(c), at_col), lambda d, r: term("R", d, r, at_row), rows)


_DIGITS = re.compile(r"([0-9]+)")
#: Marks in a pattern: digits of columns (moved up), a relative and an absolute row.
_UP, _REL, _ABS = {ord("0") + d: 0xE000 + d for d in range(10)}, "\ue010", "\ue011"
_SLOT = re.compile(f"([0-9]+|{_REL}|{_ABS})")


@lru_cache(maxsize=10_000)
def _pattern(texts: tuple[str, ...], at_col: int) -> tuple[tuple[str, str], ...] | None:
    """Relative form of the formulas that have ``texts`` around their numbers: pairs of a text and the kind of number behind it."""

    def col(fixed: bool, c: str) -> str:
        v = column_index(c)
        return (f"C{v}" if fixed else "C" + (f"[{v - at_col:+d}]" if v != at_col else "")).translate(_UP)

    def row(fixed: bool, _) -> str:
        return _ABS if fixed else _REL

    if any(0xE000 <= ord(c) <= 0xE011 for x in texts for c in x):
        return None
    try:
        got = _SLOT.split(_map_cells("1".join(texts), lambda cd, c, rd, _: row(bool(rd), _) + col(bool(cd), c), col, row))
    except FormulaSyntaxError:
        return None
    down = {v: chr(k) for k, v in _UP.items()}
    return tuple(zip((x.translate(down) for x in got[::2]), [*got[1::2], ""])) if len(got) == 2 * len(texts) - 1 else None


def _to_r1c1(formula: str, at_row: int, at_col: int, rows: int) -> str:
    """``to_r1c1`` with one look at all formulas that differ in numbers only."""
    parts = _DIGITS.split(formula)
    pattern = _pattern(tuple(parts[::2]), at_col)
    if pattern is None:
        return to_r1c1(formula, at_row, at_col, rows)
    out = []
    for (text, kind), n in zip(pattern, [*parts[1::2], ""]):
        out.append(text)
        if kind == _REL or kind == _ABS:
            v = int(n)
            if not 1 <= v <= rows:
                return to_r1c1(formula, at_row, at_col, rows)
            out.append(f"R{v}" if kind == _ABS else "R" if v == at_row else f"R[{v - at_row:+d}]")
        else:
            out.append(n)
    return "".join(out)


def translate(formula: str, from_row: int, from_col: int, to_row: int, to_col: int) -> str:
    """A copied formula: relative parts shift; a reference that leaves the sheet is an error."""
    dr, dc = to_row - from_row, to_col - from_col

    def shift(v: int, d: int, most: int) -> int:
        if not 1 <= v + d <= most:
            raise FormulaSyntaxError("the reference leaves the sheet")
        return v + d

    def cell(cd, c, rd, r):
        c = c if cd else column_name(shift(column_index(c), dc, MAX_COLS))
        return f"{cd}{c}{rd}{r if rd else shift(int(r), dr, MAX_ROWS)}"

    return _map_cells(formula, cell, lambda d, c: ("$" + c) if d else column_name(shift(column_index(c), dc, MAX_COLS)), lambda d, r: f"${r}" if d else str(shift(r, dr, MAX_ROWS)))


def from_r1c1(formula: str, at_row: int, at_col: int) -> str | None:
    """A1 form at a cell; None if the text has no R1C1 reference; A1 references beside them are an error."""
    if not _R1C1.search(formula):
        return None
    parts = re.split(r'("(?:[^"]|"")*")', formula)
    for i in range(0, len(parts), 2):
        plain = _R1C1.sub("", parts[i])
        if re.search(r"(?<![\w.])\$?[A-Za-z]{1,3}\$?[0-9]+(?![\w.(])", plain):
            raise FormulaSyntaxError("A1 and R1C1 references in one formula")
        parts[i] = re.sub(r"(?<![A-Za-z_.])" + _R1C1.pattern + r"(?![A-Za-z_.(])", lambda m: _a1(m, at_row, at_col), parts[i])
    return "".join(parts)


def _a1(m, at_row: int, at_col: int) -> str:
    def term(x: str | None, base: int, most: int) -> tuple[str, int]:
        v = base if not x else base + int(x[1:-1]) if x.startswith("[") else int(x)
        if not 1 <= v <= most:
            raise FormulaSyntaxError("the reference leaves the sheet")
        return ("$" if x and not x.startswith("[") else ""), v

    (rd, r), (cd, c) = term(m[1], at_row, MAX_ROWS), term(m[2], at_col, MAX_COLS)
    return f"{cd}{column_name(c)}{rd}{r}"


def function_name(text: str) -> str:
    """Upper case without @, bracket and the prefixes of newer functions."""
    name = text.rstrip("(").lstrip("@").upper()
    while True:
        short = re.sub(r"^(_XLFN\.|_XLWS\.|_XLUDF\.)", "", name)
        if short == name:
            return name
        name = short


@dataclass
class Reference:
    """One reference: what it is, its sheet (or first:last, or book), and its axis terms."""

    via: str
    sheet: str | None = None
    rect: tuple | None = None  # (row1, rel), (row2, rel), (col1, rel), (col2, rel)
    text: str = ""


@dataclass
class Analysis:
    references: list[Reference] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    volatile: bool = False
    issues: list[tuple[str, str]] = field(default_factory=list)

    @property
    def opaque(self) -> bool:
        return any(r.via.startswith("opaque") for r in self.references)


def _terms(area: str, row: int, col: int, height: int = MAX_ROWS) -> tuple | None:
    def axis(text: str, v: int, base: int):
        return (v, False) if text.startswith("$") else (v - base, True)

    ends = area.split(":")
    if _CELL.fullmatch(ends[0]):
        got = [_CELL.fullmatch(e).groups() for e in (ends * 2)[:2]]
        rows = [axis(rd, int(r), row) for _, _, rd, r in got]
        cols = [axis(cd, column_index(c), col) for cd, c, _, _ in got]
    elif re.fullmatch(r"\$?[A-Za-z]{1,3}", ends[0]) and len(ends) == 2:
        rows, cols = [(1, False), (height, False)], [axis(e, column_index(e.lstrip("$")), col) for e in ends]
    elif re.fullmatch(r"\$?[0-9]+", ends[0]) and len(ends) == 2:
        rows, cols = [axis(e, int(e.lstrip("$")), row) for e in ends], [(1, False), (MAX_COLS, False)]
    else:
        return None
    return rows[0], rows[1], cols[0], cols[1]


def _locals(tokens: tuple[Token, ...]) -> set[str]:
    """Names that LET and LAMBDA declare (folded)."""
    out: set[str] = set()
    for i, t in enumerate(tokens):
        if t.kind != "func" or function_name(t.text) not in ("LET", "LAMBDA"):
            continue
        args, depth, start = [], 0, i + 1
        for j in range(i + 1, len(tokens)):
            k = tokens[j].kind
            if depth == 0 and k in ("sep", "close"):
                args.append([x for x in tokens[start:j] if x.kind != "space"])
                start = j + 1
                if k == "close":
                    break
            depth += (k in ("func", "open")) - (k == "close")
        heads = args[:-1:2] if function_name(t.text) == "LET" else args[:-1]
        out |= {a[0].text.casefold().removeprefix("_xlpm.") for a in heads if len(a) == 1 and a[0].kind in ("name", "cell")}
    return out


@lru_cache(maxsize=50_000)
def analyze(formula: str, row: int, col: int, rows: int = MAX_ROWS) -> Analysis:
    """References, functions and issues of a formula at its cell; a malformed one is opaque:parse."""
    out = Analysis()
    try:
        tokens = tokenize(formula, rows)
    except FormulaSyntaxError as x:
        out.references.append(Reference("opaque:parse", text=formula))
        out.issues.append(("W_PARSE", str(x)))
        return out
    bound = _locals(tokens)
    solid = [t for t in tokens if t.kind != "space"]
    for i, t in enumerate(solid):
        if t.kind == "func":
            name = function_name(t.text)
            out.functions.append(name)
            out.volatile |= name in VOLATILE
            ranged = (i and solid[i - 1].text == ":") or _after(solid, i) == ":"
            if name in DYNAMIC or (name in CONTEXTUAL and ranged):
                out.references.append(Reference(f"opaque:{name}", text=t.text))
                out.issues.append(("I_DYNAMIC_REF", f"{name} picks its reference when it is calculated"))
        elif t.kind in ("cell", "cols", "rows", "ref"):
            _classify(t.text, row, col, out, rows)
        elif t.kind == "table":
            m = re.fullmatch(r"@?([^\[\]]*)\[(.*)\]", t.text, re.S)
            out.references.append(Reference(f"structured:{m[1]}[{m[2].lstrip('@')}]", text=t.text))
        elif t.kind == "name":
            plain = t.text.lstrip("@").rstrip("#")
            if plain.upper() in ("TRUE", "FALSE") or plain.casefold().removeprefix("_xlpm.") in bound:
                continue
            out.references.append(Reference(f"name:{plain}", text=t.text))
    return out


def _after(tokens: list[Token], i: int) -> str:
    """The token behind a call."""
    depth = 1
    for j in range(i + 1, len(tokens)):
        depth += (tokens[j].kind in ("func", "open")) - (tokens[j].kind == "close")
        if not depth:
            return tokens[j + 1].text if j + 1 < len(tokens) else ""
    return ""


def _classify(text: str, row: int, col: int, out: Analysis, rows: int = MAX_ROWS) -> None:
    prefix, area, suffix = _split(text)
    sheet = prefix.lstrip("@").removesuffix("!")
    if sheet.startswith("'"):
        sheet = sheet[1:-1].replace("''", "'")
    book = re.match(r"(?:.*[\\/])?\[([^\]]+)\]", sheet)
    terms = _terms(area, row, col, rows)
    if area == "#REF!":
        out.references.append(Reference("opaque:ref", sheet or None, text=text))
    elif book:
        out.references.append(Reference(f"external:[{book[1]}]", sheet, text=text))
    elif terms is None:
        out.references.append(Reference(f"name:{area}", sheet or None, text=text))
    elif ":" in sheet:
        out.references.append(Reference("3d", sheet, terms, text))
    elif suffix:
        anchor = tuple((v + b, False) if rel else (v, False) for (v, rel), b in zip(terms, (row, row, col, col)))
        out.references.append(Reference("spill", sheet or None, anchor, text))
    else:
        out.references.append(Reference("ref", sheet or None, terms, text))


REFERENCE_SCHEMA = (
    "via string, sheet string, row1 int, row1_rel boolean, row2 int, row2_rel boolean, col1 int, col1_rel boolean, col2 int, col2_rel boolean"
)


def reference_rows(batches: Iterator[pd.DataFrame], height: int = MAX_ROWS) -> Iterator[pd.DataFrame]:
    """mapInPandas: one row a reference of each anchor (sheet_id, n, row, col, formula).

    Called on one anchor a block, not on every cell.
    """
    names = ["sheet_id", "n", *(x.split()[0] for x in REFERENCE_SCHEMA.split(", ")), "ordinal"]
    for pdf in batches:
        rows = []
        for sid, n, r, c, f in zip(pdf["sheet_id"], pdf["n"], pdf["row"], pdf["col"], pdf["formula"]):
            for k, ref in enumerate(analyze(f, int(r), int(c), height).references):
                terms = [x for t in ref.rect for x in t] if ref.rect else [None] * 8
                rows.append((sid, n, ref.via, ref.sheet, *terms, k))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({x: "Int32" for x in ("row1", "row2", "col1", "col2")} | {x: "boolean" for x in ("row1_rel", "row2_rel", "col1_rel", "col2_rel")})


def relative(rows: int = MAX_ROWS):
    """Column function of formula, row and col: the relative form in a grid of ``rows``; a malformed formula stays as it is."""

    def one(f, r, c):
        if f is None:
            return None
        try:
            return _to_r1c1(f, int(r), int(c), rows)
        except FormulaSyntaxError:
            return f

    @pandas_udf(StringType())
    def r1c1(formula: pd.Series, row: pd.Series, col: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(formula, row, col)], dtype=object)

    return r1c1


r1c1 = relative()


@pandas_udf(StringType())
def translated(formula: pd.Series, from_row: pd.Series, from_col: pd.Series, to_row: pd.Series, to_col: pd.Series) -> pd.Series:
    """Text of a formula copied from one cell to another; null if it leaves the sheet."""

    def one(f, *at):
        try:
            return None if f is None else translate(f, *map(int, at))
        except FormulaSyntaxError:
            return None

    return pd.Series([one(*x) for x in zip(formula, from_row, from_col, to_row, to_col)], dtype=object)
