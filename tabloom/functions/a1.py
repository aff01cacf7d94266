"""A1 references and grid coordinates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLS = 1_048_576, 16_384
#: Rows above the column bits of a packed cell id.
PACK_BITS = 16
RECT = ("row_min", "row_max", "col_min", "col_max")


def column_label(n) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD."""
    n = F.col(n) if isinstance(n, str) else n

    def letter(x: Column) -> Column:
        return F.char((x + 65).cast("int"))

    third = F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise("")
    second = F.when(n > 26, letter(F.pmod(F.floor((n - 27) / 26), F.lit(26)))).otherwise("")
    return F.concat(third, second, letter(F.pmod(n - 1, F.lit(26))))


def column_number(label) -> Column:
    """A -> 1; null if it is no label of the grid."""
    label = F.col(label) if isinstance(label, str) else label
    up = F.upper(label)
    n = F.aggregate(F.split(up, ""), F.lit(0), lambda acc, c: acc * 26 + (F.ascii(c) - 64))
    return F.when(up.rlike("^[A-Z]{1,3}$") & (n <= MAX_COLS), n)


def cell_ref(row, col) -> Column:
    row = F.col(row) if isinstance(row, str) else row
    return F.concat(column_label(col), row.cast("string"))


def rect_ref(prefix: str = "") -> Column:
    """A single cell, or its corners joined by a colon."""
    a, b, c, d = (F.col(prefix + x) for x in RECT)
    first, last = cell_ref(a, c), cell_ref(b, d)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))


def parse_rect(ref) -> Column:
    """Struct of the four bounds of a cell, range, whole columns or whole rows; null if it is none."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    ref = F.regexp_replace(F.upper(F.trim(ref)), r"\$", "")
    ends = F.split(ref, ":")
    a, b = ends[0], F.when(F.size(ends) > 1, F.get(ends, F.lit(1))).otherwise(ends[0])

    def part(x: Column, pattern: str) -> Column:
        got = F.regexp_extract(x, pattern, 1)
        return F.when(got != "", got)

    ca, cb = (column_number(part(x, "^([A-Z]+)")) for x in (a, b))
    ra, rb = (part(x, "([0-9]+)$").cast("int") for x in (a, b))
    shape = ref.rlike(r"^[A-Z]{1,3}[0-9]{1,7}(:[A-Z]{1,3}[0-9]{1,7})?$|^[A-Z]{1,3}:[A-Z]{1,3}$|^[0-9]{1,7}:[0-9]{1,7}$")
    whole_rows, whole_cols = ca.isNull() & cb.isNull(), ra.isNull() & rb.isNull()
    r1, r2 = F.when(whole_cols, 1).otherwise(F.least(ra, rb)), F.when(whole_cols, MAX_ROWS).otherwise(F.greatest(ra, rb))
    c1, c2 = F.when(whole_rows, 1).otherwise(F.least(ca, cb)), F.when(whole_rows, MAX_COLS).otherwise(F.greatest(ca, cb))
    ok = shape & (r1 >= 1) & (r2 <= MAX_ROWS) & (c1 >= 1) & (c2 <= MAX_COLS)
    return F.when(ok, F.struct(r1.cast("int").alias("row_min"), r2.cast("int").alias("row_max"), c1.cast("int").alias("col_min"), c2.cast("int").alias("col_max")))


def split_qualified(ref) -> Column:
    """Struct(sheet, area) at the last exclamation mark; quotes are taken off and doubled ones undone."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    sheet = F.regexp_extract(ref, r"^(.*)!([^!]*)$", 1)
    area = F.when(ref.contains("!"), F.regexp_extract(ref, r"^(.*)!([^!]*)$", 2)).otherwise(ref)
    plain = F.when(sheet.rlike(r"^'.*'$"), F.replace(sheet.substr(F.lit(2), F.length(sheet) - 2), F.lit("''"), F.lit("'"))).otherwise(sheet)
    return F.struct(F.when(ref.contains("!"), plain).alias("sheet"), area.alias("area"))


def pack_cell(row, col) -> Column:
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return row.cast("long") * (1 << PACK_BITS) + col


def unpack_cell(packed) -> Column:
    packed = F.col(packed) if isinstance(packed, str) else packed
    return F.struct(F.shiftright(packed, PACK_BITS).cast("int").alias("row"), packed.bitwiseAND((1 << PACK_BITS) - 1).cast("int").alias("col"))


def intersects(a: str, b: str) -> Column:
    """Closed rectangles with column prefixes ``a`` and ``b`` share a cell."""
    c = lambda p, n: F.col(p + n)
    return (c(a, "row_min") <= c(b, "row_max")) & (c(b, "row_min") <= c(a, "row_max")) & (c(a, "col_min") <= c(b, "col_max")) & (c(b, "col_min") <= c(a, "col_max"))


def area(prefix: str = "") -> Column:
    a, b, c, d = (F.col(prefix + x).cast("long") for x in RECT)
    return (b - a + 1) * (d - c + 1)
