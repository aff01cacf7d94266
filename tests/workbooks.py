"""Small workbooks with known answers."""

from tabloom.functions.formula import column_name
from tabloom.sources.ooxml_writer import write_workbook


def model(path):
    """Inputs -> Calc -> Summary; one formula of Calc differs from its column."""
    inputs = [(1, 1, "Input", None), (1, 2, "Value", None), (1, 3, "Unit", None)]
    for r, (n, v) in enumerate((("Base", 1000), ("Rate", 0.1), ("Cost", 0.6), ("Tax", 0.25)), 2):
        inputs += [(r, 1, n, None), (r, 2, v, None), (r, 3, "x", None)]
    calc = [(1, c, h, None) for c, h in enumerate(("Year", "Revenue", "Cost", "Margin"), 1)]
    for r in range(2, 7):
        rev = "=Inputs!$B$2" if r == 2 else f"=B{r - 1}*(1+Inputs!$B$3)"
        calc += [(r, 1, 2020 + r, None), (r, 2, 1000 * 1.1 ** (r - 2), rev), (r, 3, 600.0, f"=B{r}*Inputs!$B$4"), (r, 4, 300.0, f"=(B{r}-C{r})*(1-Inputs!$B$5)")]
    summary = [(1, 1, "Metric", None), (1, 2, "Value", None), (2, 1, "End", None), (2, 2, 1464.1, "=Calc!B6"), (3, 1, "Sum", None), (3, 2, 1.0, "=SUM(Calc!D2:D6)")]
    write_workbook(path, {"Inputs": inputs, "Calc": calc, "Summary": summary}, names={"StartStock": "Inputs!$B$2"})
    return path


def blocks(path):
    """A column of products with one sum in row 12."""
    cells = [(1, c, h, None) for c, h in enumerate(("Pieces", "Weight", "Load"), 1)]
    for r in range(2, 22):
        cells += [(r, 1, r, None), (r, 2, 2, None), (r, 3, 2 * r, f"=A{r}{'+' if r == 12 else '*'}B{r}")]
    write_workbook(path, {"Loads": cells})
    return path


def errors(path):
    texts = ["#N/A", "#DIV/0!", "#VALUE!", "#NULL!", "#NUM!"]
    cells = [(1, 1, "Shown", None), (1, 2, "Outcome", None)]
    for r, t in enumerate(texts, 2):
        cells += [(r, 1, t[1:], None), (r, 2, t, None)]
    write_workbook(path, {"Errors": cells})
    return path, texts


def mixed(path):
    """Circular cells, a running total, three sheets summed, a table, an external link, volatile and unknown names."""
    running = [(1, 5, "x", None)] + [x for r in range(2, 40) for x in ((r, 5, r, None), (r, 6, 0, f"=SUM($E$1:E{r - 1})"))]
    month = [(2, 2, 5, None)]
    table = [(1, c, h, None) for c, h in enumerate(("Qty", "Price", "Total"), 1)]
    for r in range(2, 6):
        table += [(r, 1, r, None), (r, 2, 1.5, None), (r, 3, r * 1.5, "=Freight[[#This Row],[Qty]]*[@Price]")]
    table += [(6, 3, 21.0, "=SUM(Freight[Total])"), (9, 1, 21.0, "=SUM(Freight[Total])")]
    other = [(1, 1, 1, "=NOW()"), (2, 1, 1, "=Unheard+1"), (3, 1, 1, "=[1]Data!A1"), (4, 1, 1, "=OFFSET(A1,1,0)"), (5, 1, 1, "=Surcharge*2"), (6, 1, 3, "=SUM(Jan:Mar!B2)")]
    sheets = {"Circular": [(2, 2, 1, "=B3+1"), (3, 2, 1, "=B2+1")], "Running": running, "Jan": month, "Feb": month, "Mar": month, "Structured": table, "Other": other}
    write_workbook(path, sheets, names={"Surcharge": "Jan!$B$2"}, tables={"Structured": ("Freight", "A1:C6", ["Qty", "Price", "Total"], 1)}, links=["gone/tariffs.xlsx"])
    return path


def ref(r, c):
    return f"{column_name(c)}{r}"
