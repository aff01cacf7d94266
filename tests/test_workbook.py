import shutil
import zipfile

import pytest

from tabloom.plans.workbook import Workbook
from tabloom.sources.ooxml import Package, WorkbookError, from_serial, is_date_format
from tests import workbooks


def test_model_lineage(spark, tmp_path):
    w = Workbook(spark, workbooks.model(str(tmp_path / "m.xlsx")))
    m = w.open_workbook()
    assert [s["sheet"] for s in m["sheetList"]] == ["Inputs", "Calc", "Summary"]
    assert m["sheetList"][1]["dims"] == "A1:D6" and m["names"] == ["StartStock"]
    assert m["sheetList"][1]["regions"][0]["headerRows"] == 1
    assert m["diagCounts"] == {"error": 0, "warn": 1, "info": 0}
    d = w.get_diagnostics()["diagnostics"]
    assert [(x["code"], x["sheet"], x["ref"]) for x in d] == [("W_INCONSISTENT_FORMULA", "Calc", "B2")]
    t = w.trace_dependents("Inputs!B2", 8, 200)
    refs = set()

    def walk(n):
        refs.add(n["ref"])
        for c in n["children"]:
            walk(c)

    walk(t["tree"])
    assert {"Calc!B2", "Calc!B3:B6", "Calc!C2:C6", "Calc!D2:D6", "Summary!B2", "Summary!B3"} <= refs
    p = w.trace_path("Inputs!B2", "Summary!B3")
    assert p["connected"] and p["paths"][0][0]["symbol"] == "Inputs!B2"
    profile = w.profile_column("Inputs!B:B")
    assert profile["nonnull"] == 5 and "topValues" in profile
    profile = w.profile_column("col:Inputs:0:value")
    assert profile["range"] == "B2:B5" and abs(profile["sum"] - 1000.95) < 1e-9
    assert w.read_range("Summary!A1:B2")["values"] == ["Metric", "Value", "End", "1464.1"]
    page = w.read_range("Calc!A1:D6", max_cells=10)
    assert page["truncated"] and len(w.read_range("Calc!A1:D6", page["cursor"], 10)["values"]) == 10
    assert w.find("^Reven")["matches"][0]["ref"] == "Calc!B1"
    e = w.explain_formula("Calc!C3")
    assert e["r1c1"] == "=RC[-1]*Inputs!R4C2" and e["extent"] == "C2:C6"
    s = w.list_symbols("margin")
    assert s["symbols"][0]["id"] == "col:Calc:0:margin"
    with pytest.raises(WorkbookError):
        w.read_range("Nowhere!A1")


def test_blocks_and_errors(spark, tmp_path):
    w = Workbook(spark, workbooks.blocks(str(tmp_path / "b.xlsx")))
    got = [(b["row_min"], b["row_max"], b["r1c1"]) for b in w.fblocks.orderBy("n").collect()]
    assert got == [(2, 11, "=RC[-2]*RC[-1]"), (12, 12, "=RC[-2]+RC[-1]"), (13, 21, "=RC[-2]*RC[-1]")]
    assert [d["ref"] for d in w.get_diagnostics()["diagnostics"]] == ["C12"]
    path, texts = workbooks.errors(str(tmp_path / "e.xlsx"))
    d = Workbook(spark, path).get_diagnostics(code="E_ERRVAL")["diagnostics"]
    assert [x["ref"] for x in d] == [f"B{r}" for r in range(2, 2 + len(texts))]
    assert [x["message"].split(":")[0] for x in d] == texts


def test_mixed_findings(spark, tmp_path):
    w = Workbook(spark, workbooks.mixed(str(tmp_path / "x.xlsx")))
    d = w.get_diagnostics()["diagnostics"]
    codes = {(x["code"], x["sheet"], x["ref"]) for x in d}
    assert ("E_CIRCULAR", "Circular", "B2") in codes and sum(x["code"] == "E_CIRCULAR" for x in d) == 1
    assert next(x for x in d if x["code"] == "E_CIRCULAR")["message"].endswith("Circular!B2 -> Circular!B3 -> Circular!B2")
    assert ("I_VOLATILE", "Other", "A1") in codes and ("W_UNKNOWN_NAME", "Other", "A2") in codes
    assert ("E_BROKEN_XLINK", "Other", "A3") in codes and ("I_DYNAMIC_REF", "Other", "A4") in codes
    assert "[tariffs.xlsx]" in next(x for x in d if x["code"] == "E_BROKEN_XLINK")["message"]
    e = {(r["via"], r["dst_sheet_id"], r["dst_row_min"], r["dst_row_max"], r["dst_col_min"]) for r in w.edges.collect()}
    assert {("3d", 3, 2, 2, 2), ("3d", 4, 2, 2, 2), ("3d", 5, 2, 2, 2), ("name:Surcharge", 3, 2, 2, 2)} <= e
    assert ("structured:Freight[Total]", 6, 2, 5, 3) in e and ("structured:Freight[Qty]", 6, 2, 5, 1) in e
    r = [x for x in w.regions.collect() if x["kind"] == "table"]
    assert [(x["row_min"], x["row_max"], x["header_rows"]) for x in r] == [(1, 6, 1)]


def test_writes(spark, tmp_path):
    path = workbooks.model(str(tmp_path / "w.xlsx"))
    w = Workbook(spark, path)
    before = dict(w.package.part_hashes())
    got = w.write_cells([{"sheet": "Inputs", "ref": "B2", "value": 2000}])
    assert got["staleBlocks"] == 6
    assert w.read_range("Inputs!B2")["values"] == ["2000"] and w.read_range("Calc!B3")["stale"]
    after = dict(w.package.part_hashes())
    assert {k for k in before if before[k] != after[k]} == {"xl/worksheets/sheet1.xml", "xl/workbook.xml"}
    assert b'fullCalcOnLoad="1"' in zipfile.ZipFile(path).read("xl/workbook.xml")
    w.refresh(recalculated=True)
    assert not w.read_range("Calc!B3")["stale"]
    got = w.set_column_formula("Summary!C2:C3", "=RC[-1]*2")
    assert got["cellsWritten"] == 2 and w.explain_formula("Summary!C3")["a1"] == "=B3*2"
    with pytest.raises(WorkbookError):
        w.set_column_formula("Summary!C2:C3", "=B2")
    with pytest.raises(WorkbookError):
        w.write_cells([{"sheet": "Inputs", "ref": "B2", "value": float("nan")}])
    shutil.copy(path, tmp_path / "~$w.xlsx")
    with pytest.raises(WorkbookError) as x:
        w.write_cells([{"sheet": "Inputs", "ref": "B2", "value": 1}])
    assert x.value.code == "E_OPEN_IN_EXCEL"


def test_package_errors(tmp_path):
    code = lambda p: pytest.raises(WorkbookError, Package, str(p)).value.code
    assert code(tmp_path / "a.csv") == "E_UNSUPPORTED_FORMAT"
    assert code(tmp_path / "a.xlsx") == "E_NOT_FOUND"
    (tmp_path / "b.xlsx").write_bytes(b"\xd0\xcf\x11\xe0rest")
    assert code(tmp_path / "b.xlsx") == "E_ENCRYPTED"
    (tmp_path / "c.xlsx").write_bytes(b"nothing")
    assert code(tmp_path / "c.xlsx") == "E_CORRUPT"


def test_dates():
    assert from_serial(60.0, False) == "1900-02-28" or from_serial(61.0, False) == "1900-03-01"
    assert from_serial(1.0, False) == "1900-01-01" and from_serial(0.5, False) == "12:00:00"
    assert from_serial(1.0, True) == "1904-01-02" and from_serial(45000.25, False) == "2023-03-15T06:00:00"
    assert is_date_format("yyyy-mm-dd") and not is_date_format('0.00" days"') and not is_date_format("[Red]0.0")


def test_running_totals_are_no_cycles(spark, tmp_path, monkeypatch):
    """A long column over itself is no cycle; one that meets its own end is; names are followed; what is too large is possible."""
    from tabloom.sources.ooxml_writer import write_workbook

    from tabloom.plans import workbook as facade

    monkeypatch.setattr(facade, "CYCLE_CELLS", 100)
    n = 3_000
    total = [(1, 1, 1, None), (1, 2, 1, "=A1")] + [x for r in range(2, n + 1) for x in ((r, 1, 1, None), (r, 2, r, f"=B{r - 1}+A{r}"))]
    whole = [(r, 3, 0, "=SUM(C$1:C$300)+1") for r in range(1, 301)]
    pair = [x for r in range(1, 151) for x in ((r, 1, 0, f"=C{r + 1}+1"), (r, 3, 0, f"=A{r}"))]
    named = [(1, 1, 0, "=Loop+1"), (2, 2, 0, "=A1")]
    path = str(tmp_path / "c.xlsx")
    write_workbook(path, {"Total": total, "Whole": whole, "Pair": pair, "Named": named}, names={"Loop": "Named!$B$2"})
    w = Workbook(spark, path)
    found, possible = w._circular({(r["sheet_id"], r["n"]): r for r in w.fblocks.collect()})
    name = lambda x: (w.sheet_names[x[0]], x[1], x[2])
    assert {name(x) for x in found} == {("Whole", 1, 3), ("Named", 1, 1)} and {name(x) for x in possible} == {("Pair", 1, 1)}
