import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.functions import formula as f

cell = st.builds(lambda a, c, b, r: f"{a}{f.column_name(c)}{b}{r}", st.sampled_from(["", "$"]), st.integers(1, 300), st.sampled_from(["", "$"]), st.integers(1, 900))
area = st.one_of(cell, st.builds("{}:{}".format, cell, cell))
text = st.builds(lambda xs, op: "=" + op.join(xs), st.lists(st.one_of(area, st.builds("SUM({})".format, area), st.builds("'O''x'!{}".format, area), st.just('"A1""B2"'), st.just("1.5")), min_size=1, max_size=4), st.sampled_from(["+", "*", "&", ","]))


@settings(max_examples=150, deadline=None)
@given(text, st.integers(1, 50), st.integers(1, 50), st.integers(0, 60), st.integers(0, 60))
def test_relative_form_is_invariant_under_copying(x, row, col, dr, dc):
    moved = f.translate(x, row, col, row + dr, col + dc)
    assert f.to_r1c1(moved, row + dr, col + dc) == f.to_r1c1(x, row, col)


@settings(max_examples=150, deadline=None)
@given(text, st.sampled_from(["", "+3:$7", "+$B:C", "+F1048577", "+LOG10(A0)", "+#DIV/0!", "+A1#", "+Tab2[Qty1]"]), st.integers(1, 50), st.integers(1, 50))
def test_patterns_give_the_relative_form(x, more, row, col):
    for rows in (f.MAX_ROWS, 2 * f.MAX_ROWS):
        assert f._to_r1c1(x + more, row, col, rows) == f.to_r1c1(x + more, row, col, rows)


def test_grid_higher_than_a_sheet():
    assert f.to_r1c1("=F1048577*2", 1048577, 7) == "=F1048577*2"
    assert f.to_r1c1("=F1048577*2", 1048577, 7, 1048577) == "=RC[-1]*2"
    assert f.analyze("=F1048577", 1048577, 7, 1048577).references[0].rect == ((0, True), (0, True), (-1, True), (-1, True))
    assert f.analyze("=F:F", 5, 7, 2_000_000).references[0].rect[:2] == ((1, False), (2_000_000, False))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, f.MAX_COLS))
def test_column_names(n):
    assert f.column_index(f.column_name(n)) == n


def test_r1c1_known_forms():
    assert f.to_r1c1("=A5*B5", 5, 3) == "=RC[-2]*RC[-1]"
    assert f.to_r1c1("=SUM($E$2:E5)", 6, 6) == "=SUM(R2C5:R[-1]C[-1])"
    assert f.to_r1c1("=B:B+3:7", 1, 1) == "=C[+1]:C[+1]+R[+2]:R[+6]"
    assert f.from_r1c1("=RC[-2]*R2C3", 5, 5) == "=C5*$C$2"
    assert f.from_r1c1("=SUM(1,2)", 5, 5) is None
    with pytest.raises(f.FormulaSyntaxError):
        f.from_r1c1("=RC[-1]+A1", 5, 5)
    with pytest.raises(f.FormulaSyntaxError):
        f.translate("=A1", 2, 2, 1, 1)


def test_references():
    via = lambda x: [(r.via, r.sheet) for r in f.analyze(x, 2, 3).references]
    assert via("=SUM(Jan:Mar!B2)") == [("3d", "Jan:Mar")]
    assert via("='O''Brien'!C3") == [("ref", "O'Brien")]
    assert via("=[1]Data!A1") == [("external:[1]", "[1]Data")]
    assert via("=A1#") == [("spill", None)]
    assert via("=Rate*2") == [("name:Rate", None)]
    assert via("=LET(x,A1,x+B1)") == [("ref", None), ("ref", None)]
    assert via("=Table1[Qty]") == [("structured:Table1[Qty]", None)]
    assert f.analyze("=SUM(A1", 1, 1).references[0].via == "opaque:parse"
    assert f.analyze("=OFFSET(A1,1,1)", 1, 1).issues[0][0] == "I_DYNAMIC_REF"
    assert [i[0] for i in f.analyze("=SUM(A1:INDEX(B:B,3))", 1, 1).issues] == ["I_DYNAMIC_REF"]
    assert f.analyze("=INDEX(B:B,3)", 1, 1).issues == []
    assert f.analyze("=NOW()", 1, 1).volatile and not f.analyze("=SUM(A1)", 1, 1).volatile
    assert f.function_name("@_xlfn._xlws.filter(") == "FILTER"
