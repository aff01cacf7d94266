import random

from pyspark.sql import functions as F

from tabloom.operators import blocks, components, edges, graph, grid, overlap, profile, regions
from tests.conftest import rows


def rects(rng, n, tall=False):
    out = []
    for i in range(n):
        r = rng.randint(1, 5000)
        high = rng.choice([0, 3, 40, 3000, 1048576 - r]) if tall else rng.randint(0, 60)
        c = rng.randint(1, 20)
        out.append((i, rng.randint(1, 2), r, min(1048576, r + high), c, c + rng.randint(0, 4)))
    return out


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(3)
    schema = "id int, sheet_id int, row_min int, row_max int, col_min int, col_max int"
    a, b = rects(rng, 150, True), rects(rng, 150, True)
    df = overlap.overlap_join(overlap.prefixed(spark.createDataFrame(a, schema), "l_", {"id": "a"}), overlap.prefixed(spark.createDataFrame(b, schema), "r_", {"id": "b"}), ["sheet_id"], bucket=16, tall=4)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[4] <= y[5] and y[4] <= x[5])
    assert sorted((r["a"], r["b"]) for r in df.collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def brute_regions(cells, gap):
    """Runs, components and closure by plain loops."""
    by = {}
    for r, c in sorted(cells):
        by.setdefault(r, []).append(c)
    runs = []
    for r, cs in by.items():
        lo = hi = cs[0]
        for c in cs[1:]:
            if c - hi - 1 <= gap:
                hi = c
            else:
                runs.append((r, lo, hi))
                lo = hi = c
        runs.append((r, lo, hi))
    group = list(range(len(runs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (r, a, b) in enumerate(runs):
        for j, (s, c, d) in enumerate(runs):
            if r < s and s - r - 1 <= gap and b + gap + 1 >= c and d + gap + 1 >= a:
                group[top(i)] = top(j)
    box = {}
    for i, (r, a, b) in enumerate(runs):
        x = box.setdefault(top(i), [r, r, a, b])
        box[top(i)] = [min(x[0], r), max(x[1], r), min(x[2], a), max(x[3], b)]
    out = list(box.values())
    merged = True
    while merged:
        merged = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                x, y = out[i], out[j]
                if x[0] <= y[1] and y[0] <= x[1] and x[2] <= y[3] and y[2] <= x[3]:
                    out[i] = [min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3])]
                    del out[j]
                    merged = True
                    break
            if merged:
                break
    return sorted(map(tuple, out))


def test_regions_equal_brute_force(spark):
    rng = random.Random(5)
    for gap in (0, 1):
        cells = {(rng.randint(1, 40), rng.randint(1, 25)) for _ in range(150)}
        df = spark.createDataFrame([(1, r, c) for r, c in cells], "sheet_id int, row int, col int")
        got = rows(regions.detect(df, gap=gap), "row_min", "row_max", "col_min", "col_max")
        assert sorted(got) == brute_regions(cells, gap)


def test_tables_split_regions(spark):
    cells = [(1, r, c) for r in range(1, 11) for c in range(1, 4)]
    table = spark.createDataFrame([(1, "T", 4, 6, 1, 3)], "sheet_id int, name string, row_min int, row_max int, col_min int, col_max int")
    got = rows(regions.detect(spark.createDataFrame(cells, "sheet_id int, row int, col int"), table), "n", "row_min", "row_max", "kind")
    assert got == [(0, 1, 3, "region"), (1, 4, 6, "table"), (2, 7, 10, "region")]


def test_blocks_cover_every_cell_once(spark):
    rng = random.Random(1)
    cells = {(r, c): rng.choice(["=a", "=b"]) for r in range(1, 12) for c in range(1, 9) if rng.random() < 0.8}
    df = spark.createDataFrame([(1, r, c, x) for (r, c), x in cells.items()], "sheet_id int, row int, col int, r1c1 string")
    seen = {}
    for b in blocks.formula_blocks(df).collect():
        for r in range(b["row_min"], b["row_max"] + 1):
            for c in range(b["col_min"], b["col_max"] + 1):
                assert (r, c) not in seen
                seen[r, c] = b["r1c1"]
    assert seen == cells


def test_runs_do_not_depend_on_bands(spark):
    rng = random.Random(6)
    cells = [(s, r, c, rng.choice(["=a", "=a", "=a", "=b"])) for s in (1, 2) for c in (1, 2, 4) for r in range(1, 60) if rng.random() < 0.95] + [(3, r, 1, "=a") for r in range(1, 60)]
    df = spark.createDataFrame(cells, "sheet_id int, row int, col int, r1c1 string")
    want = rows(blocks.vertical_runs(df))
    assert [rows(blocks.vertical_runs(df, band)) for band in (1, 4, 7)] == [want] * 3
    assert {x[0:1] + x[-2:] for x in want if x[0] == 3} == {(3, 1, 59)}


def test_extrusion_is_the_union_over_cells(spark):
    rng = random.Random(2)
    data = []
    for i in range(60):
        r, c = rng.randint(5, 50), rng.randint(5, 30)
        t = [(rng.randint(-4, 4), True) if rng.random() < 0.6 else (rng.randint(1, 60), False) for _ in range(4)]
        data.append((i, r, r + rng.randint(0, 6), c, c + rng.randint(0, 3), *[x for y in t for x in y]))
    names = "row1 int, row1_rel boolean, row2 int, row2_rel boolean, col1 int, col1_rel boolean, col2 int, col2_rel boolean"
    df = spark.createDataFrame(data, "id int, row_min int, row_max int, col_min int, col_max int, " + names)
    for x in edges.extrude(df).collect():
        cells = [(r, c) for r in range(x["row_min"], x["row_max"] + 1) for c in range(x["col_min"], x["col_max"] + 1)]
        rs = [x[f"row{k}"] + (r if x[f"row{k}_rel"] else 0) for r, _ in cells for k in (1, 2)]
        cs = [x[f"col{k}"] + (c if x[f"col{k}_rel"] else 0) for _, c in cells for k in (1, 2)]
        assert (x["dst_row_min"], x["dst_row_max"], x["dst_col_min"], x["dst_col_max"]) == (max(1, min(rs)), max(rs), max(1, min(cs)), max(cs))


def test_only_whole_columns_go_below_the_sheet(spark):
    names = "row1 int, row1_rel boolean, row2 int, row2_rel boolean, col1 int, col1_rel boolean, col2 int, col2_rel boolean"
    ends = [(1, 1048576), (1048576, 1), (2, 1048576), (1048576, 1048576), (1048576, 1048590), (1, 1048575)]
    e = spark.createDataFrame([(1, n, 1, a, False, b, False, 0, True, 0, True) for n, (a, b) in enumerate(ends)], "src_sheet_id int, src_n int, dst_sheet_id int, " + names)
    b = spark.createDataFrame([(1, n, 1048580, 1048600, 4, 4) for n in range(len(ends))], "sheet_id int, n int, row_min int, row_max int, col_min int, col_max int")
    assert rows(graph.self_reading(b, e), "src_n") == [(0,), (1,), (4,)]


def test_strong_components_equal_brute_force(spark):
    rng = random.Random(4)
    links = {(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(45)} | {(5, 5)}
    reach = {v: {v} for v in range(1, 31)}
    for _ in range(31):
        for a, b in links:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    want = {}
    for v in reach:
        comp = {w for w in reach if w in reach[v] and v in reach[w]}
        if len(comp) > 1 or (v, v) in links:
            want[v] = min(comp)
    df = spark.createDataFrame(sorted(links), "a long, b long")
    assert {r["id"]: r["component"] for r in graph.strong_components(df).collect()} == want
    for r in graph.cycles(df).collect():
        path = r["cycle"]
        assert path[0] == path[-1] and all(e in links for e in zip(path, path[1:]))


def test_components_and_paths(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (1, 5), (5, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 10, 11, 20)], "id long")
    assert rows(components.components(nodes, links)) == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 10), (11, 10), (20, 20)], key=repr)
    assert [r["path"] for r in graph.shortest_paths(links, 1, 3).collect()] == [[1, 2, 3], [1, 5, 3]]
    assert graph.shortest_paths(links, 4, 1).count() == 0


def test_trace_repeats_expanded_nodes_as_leaves():
    hops = {("a",): [(("b",), "ref"), (("c",), "ref")], ("b",): [(("a",), "ref")], ("c",): [(("b",), "ref")]}
    got, cut = graph.trace(lambda nodes: {n: hops.get(n, []) for n in nodes}, ("a",), 5, 10)
    assert [r["node"][0] for r in got] == ["a", "b", "c", "a", "b"] and not cut
    got, cut = graph.trace(lambda nodes: {n: hops.get(n, []) for n in nodes}, ("a",), 5, 2)
    assert len(got) == 2 and cut


def test_numbering_and_profiles(spark):
    df = spark.createDataFrame([(i * 7 % 101, float(i)) for i in range(101)], "k long, v double")
    got = {r["k"]: r["row_no"] for r in grid.numbered(df, ["k"], buckets=8).collect()}
    assert got == {k: k + 1 for k in range(101)}
    cells = grid.to_cells(df, ["k"], 1).where("row > 1")
    p = {r["col"]: r for r in profile.column_profiles(cells, ["sheet_id", "col"]).collect()}
    assert (p[1]["nonnull"], p[1]["distinct_est"], p[1]["dtype"]) == (101, 101, "int")
    assert grid.to_cells(df.where("false"), ["k"], 1).count() == 2


def test_lattice(spark):
    sets = [([], "empty"), (["int"], "int"), (["int", "float"], "float"), (["date"], "date"), (["int", "str"], "mixed"), (["bool"], "bool"), (["error"], "mixed")]
    df = spark.createDataFrame(sets, "a array<string>, want string").withColumn("got", profile.lattice(F.col("a")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_canonical_export_ignores_order_and_surrogates(spark, tmp_path):
    from tabloom.operators import export

    sheets = spark.createDataFrame([(1, "A"), (2, "B")], "sheet_id int, name string")
    x = spark.createDataFrame([(1, 5, "u"), (2, 6, None), (1, 5, "u")], "sheet_id int, row int, v string")
    y = x.orderBy(F.desc("row")).repartition(3).withColumn("generation", F.lit(9))
    one, two = (export.canonical(d, sheets) for d in (x, y))
    assert one.columns == ["row", "sheet", "v"] and one.collect() == two.collect()
    assert export.fingerprint(one).collect() == export.fingerprint(two).collect()
    assert export.fingerprint(one).collect() != export.fingerprint(one.limit(2)).collect()
    cells = x.withColumn("workbook", F.lit("w"))
    export.write_index(cells, str(tmp_path / "i"))
    export.write_index(cells.where("sheet_id = 2").withColumn("row", F.lit(7)), str(tmp_path / "i"))
    assert rows(spark.read.parquet(str(tmp_path / "i")), "sheet_id", "row") == [(1, 5), (1, 5), (2, 7)]
    export.dump_csv(x, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_incremental_scope(spark):
    from tabloom.operators import lifecycle

    schema = "part_name string, part_hash string"
    old = spark.createDataFrame([("xl/workbook.xml", "1"), ("xl/worksheets/sheet1.xml", "a"), ("xl/worksheets/sheet2.xml", "b")], schema)
    sheets = spark.createDataFrame([(1, "xl/worksheets/sheet1.xml"), (2, "xl/worksheets/sheet2.xml")], "sheet_id int, xml_part string")
    new = spark.createDataFrame([("xl/workbook.xml", "1"), ("xl/worksheets/sheet1.xml", "a"), ("xl/worksheets/sheet2.xml", "c")], schema)
    assert [r["sheet_id"] for r in lifecycle.sheets_to_refresh(lifecycle.changed_parts(old, new), sheets).collect()] == [2]
    assert lifecycle.changed_parts(old, old).count() == 0
    broad = spark.createDataFrame([("xl/workbook.xml", "2"), ("xl/worksheets/sheet1.xml", "a"), ("xl/worksheets/sheet2.xml", "b")], schema)
    assert lifecycle.sheets_to_refresh(lifecycle.changed_parts(old, broad), sheets).count() == 2


def test_rectangles_make_few_candidates(spark):
    """One-row rectangles of a long column: candidates grow with rows, and guests of coarser levels never meet."""
    counts = []
    for n in (2_000, 8_000):
        cells = spark.range(1, n + 1).select(F.lit(1).alias("sheet_id"), *(F.col("id").cast("int").alias(c) for c in ("row_min", "row_max")), F.lit(1).alias("col_min"), F.lit(1).alias("col_max"))
        sizes = overlap._levels(overlap.BUCKET, overlap.TALL)
        l, r = overlap.prefixed(cells, "l_"), overlap.prefixed(cells, "r_")
        pairs = [overlap._listed(l, "l_", sizes, overlap.TALL, a).join(overlap._listed(r, "r_", sizes, overlap.TALL, b), ["sheet_id", "__level", "__bucket"]).count() for a, b in ((False, None), (True, False))]
        counts.append(sum(pairs))
        assert overlap.overlap_join(l, r, ["sheet_id"]).count() == n
    assert counts[1] <= 4 * counts[0] + overlap.BUCKET**2 and counts[1] <= overlap.BUCKET * 8_000
