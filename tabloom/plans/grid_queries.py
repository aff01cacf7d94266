"""Queries over cell grids, regions, blocks and rectangle joins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import formula
from ..functions.a1 import MAX_ROWS
from ..operators import blocks, edges, grid, overlap, profile, regions
from ..session import ship
from .registry import query

NATION_CELLS = """c AS (SELECT n_nationkey + 2 AS r, 1 AS c, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_nationkey + 2, 2, n_name FROM nation
    UNION ALL SELECT n_nationkey + 2, 3, CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT * FROM (VALUES (1, 1, 'n_nationkey'), (1, 2, 'n_name'), (1, 3, 'n_regionkey')) h)"""


@query(f"""WITH {NATION_CELLS}, g AS (SELECT CAST(i AS BIGINT) AS pos, CAST(i // 5 + 1 AS INTEGER) AS "row", CAST(i % 5 + 1 AS INTEGER) AS col FROM range(0, 150) t(i))
    SELECT g.pos, g."row", g.col, c.v AS "value" FROM g LEFT JOIN c ON c.r = g."row" AND c.c = g.col""")
def read_grid(t):
    """SRC20, SRC21: a rectangle with blanks."""
    return grid.read_grid(grid.to_cells(t.nation, ["n_nationkey"], 1), 1, (1, 30, 1, 5))


@query(f"""WITH {NATION_CELLS}, g AS (SELECT CAST(i AS BIGINT) AS pos, CAST(i // 3 + 1 AS INTEGER) AS "row", CAST(i % 3 + 1 AS INTEGER) AS col FROM range(7, 47) t(i))
    SELECT g.pos, g."row", g.col, c.v AS "value", false AS truncated FROM g LEFT JOIN c ON c.r = g."row" AND c.c = g.col""")
def read_page(t):
    """SRC22, ORD7: positions 7 to 46 of a rectangle."""
    return grid.read_page(grid.to_cells(t.nation, ["n_nationkey"], 1), 1, (1, 26, 1, 3), 7, 40)


@query("""WITH m AS (SELECT doc_id, text, regexp_extract(text, 'the [a-z]+ble') AS hit FROM documents), p AS (SELECT *, strpos(text, hit) AS pos FROM m WHERE hit <> ''),
    s AS (SELECT doc_id, length(text) AS n, greatest(1, pos - 30) AS a, least(length(text), pos + length(hit) - 1 + 30) AS b, text FROM p),
    w AS (SELECT doc_id, (CASE WHEN a > 1 THEN '…' ELSE '' END) || substr(text, a, b - a + 1) || (CASE WHEN b < n THEN '…' ELSE '' END) AS x FROM s)
    SELECT CAST(1 AS INTEGER) AS sheet_id, CAST(doc_id + 1 AS INTEGER) AS "row", CAST(2 AS INTEGER) AS col, 'B' || CAST(doc_id + 1 AS VARCHAR) AS ref, 'value' AS kind,
        CASE WHEN length(x) <= 80 THEN x ELSE substr(x, 1, 79) || '…' END AS snippet FROM w""")
def find_values(t):
    """FLT2, FLT4, PRJ7, SET5, ORD4: regex search over whole texts as cells."""
    c = t.documents.select(F.lit(1).alias("sheet_id"), (F.col("doc_id") + 1).cast("int").alias("row"), F.lit(2).alias("col"), F.lit("string").alias("value_type"), F.col("text").alias("v_str"), F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("formula"))
    return grid.find(grid.subjects(c), "the [a-z]+ble", limit=None, cut=None)


@query("""WITH s AS (SELECT 'sheet:' || r_name AS id, 'sheet' AS kind, 'worksheet' AS description FROM region
    UNION ALL SELECT 'col:' || r_name || ':0:' || lower(n_name), 'column', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'region:' || r_name || ':0', 'region', 'A1:C26' FROM region)
    SELECT id, kind, description FROM s WHERE lower(id) LIKE '%1%' OR lower(description) LIKE '%1%' ORDER BY lower(id), id LIMIT 100""")
def list_symbols(t):
    """PRJ1, PRJ2, FLT1, FLT3, ORD1, JON1."""
    sheets = t.region.select((F.col("r_regionkey") + 1).alias("sheet_id"), F.col("r_name").alias("name"), F.lit("worksheet").alias("kind"))
    cols = t.nation.select((F.col("n_regionkey") + 1).alias("sheet_id"), F.lit(0).alias("region_n"), F.col("n_name").alias("header"), F.lower("n_name").alias("norm_header"))
    regs = t.region.select((F.col("r_regionkey") + 1).alias("sheet_id"), F.lit(0).alias("n"), F.lit(1).alias("row_min"), F.lit(26).alias("row_max"), F.lit(1).alias("col_min"), F.lit(3).alias("col_max"))
    return grid.list_symbols(grid.symbols(sheets, cols, regs), "1")


def _sparse(t):
    """Cells left of a grid of parts: rows by key, 12 columns, holes by modulo."""
    p = t.part.select(F.lit(1).alias("sheet_id"), F.col("p_partkey").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("col"))
    return p.where((F.pmod(F.col("row") * F.col("col"), F.lit(5)) != 0) & (F.pmod(F.col("row") + F.col("col"), F.lit(7)) != 0))


SPARSE = """c AS (SELECT CAST(p_partkey AS INTEGER) AS "row", CAST(k AS INTEGER) AS col FROM part, range(1, 13) r(k) WHERE (p_partkey * k) % 5 <> 0 AND (p_partkey + k) % 7 <> 0)"""


def _runs_sql(gap: int) -> str:
    return f"""WITH {SPARSE}, b AS (SELECT *, lag(col) OVER (PARTITION BY "row" ORDER BY col) AS p FROM c),
        g AS (SELECT *, sum(CASE WHEN p IS NULL OR col - p - 1 > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY "row" ORDER BY col) AS k FROM b)
        SELECT 1 AS sheet_id, "row", min(col) AS col_min, max(col) AS col_max, count(*) AS n FROM g GROUP BY "row", k"""


@query(_runs_sql(0))
def row_runs(t):
    """WIN9."""
    return regions.runs(_sparse(t), 0)


@query(_runs_sql(1))
def gap_tolerant_runs(t):
    """WIN10."""
    return regions.runs(_sparse(t), 1)


@query("""WITH c AS (SELECT CAST(s_suppkey AS INTEGER) AS r FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT min(r) AS row_min, max(r) AS row_max FROM c GROUP BY r // 7),
    x AS (SELECT * FROM b, (VALUES (1, 3), (5, 6)) v(col_min, col_max))
    SELECT 1 AS sheet_id, row_min, row_max, col_min, col_max, 'region' AS kind, CAST(NULL AS VARCHAR) AS list_object_name, CAST(row_number() OVER (ORDER BY row_min, col_min) - 1 AS INTEGER) AS n FROM x""")
def region_boxes(t):
    """REG1, REG3, REG4, REG6, REG7, REG13, AGG15: islands between blank rows and columns."""
    c = t.supplier.where(F.pmod("s_suppkey", F.lit(7)) != 0).select(F.lit(1).alias("sheet_id"), F.col("s_suppkey").cast("int").alias("row"), F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 6)))).alias("col"))
    return regions.detect(c, gap=0)


LEFT = """l AS (SELECT s_suppkey AS id, CAST(s_suppkey % 3 AS INTEGER) AS sheet_id, CAST(s_suppkey * 10 AS INTEGER) AS row_min, CAST(s_suppkey * 10 + 15 AS INTEGER) AS row_max, CAST(1 + s_nationkey % 5 AS INTEGER) AS col_min, CAST(4 + s_nationkey % 5 AS INTEGER) AS col_max FROM supplier)"""
RIGHT = """r AS (SELECT p_partkey AS n, CAST(p_partkey % 3 AS INTEGER) AS sheet_id, CAST(p_partkey AS INTEGER) AS row_min, CAST(p_partkey + p_size AS INTEGER) AS row_max, CAST(1 + p_size % 7 AS INTEGER) AS col_min, CAST(3 + p_size % 7 AS INTEGER) AS col_max FROM part)"""
MEETS = "l.sheet_id = r.sheet_id AND l.row_min <= r.row_max AND r.row_min <= l.row_max AND l.col_min <= r.col_max AND r.col_min <= l.col_max"


def _left(t):
    k, n = F.col("s_suppkey"), F.pmod("s_nationkey", F.lit(5))
    return t.supplier.select(k.alias("id"), F.pmod(k, F.lit(3)).cast("int").alias("sheet_id"), (k * 10).cast("int").alias("row_min"), (k * 10 + 15).cast("int").alias("row_max"), (n + 1).cast("int").alias("col_min"), (n + 4).cast("int").alias("col_max"))


def _right(t):
    k, s = F.col("p_partkey"), F.pmod("p_size", F.lit(7))
    return t.part.select(k.alias("n"), F.pmod(k, F.lit(3)).cast("int").alias("sheet_id"), k.cast("int").alias("row_min"), (k + F.col("p_size")).cast("int").alias("row_max"), (s + 1).cast("int").alias("col_min"), (s + 3).cast("int").alias("col_max"))


@query(f"WITH {LEFT}, {RIGHT} SELECT l.id, count(r.n) AS n FROM l LEFT JOIN r ON {MEETS} GROUP BY l.id")
def rect_overlap_counts(t):
    """JON4, JON5, JON7, JON8, JON16, GEO1, FLT5, AGG10."""
    got = overlap.overlap_join(overlap.prefixed(_left(t), "l_"), overlap.prefixed(_right(t), "r_"), ["sheet_id"])
    return _left(t).join(got.groupBy("id").agg(F.count("n").alias("c")), "id", "left").select("id", F.coalesce("c", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {LEFT}, o AS (SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS sheet_id, CAST(o_orderkey % 2000 + 1 AS INTEGER) AS r, CAST(1 + o_custkey % 9 AS INTEGER) AS c FROM orders)
    SELECT o.o_orderkey, l.id FROM o JOIN l ON l.sheet_id = o.sheet_id AND o.r BETWEEN l.row_min AND l.row_max AND o.c BETWEEN l.col_min AND l.col_max""")
def point_in_rect(t):
    """FLT6, JON6, JON14, JON15, JON20, SRC12, RES8."""
    k = F.col("o_orderkey")
    o = t.orders.select(k, F.pmod(k, F.lit(3)).cast("int").alias("sheet_id"), (F.pmod(k, F.lit(2000)) + 1).cast("int").alias("row"), (F.pmod("o_custkey", F.lit(9)) + 1).cast("int").alias("col"))
    return overlap.overlap_join(overlap.points(o, "l_"), overlap.prefixed(_left(t), "r_"), ["sheet_id"]).select("o_orderkey", "id")


@query(f"WITH {LEFT}, {RIGHT} SELECT r.n FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.id % 4 = 0 AND {MEETS})")
def stale_rects(t):
    """JON11."""
    return overlap.overlapping(_right(t).withColumnRenamed("n", "id"), _left(t).where(F.pmod("id", F.lit(4)) == 0), ["sheet_id"]).select(F.col("id").alias("n"))


@query(f"WITH {LEFT}, {RIGHT} SELECT r.n FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE {MEETS})")
def fresh_rects(t):
    """JON12, JON13."""
    return overlap.overlapping(_right(t).withColumnRenamed("n", "id"), _left(t), ["sheet_id"], "left_anti").select(F.col("id").alias("n"))


@query(f"""WITH {LEFT}, {RIGHT}, m AS (SELECT l.id, min(r.n) AS n, count(*) AS c FROM l JOIN r ON {MEETS} WHERE r.row_min <= l.row_min AND r.row_max >= l.row_max AND r.col_min <= l.col_min + 1 AND r.col_max >= l.col_max - 1 GROUP BY l.id)
    SELECT id, n AS fblock_n FROM m WHERE c = 1""")
def unique_block_links(t):
    """JON17: bodies that exactly one block covers."""
    bodies = _left(t).withColumns({"col_min": F.col("col_min") + 1, "col_max": F.col("col_max") - 1})
    return edges.unique_links(_right(t), bodies)


FORMULAS = """f AS (SELECT CAST(i + 1 AS INTEGER) AS r, CASE WHEN (i + 1) % 997 = 0 THEN '=RC[-5]+(1-RC[-4])' ELSE '=RC[-5]*(1-RC[-4])' END AS r1c1 FROM range(1, (SELECT count(*) FROM lineitem) + 1) t(i))"""


def _last(t) -> int:
    """The row of lineitem's last formula."""
    return t.lineitem.count() + 1


def _formulas(t, last: int):
    """A computed column K beside lineitem's F and G, in a grid as high as it needs; one row in 997 is tampered with."""
    ship(t.spark)
    rows = t.spark.range(2, last + 1).select(F.lit(1).alias("sheet_id"), F.col("id").cast("int").alias("row"), F.lit(11).alias("col"))
    r = F.col("row").cast("string")
    text = F.concat(F.lit("=F"), r, F.when(F.pmod("row", F.lit(997)) == 0, "+").otherwise("*"), F.lit("(1-G"), r, F.lit(")"))
    return rows.withColumn("formula", text).withColumn("r1c1", formula.relative(max(last, MAX_ROWS))("formula", "row", "col"))


BLOCKS_SQL = f"""WITH {FORMULAS}, g AS (SELECT *, sum(CASE WHEN p = r1c1 THEN 0 ELSE 1 END) OVER (ORDER BY r) AS k FROM (SELECT *, lag(r1c1) OVER (ORDER BY r) AS p FROM f)),
    b AS (SELECT r1c1, min(r) AS row_min, max(r) AS row_max FROM g GROUP BY k, r1c1)"""


@query(f"""{BLOCKS_SQL} SELECT 1 AS sheet_id, CAST(row_number() OVER (ORDER BY row_min) - 1 AS INTEGER) AS n, r1c1, row_min, row_max, 11 AS col_min, 11 AS col_max FROM b""")
def r1c1_blocks(t):
    """FML3, FML6, FML7, WIN11, WIN12, ORD9."""
    return blocks.formula_blocks(_formulas(t, _last(t)))


@query(f"""WITH {FORMULAS}, g AS (SELECT *, (r - 2) // 500 AS region FROM f), n AS (SELECT region, count(*) AS n, count(*) FILTER (WHERE r1c1 = '=RC[-5]*(1-RC[-4])') AS d FROM g GROUP BY 1)
    SELECT 1 AS sheet_id, CAST(g.region AS BIGINT) AS region, g.r AS "row", 11 AS col, g.r1c1, '=RC[-5]*(1-RC[-4])' AS pattern, n.n, n.d AS dominant, 0 AS axis
    FROM g JOIN n ON g.region = n.region WHERE g.r1c1 <> '=RC[-5]*(1-RC[-4])' AND n.n >= 5 AND 5 * n.d >= 4 * n.n AND n.n - n.d <= greatest(3, (n.n + 19) // 20)""")
def block_inconsistency(t):
    """FML8, AGG13, WIN13, WIN14, DIA4."""
    f = _formulas(t, _last(t)).withColumn("region", F.floor((F.col("row") - 2) / 500))
    return blocks.inconsistencies(f, "vertical")


@query(f"""{BLOCKS_SQL}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY row_min) - 1 AS INTEGER) AS n FROM b)
    SELECT 1 AS src_sheet_id, n AS src_n, 'ref' AS via, row_min AS dst_row_min, row_max AS dst_row_max, c AS dst_col_min, c AS dst_col_max FROM n, (VALUES (6), (7)) v(c)""")
def extruded_edges(t):
    """FML9, FML14, FML18, FML20, FML21: references of one anchor a block, extruded over the block."""
    last = _last(t)
    height, b = max(last, MAX_ROWS), blocks.formula_blocks(_formulas(t, last))
    anchor = b.withColumns({"row": F.col("row_min"), "col": F.col("col_min")})
    r = F.col("row").cast("string")
    text = F.concat(F.lit("=F"), r, F.when(F.col("r1c1").contains("+("), "+").otherwise("*"), F.lit("(1-G"), r, F.lit(")"))
    refs = anchor.select("sheet_id", "n", "row", "col", text.alias("formula")).mapInPandas(partial(formula.reference_rows, height=height), "sheet_id int, n int, " + formula.REFERENCE_SCHEMA + ", ordinal int")
    got = edges.extrude(refs.join(b, ["sheet_id", "n"]), height)
    return got.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), "via", *("dst_" + c for c in ("row_min", "row_max", "col_min", "col_max")))


@query("""WITH n AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) AS p, CAST(n_nationkey + 1 AS INTEGER) AS sheet_id FROM nation),
    r AS (SELECT s_suppkey, 'NATION_' || CAST(s_suppkey % 25 AS VARCHAR) AS a, 'NATION_' || CAST((s_suppkey * 7) % 25 AS VARCHAR) AS b FROM supplier)
    SELECT r.s_suppkey, n.sheet_id AS dst_sheet_id, n.name AS dst_sheet FROM r JOIN n x ON x.name = r.a JOIN n y ON y.name = r.b JOIN n ON n.p BETWEEN least(x.p, y.p) AND greatest(x.p, y.p)""")
def threed_expand(t):
    """JON18."""
    sheets = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"), (F.col("n_nationkey") + 1).alias("sheet_id"))
    k = F.col("s_suppkey")
    refs = t.supplier.select(k, F.concat(F.lit("NATION_"), F.pmod(k, F.lit(25)).cast("string")).alias("first"), F.concat(F.lit("NATION_"), F.pmod(k * 7, F.lit(25)).cast("string")).alias("last"))
    return edges.expand_sheets(refs, sheets).select("s_suppkey", "dst_sheet_id", "dst_sheet")


@query("""WITH l AS (SELECT n_nationkey AS sheet_id, 'Building' AS defined FROM nation WHERE n_nationkey < 10), b AS (SELECT DISTINCT c_mktsegment AS defined FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT c.c_custkey, coalesce(l.defined, b.defined) AS defined, CASE WHEN l.defined IS NOT NULL THEN 'sheet' WHEN b.defined IS NOT NULL THEN 'workbook' END AS scope
    FROM customer c LEFT JOIN l ON l.sheet_id = c.c_nationkey AND lower(l.defined) = lower(c.c_mktsegment) LEFT JOIN b ON lower(b.defined) = lower(c.c_mktsegment)""")
def name_scope_resolution(t):
    """JON2, JON19, FML11."""
    local = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("scope_sheet_id"), F.lit("Building").alias("name"))
    book = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.lit(None).cast("int").alias("scope_sheet_id"), F.col("c_mktsegment").alias("name")).distinct()
    names = local.unionByName(book).withColumns({"kind": F.lit("range"), "refers_to": F.lit("A1")})
    uses = t.customer.select("c_custkey", F.col("c_nationkey").alias("sheet_id"), F.col("c_mktsegment").alias("name"))
    return edges.resolve_names(uses, names).select("c_custkey", "defined", "scope")


@query("""SELECT o_orderkey AS "key", CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders""")
def overlay_edits(t):
    """EDT1, EDT10, SNK1: edited cells replace, others stay."""
    k = F.col("o_orderkey")
    c = t.orders.select(F.lit(1).alias("sheet_id"), k.alias("row"), F.lit(4).alias("col"), F.col("o_totalprice").alias("v_num"))
    return grid.overlay(c, c.where(F.pmod("row", F.lit(10)) == 0).withColumn("v_num", F.lit(0.0))).select(F.col("row").alias("key"), F.col("v_num").alias("v"))


@query("""WITH r AS (SELECT n_regionkey AS sheet_id, n_nationkey AS n, (n_nationkey % 4 + 1) * (n_nationkey % 7 + 1) AS area, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey % 4 + 1) * (n_nationkey % 7 + 1) DESC, n_nationkey) AS k FROM nation)
    SELECT sheet_id, n, CAST(area AS BIGINT) AS area, k AS render_rank, row_number() OVER (ORDER BY k, sheet_id) AS source_rank FROM r""")
def map_region_rank(t):
    """WIN4, WIN5, MAP1."""
    from ..operators.workbook_map import region_ranks

    k = F.col("n_nationkey")
    r = t.nation.select(F.col("n_regionkey").alias("sheet_id"), k.alias("n"), k.alias("row_min"), (k + F.pmod(k, F.lit(4))).alias("row_max"), F.lit(1).alias("col_min"), (F.pmod(k, F.lit(7)) + 1).alias("col_max"))
    return region_ranks(r).select("sheet_id", "n", "area", F.col("render_rank").cast("long").alias("render_rank"), F.col("source_rank").cast("long").alias("source_rank"))


@query("""SELECT 0 AS region, 1 AS header_rows, round(0.30 + 0.25 * 2 / 3 + 0.20 + 0.05, 6) AS confidence FROM (SELECT count(*) AS n FROM nation) WHERE n > 1""")
def header_scores(t):
    """AGG14, REG10, REG11 on a table seen as a sheet."""
    c = grid.to_cells(t.nation, ["n_nationkey"], 1).withColumn("region", F.lit(0))
    b = t.spark.createDataFrame([(0, 1, 26, 1, 3)], "region int, row_min int, row_max int, col_min int, col_max int")
    return profile.infer_header_rows(profile.header_scores(c, b))


@query("""SELECT s_nationkey AS workbook, s_suppkey AS sheet_id, CASE WHEN s_suppkey % 3 = 0 THEN 'hidden' ELSE 'visible' END AS visibility,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0, s_suppkey) AS detail_rank FROM supplier""")
def sheet_detail_rank(t):
    """WIN3, AGG9."""
    from ..operators.workbook_map import sheet_ranks

    k = F.col("s_suppkey")
    s = t.supplier.select(F.col("s_nationkey").alias("workbook"), k.alias("sheet_id"), F.when(F.pmod(k, F.lit(3)) == 0, "hidden").otherwise("visible").alias("visibility"))
    return sheet_ranks(s).withColumn("detail_rank", F.col("detail_rank").cast("long"))


@query("""WITH b AS (SELECT p_size % 3 AS workbook, p_brand AS region, p_partkey AS idx FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY workbook, region ORDER BY idx) AS column_rank FROM b),
    x AS (SELECT *, CASE WHEN column_rank > 16 THEN row_number() OVER (PARTITION BY workbook, column_rank > 16 ORDER BY region, idx) END AS extra_rank FROM r)
    SELECT * FROM x WHERE column_rank <= 16 OR extra_rank <= 512""")
def column_extra_rank(t):
    """WIN6."""
    from ..operators.workbook_map import column_ranks

    c = t.part.select(F.pmod("p_size", F.lit(3)).alias("workbook"), F.col("p_brand").alias("region"), F.col("p_partkey").alias("idx"))
    got = column_ranks(c, 16, 512)
    return got.withColumns({"column_rank": F.col("column_rank").cast("long"), "extra_rank": F.col("extra_rank").cast("long")})


@query("""SELECT s_nationkey AS workbook, s_name AS target, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS link_rank, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier""")
def link_rank_total(t):
    """WIN7."""
    from ..operators.workbook_map import link_ranks

    got = link_ranks(t.supplier.select(F.col("s_nationkey").alias("workbook"), F.col("s_name").alias("target")))
    return got.withColumn("link_rank", F.col("link_rank").cast("long"))


@query("""SELECT c.c_custkey AS src_n, r.r_name AS dst_sheet, n.n_name AS src_sheet FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 20
    LEFT JOIN region r ON r.r_regionkey = c.c_custkey % 7""")
def decorated_edges(t):
    """JON10, JON21, JON22, SUP18: edges with sheet names, kept where a sheet is missing."""
    e = t.customer.select(F.col("c_nationkey").alias("src_sheet_id"), F.col("c_custkey").cast("int").alias("src_n"), (F.pmod("c_custkey", F.lit(7)) + 100).cast("int").alias("dst_sheet_id"))
    sheets = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("sheet_id"), F.col("n_name").alias("name")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("sheet_id"), F.col("r_name").alias("name")))
    b = t.nation.select(F.col("n_nationkey").alias("sheet_id"), F.lit(-1).alias("n"), F.lit("").alias("r1c1"), *(F.lit(1).alias(c) for c in ("row_min", "row_max", "col_min", "col_max")))
    return edges.decorate(e, sheets, b).select(F.col("src_n").cast("long").alias("src_n"), "dst_sheet", "src_sheet")
