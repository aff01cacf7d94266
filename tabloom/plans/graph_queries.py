"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, graph
from .registry import query

#: A block graph on orders: block k fills two cells of row k and reads rows of earlier blocks.
EDGES = """b AS (SELECT CAST(1 AS INTEGER) AS sheet_id, CAST(o_orderkey AS INTEGER) AS n FROM orders),
    e AS (SELECT CAST(1 AS INTEGER) AS sheet_id, CAST(o_orderkey AS INTEGER) AS n, CAST(o_orderkey // 3 AS INTEGER) AS lo, CAST(o_orderkey // 3 + o_custkey % 2 AS INTEGER) AS hi FROM orders WHERE o_orderkey >= 6)"""


def _blocks(t):
    k = F.col("o_orderkey").cast("int")
    return t.orders.select(F.lit(1).alias("sheet_id"), k.alias("n"), k.alias("row_min"), k.alias("row_max"), F.lit(5).alias("col_min"), F.lit(6).alias("col_max"))


def _edges(t):
    k = F.col("o_orderkey")
    low = F.floor(k / 3).cast("int")
    return t.orders.where("o_orderkey >= 6").select(
        F.lit(1).alias("src_sheet_id"), k.cast("int").alias("src_n"), F.lit("ref").alias("via"), F.lit(1).alias("dst_sheet_id"), low.alias("dst_row_min"),
        (low + F.pmod("o_custkey", F.lit(2))).cast("int").alias("dst_row_max"), F.lit(6).alias("dst_col_min"), F.lit(6).alias("dst_col_max"),
    )


def _areas(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), F.lit(1).alias("sheet_id"), (k * 4).cast("int").alias("row_min"), (k * 4 + 2).cast("int").alias("row_max"), F.lit(6).alias("col_min"), F.lit(6).alias("col_max"))


@query(f"WITH {EDGES} SELECT DISTINCT s_suppkey AS id, 1 AS dst_sheet_id, lo AS row_min, hi AS row_max, 6 AS col_min, 6 AS col_max, 'ref' AS via FROM supplier JOIN e ON e.n BETWEEN s_suppkey * 4 AND s_suppkey * 4 + 2")
def direct_precedents(t):
    """GRF1, JON9, SET4, SUP16."""
    got = graph.direct_precedents(_blocks(t), _edges(t), _areas(t))
    return got.select("id", "dst_sheet_id", *(F.col("dst_" + c).alias(c) for c in ("row_min", "row_max", "col_min", "col_max")), "via")


@query(f"WITH {EDGES} SELECT DISTINCT s_suppkey AS id, 1 AS src_sheet_id, e.n AS src_n, 'ref' AS via FROM supplier JOIN e ON e.lo <= s_suppkey * 4 + 2 AND e.hi >= s_suppkey * 4")
def direct_dependents(t):
    """GRF2."""
    return graph.direct_dependents(_edges(t), _areas(t))


LINKS = "k AS (SELECT DISTINCT CAST(b.n AS BIGINT) AS a, CAST(e.n AS BIGINT) AS b FROM b JOIN e ON b.n BETWEEN e.lo AND e.hi)"


def _links(t):
    mask = (1 << graph.NODE_BITS) - 1
    return graph.block_links(_blocks(t), _edges(t)).select(F.col("a").bitwiseAND(mask).alias("a"), F.col("b").bitwiseAND(mask).alias("b"))


@query(f"""WITH RECURSIVE {EDGES}, {LINKS}, r AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS depth UNION SELECT k.b, r.depth + 1 FROM r JOIN k ON k.a = r.id WHERE r.depth < 8)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id""")
def trace_levels(t):
    """GRF3, GRF5, AGG16: dependents of one block by shortest depth."""
    seeds = t.spark.createDataFrame([(7,)], "id long")
    return components.reachable(seeds, components.materialised(_links(t)), 8)


@query(f"""WITH RECURSIVE {EDGES}, {LINKS}, r AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS depth, '7' AS path UNION ALL SELECT k.b, r.depth + 1, r.path || '>' || CAST(k.b AS VARCHAR) FROM r JOIN k ON k.a = r.id WHERE r.depth < 4),
    h AS (SELECT * FROM r WHERE id = (SELECT min(id) FROM r WHERE depth = 4)) SELECT path FROM h WHERE depth = (SELECT min(depth) FROM h)""")
def shortest_paths(t):
    """GRF4: all shortest paths to the nearest block four steps away."""
    links = components.materialised(_links(t))
    far = components.reachable(t.spark.createDataFrame([(7,)], "id long"), links, 4)
    # The graph only leads to larger keys, so a block's levels are as in the SQL.
    step = t.spark.createDataFrame([(7,)], "id long")
    for _ in range(4):
        step = step.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
    target = step.join(far, "id", "left_semi").agg(F.min("id")).first()[0]
    got = graph.shortest_paths(links, 7, target) if target is not None else t.spark.createDataFrame([], "path array<long>")
    return got.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {EDGES}, {LINKS}, s AS (SELECT DISTINCT CAST(e.n AS BIGINT) AS id FROM e WHERE e.lo <= 9 AND e.hi >= 8), r AS (SELECT id FROM s UNION SELECT k.b FROM r JOIN k ON k.a = r.id)
    SELECT 1 AS sheet_id, CAST(id AS INTEGER) AS n FROM r""")
def staleness_closure(t):
    """GRF11, EDT9: blocks that may change after rows 8 to 9 were written."""
    written = t.spark.createDataFrame([(1, 8, 9, 5, 6)], "sheet_id int, row_min int, row_max int, col_min int, col_max int")
    return graph.staleness(_blocks(t), _edges(t), written)


@query(f"""WITH {EDGES} SELECT n % 50 AS src_n, lo, hi, dense_rank() OVER (PARTITION BY n % 50 ORDER BY lo, hi) AS "rank" FROM e""")
def dense_hop_rank(t):
    """WIN8, GRF12, ORD3, ORD8, SUP19."""
    sheets = t.spark.createDataFrame([(1, "Orders")], "sheet_id int, name string")
    got = graph.hop_ranks(_edges(t).withColumn("src_n", F.pmod("src_n", F.lit(50)).cast("int")), sheets)
    return got.select("src_n", F.col("dst_row_min").alias("lo"), F.col("dst_row_max").alias("hi"), F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 9 ELSE p_partkey + 1 END AS b FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0),
    u AS (SELECT a, b FROM l WHERE b <= (SELECT max(p_partkey) FROM part) UNION SELECT b, a FROM l WHERE b <= (SELECT max(p_partkey) FROM part)),
    r AS (SELECT p_partkey AS id, p_partkey AS x FROM part UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.x) SELECT id, min(x) AS label FROM r GROUP BY id""")
def connected_components(t):
    """AGG15, REG6: labels of rings of ten with gaps."""
    k = F.col("p_partkey")
    top = t.part.agg(F.max("p_partkey")).first()[0]
    links = t.part.where((F.pmod(k, F.lit(3)) != 0) | (F.pmod(k, F.lit(2)) == 0)).select(k.alias("a"), F.when(F.pmod(k, F.lit(10)) == 0, k - 9).otherwise(k + 1).alias("b")).where(F.col("b") <= top)
    return components.components(t.part.select(k.alias("id")), links)


@query("""SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS component FROM part WHERE (p_partkey // 10) % 4 = 1 AND (p_partkey // 10 + 1) * 10 <= (SELECT max(p_partkey) FROM part)""")
def strong_components(t):
    """GRF6, GRF10, DIA2: rings of ten among chains."""
    k = F.col("p_partkey")
    top = t.part.agg(F.max("p_partkey")).first()[0]
    ten = F.floor(k / 10)
    ring = t.part.where((F.pmod(ten, F.lit(4)) == 1) & ((ten + 1) * 10 <= top)).select(k.alias("a"), F.when(F.pmod(k, F.lit(10)) == 9, k - 9).otherwise(k + 1).alias("b"))
    chain = t.part.select(k.alias("a"), (k + 10).alias("b")).where(F.col("b") <= top)
    return graph.strong_components(ring.unionByName(chain))


@query("""SELECT CAST(1 AS INTEGER) AS src_sheet_id, CAST(p_partkey AS INTEGER) AS src_n FROM part WHERE p_partkey % 5 IN (0, 2)""")
def self_inclusion(t):
    """GRF7, DIA2: cells inside their own range, by arithmetic on offsets."""
    k = F.col("p_partkey")
    kind = F.pmod(k, F.lit(5))
    b = t.part.select(F.lit(1).alias("sheet_id"), k.cast("int").alias("n"), (k * 20 + 2).cast("int").alias("row_min"), (k * 20 + 9).cast("int").alias("row_max"), F.lit(4).alias("col_min"), F.lit(4).alias("col_max"))
    # 0: its own column whole; 1: the row above; 2: a fixed range that covers it; 3: a running range that ends above; 4: the column beside it.
    term = lambda *v: F.element_at(F.array(*map(F.lit, v)), (kind + 1).cast("int"))
    fixed = (k * 20 + 1).cast("int")
    e = t.part.select(
        F.lit(1).alias("src_sheet_id"), k.cast("int").alias("src_n"), F.lit(1).alias("dst_sheet_id"), F.lit("ref").alias("via"),
        F.when(kind.isin(2, 3), fixed).otherwise(term(1, -1, 0, 0, 0)).alias("row1"), term(False, True, False, False, True).alias("row1_rel"),
        F.when(kind == 2, fixed + 12).otherwise(term(1048576, -1, 0, -1, 0)).alias("row2"), term(False, True, False, True, True).alias("row2_rel"),
        term(0, 0, 0, 0, -1).alias("col1"), F.lit(True).alias("col1_rel"), term(0, 0, 0, 0, -1).alias("col2"), F.lit(True).alias("col2_rel"),
    )
    return graph.self_reading(b, e)
