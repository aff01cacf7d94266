"""Queries over scalar operators, profiles, counts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import a1, values
from ..operators import diagnostics, grid, profile
from .registry import query

LABEL = """(CASE WHEN {n} > 702 THEN chr(CAST(65 + ({n} - 703) // 676 AS INTEGER)) ELSE '' END
    || CASE WHEN {n} > 26 THEN chr(CAST(65 + (({n} - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)))"""


@query("""SELECT count(*) AS "count", count(c_acctbal) AS nonnull, count(DISTINCT c_acctbal) AS "distinct", round(sum(c_acctbal), 3) AS "sum",
    round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS "min", max(c_acctbal) AS "max" FROM customer""")
def profile_numeric(t):
    """AGG1, AGG3, AGG4."""
    got = profile.profile_numeric(t.customer.select("c_acctbal"), "c_acctbal")
    return got.withColumns({"sum": F.round("sum", 3), "mean": F.round("mean", 6)})


@query("""SELECT c_mktsegment AS "value", count(*) AS "count" FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def profile_topk(t):
    """AGG2, ORD5."""
    return profile.top_values(t.customer, "c_mktsegment")


def _profile_sql() -> str:
    parts = []
    for i, (c, dtype) in enumerate((("event_id", "int"), ("ts", "date"), ("user_id", "int"), ("event_type", "str"), ("value", None), ("props", "str"))):
        kind = f"'{dtype}'" if dtype else "CASE WHEN (SELECT bool_and(value = floor(value)) FROM (SELECT value FROM events ORDER BY event_id LIMIT 200)) THEN 'int' ELSE 'float' END"
        parts.append(f"SELECT 1 AS sheet_id, {i + 1} AS col, count({c}) AS nonnull, least(1000, count(DISTINCT {c})) AS distinct_est, {kind} AS dtype FROM events")
    return " UNION ALL ".join(parts)


@query(_profile_sql())
def column_profiles(t):
    """AGG5, AGG6, AGG7, WIN1: every column of a table seen as a sheet."""
    cells = grid.to_cells(t.events, ["event_id"], 1).where("row > 1")
    return profile.column_profiles(cells, ["sheet_id", "col"])


@query("""WITH v AS (SELECT p_brand AS region, p_partkey AS idx, p_type AS header, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column') AS k FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY region, k ORDER BY idx) AS n FROM v)
    SELECT region, idx, header, CASE WHEN n > 1 THEN k || '#' || CAST(n AS VARCHAR) ELSE k END AS norm_header FROM r""")
def header_dedup(t):
    """PRJ3, PRJ4."""
    h = t.part.select(F.col("p_brand").alias("region"), F.col("p_partkey").alias("idx"), F.col("p_type").alias("header"))
    return profile.deduplicated(h.withColumn("norm_header", values.normal_header("header")), ["region"])


@query(f"""WITH p AS (SELECT p_partkey, CAST((p_partkey * 37) % 16384 + 1 AS INTEGER) AS c, CAST((p_partkey * 101) % 1048576 + 1 AS INTEGER) AS r FROM part)
    SELECT p_partkey, {LABEL.format(n="c")} AS label, c AS number, {LABEL.format(n="c")} || CAST(r AS VARCHAR) AS ref, CAST(r AS BIGINT) * 65536 + c AS packed, r AS unpacked_row, c AS unpacked_col FROM p""")
def coordinates(t):
    """PRJ6, RES4, SCA9."""
    p = t.part.select("p_partkey", (F.pmod(F.col("p_partkey") * 37, F.lit(16384)) + 1).cast("int").alias("c"), (F.pmod(F.col("p_partkey") * 101, F.lit(1048576)) + 1).cast("int").alias("r"))
    p = p.select("p_partkey", a1.column_label("c").alias("label"), a1.cell_ref("r", "c").alias("ref"), a1.pack_cell("r", "c").alias("packed"))
    return p.select("p_partkey", "label", a1.column_number("label").cast("int").alias("number"), "ref", "packed", a1.unpack_cell("packed")["row"].alias("unpacked_row"), a1.unpack_cell("packed")["col"].alias("unpacked_col"))


@query(f"""WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 300 + 1 AS INTEGER) AS c, CAST(s_suppkey * 3 + 1 AS INTEGER) AS r, CAST(s_suppkey % 4 AS INTEGER) AS k FROM supplier)
    SELECT s_suppkey, CASE k WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN 1 ELSE r END AS row_min, CASE k WHEN 0 THEN r WHEN 1 THEN r + 5 WHEN 2 THEN 1048576 ELSE r + 2 END AS row_max,
        CASE k WHEN 3 THEN 1 ELSE c END AS col_min, CASE k WHEN 0 THEN c WHEN 1 THEN c + 2 WHEN 2 THEN c ELSE 16384 END AS col_max FROM s""")
def a1_parse(t):
    """RES2, RES3: cells, ranges in either order, whole columns and rows, with a sheet."""
    s = t.supplier.select("s_suppkey", F.pmod("s_suppkey", F.lit(300)).cast("int").alias("c0"), (F.col("s_suppkey") * 3 + 1).cast("int").alias("r"), F.pmod("s_suppkey", F.lit(4)).alias("k"))
    s = s.withColumn("c", F.col("c0") + 1)
    one, far = a1.cell_ref("r", "c"), a1.cell_ref(F.col("r") + 5, F.col("c") + 2)
    text = F.when(F.col("k") == 0, one).when(F.col("k") == 1, F.concat(far, F.lit(":"), one)).when(F.col("k") == 2, F.concat(F.lit("$"), a1.column_label("c"), F.lit(":"), a1.column_label("c"))).otherwise(F.concat(F.col("r").cast("string"), F.lit(":"), (F.col("r") + 2).cast("string")))
    area = a1.split_qualified(F.concat(F.lit("'It''s'!"), text))["area"]
    return s.select("s_suppkey", a1.parse_rect(area).alias("x")).select("s_suppkey", "x.*")


@query("""SELECT event_id, CAST(TIMESTAMP '1899-12-30' + CAST(60 + event_id AS INTEGER) * INTERVAL 1 DAY + INTERVAL 12 HOUR AS TIMESTAMP) AS at,
    CAST(TIMESTAMP '1904-01-01' + CAST(60 + event_id AS INTEGER) * INTERVAL 1 DAY + INTERVAL 12 HOUR AS TIMESTAMP) AS at1904,
    CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'date' WHEN 1 THEN 'datetime' ELSE 'time' END AS kind FROM events""")
def serial_dates(t):
    """SCA5, SCA6."""
    serial = F.col("event_id") + 60.5
    text = F.when(F.pmod("event_id", F.lit(3)) == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.pmod("event_id", F.lit(3)) == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return t.events.select("event_id", values.serial_to_timestamp(serial).alias("at"), values.serial_to_timestamp(serial, True).alias("at1904"), values.temporal_kind(text).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS v_long, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey AS DOUBLE) + 0.25 END AS v_double FROM part""")
def number_parse(t):
    """SCA7, PRJ5."""
    text = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".25")))
    return t.part.select("p_partkey", values.number_of(text).alias("x")).select("p_partkey", "x.*")


@query("""SELECT page_id, CASE WHEN label <> '' THEN label ELSE '[none]' END AS label FROM (SELECT page_id,
    regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '([^/\\\\]*)[/\\\\]*$', 1) AS label FROM pages)""")
def url_labels(t):
    """SCA13."""
    return t.pages.select("page_id", values.url_label("url").alias("label"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 256 THEN text ELSE substr(text, 1, 255) || '…' END AS shown FROM documents""")
def shortened_values(t):
    """SCA2."""
    return t.documents.select("doc_id", values.shorten("text", 256).alias("shown"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS link, sha256(props) AS digest FROM events""")
def json_links(t):
    """SCA10, SCA11, SRC19."""
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "link"), F.sha2(F.col("props").cast("binary"), 256).alias("digest")).select("event_id", "link", "digest")


@query("""SELECT s_suppkey, CASE CAST(s_suppkey % 3 AS INTEGER) WHEN 0 THEN 'FILTER' WHEN 1 THEN 'SUM' ELSE 'NOW' END AS name, s_suppkey % 3 = 2 AS volatile FROM supplier""")
def function_names(t):
    """SCA16, SCA17."""
    from ..functions.formula import VOLATILE

    text = F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "_xlfn._xlws.filter").when(F.pmod("s_suppkey", F.lit(3)) == 1, "@Sum").otherwise("now")
    got = t.supplier.select("s_suppkey", values.normal_function(text).alias("name"))
    return got.withColumn("volatile", F.col("name").isin(sorted(VOLATILE)))


@query("""SELECT 1 AS sheet_id, min(CAST(o_orderkey AS INTEGER)) AS row_min, max(CAST(o_orderkey AS INTEGER)) AS row_max, min(CAST(o_custkey % 50 + 1 AS INTEGER)) AS col_min,
    max(CAST(o_custkey % 50 + 1 AS INTEGER)) AS col_max, count(*) AS cells FROM orders""")
def bounding_box(t):
    """AGG11."""
    from ..operators.regions import bounds

    return bounds(t.orders.select(F.lit(1).alias("sheet_id"), F.col("o_orderkey").cast("int").alias("row"), (F.pmod("o_custkey", F.lit(50)) + 1).cast("int").alias("col")))


@query("""WITH c AS (SELECT CAST(l_linenumber AS INTEGER) AS col, CAST(l_quantity AS INTEGER) % 7 AS style_idx, count(*) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, style_idx) AS k FROM c) SELECT col, style_idx FROM r WHERE k = 1""")
def modal_styles(t):
    """AGG12."""
    return profile.modal_style(t.lineitem.select(F.col("l_linenumber").alias("col"), F.pmod(F.col("l_quantity").cast("int"), F.lit(7)).alias("style_idx")), ["col"])


@query("""SELECT event_type AS sheet, CASE CAST(event_id % 11 AS INTEGER) WHEN 0 THEN '#N/A' WHEN 1 THEN '#REF!' ELSE '#ODD!' END AS text, count(*) AS cells, min(event_id) AS first_row
    FROM events WHERE event_id % 11 < 3 GROUP BY 1, 2""")
def error_census(t):
    """FLT8, DIA1: error cells by sheet and text."""
    text = F.when(F.pmod("event_id", F.lit(11)) == 0, "#N/A").when(F.pmod("event_id", F.lit(11)) == 1, "#REF!").when(F.pmod("event_id", F.lit(11)) == 2, "#ODD!")
    cells = t.events.select(F.col("event_type").alias("sheet"), F.col("event_id").alias("row"), F.when(text.isNotNull(), "error").otherwise("number").alias("value_type"), text.alias("v_str"))
    return diagnostics.error_census(cells)


@query("""WITH d AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'E_ERRVAL' WHEN event_id % 11 = 1 THEN 'I_VOLATILE' ELSE 'W_PARSE' END AS code FROM events WHERE event_id % 11 < 3),
    s AS (SELECT * FROM (VALUES ('error', 'E_ERRVAL'), ('warn', 'W_PARSE'), ('info', 'I_VOLATILE'), ('error', 'E_CIRCULAR'), ('warn', 'W_POSSIBLE_CIRCULAR'), ('error', 'E_BROKEN_XLINK'), ('warn', 'W_INCONSISTENT_FORMULA'),
        ('warn', 'W_UNKNOWN_NAME'), ('warn', 'W_LARGE_SHEET'), ('warn', 'W_REGEX_TIMEOUT'), ('info', 'I_DYNAMIC_REF'), ('info', 'I_STALE')) v(severity, code))
    SELECT s.severity, s.code, count(d.code) AS n FROM s LEFT JOIN d ON s.code = d.code GROUP BY 1, 2""")
def diagnostic_counts(t):
    """AGG8, FLT7: counts by severity and code with zeros, before any limit."""
    code = F.when(F.pmod("event_id", F.lit(11)) == 0, "E_ERRVAL").when(F.pmod("event_id", F.lit(11)) == 1, "I_VOLATILE").when(F.pmod("event_id", F.lit(11)) == 2, "W_PARSE")
    return diagnostics.counts(t.events.select(code.alias("code")).where("code IS NOT NULL"))


@query("""WITH o AS (SELECT p_partkey AS part, sha256(p_name) AS h FROM part WHERE p_partkey % 13 <> 0), n AS (SELECT p_partkey AS part, sha256(CASE WHEN p_partkey % 17 = 0 THEN p_name || '!' ELSE p_name END) AS h FROM part WHERE p_partkey % 19 <> 0)
    SELECT coalesce(o.part, n.part) AS part_name, CASE WHEN o.part IS NULL THEN 'added' WHEN n.part IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.part = n.part WHERE o.h IS DISTINCT FROM n.h""")
def part_difference(t):
    """SET6, LIF2: changed, added and removed parts."""
    from ..operators.lifecycle import changed_parts

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    old = t.part.where(F.pmod("p_partkey", F.lit(13)) != 0).select(F.col("p_partkey").alias("part_name"), sha(F.col("p_name")).alias("part_hash"))
    new = t.part.where(F.pmod("p_partkey", F.lit(19)) != 0).select(F.col("p_partkey").alias("part_name"), sha(F.when(F.pmod("p_partkey", F.lit(17)) == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("part_hash"))
    return changed_parts(old, new)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 1000""")
def keyset_page(t):
    """ORD6."""
    return grid.keyset_page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 500)


@query("""(SELECT c_nationkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
    UNION ALL (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)""")
def set_difference(t):
    """SET1, SET2, SET3, SET7."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    a, b = (c.where(F.pmod("c_custkey", F.lit(m)) == 0).select("k", "v") for m in (2, 3))
    return a.subtract(b).unionByName(b.subtract(a))
