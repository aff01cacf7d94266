"""Column profiles, dtype lattice, header scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISTINCT_CAP = 1000
SAMPLE = 200


def profile_numeric(df: DataFrame, column: str) -> DataFrame:
    """One row: count, nonnull, distinct, sum, mean, min, max."""
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("count"), F.count(c).alias("nonnull"), F.countDistinct(c).alias("distinct"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties by value, shown in 120 characters at most."""
    from ..functions.values import shorten

    shown = shorten(F.col(column).cast("string"), 120)
    got = df.where(F.col(column).isNotNull()).groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return got.orderBy(F.desc("count"), F.asc("value")).limit(k)


def atom(value_type: Column, v_num: Column) -> Column:
    """int, float, str, bool, date, error or null (blank)."""
    return (
        F.when(value_type == "number", F.when(v_num == F.floor(v_num), "int").otherwise("float"))
        .when(value_type == "string", "str")
        .when(value_type.isin("bool", "date", "error"), value_type)
    )


def lattice(atoms: Column) -> Column:
    """dtype of a set of atoms."""
    n = F.size(atoms)
    only = lambda *xs: F.size(F.array_except(atoms, F.array(*map(F.lit, xs)))) == 0
    return (
        F.when(n == 0, "empty").when(only("int"), "int").when(only("int", "float"), "float").when(only("date"), "date").when(only("str"), "str").when(only("bool"), "bool").otherwise("mixed")
    )


def column_profiles(cells: DataFrame, keys: list[str], cap: int = DISTINCT_CAP, sample: int = SAMPLE) -> DataFrame:
    """Per column of a body: nonnull, distinct (exact up to the cap), dtype of the first ``sample`` values.

    Distinct values are counted in two steps that combine before the shuffle;
    the sample is cut with a rank that Spark limits before it sorts a group.
    """
    full = cells.where("value_type IS NOT NULL AND value_type <> 'blank'")
    value = F.coalesce("v_str", F.col("v_num").cast("string"), F.col("v_bool").cast("string"))
    counts = full.groupBy(*keys, F.col("value_type"), value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.groupBy(*keys).agg(F.sum("__n").alias("nonnull"), F.least(F.lit(cap), F.count(F.lit(1))).cast("long").alias("distinct_est"))
    first = full.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).where(F.col("__r") <= sample)
    kinds = first.groupBy(*keys).agg(lattice(F.collect_set(atom(F.col("value_type"), F.col("v_num")))).alias("dtype"))
    return counts.join(kinds, keys)


def strided_sample(cells: DataFrame, keys: list[str], stride: int, most: int = 50) -> DataFrame:
    """Every ``stride``-th cell of a column, ``most`` at most (large sheets)."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("row"))
    return cells.withColumn("__r", r).where((F.pmod(F.col("__r") - 1, F.lit(stride)) == 0) & (F.col("__r") <= stride * most)).drop("__r")


def header_scores(cells: DataFrame, bounds: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Score of 1 to 3 header rows for each region (bounds: region, row_min, row_max, col_min, col_max).

    0.30 text coverage + 0.25 contrast + 0.20 uniqueness + 0.20 style shift + 0.05 coverage, to six digits.
    ``cells`` carries region and, optionally, styled (a highlighted cell).
    """
    b = bounds.select("region", "row_min", "row_max", (F.col("col_max") - F.col("col_min") + 1).alias("width"))
    c = cells.join(b, "region").withColumn("line", F.col("row") - F.col("row_min") + 1)
    styled = F.col("styled") if "styled" in cells.columns else F.lit(False)
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(F.lit(1), F.col("row_max") - F.col("row_min"))))).alias("k")
    seen = c.where("line <= 27").select("region", "col", "line", "value_type", "v_str", styled.alias("styled"), "width", k)
    head, body = F.col("line") <= F.col("k"), F.col("line") > F.col("k")
    per = seen.groupBy("region", "width", "k", "col").agg(
        F.count_if(head & F.col("value_type").isNotNull()).alias("filled"),
        F.count_if(head & (F.col("value_type") == "string")).alias("texts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(head & F.col("v_str").isNotNull(), F.struct("line", "v_str")))), lambda x: x["v_str"]), " / ").alias("header"),
        F.count_if(body & F.col("value_type").isNotNull()).alias("below"),
        F.count_if(body & F.col("value_type").isin("number", "date", "bool")).alias("typed"),
        F.bool_or(head & F.col("styled")).alias("high"),
        F.bool_or(body & F.col("styled")).alias("low"),
    )
    all_text = (F.col("filled") > 0) & (F.col("filled") == F.col("texts"))
    got = per.groupBy("region", "width", "k").agg(
        F.count_if(all_text).alias("text"),
        F.count_if(F.expr("filled > 0")).alias("full"),
        F.countDistinct(F.when(F.col("filled") > 0, F.lower("header"))).alias("unique"),
        F.count_if(F.expr("below > 0")).alias("bodies"),
        F.count_if(all_text & (F.col("typed") > 0)).alias("contrast"),
        F.count_if(F.coalesce("high", F.lit(False)) & ~F.coalesce("low", F.lit(False))).alias("shift"),
    )
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(0.0)
    score = 0.30 * share("text", "width") + 0.25 * share("contrast", "bodies") + 0.20 * share("unique", "full") + 0.20 * share("shift", "width") + 0.05 * share("full", "width")
    return got.select("region", "k", F.round(score, 6).alias("score"))


def infer_header_rows(scores: DataFrame, threshold: float = 0.55) -> DataFrame:
    """The shortest best header of each region, or none below the threshold: region, header_rows, confidence."""
    best = scores.groupBy("region").agg(F.max_by(F.struct("k", "score"), F.struct("score", (-F.col("k")).alias("o"))).alias("b"))
    ok = F.col("b.score") >= threshold
    return best.select("region", F.when(ok, F.col("b.k")).otherwise(0).alias("header_rows"), F.round(F.when(ok, F.col("b.score")).otherwise(1 - F.col("b.score")), 6).alias("confidence"))


def deduplicated(headers: DataFrame, keys: list[str], norm: str = "norm_header", order: str = "idx") -> DataFrame:
    """The k-th repeat of a header of a region gets #k."""
    r = F.row_number().over(Window.partitionBy(*keys, norm).orderBy(order))
    return headers.withColumn("__r", r).withColumn(norm, F.when(F.col("__r") > 1, F.concat(norm, F.lit("#"), F.col("__r").cast("string"))).otherwise(F.col(norm))).drop("__r")


def modal_style(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent style of each group, the smallest id on ties."""
    n = cells.groupBy(*keys, "style_idx").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by("style_idx", F.struct("n", (-F.col("style_idx")).alias("o"))).alias("style_idx"))
