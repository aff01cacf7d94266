"""Hops, traces, paths, cycles and staleness over the edge list.

edges: src_sheet_id, src_n, dst_sheet_id, dst_row_min .. dst_col_max, via.
blocks: sheet_id, n, rectangle.  A node is (sheet_id, n).
"""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.a1 import MAX_COLS, MAX_ROWS, RECT
from .components import materialised, reachable
from .overlap import overlap_join, prefixed

NODE_BITS = 32


def node(sheet, n):
    return (F.col(sheet).cast("long") * (1 << NODE_BITS)) + F.col(n)


def concrete(edges: DataFrame) -> DataFrame:
    return edges.where("dst_row_min IS NOT NULL AND NOT startswith(via, 'opaque') AND NOT startswith(via, 'external')")


def _dst(edges: DataFrame, p: str) -> DataFrame:
    return edges.select("src_sheet_id", "src_n", "via", F.col("dst_sheet_id").alias("sheet_id"), *(F.col("dst_" + c).alias(p + c) for c in RECT))


def direct_precedents(blocks: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    """What blocks overlapping each area read.  areas: id, sheet_id, rectangle."""
    src = overlap_join(prefixed(areas.select("id", "sheet_id", *RECT), "l_"), prefixed(blocks.select("sheet_id", "n", *RECT), "r_"), ["sheet_id"])
    src = src.select("id", F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"))
    return src.join(edges, ["src_sheet_id", "src_n"]).select("id", "dst_sheet_id", *("dst_" + c for c in RECT), "via").distinct()


def direct_dependents(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks that read any cell of each area."""
    got = overlap_join(prefixed(areas.select("id", "sheet_id", *RECT), "l_"), _dst(edges.where("dst_row_min IS NOT NULL"), "r_"), ["sheet_id"])
    return got.select("id", "src_sheet_id", "src_n", "via").distinct()


def block_links(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Coarse adjacency a -> b: block b reads a cell of block a (the dependent direction)."""
    got = overlap_join(prefixed(blocks.select("sheet_id", "n", *RECT), "l_"), _dst(concrete(edges), "r_"), ["sheet_id"])
    return got.select(node("sheet_id", "n").alias("a"), node("src_sheet_id", "src_n").alias("b")).distinct()


def levels(blocks: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Transitive dependents of seed blocks (sheet_id, n): id, depth."""
    return reachable(seeds.select(node("sheet_id", "n").alias("id")), materialised(block_links(blocks, edges)), depth)


def staleness(blocks: DataFrame, edges: DataFrame, written: DataFrame) -> DataFrame:
    """Blocks whose value may change once cells of ``written`` (sheet_id, rectangle) do: sheet_id, n.

    The blocks that contain or read a written cell start; a block-level
    closure follows, so no cell is ever expanded.
    """
    first = direct_dependents(concrete(edges), written.withColumn("id", F.lit(0))).select(node("src_sheet_id", "src_n").alias("id"))
    got = reachable(first.distinct(), materialised(block_links(blocks, edges)))
    return got.select(F.shiftright("id", NODE_BITS).cast("int").alias("sheet_id"), F.col("id").bitwiseAND((1 << NODE_BITS) - 1).cast("int").alias("n"))


def hop_ranks(edges: DataFrame, sheets: DataFrame) -> DataFrame:
    """One dense rank a canonical hop of a source: concrete first, then sheet, corners, via."""
    e = edges.join(sheets.select(F.col("sheet_id").alias("dst_sheet_id"), F.col("name").alias("dst_sheet")), "dst_sheet_id", "left")
    w = Window.partitionBy("src_sheet_id", "src_n").orderBy(F.col("dst_row_min").isNull(), F.lower("dst_sheet"), "dst_sheet", *("dst_" + c for c in ("row_min", "col_min", "row_max", "col_max")), "via")
    return e.withColumn("rank", F.dense_rank().over(w))


def self_reading(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks with a cell inside what that very cell reads, by column arithmetic on offsets.

    edges carry the reference's terms (see ``edges.extrude``): the cell (r, c)
    lies in its own range if r and c do, which for each axis is an interval of
    the block's rows or columns.  A whole column also holds the rows of a table
    taller than a sheet.
    """
    e = edges.join(blocks.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), *RECT), ["src_sheet_id", "src_n"]).where("dst_sheet_id = src_sheet_id")

    def meets(a: str, lo: str, hi: str, most: int):
        r1, v1, r2, v2 = F.col(a + "1_rel"), F.col(a + "1"), F.col(a + "2_rel"), F.col(a + "2")
        # Between the two ends, in either order, at the cell's own place x: x + offset or a fixed value.
        low, high = F.col(lo), F.col(hi)
        both = r1 & r2 & (F.least(v1, v2) <= 0) & (F.greatest(v1, v2) >= 0)
        none = ~r1 & ~r2 & (F.greatest(F.least(v1, v2), low) <= F.least(F.greatest(v1, v2), high))
        whole = ~r1 & ~r2 & (F.least(v1, v2) <= 1) & (F.greatest(v1, v2) >= most)
        off, fix = F.when(r1, v1).otherwise(v2), F.when(r1, v2).otherwise(v1)
        mixed = (r1 != r2) & (((off >= 0) & (fix <= high)) | ((off <= 0) & (fix >= low)))
        return both | none | whole | mixed

    return e.where(meets("row", "row_min", "row_max", MAX_ROWS) & meets("col", "col_min", "col_max", MAX_COLS)).select("src_sheet_id", "src_n").distinct()


def one_way(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks that read themselves in one direction only, as running totals do; alone they make no cycle.

    edges as for ``self_reading``.  Every reference of the block to itself has
    both ends above the reading cell's row (or all below, or all on one side of
    its column), so following them leaves the block.
    """
    e = edges.join(blocks.select(F.col("sheet_id").alias("src_sheet_id"), F.col("n").alias("src_n"), *RECT), ["src_sheet_id", "src_n"])
    e = e.where("dst_sheet_id = src_sheet_id AND dst_row_min <= row_max AND dst_row_max >= row_min AND dst_col_min <= col_max AND dst_col_max >= col_min")

    def beyond(axis: str, sign: int):
        edge = F.col(axis + ("_min" if sign < 0 else "_max"))
        ends = [F.when(F.col(f"{axis}{k}_rel"), F.col(f"{axis}{k}") * sign > 0).otherwise((F.col(f"{axis}{k}") - edge) * sign > 0) for k in "12"]
        return F.every(ends[0] & ends[1])

    got = e.groupBy("src_sheet_id", "src_n").agg((beyond("row", -1) | beyond("row", 1) | beyond("col", -1) | beyond("col", 1)).alias("ok"))
    return got.where("ok").select("src_sheet_id", "src_n")


def cyclic_candidates(links: DataFrame) -> DataFrame:
    """Links left after repeatedly dropping nodes without an incoming or outgoing link: all cycles survive, chains go."""
    links = materialised(links.select("a", "b").distinct())
    n = links.count()
    while n:
        links = materialised(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        left = links.count()
        if left == n:
            break
        n = left
    return links


def strong_components(links: DataFrame) -> DataFrame:
    """Strongly connected components with a cycle: id, component (its smallest id).

    Chains are trimmed away; then colours spread forward (largest id that
    reaches a node), and each colour's root collects, backward within its
    colour, its component.  Components found are removed until no link is left.
    """
    left = cyclic_candidates(links.where("a <> b"))
    found = materialised(links.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    while not left.isEmpty():
        nodes = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
        colour = materialised(nodes.withColumn("c", F.col("id")))
        while True:
            spread = left.join(colour.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.max("c").alias("m")).withColumnRenamed("b", "id")
            new = materialised(colour.join(spread, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("n"), "c"))
            changed = not new.where("n <> c").isEmpty()
            colour = new.select("id", F.col("n").alias("c"))
            if not changed:
                break
        inner = left.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        back = materialised(inner.select(F.col("b").alias("a"), F.col("a").alias("b")))
        member = reachable(colour.where("id = c").select("id"), back).select("id")
        part = materialised(member.join(colour, "id"))
        size = part.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component"))
        got = part.join(size.where("n > 1"), "c").select("id", "component")
        found = materialised(found.join(got.select("id"), "id", "left_anti").unionByName(got))
        left = cyclic_candidates(left.join(part.select(F.col("id").alias("a")), "a", "left_anti").join(part.select(F.col("id").alias("b")), "b", "left_anti"))
    return found


def shortest_paths(links: DataFrame, source: int, target: int, max_depth: int = 12, max_paths: int = 50) -> DataFrame:
    """Shortest paths a -> ... -> b as arrays of ids, in order; the first ``max_paths``.

    Parents are kept level by level, and paths are rebuilt by joining back from
    the target, so only nodes on shortest paths are ever strung together.
    """
    spark = links.sparkSession
    links = materialised(links.select("a", "b").distinct())
    levels_ = [spark.createDataFrame([(source,)], "id long")]
    seen, parents, depth = levels_[0], [], 0
    while depth < max_depth:
        if not levels_[-1].where(F.col("id") == target).isEmpty():
            break
        depth += 1
        step = materialised(levels_[-1].join(links, F.col("id") == F.col("a")).select("a", "b").join(seen.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b").distinct())
        if step.isEmpty():
            return spark.createDataFrame([], "path array<long>")
        parents.append(step)
        levels_.append(materialised(step.select(F.col("b").alias("id")).distinct()))
        seen = materialised(seen.union(levels_[-1]))
    if levels_[-1].where(F.col("id") == target).isEmpty():
        return spark.createDataFrame([], "path array<long>")
    paths = spark.createDataFrame([([target],)], "path array<long>")
    for step in reversed(parents):
        paths = paths.join(step, F.col("path")[0] == F.col("b")).select(F.concat(F.array("a"), "path").alias("path")).orderBy("path").limit(max_paths)
    return paths.orderBy("path")


def trace(hops, root: tuple, depth: int, max_nodes: int) -> tuple[list[dict], bool]:
    """Breadth-first tree of hops: rows (id, parent, depth, node, via, child_count) and whether it was cut.

    ``hops(nodes)`` gives, for the nodes of a level, their ordered hops
    {node: [(node, via), ...]} in one query.  A node already expanded is listed
    again as a leaf; when a node's hops pass ``max_nodes`` the trace ends with it.
    """
    rows = [{"id": 0, "parent": None, "depth": 0, "node": root, "via": None, "child_count": 0}]
    seen, front, cut = {root}, [0], False
    while front and not cut:
        level = [i for i in front if rows[i]["depth"] < depth]
        if not level:
            break
        got, front = hops([rows[i]["node"] for i in level]), []
        for i in level:
            found = got.get(rows[i]["node"], [])
            room = max_nodes - len(rows)
            rows[i]["child_count"] = min(len(found), room + 1)
            for target, via in found[:room]:
                rows.append({"id": len(rows), "parent": i, "depth": rows[i]["depth"] + 1, "node": target, "via": via, "child_count": 0})
                if target not in seen and target[0] is not None:
                    seen.add(target)
                    front.append(len(rows) - 1)
            if len(found) > room:
                cut = True
                break
    return rows, cut


def canonical_cycle(pdf: pd.DataFrame, key: str = "component") -> pd.DataFrame:
    """The shortest cycle through the smallest node of one strong component (rows a, b of its links)."""
    after: dict[int, list[int]] = {}
    for a, b in zip(pdf["a"], pdf["b"]):
        after.setdefault(int(a), []).append(int(b))
    start = min(after)
    back, queue = {}, [start]
    for u in queue:
        for v in sorted(after.get(u, [])):
            if v == start:
                path = [start]
                while u != start:
                    path.append(u)
                    u = back[u]
                return pd.DataFrame({key: [start], "cycle": [[start, *path[1:][::-1], start]]})
            if v not in back and v != start:
                back[v] = u
                queue.append(v)
    return pd.DataFrame({key: [start], "cycle": [[]]})


def cycles(links: DataFrame) -> DataFrame:
    """One canonical cycle a strong component; a component is held by one task, its size bounded by trimming."""
    comp = materialised(strong_components(links))
    inner = links.join(comp.select(F.col("id").alias("a"), "component"), "a").join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("component = cb")
    return inner.select("component", "a", "b").distinct().groupBy("component").applyInPandas(_cycle, "component long, cycle array<long>")


def _cycle(pdf: pd.DataFrame) -> pd.DataFrame:
    return partial(canonical_cycle, key="component")(pdf)
