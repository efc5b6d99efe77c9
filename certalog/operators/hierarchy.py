"""Trees and graphs level by level: what is reached from roots, and seeds written into a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.session import staged


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): what each root reaches over edges (parent, child), with the least number of steps; roots reach themselves.

    Each level is one join of the frontier with the edges and an anti-join with what was seen, staged, until a level is empty: cycles end,
    and no path is held. Nulls are no nodes.
    """
    e = staged(edges.select(F.col(edges.columns[0]).alias("node"), F.col(edges.columns[1]).alias("child")).where("node is not null and child is not null").distinct())
    first = roots.select(F.col(roots.columns[0]).alias("root")).where("root is not null").distinct()
    seen = frontier = staged(first.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(e, "node").select("root", F.col("child").alias("node")).distinct()
        frontier = staged(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def seed_tree(seeds: DataFrame, existing: DataFrame, dry_run: bool = False) -> DataFrame:
    """What a tree of seeds does to existing nodes: seed, node_id, parent_id, name, level, synonyms, action.

    seeds: seed, parent (a seed; null for roots), name, synonyms (array). existing: node_id (text), parent_id, name, level, synonyms, is_active. A seed is the
    node of its name below its parent's node; its level, its synonyms (name first, each once) and being active are made right (updated), or
    it is created with an id made of its place. A dry run has no ids of parents, so it looks for all below the roots among nodes without parent. Seeds on
    a cycle, or below no root, are no tree and have no row. Levels are joined one after the other.
    """
    known = existing.select("node_id", "parent_id", "name", F.col("level").alias("_level"), F.col("synonyms").alias("_synonyms"), F.col("is_active").alias("_active"))
    s = seeds.select("seed", "parent", "name", F.array_distinct(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("synonyms"))
    none = F.lit(None).cast("string")
    now, level, out = s.where("parent is null").withColumn("parent_id", none), 1, None
    while True:
        at = now.alias("s").join(known.alias("k"), (F.col("s.name") == F.col("k.name")) & F.col("s.parent_id").eqNullSafe(F.col("k.parent_id")), "left")
        right = (F.col("_level") == level) & F.col("_synonyms").eqNullSafe(F.col("s.synonyms")) & F.coalesce("_active", F.lit(True))
        action = F.when(F.col("node_id").isNull(), "created").when(F.coalesce(right, F.lit(False)), "unchanged").otherwise("updated")
        made = F.sha2(F.concat_ws("/", F.coalesce("s.parent_id", F.lit("")), "s.name"), 256)
        rows = staged(at.select("s.seed", F.coalesce("node_id", made).alias("node_id"), "s.parent_id", "s.name", F.lit(level).alias("level"), "s.synonyms", action.alias("action")))
        if rows.isEmpty():
            return rows if out is None else out
        out = rows if out is None else out.unionByName(rows)
        above = rows.select(F.col("seed").alias("parent"), (none if dry_run else F.col("node_id")).alias("parent_id"))
        now, level = s.join(above, "parent"), level + 1
