"""Parent-child rows to full hierarchies: path, depth, root, descendants, and what has no root.

Roots and the children of absent parents start a frontier that a few level-wise joins push down. Nearly every node is
reached in those rounds. What is left (deep chains, rings and what hangs below rings) is finished by the same frontier
join with doubled strides: an unreached node joins its current ancestor, and either lands on a reached node or doubles the
stretch it knows, so a chain of depth d takes log2(d) joins. Nodes that no frontier reaches lead into a ring; there the
image of the doubled parent function shrinks until it holds ring nodes only. Frontiers grow with the data, so their joins
are sort-merge joins, never broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadquarry.runtime import Scratch

#: Level-wise rounds before strides are doubled. It sets speed only; any value gives the same result.
FRONTIER_ROUNDS = 3


def nodes_of(df: DataFrame, scope: list[str], node: str, parent: str) -> DataFrame:
    """One row per node as (s1.., id, par). A parent named in any row holds; an empty name is none; null ids are no nodes."""
    named = F.when(F.col(parent) != "", F.col(parent))
    keys = [F.col(c).alias(f"s{i}") for i, c in enumerate(scope)]
    return df.where(F.col(node).isNotNull()).groupBy(*keys, F.col(node).alias("id")).agg(F.max(named).alias("par"))


def _on(left: str, right: str, scopes: list[str], a: str, b: str) -> Column:
    cond = F.col(f"{left}.{a}") == F.col(f"{right}.{b}")
    for s in scopes:
        cond = cond & F.col(f"{left}.{s}").eqNullSafe(F.col(f"{right}.{s}"))
    return cond


def resolve(df: DataFrame, scope: list[str], node: str, parent: str) -> DataFrame:
    """Place every node in its tree.

    Returns one row per node: the scope columns, ``node``, ``status``, ``root``, ``depth`` and ``path`` (array from the top
    down to the node itself).

    * ``rooted``: its chain ends at a node without parent; depth 0 is the root.
    * ``lost_root``: its chain ends at a parent that the scope doesn't hold; root null, path and depth counted from the
      topmost node present.
    * ``in_cycle`` / ``below_cycle``: following parents returns to the node (also at once), or enters such a ring from
      outside; root, depth and path null.

    Rows with a null node are left out, null scope values form a scope of their own, repeated rows count once, extra
    columns are ignored, and an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hierarchy")
    scopes = [f"s{i}" for i in range(len(scope))]
    base = nodes_of(df.select(*scope, node, parent), scope, node, parent)
    base = scratch.keep(base, "nodes")

    present = base.select(*scopes, F.col("id").alias("pid"))
    linked = (
        base.where("par is not null").alias("n")
        .join(present.hint("merge").alias("p"), _on("n", "p", scopes, "par", "pid"), "left")
        .select("n.*", F.col("p.pid").isNotNull().alias("held"))
    )
    reached_cols = [*scopes, "id", "status", "root", "depth", "path"]
    top = base.where("par is null").select(
        *scopes, "id", F.lit("rooted").alias("status"), F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("path")
    )
    linked = scratch.keep(linked, "linked")
    lost = linked.where("not held").select(
        *scopes, "id", F.lit("lost_root").alias("status"), F.lit(None).cast("string").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("path")
    )
    # ptr is the ancestor that seg (the stretch below it, top down) hangs from.
    waiting = linked.where("held").select(*scopes, "id", F.col("par").alias("ptr"), F.array("id").alias("seg"))
    reached = [top, lost]
    frontier = top.unionByName(lost)
    left = None
    rounds = 0
    stride = None
    while left is None or left > 0:
        doubling = rounds >= FRONTIER_ROUNDS
        step = (
            waiting.alias("w")
            .join(frontier.select(*scopes, F.col("id").alias("fid"), "status", "root", "depth", "path").hint("merge").alias("f"), _on("w", "f", scopes, "ptr", "fid"), "left")
            .select(
                *[F.col(f"w.{c}") for c in (*scopes, "id", "ptr", "seg")],
                "status", "root",
                (F.col("depth") + F.size("seg")).alias("depth"),
                F.when(F.col("status").isNotNull(), F.concat("path", "seg")).alias("path"),
            )
            .withColumn("hit", F.col("status").isNotNull())
        )
        seen = Observation()
        step = scratch.keep(step.observe(seen, F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("rows")), f"step{rounds}", ["hit"])
        scratch.drop(stride)
        hit, miss = step.where("hit"), step.where("not hit").select(*scopes, "id", "ptr", "seg")
        # What landed now is all that the next round can land on: every end was looked up before and had not been reached.
        frontier = hit.select(*reached_cols)
        hits, left = seen.get["hits"], seen.get["rows"] - seen.get["hits"]
        reached.append(frontier)
        waiting = miss
        if not hits and rounds > FRONTIER_ROUNDS:
            break  # chains are contiguous: if no stretch landed, none ever will
        if doubling:
            waiting = (
                miss.alias("w")
                .join(miss.hint("merge").alias("u"), _on("w", "u", scopes, "ptr", "id"), "left")
                .select(
                    *[F.col(f"w.{c}").alias(c) for c in (*scopes, "id")],
                    F.coalesce("u.ptr", "w.ptr").alias("ptr"),
                    F.when(F.col("u.ptr").isNotNull(), F.concat("u.seg", "w.seg")).otherwise(F.col("w.seg")).alias("seg"),
                )
            )
            waiting = stride = scratch.keep(waiting, f"stride{rounds}")
        rounds += 1

    # The stretches of ring nodes grew with the strides; start again from plain parents.
    ring = waiting.select(*scopes, "id").alias("w").join(
        linked.select(*scopes, F.col("id").alias("lid"), "par").hint("merge").alias("l"), _on("w", "l", scopes, "id", "lid")
    ).select(*[F.col(f"w.{c}").alias(c) for c in scopes], F.col("w.id").alias("id"), F.col("par").alias("ptr"))
    ring = scratch.keep(ring, "ring")
    image = ring.select(*scopes, F.col("ptr").alias("id")).distinct()
    size = image.count()
    while size:
        doubled = scratch.keep(
            ring.alias("a").join(ring.hint("merge").alias("b"), _on("a", "b", scopes, "ptr", "id")).select(*[F.col(f"a.{c}").alias(c) for c in (*scopes, "id")], F.col("b.ptr").alias("ptr")),
            "ring",
        )
        image = doubled.select(*scopes, F.col("ptr").alias("id")).distinct()
        now = image.count()
        scratch.drop(ring)
        ring = doubled
        if now == size:
            break
        size = now
    unreached = (
        ring.alias("a").join(image.select(*scopes, F.col("id").alias("iid")).hint("merge").alias("i"), _on("a", "i", scopes, "id", "iid"), "left")
        .select(
            *[F.col(f"a.{c}").alias(c) for c in (*scopes, "id")],
            F.when(F.col("iid").isNotNull(), "in_cycle").otherwise("below_cycle").alias("status"),
            F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"),
        )
    )
    out = unreached
    for part in reached:
        out = out.unionByName(part)
    return out.select(*[F.col(s).alias(c) for s, c in zip(scopes, scope)], F.col("id").alias(node), "status", "root", "depth", "path")


def descendant_pairs(resolved: DataFrame, scope: list[str], node: str) -> DataFrame:
    """One row per (ancestor, descendant) with their distance, from the paths of placed nodes. Rings have no paths, so no pairs.

    Rows, not one array per ancestor: the subtree of a hot root stays spread over tasks.
    """
    size = F.size("path")
    return (
        resolved.where(F.col("path").isNotNull() & (size > 1))
        .select(*scope, F.col(node).alias("descendant"), size.alias("_n"), F.posexplode(F.slice("path", F.lit(1), size - 1)).alias("_pos", "ancestor"))
        .select(*scope, "ancestor", "descendant", (F.col("_n") - 1 - F.col("_pos")).cast("bigint").alias("distance"))
    )


def with_descendant_counts(resolved: DataFrame, scope: list[str], node: str) -> DataFrame:
    """``resolved`` plus the number of descendants of each node (0 for leaves and for ring nodes).

    Counts are added up by doubling: a node that knows how many nodes hang less than 2^k below it hands that number to its
    2^k-th ancestor, so a tree of depth d takes log2(d) rounds over as many rows as there are nodes, never a row per pair.
    """
    scratch = Scratch(resolved.sparkSession, "descendants")
    placed = scratch.keep(resolved, "placed")
    names = [f"s{i}" for i in range(len(scope))]
    own = placed.where("path is not null").select(*[F.col(c).alias(s) for c, s in zip(scope, names)], F.col(node).alias("id"), "path", F.lit(1).cast("bigint").alias("n"))
    deepest = own.agg(F.max(F.size("path"))).first()[0] or 0
    step, last = 1, None
    while step < deepest:
        up = own.where(F.size("path") > step).groupBy(*names, F.element_at("path", -1 - step).alias("up")).agg(F.sum("n").alias("more"))
        added = own.alias("o").join(up.hint("merge").alias("u"), _on("o", "u", names, "id", "up"), "left").select("o.*", "u.more")
        own = scratch.keep(added.select(*names, "id", "path", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), f"sums{step}")
        scratch.drop(last)
        last, step = own, 2 * step
    counts = own.where("n > 1")
    cond = F.col(f"r.{node}") == F.col("c.id")
    for c, s in zip(scope, names):
        cond = cond & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{s}"))
    return placed.alias("r").join(counts.hint("merge").alias("c"), cond, "left").select("r.*", F.coalesce(F.col("c.n") - 1, F.lit(0)).alias("descendants"))
