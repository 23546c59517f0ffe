"""Token-limited batches: next-fit in id order, and what is wrong with a plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_fit(sizes: list[int], fixed: int, limit: int) -> list[int]:
    """The batch of each item in order; a batch closes when the next item would take it over the limit."""
    at, batch, used, empty = [], 0, fixed, True
    for s in sizes:
        if not empty and used + s > limit:
            batch, used = batch + 1, fixed
        used, empty = used + s, False
        at.append(batch)
    return at


def plan_batches(items: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of the plans that hold: (plan_id, item_id, batch, tokens), and one status row per plan.

    ``items``: plan_id, item_id, tokens (one row per item). ``plans``: plan_id, per_call, budget, fixed, max_calls (null:
    no limit); one call is kept for merging. A plan fails, and has no batches, where an item exceeds a call, its calls or its
    budget run out. Items take a token at least, so a plan within its budget is a bounded group; others are never gathered.
    """
    plans = plans.select("plan_id", *[F.col(c).cast("bigint").alias(c) for c in ("per_call", "budget", "fixed", "max_calls")]).withColumn("limit", F.least("per_call", "budget"))
    items = items.withColumn("tokens", F.col("tokens").cast("bigint"))
    sums = items.groupBy("plan_id").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest"), F.count("*").alias("items"))
    known = plans.join(sums, "plan_id", "left")
    fits = known.where(F.col("items").isNotNull() & (F.col("fixed") + F.col("largest") <= F.col("limit")) & (F.col("total") + F.col("fixed") <= F.col("budget")))
    rows = items.join(fits.select("plan_id", "limit", "fixed"), "plan_id")

    def run(key, table):
        table = table.sort_by([("item_id", "ascending")])
        at = next_fit(table.column("tokens").to_pylist(), table.column("fixed")[0].as_py(), table.column("limit")[0].as_py())
        return pa.table({"plan_id": table.column("plan_id"), "item_id": table.column("item_id"), "batch": pa.array(at, pa.int64()), "tokens": table.column("tokens"), "fixed": table.column("fixed")})

    kind = items.schema["item_id"].dataType.simpleString()
    packed = rows.select("plan_id", "item_id", "tokens", "limit", "fixed").groupBy("plan_id").applyInArrow(run, f"plan_id string, item_id {kind}, batch bigint, tokens bigint, fixed bigint")
    used = packed.groupBy("plan_id").agg((F.max("batch") + 1).alias("batches"), (F.sum("tokens") + F.max("fixed") * (F.max("batch") + 1)).alias("used"))
    status = known.join(used, "plan_id", "left").select(
        "plan_id", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"), "batches", "used",
        F.when(F.col("items").isNull(), "empty").when(F.col("fixed") + F.col("largest") > F.col("limit"), "item_exceeds_call")
        .when(F.col("max_calls").isNotNull() & (F.col("batches") > F.greatest(F.col("max_calls") - 1, F.lit(0))), "calls_exhausted").when(F.col("batches").isNull() | (F.col("used") > F.col("budget")), "budget_exhausted").otherwise("planned").alias("status"),
    )
    good = status.where("status = 'planned'").select("plan_id")
    return packed.join(good, "plan_id", "left_semi").drop("fixed"), status


def batch_keys(batches: DataFrame, scope: list[str]) -> DataFrame:
    """One row per batch with the digest of its scope and ordered members (a batch is bounded by its call)."""
    from threadquarry.functions.scalars import UNIT, short_digest

    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id"))), lambda x: x["item_id"].cast("string")), UNIT)
    grouped = batches.groupBy(*scope, "batch").agg(members.alias("_m"), F.count("*").alias("items"), F.sum("tokens").cast("bigint").alias("tokens"))
    return grouped.select(*scope, "batch", "items", "tokens", short_digest("batch_", F.concat_ws(UNIT, *scope, "_m")).alias("batch_id"))


def cover_violations(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per batch, why proposed clusters do not exactly cover their inputs: (batch_id, code).

    ``nodes``: batch_id, node_id, comment_id. ``clusters``: batch_id, cluster_id, comment_id. A batch with any row is rejected
    whole; codes are overlap, unknown, omitted and split (a node that was merged before went to several clusters).
    """
    proposed = clusters.groupBy("batch_id", "comment_id").agg(F.count("*").alias("n"))
    inputs = nodes.select("batch_id", "comment_id").distinct()
    on = ["batch_id", "comment_id"]
    code = lambda df, c: df.select("batch_id", F.lit(c).alias("code")).distinct()
    torn = nodes.join(clusters.select("batch_id", "comment_id", "cluster_id"), on).groupBy("batch_id", "node_id").agg(F.count_distinct("cluster_id").alias("n")).where("n > 1")
    return (
        code(proposed.where("n > 1"), "overlap").unionByName(code(proposed.join(inputs, on, "left_anti"), "unknown"))
        .unionByName(code(inputs.join(proposed, on, "left_anti"), "omitted")).unionByName(code(torn, "split"))
    )
