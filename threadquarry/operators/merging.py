"""Runs of collected comments: dedupe with conflict detection, keyed upsert, duplicate provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import conflict_fields

KEY = ("platform", "raw_video_id", "raw_comment_id")
IDENTITY = ("raw_author_id", "text")


def merge_run(rows: DataFrame, order: str = "arrival_seq", key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per comment of a run: its first row by ``order``, with ``conflict`` (its rows differ in author or text) and
    ``exact_duplicates`` (rows whose whole payload was seen before; rows that differ elsewhere are no duplicates).

    One aggregation, combinable map-side: no comment's rows are gathered. Null keys form comments of their own.
    """
    payload = [c for c in rows.columns if c != order and c not in key]
    # Rows are grouped by their values themselves, in which a null is a value: no digest that skips nulls or collides.
    said = F.struct(*payload)
    grouped = rows.groupBy(*key, said.alias("_p")).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    identity = F.struct(*[F.col(f"_p.{c}") for c in IDENTITY])
    merged = grouped.groupBy(*key).agg(
        F.min_by("_p", "_first").alias("r"), F.min("_first").alias("_first"), (~F.min(identity).eqNullSafe(F.max(identity))).alias("conflict"), (F.sum("_n") - F.count("*")).cast("bigint").alias("exact_duplicates"))
    return merged.select(*key, *[F.col("_first").alias(c) if c == order else F.col(f"r.{c}").alias(c) for c in rows.columns if c not in key], "conflict", "exact_duplicates")


def upsert(previous: DataFrame, current: DataFrame, key: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """Merge two deduplicated runs of the same columns: (rows, conflicts).

    A comment in both keeps its previous row where author or text differ, and then has a conflict row naming the fields; else
    the current row replaces it. Null authors and texts equal each other.
    """
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = previous.withColumn("_in", F.lit(1)).alias("p").join(current.withColumn("_in", F.lit(1)).alias("c"), on, "full_outer")
    old, new = F.col("p._in").isNotNull(), F.col("c._in").isNotNull()
    fields = F.when(old & new, conflict_fields("p", "c", IDENTITY)).otherwise(F.array().cast("array<string>"))
    keep_old = old & (~new | (F.size(fields) > 0))
    rows = both.select(*[F.when(keep_old, F.col(f"p.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in previous.columns])
    conflicts = both.where(F.size(fields) > 0).select(*[F.col(f"p.{k}").alias(k) for k in key], fields.alias("conflict_fields"))
    return rows, conflicts


def duplicate_provenance(observations: DataFrame, accepted: DataFrame, previous: DataFrame, counts: DataFrame, scope: tuple[str, ...] = KEY[:2], node: str = KEY[2]) -> DataFrame:
    """Per scope, exact duplicates after a commit: accepted observations beyond one each, plus accepted comments the previous
    run had, plus the previous count. ``counts`` has scope and ``previous_duplicates``; a scope it lists with null stays
    unknown, one it lacks starts at zero."""
    seen = observations.join(accepted.select(*scope, node).distinct(), [*scope, node], "left_semi").groupBy(*scope).agg((F.count("*") - F.count_distinct(node)).alias("repeats"))
    again = accepted.select(*scope, node).distinct().join(previous.select(*scope, node).distinct(), [*scope, node], "left_semi").groupBy(*scope).agg(F.count("*").alias("again"))
    out = seen.join(again, list(scope), "left").join(counts.withColumn("_known", F.lit(True)), list(scope), "left")
    new = F.col("repeats") + F.coalesce("again", F.lit(0))
    return out.select(*scope, F.when(F.col("_known").isNull(), new).otherwise(F.col("previous_duplicates") + new).cast("bigint").alias("exact_duplicate_count"))


def first_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by a unique order: an aggregation, so hot keys combine before they move."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
