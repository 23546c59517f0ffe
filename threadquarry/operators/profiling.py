"""Profiles of videos: completeness, duplicates, strata, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import casefold

VIDEO = ("platform", "raw_video_id")


def folded_text(text: Column) -> Column:
    """Case-folded text with white space collapsed: what makes two texts the same in a profile."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)[\s\x1c-\x1f]+", " "))


def normalized_duplicates(comments: DataFrame, scope: tuple[str, ...] = VIDEO, text: str = "text") -> DataFrame:
    """Per scope, rows beyond the first of each folded text; null texts take no part."""
    per_text = comments.where(F.col(text).isNotNull()).groupBy(*scope, folded_text(F.col(text)).alias("_t")).agg((F.count("*") - 1).alias("_n"))
    return per_text.groupBy(*scope).agg(F.sum("_n").cast("bigint").alias("normalized_duplicate_count"))


def profile(comments: DataFrame, exact: DataFrame, scope: tuple[str, ...] = VIDEO) -> DataFrame:
    """One row per video of deduplicated comments. ``exact``: scope and exact_duplicate_count (null where unknown).

    collected_total counts rows and known exact duplicates; strata come with their numbers of comments, not with ids, so
    a hot video's row stays small.
    """
    base = comments.groupBy(*scope).agg(F.count("*").alias("rows"), F.count("raw_author_id").alias("author_id_present"), F.count_distinct("raw_author_id").alias("distinct_author_count"))
    strata = comments.where("source_stratum is not null").groupBy(*scope, "source_stratum").agg(F.count("*").alias("n")).groupBy(*scope).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_stratum", "n"))), lambda x: F.concat(x["source_stratum"], F.lit("="), x["n"].cast("string"))), ",").alias("strata"))
    on = list(scope)
    out = base.join(strata, on, "left").join(normalized_duplicates(comments, scope), on, "left").join(exact, on, "left")
    return out.select(
        *scope, (F.col("rows") + F.coalesce("exact_duplicate_count", F.lit(0))).cast("bigint").alias("collected_total"), "author_id_present", "distinct_author_count", "strata",
        "exact_duplicate_count", F.coalesce("normalized_duplicate_count", F.lit(0)).cast("bigint").alias("normalized_duplicate_count"),
    )


def stratum_ids(rows: DataFrame, scope: list[str], stratum: str = "source_stratum", node: str = "raw_comment_id") -> DataFrame:
    """Per scope and stratum the distinct ids, in order, and their number. An array per row: use it on scopes that a sample or a
    collection target bounds, and keep rows elsewhere."""
    ids = rows.where(F.col(stratum).isNotNull() & F.col(node).isNotNull()).select(*scope, stratum, node).distinct()
    return ids.groupBy(*scope, stratum).agg(F.array_sort(F.collect_list(node)).alias("ids"), F.count("*").alias("comments"))


def quality(manifests: DataFrame) -> DataFrame:
    """Completion, page, author and duplicate rates of manifests, and their grade.

    The duplicate rate is unknown unless the schema is 1.1 and the exact count is stated, and an unknown rate is never usable;
    a degraded grade doesn't look at it.
    """
    c = F.col
    ratio = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    out = manifests.withColumn("completion", F.least(ratio("collected_total", "collection_target"), F.lit(1.0)))
    out = out.withColumn("page_rate", ratio("pages_succeeded", "pages_requested")).withColumn("author_rate", ratio("author_id_present", "collected_total"))
    trusted = (c("sampling_schema_version") == "1.1") & c("exact_duplicate_count").isNotNull()
    out = out.withColumn("duplicate_rate", F.when(trusted, (c("exact_duplicate_count") + c("normalized_duplicate_count")) / F.greatest(c("collected_total"), F.lit(1))))
    usable = (c("completion") >= 0.90) & (c("page_rate") >= 0.90) & (c("author_rate") >= 0.80) & (c("duplicate_rate") <= 0.25) & (c("distinct_author_count") >= 3)
    degraded = (c("completion") >= 0.60) & (c("page_rate") >= 0.60) & (c("author_rate") >= 0.50) & (F.size("available_strata") >= 2) & (c("distinct_author_count") >= 3)
    return out.withColumn("status", F.when(usable, "usable").when(degraded, "degraded").otherwise("insufficient"))


def exclusion_reason(collected: Column, pages: Column) -> Column:
    return F.when(collected == 0, "no_comments").when(pages == 0, "no_successful_pages")
