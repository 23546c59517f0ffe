"""Constraint catalogue: every rule yields (entity, key, code) rows; fail-closed callers raise where any exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_violating(df: DataFrame, entity: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One scan for all row rules of an entity; a rule that is null holds."""
    codes = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.explode(codes).alias("code"))


def repeated(df: DataFrame, entity: str, columns: list[str], code: str) -> DataFrame:
    key = F.concat_ws("/", *columns)
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(entity).alias("entity"), key.alias("key"), F.lit(code).alias("code"))


def unmatched(df: DataFrame, other: DataFrame, entity: str, columns: list[str], code: str) -> DataFrame:
    """Rows whose reference is absent (left anti)."""
    return df.select(*columns).distinct().join(other.select(*columns).distinct(), columns, "left_anti").select(F.lit(entity).alias("entity"), F.concat_ws("/", *columns).alias("key"), F.lit(code).alias("code"))


def set_difference(left: DataFrame, right: DataFrame, entity: str, columns: list[str], missing: str, extra: str) -> DataFrame:
    """Both directions of a set equality."""
    return unmatched(right, left, entity, columns, missing).unionByName(unmatched(left, right, entity, columns, extra))


def manifest_violations(manifests: DataFrame) -> DataFrame:
    c = F.col
    ids, strata = c("candidate_comment_ids"), c("stratum_comment_ids")
    flat = F.flatten(F.map_values(strata))
    return rows_violating(manifests, "sampling_manifest", c("manifest_id"), {
        "pages_succeeded_exceed_requested": c("pages_succeeded") > c("pages_requested"),
        "authors_exceed_collected": c("author_id_present") > c("collected_total"),
        "distinct_authors_exceed_present": c("distinct_author_count") > c("author_id_present"),
        "duplicates_exceed_collected": F.coalesce("exact_duplicate_count", F.lit(0)) + F.coalesce("normalized_duplicate_count", F.lit(0)) > c("collected_total"),
        "candidate_ids_repeat": F.size(F.array_distinct(ids)) < F.size(ids),
        "candidates_exceed_collected": F.size(ids) > c("collected_total"),
        "strata_differ_from_keys": F.array_sort(F.array_distinct("available_strata")) != F.array_sort(F.map_keys(strata)),
        "stratum_ids_repeat": F.exists(F.map_values(strata), lambda x: F.size(F.array_distinct(x)) < F.size(x)),
        "stratum_ids_outside_pool": F.size(F.array_except(flat, ids)) > 0,
    })


def comment_violations(comments: DataFrame) -> DataFrame:
    c = F.col
    return rows_violating(comments, "raw_comment", c("arrival_seq"), {
        "text_blank": c("text").isNull() | ~c("text").rlike(r"(?U)[^\s\x1c-\x1f]"),
        "replies_to_itself": c("raw_parent_comment_id") == c("raw_comment_id"),
        "identifier_invalid": ~c("raw_comment_id").rlike(r"(?U)^\S{1,256}$"),
        "stratum_unknown": ~c("source_stratum").isin("top", "recent", "replies", "long_tail"),
        "count_negative": (c("like_count") < 0) | (c("reply_count") < 0) | (c("source_page_or_rank") < 1),
        "collected_before_published": c("collected_at") < c("published_at"),
    })


def split_violations(splits: DataFrame, names: tuple[str, ...] = ("development", "calibration", "holdout")) -> DataFrame:
    """Videos listed more than once within a run's split: repeated in a group, or in several groups."""
    listed = None
    for n in names:
        part = splits.select("split_id", F.lit(n).alias("grp"), F.explode(n).alias("video_id"))
        listed = part if listed is None else listed.unionByName(part)
    seen = listed.groupBy("split_id", "video_id").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("g")).where("n > 1")
    return seen.select(F.lit("dataset_split").alias("entity"), F.concat_ws("/", "split_id", "video_id").alias("key"), F.when(F.col("g") > 1, "groups_overlap").otherwise("group_repeats").alias("code"))


def require_none(violations: DataFrame) -> None:
    """Fail closed: raise with a few of the violations where there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r['entity']} {r['key']}: {r['code']}" for r in some))
