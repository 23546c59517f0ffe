"""Consensus of distinct authors, on evidence that has not expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct authors that a cluster needs.
LEAST_AUTHORS = 3
LIFETIME = "INTERVAL '10' DAY"


def active(comments: DataFrame, at: Column, first: str = "first_collected_at") -> DataFrame:
    """Comments collected by ``at`` and not expired then; the very moment of expiry is too late. The lower bound is written
    on the column itself, so that scans can skip by it."""
    return comments.where((F.col(first) <= at) & (F.col(first) > at - F.expr(LIFETIME)))


def evidence(members: DataFrame, comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Per cluster and author the earliest comment: (cluster keys, author_id, comment_id, first_collected_at).

    ``members``: video_id, cluster_id, comment_id. ``comments``: video_id, comment_id, author_id, first_collected_at.
    ``videos``: video_id, author_id. Unknown authors and the video's own author give no evidence; nor does anything under a
    video whose author is unknown. An aggregation, so a hot author or cluster combines before it moves.
    """
    joined = members.distinct().join(comments, ["video_id", "comment_id"]).join(videos.select("video_id", F.col("author_id").alias("_owner")), "video_id")
    counted = joined.where("author_id is not null and _owner is not null and author_id <> _owner")
    return counted.groupBy("video_id", "cluster_id", "author_id").agg(F.min(F.struct("first_collected_at", "comment_id")).alias("e")).select(
        "video_id", "cluster_id", "author_id", F.col("e.comment_id").alias("comment_id"), F.col("e.first_collected_at").alias("first_collected_at"))


def decide(members: DataFrame, comments: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per cluster: authors, passed, and the first reason that applies: a member is unknown, the video's author is
    unknown, too few independent authors, or the threshold is met."""
    rows = members.distinct()
    known = comments.select("video_id", "comment_id").distinct()
    lost = rows.join(known, ["video_id", "comment_id"], "left_anti").groupBy("video_id", "cluster_id").agg(F.lit(True).alias("lost"))
    authors = evidence(members, comments, videos).groupBy("video_id", "cluster_id").agg(F.count("*").alias("authors"))
    owners = videos.where("author_id is not null").select("video_id").distinct().withColumn("owned", F.lit(True))
    out = rows.select("video_id", "cluster_id").distinct().join(lost, ["video_id", "cluster_id"], "left").join(authors, ["video_id", "cluster_id"], "left").join(owners, "video_id", "left")
    n = F.coalesce("authors", F.lit(0))
    reason = (
        F.when(F.col("lost"), "cluster_references_unknown_comment").when(F.col("owned").isNull(), "video_author_unknown").when(n < LEAST_AUTHORS, "insufficient_independent_authors")
        .otherwise("independent_author_threshold_met")
    )
    return out.select("video_id", "cluster_id", n.cast("bigint").alias("authors"), reason.alias("reason_code")).withColumn("passed", F.col("reason_code") == "independent_author_threshold_met")


def earliest_expiry(members: DataFrame, comments: DataFrame) -> DataFrame:
    """When a cluster's cached result expires: with the first of its members."""
    return members.distinct().join(comments, ["video_id", "comment_id"]).groupBy("video_id", "cluster_id").agg((F.min("first_collected_at") + F.expr(LIFETIME)).alias("expires_at"))


def fingerprints(comments: DataFrame, at: Column, key: list[str], parts: list[str], first: str = "first_collected_at") -> DataFrame:
    """What outlives comments: key, the digest of their parts, and whether they are alive at ``at``. Texts may go when they expire,
    fingerprints stay, so that a comment that comes again is known."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p), F.lit("")) for p in parts]), 256)
    return comments.select(*key, digest.alias("fingerprint"), ((F.col(first) <= at) & (F.col(first) > at - F.expr(LIFETIME))).alias("alive"))
