"""Label files: completeness, structure, and two annotators' answers side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadquarry.functions.scalars import looks_raw

FIELDS = ("need_signal", "signal_kind", "noise_kind", "video_reception")


def holding(labels: DataFrame) -> DataFrame:
    """The latest row of each video, annotator and comment."""
    key = ["video_id", "annotator_id", "comment_id"]
    rest = [c for c in labels.columns if c not in key]
    order = F.struct("labelled_at", "label_seq")
    return labels.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def completeness(labels: DataFrame) -> DataFrame:
    """Per video and annotator: comments, and whether all fields are labelled and every need is put into words."""
    missing = F.lit(False)
    for f in FIELDS:
        missing = missing | F.col(f).isNull() | (F.col(f) == "unlabeled")
    unsaid = (F.col("need_signal") == "yes") & (F.coalesce(F.length("normalized_need"), F.lit(0)) == 0)
    return labels.groupBy("video_id", "annotator_id").agg(
        F.count("*").alias("comments"), (F.col("annotator_id").isNotNull() & ~F.max(F.coalesce(missing | unsaid, F.lit(True)))).alias("complete"))


def structure_violations(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(video_id, annotator_id, code): repeated comments, cluster members that are no comments of the video, comments in
    several clusters, and ids that look like a platform's own. ``clusters``: video_id, annotator_id, cluster_id, comment_id."""
    key = ["video_id", "annotator_id"]
    code = lambda df, c: df.select(*key, F.lit(c).alias("code")).distinct()
    twice = labels.groupBy(*key, "comment_id").agg(F.count("*").alias("n")).where("n > 1")
    foreign = clusters.join(labels.select(*key, "comment_id").distinct(), [*key, "comment_id"], "left_anti")
    many = clusters.groupBy(*key, "comment_id").agg(F.count_distinct("cluster_id").alias("n")).where("n > 1")
    return (
        code(twice, "duplicate_comment").unionByName(code(foreign, "cross_video_cluster_member")).unionByName(code(many, "duplicate_cluster_membership"))
        .unionByName(code(labels.where(looks_raw(F.col("annotator_id"))), "raw_identifier_pattern")).unionByName(code(clusters.where(looks_raw(F.col("cluster_id"))), "raw_identifier_pattern"))
    ).distinct()


def dispute_violations(files: DataFrame) -> DataFrame:
    """(video_id, annotator_id, code) of files (disputed, reasons array<string>) that are disputed without a reason, or give reasons
    without a dispute."""
    said = F.size(F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.trim(r) != "")) > 0
    code = F.when(F.col("disputed") & ~said, "dispute_without_reason").when(~F.col("disputed") & said, "reason_without_dispute")
    return files.select("video_id", "annotator_id", code.alias("code")).where("code is not null")


def side_by_side(labels: DataFrame) -> DataFrame:
    """Per comment: annotators and whether they all agree, by field. Counted from distinct values, without pairs."""
    aggs = [(F.count_distinct(f) <= 1).alias(f"{f}_agreed") for f in FIELDS]
    return labels.groupBy("video_id", "comment_id").agg(F.count_distinct("annotator_id").alias("annotators"), *aggs).where("annotators > 1")


def blank_labels(comments: DataFrame) -> DataFrame:
    """One unlabelled row per comment, to be filled in."""
    out = comments.select("video_id", "comment_id", "text")
    for f in FIELDS:
        out = out.withColumn(f, F.lit("unlabeled"))
    return out.withColumn("normalized_need", F.lit(None).cast("string"))


def export(labels: DataFrame, path: str) -> None:
    """Write the complete files of labels (a file is a video's by one annotator) as JSON lines, numbered in the order of their
    comments; incomplete ones are held back whole. A path that exists is refused."""
    whole = completeness(labels).where("complete").select("video_id", "annotator_id")
    line = (F.row_number().over(W.partitionBy("video_id", "annotator_id").orderBy("comment_id")) - 1).cast("bigint")  # one person's work on one video
    rows = labels.join(whole, ["video_id", "annotator_id"], "left_semi").select("video_id", "annotator_id", "comment_id", line.alias("line"), *FIELDS, "normalized_need")
    rows.repartition("video_id", "annotator_id").sortWithinPartitions("video_id", "annotator_id", "line").write.mode("errorifexists").json(path)
