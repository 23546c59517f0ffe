"""Evaluation of predicted signals and clusters against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_records(records: DataFrame) -> DataFrame:
    """Identities that occur more than once; metrics are defined only where this is empty."""
    return records.groupBy("video_id", "comment_id").agg(F.count("*").alias("rows")).where("rows > 1")


def undisputed(records: DataFrame) -> DataFrame:
    return records.where("adjudication is null or adjudication <> 'disputed_pending'")


def _pairs(df: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*").cast("bigint")
    return df.groupBy("video_id", *keys).agg((n * (n - 1) / 2).cast("bigint").alias("pairs"))


def pair_counts(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Predicted, gold and matched pairs of comments that share a cluster, per ``by`` (all records without).

    Pairs are counted from group sizes, never formed; that is exact since a comment has one cluster on each side.
    """
    sides = {
        "predicted_pairs": _pairs(records.where("predicted_cluster_id is not null"), "predicted_cluster_id"),
        "gold_pairs": _pairs(records.where("gold_cluster_id is not null"), "gold_cluster_id"),
        "matched_pairs": _pairs(records.where("predicted_cluster_id is not null and gold_cluster_id is not null"), "predicted_cluster_id", "gold_cluster_id"),
    }
    all_sides = None
    for name, df in sides.items():
        part = df.select(*by, F.lit(name).alias("side"), "pairs")
        all_sides = part if all_sides is None else all_sides.unionByName(part)
    return all_sides.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("side") == n, F.col("pairs"))), F.lit(0)).cast("bigint").alias(n) for n in sides])


def signal_metrics(records: DataFrame) -> DataFrame:
    eligible = F.coalesce(F.col("adjudication"), F.lit("")) != "disputed_pending"
    predicted = eligible & F.col("predicted_signal")
    return records.agg(
        F.count_if(eligible).alias("sample_count"), F.count_if(~eligible).alias("disputed_pending_count"), F.count_if(predicted).alias("predicted_positive_count"),
        F.coalesce(F.try_divide(F.count_if(predicted & F.col("gold_signal")), F.count_if(predicted)), F.lit(0.0)).alias("signal_precision"),
        F.count_if(F.col("reference_accepted") & (F.coalesce("reference_status", F.lit("")) != "valid")).alias("accepted_forged"),
    )


def report(records: DataFrame) -> DataFrame:
    """One row: signal precision, pairwise cluster precision and recall, accepted forged references, and the four gates."""
    pairs = pair_counts(undisputed(records))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = signal_metrics(records).crossJoin(pairs)  # one row each
    out = out.withColumn("cluster_precision", rate("matched_pairs", "predicted_pairs")).withColumn("cluster_recall", rate("matched_pairs", "gold_pairs"))
    gates = (F.col("signal_precision") >= 0.90) & (F.col("cluster_precision") >= 0.90) & (F.col("cluster_recall") >= 0.75) & (F.col("accepted_forged") == 0)
    return out.withColumn("all_gates_passed", gates)
