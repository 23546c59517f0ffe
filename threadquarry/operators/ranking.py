"""Orders without a global sort task: hash order and splits, least rows per group, coverage and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadquarry.functions.scalars import comment_scale

#: Parts that a group's rows are ranked in before their winners (parts x limit rows at most) meet.
SALTS = 512


def least_per_group(df: DataFrame, keys: list[str], order: list[str], limit: str) -> DataFrame:
    """The first ``limit`` (a column) rows of each group in ``order``; ``order`` must be total. Groups of any size are ranked in
    parts, and only the parts' winners meet in one task."""
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    part = df.withColumn("_s", salt).withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_k") <= F.col(limit))
    return part.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= F.col(limit)).drop("_s", "_k")


def placed(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``df`` plus ``place``, each row's place (from 1) in its scope's order: results as rows that any writer may put in order. A scope
    is one task's work, so it is for results that a budget or a sample bounds."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))


def hash_ranks(df: DataFrame, id_column: str) -> DataFrame:
    """Distinct ids with their rank (from 1) by SHA-256 and the number of ids. Null ids are left out.

    Ids are counted by the digest's first three digits, so ranks come from 4,096 independent parts and their offsets.
    """
    ids = df.select(F.col(id_column).alias("id")).where("id is not null").distinct().withColumn("digest", F.sha2("id", 256)).withColumn("part", F.substring("digest", 1, 3))
    parts = ids.groupBy("part").agg(F.count("*").alias("n"))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))  # 4,096 rows at most
    ranked = ids.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("digest", "id"))).join(parts, "part")
    return ranked.select("id", (F.col("r") + F.col("before")).cast("bigint").alias("rank"), F.col("total").cast("bigint").alias("total"))


def _split(rank: Column, development: Column, calibration: Column) -> Column:
    return F.when(rank <= development, "development").when(rank <= development + calibration, "calibration").otherwise("holdout")


def evaluation_split(df: DataFrame, id_column: str) -> DataFrame:
    """(id, split) in hash order: two fifths and three tenths, both rounded up, and the rest."""
    r = hash_ranks(df, id_column)
    n = F.col("total").cast("double")
    return r.select("id", _split(F.col("rank"), F.ceil(n * F.lit(0.4)), F.ceil(n * F.lit(0.3))).alias("split"))


def dataset_split(df: DataFrame, id_column: str) -> DataFrame:
    """(id, split) in hash order: exactly 10 and 7 of 24, else two fifths rounded up and three tenths rounded down."""
    r = hash_ranks(df, id_column)
    n = F.col("total").cast("double")
    dev = F.when(F.col("total") == 24, F.lit(10)).otherwise(F.ceil(n * F.lit(0.4)))
    cal = F.when(F.col("total") == 24, F.lit(7)).otherwise(F.floor(n * F.lit(0.3)))
    return r.select("id", _split(F.col("rank"), dev, cal).alias("split"))


def distribution(df: DataFrame, column: str, targets: dict[str, int]) -> DataFrame:
    """(value, expected, actual) for each target value, zeros included; other values are not counted."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in targets.items()], "value string, expected bigint")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("actual"))
    return wanted.join(counts, "value", "left").select("value", "expected", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))


def coverage_gaps(df: DataFrame, targets: dict[str, dict[str, int]], total: int) -> DataFrame:
    """(dimension, value, expected, actual) where counts differ from their targets; the total is a dimension of its own."""
    out = df.agg(F.count("*").alias("actual")).select(F.lit("total").alias("dimension"), F.lit("*").alias("value"), F.lit(total).cast("bigint").alias("expected"), "actual")
    for column, wanted in targets.items():
        out = out.unionByName(distribution(df, column, wanted).select(F.lit(column).alias("dimension"), "value", "expected", "actual"))
    return out.where("expected <> actual")


def coverage_report(videos: DataFrame, targets: dict[str, dict[str, int]], total: int, unavailable: list[str]) -> DataFrame:
    """(code, expected, actual, unavailable_platforms) for each dimension whose counts differ from their targets, as
    ``value=count`` lists in the order of the targets. A platform that can't be reached replaces the platforms' own gap."""
    spark = videos.sparkSession
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("value", F.lit("="), F.col(c).cast("string")).alias("v")))), lambda x: x["v"]), ",")
    out = videos.agg(F.count("*").alias("n")).where(F.col("n") != total).select(F.lit("video_total").alias("code"), F.lit(str(total)).alias("expected"), F.col("n").cast("string").alias("actual"), F.lit("").alias("unavailable_platforms"))
    for column, wanted in targets.items():
        order = spark.createDataFrame([(v, i) for i, v in enumerate(wanted)], "value string, at int")
        both = distribution(videos, column, wanted).join(order, "value").agg(line("expected").alias("expected"), line("actual").alias("actual"))
        gone = column == "platform" and unavailable
        code = "platform_unavailable" if gone else f"{column.removeprefix('comment_')}_distribution"
        both = both if gone else both.where("expected <> actual")
        out = out.unionByName(both.select(F.lit(code).alias("code"), "expected", "actual", F.lit(",".join(dict.fromkeys(unavailable)) if gone else "").alias("unavailable_platforms")))
    return out


def suggestions(candidates: DataFrame, selected: DataFrame, key: list[str], order: str, scales: list[str], count: str) -> DataFrame:
    """Candidates that are not selected, one per key (first by ``order``), with their priority: a scale that is still missing
    first, then others, then unknown ones; then order and key."""
    rest = [c for c in candidates.columns if c not in key]
    fresh = candidates.join(selected.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    scale = comment_scale(F.col(count))
    return fresh.withColumn("priority", F.when(scale.isNull(), 2).when(scale.isin(scales), 0).otherwise(1))


def skip_after_fatal(items: DataFrame, group: str, order: str, fatal: Column) -> DataFrame:
    """``items`` plus ``skipped``: whether an earlier item of the group was fatal. One aggregation instead of a running window."""
    first = items.where(fatal).groupBy(group).agg(F.min(order).alias("_first"))
    return items.join(first, group, "left").withColumn("skipped", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def page_ranks(rows: DataFrame, scope: list[str], page: str) -> DataFrame:
    """``rows`` plus ``page_rank``: pages of a scope numbered by arrival; all rows of a page share it."""
    pages = rows.select(*scope, page).distinct().withColumn("page_rank", F.row_number().over(W.partitionBy(*scope).orderBy(page)))
    return rows.join(pages, [*scope, page])


def discover(rows: DataFrame, key: list[str], page: str, order: str, most: int, most_pages: int | None = None) -> DataFrame:
    """Candidates in page order, one per key, the first ``most``, of the first ``most_pages`` pages; with ``pages``, how many pages that
    took. The limits are the feature: discovery stops there."""
    if most_pages is not None:
        rows = rows.join(F.broadcast(rows.select(page).distinct().orderBy(page).limit(most_pages)), page, "left_semi")  # a bounded side
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(page, order)).alias("r")).select(*key, "r.*")
    taken = first.orderBy(page, order).limit(most)
    last = taken.agg(F.max(page).alias("_last"))
    pages = rows.select(page).distinct().crossJoin(last).where(F.col(page) <= F.col("_last")).agg(F.count("*").alias("pages"))  # one row
    return taken.crossJoin(pages)
