"""Whole pipelines over every video at once: collection commit, dataset preparation, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadquarry.functions import redaction, scalars
from threadquarry.operators import analysis, batching, checks, consensus, merging, model_step, profiling, ranking, sampling
from threadquarry.plans.pipelines_sql import SQL as _WHOLE
from threadquarry.plans.reference_sql import SQL as _ALL
from threadquarry.runtime import Scratch, table
from threadquarry.sources import sinks

VIDEO = ["platform", "raw_video_id"]
#: A fixed secret for the queries; real runs pass their own.
_SECRET = b"0123456789abcdef0123456789abcdef"


def collect(previous: DataFrame, observed: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commit a run of observed comments: dedupe, choose by quota, merge with the previous run.

    ``videos`` has one row per video with total_comment_count. Returns the merged comments and one row per video: target,
    chosen, conflicts and status (complete, or partial where fewer were chosen than asked). Videos whose run contradicts
    itself keep their previous comments and get status conflict.
    """
    scratch = Scratch(observed.sparkSession, "collect")
    run = scratch.keep(merging.merge_run(observed), "run")
    torn = run.where("conflict").select(*VIDEO).distinct()
    clean = run.join(torn, VIDEO, "left_anti").drop("conflict", "exact_duplicates")
    targets = videos.select(*VIDEO, scalars.collection_target(F.col("total_comment_count")).alias("target")).where("target is not null")
    pool = clean.select(*VIDEO, F.col("source_stratum").alias("stratum"), F.col("raw_comment_id").alias("id"), F.coalesce("source_page_or_rank", F.lit(1 << 40)).alias("rank"))
    chosen = scratch.keep(sampling.select(pool, targets, VIDEO, sampling.collection_quotas, ["rank", "id"]), "chosen")
    picked = clean.join(chosen.select(*VIDEO, F.col("id").alias("raw_comment_id")), [*VIDEO, "raw_comment_id"], "left_semi").select(*previous.columns)
    merged, conflicts = merging.upsert(previous, picked)
    state = (
        targets.join(chosen.groupBy(*VIDEO).agg(F.count("*").alias("chosen")), VIDEO, "left")
        .join(conflicts.groupBy(*VIDEO).agg(F.count("*").alias("conflicts")), VIDEO, "left").join(torn.withColumn("_torn", F.lit(True)), VIDEO, "left")
    )
    n = F.coalesce("chosen", F.lit(0))
    status = state.select(
        *VIDEO, "target", n.cast("bigint").alias("chosen"), F.coalesce("conflicts", F.lit(0)).cast("bigint").alias("conflicts"),
        F.when(F.col("_torn"), "conflict").when(n < F.col("target"), "partial").otherwise("complete").alias("status"))
    return merged, status


def prepare(comments: DataFrame, videos: DataFrame, approved: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepare a data set of the approved videos: (sanitised comments, profiles, splits), under pseudonyms only.

    ``approved``: platform, raw_video_id. An approved video that was not captured raises; others are not read further.
    """
    lost = approved.join(videos.select(*VIDEO), VIDEO, "left_anti")
    if not lost.isEmpty():
        raise ValueError("approved video is missing")
    kept = comments.join(approved.select(*VIDEO), VIDEO, "left_semi")
    first = merging.first_per_key(kept, list(merging.KEY), "arrival_seq")
    clean = redaction.redact(first, "text", "clean")
    name = lambda kind, c: scalars.pseudonym(kind, F.col(c), secret).alias(f"{kind}_id")
    out = clean.select("platform", name("video", "raw_video_id"), name("comment", "raw_comment_id"), name("author", "raw_author_id"),
                       scalars.pseudonym("comment", F.col("raw_parent_comment_id"), secret).alias("parent_comment_id"), F.col("clean").alias("text"), "source_stratum", "review")
    out = Scratch(comments.sparkSession, "prepare").keep(out, "comments")
    scope = ("platform", "video_id")
    exact = out.groupBy(*scope).agg(F.lit(None).cast("bigint").alias("exact_duplicate_count"))
    profiles = profiling.profile(out.withColumnRenamed("author_id", "raw_author_id"), exact, scope)
    return out, profiles, ranking.dataset_split(out, "video_id").withColumnRenamed("id", "video_id")


def sanitize_report(comments: DataFrame, secret: bytes) -> DataFrame:
    """Per video, under its pseudonym: comments, replacements by rule, and how many comments somebody should look at."""
    clean = redaction.redact(merging.first_per_key(comments, list(merging.KEY), "arrival_seq"), "text", "clean")
    counts = [F.sum(c).alias(c) for c in clean.columns if c.startswith("n_")]
    return clean.groupBy("platform", scalars.pseudonym("video", F.col("raw_video_id"), secret).alias("video_id")).agg(F.count("*").alias("comments"), *counts, F.count_if("review").alias("reviews"))


def publish_dataset(generations: sinks.Generations, comments: DataFrame, videos: DataFrame, approved: DataFrame, secret: bytes) -> str:
    """Prepare a data set and publish its comments, profiles, splits, reports and manifest (rows per table) as one version. A data
    set in which an author, comment or video still bears a platform's own id, or a table lacks videos, is refused whole."""
    out, profiles, split = prepare(comments, videos, approved, secret)
    report = sanitize_report(comments.join(approved.select(*VIDEO), VIDEO, "left_semi"), secret)
    tables = {"comments": out, "profiles": profiles, "splits": split, "reports": report}
    manifest = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        manifest = n if manifest is None else manifest.unionByName(n)

    def check(got: dict[str, DataFrame]) -> None:
        raw = [F.col(c).isNotNull() & ~F.col(c).rlike("^(video|comment|author)_[0-9a-f]{32}$") for c in ("video_id", "comment_id", "author_id", "parent_comment_id")]
        bad = got["comments"].where(raw[0] | raw[1] | raw[2] | raw[3]).select(F.lit("comment").alias("entity"), F.lit("-").alias("key"), F.lit("raw_identifier").alias("code"))
        ids = got["comments"].select("platform", "video_id").distinct()
        for name in ("profiles", "reports"):
            bad = bad.unionByName(checks.set_difference(got[name], ids, name, ["platform", "video_id"], "video_missing", "video_unknown"))
        checks.require_none(bad)

    return generations.commit_tables({**tables, "manifest": manifest}, check)


def analyse(comments: DataFrame, videos: DataFrame, gateway: model_step.Gateway, **limits) -> DataFrame:
    """The clusters of ``analyse_all`` alone."""
    return analyse_all(comments, videos, gateway, **limits)[0]


def analyse_all(comments: DataFrame, videos: DataFrame, gateway: model_step.Gateway, per_call: int = 2_000, max_calls: int = 64, max_input: int = 64_000, max_output: int = 64_000, version: str = "v1", insufficient: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Batches, calls, verified signals, clusters merged in layers and their consensus: one row per cluster, and one row per video of
    either table that says how far it came.

    ``comments``: video_id, comment_id, author_id, text, first_collected_at; ``videos``: video_id, author_id; ``insufficient``: ids
    of videos whose data may not be analysed. Each video has a ledger of its own. status is ``complete``, ``no_signal``, or what
    stopped it: ``no_comments``, ``insufficient_data``, ``plan`` (code: what its batches broke), ``budget`` (code: the resource),
    ``error``, ``invalid`` or ``identity``. A video that stopped has no clusters. Also counts of batches, calls and tokens.
    """
    scratch = Scratch(comments.sparkSession, "analyse")
    every = comments.select("video_id").unionByName(videos.select("video_id")).where("video_id is not null").distinct()
    barred = every.limit(0) if insufficient is None else insufficient.select("video_id").distinct()
    mine = comments.join(barred, "video_id", "left_anti")
    empty = analysis.prompt(analysis.INSTRUCTION["signals"], F.to_json(F.struct("video_id", F.array().cast("array<string>").alias("comments"))))
    items = mine.select(F.col("video_id").alias("plan_id"), F.col("comment_id").alias("item_id"), scalars.row_tokens("comment_id", "text").alias("tokens"))
    signal_input = max_input - -(-max_input // 4)  # the quarter, rounded up, is kept for merging
    plans = mine.select("video_id").distinct().select(
        F.col("video_id").alias("plan_id"), F.lit(per_call).alias("per_call"), F.lit(signal_input).alias("budget"), analysis.call_tokens(empty).alias("fixed"), F.lit(max_calls).alias("max_calls"))
    packed, planned = batching.plan_batches(items, plans)
    packed, planned = scratch.keep(packed, "packed"), scratch.keep(planned, "planned")
    limits = [F.lit(max_calls).alias("max_calls"), F.lit(max_input).alias("max_input"), F.lit(max_output).alias("max_output"), F.lit(max_output // max_calls if max_calls else 0).alias("reserved_output")]
    listed = F.array_sort(F.collect_list(F.struct("comment_id", "text")))  # a batch is bounded by its call
    full = packed.select(F.col("plan_id").alias("video_id"), F.col("item_id").alias("comment_id"), "batch", "tokens").join(mine.select("video_id", "comment_id", "text"), ["video_id", "comment_id"])
    full = full.groupBy("video_id", "batch").agg(listed.alias("comments"), F.sum("tokens").alias("tokens"))
    full = full.withColumn("prompt", analysis.prompt(analysis.INSTRUCTION["signals"], F.to_json(F.struct("video_id", "comments"), {"ignoreNullFields": "false"})))
    zero = [F.lit(0).alias(c) for c in ("calls", "input", "output")]
    called = scratch.keep(analysis.run_stage(full.select("video_id", "batch", "prompt", (F.col("tokens") + analysis.call_tokens(empty)).alias("tokens"), *limits, *zero), gateway, analysis.check_signals), "called")
    last = scratch.keep(analysis.last_attempts(called), "last")
    signals = scratch.keep(analysis.stage_signals(called, version).join(last.where("status = 'ok'").select("video_id"), "video_id", "left_semi"), "signals")
    state = last.select("video_id", F.lit(per_call).alias("per_call"), *limits, "calls", "input", "output")
    clusters, ended, merging_calls = analysis.merge_layers(signals, state, gateway, version)
    clusters, ended = scratch.keep(clusters, "clusters"), scratch.keep(ended, "ended")
    members = scratch.keep(clusters.select("video_id", "cluster_id", F.explode("comment_ids").alias("comment_id")), "members")
    decided = consensus.decide(members, comments.select("video_id", "comment_id", "author_id", "first_collected_at"), videos)
    decided = decided.join(clusters.select("video_id", "cluster_id", "summary", F.size("comment_ids").cast("bigint").alias("comments")), ["video_id", "cluster_id"])

    spent = called.unionByName(merging_calls.drop("layer")).groupBy("video_id").agg(F.max("calls").alias("calls"), F.max("input").alias("input_tokens"))
    got = (
        every.join(barred.withColumn("barred", F.lit(True)), "video_id", "left")
        .join(planned.select(F.col("plan_id").alias("video_id"), "items", "batches", F.col("status").alias("plan")), "video_id", "left")
        .join(last.select("video_id", F.col("status").alias("at"), F.col("code").alias("at_code")), "video_id", "left")
        .join(ended.select("video_id", F.col("status").alias("end"), F.col("code").alias("end_code"), "layers"), "video_id", "left")
        .join(spent, "video_id", "left").join(clusters.groupBy("video_id").agg(F.count("*").alias("clusters")), "video_id", "left")
    )
    c = F.col
    status = (
        F.when(c("barred"), "insufficient_data").when(c("plan").isNull(), "no_comments").when(c("plan") != "planned", "plan").when(c("at") != "ok", c("at"))
        .when(c("end").isNull(), "no_signal").when(c("end") != "ok", c("end")).otherwise("complete")
    )
    code = F.when(c("plan") != "planned", c("plan")).when(c("at") != "ok", c("at_code")).otherwise(c("end_code"))
    count = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return decided, got.select("video_id", status.alias("status"), code.alias("code"), count("items"), count("batches"), count("calls"), count("input_tokens"), count("layers"), count("clusters"))


# ---------------------------------------------------------------- queries


def _cut(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "raw_comments")
    cut = F.expr("TIMESTAMP '2026-06-15 00:00:00'")
    before = merging.merge_run(c.where(F.col("collected_at") < cut)).where("not conflict").drop("conflict", "exact_duplicates")
    return before, c.where(F.col("collected_at") >= cut).select(*before.columns), merging.first_per_key(table(spark, d, "raw_videos"), VIDEO, "capture_seq")


def collection_status(spark: SparkSession, d: str) -> DataFrame:
    return collect(*_cut(spark, d))[1]


def prepared_splits(spark: SparkSession, d: str) -> DataFrame:
    videos = merging.first_per_key(table(spark, d, "raw_videos"), VIDEO, "capture_seq")
    return prepare(table(spark, d, "raw_comments"), videos, videos.where("platform = 'bilibili'").select(*VIDEO), _SECRET)[2]


def collected_comments(spark: SparkSession, d: str) -> DataFrame:
    """The comments that the collection leaves behind, merged with the previous run."""
    out = collect(*_cut(spark, d))[0]
    return out.select(*[F.unix_micros(c).alias(c.replace("_at", "_us")) if c.endswith("_at") else F.col(c) for c in out.columns])


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The preparation of all captured videos."""
    videos = merging.first_per_key(table(spark, d, "raw_videos"), VIDEO, "capture_seq")
    approved = videos.where("platform is not null and raw_video_id is not null").select(*VIDEO)
    return prepare(table(spark, d, "raw_comments"), videos, approved, _SECRET)


def prepared_comments(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d)[0]


def prepared_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d)[1]


def sanitize_reports(spark: SparkSession, d: str) -> DataFrame:
    videos = merging.first_per_key(table(spark, d, "raw_videos"), VIDEO, "capture_seq").where("platform is not null and raw_video_id is not null")
    return sanitize_report(table(spark, d, "raw_comments").join(videos.select(*VIDEO), VIDEO, "left_semi"), _SECRET)


def published_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a data set of all captured videos, published as one version and read again beside what it says."""
    videos = merging.first_per_key(table(spark, d, "raw_videos"), VIDEO, "capture_seq")
    g = sinks.Generations(spark, Scratch(spark, "dataset").path("dataset"))
    publish_dataset(g, table(spark, d, "raw_comments"), videos, videos.where("platform is not null and raw_video_id is not null").select(*VIDEO), _SECRET)
    found = None
    for name in ("comments", "profiles", "splits", "reports"):
        n = g.read_table(name).agg(F.count("*").alias("found")).select(F.lit(name).alias("name"), "found")
        found = n if found is None else found.unionByName(n)
    return g.read_table("manifest").join(found, "name").select("name", "rows", "found")


def prepared_splits_all(spark: SparkSession, d: str) -> DataFrame:
    """The splits over the videos of all platforms; ``prepared_splits`` is one platform's data set."""
    return _prepared(spark, d)[2]


def _analysis(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "raw_comments").where("raw_video_id is not null and raw_comment_id is not null").groupBy(F.col("raw_video_id").alias("video_id"), F.col("raw_comment_id").alias("comment_id")).agg(
        F.min_by("raw_author_id", "arrival_seq").alias("author_id"), F.min_by("text", "arrival_seq").alias("text"), F.min_by("source_stratum", "arrival_seq").alias("stratum"), F.min("collected_at").alias("first_collected_at"))
    pool = c.select("video_id", "stratum", F.col("comment_id").alias("id"))
    chosen = sampling.select(pool, c.select("video_id").distinct().withColumn("target", F.lit(200).cast("bigint")), ["video_id"], sampling.sampling_quotas, ["id"])
    c = c.join(chosen.select("video_id", F.col("id").alias("comment_id")), ["video_id", "comment_id"], "left_semi").drop("stratum")
    v = table(spark, d, "raw_videos").groupBy(F.col("raw_video_id").alias("video_id")).agg(F.max(F.when(~F.col("raw_author_id").isin("0", "unknown"), F.col("raw_author_id"))).alias("author_id"))
    return analyse_all(c, v, model_step.KeywordGateway({"闪退": "pain", "白屏": "pain", "希望": "need", "wish": "need"}))


def analysis_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of up to 200 comments a video, chosen over its strata, with the keyword stand-in for a model."""
    return _analysis(spark, d)[0]


def analysis_status(spark: SparkSession, d: str) -> DataFrame:
    """How far that analysis came with each video, and what stopped it."""
    return _analysis(spark, d)[1].select("video_id", "status", "code", "items", "batches", "clusters")


QUERIES = {f"ref_{f.__name__}": f for f in (collection_status, collected_comments, prepared_splits, prepared_comments, prepared_profiles, prepared_splits_all, sanitize_reports, published_dataset, analysis_status)} | {"ref_analysis": analysis_clusters}
SQL = {name: sql for name, sql in (_ALL | _WHOLE).items() if name in QUERIES}
