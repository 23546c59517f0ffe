"""Queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadquarry.functions import redaction, scalars
from threadquarry.operators import batching, checks, consensus, evaluation, labels, merging, profiling, ranking, sampling
from threadquarry.plans.reference_sql import SQL as _ALL
from threadquarry.runtime import Scratch, table
from threadquarry.sources import payloads

#: A fixed secret for the queries; real runs pass their own.
SECRET = b"0123456789abcdef0123456789abcdef"
CUT = "TIMESTAMP '2026-06-15 00:00:00'"
VIDEO = ["platform", "raw_video_id"]


def _comments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_comments")


# ---------------------------------------------------------------- projections


def comment_scale(s, d):
    return table(s, d, "raw_videos").select("capture_seq", scalars.comment_scale(F.col("total_comment_count")).alias("comment_scale"))


def collection_target(s, d):
    return table(s, d, "raw_videos").select("capture_seq", scalars.collection_target(F.col("total_comment_count")).alias("target"))


def quality(s, d):
    m = profiling.quality(table(s, d, "sampling_manifests"))
    return m.select("manifest_id", "completion", "page_rate", "author_rate", "duplicate_rate", "status")


def dynamic_target(s, d):
    m = profiling.quality(table(s, d, "sampling_manifests"))
    factor = F.when(F.col("status") == "degraded", 1.2).otherwise(1.0)
    population = F.coalesce("reported_total", F.size("candidate_comment_ids"))
    return m.select("manifest_id", scalars.dynamic_target(population, F.lit(200), scalars.direction_factor(F.col("direction")), factor).alias("target"))


def text_tokens(s, d):
    return _comments(s, d).where("text is not null").select("arrival_seq", scalars.text_tokens(F.col("text")).alias("tokens"))


def row_tokens(s, d):
    return _comments(s, d).select("arrival_seq", scalars.row_tokens("raw_comment_id", "text", "like_count", "raw_parent_comment_id").alias("tokens"))


def input_split(s, d):
    total = F.col("signal_input_limit") + F.col("merge_input_reserve")
    return table(s, d, "batch_plans").select("plan_id", scalars.merge_reserve(total).alias("merge_tokens"), (total - scalars.merge_reserve(total)).alias("signal_tokens"), scalars.output_limit(total, F.lit(8)).alias("per_call"))


def active_comments(s, d):
    return consensus.active(_comments(s, d), F.expr("TIMESTAMP '2026-06-20 00:00:00'"), "collected_at").select("arrival_seq")


def safe_names(s, d):
    return table(s, d, "raw_videos").select(F.col("raw_video_id")).distinct().select("raw_video_id", scalars.safe_file_name(F.col("raw_video_id")).alias("safe"), scalars.looks_raw(F.col("raw_video_id")).alias("raw"))


def video_urls(s, d):
    v = table(s, d, "raw_videos").select("capture_seq", "platform", "title", "duration_seconds")
    page = F.pmod("capture_seq", F.lit(7)) + 1
    url = scalars.search_url(F.col("platform"), F.col("title"), page)
    v = v.where("platform is not null and title is not null").select("capture_seq", url.alias("url"), scalars.page_url(url, page + 1).alias("next_url"))
    return v.select("capture_seq", "next_url", scalars.page_number(F.col("next_url")).alias("page"), scalars.known_path(F.col("url"), ("bilibili.com", "douyin.com")).alias("path"))


def response_kinds(s, d):
    """An address for each capture, of a known answer or of something near it."""
    seq = F.col("capture_seq")
    forms = [
        "https://api.bilibili.com/x/v2/reply/wbi/main/?oid=", "https://www.douyin.com/aweme/v1/web/aweme/detail?id=", "http://api.bilibili.com/x/v2/reply/reply?id=", "https://notbilibili.com/x/v2/reply/reply?id=",
        "https://www.douyin.com/aweme/v1/web/comment/list/reply/?id=", "https://api.bilibili.com/x/web-interface/view?id=", "https://api.bilibili.com/x/v2/reply/other?id=",
    ]
    url = F.concat(F.element_at(F.array(*map(F.lit, forms)), (seq % len(forms) + 1).cast("int")), seq.cast("string"))
    return table(s, d, "raw_videos").select("capture_seq", "platform", url.alias("url")).withColumn("kind", payloads.response_kind(F.col("platform"), F.col("url")))


# ---------------------------------------------------------------- ids and redaction


def pseudonyms(s, d):
    c = _comments(s, d).where("raw_author_id is not null").select("raw_author_id").distinct()
    return c.select("raw_author_id", scalars.pseudonym("author", F.col("raw_author_id"), SECRET).alias("author_id"))


def signal_ids(s, d):
    r = table(s, d, "comment_labels").where("normalized_need is not null and signal_kind is not null")
    return r.select("label_seq", scalars.signal_id(F.col("comment_id"), F.col("signal_kind"), F.col("normalized_need"), "v1").alias("signal_id"))


def cluster_ids(s, d):
    r = table(s, d, "evaluation_records").where("predicted_cluster_id is not null and comment_id is not null").groupBy("video_id", "predicted_cluster_id").agg(F.collect_set("comment_id").alias("m"))
    return r.select("video_id", "predicted_cluster_id", scalars.cluster_id(F.col("m"), F.col("predicted_cluster_id"), "v1").alias("cluster_id"))


def redaction_counts(s, d):
    """Replacements per rule over all comments."""
    r = redaction.redact(_comments(s, d).select("arrival_seq", "text"), "text")
    names = [c for c in r.columns if c.startswith("n_")]
    sums = r.agg(*[F.sum(c).alias(c) for c in names], F.count_if("review").alias("reviews"))
    return sums


def redacted(s, d):
    return redaction.redact(_comments(s, d).select("arrival_seq", "text"), "text").drop("text")


# ---------------------------------------------------------------- runs


def merged_run(s, d):
    return merging.merge_run(_comments(s, d)).select(*merging.KEY, "arrival_seq", "conflict", "exact_duplicates")


def _runs(s, d):
    c = _comments(s, d)
    clean = lambda df: merging.merge_run(df).where("not conflict").drop("conflict", "exact_duplicates")
    return clean(c.where(F.col("collected_at") < F.expr(CUT))), clean(c.where(F.col("collected_at") >= F.expr(CUT)))


def upserted(s, d):
    return merging.upsert(*_runs(s, d))[0].select(*merging.KEY, "arrival_seq")


def upsert_conflicts(s, d):
    return merging.upsert(*_runs(s, d))[1].select(*merging.KEY, F.array_join("conflict_fields", ",").alias("fields"))


def duplicate_provenance(s, d):
    prev, cur = _runs(s, d)
    accepted = cur.join(merging.upsert(prev, cur)[1].select(*merging.KEY), list(merging.KEY), "left_anti")
    counts = table(s, d, "sampling_manifests").groupBy("platform", F.col("video_id").alias("raw_video_id")).agg(F.min_by("exact_duplicate_count", "manifest_id").alias("previous_duplicates"))
    return merging.duplicate_provenance(_comments(s, d).where(F.col("collected_at") >= F.expr(CUT)), accepted, prev, counts)


def first_captures(s, d):
    return merging.first_per_key(table(s, d, "raw_videos"), VIDEO, "capture_seq").select(*VIDEO, "capture_seq", "title")


# ---------------------------------------------------------------- profiles


def _firsts(s, d):
    return merging.first_per_key(_comments(s, d), list(merging.KEY), "arrival_seq")


def normalized_duplicates(s, d):
    return profiling.normalized_duplicates(_firsts(s, d))


def profiles(s, d):
    rows = Scratch(s, "profiles").keep(merging.merge_run(_comments(s, d)), "run")
    exact = rows.groupBy(*VIDEO).agg(F.sum("exact_duplicates").alias("exact_duplicate_count"))
    return profiling.profile(rows, exact)


def exclusions(s, d):
    m = table(s, d, "sampling_manifests")
    return m.select("manifest_id", profiling.exclusion_reason(F.col("collected_total"), F.col("pages_succeeded")).alias("reason"))


def platform_results(s, d):
    """Per platform: stopped if any manifest got no page, its successes, and whether all succeeded."""
    m = table(s, d, "sampling_manifests")
    ok = F.col("pages_succeeded") == F.col("pages_requested")
    return m.groupBy("platform").agg(F.bool_or(F.col("pages_succeeded") == 0).alias("stopped"), F.count_if(ok).alias("successes"), F.bool_and(ok).alias("success"))


# ---------------------------------------------------------------- quotas, samples, splits


def _quota_rows(s, d, quotas):
    t = table(s, d, "sampling_targets").where("target_count is not null").select(F.col("target_count").alias("target")).distinct()
    t = t.unionByName(s.range(0, 1001).select(F.col("id").alias("target"))).distinct()
    q = quotas(F.col("target"))
    return t.select("target", *[q[x].alias(x) for x in q])


def quotas_whole(s, d):
    return _quota_rows(s, d, sampling.collection_quotas)


def quotas_double(s, d):
    return _quota_rows(s, d, sampling.sampling_quotas)


def selected_comments(s, d):
    pool = _firsts(s, d).select(*VIDEO, F.col("source_stratum").alias("stratum"), F.col("raw_comment_id").alias("id"), F.coalesce("source_page_or_rank", F.lit(1 << 40)).alias("rank")).where("id is not null")
    totals = merging.first_per_key(table(s, d, "raw_videos"), VIDEO, "capture_seq").select(*VIDEO, scalars.collection_target(F.col("total_comment_count")).alias("target")).where("target is not null")
    return sampling.select(pool, totals, VIDEO, sampling.collection_quotas, ["rank", "id"]).select(*VIDEO, "stratum", F.col("id").alias("raw_comment_id"))


def sampling_plan(s, d):
    m = profiling.quality(table(s, d, "sampling_manifests")).where("status <> 'insufficient'")
    factor = F.when(F.col("status") == "degraded", 1.2).otherwise(1.0)
    population = F.coalesce("reported_total", F.size("candidate_comment_ids"))
    target = scalars.dynamic_target(population, F.lit(200), scalars.direction_factor(F.col("direction")), factor)
    long = m.select("manifest_id", F.explode("stratum_comment_ids").alias("stratum", "ids")).select("manifest_id", "stratum", F.explode("ids").alias("id")).distinct()
    eligible = long.groupBy("manifest_id").agg(F.count_distinct("id").alias("n"))
    targets = m.select("manifest_id", target.alias("t")).join(eligible, "manifest_id").select("manifest_id", F.least("t", "n").alias("target"))
    return sampling.select(long, targets, ["manifest_id"], sampling.sampling_quotas, ["id"]).select("manifest_id", "stratum", F.col("id").alias("comment_id"))


def evaluation_split(s, d):
    return ranking.evaluation_split(table(s, d, "raw_videos"), "raw_video_id").select(F.col("id").alias("video_id"), "split")


def dataset_split(s, d):
    return ranking.dataset_split(table(s, d, "raw_videos"), "raw_video_id").select(F.col("id").alias("video_id"), "split")


def coverage(s, d):
    v = merging.first_per_key(table(s, d, "raw_videos"), VIDEO, "capture_seq").withColumn("comment_scale", scalars.comment_scale(F.col("total_comment_count")))
    return ranking.coverage_gaps(v, {"platform": {"bilibili": 12, "douyin": 12}, "comment_scale": {"up_to_200": 8, "201_to_2000": 8, "over_2000": 8}}, 24)


def suggestions(s, d):
    taken = table(s, d, "dataset_splits").select(F.explode("development").alias("raw_video_id")).distinct()
    out = ranking.suggestions(table(s, d, "raw_videos").where("raw_video_id is not null"), taken, ["raw_video_id"], "capture_seq", ["over_2000"], "total_comment_count")
    return out.select("raw_video_id", "capture_seq", F.col("priority").cast("bigint").alias("priority"))


def skipped(s, d):
    out = ranking.skip_after_fatal(table(s, d, "sampling_manifests").where("platform is not null"), "platform", "manifest_id", F.col("pages_succeeded") < F.col("pages_requested") * 0.7)
    return out.select("manifest_id", "skipped")


def page_ranks(s, d):
    """Pages numbered by arrival within video and stratum; a row without page or stratum has no rank."""
    c = _comments(s, d)
    placed = (F.col("source_page_or_rank").isNotNull() & F.col("source_stratum").isNotNull())
    ranked = ranking.page_ranks(c.where(placed), [*VIDEO, "source_stratum"], "source_page_or_rank").select("arrival_seq", F.col("page_rank").cast("bigint").alias("page_rank"))
    return ranked.unionByName(c.where(~placed).select("arrival_seq", F.lit(None).cast("bigint").alias("page_rank")))


def discovered(s, d):
    v = table(s, d, "raw_videos").withColumn("page", F.floor(F.col("capture_seq") / 20))
    return ranking.discover(v.select(*VIDEO, "page", "capture_seq"), VIDEO, "page", "capture_seq", 50).select(*VIDEO, "capture_seq", F.col("pages").cast("bigint").alias("pages"))


def reported_counts(s, d):
    """Missing comment counts of one platform filled from other captures of the same video."""
    v = table(s, d, "raw_videos")
    known = v.where("platform = 'bilibili' and total_comment_count is not null").groupBy("raw_video_id").agg(F.max("total_comment_count").alias("found"))
    out = v.join(known, "raw_video_id", "left")
    return out.select("capture_seq", F.when((F.col("platform") == "bilibili") & F.col("total_comment_count").isNull(), F.col("found")).otherwise(F.col("total_comment_count")).alias("total"))


# ---------------------------------------------------------------- evaluation, consensus, batches


def _records(s, d):
    """One row per identity: the least by its fields, since copies may differ."""
    r = table(s, d, "evaluation_records").where("video_id is not null and comment_id is not null")
    rest = [c for c in r.columns if c not in ("video_id", "comment_id")]
    return r.groupBy("video_id", "comment_id").agg(F.min(F.struct(*rest)).alias("r")).select("video_id", "comment_id", "r.*")


def duplicate_records(s, d):
    return evaluation.duplicate_records(table(s, d, "evaluation_records"))


def evaluation_report(s, d):
    return evaluation.report(_records(s, d))


def cluster_pairs(s, d):
    return evaluation.pair_counts(evaluation.undisputed(_records(s, d)), ("video_id",))


def _consensus_inputs(s, d):
    members = _records(s, d).where("predicted_cluster_id is not null").select("video_id", F.col("predicted_cluster_id").alias("cluster_id"), "comment_id")
    c = _comments(s, d).groupBy(F.col("raw_video_id").alias("video_id"), F.col("raw_comment_id").alias("comment_id")).agg(
        F.min_by("raw_author_id", "arrival_seq").alias("author_id"), F.min_by("collected_at", "arrival_seq").alias("first_collected_at"))
    v = table(s, d, "raw_videos").where("raw_video_id is not null").groupBy(F.col("raw_video_id").alias("video_id")).agg(F.max(F.when(~F.col("raw_author_id").isin("0", "unknown"), F.col("raw_author_id"))).alias("author_id"))
    return members, c, v


def consensus_decisions(s, d):
    return consensus.decide(*_consensus_inputs(s, d))


def consensus_evidence(s, d):
    return consensus.evidence(*_consensus_inputs(s, d)).select("video_id", "cluster_id", "author_id", "comment_id")


def cache_expiry(s, d):
    members, c, _ = _consensus_inputs(s, d)
    return consensus.earliest_expiry(members, c).select("video_id", "cluster_id", F.unix_micros("expires_at").alias("expires_us"))


def _batch_inputs(s, d):
    i = table(s, d, "batch_items").where("plan_id is not null and item_id is not null").groupBy("plan_id", "item_id").agg(F.max(F.struct("estimated_at", "estimated_input_tokens")).alias("r")).select(
        "plan_id", "item_id", F.col("r.estimated_input_tokens").alias("tokens")).where("tokens > 0")
    p = table(s, d, "batch_plans").select("plan_id", F.col("per_call_input_limit").alias("per_call"), F.col("signal_input_limit").alias("budget"), F.coalesce("fixed_input_tokens", F.lit(0)).alias("fixed"), F.lit(64).alias("max_calls"))
    return i.join(p.select("plan_id"), "plan_id", "left_semi"), p


def batch_status(s, d):
    return batching.plan_batches(*_batch_inputs(s, d))[1].select("plan_id", "status")


def batches(s, d):
    return batching.batch_keys(batching.plan_batches(*_batch_inputs(s, d))[0], ["plan_id"]).select("plan_id", "batch", F.col("items").cast("bigint").alias("items"), "tokens", "batch_id")


def cover_violations(s, d):
    """Gold clusters as merged nodes, predicted clusters as a proposal: which videos' proposals don't cover their inputs."""
    r = _records(s, d).select(F.col("video_id").alias("batch_id"), "comment_id", "gold_cluster_id", "predicted_cluster_id")
    nodes = r.where("gold_cluster_id is not null").select("batch_id", F.col("gold_cluster_id").alias("node_id"), "comment_id")
    return batching.cover_violations(nodes, r.where("predicted_cluster_id is not null").select("batch_id", F.col("predicted_cluster_id").alias("cluster_id"), "comment_id"))


# ---------------------------------------------------------------- labels, checks, ingest


def label_completeness(s, d):
    return labels.completeness(labels.holding(table(s, d, "comment_labels"))).select("video_id", "annotator_id", "comments", "complete")


def label_agreement(s, d):
    return labels.side_by_side(labels.holding(table(s, d, "comment_labels")))


def label_structure(s, d):
    r = _records(s, d).where("gold_cluster_id is not null")
    held = labels.holding(table(s, d, "comment_labels"))
    clusters = held.select("video_id", "annotator_id").distinct().join(r.select("video_id", F.col("gold_cluster_id").alias("cluster_id"), "comment_id"), "video_id")
    return labels.structure_violations(held, clusters)


def manifest_checks(s, d):
    return checks.manifest_violations(table(s, d, "sampling_manifests"))


def comment_checks(s, d):
    return checks.comment_violations(_comments(s, d))


def split_checks(s, d):
    return checks.split_violations(table(s, d, "dataset_splits"))


def reference_checks(s, d):
    """Label and evaluation rows of videos that no capture shows."""
    v = table(s, d, "raw_videos").select(F.col("raw_video_id").alias("video_id"))
    a = checks.unmatched(table(s, d, "comment_labels").where("video_id is not null"), v, "comment_label", ["video_id"], "video_unknown")
    links = table(s, d, "video_links").select(F.explode(F.array("video_id", "linked_video_id")).alias("video_id")).where("video_id is not null")
    return a.unionByName(checks.unmatched(links, v, "video_link", ["video_id"], "video_unknown"))


def line_codes(s, d):
    return payloads.read_lines(table(s, d, "comment_lines")).select("line_id", "code")


def line_fields(s, d):
    r = payloads.read_lines(table(s, d, "comment_lines")).where("code is null")
    return r.select("line_id", "l_raw_comment_id", "l_raw_author_id", "l_like_count", "l_is_video_author", "l_text", F.unix_micros(scalars.strict_timestamp(F.col("l_collected_at"))).alias("collected_us"))


QUERIES = {
    f"ref_{f.__name__}": f
    for f in (
        comment_scale, collection_target, quality, dynamic_target, text_tokens, row_tokens, input_split, active_comments, safe_names, video_urls, response_kinds, pseudonyms, signal_ids, cluster_ids,
        redaction_counts, redacted, merged_run, upserted, upsert_conflicts, duplicate_provenance, first_captures, normalized_duplicates, profiles, exclusions, platform_results, quotas_whole, quotas_double,
        selected_comments, sampling_plan, evaluation_split, dataset_split, coverage, suggestions, skipped, page_ranks, discovered, reported_counts, duplicate_records, evaluation_report, cluster_pairs,
        consensus_decisions, consensus_evidence, cache_expiry, batch_status, batches, cover_violations, label_completeness, label_agreement, label_structure, manifest_checks, comment_checks, split_checks,
        reference_checks, line_codes, line_fields,
    )
}

SQL = {name: sql for name, sql in _ALL.items() if name in QUERIES}
