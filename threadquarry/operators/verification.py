"""Cross-table verification: samples against manifests, two annotators and their adjudication, cached results, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadquarry.functions.scalars import canonical_json, looks_raw, safe_file_name, signal_id
from threadquarry.operators.profiling import quality


def digest(*columns: str) -> Column:
    """SHA-256 of a row's canonical JSON (keys sorted, nulls kept)."""
    return F.sha2(canonical_json(*columns), 256)


def group_digest(df: DataFrame, scope: list[str], columns: list[str], order: str) -> DataFrame:
    """Per scope, a digest over its rows in ``order``. Rows are digested first and only digests are gathered; use it on scopes
    that a budget or a batch bounds."""
    rows = df.select(*scope, order, digest(*columns).alias("_d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "_d"))), lambda x: x["_d"])
    return rows.groupBy(*scope).agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def plan_violations(plans: DataFrame, manifests: DataFrame, members: DataFrame, requested: DataFrame) -> DataFrame:
    """Why a sample doesn't belong to its manifest and request: (manifest_id, code).

    ``plans``: manifest_id, platform, video_id, status, population_size, target_count. ``members``: manifest_id, stratum,
    comment_id as the plan assigned them. ``requested``: manifest_id, comment_id as sent on.
    """
    m = quality(manifests).select(
        "manifest_id", F.col("platform").alias("m_platform"), F.col("video_id").alias("m_video"), F.col("status").alias("m_status"),
        F.coalesce("reported_total", F.size("candidate_comment_ids")).cast("bigint").alias("m_population"))
    both = plans.join(m, "manifest_id", "left")
    rules = {
        "manifest_unknown": F.col("m_video").isNull(), "video_mismatch": (F.col("platform") != F.col("m_platform")) | (F.col("video_id") != F.col("m_video")),
        "quality_mismatch": (F.col("m_status") != "insufficient") & (F.col("status") != F.col("m_status")), "population_mismatch": F.col("population_size") != F.col("m_population"),
    }
    flat = both.select("manifest_id", F.explode(F.filter(F.array(*[F.when(bad, F.lit(c)) for c, bad in rules.items()]), lambda x: x.isNotNull())).alias("code"))
    code = lambda df, c: df.select("manifest_id", F.lit(c).alias("code")).distinct()
    on = ["manifest_id", "comment_id"]
    allowed = manifests.select("manifest_id", F.explode("stratum_comment_ids").alias("stratum", "ids")).select("manifest_id", "stratum", F.explode("ids").alias("comment_id")).distinct()
    pool = manifests.select("manifest_id", F.explode("candidate_comment_ids").alias("comment_id")).distinct()
    assigned = members.groupBy(*on).agg(F.count("*").alias("n"))
    sizes = plans.select("manifest_id", "target_count").join(members.groupBy("manifest_id").agg(F.count_distinct("comment_id").alias("n")), "manifest_id", "left")
    return (
        flat.unionByName(code(requested.join(members, on, "left_anti"), "request_not_in_plan")).unionByName(code(members.join(requested, on, "left_anti"), "plan_not_in_request"))
        .unionByName(code(requested.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "request_repeats")).unionByName(code(assigned.where("n > 1"), "strata_overlap"))
        .unionByName(code(members.join(pool, on, "left_anti"), "not_in_manifest")).unionByName(code(members.join(allowed, [*on, "stratum"], "left_anti"), "stratum_mismatch"))
        .unionByName(code(sizes.where("target_count <> coalesce(n, 0)"), "target_mismatch"))
    )


def ordered_lookup(batches: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of batches (batch_id, ids) to rows in their order (batch_id, position, comment columns), and the ids without row."""
    rows = batches.select("batch_id", F.posexplode("ids").alias("position", "comment_id"))
    return rows.join(comments, "comment_id"), rows.join(comments.select("comment_id").distinct(), "comment_id", "left_anti")


def adjudication_violations(labels: DataFrame, disputes: DataFrame) -> DataFrame:
    """Why a dispute is not settled: (video_id, code).

    ``labels``: video_id, annotator_id, position, comment_id, text. ``disputes``: video_id, first_annotator, second_annotator,
    adjudicator (null where nobody decided). The three must be distinct people who saw the same comments in the same order.
    """
    code = lambda df, c: df.select("video_id", F.lit(c).alias("code")).distinct()
    out = code(disputes.where("adjudicator is null or second_annotator is null"), "dispute_not_adjudicated")
    out = out.unionByName(code(disputes.where("first_annotator = second_annotator"), "independent_annotators_required"))
    out = out.unionByName(code(disputes.where(looks_raw(F.col("adjudicator"))), "raw_identifier_pattern"))
    seen = ["position", "comment_id", "text"]
    first = labels.join(disputes.select("video_id", F.col("first_annotator").alias("annotator_id")), ["video_id", "annotator_id"]).select("video_id", *seen)
    for who, name in (("second_annotator", "independent_annotation_source_mismatch"), ("adjudicator", "adjudication_source_mismatch")):
        other = labels.join(disputes.select("video_id", F.col(who).alias("annotator_id")), ["video_id", "annotator_id"]).select("video_id", *seen)
        settled = disputes.where(F.col(who).isNotNull()).select("video_id")
        out = out.unionByName(code(first.exceptAll(other).unionByName(other.exceptAll(first)).join(settled, "video_id", "left_semi"), name))
    return out


def label_root(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Source videos against label files (both video_id, position, comment_id): missing files, foreign files, other order."""
    a, b = sources.select("video_id").distinct().withColumn("s", F.lit(1)), files.select("video_id").distinct().withColumn("f", F.lit(1))
    sets = a.join(b, "video_id", "full_outer").where("s is null or f is null").select("video_id", F.when(F.col("s").isNull(), "foreign_file").otherwise("missing_file").alias("code"))
    cols = ["video_id", "position", "comment_id"]
    off = sources.select(*cols).exceptAll(files.select(*cols)).unionByName(files.select(*cols).exceptAll(sources.select(*cols))).select("video_id").distinct()
    return sets.unionByName(off.join(sets.select("video_id"), "video_id", "left_anti").select("video_id", F.lit("order_mismatch").alias("code")))


def cached_violations(cached: DataFrame, sources: DataFrame, version: str) -> DataFrame:
    """Cached signals (key, signal_id, comment_id, kind, summary) that may not be used: an id that is not theirs, or a source
    that the run doesn't hold (``sources``: comment_id)."""
    forged = cached.where(F.col("signal_id") != signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), version)).select("key", F.lit("id_mismatch").alias("code"))
    return forged.unionByName(cached.join(sources.select("comment_id").distinct(), "comment_id", "left_anti").select("key", F.lit("source_unknown").alias("code"))).distinct()


def preflight(runs: DataFrame) -> DataFrame:
    """``runs`` (run_id, model_name, revision, gateway_name, gateway_revision, supports_text, gateway_text, gateway_structured)
    to run_id and the first reason not to start, null if there is none."""
    c = F.col
    code = (
        F.when(c("revision").isNull(), "requested_revision_required").when(c("gateway_revision").isNull(), "gateway_revision_required").when(c("gateway_name") != c("model_name"), "gateway_model_mismatch")
        .when(c("gateway_revision") != c("revision"), "gateway_revision_mismatch").when(~(c("supports_text") & c("gateway_text") & c("gateway_structured")), "gateway_capability_unsupported")
    )
    return runs.select("run_id", code.alias("code"))


def plan_entries(plan: DataFrame, directions: list[str]) -> DataFrame:
    """(platform, video_key, code) for entries of an allow-list: unsafe keys, unknown directions, repeated videos."""
    one = lambda df, c: df.select("platform", "video_key", F.lit(c).alias("code")).distinct()
    twice = plan.groupBy("platform", "video_key").agg(F.count("*").alias("n")).where("n > 1")
    return one(plan.where(~safe_file_name(F.col("video_key"))), "unsafe_key").unionByName(one(plan.where(~F.col("direction").isin(directions)), "direction_unknown")).unionByName(one(twice, "duplicate_video"))


def discovery_source(query: Column, url: Column) -> Column:
    """Whether a discovery names exactly one of a query and a page, the page with its number at most once."""
    pages = F.size(F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("(?:^|&)page=([^&]*)"), 1))
    return (query.isNotNull() != url.isNotNull()) & (pages <= 1)


def fixture_report(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Cases (name, code) expected and observed: one row with cases checked and failed; a case without code expects none."""
    sets = lambda df, c: df.groupBy("name").agg(F.array_sort(F.collect_set("code")).alias(c))
    both = sets(expected, "e").join(sets(observed, "o"), "name", "left")
    bad = F.col("e") != F.coalesce("o", F.array().cast("array<string>"))
    return both.agg(F.count("*").alias("checked"), F.count_if(bad).alias("failed"))


def budget_snapshot(attempts: DataFrame) -> DataFrame:
    """Per scope, calls and tokens used (a missing usage counts its reservation) and reserved by open attempts."""
    done = F.col("status") != "open"
    used = lambda a, b: F.sum(F.when(done, F.coalesce(a, b)).otherwise(0)).cast("bigint")
    held = lambda c: F.sum(F.when(~done, F.col(c)).otherwise(0)).cast("bigint")
    return attempts.groupBy("scope").agg(
        F.count_if(done).alias("calls"), used("input_tokens", "reserved_input").alias("input_tokens"), used("output_tokens", "reserved_output").alias("output_tokens"),
        F.count_if(~done).alias("calls_reserved"), held("reserved_input").alias("input_reserved"), held("reserved_output").alias("output_reserved"))


def fill_videos(payload: DataFrame, page: DataFrame, key: list[str]) -> DataFrame:
    """Video rows from payloads, and from page metadata where no payload was seen; a payload's nulls are filled likewise."""
    rest = [c for c in payload.columns if c not in key]
    both = payload.alias("a").join(page.alias("b"), key, "full_outer")
    return both.select(*key, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in rest])


def masked(category: Column, known: list[str]) -> Column:
    """Error categories that a report may name; all others read collection_error."""
    return F.when(category.isin(known), category).otherwise("collection_error")
