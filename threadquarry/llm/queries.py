"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadquarry.llm import annotators, copies, mixing, packing, pii, quality, splits, stratified, tokens
from threadquarry.runtime import Scratch, table

# ---------------------------------------------------------------- problem 1: splits

UNKNOWN_AUTHORS = ["0", "unknown", ""]


def _video_groups(spark: SparkSession, d: str) -> DataFrame:
    videos = table(spark, d, "raw_videos")
    listed = table(spark, d, "dataset_splits").select(F.explode(F.concat(*[F.coalesce(F.col(s), F.array().cast("array<string>")) for s in splits.PROPORTIONS])).alias("id"))
    vertices = videos.select(F.col("raw_video_id").alias("id")).unionByName(listed).unionByName(table(spark, d, "evaluation_records").select(F.col("video_id").alias("id")))
    known = videos.where(F.col("platform").isNotNull() & F.col("raw_author_id").isNotNull() & ~F.lower(F.trim("raw_author_id")).isin(*UNKNOWN_AUTHORS) & F.col("raw_video_id").isNotNull())
    edges = splits.star_edges(known, ["platform", "raw_author_id"], "raw_video_id").unionByName(
        table(spark, d, "video_links").select(F.col("video_id").alias("a"), F.col("linked_video_id").alias("b")))
    return splits.components(vertices, edges)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every video known to any table."""
    return _video_groups(spark, d).select(F.col("id").alias("video_id"), F.col("component").alias("group_id"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p1")
    groups = scratch.keep(_video_groups(spark, d), "groups")
    records = table(spark, d, "evaluation_records").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("records"))
    weighted = groups.join(records, "id", "left").groupBy("component").agg(F.sum(F.coalesce("records", F.lit(0)) + 1).alias("weight"))
    return groups.join(splits.balanced_splits(weighted).select("component", "split"), "component")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Listed videos whose group earlier runs put into more than one split: of the groups that the balanced splits would move
    somewhere, those that no single listed split holds."""
    s = table(spark, d, "dataset_splits")
    listed = None
    for name in splits.PROPORTIONS:
        part = s.select(F.explode(name).alias("id"), F.lit(name).alias("listed"))
        listed = part if listed is None else listed.unionByName(part)
    listed = listed.distinct().join(_assigned(spark, d), "id")
    torn = listed.where(F.col("listed") != F.col("split")).groupBy("component").agg(F.first("split").alias("_s"))
    torn = listed.join(torn, "component", "left_semi").groupBy("component").agg(F.count_distinct("listed").alias("n")).where("n > 1").select("component")
    return listed.join(torn, "component", "left_semi").select(F.col("id").alias("video_id")).distinct()


def p1_video_split(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select(F.col("id").alias("video_id"), F.col("component").alias("group_id"), "split")


def p1_record_split(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation record with its video's split; a record without video has none."""
    return table(spark, d, "evaluation_records").join(_assigned(spark, d).select(F.col("id").alias("video_id"), "split"), "video_id", "left").select("video_id", "comment_id", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    got = p1_record_split(spark, d).groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("video_id").alias("videos"))
    total = got.agg(F.sum("records").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("split", "records", "videos", (F.col("records") / F.col("total")).alias("share"))  # one row


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """One row: videos, groups and records of known videos, groups in several splits, and whether each split has its share of
    the weight to within a bin or, where a group is heavier than a bin, that group."""
    placed = Scratch(spark, "p1").keep(_assigned(spark, d), "placed")
    records = table(spark, d, "evaluation_records").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("records"))
    groups = placed.join(records, "id", "left").groupBy("component").agg(
        F.count("*").alias("videos"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count_distinct("split").alias("splits"), F.first("split").alias("split"))
    groups = groups.withColumn("weight", F.col("videos") + F.col("records"))
    total = groups.agg(F.sum("videos").alias("videos"), F.count("*").alias("groups"), F.sum("records").alias("records"), F.count_if(F.col("splits") > 1).alias("torn"), F.max("weight").alias("heaviest"), F.sum("weight").alias("weight"))
    shares = groups.groupBy("split").agg(F.sum("weight").alias("w"))
    shares = spark.createDataFrame([*splits.PROPORTIONS.items()], "split string, p double").join(shares, "split", "left")
    far = shares.crossJoin(F.broadcast(total.select("weight", "heaviest"))).agg(  # one row
        F.max(F.abs(F.coalesce("w", F.lit(0)) - F.col("p") * F.col("weight")) - F.greatest(F.col("heaviest"), 2 * F.col("weight") / splits.BINS)).alias("beyond"))
    return total.crossJoin(F.broadcast(far)).select("videos", "groups", "records", "torn", (F.col("beyond") <= 0).alias("balanced"))  # one row


_GROUPS = """
WITH RECURSIVE listed AS (
  SELECT DISTINCT unnest(development) AS v, 'development' AS split FROM dataset_splits
  UNION SELECT DISTINCT unnest(calibration), 'calibration' FROM dataset_splits
  UNION SELECT DISTINCT unnest(holdout), 'holdout' FROM dataset_splits),
vs AS MATERIALIZED (
  SELECT raw_video_id AS v FROM raw_videos WHERE raw_video_id IS NOT NULL UNION SELECT v FROM listed WHERE v IS NOT NULL
  UNION SELECT video_id FROM evaluation_records WHERE video_id IS NOT NULL),
known AS (SELECT DISTINCT platform, raw_author_id AS au, raw_video_id AS v FROM raw_videos
  WHERE raw_author_id IS NOT NULL AND platform IS NOT NULL AND lower(trim(raw_author_id)) NOT IN ('0', 'unknown', '')),
e1 AS (SELECT v AS a, min(v) OVER (PARTITION BY platform, au) AS b FROM known
  UNION SELECT video_id, linked_video_id FROM video_links),
e2 AS MATERIALIZED (SELECT a, b FROM e1 WHERE a IN (FROM vs) AND b IN (FROM vs) AND a <> b
  UNION SELECT b, a FROM e1 WHERE a IN (FROM vs) AND b IN (FROM vs) AND a <> b),
reach AS (SELECT v, v AS w FROM vs UNION SELECT r.v, e2.b FROM reach r JOIN e2 ON e2.a = r.w),
groups AS (SELECT v AS video_id, min(w) AS group_id FROM reach GROUP BY v)
"""

# ---------------------------------------------------------------- problem 2: personal information


def _texts(spark: SparkSession, d: str) -> DataFrame:
    comments = table(spark, d, "raw_comments").select(F.lit("comment_text").alias("field"), F.col("arrival_seq").alias("row_key"), "text")
    videos = table(spark, d, "raw_videos")
    for c in ("title", "description"):
        comments = comments.unionByName(videos.select(F.lit(f"video_{c}").alias("field"), F.col("capture_seq").alias("row_key"), F.col(c).alias("text")))
    return comments


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return pii.find(texts, pii.learn(texts.select("text")))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of what was found, and all else unchanged."""
    texts = _texts(spark, d)
    return pii.redact(texts, pii.learn(texts.select("text"))).select("field", "row_key", "redacted", F.array_join("kinds", ",").alias("kinds"))


def p2_patterns(spark: SparkSession, d: str) -> DataFrame:
    """What the graph of patterns and instances believes in: contexts, endings and parts of names with their scores, and forms."""
    base, entries = pii.learned(_texts(spark, d).select("text"))
    forms = spark.createDataFrame([("forms", f"{k}|{f}", 1.0) for k, f in sorted(base.forms)], "part string, key string, score double")
    return entries.select("part", F.regexp_replace("key", "\x1f", " _ ").alias("key"), "score").unionByName(forms)


# ---------------------------------------------------------------- problem 4: packing


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces, groups, and every holding item with its room and status."""
    scratch = Scratch(spark, "p4")
    plans = table(spark, d, "batch_plans").where("plan_id is not null").groupBy("plan_id").agg(F.max(F.col("per_call_input_limit") - F.coalesce("fixed_input_tokens", F.lit(0))).alias("room"))
    held = table(spark, d, "batch_items").where("plan_id is not null and item_id is not null").groupBy("plan_id", "item_id").agg(
        F.max(F.struct("estimated_at", "estimated_input_tokens")).alias("r")).select("plan_id", "item_id", F.col("r.estimated_input_tokens").alias("tokens"))
    t, room = F.col("tokens"), F.col("room")
    status = (
        F.when(~F.col("planned"), "unknown_plan").when(t.isNull(), "no_estimate").when(room.isNull(), "no_limit").when(t > room, F.when(room <= 0, "no_room").otherwise("split"))
        .when(t <= 0, "empty").otherwise("whole")
    )
    items = held.join(plans.withColumn("planned", F.lit(True)), "plan_id", "left").withColumn("planned", F.coalesce("planned", F.lit(False))).withColumn("status", status)
    items = scratch.keep(items, "items")
    pieces, groups = packing.pack_items(
        items.where("status in ('whole', 'split')").select(F.col("plan_id").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("tokens").alias("size"), F.col("room").alias("capacity")))
    return pieces, groups, items


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the packing had to cut (or had no room for): their estimate exceeds the room of a call."""
    pieces, _, items = _calls(spark, d)
    cut = pieces.groupBy(F.col("grp").alias("plan_id"), F.col("item").cast("bigint").alias("item_id")).agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity")).where("size > capacity")
    return cut.select("plan_id", "item_id").unionByName(items.where("status = 'no_room'").select("plan_id", "item_id"))


def p4_calls(spark: SparkSession, d: str) -> DataFrame:
    """The call of each piece of each item, with the call's fill."""
    pieces, _, _ = _calls(spark, d)
    return pieces.select(F.col("grp").alias("plan_id"), F.col("item").cast("bigint").alias("item_id"), "part", "size", F.col("bin").alias("call_id"), "fill", "capacity")


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: calls used, the certified lower bound, and the share of room filled."""
    pieces, groups, _ = _calls(spark, d)
    filled = pieces.groupBy("grp").agg(F.sum("size").alias("tokens"))
    return groups.join(filled, "grp").select(F.col("grp").alias("plan_id"), F.col("bins").alias("calls"), "lower_bound", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))


def p4_plans(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: items and tokens that its calls hold, and whether no call is over its room, no item in two calls unless it was
    cut, and the calls no fewer than the bound and no more than best fit can need (twice the tokens' rooms, and one)."""
    pieces, groups, _ = _calls(spark, d)
    calls = pieces.groupBy("grp", "bin").agg(F.sum("size").alias("fill"), F.max("capacity").alias("capacity"))
    items = pieces.groupBy("grp", "item").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"), F.count_distinct("bin").alias("calls"))
    fits = calls.groupBy("grp").agg(F.bool_and(F.col("fill") <= F.col("capacity")).alias("fits"))
    held = items.groupBy("grp").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"), F.bool_and(F.col("calls") == F.ceil(F.col("size") / F.col("capacity"))).alias("whole"))
    few = (F.col("bins") >= F.col("lower_bound")) & (F.col("bins") <= 2 * F.ceil(F.col("tokens") / F.col("capacity")) + 1)
    return groups.join(fits, "grp").join(held, "grp").select(F.col("grp").alias("plan_id"), "items", "tokens", (F.col("fits") & F.col("whole") & few).alias("sound"))


# ---------------------------------------------------------------- problem 5: annotators

LABEL_FIELDS = ["need_signal", "signal_kind", "noise_kind"]
ITEM = ["video_id", "comment_id"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comment_labels").withColumn("video_id", F.coalesce("video_id", F.lit("")))
    return annotators.holding_labels(rows, ITEM, "annotator_id", LABEL_FIELDS, ["labelled_at", "label_seq"])


def _reliability(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = Scratch(spark, "p5").keep(_labels(spark, d), "labels")
    agreed, weights = annotators.consensus(labels, ITEM)
    seen = annotators.agreement(labels, ITEM).drop("z")
    return agreed, weights.join(seen, ["annotator", "field"], "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Annotators whose labels hit the reweighted vote of the others no more often than the same labels dealt at random would,
    by a test that misses CHANCE_ERROR of those who label at random."""
    _, rel = annotators.consensus(_labels(spark, d), ITEM)
    return rel.where(F.col("z").isNotNull() & (F.col("z") <= NormalDist().inv_cdf(1 - annotators.CHANCE_ERROR))).select(F.col("annotator").alias("annotator_id"), F.col("field").alias("label_field"))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    agreed, _ = annotators.consensus(_labels(spark, d), ITEM)
    return agreed.select(*ITEM, F.col("field").alias("label_field"), "value", "share", "labels")


def p5_unanimous(spark: SparkSession, d: str) -> DataFrame:
    """Consensus values that got all of the vote."""
    agreed, _ = annotators.consensus(_labels(spark, d), ITEM)
    return agreed.where("share > 1 - 1e-9").select(*ITEM, F.col("field").alias("label_field"), "value", F.col("labels").cast("bigint").alias("labels"))


def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, rel = _reliability(spark, d)
    return rel.select(F.col("annotator").alias("annotator_id"), F.col("field").alias("label_field"), "labels", "accuracy", "weight", "hits", "dealt", "z", "pairs", "observed", "expected", "kappa")


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return annotators.field_agreement(_labels(spark, d), ITEM).select(F.col("field").alias("label_field"), F.col("labels").cast("bigint").alias("labels"), "observed", "expected", "alpha")


_HELD = """
WITH held AS (
  SELECT * FROM comment_labels WHERE annotator_id IS NOT NULL AND comment_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id, comment_id, annotator_id ORDER BY labelled_at DESC NULLS LAST, label_seq DESC) = 1),
long AS MATERIALIZED (
  SELECT video_id, comment_id, annotator_id AS a, 'need_signal' AS f, need_signal AS v FROM held
  UNION ALL SELECT video_id, comment_id, annotator_id, 'signal_kind', signal_kind FROM held
  UNION ALL SELECT video_id, comment_id, annotator_id, 'noise_kind', noise_kind FROM held),
lab AS MATERIALIZED (SELECT * FROM long WHERE v IS NOT NULL AND v <> 'unlabeled')
"""

# ---------------------------------------------------------------- problem 6: samples

SCOPE = ["platform", "raw_video_id"]


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    comments = table(spark, d, "raw_comments").select(
        *SCOPE, "raw_comment_id", stratified.stratum_name(F.col("source_stratum")).alias("stratum"), F.when(F.col("raw_parent_comment_id").isNull(), "top_level").otherwise("reply").alias("side"))
    requests = stratified.requests_of(table(spark, d, "sampling_targets"), SCOPE)
    return stratified.stratified_sample(comments, requests, SCOPE, "raw_comment_id", "side")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Strata that the sample left short because the video has fewer comments of them than asked, under the targets' own spelling."""
    _, report = _sample(spark, d)
    own = table(spark, d, "sampling_targets").where("request_id is not null").select("request_id", "source_stratum", stratified.stratum_name(F.col("source_stratum")).alias("s")).distinct()
    gaps = report.where((F.col("chosen") < F.col("needed")) & (F.col("available") < F.col("needed"))).select("request_id", F.col("source_stratum").alias("s"))
    return own.join(gaps.hint("merge"), ["request_id", "s"]).select("request_id", "source_stratum")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = _sample(spark, d)
    return chosen.select("request_id", F.col("record").alias("raw_comment_id"), F.array_join("strata", ",").alias("strata"), "weight")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = _sample(spark, d)
    return report.withColumn("gap", F.greatest(F.col("needed") - F.col("chosen"), F.lit(0.0)))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per request: records chosen, each once and of the request's own video."""
    chosen, report = _sample(spark, d)
    have = chosen.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("record").alias("distinct"))
    return report.select("request_id").distinct().join(have, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("chosen"), F.coalesce("distinct", F.lit(0)).alias("distinct"))


# ---------------------------------------------------------------- problem 7: copies


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    a = copies.copy_pairs(table(spark, d, "raw_comments"), SCOPE, "arrival_seq", "text").withColumn("table_name", F.lit("raw_comments"))
    b = copies.copy_pairs(table(spark, d, "comment_lines"), SCOPE, "line_id", "body", copies.line_bytes).withColumn("table_name", F.lit("comment_lines"))
    return a.unionByName(b).select("table_name", "first_key", "copy_key")


def p7_representatives(spark: SparkSession, d: str) -> DataFrame:
    """One comment of each content per video, and its number of copies."""
    groups = copies.copy_groups(table(spark, d, "raw_comments"), SCOPE, "arrival_seq", "text")
    kept = table(spark, d, "raw_comments").select(*SCOPE, F.col("arrival_seq").alias("first_key"), "text")
    return groups.join(kept, "first_key").select(*SCOPE, "first_key", "copies", "text")


def p7_against_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Per manifest: the copies it states and the copies counted here over its video's comments."""
    counted = p7_representatives(spark, d).groupBy(*SCOPE).agg(F.sum(F.col("copies") - 1).alias("counted"))
    m = table(spark, d, "sampling_manifests").select("manifest_id", "platform", F.col("video_id").alias("raw_video_id"), "exact_duplicate_count", "normalized_duplicate_count")
    return m.join(counted, SCOPE, "left").select("manifest_id", *SCOPE, "exact_duplicate_count", "normalized_duplicate_count", F.coalesce("counted", F.lit(0)).cast("bigint").alias("counted"))


# ---------------------------------------------------------------- problem 8: tokens


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from their text (none should)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode_corpus(tokens.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return back.join(docs, "doc_id").where(F.col("decoded") != F.coalesce("text", F.lit(""))).select("doc_id")


def p8_empty(spark: SparkSession, d: str) -> DataFrame:
    """Documents without ids."""
    return p8_ids(spark, d).where(F.size("ids") == 0).select("doc_id")


# ---------------------------------------------------------------- problem 9: mixes


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the mix left below their share although their documents were used as often as they may be."""
    _, report = _mixed(spark, d)
    own = table(spark, d, "mix_targets").select("mix_id", F.col("source").alias("asked"), mixing.source_name(F.col("source")).alias("source")).distinct()
    return report.where((F.col("actual_tokens") < F.col("wanted")) & F.col("short")).join(own, ["mix_id", "source"]).select("mix_id", F.col("asked").alias("source"))


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: its cap, and whether its documents stay within it, its tokens within two documents of its goal,
    and the mix's shares add up to 1."""
    chosen, report = _mixed(spark, d)
    used = chosen.groupBy("mix_id", "source").agg(F.max("repeats").alias("most"), F.max("tokens").alias("largest"))
    sums = report.groupBy("mix_id").agg(F.sum("actual_share").alias("shares"))
    near = F.abs(F.col("actual_tokens") - F.col("goal")) <= 2 * F.coalesce("largest", F.lit(0))
    out = report.join(used, ["mix_id", "source"], "left").join(sums, "mix_id")
    return out.select("mix_id", "source", F.col("max_repeats").cast("bigint").alias("max_repeats"), ((F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & near & (F.abs(F.col("shares") - 1) < 1e-9)).alias("sound"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


# ---------------------------------------------------------------- problem 10: quality


def _measured(spark: SparkSession, d: str) -> DataFrame:
    common: dict[str, list[str]] = {}
    for r in table(spark, d, "common_words").where("lang is not null and word is not null").collect():  # fixed table of 118 rows
        common.setdefault(r["lang"].lower(), []).append(r["word"])
    return Scratch(spark, "p10").keep(quality.measure(table(spark, d, "documents"), common), "measured")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose tails say that they are a list, a table or junk."""
    return quality.flagged(_measured(spark, d)).where(F.size("tails") > 0).select("doc_id", quality.kind().alias("kind")).where("kind is not null")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic of every document that is not blank, with the tails it lies in."""
    return quality.flagged(_measured(spark, d)).drop("source").withColumn("tails", F.array_join("tails", ","))


def p10_sketches(spark: SparkSession, d: str) -> DataFrame:
    out = quality.sketches(_measured(spark, d))
    return out.select("language", "source", "documents", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("q")) for s in quality.STATISTICS])).alias("x")).select(
        "language", "source", "documents", "x.statistic", *[F.col("x.q")[i].alias(n) for i, n in enumerate(("p01", "p05", "p25", "p50", "p75", "p95", "p99"))])


QUERIES = {
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p2_patterns": p2_patterns,
    "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_sketches": p10_sketches,
    "p1_found": p1_found, "p1_groups": p1_groups, "p1_video_split": p1_video_split, "p1_record_split": p1_record_split, "p1_shares": p1_shares, "p1_balance": p1_balance,
    "p4_found": p4_found, "p4_calls": p4_calls, "p4_fill": p4_fill, "p4_plans": p4_plans,
    "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_unanimous": p5_unanimous, "p5_reliability": p5_reliability, "p5_agreement": p5_agreement,
    "p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report, "p6_sizes": p6_sizes,
    "p7_found": p7_found, "p7_representatives": p7_representatives, "p7_against_manifests": p7_against_manifests,
    "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p8_empty": p8_empty,
    "p9_found": p9_found, "p9_mix": p9_mix, "p9_report": p9_report, "p9_caps": p9_caps,
}

_WIDE, _NARROW = ("".join(chr(c + d) for c in range(0x21, 0x7F)) for d in (0xFEE0, 0))
_DRESS = r"[\p{P}\p{Z}\s\p{Cc}\p{Cf}\x{85}\x{34F}\x{115F}\x{1160}\x{3164}\x{FE00}-\x{FE0F}]+"


def _canonical(text: str) -> str:
    wide, narrow = (x.replace("'", "''") for x in (_WIDE, _NARROW))
    return f"regexp_replace(lower(nfc_normalize(translate({text}, '{wide}', '{narrow}'))), '{_DRESS}', '', 'g')"


_LINE = ["raw_comment_id", "raw_author_id", "raw_parent_comment_id", "published_at", "collected_at", "like_count", "reply_count", "is_video_author", "source_stratum", "source_page_or_rank"]

SQL = {
    "p7_found": f"""WITH c AS (SELECT 'raw_comments' AS table_name, arrival_seq AS k, platform, raw_video_id, {_canonical('text')} AS t FROM raw_comments WHERE text IS NOT NULL),
j AS (SELECT line_id, platform, raw_video_id, body::JSON AS b FROM comment_lines WHERE json_valid(body)),
l AS (SELECT 'comment_lines' AS table_name, line_id AS k, platform, raw_video_id, coalesce(nullif('c' || {_canonical("(b->>'text')")}, 'c'), 'r' || (b->>'text')) AS t, {', '.join(f"b->>'{f}' AS f{i}" for i, f in enumerate(_LINE))} FROM j),
p AS (SELECT table_name, k, min(k) OVER (PARTITION BY platform, raw_video_id, t) AS first_key FROM c WHERE t <> ''
  UNION ALL SELECT table_name, k, min(k) OVER (PARTITION BY platform, raw_video_id, t, {', '.join(f"f{i}" for i in range(len(_LINE)))}) FROM l)
SELECT table_name, first_key, k AS copy_key FROM p WHERE k <> first_key""",
    "p1_found": _GROUPS + """SELECT DISTINCT l.v AS video_id FROM listed l JOIN groups g ON g.video_id = l.v WHERE g.group_id IN (
  SELECT g2.group_id FROM listed l2 JOIN groups g2 ON g2.video_id = l2.v GROUP BY 1 HAVING count(DISTINCT l2.split) > 1)""",
    "p1_groups": _GROUPS + "SELECT video_id, group_id FROM groups",
    "p1_balance": _GROUPS + """SELECT (SELECT count(*) FROM groups) AS videos, (SELECT count(DISTINCT group_id) FROM groups) AS groups,
  (SELECT count(*) FROM evaluation_records WHERE video_id IS NOT NULL) AS records, 0::BIGINT AS torn, true AS balanced""",
    "p4_plans": """WITH p AS (SELECT plan_id, max(per_call_input_limit - coalesce(fixed_input_tokens, 0)) AS room FROM batch_plans WHERE plan_id IS NOT NULL GROUP BY 1),
i AS (SELECT plan_id, item_id, estimated_input_tokens AS t FROM batch_items WHERE plan_id IS NOT NULL AND item_id IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY plan_id, item_id ORDER BY estimated_at DESC NULLS LAST, estimated_input_tokens DESC NULLS LAST) = 1)
SELECT plan_id, count(*) AS items, sum(t)::BIGINT AS tokens, true AS sound FROM i JOIN p USING (plan_id) WHERE t > 0 AND room > 0 GROUP BY 1""",
    "p5_unanimous": _HELD + """SELECT coalesce(video_id, '') AS video_id, comment_id, f AS label_field, min(v) AS value, count(*) AS labels FROM lab GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1""",
    "p6_sizes": """WITH r AS (SELECT request_id, platform, raw_video_id, greatest(coalesce(max(target_count), 0), 0) AS t FROM sampling_targets WHERE request_id IS NOT NULL AND source_stratum IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT platform, raw_video_id, count(DISTINCT raw_comment_id) AS n FROM raw_comments GROUP BY 1, 2)
SELECT request_id, least(t, coalesce(n, 0))::BIGINT AS chosen, least(t, coalesce(n, 0))::BIGINT AS "distinct" FROM r LEFT JOIN n USING (platform, raw_video_id)""",
    "p7_representatives": f"""WITH c AS (SELECT platform, raw_video_id, arrival_seq, text, {_canonical('text')} AS t FROM raw_comments WHERE text IS NOT NULL AND arrival_seq IS NOT NULL)
SELECT platform, raw_video_id, min(arrival_seq) AS first_key, count(*) AS copies, arg_min(text, arrival_seq) AS text FROM c WHERE t <> '' GROUP BY platform, raw_video_id, t""",
    "p7_against_manifests": f"""WITH c AS (SELECT platform, raw_video_id, {_canonical('text')} AS t FROM raw_comments WHERE text IS NOT NULL),
n AS (SELECT platform, raw_video_id, count(*) - count(DISTINCT t) AS n FROM c WHERE t <> '' GROUP BY 1, 2)
SELECT manifest_id, m.platform, m.video_id AS raw_video_id, exact_duplicate_count, normalized_duplicate_count, coalesce(n, 0)::BIGINT AS counted
FROM sampling_manifests m LEFT JOIN n ON n.platform = m.platform AND n.raw_video_id = m.video_id""",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p8_empty": "SELECT doc_id FROM documents WHERE text IS NULL OR text = ''",
    "p9_caps": r"SELECT mix_id, regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, max(max_repeats)::BIGINT AS max_repeats, true AS sound FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2",
    "p4_found": """WITH p AS (SELECT plan_id, max(per_call_input_limit - coalesce(fixed_input_tokens, 0)) AS room FROM batch_plans GROUP BY 1),
i AS (SELECT * FROM batch_items WHERE plan_id IS NOT NULL AND item_id IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY plan_id, item_id ORDER BY estimated_at DESC NULLS LAST, estimated_input_tokens DESC NULLS LAST) = 1)
SELECT plan_id, item_id FROM i JOIN p USING (plan_id) WHERE estimated_input_tokens > room""",
    "p5_found": _HELD + """, n1 AS (SELECT video_id, comment_id, f, v, count(*) AS n FROM lab GROUP BY ALL),
n2 AS (SELECT video_id, comment_id, f, sum(n) AS total FROM n1 GROUP BY ALL HAVING sum(n) > 1),
own AS (SELECT l.a, l.f, l.v, n1.n - 1 AS same, n2.total - 1 AS others, l.video_id, l.comment_id FROM lab l
  JOIN n1 USING (video_id, comment_id, f, v) JOIN n2 USING (video_id, comment_id, f)),
p AS (SELECT a, f, v, count(*) / sum(count(*)) OVER (PARTITION BY a, f) AS p FROM own GROUP BY a, f, v),
e AS (SELECT o.a, o.f, o.video_id, o.comment_id, any_value(o.same) AS same, sum(p.p * (n1.n - (n1.v = o.v)::INT)) AS e, sum(p.p * (n1.n - (n1.v = o.v)::INT) ** 2) AS q
  FROM own o JOIN n1 USING (video_id, comment_id, f) JOIN p ON p.a = o.a AND p.f = o.f AND p.v = n1.v GROUP BY ALL),
z AS (SELECT a, f, sum(same) AS agreed, sum(e) AS e, sum(q - e * e) AS var FROM e GROUP BY a, f),
base AS (SELECT a, f, sum(others) AS pairs, sum(same) / sum(others) AS po FROM own GROUP BY ALL),
mine AS (SELECT a, f, v, sum(others) AS m FROM own GROUP BY ALL),
their AS (SELECT o.a, o.f, n1.v, sum(n1.n - (n1.v = o.v)::INT) AS t FROM own o JOIN n1 USING (video_id, comment_id, f) GROUP BY ALL),
ch AS (SELECT a, f, sum(m::DOUBLE * t) AS mt FROM mine JOIN their USING (a, f, v) GROUP BY ALL),
k AS (SELECT a, f, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT a, f, po, coalesce(mt, 0) / (pairs::DOUBLE * pairs) AS pe FROM base LEFT JOIN ch USING (a, f)))
SELECT a AS annotator_id, f AS label_field FROM z JOIN k USING (a, f) WHERE CASE WHEN var > 1e-9 THEN (agreed - e) / sqrt(var) ELSE 0 END <= 4.5 AND coalesce(kappa, 0) < 0.2""",
    "p5_agreement": _HELD + """, n1 AS (SELECT video_id, comment_id, f, v, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
n2 AS (SELECT video_id, comment_id, f, sum(n) AS m FROM n1 GROUP BY ALL HAVING sum(n) > 1),
x AS (SELECT n1.f, n1.v, n1.n, n2.m FROM n1 JOIN n2 USING (video_id, comment_id, f)),
w AS (SELECT f, sum(n * (n - 1) / (m - 1)) AS agree, sum(n) AS labels FROM x GROUP BY f),
e AS (SELECT f, sum(nv * (nv - 1)) AS ee FROM (SELECT f, v, sum(n) AS nv FROM x GROUP BY ALL) GROUP BY f)
SELECT f AS label_field, labels::BIGINT AS labels, round(agree / labels, 15) AS observed, ee / (labels * (labels - 1)) AS expected,
  (agree / labels - ee / (labels * (labels - 1))) / (1 - ee / (labels * (labels - 1))) AS alpha FROM w JOIN e USING (f)""",
    "p6_found": r"""WITH norm AS (SELECT DISTINCT platform, raw_video_id, raw_comment_id,
  nullif(regexp_replace(lower(trim(source_stratum)), '[\s\-_]+', '_', 'g'), '') AS s FROM raw_comments WHERE raw_comment_id IS NOT NULL),
have AS (SELECT platform, raw_video_id, s, count(*) AS n FROM norm WHERE s IS NOT NULL GROUP BY ALL)
SELECT t.request_id, t.source_stratum FROM sampling_targets t
LEFT JOIN have h ON h.platform = t.platform AND h.raw_video_id = t.raw_video_id
  AND h.s = regexp_replace(lower(trim(t.source_stratum)), '[\s\-_]+', '_', 'g')
WHERE coalesce(h.n, 0) < greatest(coalesce(t.min_count, 0)::DOUBLE, t.target_count * t.target_share)""",
}
