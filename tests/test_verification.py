from __future__ import annotations

from pyspark.sql import functions as F

from threadquarry.functions.scalars import signal_id
from threadquarry.operators import verification as v

MANIFEST = "manifest_id string, platform string, video_id string, sampling_schema_version string, reported_total bigint, collected_total bigint, collection_target bigint, pages_succeeded bigint, pages_requested bigint, author_id_present bigint, distinct_author_count bigint, exact_duplicate_count bigint, normalized_duplicate_count bigint, available_strata array<string>, candidate_comment_ids array<string>, stratum_comment_ids map<string,array<string>>"


def test_plan_violations(spark):
    m = spark.createDataFrame([(i, "b", i, "1.1", None, 4, 4, 1, 1, 4, 4, 0, 0, ["top"], ["1", "2", "3", "4"], {"top": ["1", "2"], "recent": ["2", "3"]}) for i in ("good", "bad")], MANIFEST)
    plans = spark.createDataFrame([("good", "b", "good", "usable", 4, 2), ("bad", "b", "other", "degraded", 9, 5), ("lost", "b", "lost", "usable", 1, 0)], "manifest_id string, platform string, video_id string, status string, population_size bigint, target_count bigint")
    members = spark.createDataFrame([("good", "top", "1"), ("good", "recent", "3"), ("bad", "top", "2"), ("bad", "recent", "2"), ("bad", "top", "3"), ("bad", "top", "9")], "manifest_id string, stratum string, comment_id string")
    requested = spark.createDataFrame([("good", "1"), ("good", "3"), ("bad", "2"), ("bad", "2"), ("bad", "7")], "manifest_id string, comment_id string")
    got = {(r["manifest_id"], r["code"]) for r in v.plan_violations(plans, m, members, requested).collect()}
    codes = {"video_mismatch", "quality_mismatch", "population_mismatch", "request_not_in_plan", "plan_not_in_request", "request_repeats", "strata_overlap", "not_in_manifest", "stratum_mismatch", "target_mismatch"}
    assert got == {("bad", c) for c in codes} | {("lost", "manifest_unknown")}


def test_lookup_and_digests(spark):
    b = spark.createDataFrame([("x", ["2", "1", "9"])], "batch_id string, ids array<string>")
    c = spark.createDataFrame([("1", "a"), ("2", "b")], "comment_id string, text string")
    rows, lost = v.ordered_lookup(b, c)
    assert [r["comment_id"] for r in rows.orderBy("position").collect()] == ["2", "1"] and [r["comment_id"] for r in lost.collect()] == ["9"]
    one = v.group_digest(c.withColumn("g", F.lit(1)), ["g"], ["comment_id", "text"], "comment_id").collect()[0]["digest"]
    assert one == v.group_digest(c.repartition(2).withColumn("g", F.lit(1)), ["g"], ["text", "comment_id"], "comment_id").collect()[0]["digest"]


def test_adjudication(spark):
    rows = [("v", a, i, f"c{i}", "t") for a in ("a", "b", "j") for i in range(2)] + [("w", "a", 0, "c0", "t"), ("w", "b", 0, "c0", "other"), ("w", "j", 0, "c0", "t")]
    labels = spark.createDataFrame(rows, "video_id string, annotator_id string, position int, comment_id string, text string")
    d = spark.createDataFrame([("v", "a", "b", "j"), ("w", "a", "b", "j"), ("x", "a", "a", None)], "video_id string, first_annotator string, second_annotator string, adjudicator string")
    assert {(r["video_id"], r["code"]) for r in v.adjudication_violations(labels, d).collect()} == {("w", "independent_annotation_source_mismatch"), ("x", "dispute_not_adjudicated"), ("x", "independent_annotators_required")}
    src, files = labels.where("annotator_id = 'a'"), labels.where("annotator_id = 'b' and video_id = 'v'").withColumn("position", 1 - F.col("position"))
    assert {(r["video_id"], r["code"]) for r in v.label_root(src, files).collect()} == {("v", "order_mismatch"), ("w", "missing_file")}


def test_cached(spark):
    c = spark.createDataFrame([("k", "1", "need", "s"), ("l", "9", "need", "s")], "key string, comment_id string, kind string, summary string").withColumn("signal_id", signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), "v1"))
    bad = c.where("key = 'k'").withColumn("key", F.lit("m")).withColumn("summary", F.lit("t"))
    got = v.cached_violations(c.unionByName(bad), spark.createDataFrame([("1",)], "comment_id string"), "v1").collect()
    assert {(r["key"], r["code"]) for r in got} == {("l", "source_unknown"), ("m", "id_mismatch")}


def test_preflight_and_sources(spark):
    runs = [("ok", "m", "1", "m", "1", True, True, True), ("a", "m", None, "m", "1", True, True, True), ("b", "m", "1", "m", None, True, True, True), ("c", "m", "1", "n", "1", True, True, True), ("d", "m", "1", "m", "2", True, True, True), ("e", "m", "1", "m", "1", True, True, False)]
    df = spark.createDataFrame(runs, "run_id string, model_name string, revision string, gateway_name string, gateway_revision string, supports_text boolean, gateway_text boolean, gateway_structured boolean")
    assert {r["run_id"]: r["code"] for r in v.preflight(df).collect()} == {"ok": None, "a": "requested_revision_required", "b": "gateway_revision_required", "c": "gateway_model_mismatch", "d": "gateway_revision_mismatch", "e": "gateway_capability_unsupported"}
    s = spark.createDataFrame([("q", None), (None, "https://x.com/?page=1"), (None, "https://x.com/?page=1&page=2"), ("q", "https://x.com/"), (None, None)], "q string, u string")
    assert [r["x"] for r in s.select(v.discovery_source(F.col("q"), F.col("u")).alias("x")).collect()] == [True, True, False, False, False]
    plan = spark.createDataFrame([("b", "k", "life_services"), ("b", "k", "life_services"), ("b", "a/b", "life_services"), ("d", "z", "odd")], "platform string, video_key string, direction string")
    assert {(r["video_key"], r["code"]) for r in v.plan_entries(plan, ["life_services"]).collect()} == {("k", "duplicate_video"), ("a/b", "unsafe_key"), ("z", "direction_unknown")}


def test_reports(spark):
    e = spark.createDataFrame([("a", None), ("b", "x"), ("c", "x")], "name string, code string")
    o = spark.createDataFrame([("b", "x"), ("c", "y")], "name string, code string")
    assert tuple(v.fixture_report(e, o).collect()[0]) == (3, 1)
    a = spark.createDataFrame([("s", "ok", 3, 1, 5, 2), ("s", "error", None, None, 5, 2), ("s", "open", None, None, 7, 4)], "scope string, status string, input_tokens bigint, output_tokens bigint, reserved_input bigint, reserved_output bigint")
    assert tuple(v.budget_snapshot(a).collect()[0]) == ("s", 2, 8, 3, 1, 7, 4)
    p = spark.createDataFrame([("1", "t", None)], "k string, title string, n int")
    q = spark.createDataFrame([("1", "u", 5), ("2", "w", 6)], "k string, title string, n int")
    assert {tuple(r) for r in v.fill_videos(p, q, ["k"]).collect()} == {("1", "t", 5), ("2", "w", 6)}
    assert [r["x"] for r in spark.createDataFrame([("known",), ("odd",), (None,)], "c string").select(v.masked(F.col("c"), ["known"]).alias("x")).collect()] == ["known", "collection_error", "collection_error"]
