from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadquarry.functions import scalars
from threadquarry.operators import cache, consensus, labels, ranking
from threadquarry.sources import payloads

T0 = datetime(2026, 1, 1)


def test_replay(spark):
    """What one run stores the next one reads, until it expires; another stage or another model never sees it."""
    k = spark.createDataFrame([("b1", "signals", "m", "h1"), ("b2", "signals", "m", "h2"), ("b1", "signals", None, "h1"), ("b1", "cluster", "m", "h1")], "batch_id string, stage string, model_revision string, normalized_input_hash string")
    fixed = {c: F.lit("x") for c in cache.KEY_PARTS if c not in ("stage", "model_revision", "normalized_input_hash", "model_name")}
    k = k.withColumns(fixed).withColumn("key", cache.stage_key("model_name"))
    assert k.select("key").distinct().count() == 4
    first = k.where("stage = 'signals' and model_revision = 'm'")
    members = spark.createDataFrame([("b1", "c1", T0 + timedelta(9)), ("b1", "c2", T0 + timedelta(3)), ("b2", "c3", T0 + timedelta(9))], "batch_id string, comment_id string, expires_at timestamp")
    signals = spark.createDataFrame([("b1", "c1", "need", "a  b")], "batch_id string, comment_id string, kind string, summary string")
    signals = signals.select("batch_id", scalars.signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), "v").alias("signal_id"), "comment_id", "kind", scalars.summary_text(F.col("summary")).alias("summary"))
    held = cache.put(cache.put(None, cache.signal_entries(first, members, signals)), cache.signal_entries(first, members, signals))
    assert held.count() == 2  # put twice, there once; a batch without signals is an answer, too

    def events(day):
        return {(r["batch_id"], r["stage"], r["model_revision"]): r["event"] for r in cache.probe(k, held, F.lit(T0 + timedelta(day))).collect()}

    assert events(2) == {("b1", "signals", "m"): "hit", ("b2", "signals", "m"): "hit", ("b1", "signals", None): "miss", ("b1", "cluster", "m"): "miss"}
    assert events(3)["b1", "signals", "m"] == "expired" and events(3)["b2", "signals", "m"] == "hit"
    assert cache.expire(held, F.lit(T0 + timedelta(3))).count() == 1
    hits = cache.probe(k, held, F.lit(T0)).where("event = 'hit'").withColumn("expected", F.col("sources"))
    assert cache.signal_faults(hits, "v").count() == 0
    assert [r["code"] for r in cache.signal_faults(hits.where("batch_id = 'b1'"), "w").collect()] == ["identity_invalid"]
    assert {r["code"] for r in cache.signal_faults(hits.withColumn("expected", F.array(F.lit("c9"))).withColumn("sources", F.col("expected")), "v").collect()} == {"reference_invalid"}
    assert cache.signal_faults(hits.limit(0), "v").count() == 0


def test_page_contracts(spark):
    def codes(bodies, parent=None):
        df = spark.createDataFrame([("bilibili", i, b, parent) for i, b in enumerate(bodies)], "platform string, page_number int, body string, parent_comment_id string")
        return [(r["has_more"], r["next_cursor"], r["code"]) for r in payloads.bilibili_pages(df if parent else df.drop("parent_comment_id")).orderBy("page_number").collect()]

    bad = (None, None, "response_shape_changed")
    reply = '{"rpid": 1, "content": {"message": "x"}%s}'
    page = lambda r, cursor='{"is_end": true}', more="": '{"code": 0, "data": {"replies": [%s], "cursor": %s%s}}' % (r, cursor, more)
    assert codes([page(reply % ""), page(reply % "", '{"is_end": false, "next": 2}'), page(reply % "", '{"is_end": false}'), page(reply % "", "{}"), '{"code": 1}', "no", None, page('{"rpid": 1}')]) == [
        (False, None, None), (True, "2", None), bad, bad, bad, bad, bad, bad]
    counted = ', "page": {"count": 41, "num": 2, "size": 20}'
    assert codes([page(reply % ', "root": 9', more=counted), page(reply % ', "root": 8', more=counted), page(reply % "", more=', "root": {"rpid": 8}'), page(reply % "", more=', "page": {"count": 1, "num": 0, "size": 20}')], "9") == [(True, "3", None), bad, bad, bad]
    under = spark.createDataFrame([("bilibili", 1, page(reply % ', "root": 9, "parent": 7', more=counted), "9")], "platform string, page_number int, body string, parent_comment_id string")
    assert [r["raw_parent_comment_id"] for r in payloads.bilibili_comments(under).collect()] == ["7"]


def test_small_operators(spark):
    files = spark.createDataFrame([("v", "a", True, []), ("v", "b", True, [" "]), ("v", "c", True, ["text"]), ("v", "d", False, ["text"]), ("v", "e", False, None), ("v", "f", None, None)], "video_id string, annotator_id string, disputed boolean, reasons array<string>")
    assert {(r["annotator_id"], r["code"]) for r in labels.dispute_violations(files).collect()} == {("a", "dispute_without_reason"), ("b", "dispute_without_reason"), ("d", "reason_without_dispute")}
    v = spark.createDataFrame([("bilibili", "x")] * 2 + [("douyin", "y"), (None, None)], "platform string, direction string")
    targets = {"platform": {"douyin": 1, "bilibili": 2}, "direction": {"x": 1, "z": 0}}
    got = lambda gone: {r["code"]: (r["expected"], r["actual"], r["unavailable_platforms"]) for r in ranking.coverage_report(v, targets, 4, gone).collect()}
    assert got([]) == {"direction_distribution": ("x=1,z=0", "x=2,z=0", "")}
    assert got(["douyin", "douyin"])["platform_unavailable"] == ("douyin=1,bilibili=2", "douyin=1,bilibili=2", "douyin")
    assert ranking.coverage_report(v.limit(0), targets, 0, []).count() == 2
    c = spark.createDataFrame([("1", "t", T0), ("2", None, T0 - timedelta(10)), ("3", "t", None)], "id string, text string, first_collected_at timestamp")
    out = {r["id"]: (r["fingerprint"][:4], r["alive"]) for r in consensus.fingerprints(c, F.lit(T0), ["id"], ["text"]).collect()}
    assert out["1"][0] == out["3"][0] != out["2"][0] and [out[x][1] for x in "123"] == [True, False, None]
    urls = spark.createDataFrame([("bilibili", "https://search.bilibili.com/all?keyword=a&page=2&order=x", "https://search.bilibili.com/all?keyword=a&order=x"), ("bilibili", None, None)], "p string, seen string, asked string")
    assert [tuple(r) for r in urls.select(scalars.source_page_fits(F.col("asked"), F.col("seen"), F.lit(2)), scalars.is_candidate_page(F.col("p"), F.col("seen"))).collect()] == [(True, True), (False, False)]
    assert [r[0] for r in spark.createDataFrame([("life_services",), ("life_service",), ("sports",), (None,)], "d string").select(scalars.direction_name(F.col("d"))).collect()] == ["life_service", "life_service", "unknown", "unknown"]
