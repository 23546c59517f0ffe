from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadquarry.operators import batching, checks, consensus, evaluation, labels, merging, profiling, ranking, sampling

COMMENT = "platform string, raw_video_id string, raw_comment_id string, raw_author_id string, text string, like_count bigint, arrival_seq bigint"
T0 = datetime(2026, 1, 1)


def test_merge_run(spark):
    rows = [
        ("b", "v", "1", "a", "x", 1, 1), ("b", "v", "1", "a", "x", 1, 2), ("b", "v", "1", "a", "x", 2, 3), ("b", "v", "1", "a", "x", 1, 4),
        ("b", "v", "2", None, "x", 1, 5), ("b", "v", "2", "a", "x", 1, 6), ("b", "v", "3", None, None, None, 7), ("b", "v", "3", None, None, None, 8), (None, None, None, None, None, None, 9),
    ]
    got = {(r["platform"], r["raw_comment_id"]): (r["arrival_seq"], r["conflict"], r["exact_duplicates"]) for r in merging.merge_run(spark.createDataFrame(rows, COMMENT).repartition(3)).collect()}
    assert got == {("b", "1"): (1, False, 2), ("b", "2"): (5, True, 0), ("b", "3"): (7, False, 1), (None, None): (9, False, 0)}
    # A null is a value of its own, wherever it stands.
    null = spark.createDataFrame([("b", "v", "1", None, "x", 5, None, 1), ("b", "v", "1", None, "x", None, 5, 2), ("b", "v", "2", None, "t", 1, 1, 3), ("b", "v", "2", "t", None, 1, 1, 4), ("b", "v", "3", "t", "t", 1, 1, 5), ("b", "v", "3", "t", "t", 1, 1, 6)],
                                 "platform string, raw_video_id string, raw_comment_id string, raw_author_id string, text string, like_count bigint, reply_count bigint, arrival_seq bigint")
    assert {r["raw_comment_id"]: (r["arrival_seq"], r["conflict"], r["exact_duplicates"]) for r in merging.merge_run(null).collect()} == {"1": (1, False, 0), "2": (3, True, 0), "3": (5, False, 1)}
    assert merging.merge_run(spark.createDataFrame([], COMMENT)).count() == 0


def test_upsert(spark):
    prev = spark.createDataFrame([("b", "v", "1", "a", "x", 1, 1), ("b", "v", "2", "a", "x", 1, 2), ("b", "v", "3", None, "x", 1, 3)], COMMENT)
    cur = spark.createDataFrame([("b", "v", "2", "b", "y", 5, 12), ("b", "v", "3", None, "x", 9, 13), ("b", "v", "4", "a", "x", 1, 14)], COMMENT)
    rows, conflicts = merging.upsert(prev, cur)
    assert {r["raw_comment_id"]: r["arrival_seq"] for r in rows.collect()} == {"1": 1, "2": 2, "3": 13, "4": 14}
    assert [(r["raw_comment_id"], r["conflict_fields"]) for r in conflicts.collect()] == [("2", ["raw_author_id", "text"])]


def test_duplicate_provenance(spark):
    obs = spark.createDataFrame([("b", "v", "1"), ("b", "v", "1"), ("b", "v", "2"), ("b", "w", "1"), ("b", "u", "1"), ("b", "v", "9")], "platform string, raw_video_id string, raw_comment_id string")
    acc = obs.where("raw_comment_id <> '9'").distinct()
    prev = spark.createDataFrame([("b", "v", "2")], obs.schema)
    counts = spark.createDataFrame([("b", "v", 3), ("b", "u", None)], "platform string, raw_video_id string, previous_duplicates bigint")
    got = {r["raw_video_id"]: r["exact_duplicate_count"] for r in merging.duplicate_provenance(obs, acc, prev, counts).collect()}
    assert got == {"v": 3 + 1 + 1, "w": 0, "u": None}


def test_normalized_duplicates(spark):
    df = spark.createDataFrame([("b", "v", "Straße  x"), ("b", "v", "STRASSE X"), ("b", "v", " y"), ("b", "v", None), ("b", "w", "y")], "platform string, raw_video_id string, text string")
    assert {r["raw_video_id"]: r["normalized_duplicate_count"] for r in profiling.normalized_duplicates(df).collect()} == {"v": 1, "w": 0}


def test_quality(spark):
    schema = "m string, sampling_schema_version string, collected_total bigint, collection_target bigint, pages_succeeded bigint, pages_requested bigint, author_id_present bigint, distinct_author_count bigint, exact_duplicate_count bigint, normalized_duplicate_count bigint, available_strata array<string>"
    rows = [("u", "1.1", 102, 100, 10, 10, 100, 9, 2, 0, ["top"]), ("unknown", "1.1", 100, 100, 10, 10, 100, 9, None, 0, ["top", "recent"]), ("old", "1.0", 100, 100, 10, 10, 100, 9, 0, 0, ["top"]), ("empty", "1.1", 0, 0, 0, 0, 0, 0, 0, 0, [])]
    got = {r["m"]: (r["status"], r["duplicate_rate"]) for r in profiling.quality(spark.createDataFrame(rows, schema)).collect()}
    assert got["u"] == ("usable", 2 / 102) and got["unknown"] == ("degraded", None) and got["old"] == ("insufficient", None) and got["empty"][0] == "insufficient"


def quotas(target, whole):
    w = dict(top=35, recent=25, replies=20, long_tail=20)
    exact = {s: (target * x if whole else target * (x / 100)) for s, x in w.items()}
    fl = {s: exact[s] // 100 if whole else math.floor(exact[s]) for s in w}
    rem = {s: exact[s] % 100 if whole else exact[s] - fl[s] for s in w}
    order = sorted(w, key=lambda s: (-rem[s], s if whole else list(w).index(s)))
    for s in order[: target - sum(fl.values())]:
        fl[s] += 1
    return fl


def test_quotas(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "target")
    for f, whole in ((sampling.collection_quotas, True), (sampling.sampling_quotas, False)):
        q = f(F.col("target"))
        for r in df.select("target", *[q[s].alias(s) for s in q]).collect():
            assert {s: r[s] for s in q} == quotas(r["target"], whole), r["target"]


def test_select_matches_fold(spark):
    rnd = random.Random(4)
    pool = [(v, rnd.choice(sampling.ORDER), f"i{rnd.randrange(60)}", rnd.randrange(5)) for v in ("v1", "v2") for _ in range(150)]
    pool = list({(v, s, i): (v, s, i, r) for v, s, i, r in pool}.values())
    targets = [("v1", 17), ("v2", 300), ("v3", 4)]
    got = sampling.select(spark.createDataFrame(pool, "v string, stratum string, id string, rank int").repartition(5), spark.createDataFrame(targets, "v string, target bigint"), ["v"], sampling.sampling_quotas, ["rank", "id"]).collect()
    for v, t in targets:
        pools = {s: [i for _, i in sorted((r, i) for x, y, i, r in pool if x == v and y == s)] for s in sampling.ORDER}
        want = sampling.fold(pools, quotas(t, False), t)
        assert [(r["stratum"], r["id"]) for r in sorted(got, key=lambda r: r["position"]) if r["v"] == v] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(0, 5))
def test_next_fit(sizes, fixed):
    at = batching.next_fit(sizes, fixed, 40)
    used = {}
    for s, b in zip(sizes, at):
        used[b] = used.get(b, fixed) + s
    assert all(u <= 40 for u in used.values()) and at == sorted(at)
    for i in range(1, len(at)):
        if at[i] != at[i - 1]:
            assert used[at[i - 1]] + sizes[i] > 40


def test_plan_batches(spark):
    items = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 1, 50), ("c", 1, 6), ("c", 2, 6), ("d", 1, 9), ("d", 2, 9)], "plan_id string, item_id bigint, tokens bigint")
    plans = spark.createDataFrame([("a", 12, 100, 2, None), ("b", 12, 100, 2, None), ("c", 12, 15, 2, 9), ("d", 12, 100, 2, 2), ("e", 12, 100, 2, 3)], "plan_id string, per_call bigint, budget bigint, fixed bigint, max_calls bigint")
    rows, status = batching.plan_batches(items, plans)
    assert {r["plan_id"]: r["status"] for r in status.collect()} == {"a": "planned", "b": "item_exceeds_call", "c": "budget_exhausted", "d": "calls_exhausted", "e": "empty"}
    assert sorted((r["plan_id"], r["item_id"], r["batch"]) for r in rows.collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]


def test_cover(spark):
    nodes = spark.createDataFrame([(1, "n", "a"), (1, "n", "b"), (2, "n", "a"), (2, "m", "b"), (3, "n", "a")], "batch_id int, node_id string, comment_id string")
    clusters = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (2, "x", "a"), (2, "x", "b"), (3, "x", "z"), (3, "y", "z")], "batch_id int, cluster_id string, comment_id string")
    assert {(r["batch_id"], r["code"]) for r in batching.cover_violations(nodes, clusters).collect()} == {(1, "split"), (3, "omitted"), (3, "unknown"), (3, "overlap")}


def test_consensus(spark):
    c = [("v", "1", "a", T0), ("v", "2", "a", T0 - timedelta(1)), ("v", "3", "b", T0), ("v", "4", "c", T0), ("v", "5", "owner", T0), ("v", "6", None, T0), ("w", "1", "a", T0)]
    comments = spark.createDataFrame(c, "video_id string, comment_id string, author_id string, first_collected_at timestamp")
    videos = spark.createDataFrame([("v", "owner"), ("w", None)], "video_id string, author_id string")
    members = spark.createDataFrame([("v", "ok", x) for x in "1234"] + [("v", "few", x) for x in "1256"] + [("v", "lost", "1"), ("v", "lost", "99"), ("w", "k", "1"), ("v", "ok", "1")], "video_id string, cluster_id string, comment_id string")
    got = {r["cluster_id"]: (r["authors"], r["reason_code"], r["passed"]) for r in consensus.decide(members, comments, videos).collect()}
    assert got["ok"] == (3, "independent_author_threshold_met", True) and got["few"] == (1, "insufficient_independent_authors", False)
    assert got["lost"][1] == "cluster_references_unknown_comment" and got["k"][1] == "video_author_unknown"
    ev = {(r["author_id"], r["comment_id"]) for r in consensus.evidence(members, comments, videos).where("cluster_id = 'ok'").collect()}
    assert ev == {("a", "2"), ("b", "3"), ("c", "4")}


def test_active_edges(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(seconds=1),), (T0 - timedelta(10),), (T0 - timedelta(10) + timedelta(seconds=1),)], "first_collected_at timestamp")
    assert consensus.active(df, F.lit(T0)).count() == 2


def test_evaluation(spark):
    rnd = random.Random(7)
    rows = [(f"v{rnd.randrange(3)}", f"c{i}", rnd.random() < 0.5, rnd.random() < 0.5, rnd.choice([None, "p", "q"]), rnd.choice([None, "g", "h"]), rnd.choice(["adjudicated", "disputed_pending"]), rnd.choice(["valid", "unknown"]), rnd.random() < 0.2) for i in range(90)]
    schema = "video_id string, comment_id string, predicted_signal boolean, gold_signal boolean, predicted_cluster_id string, gold_cluster_id string, adjudication string, reference_status string, reference_accepted boolean"
    r = evaluation.report(spark.createDataFrame(rows, schema)).collect()[0]
    ok = [x for x in rows if x[6] != "disputed_pending"]
    pairs = lambda k: {(a[1], b[1]) for a in ok for b in ok if a[1] < b[1] and a[0] == b[0] and a[k] == b[k] and a[k] is not None}
    p, g = pairs(4), pairs(5)
    assert (r["predicted_pairs"], r["gold_pairs"], r["matched_pairs"]) == (len(p), len(g), len(p & g))
    assert abs(r["cluster_recall"] - len(p & g) / len(g)) < 1e-12 and r["accepted_forged"] == sum(x[8] and x[7] != "valid" for x in rows)
    empty = evaluation.report(spark.createDataFrame([], schema)).collect()[0]
    assert empty["sample_count"] == 0 and empty["signal_precision"] == 0.0 and not empty["all_gates_passed"]


def test_splits(spark):
    for n, want in ((24, (10, 7, 7)), (10, (4, 3, 3)), (0, (0, 0, 0))):
        df = spark.createDataFrame([(f"id{i}",) for i in range(n)] * 2 + [(None,)], "v string")
        got = ranking.dataset_split(df, "v").collect()
        assert tuple(sum(r["split"] == s for r in got) for s in ("development", "calibration", "holdout")) == want
    ev = ranking.evaluation_split(spark.createDataFrame([(f"id{i}",) for i in range(24)], "v string"), "v").collect()
    assert tuple(sum(r["split"] == s for r in ev) for s in ("development", "calibration", "holdout")) == (10, 8, 6)


def test_skip_and_discover(spark):
    df = spark.createDataFrame([("b", 1, False), ("b", 2, True), ("b", 3, False), ("d", 1, False)], "p string, o int, f boolean")
    assert {(r["p"], r["o"]): r["skipped"] for r in ranking.skip_after_fatal(df, "p", "o", F.col("f")).collect()} == {("b", 1): False, ("b", 2): False, ("b", 3): True, ("d", 1): False}
    rows = spark.createDataFrame([("k1", 1, 1), ("k1", 1, 2), ("k2", 2, 1), ("k3", 3, 1)], "k string, page int, o int")
    got = ranking.discover(rows, ["k"], "page", "o", 2).collect()
    assert {r["k"] for r in got} == {"k1", "k2"} and {r["pages"] for r in got} == {2}


def test_least_per_group(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(7).alias("n"))
    got = ranking.least_per_group(df, ["g"], ["o"], "n").collect()
    assert sorted(r["o"] for r in got) == list(range(21))


def test_labels(spark):
    schema = "video_id string, annotator_id string, comment_id string, need_signal string, signal_kind string, noise_kind string, video_reception string, normalized_need string, labelled_at timestamp, label_seq bigint"
    rows = [("v", "a", "1", "no", "pain", "none", "mixed", None, T0, 1), ("v", "a", "1", "yes", "pain", "none", "mixed", "x", T0 + timedelta(1), 2), ("v", "b", "1", "yes", "pain", "none", "mixed", None, T0, 3), ("v", None, "1", "yes", "pain", "none", "mixed", "x", None, 4)]
    held = labels.holding(spark.createDataFrame(rows, schema))
    assert {r["annotator_id"]: r["complete"] for r in labels.completeness(held).collect()} == {"a": True, "b": False, None: False}
    assert labels.side_by_side(held).collect()[0]["need_signal_agreed"]
    clusters = spark.createDataFrame([("v", "a", "k", "1"), ("v", "a", "l", "1"), ("v", "a", "raw_1", "9")], "video_id string, annotator_id string, cluster_id string, comment_id string")
    assert {r["code"] for r in labels.structure_violations(held, clusters).collect()} == {"cross_video_cluster_member", "duplicate_cluster_membership", "raw_identifier_pattern"}


def test_checks(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "k string")
    b = spark.createDataFrame([("2",), ("3",)], "k string")
    assert {(r["key"], r["code"]) for r in checks.set_difference(a, b, "e", ["k"], "missing", "extra").collect()} == {("3", "missing"), ("1", "extra")}
    bad = checks.repeated(a, "e", ["k"], "twice")
    assert [r["key"] for r in bad.collect()] == ["2"]
    checks.require_none(bad.limit(0))
    try:
        checks.require_none(bad)
        raise AssertionError
    except ValueError as e:
        assert "twice" in str(e)
