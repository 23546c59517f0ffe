from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from threadquarry.operators import model_step
from threadquarry.plans import inventory
from threadquarry.sources import files, payloads
from threadquarry.sources.sinks import Generations, append_audit, sensitive_keys

GOOD = {"raw_comment_id": "1", "raw_author_id": None, "raw_parent_comment_id": None, "text": "x y", "published_at": None, "collected_at": "2026-01-01T00:00:00Z", "like_count": 1, "reply_count": None, "is_video_author": None, "source_stratum": "top", "source_page_or_rank": 1}


def line(**kw):
    return json.dumps({**GOOD, **kw}, ensure_ascii=False)


def test_lines(spark):
    rows = [line(), "", "{", line(extra=1), json.dumps({k: v for k, v in GOOD.items() if k != "text"}), line(like_count="many"), line(text="  "), None]
    got = payloads.read_lines(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string")).orderBy("i").collect()
    assert [r["code"] for r in got] == [None, "blank_line", "not_json", "unknown_field", "missing_field", "wrong_type", "blank_text", "blank_line"]
    assert got[0]["l_text"] == "x y" and got[0]["l_like_count"] == 1 and got[3]["l_text"] is None


def page(spark, platform, body, **more):
    return spark.createDataFrame([(platform, 1, json.dumps(body), *more.values())], "platform string, page_number int, body string" + "".join(f", {k} string" for k in more))


def test_bilibili(spark):
    reply = lambda i, **kw: {"rpid": i, "member": {"mid": 7}, "content": {"message": f"m{i}"}, "ctime": 10, "like": 1, "rcount": 0, **kw}
    body = {"code": 0, "data": {"upper": {"mid": 7}, "cursor": {"all_count": 2, "is_end": True}, "replies": [reply(11, replies=[reply(12, member={"mid": None})]), reply(13, replies=None)]}}
    got = payloads.bilibili_comments(page(spark, "bilibili", body)).collect()
    assert {(r["raw_comment_id"], r["raw_parent_comment_id"], r["pos"], r["sub_pos"], r["is_video_author"]) for r in got} == {("11", None, 0, None, True), ("12", "11", 0, 0, None), ("13", None, 1, None, True)}
    assert payloads.bilibili_comments(page(spark, "bilibili", {**body, "code": 5})).count() == 0


def test_douyin(spark):
    body = {"status_code": 0, "has_more": 0, "cursor": 1, "comments": [{"cid": "1", "user": {"uid": "u", "sec_uid": ""}, "text": "a", "create_time": 1}, {"cid": "2", "user": {}, "text": " "}, {"cid": "3", "user": {"sec_uid": "s"}, "text": "b", "reply_id": "1"}]}
    got = payloads.douyin_comments(page(spark, "douyin", body, video_author="s")).collect()
    assert {(r["raw_comment_id"], r["raw_author_id"], r["raw_parent_comment_id"], r["is_video_author"]) for r in got} == {("1", "u", None, False), ("3", "s", "1", True)}
    video = {"status_code": 0, "aweme_detail": {"aweme_id": "9", "author": {"uid": "u"}, "desc": "d", "duration": 125999, "statistics": {"play_count": 3}}}
    r = payloads.videos(page(spark, "douyin", video)).collect()[0]
    assert (r["duration_seconds"], r["raw_author_id"], r["title"], r["view_count"], r["like_count"]) == (125, "u", "d", 3, None)


def test_candidates(spark):
    b = {"code": 0, "data": {"result": [{"bvid": "BV1", "title": "t", "review": 3}, {"bvid": "BV2", "title": "u"}]}}
    assert {(r["video_key"], r["source_rank"], r["reported_comment_count"]) for r in payloads.candidates(page(spark, "bilibili", b)).collect()} == {("BV1", 1, 3), ("BV2", 2, None)}
    assert payloads.candidates(page(spark, "bilibili", {**b, "x": [{"Replies": []}]})).count() == 0
    d = {"status_code": 0, "data": [{"type": 6, "card_unique_name": "related_word"}, {"aweme_info": {"aweme_id": "1", "desc": "d", "statistics": {"comment_count": 2}, "comment_list": []}}]}
    assert [(r["video_key"], r["source_rank"]) for r in payloads.candidates(page(spark, "douyin", d)).collect()] == [("1", 2)]
    assert payloads.candidates(page(spark, "douyin", {**d, "comment_list": []})).count() == 0


def test_bundles(spark, tmp_path):
    def bundle(vid, lines, total, extra=None, video_id=None):
        p = tmp_path / "raw" / "bilibili" / vid
        p.mkdir(parents=True)
        (p / "video.json").write_text(json.dumps({"platform": "bilibili", "raw_video_id": video_id or vid, "raw_author_id": "a", "title": "t", "description": "d", "captured_at": "2026-01-01T00:00:00Z"}))
        (p / "comments.jsonl").write_text("\n".join(lines) + "\n")
        (p / "collection.json").write_text(json.dumps({"collected_total": total, "pages_requested": 1, "pages_succeeded": 1, "sort_modes": []}))
        if extra:
            (p / extra).write_text("x")

    bundle("good", [line(), line(raw_comment_id="2", raw_parent_comment_id="1")], 2)
    bundle("bad", [line(), line(), ""], 5, "notes.txt", "other")
    got = {(r["raw_video_id"], r["code"]) for r in files.bundle_violations(spark, str(tmp_path / "raw")).collect()}
    assert got == {("bad", c) for c in ("unexpected_files", "identity_mismatch", "blank_line", "duplicate_comment_id", "total_mismatch")}
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"manifest_version": "1", "videos": [{"platform": "bilibili", "video_key": "good"}], "unavailable_platforms": []}))
    assert [r["raw_video_id"] for r in files.unapproved(files.listing(spark, str(tmp_path / "raw")), files.approved(spark, str(plan))).collect()] == ["bad"]


def test_many_directories_of_odd_names(spark, tmp_path, monkeypatch):
    """Names are taken as they are, in whole files and in blocks, and directories are no tasks of their own."""
    odd = ["a b", "a+b%20c", "视频", "[x]{y}*?", "_v", "plain"]
    bodies = [b"\xef\xbb\xbf" + line().encode() + b"\n", line().encode(), b"", b"\n\n" + line().encode() + b"\r\n", b"\xff\xfe\n" + line().encode() + b"\n\n", "\u2028".join(["x", "y"]).encode()]
    for i in range(400):
        name = odd[i] if i < len(odd) else f"v{i}"
        p = tmp_path / "raw" / "bilibili" / name
        p.mkdir(parents=True)
        (p / "video.json").write_text(json.dumps({"platform": "bilibili", "raw_video_id": name}))
        (p / "comments.jsonl").write_bytes(bodies[i] if i < len(bodies) else (line() + "\n").encode())
        (p / "collection.json").write_text(json.dumps({"collected_total": 1}))
        (p / ".hidden").write_text("")
    root = str(tmp_path / "raw")
    rows = lambda: sorted((r["platform"], r["raw_video_id"], r["line_number"], str(r["l_raw_comment_id"]), str(r["code"])) for r in files.comment_lines(spark, root).collect())
    whole = rows()
    assert [(v, n, c) for _, v, n, _, c in whole if v in odd] == sorted([
        ("a b", 1, "None"), ("a+b%20c", 1, "None"), ("[x]{y}*?", 1, "blank_line"), ("[x]{y}*?", 2, "blank_line"), ("[x]{y}*?", 3, "None"), ("_v", 1, "not_json"), ("_v", 2, "None"), ("_v", 3, "blank_line"), ("plain", 1, "not_json")])
    monkeypatch.setattr(files, "WHOLE_BYTES", 300)
    (tmp_path / "raw" / "bilibili" / "a b" / "comments.jsonl").write_bytes(bodies[0] * 3)
    (tmp_path / "raw" / "bilibili" / "[x]{y}*?" / "comments.jsonl").write_bytes(bodies[3] * 3)
    blocks = rows()
    monkeypatch.undo()
    assert blocks == rows() and len(blocks) == len(whole) + 8
    sc = spark.sparkContext
    sc.setJobGroup("bundles", "")
    bad = files.bundle_violations(spark, root).collect()
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("bundles") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) < 400
    assert {(r["raw_video_id"], r["code"]) for r in bad if r["raw_video_id"] not in odd} == set() and ("视频", "total_mismatch") in {(r["raw_video_id"], r["code"]) for r in bad}


def test_lines_of_many_directories(spark, tmp_path):
    for i in range(300):
        (p := tmp_path / "raw" / "douyin" / f"v{i}").mkdir(parents=True)
        (p / "comments.jsonl").write_text(line() + "\n")
    sc = spark.sparkContext
    sc.setJobGroup("lines", "")
    assert len(files.comment_lines(spark, str(tmp_path / "raw")).collect()) == 300
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("lines") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) < 150


def test_folder_lines_keep_no_directories(spark, tmp_path):
    """The query lays out directories in rounds and leaves none behind; a round holds its own directories and bytes only."""
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    c = spark.range(900).select(
        F.col("id").alias("arrival_seq"), F.when(F.col("id") % 3 == 0, "douyin").otherwise("bilibili").alias("platform"), F.concat(F.lit("v"), F.col("id") % 450).alias("raw_video_id"), F.concat(F.lit("c"), F.col("id")).alias("raw_comment_id"),
        F.lit(None).cast("string").alias("raw_author_id"), F.lit(None).cast("string").alias("raw_parent_comment_id"), F.expr("repeat('x', int(1 + id * 7919 % 4000))").alias("text"), stamp.alias("published_at"), stamp.alias("collected_at"),
        F.col("id").alias("like_count"), F.lit(0).cast("bigint").alias("reply_count"), F.lit(False).alias("is_video_author"), F.lit("top").alias("source_stratum"), F.lit(1).cast("bigint").alias("source_page_or_rank"))
    c.repartition(1).write.parquet(str(tmp_path / "raw_comments.parquet"))
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(shared))
    got = {(r["platform"], r["raw_video_id"], r["line_number"], r["raw_comment_id"], len(r["text"]), r["like_count"], r["code"]) for r in inventory.folder_lines(spark, str(tmp_path)).collect()}
    assert got == {(("bilibili", "douyin")[i % 3 == 0], f"v{i % 450}-0", 1 + i // 450, f"c{i}", 1 + i * 7919 % 4000, i, None) for i in range(900)}
    assert set(os.listdir(shared)) == there

    folders = inventory._OwnFolders(str(tmp_path / "own"))
    for n in range(12):  # rounds of changing size, lengths and files
        rows = [{"platform": ("bilibili", "douyin")[i % 2], "folder": f"v{n}-{i}", "video": "v" * (1 + n * i % 7), "comments": f"{n} {i}\n" * (1 + (n * 5 + i) % 9), "collection": None if (n + i) % (2 + n % 5) == 0 else "c" * (n + i)} for i in range(3 + n * 7 % 11)]
        folders.lay_out(rows)
        read = [(r["platform"], r["raw_video_id"], r["line_number"], r["body"].decode()) for b in files.own_lines(folders.root) for r in b.to_pylist()]
        assert sorted(read) == sorted((r["platform"], r["folder"], i, x) for r in rows for i, x in enumerate(r["comments"].splitlines(), 1))
        for r in rows:
            at = tmp_path / "own" / "raw" / r["platform"] / r["folder"]
            assert {p.name: p.read_text() for p in at.iterdir()} == {k: v for k, v in (("video.json", r["video"]), ("comments.jsonl", r["comments"]), ("collection.json", r["collection"])) if v is not None}
    assert sum(p.name == "video.json" for p in (tmp_path / "own").rglob("*")) <= 2 * 13


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g")
    assert g.read() is None
    g.commit(spark.range(3))
    g.commit(spark.range(5))
    assert g.read().count() == 5
    with pytest.raises(FileExistsError):
        g.commit(spark.range(1), create_only=True)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        g.commit(spark.range(9), refuse)
    spark.range(2).write.parquet(f"{tmp_path}/g/vlost")
    assert g.recover() == 1 and g.read().count() == 5


def test_audit(spark, tmp_path):
    append_audit(spark.range(1), f"{tmp_path}/a")
    append_audit(spark.range(1), f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 2
    bad = spark.range(1).select(F.array(F.struct(F.lit(1).alias("Auth_TOKEN"))).alias("x"))
    assert sensitive_keys(bad.schema) == ["Auth_TOKEN"]
    with pytest.raises(ValueError):
        append_audit(bad, f"{tmp_path}/a")


def test_model_step(spark):
    comments = spark.createDataFrame([("c1", "slow app", "a"), ("c2", "nice", "b"), ("c3", "slow", "c")], "comment_id string, text string, author string")
    batches = spark.createDataFrame([("b1", "c1"), ("b1", "c2"), ("b2", "c3")], "batch_id string, comment_id string")
    req = model_step.requests(batches, comments)
    assert all("author" not in r["request"] for r in req.collect())
    out = model_step.invoke(req, model_step.KeywordGateway({"slow": "pain"}, fail_first=True))
    assert sorted((r["batch_id"], r["attempt"], r["status"]) for r in out.collect()) == [("b1", 1, "rate_limited"), ("b1", 2, "ok"), ("b2", 1, "rate_limited"), ("b2", 2, "ok")]
    good, rejected = model_step.trusted_signals(out, batches, "v1")
    assert {r["comment_id"] for r in good.collect()} == {"c1", "c3"} and rejected.count() == 0
    forged = model_step.invoke(req.where("batch_id = 'b2'"), model_step.KeywordGateway({"slow": "pain"}, forge="c1")).unionByName(out.where("batch_id = 'b1'"))
    good, rejected = model_step.trusted_signals(forged, batches, "v1")
    assert {r["comment_id"] for r in good.collect()} == {"c1"} and [(r["batch_id"], r["code"]) for r in rejected.collect()] == [("b2", "comment_not_in_batch")]


def test_budget_and_cache(spark):
    att = spark.createDataFrame([("s", 1, 10, 1, 12, 5), ("s", 2, None, None, 12, 5), ("s", 3, 1, 1, 12, 5)], "scope string, attempt int, input_tokens bigint, output_tokens bigint, reserved_input bigint, reserved_output bigint")
    lim = spark.createDataFrame([("s", 9, 30, 100)], "scope string, max_calls bigint, max_input bigint, max_output bigint")
    assert [r["refused"] for r in model_step.replay_budget(att, lim).orderBy("attempt").collect()] == [None, None, "input_tokens"]
    # A refused attempt charges nothing, so a smaller one fits; usage beyond a reservation or a limit is charged and told.
    att = spark.createDataFrame([("s", i, u, o, r, 5) for i, (u, o, r) in enumerate([(None, None, 12), (12, 5, 12), (12, 5, 12), (5, 5, 5), (2, 5, 1), (None, None, 1)])] + [("t", 1, 1, 9, 12, 5), ("gone", 1, 1, 1, 1, 1)], "scope string, attempt int, input_tokens bigint, output_tokens bigint, reserved_input bigint, reserved_output bigint")
    lim = spark.createDataFrame([("s", 4, 30, 100), ("t", 1, 30, 100)], "scope string, max_calls bigint, max_input bigint, max_output bigint")
    got = [(r["scope"], r["refused"], r["exceeded"]) for r in model_step.replay_budget(att, lim).orderBy("scope", "attempt").collect()]
    assert got == [("s", None, None), ("s", None, None), ("s", "input_tokens", None), ("s", None, None), ("s", None, "input_tokens"), ("s", "model_calls", None), ("t", None, "output_tokens")]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "1", 10), ("b", "2", 5)], "key string, value string, expires_at int")
    assert {r["key"]: (r["event"], r["value"]) for r in model_step.probe_cache(keys, cache, F.lit(5)).collect()} == {"a": ("hit", "1"), "b": ("expired", None), "c": ("miss", None)}
