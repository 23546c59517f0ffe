from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from threadquarry.llm import annotators, mixing, stratified

T0 = datetime(2026, 1, 1)


def label_rows(seed=1):
    """Good annotators keep the truth in four of five labels; two guess."""
    rnd = random.Random(seed)
    truth = {f"c{i}": rnd.choice(["yes", "no", "uncertain"]) for i in range(150)}
    rows, seq = [], 0
    for c, v in truth.items():
        for a in rnd.sample([f"a{i}" for i in range(8)] + ["guess1", "guess2"], 5):
            seq += 1
            own = v if not a.startswith("guess") and rnd.random() < 0.8 else rnd.choice(["yes", "no", "uncertain"])
            rows.append(("v", a, c, own, "unlabeled" if seq % 7 == 0 else own, T0, seq))
    return truth, rows


SCHEMA = "video_id string, annotator_id string, comment_id string, need_signal string, noise_kind string, labelled_at timestamp, label_seq bigint"


def held(spark, rows):
    return annotators.holding_labels(spark.createDataFrame(rows, SCHEMA), ["video_id", "comment_id"], "annotator_id", ["need_signal", "noise_kind"], ["labelled_at", "label_seq"])


def test_holding(spark):
    rows = [("v", "a", "1", "no", "x", T0, 1), ("v", "a", "1", "yes", "unlabeled", T0 + timedelta(1), 2), ("v", "a", "1", "no", "x", None, 3), ("v", "a", "1", "yes", "unlabeled", T0 + timedelta(1), 2), (None, "a", "1", "no", "x", T0, 4), ("v", None, "1", "no", "x", T0, 5), ("v", "b", "1", None, "y", T0, 6)]
    got = sorted((r["annotator"], r["field"], r["value"]) for r in held(spark, rows).collect())
    assert got == [("a", "need_signal", "yes"), ("b", "noise_kind", "y")]
    assert held(spark, []).count() == 0


def test_consensus_and_reliability(spark, monkeypatch):
    truth, rows = label_rows()
    labels = held(spark, rows).cache()
    agreed, rel = annotators.consensus(labels, ["video_id", "comment_id"])
    got = {r["comment_id"]: r["value"] for r in agreed.where("field = 'need_signal'").collect()}
    assert sum(got[c] == v for c, v in truth.items()) > 0.9 * len(truth)
    acc = {r["annotator"]: r["accuracy"] for r in rel.where("field = 'need_signal'").collect()}
    assert max(acc["guess1"], acc["guess2"]) < min(v for a, v in acc.items() if not a.startswith("guess"))
    z = {(r["annotator"], r["field"]): r["z"] for r in rel.collect()}
    assert {k[0] for k, v in z.items() if v <= NormalDist().inv_cdf(1 - annotators.CHANCE_ERROR)} == {"guess1", "guess2"}
    moved, steady = brute_votes(labels.where("field = 'need_signal'").collect())
    assert moved < annotators.TOLERANCE and all(abs(steady[a] - acc[a]) < 1e-9 for a in acc)
    # Hot items in rows, and everything by joins, give the same.
    whole = lambda: [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in annotators.consensus(labels, ["video_id", "comment_id"])]
    held_in_rows = whole()
    monkeypatch.setattr(annotators, "HOT_LABELS", 6)
    assert whole() == held_in_rows
    monkeypatch.setattr(annotators, "BROADCAST_BYTES", 0)
    assert whole() == held_in_rows
    monkeypatch.undo()
    empty = annotators.consensus(labels.limit(0), ["video_id", "comment_id"])
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_one_label_for_everything_is_no_better_than_chance(spark):
    _, rows = label_rows(7)
    rows += [("v", "same", f"c{i}", "no", "unlabeled", T0, 10_000 + i) for i in range(120)] + [("v", "alone", "c999", "no", "unlabeled", T0, 20_000)]
    rel = {r["annotator"]: r["z"] for r in annotators.consensus(held(spark, rows).where("field = 'need_signal'"), ["video_id", "comment_id"])[1].collect()}
    assert rel["same"] == 0.0 and rel["alone"] is None and rel["a1"] > 4


def brute_votes(rows):
    """The voting over dictionaries: (largest last move, accuracies)."""
    said = [((r["video_id"], r["comment_id"]), r["annotator"], r["value"]) for r in rows]
    acc = {a: annotators.PRIOR for _, a, _ in said}
    weight = dict.fromkeys(acc, 1.0)
    while True:
        hits, seen = dict.fromkeys(acc, 0.0), dict.fromkeys(acc, 0)
        for i, a, v in said:
            votes = {}
            for j, b, w in said:
                if i == j and a != b:
                    votes[w] = votes.get(w, 0.0) + weight[b]
            if votes:
                lead = votes.get(v, 0.0) - max([x for w, x in votes.items() if w != v], default=0.0)
                hits[a] += min(1.0, max(0.0, 0.5 + lead / (2 * annotators.MARGIN)))
                seen[a] += 1
        new = {a: (hits[a] + annotators.SMOOTHING * annotators.PRIOR) / (seen[a] + annotators.SMOOTHING) for a in acc}
        moved = max(abs(new[a] - acc[a]) for a in acc)
        acc = new
        weight = {a: min(annotators.MOST_WEIGHT, max(annotators.LEAST_WEIGHT, float(np.log(x / (1 - x))))) for a, x in acc.items()}
        if moved < annotators.TOLERANCE:
            return moved, acc


def test_agreement_against_pairs(spark):
    _, rows = label_rows(3)
    lab = [(a, c, v) for _, a, c, v, _, _, _ in rows]
    got = {r["annotator"]: r for r in annotators.agreement(held(spark, rows).where("field = 'need_signal'"), ["video_id", "comment_id"]).collect()}
    for a in {x[0] for x in lab}:
        pairs = [(v, w) for x, c, v in lab if x == a for y, d, w in lab if d == c and y != a]
        po = sum(v == w for v, w in pairs) / len(pairs)
        pe = sum(sum(v == k for v, _ in pairs) * sum(w == k for _, w in pairs) for k in ("yes", "no", "uncertain")) / len(pairs) ** 2
        assert got[a]["pairs"] == len(pairs) and abs(got[a]["observed"] - po) < 1e-12 and abs(got[a]["expected"] - pe) < 1e-12


def test_alpha(spark):
    rows = [("v", a, c, v, v, T0, i) for i, (a, c, v) in enumerate([("a", "1", "x"), ("b", "1", "x"), ("a", "2", "y"), ("b", "2", "y"), ("a", "3", "x")])]
    r = annotators.field_agreement(held(spark, rows), ["video_id", "comment_id"]).where("field = 'need_signal'").collect()[0]
    assert r["alpha"] == 1.0 and r["labels"] == 4


def test_rake():
    counts = np.array([100.0, 50.0, 10.0, 40.0])
    a = np.array([[1.0, 1, 0, 0], [0, 0, 1, 1]])
    b = np.array([[1.0, 0, 1, 0], [0, 1, 0, 1]])
    w = stratified.rake(counts, [(a, np.array([0.3, 0.7])), (b, np.array([0.5, 0.5]))])
    mass = counts * w / (counts * w).sum()
    assert np.allclose(a @ mass, [0.3, 0.7], atol=1e-3) and np.allclose(b @ mass, [0.5, 0.5], atol=1e-3)


def test_settle_meets_needs():
    rnd = random.Random(3)
    names = ["top", "recent", "replies", "long_tail"]
    for _ in range(300):
        strata = [set(x) for x in {tuple(sorted(rnd.sample(names, rnd.choice([0, 1, 1, 1, 2, 4])))) for _ in range(8)}]
        buckets = [[(b, rnd.randrange(1, 5)) for b in sorted(rnd.sample(range(40), rnd.randrange(1, 9)))] for _ in strata]
        size = [sum(n for _, n in x) for x in buckets]
        target = rnd.randrange(0, 60)
        shares = dict(zip(names, (0.4, 0.3, 0.2, 0.1)))
        minimum = {s: rnd.choice([0, 0, 3, 9]) for s in names}
        k = stratified.settle(strata, buckets, target, shares, minimum)
        assert sum(k) == min(target, sum(size)) and all(0 <= x <= n for x, n in zip(k, size))
        for s in names:  # a minimum is missed only where all of its records are in, or none outside it can go
            have = {x: sum(n for n, y in zip(k, strata) if x in y) for x in names}
            if have[s] < min(minimum[s], target):
                free = [i for i, x in enumerate(strata) if s in x and k[i] < size[i]]
                gives = [i for i, x in enumerate(strata) if k[i] and s not in x and all(have[y] > minimum[y] for y in x)]
                assert not free or not gives


def test_least_keys_win():
    # Without needs the least keys win, and of the last bucket cells give in proportion.
    assert stratified.settle([{"a"}, {"b"}], [[(1, 3), (5, 10)], [(2, 1), (5, 20)]], 10, {"a": 0.0, "b": 0.0}, {}) == [5, 5]


def test_sample(spark):
    rnd = random.Random(5)
    strata = ["top", "recent", "replies", "long_tail"]
    rows = [("b", "v", f"c{i}", rnd.choices(strata, [70, 20, 8, 2])[0], rnd.choice(["x", "y"])) for i in range(1500)] + [("b", "v", f"c{i}", "replies", "x") for i in range(0, 40, 4)] + [("b", "v", None, "top", "x"), ("b", "v", "c1", None, None)]
    records = spark.createDataFrame(rows, "platform string, raw_video_id string, rid string, stratum string, side string")
    targets = [("r1", "b", "v", 100, s, p, m) for s, p, m in (("Top", 0.25, 0), ("recent ", 0.25, 0), ("replies", 0.25, 5), ("long-tail", 0.25, 30))] + [("r2", "b", "gone", 10, "top", 1.0, 2), (None, "b", "v", 5, "top", 1.0, 0)]
    req = stratified.requests_of(spark.createDataFrame(targets, "request_id string, platform string, raw_video_id string, target_count bigint, source_stratum string, target_share double, min_count bigint"), ["platform", "raw_video_id"])
    chosen, report = stratified.stratified_sample(records, req, ["platform", "raw_video_id"], "rid", "side")
    got = chosen.collect()
    assert len(got) == 100 and len({r["record"] for r in got}) == 100
    rep = {(r["request_id"], r["source_stratum"]): r for r in report.collect()}
    for s in ("top", "recent", "replies"):
        assert abs(rep["r1", s]["chosen"] - 25) <= 8
    lt = len({r[2] for r in rows if r[3] == "long_tail"})
    assert rep["r1", "long_tail"]["chosen"] == min(30, lt) and rep["r1", "long_tail"]["needed"] == 30.0
    assert rep["r2", "top"]["chosen"] == 0 and rep["r2", "top"]["available"] == 0
    again, _ = stratified.stratified_sample(records.repartition(7), req, ["platform", "raw_video_id"], "rid", "side")
    assert {r["record"] for r in again.collect()} == {r["record"] for r in got}
    assert stratified.stratified_sample(records.limit(0), req, ["platform", "raw_video_id"], "rid", "side")[0].count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        p, s = rng.random(n), rng.integers(1, 500, n).astype(float)
        q = mixing.flight(p, s, rng)
        assert abs((p * s).sum() - (q * s).sum()) < 1e-6 * max(1.0, s.sum()) and abs(p.sum() - q.sum()) < 1e-6 * max(1, n)
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        r = mixing.land(q, s)
        assert set(np.round(r, 9)) <= {0.0, 1.0}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_UNITS", 60)
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["big", "Big ", "BIG"]), rnd.randrange(1, 300)) for i in range(700)] + [(1000 + i, "small-one", rnd.randrange(1, 300)) for i in range(40)] + [(2000, None, 5), (2001, "big", 0), (2002, "big", None), (2003, "other", 9)]
    targets = [(1, "big", 0.5, 3), (1, "small_one", 0.5, 4), (2, "big", 0.99, 1), (2, "small one", 0.01, 9), (2, "missing", 0.0, 1), (None, "big", 1.0, 1)]
    chosen, report = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(targets, "mix_id bigint, source string, target_share double, max_repeats bigint"))
    total = sum(d[2] or 0 for d in docs)
    rep = {(r["mix_id"], r["source"]): r for r in report.collect()}
    small = sum(d[2] for d in docs if d[1] == "small-one")
    assert rep[1, "small_one"]["short"] and small * 4 < 0.5 * total and rep[1, "small_one"]["actual_tokens"] == small * 4
    # What the short source has sets the size of the mix, so that the other keeps its share of it.
    assert abs(rep[1, "big"]["actual_tokens"] - small * 4) <= 600 and abs(rep[1, "big"]["share_error"]) < 0.01 and rep[1, "big"]["exact_tokens"] == small * 8
    assert rep[2, "big"]["actual_tokens"] == sum(d[2] or 0 for d in docs if d[1] and d[1].strip().lower() == "big") and abs(rep[2, "small_one"]["actual_tokens"] - 0.01 * total) <= 600
    assert rep[2, "missing"]["actual_tokens"] == 0
    most = {(1, "big"): 3, (1, "small_one"): 4, (2, "big"): 1, (2, "small_one"): 9}
    rows = chosen.collect()
    assert all(0 < r["repeats"] <= most[r["mix_id"], r["source"]] for r in rows) and len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows)
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(targets, "mix_id bigint, source string, target_share double, max_repeats bigint"))[0].count() == 0
    assert F.lit(1) is not None
