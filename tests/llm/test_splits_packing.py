from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadquarry.llm import packing, splits


def test_components(spark):
    rnd = random.Random(3)
    ids = [f"v{i:03d}" for i in range(120)] + [None]
    edges = [(rnd.choice(ids), rnd.choice([*ids, "nowhere"])) for _ in range(90)] + [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(60, 100)] + [("v001", "v001")]
    got = {r["id"]: r["component"] for r in splits.components(spark.createDataFrame([(i,) for i in ids] * 2, "x string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {i: i for i in ids if i}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}
    assert splits.components(spark.createDataFrame([], "x string"), spark.createDataFrame([], "a string, b string")).count() == 0


def test_star_edges(spark):
    df = spark.createDataFrame([("p", "a", "3", 1), ("p", "a", "1", 2), ("p", "a", "1", 3), ("p", "b", "9", 4), ("p", "a", "2", 5)], "p string, k string, v string, a int")
    assert {(r["a"], r["b"]) for r in splits.star_edges(df, ["p", "k"], "v").collect()} == {("3", "1"), ("2", "1")}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 6))
def test_difference_keeps_weight(weights, k):
    w = np.zeros((len(weights), k))
    w[:, 0] = weights
    sums, where = splits.difference(w)
    assert abs(sums.sum() - sum(weights)) < 1e-9
    if weights:
        back = np.zeros(k)
        for i, x in enumerate(weights):
            back[where[i, 0]] += x
        assert np.allclose(back, sums)
        assert sums.max() <= max(weights) + sum(weights) / k + 1e-9


def test_balanced_splits(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", float(rnd.randrange(1, 30))) for i in range(3000)] + [("hot", 9000.0), ("none", None), ("less", -4.0)]
    df = spark.createDataFrame(rows, "component string, weight double")
    for shard in (20_000, 8):  # one shard, and shards merged over two levels
        got = splits.balanced_splits(df, shard=shard).collect()
        assert len(got) == len(rows) and all(r["split"] in splits.PROPORTIONS for r in got)
        total = sum(r["weight"] for r in got)
        for s, p in splits.PROPORTIONS.items():
            assert abs(sum(r["weight"] for r in got if r["split"] == s) / total - p) < 0.02
    assert splits.balanced_splits(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_packers(sizes):
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    low = packing.bound(packing.dff_sums(np.array(sizes), 50)) if sizes else 0
    first = packing.best_fit(down, sizes, 50)
    for bins in (first, packing.least_slack(down, sizes, 50), packing.pack(sizes, 50)[0] if sizes else []):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(b and sum(sizes[i] for i in b) <= 50 for b in bins) and low <= len(bins)
    assert not sizes or len(packing.pack(sizes, 50)[0]) <= len(first)


def test_exchange_saves_bins():
    rnd = random.Random(4)
    first = last = low = 0
    for _ in range(60):
        sizes = [rnd.randrange(100, 700) for _ in range(rnd.randrange(20, 90))]
        first += len(packing.pack(sizes, 1000, 0)[0])
        bins, sums = packing.pack(sizes, 1000)
        last, low = last + len(bins), low + packing.bound(sums)
    assert low <= last < first and last - low < 0.6 * (first - low)


def exact_bins(sizes, cap):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bound_is_a_bound():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))), reverse=True)
        assert packing.bound(packing.dff_sums(np.array(sizes), 20)) <= exact_bins(sizes, 20)


def test_pack_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    rnd = random.Random(8)
    rows = [("big", f"i{i}", rnd.randrange(5, 60), 100) for i in range(300)] + [("cut", "x", 250, 100), ("cut", "y", 100, 100), ("cut", "z", 40, 100), ("cut", "w", 200, 100), ("none", "n", None, 100), (None, "n", 5, 100), ("zero", "n", 5, 0)]
    pieces, groups = packing.pack_items(spark.createDataFrame(rows, "grp string, item string, size bigint, capacity bigint"))
    got = pieces.collect()
    fill, whole = {}, {}
    for r in got:
        fill[r["grp"], r["bin"]] = fill.get((r["grp"], r["bin"]), 0) + r["size"]
        whole.setdefault((r["grp"], r["item"]), []).append(r["size"])
    assert all(v <= 100 for v in fill.values())
    assert all(fill[r["grp"], r["bin"]] == r["fill"] for r in got)
    assert {k: sum(v) for k, v in whole.items()} == {(g, i): s for g, i, s, c in rows if g and s and c > 0}
    assert sorted(whole["cut", "x"]) == [50, 100, 100] and whole["cut", "y"] == [100] and whole["cut", "w"] == [100, 100] and len(whole["big", "i0"]) == 1
    g = {r["grp"]: (r["bins"], r["lower_bound"]) for r in groups.collect()}
    assert g["cut"] == (6, 6) and g["big"][1] <= g["big"][0] <= g["big"][1] * 1.1 + 2
    assert packing.pack_items(spark.createDataFrame([], "grp string, item string, size bigint, capacity bigint"))[0].count() == 0
