from __future__ import annotations

import random

import pytest

from threadquarry.operators.hierarchy import descendant_pairs, resolve, with_descendant_counts

SCHEMA = "platform string, video string, cid string, parent string, status string, depth int"


def brute(rows):
    parents = {}
    for p, v, c, par, *_ in rows:
        if c is None:
            continue
        k = (p, v, c)
        parents[k] = parents.get(k) or (par or None)
    out = {}
    for k in parents:
        path, at = [k], k
        while True:
            par = parents[at]
            if par is None:
                status = "rooted"
                break
            nxt = (at[0], at[1], par)
            if nxt not in parents:
                status = "lost_root"
                break
            if nxt in path:
                status = "in_cycle" if nxt == k else "below_cycle"
                break
            path.append(nxt)
            at = nxt
        ids = tuple(x[2] for x in reversed(path))
        out[k] = (status, ids[0] if status == "rooted" else None, len(ids) - 1 if "cycle" not in status else None, ids if "cycle" not in status else None)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = resolve(df.repartition(3), ["platform", "video"], "cid", "parent").collect()
    assert len(got) == len({(r["platform"], r["video"], r["cid"]) for r in got})
    return {(r["platform"], r["video"], r["cid"]): (r["status"], r["root"], r["depth"], tuple(r["path"]) if r["path"] is not None else None) for r in got}


def random_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for v in ("v1", "v2", None):
        ids = [f"c{i}" for i in range(25)]
        for i in ids:
            par = rnd.choice([None, "", "gone", *ids])
            rows += [("b", v, i, par, "x", 1)] + ([("b", v, i, None, "y", 2)] if rnd.random() < 0.3 else [])
    # Deep chains: one from a root, one from a lost parent, one into a ring of three, and a node that is its own parent.
    rows += [("b", "deep", "n0", None, None, None)] + [("b", "deep", f"n{i}", f"n{i - 1}", None, None) for i in range(1, 70)]
    rows += [("b", "lost", "n0", "gone", None, None)] + [("b", "lost", f"n{i}", f"n{i - 1}", None, None) for i in range(1, 40)]
    rows += [("b", "ring", f"r{i}", f"r{(i + 1) % 3}", None, None) for i in range(3)] + [("b", "ring", "t0", "r0", None, None)] + [("b", "ring", f"t{i}", f"t{i - 1}", None, None) for i in range(1, 9)]
    rows += [("b", "ring", "self", "self", None, None), ("b", "ring", None, "r0", None, None), (None, "v", "c", None, None, None), (None, "v", "d", "c", None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walking(spark, seed):
    rows = random_rows(seed)
    assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == {}
    assert run(spark, [("b", "v", "a", None, None, None)] * 3) == {("b", "v", "a"): ("rooted", "a", 0, ("a",))}
    assert run(spark, [("b", "v", "a", "b", None, None), ("b", "v", "b", "a", None, None)]) == {("b", "v", x): ("in_cycle", None, None, None) for x in "ab"}


def test_descendants(spark):
    rows = [("b", "v", "a", None, None, None), ("b", "v", "b", "a", None, None), ("b", "v", "c", "b", None, None), ("b", "v", "d", "a", None, None), ("b", "v", "x", "x", None, None)]
    placed = resolve(spark.createDataFrame(rows, SCHEMA), ["platform", "video"], "cid", "parent")
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendant_pairs(placed, ["platform", "video"], "cid").collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    counts = {r["cid"]: r["descendants"] for r in with_descendant_counts(placed, ["platform", "video"], "cid").collect()}
    assert counts == {"a": 3, "b": 1, "c": 0, "d": 0, "x": 0}
