from __future__ import annotations

import hashlib
import hmac
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadquarry.functions import scalars
from threadquarry.functions.redaction import redact


def col(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_collection_target(spark):
    given = [0, 200, 201, 804, 2000, 2001, 3600, 9999, 10000, None, -1]
    assert col(spark, given, "bigint", scalars.collection_target) == [0, 200, 200, 201, 500, 500, 600, 1000, 1000, 200, None]


def test_comment_scale(spark):
    assert col(spark, [None, 0, 200, 201, 2000, 2001], "bigint", scalars.comment_scale) == [None, "up_to_200", "up_to_200", "201_to_2000", "201_to_2000", "over_2000"]


def test_dynamic_target(spark):
    given = [0, 1, 50, 500, 100_000]
    want = [0 if p <= 0 else min(math.ceil(min(p, math.ceil(32 + 14 * math.log2(p)), 200) * 1.1 * 1.2), p, 200) for p in given]
    assert col(spark, given, "bigint", lambda c: scalars.dynamic_target(c, F.lit(200), F.lit(1.1), F.lit(1.2))) == want


def test_tokens(spark):
    given = ["", "abc", "abcd", "é", "字" * 5, None]
    want = [max(1, math.ceil(len(unicodedata.normalize("NFC", t).encode()) / 3)) if t is not None else None for t in given]
    got = col(spark, given, "string", scalars.text_tokens)
    assert got[:-1] == want[:-1]


def test_pseudonym(spark):
    secret = b"s" * 40
    got = col(spark, ["1", "作者", None], "string", lambda c: scalars.pseudonym("author", c, secret))
    want = ["author_" + hmac.new(secret, b"author\0" + x.encode(), hashlib.sha256).hexdigest()[:32] for x in ("1", "作者")]
    assert got == [*want, None]
    with pytest.raises(ValueError):
        scalars.pseudonym("author", F.lit("1"), b"short")


def test_ids(spark):
    got = col(spark, ["  a   b　c "], "string", lambda c: scalars.signal_id(F.lit("c1"), F.lit("need"), c, "v1"))
    assert got == ["sig_" + hashlib.sha256("\x1f".join(("c1", "need", "a b c", "v1")).encode()).hexdigest()[:24]]
    got = col(spark, ["s"], "string", lambda c: scalars.cluster_id(F.array(F.lit("b"), F.lit("a")), c, "v1"))
    assert got == ["clu_" + hashlib.sha256("\x1e".join(("a\x1fb", "s", "v1")).encode()).hexdigest()[:24]]


def test_pages(spark):
    urls = ["https://x.com/?page=3", "https://x.com/", "https://x.com/?page=1&page=2", "https://x.com/?offset=20&count=10", "https://x.com/?offset=21&count=10", "https://x.com/?page=2&count=3", "https://x.com/?offset=5", None]
    got = col(spark, urls, "string", scalars.page_number)
    assert got == [3, 1, 1, 3, None, None, None, 1]
    assert col(spark, ["https://x.com/a?q=1", "https://x.com/a", "https://x.com/a?page=9&q=1#f", "https://x.com/a#f"], "string", lambda c: scalars.page_url(c, F.lit(2))) == [
        "https://x.com/a?q=1&page=2", "https://x.com/a?page=2", "https://x.com/a?page=2&q=1#f", "https://x.com/a?page=2#f"]
    assert col(spark, ["https://www.bilibili.com/video/x/", "http://www.bilibili.com/x", "https://evilbilibili.com/x", "https://bilibili.com"], "string", lambda c: scalars.known_path(c, ("bilibili.com",))) == ["/video/x", None, None, ""]


def test_coercions(spark):
    assert col(spark, ["1", "-1", "x", "true", None], "string", scalars.optional_count) == [1, None, None, None, None]
    assert col(spark, ["a", "", "a b", None], "string", scalars.optional_identifier) == ["a", None, None, None]
    got = col(spark, ["2026-01-01T00:00:00Z", "2026-01-01T08:00:00+08:00", "2026-01-01T00:00:00", "2026-01-01"], "string", scalars.strict_timestamp)
    assert got[0] == got[1] and got[0] is not None and got[2] is None and got[3] is None


def test_redaction(spark):
    cases = [
        ("write a.b@c.example.com now", "write [EMAIL] now", {"email": 1}), ("call 13800138000.", "call [PHONE].", {"phone": 1}), ("1138001380001", "1138001380001", {}),
        ("id 11010519491231002X ok", "id [IDENTIFIER] ok", {"identity": 1}), ("微信号：abc_12345 谢", "[HANDLE] 谢", {"handle": 1}), ("at @some_one here", "at [HANDLE] here", {"handle": 1}),
        ("地址：某某市某某区，谢谢", "[ADDRESS]，谢谢", {"address": 1}), ("住在中山路 12 号", "[ADDRESS]", {"address": 1, "review": True}), (" a\r\nb ", "a\nb", {}), (None, None, {}), ("", "", {}),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    for r, (_, want, counts) in zip(redact(df, "t").orderBy("i").collect(), cases):
        assert r["redacted"] == want
        assert {k: r[f"n_{k}"] for k in ("email", "phone", "identity", "handle", "address")} == {k: counts.get(k, 0) for k in ("email", "phone", "identity", "handle", "address")}
        assert bool(r["review"]) == counts.get("review", False)
