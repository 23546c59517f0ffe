"""Queries that run the sources, checks, sinks, model step and streams over the driver's tables, each with its SQL beside it.

Captured pages, directories, plans and attempts are built from the tables first; the SQL says from the same tables what must
come out.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadquarry.functions import scalars
from threadquarry.operators import analysis, cache, checks, consensus, labels, merging, model_step, profiling, ranking, verification
from threadquarry.plans.reference_sql import _LABELS, _QUALITY
from threadquarry.runtime import Scratch, table
from threadquarry.sources import files, payloads, sinks
from threadquarry.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as ``ref_<name>``, with its SQL."""

    def register(f):
        QUERIES[f"ref_{f.__name__}"] = f
        if sql:
            SQL[f"ref_{f.__name__}"] = sql
        return f

    return register


_BLANK = r"(text IS NULL OR NOT regexp_matches(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{0b}]'))"
_SECONDS = "epoch_us(date_trunc('second', published_at))"
SHAPE = "'response_shape_changed'"

# ---------------------------------------------------------------- captured pages

#: Comments on a captured page.
PAGE = 40


def _page_rows(s: SparkSession, d: str, platform: str) -> DataFrame:
    c = table(s, d, "raw_comments").where((F.col("platform") == platform) & F.col("raw_video_id").isNotNull() & F.col("raw_comment_id").isNotNull())
    own = table(s, d, "raw_videos").where(F.col("platform") == platform).groupBy("raw_video_id").agg(F.max("raw_author_id").alias("video_author"))
    return c.withColumn("block", F.floor(F.col("arrival_seq") / PAGE)).withColumn("at", F.unix_seconds("published_at")).join(own, "raw_video_id", "left")


def _bilibili_pages(s: SparkSession, d: str) -> DataFrame:
    one = F.struct(
        "arrival_seq", F.col("raw_comment_id").alias("rpid"), F.struct(F.col("raw_author_id").alias("mid")).alias("member"), F.struct(F.col("text").alias("message")).alias("content"),
        F.col("at").alias("ctime"), F.col("like_count").alias("like"), F.col("reply_count").alias("rcount"))
    p = _page_rows(s, d, "bilibili").groupBy("platform", "raw_video_id", "block").agg(F.array_sort(F.collect_list(one)).alias("replies"), F.max("video_author").alias("mid"))
    cursor = F.struct(F.size("replies").alias("all_count"), (F.col("block") % 2 == 0).alias("is_end"), F.when(F.col("block") % 3 != 0, (F.col("block") + 1).cast("string")).alias("next"))
    return p.select("platform", "raw_video_id", "block", F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.struct("mid").alias("upper"), cursor.alias("cursor"), "replies").alias("data"))).alias("body"))


def _douyin_pages(s: SparkSession, d: str) -> DataFrame:
    one = F.struct(
        "arrival_seq", F.col("raw_comment_id").alias("cid"), F.struct(F.col("raw_author_id").alias("uid")).alias("user"), "text", F.col("raw_parent_comment_id").alias("reply_id"),
        F.col("at").alias("create_time"), F.col("like_count").alias("digg_count"), F.col("reply_count").alias("reply_comment_total"))
    p = _page_rows(s, d, "douyin").groupBy("platform", "raw_video_id", "block").agg(F.array_sort(F.collect_list(one)).alias("comments"), F.max("video_author").alias("video_author"))
    body = F.struct(F.lit(0).alias("status_code"), "comments", (F.col("block") % 2).alias("has_more"), F.when(F.col("block") % 3 != 0, F.col("block").cast("string")).alias("cursor"))
    return p.select("platform", "raw_video_id", "block", "video_author", F.to_json(body).alias("body"))


def _pages_sql(platform: str, bad: str) -> str:
    return f"""WITH c AS (SELECT *, arrival_seq // {PAGE} AS block FROM raw_comments WHERE platform = '{platform}' AND raw_video_id IS NOT NULL AND raw_comment_id IS NOT NULL),
own AS (SELECT raw_video_id, max(raw_author_id) AS owner FROM raw_videos WHERE platform = '{platform}' GROUP BY 1),
pg AS (SELECT raw_video_id, block, count(*) AS n, bool_or({bad}) OR (block % 2 = 1 AND block % 3 = 0) AS torn FROM c GROUP BY 1, 2),
r AS (SELECT c.*, pg.torn, own.owner, row_number() OVER (PARTITION BY c.raw_video_id, c.block ORDER BY arrival_seq) - 1 AS pos FROM c JOIN pg USING (raw_video_id, block) LEFT JOIN own USING (raw_video_id))
"""


_COUNTS = "CASE WHEN like_count >= 0 THEN like_count END AS like_count, CASE WHEN reply_count >= 0 THEN reply_count END AS reply_count"


@query(_pages_sql("bilibili", _BLANK) + f"""SELECT raw_video_id, block, owner, n AS total, CASE WHEN NOT torn THEN block % 2 = 1 END AS has_more, CASE WHEN NOT torn AND block % 3 <> 0 THEN (block + 1)::VARCHAR END AS next_cursor,
  CASE WHEN torn THEN {SHAPE} END AS code, CASE WHEN owner IS NULL THEN {SHAPE} END AS context FROM pg LEFT JOIN own USING (raw_video_id)""")
def bilibili_pages(s, d):
    p = payloads.bilibili_pages(_bilibili_pages(s, d))
    return p.select("raw_video_id", "block", "owner", "total", "has_more", "next_cursor", "code", payloads.context_code(p).alias("context"))


@query(_pages_sql("bilibili", _BLANK) + f"SELECT raw_video_id, block, pos, raw_comment_id, raw_author_id, text, {_SECONDS} AS published_us, {_COUNTS}, raw_author_id = owner AS is_video_author FROM r WHERE NOT torn")
def bilibili_comments(s, d):
    c = payloads.bilibili_comments(_bilibili_pages(s, d))
    return c.select("raw_video_id", "block", F.col("pos").cast("bigint").alias("pos"), "raw_comment_id", "raw_author_id", "text", F.unix_micros("published_at").alias("published_us"), "like_count", "reply_count", "is_video_author")


@query(_pages_sql("douyin", "text IS NULL") + f"SELECT raw_video_id, block, CASE WHEN NOT torn THEN block % 2 = 1 END AS has_more, CASE WHEN NOT torn AND block % 3 <> 0 THEN block::VARCHAR END AS next_cursor, CASE WHEN torn THEN {SHAPE} END AS code FROM pg")
def douyin_pages(s, d):
    return payloads.douyin_pages(_douyin_pages(s, d)).select("raw_video_id", "block", "has_more", "next_cursor", "code")


@query(_pages_sql("douyin", "text IS NULL") + f"SELECT raw_video_id, block, pos, raw_comment_id, raw_author_id, raw_parent_comment_id, text, {_SECONDS} AS published_us, {_COUNTS}, raw_author_id = owner AS is_video_author FROM r WHERE NOT torn AND NOT {_BLANK}")
def douyin_comments(s, d):
    c = payloads.douyin_comments(_douyin_pages(s, d))
    return c.select("raw_video_id", "block", F.col("pos").cast("bigint").alias("pos"), "raw_comment_id", "raw_author_id", "raw_parent_comment_id", "text", F.unix_micros("published_at").alias("published_us"), "like_count", "reply_count", "is_video_author")


def _video_pages(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "raw_videos").where("platform is not null").withColumn("at", F.unix_seconds("published_at")).withColumn("fails", F.when(F.col("capture_seq") % 9 == 0, -404).otherwise(0))
    stat = F.struct(F.col("total_comment_count").alias("reply"), F.col("view_count").alias("view"), F.col("like_count").alias("like"), F.col("favorite_count").alias("favorite"), F.col("share_count").alias("share"))
    b = F.struct(F.col("fails").alias("code"), F.struct(F.col("raw_video_id").alias("bvid"), F.struct(F.col("raw_author_id").alias("mid")).alias("owner"), "title", F.col("description").alias("desc"), F.col("at").alias("pubdate"), F.col("duration_seconds").alias("duration"), stat.alias("stat")).alias("data"))
    counts = F.struct(F.col("total_comment_count").alias("comment_count"), F.col("view_count").alias("play_count"), F.col("like_count").alias("digg_count"), F.col("favorite_count").alias("collect_count"), "share_count")
    author = F.struct(F.col("raw_author_id").alias("uid"), F.col("author_follower_count").alias("follower_count"))
    y = F.struct(F.col("fails").alias("status_code"), F.struct(F.col("raw_video_id").alias("aweme_id"), author.alias("author"), F.col("title").alias("desc"), F.col("at").alias("create_time"), (F.col("duration_seconds") * 1000 + F.col("capture_seq") % 1000).alias("duration"), counts.alias("statistics")).alias("aweme_detail"))
    return v.select("platform", "capture_seq", F.when(F.col("platform") == "bilibili", F.to_json(b)).otherwise(F.to_json(y)).alias("body"))


_VIDEOS = f"""v AS (SELECT *, capture_seq % 9 <> 0 AND raw_video_id IS NOT NULL AND raw_author_id IS NOT NULL AND NOT {_BLANK.replace('text', 'title')} AS ok, platform = 'bilibili' AS b FROM raw_videos WHERE platform IS NOT NULL)"""
_V_FIELDS = ["raw_video_id", "raw_author_id", "title", "duration_seconds", "total_comment_count", "view_count", "like_count", "favorite_count", "share_count"]


@query(f"""WITH {_VIDEOS} SELECT platform, capture_seq, {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in _V_FIELDS)}, CASE WHEN ok THEN CASE WHEN b THEN description ELSE title END END AS description,
  CASE WHEN ok THEN {_SECONDS} END AS published_us, CASE WHEN ok AND NOT b THEN author_follower_count END AS author_follower_count, CASE WHEN NOT ok THEN {SHAPE} END AS code FROM v""")
def video_pages(s, d):
    p = payloads.video_pages(_video_pages(s, d))
    return p.select("platform", "capture_seq", *_V_FIELDS, "description", F.unix_micros("published_at").alias("published_us"), "author_follower_count", "code")


@query(f"WITH {_VIDEOS} SELECT platform, raw_video_id, max(total_comment_count) AS total_comment_count FROM v WHERE ok AND total_comment_count IS NOT NULL GROUP BY 1, 2")
def page_counts(s, d):
    return payloads.reported_counts(_video_pages(s, d))


#: Candidates on a search page.
SEARCH = 20


def _search_pages(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "raw_videos").where("platform is not null").withColumn("page_number", F.floor(F.col("capture_seq") / SEARCH)).withColumn("said", F.when(F.col("capture_seq") % 13 != 0, F.col("title")))
    b = F.struct("capture_seq", F.col("raw_video_id").alias("bvid"), F.col("said").alias("title"), F.col("total_comment_count").alias("review"))
    y = F.struct("capture_seq", F.struct(F.col("raw_video_id").alias("aweme_id"), F.col("said").alias("desc"), F.struct(F.col("total_comment_count").alias("comment_count")).alias("statistics")).alias("aweme_info"))
    p = v.groupBy("platform", "page_number").agg(F.array_sort(F.collect_list(b)).alias("b"), F.array_sort(F.collect_list(y)).alias("y"))
    body = F.when(F.col("platform") == "bilibili", F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.col("b").alias("result")).alias("data")))).otherwise(F.to_json(F.struct(F.lit(0).alias("status_code"), F.col("y").alias("data"))))
    # Every seventh page holds comments, which a search page must not.
    return p.select("platform", "page_number", F.when(F.col("page_number") % 7 == 3, F.concat(F.lit('{"Replies": [], '), F.substring(body, 2, 1 << 30))).otherwise(body).alias("body"))


@query(f"""WITH v AS (SELECT *, capture_seq // {SEARCH} AS page_number, row_number() OVER (PARTITION BY platform, capture_seq // {SEARCH} ORDER BY capture_seq) AS source_rank FROM raw_videos WHERE platform IS NOT NULL)
SELECT platform, page_number, source_rank, raw_video_id AS video_key, title, total_comment_count AS reported_comment_count FROM v
WHERE page_number % 7 <> 3 AND capture_seq % 13 <> 0 AND title IS NOT NULL AND raw_video_id IS NOT NULL""")
def candidates(s, d):
    return payloads.candidates(_search_pages(s, d)).select("platform", "page_number", F.col("source_rank").cast("bigint").alias("source_rank"), "video_key", "title", "reported_comment_count")


@query(f"""WITH v AS (SELECT *, capture_seq // {SEARCH} AS page_number, row_number() OVER (PARTITION BY capture_seq // {SEARCH} ORDER BY capture_seq) AS source_rank FROM raw_videos WHERE platform = 'bilibili')
SELECT platform, page_number, source_rank, raw_video_id AS video_key, title FROM v WHERE capture_seq % 6 <> 0 AND capture_seq % 7 <> 0 AND regexp_full_match(raw_video_id, 'BV[0-9A-Za-z]{{10}}') AND NOT {_BLANK.replace('text', 'title')}
QUALIFY row_number() OVER (PARTITION BY page_number, raw_video_id ORDER BY source_rank) = 1""")
def card_candidates(s, d):
    """Rendered search pages; every sixth card has two titles and every seventh names no video."""
    v = table(s, d, "raw_videos").where("platform = 'bilibili'").withColumn("page_number", F.floor(F.col("capture_seq") / SEARCH))
    title = F.coalesce("title", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        title = F.replace(title, F.lit(a), F.lit(b))
    k = F.col("capture_seq")
    card = F.concat(F.lit('<article><a href="https://www.bilibili.com'), F.when(k % 7 != 0, F.concat(F.lit("/video/"), "raw_video_id")).otherwise("/read/x"), F.lit('" title="'), title, F.lit('">go</a>'), F.when(k % 6 == 0, '<img title="another">').otherwise(""), F.lit("</article>"))
    p = v.withColumn("card", card).groupBy("platform", "page_number").agg(F.array_sort(F.collect_list(F.struct("capture_seq", "card"))).alias("x"))
    p = p.select("platform", "page_number", F.concat(F.lit("<html><body>"), F.array_join(F.transform("x", lambda x: F.coalesce(x["card"], F.lit("<article></article>"))), "\n"), F.lit("</body></html>")).alias("html"))
    return payloads.card_candidates(p).select("platform", "page_number", F.col("source_rank").cast("bigint").alias("source_rank"), "video_key", "title")


@query("SELECT line_id, line_id % 3 = 0 AND json_valid(body) AS refused FROM comment_lines WHERE body IS NOT NULL")
def forbidden_keys(s, d):
    """Lines wrapped into pages; every third hides a list of comments deep inside."""
    c = table(s, d, "comment_lines").where("body is not null")
    body = F.when(F.col("line_id") % 3 == 0, F.concat(F.lit('{"data": [{"x": {"Comment_List": ['), "body", F.lit("]}}]}"))).otherwise(F.concat(F.lit('{"data": ['), "body", F.lit("]}")))
    return c.select("line_id", payloads.holds_forbidden_keys(body, F.lit(False)).alias("refused"))


# ---------------------------------------------------------------- addresses of pages


def _urls(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "raw_videos").where("platform is not null and title is not null").select("capture_seq", "platform", "title", F.pmod("capture_seq", F.lit(5)).alias("k"))
    q = F.url_encode("title")
    other = F.element_at(F.array(F.lit("https://www.bilibili.com/v/popular/all"), F.lit("https://www.douyin.com/search/"), F.lit("https://search.bilibili.com/live?keyword=x"), F.lit("http://example.com/all"), F.lit("https://www.douyin.com/search/x")), (F.col("capture_seq") % 5 + 1).cast("int"))
    own = scalars.search_url(F.col("platform"), F.col("title"), F.col("k") + 1)
    answer = F.when(F.col("platform") == "bilibili", F.concat(F.lit("https://api.bilibili.com/x?keyword="), q, F.lit("&page="), F.col("k").cast("string"))).otherwise(
        F.concat(F.lit("https://www.douyin.com/aweme/v1/web/general/search/single/?keyword="), q, F.lit("&offset="), (F.col("k") * 10).cast("string"), F.lit("&count="), F.when(F.col("capture_seq") % 4 == 0, 7).otherwise(10).cast("string")))
    return v.withColumn("own", own).withColumn("other", other).withColumn("answer", answer)


@query("""SELECT capture_seq, true AS own, CASE platform WHEN 'bilibili' THEN capture_seq % 5 = 0 ELSE capture_seq % 5 = 4 END AS other FROM raw_videos WHERE platform IS NOT NULL AND title IS NOT NULL""")
def candidate_pages(s, d):
    u = _urls(s, d)
    return u.select("capture_seq", scalars.is_candidate_page(F.col("platform"), F.col("own")).alias("own"), scalars.is_candidate_page(F.col("platform"), F.col("other")).alias("other"))


@query("""WITH u AS (SELECT capture_seq, platform, capture_seq % 5 AS k, CASE WHEN capture_seq % 4 = 0 THEN 7 ELSE 10 END AS n FROM raw_videos WHERE platform IS NOT NULL AND title IS NOT NULL),
b AS (SELECT *, CASE WHEN platform <> 'bilibili' AND k * 10 >= n AND k * 10 % n = 0 THEN k * 10 // n END AS batch FROM u)
SELECT capture_seq, batch, CASE WHEN platform = 'bilibili' THEN k = 2 ELSE coalesce(batch = 2, false) END AS asked FROM b""")
def answer_pages(s, d):
    """Which answers belong to page 2 of the title's search, and the batch that offset and count name."""
    u = _urls(s, d)
    return u.select("capture_seq", scalars.douyin_batch(F.col("answer")).alias("batch"), scalars.answers_page(F.col("platform"), F.col("answer"), F.col("title"), F.lit(2)).alias("asked"))


@query("""SELECT capture_seq, capture_seq % 5 = 2 AS third, true AS own, false AS other FROM raw_videos WHERE platform IS NOT NULL AND title IS NOT NULL""")
def source_pages(s, d):
    u = _urls(s, d)
    first = scalars.search_url(F.col("platform"), F.col("title"), F.lit(1))
    return u.select(
        "capture_seq", scalars.source_page_fits(first, F.col("own"), F.lit(3)).alias("third"), scalars.source_page_fits(first, F.col("own"), F.col("k") + 1).alias("own"),
        scalars.source_page_fits(first, F.concat("own", F.lit("&order=new")), F.col("k") + 1).alias("other"))


@query("""SELECT capture_seq, capture_seq % 4 IN (1, 2) AS sound FROM raw_videos WHERE title IS NOT NULL""")
def discovery_sources(s, d):
    """A query alone, a page alone, both, or a page that is named twice."""
    v = table(s, d, "raw_videos").where("title is not null")
    k = F.col("capture_seq") % 4
    url = F.when(k == 2, "https://search.bilibili.com/all?keyword=x&page=2").when(k == 3, "https://search.bilibili.com/all?page=1&page=2").when(k == 0, "https://search.bilibili.com/all")
    return v.select("capture_seq", verification.discovery_source(F.when(k.isin(0, 1), F.col("title")), url).alias("sound"))


@query("""WITH f AS (SELECT platform, raw_video_id, capture_seq, capture_seq // 20 AS page FROM raw_videos WHERE capture_seq // 20 <= (SELECT max(p) FROM (SELECT DISTINCT capture_seq // 20 AS p FROM raw_videos ORDER BY p LIMIT 3))
  QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1)
SELECT platform, raw_video_id, capture_seq, (SELECT least(3, count(DISTINCT capture_seq // 20)) FROM raw_videos) AS pages FROM f""")
def discovered_pages(s, d):
    """Discovery that ends with its third page."""
    v = table(s, d, "raw_videos").withColumn("page", F.floor(F.col("capture_seq") / 20))
    v = v.select("platform", "raw_video_id", "page", "capture_seq")
    return ranking.discover(v, ["platform", "raw_video_id"], "page", "capture_seq", 10_000, 3).select("platform", "raw_video_id", "capture_seq", F.col("pages").cast("bigint").alias("pages"))


# ---------------------------------------------------------------- fields


@query(r"""WITH x AS (SELECT arrival_seq, CASE arrival_seq % 5 WHEN 0 THEN like_count::VARCHAR WHEN 1 THEN text WHEN 2 THEN '-3' WHEN 3 THEN raw_comment_id ELSE ' ' || raw_comment_id END AS v FROM raw_comments)
SELECT arrival_seq, CASE WHEN regexp_full_match(trim(v), '[+]?\d+') THEN TRY_CAST(trim(v) AS BIGINT) END AS n, CASE WHEN v <> '' AND NOT regexp_matches(v, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]') THEN v END AS id FROM x""")
def optional_fields(s, d):
    k = F.col("arrival_seq") % 5
    v = F.when(k == 0, F.col("like_count").cast("string")).when(k == 1, F.col("text")).when(k == 2, "-3").when(k == 3, F.col("raw_comment_id")).otherwise(F.concat(F.lit(" "), "raw_comment_id"))
    return table(s, d, "raw_comments").select("arrival_seq", scalars.optional_count(v).alias("n"), scalars.optional_identifier(v).alias("id"))


@query("""SELECT c.arrival_seq, c.raw_author_id = v.owner AS own FROM raw_comments c LEFT JOIN (SELECT platform, raw_video_id, max(raw_author_id) AS owner FROM raw_videos GROUP BY 1, 2) v USING (platform, raw_video_id)""")
def author_flags(s, d):
    own = table(s, d, "raw_videos").groupBy("platform", "raw_video_id").agg(F.max("raw_author_id").alias("owner"))
    return table(s, d, "raw_comments").join(own, ["platform", "raw_video_id"], "left").select("arrival_seq", scalars.is_video_author(F.col("raw_author_id"), F.col("owner")).alias("own"))


@query("""SELECT manifest_id, CASE direction WHEN 'software_tools' THEN 'software_tool' WHEN 'life_services' THEN 'life_service' ELSE
  CASE WHEN direction IN ('software_tool', 'tutorial_workflow', 'life_service', 'ecommerce_marketing', 'entertainment_culture') THEN direction ELSE 'unknown' END END AS direction FROM sampling_manifests""")
def directions(s, d):
    return table(s, d, "sampling_manifests").select("manifest_id", scalars.direction_name(F.col("direction")).alias("direction"))


@query(f"""WITH v AS (SELECT *, CASE WHEN total_comment_count <= 200 THEN 'up_to_200' WHEN total_comment_count <= 2000 THEN '201_to_2000' WHEN total_comment_count > 2000 THEN 'over_2000' END AS cs
  FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1),
m AS (SELECT platform, video_id AS raw_video_id, min(direction) AS dir FROM sampling_manifests GROUP BY 1, 2), x AS (SELECT v.*, m.dir FROM v LEFT JOIN m USING (platform, raw_video_id)),
w AS (SELECT * FROM (VALUES ('platform', 'bilibili', 12, 1), ('platform', 'douyin', 12, 2), ('direction', 'software_tool', 5, 1), ('direction', 'life_service', 5, 2), ('comment_scale', 'up_to_200', 8, 1), ('comment_scale', '201_to_2000', 8, 2), ('comment_scale', 'over_2000', 8, 3)) t(dim, value, expected, o)),
n AS (SELECT w.*, (SELECT count(*) FROM x WHERE CASE dim WHEN 'platform' THEN platform WHEN 'direction' THEN dir ELSE cs END = value) AS actual FROM w),
g AS (SELECT dim, string_agg(value || '=' || expected, ',' ORDER BY o) AS expected, string_agg(value || '=' || actual, ',' ORDER BY o) AS actual FROM n GROUP BY 1)
SELECT CASE dim WHEN 'platform' THEN 'platform_unavailable' WHEN 'direction' THEN 'direction_distribution' ELSE 'scale_distribution' END AS code, expected, actual, CASE dim WHEN 'platform' THEN 'douyin' ELSE '' END AS unavailable_platforms
FROM g WHERE dim = 'platform' OR expected <> actual UNION ALL SELECT 'video_total', '24', (SELECT count(*) FROM v)::VARCHAR, '' WHERE (SELECT count(*) FROM v) <> 24""")
def coverage_report(s, d):
    """Coverage of all first captures, with one platform out of reach."""
    v = merging.first_per_key(table(s, d, "raw_videos"), ["platform", "raw_video_id"], "capture_seq").withColumn("comment_scale", scalars.comment_scale(F.col("total_comment_count")))
    m = table(s, d, "sampling_manifests").groupBy("platform", F.col("video_id").alias("raw_video_id")).agg(F.min("direction").alias("direction"))
    wanted = {"platform": {"bilibili": 12, "douyin": 12}, "direction": {"software_tool": 5, "life_service": 5}, "comment_scale": {"up_to_200": 8, "201_to_2000": 8, "over_2000": 8}}
    return ranking.coverage_report(v.join(m, ["platform", "raw_video_id"], "left"), wanted, 24, ["douyin", "douyin"])


# ---------------------------------------------------------------- starts, plans and manifests


@query("""SELECT plan_id AS run_id, CASE WHEN k % 7 = 0 THEN 'requested_revision_required' WHEN k % 5 = 0 THEN 'gateway_revision_required' WHEN k % 4 = 0 THEN 'gateway_model_mismatch' WHEN k % 3 = 0 THEN 'gateway_revision_mismatch'
  WHEN k % 11 = 1 OR k % 2 = 0 THEN 'gateway_capability_unsupported' END AS code FROM (SELECT plan_id, per_call_input_limit // 64 + signal_input_limit // 64 AS k FROM batch_plans)""")
def preflight(s, d):
    """Runs that ask a gateway for what it may not be."""
    k = F.floor(F.col("per_call_input_limit") / 64) + F.floor(F.col("signal_input_limit") / 64)
    runs = table(s, d, "batch_plans").withColumn("k", k).select(
        F.col("plan_id").alias("run_id"), F.lit("m").alias("model_name"), F.when(F.col("k") % 7 != 0, "r1").alias("revision"), F.when(F.col("k") % 4 == 0, "n").otherwise("m").alias("gateway_name"),
        F.when(F.col("k") % 5 != 0, F.when(F.col("k") % 3 == 0, "r2").otherwise("r1")).alias("gateway_revision"), (F.col("k") % 11 != 1).alias("supports_text"), F.lit(True).alias("gateway_text"), (F.col("k") % 2 != 0).alias("gateway_structured"))
    return verification.preflight(runs)


@query(r"""WITH p AS (SELECT platform, CASE WHEN capture_seq % 8 = 0 THEN 'con.x' ELSE raw_video_id END AS video_key, CASE capture_seq % 6 WHEN 0 THEN 'sports' ELSE 'life_services' END AS direction FROM raw_videos WHERE platform IS NOT NULL AND raw_video_id IS NOT NULL)
SELECT DISTINCT platform, video_key, 'unsafe_key' AS code FROM p WHERE NOT (regexp_full_match(video_key, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AND NOT video_key LIKE '%.' AND NOT regexp_full_match(upper(split_part(video_key, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]'))
UNION ALL SELECT DISTINCT platform, video_key, 'direction_unknown' FROM p WHERE direction = 'sports'
UNION ALL SELECT platform, video_key, 'duplicate_video' FROM p GROUP BY 1, 2 HAVING count(*) > 1""")
def plan_entries(s, d):
    """Captures as entries of an allow-list, some with a device's name for a key or a direction that nobody knows."""
    v = table(s, d, "raw_videos").where("platform is not null and raw_video_id is not null")
    p = v.select("platform", F.when(F.col("capture_seq") % 8 == 0, "con.x").otherwise(F.col("raw_video_id")).alias("video_key"), F.when(F.col("capture_seq") % 6 == 0, "sports").otherwise("life_services").alias("direction"))
    return verification.plan_entries(p, ["software_tools", "tutorial_workflow", "life_services", "entertainment_culture", "ecommerce_marketing"])


_PLANS = f"""WITH {_QUALITY},
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY manifest_id) AS r, CASE WHEN status = 'degraded' THEN 1 ELSE 0 END AS dg, coalesce(reported_total, len(candidate_comment_ids)) AS pop FROM q),
al AS MATERIALIZED (SELECT DISTINCT manifest_id, e.key AS stratum, unnest(e.value) AS comment_id FROM (SELECT manifest_id, unnest(map_entries(stratum_comment_ids)) AS e FROM k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, stratum ORDER BY comment_id) AS i FROM al),
mem AS MATERIALIZED (SELECT manifest_id, CASE WHEN r % 5 = 0 THEN 'recent' ELSE stratum END AS stratum, comment_id, i, r FROM rk JOIN k USING (manifest_id) WHERE i <= 3),
req AS MATERIALIZED (SELECT DISTINCT manifest_id, comment_id, r FROM mem WHERE NOT (r % 7 = 0 AND i = 1)),
req2 AS MATERIALIZED (SELECT manifest_id, comment_id FROM req UNION ALL SELECT manifest_id, comment_id FROM req WHERE r % 6 = 0 UNION ALL SELECT manifest_id, 'stranger' FROM k WHERE r % 8 = 0),
pl AS MATERIALIZED (SELECT CASE WHEN r % 9 = 0 THEN 'lost' ELSE manifest_id END AS manifest_id, r, CASE WHEN r % 4 = 0 THEN 'usable' ELSE status END AS status, pop + (r % 3 = 0)::INT AS population, (SELECT count(DISTINCT comment_id) FROM mem m WHERE m.manifest_id = k.manifest_id) AS n,
  CASE WHEN r % 10 = 0 THEN 'elsewhere' ELSE video_id END AS video_id FROM k)
"""


@query(_PLANS + """SELECT DISTINCT manifest_id, code FROM (
SELECT pl.manifest_id, 'manifest_unknown' AS code FROM pl ANTI JOIN k USING (manifest_id)
UNION ALL SELECT pl.manifest_id, 'video_mismatch' FROM pl JOIN k USING (manifest_id) WHERE pl.video_id <> k.video_id
UNION ALL SELECT pl.manifest_id, 'quality_mismatch' FROM pl JOIN k USING (manifest_id) WHERE k.status <> 'insufficient' AND pl.status <> k.status
UNION ALL SELECT pl.manifest_id, 'population_mismatch' FROM pl JOIN k USING (manifest_id) WHERE pl.population <> k.pop
UNION ALL SELECT manifest_id, 'request_not_in_plan' FROM req2 ANTI JOIN mem USING (manifest_id, comment_id)
UNION ALL SELECT manifest_id, 'plan_not_in_request' FROM mem ANTI JOIN req2 USING (manifest_id, comment_id)
UNION ALL SELECT manifest_id, 'request_repeats' FROM req2 GROUP BY manifest_id, comment_id HAVING count(*) > 1
UNION ALL SELECT manifest_id, 'strata_overlap' FROM mem GROUP BY manifest_id, comment_id HAVING count(*) > 1
UNION ALL SELECT manifest_id, 'not_in_manifest' FROM mem ANTI JOIN (SELECT manifest_id, unnest(candidate_comment_ids) AS comment_id FROM k) USING (manifest_id, comment_id)
UNION ALL SELECT manifest_id, 'stratum_mismatch' FROM mem ANTI JOIN al USING (manifest_id, comment_id, stratum)
UNION ALL SELECT pl.manifest_id, 'target_mismatch' FROM pl LEFT JOIN (SELECT manifest_id, count(DISTINCT comment_id) AS c FROM mem GROUP BY 1) x USING (manifest_id) WHERE pl.n + (r % 11 = 0)::INT <> coalesce(c, 0))""")
def plan_violations(s, d):
    """Samples of three comments a stratum, with plans and requests that differ from them in every way a check knows."""
    m = table(s, d, "sampling_manifests")
    k = profiling.quality(m).withColumn("r", F.row_number().over(W.orderBy("manifest_id"))).withColumn("pop", F.coalesce("reported_total", F.size("candidate_comment_ids")).cast("bigint"))
    k = Scratch(s, "plans").keep(k.select("manifest_id", "platform", "video_id", "status", "r", "pop", "stratum_comment_ids"), "k")
    flat = k.select("manifest_id", "r", F.explode("stratum_comment_ids").alias("stratum", "ids")).select("manifest_id", "r", "stratum", F.explode("ids").alias("comment_id")).distinct()
    mem = flat.withColumn("i", F.row_number().over(W.partitionBy("manifest_id", "stratum").orderBy("comment_id"))).where("i <= 3").withColumn("stratum", F.when(F.col("r") % 5 == 0, "recent").otherwise(F.col("stratum")))
    req = mem.where("not (r % 7 = 0 and i = 1)").select("manifest_id", "comment_id", "r").distinct()
    req = req.unionByName(req.where("r % 6 = 0")).unionByName(k.where("r % 8 = 0").select("manifest_id", F.lit("stranger").alias("comment_id"), "r")).select("manifest_id", "comment_id")
    size = mem.groupBy("manifest_id").agg(F.count_distinct("comment_id").alias("n"))
    plans = k.join(size, "manifest_id", "left").select(
        F.when(F.col("r") % 9 == 0, "lost").otherwise(F.col("manifest_id")).alias("manifest_id"), "platform", F.when(F.col("r") % 10 == 0, "elsewhere").otherwise(F.col("video_id")).alias("video_id"), F.when(F.col("r") % 4 == 0, "usable").otherwise(F.col("status")).alias("status"),
        (F.col("pop") + (F.col("r") % 3 == 0).cast("int")).alias("population_size"), (F.coalesce("n", F.lit(0)) + (F.col("r") % 11 == 0).cast("int")).alias("target_count"))
    return verification.plan_violations(plans, m, mem.select("manifest_id", "stratum", "comment_id"), req).distinct()


@query("""SELECT manifest_id, platform, video_id, e.key AS stratum, len(list_distinct(e.value)) AS comments, array_to_string(list_sort(list_distinct(e.value)), ',') AS ids
FROM (SELECT manifest_id, platform, video_id, unnest(map_entries(stratum_comment_ids)) AS e FROM sampling_manifests)""")
def stratum_ids(s, d):
    """Each manifest's ids by stratum, as rows of (manifest, stratum, id) put together again."""
    m = table(s, d, "sampling_manifests")
    flat = m.select("manifest_id", "platform", "video_id", F.explode("stratum_comment_ids").alias("stratum", "ids"))
    known = flat.select("manifest_id", "platform", "video_id", "stratum").distinct()
    ids = profiling.stratum_ids(flat.select("manifest_id", "stratum", F.explode("ids").alias("id")), ["manifest_id"], "stratum", "id")
    return known.join(ids, ["manifest_id", "stratum"], "left").select("manifest_id", "platform", "video_id", "stratum", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))


@query("""WITH b AS (SELECT manifest_id, unnest(candidate_comment_ids) AS comment_id, generate_subscripts(candidate_comment_ids, 1) - 1 AS position FROM sampling_manifests),
c AS (SELECT raw_comment_id AS comment_id, min(arrival_seq) AS first FROM raw_comments WHERE raw_comment_id IS NOT NULL AND arrival_seq % 10 <> 0 GROUP BY 1)
SELECT manifest_id, position::BIGINT AS position, comment_id, first FROM b LEFT JOIN c USING (comment_id)""")
def requested_order(s, d):
    """Candidates of each manifest in their order, with the comments that are there, and those that are not."""
    c = table(s, d, "raw_comments").where("raw_comment_id is not null and arrival_seq % 10 <> 0").groupBy(F.col("raw_comment_id").alias("comment_id")).agg(F.min("arrival_seq").alias("first"))
    got, lost = verification.ordered_lookup(table(s, d, "sampling_manifests").select(F.col("manifest_id").alias("batch_id"), F.col("candidate_comment_ids").alias("ids")), c)
    cols = [F.col("batch_id").alias("manifest_id"), F.col("position").cast("bigint").alias("position"), "comment_id"]
    return got.select(*cols, "first").unionByName(lost.select(*cols, F.lit(None).cast("bigint").alias("first")))


# ---------------------------------------------------------------- labels and their files

_SEEN = f"""WITH {_LABELS}, l AS MATERIALIZED (SELECT video_id, annotator_id, comment_id, text, row_number() OVER (PARTITION BY video_id, annotator_id ORDER BY comment_id) AS position FROM held WHERE video_id IS NOT NULL AND annotator_id IS NOT NULL AND comment_id IS NOT NULL)"""


def _seen(s: SparkSession, d: str) -> DataFrame:
    held = labels.holding(table(s, d, "comment_labels")).where("video_id is not null and annotator_id is not null and comment_id is not null")
    return held.select("video_id", "annotator_id", F.row_number().over(W.partitionBy("video_id", "annotator_id").orderBy("comment_id")).cast("bigint").alias("position"), "comment_id", "text")


@query(_SEEN + """, a AS (SELECT video_id, min(annotator_id) AS f, max(annotator_id) AS s, (SELECT min(x.annotator_id) FROM l x WHERE x.video_id = l.video_id AND x.annotator_id > (SELECT min(y.annotator_id) FROM l y WHERE y.video_id = l.video_id)) AS j, count(*) AS n FROM l GROUP BY video_id),
dis AS MATERIALIZED (SELECT video_id, f AS first_annotator, CASE WHEN n % 5 <> 0 THEN s END AS second_annotator, CASE WHEN n % 4 <> 0 THEN CASE WHEN n % 3 = 0 THEN 'raw-judge' ELSE j END END AS adjudicator FROM a),
own AS (SELECT video_id, annotator_id, list((position, comment_id, text) ORDER BY position) AS x FROM l GROUP BY ALL)
SELECT video_id, 'dispute_not_adjudicated' AS code FROM dis WHERE adjudicator IS NULL OR second_annotator IS NULL
UNION ALL SELECT video_id, 'independent_annotators_required' FROM dis WHERE first_annotator = second_annotator
UNION ALL SELECT video_id, 'raw_identifier_pattern' FROM dis WHERE adjudicator = 'raw-judge'
UNION ALL SELECT dis.video_id, 'independent_annotation_source_mismatch' FROM dis LEFT JOIN own o ON o.video_id = dis.video_id AND o.annotator_id = dis.first_annotator LEFT JOIN own p ON p.video_id = dis.video_id AND p.annotator_id = dis.second_annotator
  WHERE second_annotator IS NOT NULL AND o.x IS DISTINCT FROM p.x
UNION ALL SELECT dis.video_id, 'adjudication_source_mismatch' FROM dis LEFT JOIN own o ON o.video_id = dis.video_id AND o.annotator_id = dis.first_annotator LEFT JOIN own p ON p.video_id = dis.video_id AND p.annotator_id = dis.adjudicator
  WHERE adjudicator IS NOT NULL AND o.x IS DISTINCT FROM p.x""")
def adjudication(s, d):
    """Each video's first and last annotator in dispute, with a judge who may be missing or bear a raw name."""
    l = Scratch(s, "seen").keep(_seen(s, d), "seen")
    who = l.groupBy("video_id").agg(F.min("annotator_id").alias("f"), F.max("annotator_id").alias("s"), F.count("*").alias("n"))
    second = l.join(who, "video_id").where("annotator_id > f").groupBy("video_id").agg(F.min("annotator_id").alias("j"))
    n = F.col("n")
    disputes = who.join(second, "video_id", "left").select(
        "video_id", F.col("f").alias("first_annotator"), F.when(n % 5 != 0, F.col("s")).alias("second_annotator"), F.when(n % 4 != 0, F.when(n % 3 == 0, "raw-judge").otherwise(F.col("j"))).alias("adjudicator"))
    return verification.adjudication_violations(l, disputes)


@query(_SEEN + """, src AS MATERIALIZED (SELECT video_id, position, comment_id FROM l QUALIFY annotator_id = min(annotator_id) OVER (PARTITION BY video_id)),
n AS (SELECT video_id, count(*) AS n FROM src GROUP BY 1),
fil AS MATERIALIZED (SELECT CASE WHEN n % 7 = 0 THEN video_id || '-x' ELSE video_id END AS video_id, CASE WHEN n % 5 = 0 THEN n + 1 - position ELSE position END AS position, comment_id, n FROM src JOIN n USING (video_id)),
sets AS (SELECT DISTINCT video_id, 'foreign_file' AS code FROM fil ANTI JOIN src USING (video_id) UNION ALL SELECT DISTINCT video_id, 'missing_file' FROM src ANTI JOIN fil USING (video_id))
SELECT * FROM sets UNION ALL SELECT video_id, 'order_mismatch' FROM n WHERE n % 5 = 0 AND n % 7 <> 0 AND n > 1""")
def label_files(s, d):
    """Files of labels against their sources: some renamed, some in another order."""
    l = _seen(s, d)
    first = l.groupBy("video_id").agg(F.min("annotator_id").alias("annotator_id"), )
    src = Scratch(s, "files").keep(l.join(first, ["video_id", "annotator_id"]).select("video_id", "position", "comment_id"), "src")
    n = src.groupBy("video_id").agg(F.count("*").alias("n"))
    files = src.join(n, "video_id").select(F.when(F.col("n") % 7 == 0, F.concat("video_id", F.lit("-x"))).otherwise(F.col("video_id")).alias("video_id"), F.when(F.col("n") % 5 == 0, F.col("n") + 1 - F.col("position")).otherwise(F.col("position")).alias("position"), "comment_id")
    return verification.label_root(src, files)


@query(f"""WITH {_LABELS} SELECT video_id, annotator_id, comment_id, row_number() OVER (PARTITION BY video_id, annotator_id ORDER BY comment_id) - 1 AS line, need_signal, signal_kind, noise_kind, video_reception, normalized_need FROM held
WHERE video_id IS NOT NULL AND annotator_id IS NOT NULL AND comment_id IS NOT NULL AND (video_id, annotator_id) NOT IN (SELECT (video_id, annotator_id) FROM held WHERE video_id IS NOT NULL AND annotator_id IS NOT NULL AND comment_id IS NOT NULL AND
  (coalesce(need_signal, 'unlabeled') = 'unlabeled' OR coalesce(signal_kind, 'unlabeled') = 'unlabeled' OR coalesce(noise_kind, 'unlabeled') = 'unlabeled' OR coalesce(video_reception, 'unlabeled') = 'unlabeled' OR (need_signal = 'yes' AND coalesce(length(normalized_need), 0) = 0)))""")
def exported_labels(s, d):
    """The complete label files in the order of their comments, written once and read again."""
    held = labels.holding(table(s, d, "comment_labels")).where("video_id is not null and annotator_id is not null and comment_id is not null")
    scratch = Scratch(s, "export")
    path = scratch.path("labels")
    labels.export(held, path)
    out = s.read.schema("video_id string, annotator_id string, comment_id string, line bigint, need_signal string, signal_kind string, noise_kind string, video_reception string, normalized_need string").json(path)
    return out.select("video_id", "annotator_id", "comment_id", "line", "need_signal", "signal_kind", "noise_kind", "video_reception", "normalized_need")


@query("""SELECT 'split' AS entity, v AS key, CASE WHEN dev THEN 'only_listed' ELSE 'not_listed' END AS code FROM (
  SELECT v, true AS dev FROM (SELECT DISTINCT unnest(development) AS v FROM dataset_splits) ANTI JOIN (SELECT DISTINCT raw_video_id AS v FROM raw_videos) USING (v)
  UNION ALL SELECT v, false FROM (SELECT DISTINCT raw_video_id AS v FROM raw_videos WHERE raw_video_id IS NOT NULL) ANTI JOIN (SELECT DISTINCT unnest(development) AS v FROM dataset_splits) USING (v))""")
def set_equality(s, d):
    """The development list against the captured videos, in both directions."""
    a = table(s, d, "raw_videos").where("raw_video_id is not null").select(F.col("raw_video_id").alias("v"))
    b = table(s, d, "dataset_splits").select(F.explode("development").alias("v")).where("v is not null")
    return checks.set_difference(b, a, "split", ["v"], "not_listed", "only_listed")


# ---------------------------------------------------------------- budgets, caches, reports

_ATTEMPTS = """held AS (SELECT plan_id, item_id, estimated_input_tokens AS t FROM batch_items WHERE plan_id IS NOT NULL AND item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY plan_id, item_id ORDER BY estimated_at DESC NULLS LAST, estimated_input_tokens DESC NULLS LAST) = 1),
att AS MATERIALIZED (SELECT plan_id AS scope, row_number() OVER (PARTITION BY plan_id ORDER BY item_id) AS attempt, CASE item_id % 3 WHEN 1 THEN t - 1 WHEN 2 THEN t + (item_id % 50 = 2)::INT END AS i, CASE WHEN item_id % 4 <> 0 THEN 5 END AS o, t AS ri, 10 AS ro, item_id FROM held WHERE t > 1),
lim AS (SELECT plan_id AS scope, 30 AS mc, signal_input_limit AS mi, 200 AS mo FROM batch_plans WHERE plan_id IS NOT NULL)"""


def _attempts(s: SparkSession, d: str) -> DataFrame:
    held = table(s, d, "batch_items").where("plan_id is not null and item_id is not null").groupBy("plan_id", "item_id").agg(F.max(F.struct("estimated_at", "estimated_input_tokens")).alias("r"))
    held = held.select(F.col("plan_id").alias("scope"), "item_id", F.col("r.estimated_input_tokens").alias("t")).where("t > 1")
    i = F.when(F.col("item_id") % 3 == 1, F.col("t") - 1).when(F.col("item_id") % 3 == 2, F.col("t") + (F.col("item_id") % 50 == 2).cast("int"))
    return held.select("scope", F.row_number().over(W.partitionBy("scope").orderBy("item_id")).alias("attempt"), i.alias("input_tokens"), F.when(F.col("item_id") % 4 != 0, 5).alias("output_tokens"), F.col("t").alias("reserved_input"), F.lit(10).alias("reserved_output"), "item_id")


@query(f"""WITH RECURSIVE {_ATTEMPTS},
a AS MATERIALIZED (SELECT * FROM att JOIN lim USING (scope)),
w AS (SELECT scope, 0::BIGINT AS attempt, 0::BIGINT AS calls, 0::BIGINT AS inp, 0::BIGINT AS outp, 0::BIGINT AS cb, 0::BIGINT AS ib, 0::BIGINT AS ob, NULL::VARCHAR AS refused, NULL::VARCHAR AS exceeded FROM lim
UNION ALL SELECT scope, attempt, calls + (refused IS NULL)::INT, inp + CASE WHEN refused IS NULL THEN ai ELSE 0 END, outp + CASE WHEN refused IS NULL THEN ao ELSE 0 END, calls, inp, outp, refused,
  CASE WHEN refused IS NULL THEN CASE WHEN ai > ri OR inp + ai > mi THEN 'input_tokens' WHEN ao > ro OR outp + ao > mo THEN 'output_tokens' END END
  FROM (SELECT a.*, w.calls, w.inp, w.outp, coalesce(i, ri) AS ai, coalesce(o, ro) AS ao, CASE WHEN w.calls + 1 > mc THEN 'model_calls' WHEN w.inp + ri > mi THEN 'input_tokens' WHEN w.outp + ro > mo THEN 'output_tokens' END AS refused
    FROM w JOIN a ON a.scope = w.scope AND a.attempt = w.attempt + 1))
SELECT scope, attempt, cb AS calls_before, ib AS input_before, ob AS output_before, refused, exceeded FROM w WHERE attempt > 0""")
def budget(s, d):
    """Items of a plan as attempts in order: what each found used, and what it broke."""
    limits = table(s, d, "batch_plans").where("plan_id is not null").select(F.col("plan_id").alias("scope"), F.lit(30).alias("max_calls"), F.col("signal_input_limit").alias("max_input"), F.lit(200).alias("max_output"))
    return model_step.replay_budget(_attempts(s, d), limits).select("scope", "attempt", "calls_before", "input_before", "output_before", "refused", "exceeded")


@query(f"""WITH {_ATTEMPTS} SELECT scope, count(*) FILTER (WHERE item_id % 5 <> 0) AS calls, coalesce(sum(coalesce(i, ri)) FILTER (WHERE item_id % 5 <> 0), 0)::BIGINT AS input_tokens, coalesce(sum(coalesce(o, ro)) FILTER (WHERE item_id % 5 <> 0), 0)::BIGINT AS output_tokens,
  count(*) FILTER (WHERE item_id % 5 = 0) AS calls_reserved, coalesce(sum(ri) FILTER (WHERE item_id % 5 = 0), 0)::BIGINT AS input_reserved, coalesce(sum(ro) FILTER (WHERE item_id % 5 = 0), 0)::BIGINT AS output_reserved FROM att GROUP BY 1""")
def budget_snapshots(s, d):
    """What each plan has used, and what its open attempts (every fifth item) hold."""
    return verification.budget_snapshot(_attempts(s, d).withColumn("status", F.when(F.col("item_id") % 5 == 0, "open").otherwise("done")))


_KEYS = """SELECT plan_id, stage, platform, sha256(to_json({'batch_manifest_hash': sha256(to_json({'fixed_input_tokens': fixed_input_tokens, 'per_call_input_limit': per_call_input_limit})::VARCHAR), 'identity_verification_required': false, 'model_config_ref': 'c',
  'model_name': NULL::VARCHAR, 'model_revision': NULL::VARCHAR, 'normalized_input_hash': sha256(to_json({'plan_id': plan_id, 'video_id': video_id})::VARCHAR), 'prompt_version': 'p', 'rules_version': 'r', 'sampling_policy_version': 's', 'schema_version': '1', 'stage': stage})::VARCHAR) AS key FROM batch_plans"""


def _keys(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "batch_plans").withColumn("batch_manifest_hash", cache.batch_manifest_hash("fixed_input_tokens", "per_call_input_limit")).withColumn("normalized_input_hash", verification.digest("plan_id", "video_id"))
    fixed = {"sampling_policy_version": "s", "rules_version": "r", "prompt_version": "p", "schema_version": "1", "model_config_ref": "c"}
    p = p.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("identity_verification_required", F.lit(False))
    return p.select("plan_id", "stage", "platform", "video_id", cache.stage_key("model_name", "model_revision").alias("key"))


@query(_KEYS)
def stage_keys(s, d):
    return _keys(s, d).select("plan_id", "stage", "platform", "key")


@query(f"""WITH k AS ({_KEYS}), o AS (SELECT *, row_number() OVER (ORDER BY plan_id) AS r FROM k)
SELECT plan_id, stage, CASE WHEN stage <> 'signal' OR r % 3 = 0 THEN 'miss' WHEN r % 3 = 1 THEN 'hit' ELSE 'expired' END AS event FROM o""")
def cache_probe(s, d):
    """Entries for two of three keys of one stage, put twice, half of them expired: hits, misses and what is dead."""
    k = Scratch(s, "probe").keep(_keys(s, d).withColumn("r", F.row_number().over(W.orderBy("plan_id"))), "keys")
    entries = lambda at: k.where("stage = 'signal' and r % 3 > 0").select("key", "stage", F.lit("{}").alias("payload"), F.lit("h").alias("result_hash"), F.array().cast("array<string>").alias("sources"), at.alias("expires_at"))
    day = lambda n: F.expr(f"TIMESTAMP '2026-06-{n:02d} 00:00:00'")
    held = cache.put(cache.put(None, entries(day(1))), entries(F.when(F.col("r") % 3 == 1, day(21)).otherwise(day(20))))
    return cache.probe(k.select("key", "stage", "plan_id"), held, day(20)).select("plan_id", "stage", "event")


_SAID = """s AS MATERIALIZED (SELECT label_seq, video_id, comment_id, signal_kind AS kind, trim(regexp_replace(nfc_normalize(normalized_need), """ + r"'[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'" + """, ' ', 'g')) AS summary FROM comment_labels
  WHERE video_id IS NOT NULL AND comment_id IS NOT NULL AND signal_kind IS NOT NULL AND normalized_need IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, comment_id ORDER BY label_seq) = 1),
v AS (SELECT video_id, count(*) AS n, min(label_seq) AS k FROM s GROUP BY 1)"""


def _said(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "comment_labels").where("video_id is not null and comment_id is not null and signal_kind is not null and normalized_need is not null")
    return l.groupBy("video_id", "comment_id").agg(F.min_by(F.struct(F.col("signal_kind").alias("kind"), scalars.summary_text(F.col("normalized_need")).alias("summary")), "label_seq").alias("r"), F.min("label_seq").alias("label_seq")).select("video_id", "comment_id", "r.*", "label_seq")


@query(f"WITH {_SAID} SELECT video_id, CASE k % 6 WHEN 0 THEN 'result_hash_mismatch' WHEN 1 THEN 'sources_differ' WHEN 2 THEN 'payload_invalid' WHEN 3 THEN 'reference_invalid' WHEN 4 THEN 'identity_invalid' END AS code FROM v WHERE k % 6 < 5")
def cached_signals(s, d):
    """Cached signals of each video's labels, spoilt in each way that reading them must notice."""
    said = Scratch(s, "said").keep(_said(s, d).withColumn("signal_id", scalars.signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), "v1")), "said")
    k = said.groupBy("video_id").agg(F.min("label_seq").alias("k"), F.array_sort(F.collect_set("comment_id")).alias("expected"))
    spoilt = said.join(k.select("video_id", F.col("k") % 6), "video_id").withColumnRenamed("(k % 6)", "m")
    spoilt = spoilt.withColumn("signal_id", F.when(F.col("m") == 4, F.concat("signal_id", F.lit("x"))).otherwise(F.col("signal_id"))).withColumn("comment_id", F.when(F.col("m") == 3, F.concat("comment_id", F.lit("-other"))).otherwise(F.col("comment_id")))
    members = said.select(F.col("video_id").alias("batch_id"), "comment_id", F.expr("TIMESTAMP '2026-06-30 00:00:00'").alias("expires_at"))
    entries = cache.signal_entries(k.select(F.col("video_id").alias("key"), F.col("video_id").alias("batch_id")), members, spoilt.select(F.col("video_id").alias("batch_id"), "signal_id", "comment_id", "kind", "summary"))
    hits = entries.join(k.select(F.col("video_id").alias("key"), "expected", (F.col("k") % 6).alias("m")), "key")
    payload = F.when(F.col("m") == 2, F.lit("[1")).otherwise(F.col("payload"))
    hits = hits.withColumn("payload", payload).withColumn("result_hash", F.when(F.col("m") == 0, "0").otherwise(F.sha2("payload", 256))).withColumn("sources", F.when(F.col("m") == 1, F.array(F.lit("z"))).otherwise(F.col("sources")))
    return cache.signal_faults(hits, "v1").withColumnRenamed("key", "video_id")


@query(f"WITH {_SAID} SELECT video_id, CASE k % 5 WHEN 0 THEN 'result_hash_mismatch' WHEN 1 THEN 'sources_differ' WHEN 2 THEN 'cover_not_exact' WHEN 3 THEN 'identity_invalid' END AS code FROM v WHERE k % 5 < 4")
def cached_clusters(s, d):
    """Cached clusters likewise: one cluster a video, of all its labelled comments."""
    said = _said(s, d)
    k = said.groupBy("video_id").agg(F.min("label_seq").alias("k"), F.array_sort(F.collect_set("comment_id")).alias("expected"))
    m = F.col("k") % 5
    ids = F.when(m == 2, F.slice("expected", F.lit(2), F.size("expected"))).otherwise(F.col("expected"))
    c = k.select("video_id", "k", "expected", ids.alias("comment_ids"), F.lit("what they need").alias("summary"))
    c = c.withColumn("cluster_id", F.concat(scalars.cluster_id(F.col("comment_ids"), F.col("summary"), "v1"), F.when(F.col("k") % 5 == 3, "x").otherwise("")))
    members = said.select("video_id", "comment_id", F.expr("TIMESTAMP '2026-06-30 00:00:00'").alias("expires_at"))
    entries = cache.cluster_entries(k.select(F.col("video_id").alias("key"), "video_id"), members, c.select("video_id", "cluster_id", "comment_ids", "summary"))
    hits = entries.join(k.select(F.col("video_id").alias("key"), "expected", m.alias("m")), "key")
    hits = hits.withColumn("result_hash", F.when(F.col("m") == 0, "0").otherwise(F.col("result_hash"))).withColumn("sources", F.when(F.col("m") == 1, F.array(F.lit("z"))).otherwise(F.col("sources")))
    return cache.cluster_faults(hits, "v1").withColumnRenamed("key", "video_id")


@query(f"WITH {_SAID} SELECT video_id, sha256(string_agg(sha256(to_json({{'comment_id': comment_id, 'kind': kind, 'summary': summary}})::VARCHAR), ',' ORDER BY label_seq)) AS digest FROM s GROUP BY 1")
def input_digests(s, d):
    """The digest of each video's stated needs in order: what a stage's key says of its input."""
    return verification.group_digest(_said(s, d), ["video_id"], ["comment_id", "kind", "summary"], "label_seq")


@query("""WITH e AS (SELECT split_id AS name, unnest(development) AS code FROM dataset_splits UNION SELECT split_id, unnest(calibration) FROM dataset_splits),
o AS (SELECT split_id AS name, unnest(development) AS code FROM dataset_splits WHERE len(development) % 2 = 0 UNION SELECT split_id, unnest(calibration) FROM dataset_splits)
SELECT count(*) AS checked, count(*) FILTER (WHERE x.c IS DISTINCT FROM y.c) AS failed FROM (SELECT name, list_sort(list(DISTINCT code)) AS c FROM e GROUP BY 1) x LEFT JOIN (SELECT name, list_sort(list(DISTINCT code)) AS c FROM o GROUP BY 1) y USING (name)""")
def fixture_report(s, d):
    """Split runs as cases: the codes each should give against those it gave."""
    t = table(s, d, "dataset_splits")
    cal = t.select(F.col("split_id").alias("name"), F.explode("calibration").alias("code"))
    dev = lambda df: df.select(F.col("split_id").alias("name"), F.explode("development").alias("code"))
    return verification.fixture_report(dev(t).unionByName(cal), dev(t.where(F.size("development") % 2 == 0)).unionByName(cal))


@query("""SELECT manifest_id, CASE WHEN pages_succeeded % 3 = 0 THEN 'rate_limited' WHEN pages_succeeded % 3 = 1 THEN 'collection_error' END AS category, pages_succeeded = pages_requested AS complete FROM sampling_manifests""")
def run_report(s, d):
    """A run's report: categories that it may name, and whether all pages came."""
    m = table(s, d, "sampling_manifests").withColumn("status", F.when(F.col("pages_succeeded") % 3 == 0, "rate_limited").when(F.col("pages_succeeded") % 3 == 1, "cookie of somebody"))
    path = Scratch(s, "report").path("report")
    sinks.write_report(m.select("manifest_id", F.when(F.col("status").isNotNull(), verification.masked(F.col("status"), ["rate_limited", "timeout"])).alias("category"), (F.col("pages_succeeded") == F.col("pages_requested")).alias("complete")), path)
    return s.read.schema("manifest_id string, category string, complete boolean").json(path)


@query("""WITH p AS (SELECT platform, raw_video_id, title, duration_seconds, capture_seq FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1)
SELECT platform, raw_video_id, CASE capture_seq % 3 WHEN 0 THEN 'page of ' || raw_video_id WHEN 1 THEN coalesce(title, 'page of ' || raw_video_id) ELSE title END AS title, duration_seconds + (capture_seq % 3 = 0)::INT AS duration_seconds FROM p
WHERE platform IS NOT NULL AND raw_video_id IS NOT NULL""")
def filled_videos(s, d):
    """Videos from payloads, from their page where there is none, and from both."""
    p = merging.first_per_key(table(s, d, "raw_videos"), ["platform", "raw_video_id"], "capture_seq").where("platform is not null and raw_video_id is not null").select("platform", "raw_video_id", "title", "duration_seconds", "capture_seq")
    page = p.where("capture_seq % 3 < 2").select("platform", "raw_video_id", F.concat(F.lit("page of "), "raw_video_id").alias("title"), (F.col("duration_seconds") + 1).alias("duration_seconds"))
    return verification.fill_videos(p.where("capture_seq % 3 > 0").drop("capture_seq"), page, ["platform", "raw_video_id"])


# ---------------------------------------------------------------- sinks


@query("""SELECT platform, raw_video_id, capture_seq, title FROM raw_videos WHERE platform IS NOT NULL QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1""")
def generations(s, d):
    """Videos committed as a version, a second version that its check refuses, a third that may only create, and what a failed write
    left removed: readers still see the first."""
    v = merging.first_per_key(table(s, d, "raw_videos").where("platform is not null"), ["platform", "raw_video_id"], "capture_seq").select("platform", "raw_video_id", "capture_seq", "title")
    scratch = Scratch(s, "generations")
    g = sinks.Generations(s, scratch.path("videos"))
    g.commit(v, create_only=True, partition_by=["platform"])
    for kwargs in ({"check": lambda df: checks.require_none(df.select(F.lit("video").alias("entity"), F.col("raw_video_id").alias("key"), F.lit("no").alias("code")))}, {"create_only": True}):
        try:
            g.commit(v.limit(1), **kwargs)
            raise AssertionError("a refused version was published")
        except (ValueError, FileExistsError):
            pass
    v.limit(1).write.parquet(f"{g.root}/vlost")
    if g.recover() != 1:
        raise AssertionError("what an interrupted write left is still there")
    return g.read().select("platform", "raw_video_id", "capture_seq", "title")


@query("""SELECT split_id, unnest([1, 2])::INT AS run, len(development)::BIGINT AS videos FROM dataset_splits""")
def audit_trail(s, d):
    """Audit rows appended twice; a table whose fields, or keys of maps, are sensitive is refused before anything is written."""
    path = Scratch(s, "audit").path("audit")
    t = table(s, d, "dataset_splits").select("split_id", F.size("development").cast("bigint").alias("videos"))
    for i in (1, 2):
        sinks.append_audit(t.withColumn("run", F.lit(i)), path)
    for bad in (t.withColumn("x", F.struct(F.lit("a").alias("access_token"))), t.withColumn("x", F.create_map(F.lit("Cookie"), F.lit("a")))):
        try:
            sinks.append_audit(bad, path)
            raise AssertionError("sensitive keys were written")
        except ValueError:
            pass
    return s.read.schema("split_id string, run int, videos bigint").json(path).select("split_id", "run", "videos")


@query("""SELECT capture_seq, title, true AS plain FROM raw_videos""")
def published_candidates(s, d):
    """Captures published as candidates in sorted ASCII JSON, refused the second time, and read again."""
    path = Scratch(s, "candidates").path("published")
    v = table(s, d, "raw_videos").select("capture_seq", "title", "platform")
    audit = v.groupBy("platform").agg(F.count("*").alias("rows"))
    sinks.publish_candidates(v, audit, path)
    try:
        sinks.publish_candidates(v, audit, path)
        raise AssertionError("published twice")
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e):
            raise
    lines = s.read.text(f"{path}/candidates")
    plain = F.col("value").rlike(r"^[\x00-\x7f]*$") & F.col("value").startswith('{"capture_seq":')
    return lines.select(F.from_json("value", "capture_seq bigint, title string").alias("j"), plain.alias("plain")).select("j.*", "plain")


@query(f"WITH {_SAID} SELECT video_id, comment_id, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) AS place FROM s")
def signal_order(s, d):
    """The place of each video's signals in the order that results have: by comment, then by signal."""
    said = _said(s, d).withColumn("signal_id", scalars.signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), "v1"))
    return ranking.placed(said, ["video_id"], ["comment_id", "signal_id"]).select("video_id", "comment_id", F.col("place").cast("bigint").alias("place"))


# ---------------------------------------------------------------- directories

#: Rows of one captured directory.
FOLDER = 4_000
#: Directories that a task has on its worker's disk at once.
ROUND = 100
_LINE = list(payloads.LINE_FIELDS)
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _folder_files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Directories of the comments, platform/video-block/: (the files of each, one row per directory)."""
    c = table(s, d, "raw_comments").where("platform is not null and raw_video_id is not null and raw_comment_id is not null").where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    k = F.floor(F.col("arrival_seq") / FOLDER)
    line = F.struct("arrival_seq", F.to_json(F.struct(*[F.date_format(x, _ISO).alias(x) if x in ("published_at", "collected_at") else F.col(x) for x in _LINE]), {"ignoreNullFields": "false"}).alias("line"))
    f = c.withColumn("k", k).groupBy("platform", "raw_video_id", "k").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max(F.crc32("raw_video_id")).alias("h"))
    f = f.withColumn("m", F.col("h") + F.col("k")).withColumn("folder", F.concat_ws("-", "raw_video_id", F.col("k").cast("string")))
    video = F.to_json(F.struct("platform", F.when(F.col("m") % 5 == 0, "another").otherwise(F.col("folder")).alias("raw_video_id"), F.lit("t").alias("title"), F.col("k").alias("view_count")))
    total = F.size("lines") + (F.col("m") % 7 == 0).cast("int")
    coll = F.when(F.col("m") % 6 == 0, F.to_json(F.struct(F.lit("1.1").alias("collection_schema_version"), total.alias("collected_total")))).otherwise(F.to_json(F.struct(F.lit("1.1").alias("collection_schema_version"), F.lit(0).alias("exact_duplicate_count"), total.alias("collected_total"))))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    files = f.select("platform", "folder", video.alias("video"), text.alias("comments"), F.when(F.col("m") % 11 != 0, coll).alias("collection"))
    return files, f.select("platform", "folder", "k", "m")


def _folders(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The directories, written by the workers to the shared folder: (root, one row per directory)."""
    files, f = _folder_files(s, d)
    root = Scratch(s, "folders").path("raw")

    def write(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root)
        above = set()
        for b in batches:
            for r in b.to_pylist():
                at = f"{base}/{r['platform']}/{r['folder']}"
                target.create_dir(at, recursive=r["platform"] not in above)
                above.add(r["platform"])
                for name, body in (("video.json", r["video"]), ("comments.jsonl", r["comments"]), ("collection.json", r["collection"])):
                    if body is not None:
                        with target.open_output_stream(f"{at}/{name}") as out:
                            out.write(body.encode())
            yield b.select(["folder"])

    if files.mapInArrow(write, "folder string").count() == 0:
        raise ValueError("no comments to lay out")
    return root, f


class _OwnFolders:
    """Directories below a root that one process has to itself, a round of them at a time. Those of the last round are renamed and
    written over: a file system takes many times longer to make files where it has just removed others."""

    def __init__(self, own: str):
        self.root, self._aside, self._n = f"{own}/raw", f"{own}/aside", 0
        os.makedirs(self._aside)
        self._laid: list[tuple[bool, str]] = []
        self._spare: dict[bool, list[str]] = {True: [], False: []}  # with or without a collection.json

    @staticmethod
    def _write(path: str, body: bytes) -> None:
        f = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666)
        try:
            if os.write(f, body) < len(body):
                raise OSError(f"{path} was not written whole")
            if os.fstat(f).st_size > len(body):  # never to nothing first: its blocks stay
                os.ftruncate(f, len(body))
        finally:
            os.close(f)

    def lay_out(self, rows: list[dict]) -> None:
        """The next round of directories: platform, folder, video, comments and collection (null: that file is missing)."""
        for full, at in self._laid:
            self._spare[full].append(at)
        self._laid = []
        for platform in {r["platform"] for r in rows}:
            os.makedirs(f"{self.root}/{platform}", exist_ok=True)
        for r in rows:
            at, spare = f"{self.root}/{r['platform']}/{r['folder']}", self._spare[r["collection"] is not None]
            old = spare.pop() if spare else None
            os.rename(old, at) if old else os.mkdir(at)
            for name, body in (("video.json", r["video"]), ("comments.jsonl", r["comments"]), ("collection.json", r["collection"])):
                if body is not None:
                    self._write(f"{at}/{name}", body.encode())
            self._laid.append((r["collection"] is not None, at))
        for spare in self._spare.values():
            for i, at in enumerate(spare):
                if at.startswith(f"{self.root}/"):
                    self._n += 1
                    os.rename(at, f"{self._aside}/{self._n}")
                    spare[i] = f"{self._aside}/{self._n}"


_FOLDERS = rf"""c AS (SELECT *, arrival_seq // {FOLDER} AS k FROM raw_comments WHERE platform IS NOT NULL AND raw_video_id IS NOT NULL AND raw_comment_id IS NOT NULL AND NOT {_BLANK}),
l AS MATERIALIZED (SELECT *, raw_video_id || '-' || k AS folder, row_number() OVER (PARTITION BY platform, raw_video_id, k ORDER BY arrival_seq) AS line_number FROM c),
f AS MATERIALIZED (SELECT platform, folder, k, count(*) AS n FROM l GROUP BY 1, 2, 3)"""


@query(f"WITH {_FOLDERS} SELECT platform, folder AS raw_video_id, line_number, raw_comment_id, text, like_count, NULL::VARCHAR AS code FROM l")
def folder_lines(s, d):
    """Every line of every directory, in order. A worker lays out, lists and reads ROUND directories of its own at a time, so that
    the disk never holds them all."""
    laid, _ = _folder_files(s, d)

    def lines(batches):
        with tempfile.TemporaryDirectory(prefix="threadquarry-folders-") as own:
            folders = _OwnFolders(own)
            for b in batches:
                for at in range(0, b.num_rows, ROUND):
                    folders.lay_out(b.slice(at, ROUND).to_pylist())
                    yield from files.own_lines(folders.root)

    read = payloads.read_lines(laid.mapInArrow(lines, files.RAW_LINE).withColumn("body", F.col("body").cast("string")))
    return read.select("platform", "raw_video_id", F.col("line_number").cast("bigint").alias("line_number"), F.col("l_raw_comment_id").alias("raw_comment_id"), F.col("l_text").alias("text"), F.col("l_like_count").alias("like_count"), "code")


@query(f"WITH {_FOLDERS} SELECT platform, folder AS raw_video_id, 't' AS title, k AS view_count, NULL::VARCHAR AS code FROM f")
def folder_videos(s, d):
    root, _ = _folders(s, d)
    return files.whole_json(s, root, "video.json", files.VIDEO).select("platform", "raw_video_id", F.col("j.title").alias("title"), F.col("j.view_count").alias("view_count"), "code")


@query(f"""WITH {_FOLDERS} SELECT 'sound' AS kind, count(*) AS folders FROM f UNION ALL SELECT 'repeats', count(DISTINCT (platform, folder)) FROM (SELECT platform, folder FROM l GROUP BY platform, folder, raw_comment_id HAVING count(*) > 1)
UNION ALL SELECT 'replies', count(DISTINCT (platform, folder)) FROM l WHERE raw_parent_comment_id = raw_comment_id UNION ALL SELECT 'spoilt', 0""")
def folder_faults(s, d):
    """Directories checked: as many as there are, those whose comments repeat or answer themselves, and those that were spoilt on
    purpose without being noticed, or noticed without having been (none)."""
    root, f = _folders(s, d)
    f = Scratch(s, "faults").keep(f, "folders")
    bad = Scratch(s, "faults").keep(files.bundle_violations(s, root), "bad")
    m = F.col("m")
    spoilt = {"identity_mismatch": m % 5 == 0, "unexpected_files": m % 11 == 0, "total_mismatch": (m % 7 == 0) & (m % 11 != 0), "version_pair_incomplete": (m % 6 == 0) & (m % 11 != 0)}
    want = f.select("platform", F.col("folder").alias("raw_video_id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in spoilt.items()]))).alias("code"))
    got = bad.where(F.col("code").isin(*spoilt))
    off = want.exceptAll(got).unionByName(got.exceptAll(want))
    count = lambda df, kind: df.agg(F.count("*").alias("folders")).select(F.lit(kind).alias("kind"), "folders")
    return count(f, "sound").unionByName(count(bad.where("code = 'duplicate_comment_id'"), "repeats")).unionByName(count(bad.where("code = 'replies_to_itself'"), "replies")).unionByName(count(off, "spoilt"))


@query(f"WITH {_FOLDERS} SELECT platform, folder AS raw_video_id FROM f WHERE k % 2 = 1")
def unapproved_folders(s, d):
    """Directories that the allow-list, a file of its own, doesn't name."""
    root, f = _folders(s, d)
    listed = f.where("k % 2 = 0").select("platform", F.col("folder").alias("video_key"), F.lit("https://example.org/").alias("url"), F.lit("life_services").alias("direction"), F.lit("up_to_200").alias("comment_scale"))
    path = Scratch(s, "plan").path("plan")
    listed.agg(F.collect_list(F.struct(*listed.columns)).alias("videos")).select(F.lit("1").alias("manifest_version"), "videos").write.json(path)  # an allow-list is one small file
    return files.unapproved(files.listing(s, root), files.approved(s, path))


# ---------------------------------------------------------------- redaction

_W = r"\p{L}\p{N}_"


def _twice(column: str, pattern: str, mark: str) -> str:
    """A rule whose neighbours are captured and put back; twice, since neighbouring matches share one."""
    once = lambda x: f"regexp_replace({x}, '{pattern}', '\\1{mark}\\2', 'g')"
    return once(once(column))


_S = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{0b}]"
_RULES = [
    ("email", rf"(?i)(^|[^{_W}.+-])[{_W}.+-]+@[{_W}-]+(?:\.[{_W}-]+)+($|[^{_W}.-])", "[EMAIL]"),
    ("phone", r"(^|[^\p{Nd}])1[3-9]\p{Nd}{9}($|[^\p{Nd}])", "[PHONE]"),
    ("identity", r"(^|[^\p{Nd}])\p{Nd}{17}[\p{Nd}Xx]($|[^\p{Nd}])", "[IDENTIFIER]"),
    ("handle", rf"(?i)(^|[^a-z0-9_])(?:(?:微信号?|wx|vx|v信|私信|qq号)(?:[:：]|{_S})*|qq(?:[:：]|{_S})+)[a-z0-9_-]{{5,32}}($|[^a-z0-9_-])", "[HANDLE]"),
    ("at", r"(?i)()@[a-z0-9_][a-z0-9_-]{1,31}($|[^a-z0-9_-])", "[HANDLE]"),
    ("address", rf"()地址[:：]{_S}*[^，,。\n]{{4,80}}($|[，,。\n])", "[ADDRESS]"),
    ("precise", rf"()[\x{{4e00}}-\x{{9fff}}]{{2,}}(?:路|街|巷){_S}*\p{{Nd}}+{_S}*号()", "[ADDRESS]"),
]


def _redaction_sql() -> str:
    steps = [rf"r0 AS MATERIALIZED (SELECT arrival_seq, regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '^{_S}+|{_S}+$', '', 'g') AS t0 FROM raw_comments)"]
    for i, (name, pattern, mark) in enumerate(_RULES, 1):
        count = f"((length(t{i}) - length(replace(t{i}, '{mark}', ''))) - (length(t{i - 1}) - length(replace(t{i - 1}, '{mark}', '')))) // {len(mark)}"
        steps.append(f"s{i} AS (SELECT *, {_twice(f't{i - 1}', pattern, mark)} AS t{i} FROM r{i - 1}), r{i} AS MATERIALIZED (SELECT *, coalesce({count}, 0) AS n{i} FROM s{i})")
    return "WITH " + ",\n".join(steps)


SQL["ref_redacted"] = _redaction_sql() + " SELECT arrival_seq, t7 AS redacted, n1 AS n_email, n2 AS n_phone, n3 AS n_identity, n4 + n5 AS n_handle, n6 + n7 AS n_address, n7 > 0 AS review FROM r7"
SQL["ref_redaction_counts"] = _redaction_sql() + " SELECT sum(n1)::BIGINT AS n_email, sum(n2)::BIGINT AS n_phone, sum(n3)::BIGINT AS n_identity, sum(n4 + n5)::BIGINT AS n_handle, sum(n6 + n7)::BIGINT AS n_address, count(*) FILTER (WHERE n7 > 0) AS reviews FROM r7"


# ---------------------------------------------------------------- layers

WORDS = {"闪退": "pain", "白屏": "pain", "希望": "need", "wish": "need"}
_WORD = "CASE " + " ".join(f"WHEN text LIKE '%{w}%' THEN '{w}'" for w in WORDS) + " END"


@query(f"""WITH f AS (SELECT raw_video_id AS video_id, raw_comment_id AS comment_id, arg_min_null(text, arrival_seq) AS text FROM raw_comments WHERE raw_video_id IS NOT NULL AND raw_comment_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT video_id, comment_id, {_WORD} AS summary FROM f)
SELECT video_id, summary, count(*) AS comments, 'clu_' || left(sha256(string_agg(comment_id, chr(31) ORDER BY comment_id) || chr(30) || summary || chr(30) || 'v1'), 24) AS cluster_id FROM w WHERE summary IS NOT NULL GROUP BY 1, 2""")
def cluster_layers(s, d):
    """Signals of all comments that hold one of a few words, merged in layers of small calls until each video has one batch."""
    c = table(s, d, "raw_comments").where("raw_video_id is not null and raw_comment_id is not null").groupBy(F.col("raw_video_id").alias("video_id"), F.col("raw_comment_id").alias("comment_id")).agg(F.min_by("text", "arrival_seq").alias("text"))
    word = F.coalesce(*[F.when(F.col("text").contains(w), F.lit(w)) for w in WORDS])
    signals = c.withColumn("summary", word).where("summary is not null").withColumn("kind", F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.col("summary")))
    signals = signals.select("video_id", scalars.signal_id(F.col("comment_id"), F.col("kind"), F.col("summary"), "v1").alias("signal_id"), "comment_id", "kind", "summary")
    state = signals.select("video_id").distinct().select("video_id", F.lit(1_500).alias("per_call"), F.lit(10_000).alias("max_calls"), F.lit(100_000_000).alias("max_input"), F.lit(100_000_000).alias("max_output"), F.lit(100).alias("reserved_output"), *[F.lit(0).alias(x) for x in ("calls", "input", "output")])
    clusters, _, _ = analysis.merge_layers(signals, state, model_step.KeywordGateway(WORDS), "v1")
    return clusters.select("video_id", "summary", F.size("comment_ids").cast("bigint").alias("comments"), "cluster_id")


# ---------------------------------------------------------------- streams


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    whole = table(s, d, name)
    return s.readStream.schema(whole.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def _run(writer, scratch: Scratch) -> None:
    q = writer.option("checkpointLocation", scratch.path("progress")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT platform, raw_video_id, raw_comment_id, min(arrival_seq) AS arrival_seq FROM raw_comments GROUP BY 1, 2, 3 HAVING count(DISTINCT (coalesce(raw_author_id, chr(1)), coalesce(text, chr(1)))) = 1")
def stream_upserts(s, d):
    """All comments streamed into a table kept in parts."""
    scratch = Scratch(s, "upserts")
    parts = lambda i: sinks.Generations(s, f"{scratch.root}/part-{i}")
    _run(_stream(s, d, "raw_comments").writeStream.foreachBatch(incremental.upsert_into(parts, count=4)), scratch)
    return incremental.read_parts(parts, 4).select("platform", "raw_video_id", "raw_comment_id", "arrival_seq")


@query("SELECT DISTINCT platform, raw_video_id, raw_comment_id FROM raw_comments WHERE collected_at IS NOT NULL")
def stream_intake(s, d):
    """Each streamed comment once, whatever its repeats."""
    scratch = Scratch(s, "intake")
    out = scratch.path("taken")
    stream = incremental.intake(_stream(s, d, "raw_comments").where("collected_at is not null").select("platform", "raw_video_id", "raw_comment_id", "collected_at"))
    _run(stream.writeStream.format("parquet").option("path", out), scratch)
    return s.read.schema("platform string, raw_video_id string, raw_comment_id string").parquet(out)


_STREAM_AUTHORS = """own AS (SELECT raw_video_id AS video_id, max(raw_author_id) AS owner FROM raw_videos WHERE raw_video_id IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT raw_video_id AS video_id, coalesce(source_stratum, '-') AS cluster_id, raw_author_id AS author FROM raw_comments c JOIN own ON own.video_id = c.raw_video_id WHERE raw_author_id IS NOT NULL AND owner IS NOT NULL AND raw_author_id <> owner AND collected_at IS NOT NULL)"""


@query(f"WITH {_STREAM_AUTHORS} SELECT video_id, cluster_id FROM a GROUP BY 1, 2 HAVING count(*) >= 3")
def stream_consensus(s, d):
    """Clusters (a video's comments of one stratum) that reach three independent authors while streaming, in one batch."""
    scratch = Scratch(s, "consensus")
    out = scratch.path("passed")
    own = table(s, d, "raw_videos").where("raw_video_id is not null").groupBy(F.col("raw_video_id").alias("video_id")).agg(F.max("raw_author_id").alias("author_id"))
    rows = _stream(s, d, "raw_comments").where("collected_at is not null and raw_video_id is not null").select(F.col("raw_video_id").alias("video_id"), F.coalesce("source_stratum", F.lit("-")).alias("cluster_id"), F.col("raw_author_id").alias("author_id"), F.col("collected_at").alias("at"))
    _run(incremental.consensus_stream(rows, own).writeStream.outputMode("append").format("parquet").option("path", out), scratch)
    return s.read.schema("video_id string, cluster_id string, authors int").parquet(out).select("video_id", "cluster_id")


@query("""SELECT raw_comment_id, sha256(raw_comment_id || chr(31) || coalesce(text, '')) AS fingerprint, bool_or(collected_at > TIMESTAMP '2026-06-10 00:00:00' AND collected_at <= TIMESTAMP '2026-06-20 00:00:00') AS alive
FROM (SELECT * FROM raw_comments WHERE raw_comment_id IS NOT NULL AND collected_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw_comment_id ORDER BY arrival_seq) = 1) GROUP BY 1, 2""")
def expired_fingerprints(s, d):
    """What stays of comments when they expire: a fingerprint, and whether the comment itself is still there."""
    c = merging.first_per_key(table(s, d, "raw_comments").where("raw_comment_id is not null and collected_at is not null"), ["raw_comment_id"], "arrival_seq")
    return consensus.fingerprints(c, F.expr("TIMESTAMP '2026-06-20 00:00:00'"), ["raw_comment_id"], ["raw_comment_id", "text"], "collected_at")
