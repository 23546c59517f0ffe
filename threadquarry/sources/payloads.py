"""Captured platform pages and JSON lines as rows with closed schemas.

A table of payloads has platform, url, page_number and body. JSON is read by declared schemas inside generated code; only the
recursive search for forbidden keys walks parsed JSON in an Arrow function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from threadquarry.functions.scalars import from_unix, known_path, optional_count, optional_identifier

#: Paths of known responses by platform, and keys that a search page must not hold.
RESPONSES = {
    "bilibili": (("bilibili.com",), {"/x/web-interface/view": "video", "/x/v2/reply/wbi/main": "comments", "/x/v2/reply/reply": "replies"}),
    "douyin": (("douyin.com", "iesdouyin.com"), {"/aweme/v1/web/aweme/detail": "video", "/aweme/v1/web/comment/list": "comments", "/aweme/v1/web/comment/list/reply": "replies"}),
}
FORBIDDEN_KEYS = ("comments", "replies", "comment_list", "reply_list")

LINE_FIELDS = {
    "raw_comment_id": "string", "raw_author_id": "string", "raw_parent_comment_id": "string", "text": "string", "published_at": "string", "collected_at": "string",
    "like_count": "bigint", "reply_count": "bigint", "is_video_author": "boolean", "source_stratum": "string", "source_page_or_rank": "bigint",
}


def _struct(fields: str) -> str:
    """``a t, b t`` as ``a: t, b: t`` for a struct inside a schema string (types without top-level commas inside)."""
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split("; ")))


_R = _struct("rpid string; root string; parent string; member struct<mid: string>; content struct<message: string>; ctime bigint; like bigint; rcount bigint")
B_COMMENTS = (
    "code int, data struct<upper: struct<mid: string>, cursor: struct<all_count: bigint, is_end: boolean, next: string>, root: struct<rpid: string>, "
    f"page: struct<count: bigint, num: bigint, size: bigint>, replies: array<struct<{_R}, replies: array<struct<{_R}>>>>>"
)
B_VIDEO = "code int, data struct<bvid: string, owner: struct<mid: string>, title: string, desc: string, pubdate: bigint, duration: bigint, stat: struct<reply: bigint, view: bigint, like: bigint, favorite: bigint, share: bigint>>"
B_CANDIDATES = "code int, data struct<result: array<struct<bvid: string, title: string, review: bigint>>>"
D_COMMENTS = "status_code int, comments array<struct<cid: string, user: struct<uid: string, sec_uid: string>, text: string, reply_id: string, create_time: bigint, digg_count: bigint, reply_comment_total: bigint>>, has_more int, cursor string"
D_VIDEO = "status_code int, aweme_detail struct<aweme_id: string, author: struct<sec_uid: string, uid: string, follower_count: bigint>, desc: string, create_time: bigint, duration: bigint, statistics: struct<comment_count: bigint, play_count: bigint, digg_count: bigint, collect_count: bigint, share_count: bigint>>"
D_CANDIDATES = "status_code int, data array<struct<aweme_info: struct<aweme_id: string, desc: string, statistics: struct<comment_count: bigint>>, type: int, card_unique_name: string>>"


def response_kind(platform: Column, url: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (hosts, paths) in RESPONSES.items():
        path = known_path(url, hosts)
        for p, kind in paths.items():
            out = F.when((platform == name) & (path == p), kind).otherwise(out)
    return out


def read_lines(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON lines of comments: ``df`` plus the fields and ``code``, the first thing wrong with a line (null: good).

    Codes: blank_line, not_json, unknown_field, missing_field, wrong_type, blank_text. Unknown keys are errors: the schema is
    closed. Fields of a faulty line are null.
    """
    o = F.from_json(F.col(body), "struct<" + ", ".join(f"{k}: string" for k in LINE_FIELDS) + ">", {"allowNumericLeadingZeros": "false"})
    typed = df.withColumn("_keys", F.json_object_keys(F.col(body))).withColumn("_o", o)
    named = F.array(*[F.lit(k) for k in LINE_FIELDS])
    wrong = F.lit(False)
    for k, t in LINE_FIELDS.items():
        if t != "string":
            wrong = wrong | (F.col(f"_o.{k}").isNotNull() & F.col(f"_o.{k}").try_cast(t).isNull())
    code = (
        F.when(F.length(F.trim(F.coalesce(F.col(body), F.lit("")))) == 0, "blank_line").when(F.col("_keys").isNull(), "not_json")
        .when(F.size(F.array_except("_keys", named)) > 0, "unknown_field").when(F.size(F.array_except(named, F.col("_keys"))) > 0, "missing_field").when(wrong, "wrong_type")
        .when(F.col("_o.text").isNull() | ~F.col("_o.text").rlike(r"(?U)\S"), "blank_text")
    )
    out = typed.withColumn("code", code)
    return out.select(*df.columns, *[F.when(F.col("code").isNull(), F.col(f"_o.{k}").try_cast(t)).alias(f"l_{k}") for k, t in LINE_FIELDS.items()], "code")


def _text(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def _kept(pages: DataFrame) -> list[str]:
    """Columns of a page table that its rows keep."""
    return [c for c in pages.columns if c not in ("body", "j", "code")]


_SHAPE = "response_shape_changed"


def bilibili_pages(pages: DataFrame) -> DataFrame:
    """Pages of comments: their columns, ``owner``, ``total``, ``has_more``, ``next_cursor`` and ``code``, null for a page that holds to
    its contract: code 0, a list of replies that each have an id and a text, under the asked parent where the page table names
    one (``parent_comment_id``), and a cursor, or a page count, that says whether and where it goes on."""
    p = pages.withColumn("j", F.from_json("body", B_COMMENTS))
    parent = F.col("parent_comment_id") if "parent_comment_id" in pages.columns else F.lit(None).cast("string")
    d = F.col("j.data")
    sound = lambda r: optional_identifier(r["rpid"]).isNotNull() & _text(r["content"]["message"]).isNotNull()
    rooted = lambda r: parent.isNull() | r["root"].isNull() | (r["root"] == parent)
    replies = F.forall(d["replies"], lambda r: sound(r) & rooted(r) & (parent.isNotNull() | r["replies"].isNull() | F.forall(r["replies"], sound)))
    counted = parent.isNotNull() & d["page"].isNotNull()
    pc, pn, ps = (d["page"][x] for x in ("count", "num", "size"))
    more = F.when(counted, pn * ps < pc).otherwise(~d["cursor"]["is_end"])
    cursor = F.when(counted, F.when(pn * ps < pc, (pn + 1).cast("string"))).otherwise(optional_identifier(d["cursor"]["next"]))
    paged = F.when(counted, (pc >= 0) & (pn >= 1) & (ps >= 1)).otherwise(d["cursor"]["is_end"].isNotNull() & (d["cursor"]["is_end"] | cursor.isNotNull()))
    holds = (F.col("j.code") == 0) & replies & (parent.isNull() | d["root"].isNull() | (d["root"]["rpid"] == parent)) & paged
    code = F.when(~F.coalesce(holds, F.lit(False)), _SHAPE)
    good = lambda c: F.when(code.isNull(), c)
    return p.select(*pages.columns, "j", optional_identifier(d["upper"]["mid"]).alias("owner"), optional_count(d["cursor"]["all_count"]).alias("total"), good(more).alias("has_more"), good(cursor).alias("next_cursor"), code.alias("code"))


def context_code(pages: DataFrame) -> Column:
    """Why a page of ``bilibili_pages`` can't name its video's author and total; null where it does."""
    return F.when(F.col("owner").isNull() | F.col("total").isNull() | F.coalesce(F.col("j.code") != 0, F.lit(True)), _SHAPE)


def bilibili_comments(pages: DataFrame) -> DataFrame:
    """Comments and one level of inline replies, in page order: the page's columns, pos, sub_pos (null for the comment itself), ids,
    text, counts, whether the video's author wrote it. Under a ``parent_comment_id`` all are replies. A page that breaks its
    contract gives nothing; ``bilibili_pages`` says so."""
    keep = _kept(pages)
    p = bilibili_pages(pages).where("code is null")
    asked = F.col("parent_comment_id") if "parent_comment_id" in pages.columns else F.lit(None).cast("string")
    top = p.select(*keep, "owner", F.posexplode("j.data.replies").alias("pos", "r"))
    inline = top.where(asked.isNull()).select(*keep, "owner", "pos", F.col("r.rpid").alias("above"), F.posexplode("r.replies").alias("sub_pos", "r"))

    def project(df: DataFrame, parent: Column, sub: Column) -> DataFrame:
        author = optional_identifier(F.col("r.member.mid"))
        return df.select(
            *keep, "pos", sub.cast("int").alias("sub_pos"), optional_identifier(F.col("r.rpid")).alias("raw_comment_id"), author.alias("raw_author_id"), parent.cast("string").alias("raw_parent_comment_id"),
            _text(F.col("r.content.message")).alias("text"), from_unix(F.col("r.ctime")).alias("published_at"), optional_count(F.col("r.like")).alias("like_count"), optional_count(F.col("r.rcount")).alias("reply_count"),
            (author == F.col("owner")).alias("is_video_author"),
        )

    return project(top, F.when(asked.isNotNull(), F.coalesce(optional_identifier(F.col("r.parent")), asked)), F.lit(None)).unionByName(project(inline, F.col("above"), F.col("sub_pos")))


def douyin_pages(pages: DataFrame) -> DataFrame:
    """Pages of comments: their columns, ``has_more``, ``next_cursor`` and ``code``, null for a page that holds to its contract: status
    0, a list of comments with ids, has_more of 0 or 1, and a cursor where it goes on."""
    p = pages.withColumn("j", F.from_json("body", D_COMMENTS))
    cursor = optional_identifier(F.col("j.cursor"))
    sound = F.forall("j.comments", lambda r: optional_identifier(r["cid"]).isNotNull() & r["text"].isNotNull())
    holds = (F.col("j.status_code") == 0) & sound & F.col("j.has_more").isin(0, 1) & ((F.col("j.has_more") == 0) | cursor.isNotNull())
    code = F.when(~F.coalesce(holds, F.lit(False)), _SHAPE)
    return p.select(*pages.columns, "j", F.when(code.isNull(), F.col("j.has_more") == 1).alias("has_more"), F.when(code.isNull(), cursor).alias("next_cursor"), code.alias("code"))


def douyin_comments(pages: DataFrame, owner: str = "video_author") -> DataFrame:
    """Comments of pages that hold to their contract; rows of blank text are dropped. ``pages`` names the video's author in
    ``owner``."""
    keep = _kept(pages)
    rows = douyin_pages(pages).where("code is null").select(*keep, F.posexplode("j.comments").alias("pos", "r")).where(F.col("r.text").rlike(r"(?U)\S"))
    author = F.coalesce(optional_identifier(F.col("r.user.sec_uid")), optional_identifier(F.col("r.user.uid")))
    return rows.select(
        *keep, "pos", F.lit(None).cast("int").alias("sub_pos"), optional_identifier(F.col("r.cid")).alias("raw_comment_id"), author.alias("raw_author_id"),
        optional_identifier(F.col("r.reply_id")).alias("raw_parent_comment_id"), F.col("r.text").alias("text"), from_unix(F.col("r.create_time")).alias("published_at"),
        optional_count(F.col("r.digg_count")).alias("like_count"), optional_count(F.col("r.reply_comment_total")).alias("reply_count"), (author == F.col(owner)).alias("is_video_author"),
    )


_VIDEO = ("raw_video_id", "raw_author_id", "title", "description", "published_at", "duration_seconds", "total_comment_count", "view_count", "like_count", "favorite_count", "share_count", "author_follower_count")


def videos(pages: DataFrame) -> DataFrame:
    """Video rows of either platform's metadata pages; a page that fails or lacks an id, author or title gives none."""
    return video_pages(pages).where("code is null").select("platform", *_VIDEO)


def video_pages(pages: DataFrame) -> DataFrame:
    """Metadata pages: their columns, the video's, and ``code``, null for a page that holds to its contract. A failing page keeps
    its row, with nulls."""
    keep = _kept(pages)
    b = pages.where("platform = 'bilibili'").withColumn("j", F.from_json("body", B_VIDEO)).withColumn("ok", F.col("j.code") == 0)
    d, s = "j.data", "j.data.stat"
    b = b.select(*keep, "ok", *[c.alias(n) for n, c in zip(_VIDEO, (
        optional_identifier(F.col(f"{d}.bvid")), optional_identifier(F.col(f"{d}.owner.mid")), F.col(f"{d}.title"), F.col(f"{d}.desc"), from_unix(F.col(f"{d}.pubdate")), optional_count(F.col(f"{d}.duration")),
        *[optional_count(F.col(f"{s}.{x}")) for x in ("reply", "view", "like", "favorite", "share")], F.lit(None).cast("bigint")))])
    y = pages.where("platform = 'douyin'").withColumn("j", F.from_json("body", D_VIDEO)).withColumn("ok", F.col("j.status_code") == 0)
    d, s = "j.aweme_detail", "j.aweme_detail.statistics"
    y = y.select(*keep, "ok", *[c.alias(n) for n, c in zip(_VIDEO, (
        optional_identifier(F.col(f"{d}.aweme_id")), F.coalesce(optional_identifier(F.col(f"{d}.author.sec_uid")), optional_identifier(F.col(f"{d}.author.uid"))), F.col(f"{d}.desc"), F.col(f"{d}.desc"), from_unix(F.col(f"{d}.create_time")),
        F.floor(optional_count(F.col(f"{d}.duration")) / 1000).cast("bigint"), *[optional_count(F.col(f"{s}.{x}")) for x in ("comment_count", "play_count", "digg_count", "collect_count", "share_count")],
        optional_count(F.col(f"{d}.author.follower_count"))))])
    holds = F.coalesce("ok", F.lit(False)) & F.col("raw_video_id").isNotNull() & F.col("raw_author_id").isNotNull() & _text(F.col("title")).isNotNull()
    both = b.unionByName(y).withColumn("code", F.when(~holds, _SHAPE))
    return both.select(*keep, *[F.when(F.col("code").isNull(), F.col(c)).alias(c) for c in _VIDEO], "code")


def reported_counts(pages: DataFrame) -> DataFrame:
    """(platform, raw_video_id, total_comment_count) of the videos whose metadata page states a count; the largest of several."""
    stated = videos(pages).where("total_comment_count is not null")
    return stated.groupBy("platform", "raw_video_id").agg(F.max("total_comment_count").alias("total_comment_count"))


def candidates(pages: DataFrame) -> DataFrame:
    """Search results with their rank on the page (from 1). Cards and unusable entries are dropped but keep their slot; pages
    that hold comments are refused whole (a video preview's own list is passed over)."""
    safe = pages.where(~holds_forbidden_keys(F.col("body"), F.col("platform") == "douyin"))
    b = safe.where("platform = 'bilibili'").withColumn("j", F.from_json("body", B_CANDIDATES)).where("j.code = 0")
    b = b.select("platform", "page_number", F.posexplode("j.data.result").alias("pos", "r")).select("platform", "page_number", (F.col("pos") + 1).alias("source_rank"), optional_identifier(F.col("r.bvid")).alias("video_key"), F.col("r.title").alias("title"), optional_count(F.col("r.review")).alias("reported_comment_count"))
    d = safe.where("platform = 'douyin'").withColumn("j", F.from_json("body", D_CANDIDATES)).where("j.status_code = 0")
    d = d.select("platform", "page_number", F.posexplode("j.data").alias("pos", "r")).where("r.aweme_info is not null and not (r.aweme_info.desc is null and r.aweme_info.statistics is null)")
    d = d.select("platform", "page_number", (F.col("pos") + 1).alias("source_rank"), optional_identifier(F.col("r.aweme_info.aweme_id")).alias("video_key"), F.col("r.aweme_info.desc").alias("title"), optional_count(F.col("r.aweme_info.statistics.comment_count")).alias("reported_comment_count"))
    return b.unionByName(d).where("video_key is not null and title is not null")


#: What a card of a rendered search page is, and where it names its video and title.
CARD, CARD_TITLE, CARD_KEY = r"(?s)<article\b.*?</article>", r'\btitle="([^"]*)"', r"/video/(BV[0-9A-Za-z]{10})(?![0-9A-Za-z])"


def card_candidates(pages: DataFrame, card: str = CARD, title: str = CARD_TITLE, key: str = CARD_KEY) -> DataFrame:
    """Candidates of rendered pages (platform, page_number, html): a card needs exactly one title and one video key; of several cards
    of a video on a page the first one holds. Ranks count cards, unusable ones included."""
    cards = pages.select("platform", "page_number", F.posexplode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("pos", "c"))
    distinct = lambda pattern: F.array_distinct(F.regexp_extract_all("c", F.lit(pattern), F.lit(1)))
    one = cards.select("platform", "page_number", (F.col("pos") + 1).alias("source_rank"), distinct(title).alias("t"), distinct(key).alias("k")).where((F.size("t") == 1) & (F.size("k") == 1))
    plain = F.col("t")[0]
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    named = one.select("platform", "page_number", "source_rank", F.col("k")[0].alias("video_key"), _text(plain).alias("title")).where("title is not null")
    return named.groupBy("platform", "page_number", "video_key").agg(F.min_by(F.struct("source_rank", "title"), "source_rank").alias("r")).select("platform", "page_number", "video_key", "r.*")


@F.pandas_udf(BooleanType())
def holds_forbidden_keys(body: pd.Series, preview: pd.Series) -> pd.Series:
    """Whether a JSON text has a forbidden key at any depth; with ``preview``, data[i].aweme_info.comment_list is allowed.
    What is no JSON holds none."""

    def walk(v, path, allow) -> bool:
        if isinstance(v, dict):
            for k, x in v.items():
                if k.lower() in FORBIDDEN_KEYS:
                    if not (allow and k == "comment_list" and len(path) == 3 and path[0] == "data" and path[1] == 0 and path[2] == "aweme_info"):
                        return True
                elif walk(x, (*path, k), allow):
                    return True
        elif isinstance(v, list):
            return any(walk(x, (*path, 0), allow) for x in v)
        return False

    def one(text, allow) -> bool:
        try:
            return walk(json.loads(text), (), bool(allow))
        except (TypeError, ValueError, RecursionError):
            return False

    return pd.Series([one(t, a) for t, a in zip(body, preview)])
