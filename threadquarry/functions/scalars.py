"""Column expressions: targets, token estimates, keyed and stable ids, lenient coercions, URL parts.

Everything stays inside generated code except NFC and case folding, which Spark lacks and which run as Arrow functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT, RECORD = "\u001f", "\u001e"

#: Weights of the strata in the order they are filled, and the order that makes up for short ones.
STRATA = (("top", 35), ("recent", 25), ("replies", 20), ("long_tail", 20))
REFILL = ("long_tail", "recent", "top", "replies")
#: Factors by direction of a video.
DIRECTION_FACTORS = {
    "software_tool": 1.10, "tutorial_workflow": 1.10, "life_service": 1.00, "ecommerce_marketing": 0.90, "entertainment_culture": 0.90, "unknown": 1.00,
}
#: A collector's plural direction names and their singular.
DIRECTION_NAMES = {
    "software_tools": "software_tool", "tutorial_workflow": "tutorial_workflow", "life_services": "life_service",
    "entertainment_culture": "entertainment_culture", "ecommerce_marketing": "ecommerce_marketing",
}


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def comment_scale(n: Column) -> Column:
    """Null stays null; up to 200, up to 2000, above."""
    return F.when(n.isNull(), None).when(n <= 200, "up_to_200").when(n <= 2000, "201_to_2000").otherwise("over_2000")


def collection_target(total: Column) -> Column:
    """How many comments to collect of a stated total; an unknown total asks for 200, a negative one is null."""
    t = total.cast("double")
    quarter = F.least(F.lit(500), F.greatest(F.lit(200), F.ceil(t * F.lit(0.25))))
    root = F.least(F.lit(1000), F.greatest(F.lit(500), F.ceil(F.lit(10.0) * F.sqrt(t))))
    return (
        F.when(total.isNull(), F.lit(200)).when(total < 0, None).when(total <= 200, total).when(total <= 2000, quarter).when(total >= 10000, F.lit(1000)).otherwise(root)
    ).cast("bigint")


def dynamic_target(population: Column, cap: Column, direction: Column, quality: Column) -> Column:
    """Logarithmic coverage of a population under a hard cap; 0 where either is not positive."""
    p = population.cast("double")
    base = F.least(population, F.ceil(F.lit(32.0) + F.lit(14.0) * F.log2(F.greatest(p, F.lit(1.0)))), cap)
    scaled = F.ceil(base.cast("double") * direction * quality)
    return F.when((population <= 0) | (cap <= 0), F.lit(0)).otherwise(F.least(scaled, population, cap)).cast("bigint")


def direction_factor(direction: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DIRECTION_FACTORS.items() for x in kv]), direction), F.lit(1.0))


def direction_name(direction: Column) -> Column:
    """A collector's direction name as profiles spell it; singular names stay, others are unknown."""
    known = DIRECTION_NAMES | {v: v for v in DIRECTION_FACTORS}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), direction), F.lit("unknown"))


def text_tokens(text: Column) -> Column:
    """A tokenizer-free bound: a third of the UTF-8 bytes of the NFC text, at least one; null for null."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(nfc(text)) / F.lit(3.0))).cast("bigint")


def row_tokens(*columns: str) -> Column:
    """``text_tokens`` of a row's canonical JSON: keys sorted, nulls kept, times in UTC."""
    return text_tokens(canonical_json(*columns))


def canonical_json(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def merge_reserve(total: Column) -> Column:
    """The quarter, rounded up, of an input budget that is kept for merging."""
    return F.ceil(total.cast("double") * F.lit(0.25)).cast("bigint")


def output_limit(max_output: Column, max_calls: Column) -> Column:
    return F.when(max_calls == 0, F.lit(0)).otherwise(F.floor(max_output / max_calls)).cast("bigint")


def pseudonym(kind: str, raw_id: Column, secret: bytes) -> Column:
    """Keyed pseudonym ``kind_<32 hex>`` (HMAC-SHA-256 from built-in digests); the secret has 32 bytes at least."""
    if len(secret) < 32:
        raise ValueError("secret too short")
    key = secret if len(secret) <= 64 else __import__("hashlib").sha256(secret).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    message = F.concat(F.lit(kind.encode() + b"\0"), F.encode(raw_id, "UTF-8"))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.when(raw_id.isNotNull(), F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 32)))


def summary_text(summary: Column) -> Column:
    """NFC, with every run of white space made one space and none outside."""
    return F.trim(F.regexp_replace(nfc(summary), r"(?U)[\s\x1c-\x1f]+", " "))


def short_digest(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 24))


def signal_id(comment_id: Column, kind: Column, summary: Column, version: str) -> Column:
    return short_digest("sig_", F.concat_ws(UNIT, comment_id, kind, summary_text(summary), F.lit(version)))


def cluster_id(members: Column, summary: Column, version: str) -> Column:
    return short_digest("clu_", F.concat_ws(RECORD, F.array_join(F.array_sort(members), UNIT), summary_text(summary), F.lit(version)))


def conflict_fields(a: str, b: str, fields: tuple[str, ...] = ("raw_author_id", "text")) -> Column:
    """The identity fields in which rows ``a`` and ``b`` differ, in fixed order; null equals null."""
    return F.filter(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def is_video_author(author: Column, video_author: Column) -> Column:
    return author == video_author


def optional_count(value: Column) -> Column:
    """A non-negative whole number, else null."""
    n = value.try_cast("bigint")
    return F.when(n >= 0, n)


def optional_identifier(value: Column) -> Column:
    """A non-empty id without white space, else null."""
    s = value.cast("string")
    return F.when((F.length(s) > 0) & ~s.rlike(r"(?U)\s"), s)


def from_unix(value: Column) -> Column:
    n = value.try_cast("bigint")
    return F.when(n >= 0, F.timestamp_seconds(n))


def strict_timestamp(value: Column) -> Column:
    """An RFC 3339 string with a zone as an instant, else null."""
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.try_to_timestamp(value))


def known_path(url: Column, hosts: tuple[str, ...]) -> Column:
    """The path, without trailing slash, of an https URL on one of the hosts or below it; null elsewhere."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    on = F.lit(False)
    for h in hosts:
        on = on | (host == h) | host.endswith("." + h)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & on, path)


def one_query_value(url: Column, key: str) -> Column:
    """The value of a query key that occurs exactly once, else null."""
    found = F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit(f"(?:^|&){key}=([^&]*)"), 1)
    return F.when(F.size(found) == 1, found[0])


def page_number(url: Column) -> Column:
    """The page a URL names, by page= or by offset= and count=; 1 without any; null where that is contradictory."""
    page, offset, count = (one_query_value(url, k) for k in ("page", "offset", "count"))
    p, o, c = (x.try_cast("bigint") for x in (page, offset, count))
    by_offset = F.when((o >= 0) & (c >= 1) & (o % c == 0), F.floor(o / c) + 1)
    return (
        F.when(page.isNotNull(), F.when(offset.isNull() & count.isNull() & (p >= 1), p)).when(offset.isNull() & count.isNull(), F.lit(1)).when(offset.isNotNull() & count.isNotNull(), by_offset)
    ).cast("bigint")


def page_url(source: Column, page: Column) -> Column:
    """``source`` asking for a page: page= replaced where it stands, added where it doesn't; page 1 leaves it alone."""
    query = F.try_parse_url(source, F.lit("QUERY"))
    set_page = F.regexp_replace(source, F.lit(r"([?&]page)(=[^&#]*)?(?=&|#|$)"), F.concat(F.lit("$1="), page.cast("string")))
    added = F.regexp_replace(source, F.lit(r"^([^#]*)"), F.concat(F.lit("$1"), F.when(query.isNull(), "?").otherwise("&"), F.lit("page="), page.cast("string")))
    return F.when(page == 1, source).when(source.rlike(r"[?&]page(=|&|#|$)"), set_page).otherwise(added)


def search_url(platform: Column, query: Column, page: Column) -> Column:
    q, n = F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), page.cast("string")
    return F.when(platform == "bilibili", F.concat(F.lit("https://search.bilibili.com/video?keyword="), q, F.lit("&page="), n)).otherwise(
        F.concat(F.lit("https://www.douyin.com/search/"), q, F.lit("?type=general&page="), n))


def is_candidate_page(platform: Column, url: Column) -> Column:
    """Whether a URL is a page that lists candidates: a search or a popular list of its platform."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    b = ((host == "search.bilibili.com") & path.isin("/all", "/video")) | ((host == "www.bilibili.com") & path.startswith("/v/popular/"))
    d = (host == "www.douyin.com") & path.rlike("^/search/.")
    return F.coalesce(F.when(platform == "bilibili", b).when(platform == "douyin", d), F.lit(False))


def douyin_batch(url: Column) -> Column:
    """The page that an answer's offset and count stand for, counted from 1 batch on; null where they name no batch."""
    o, c = (one_query_value(url, k).try_cast("bigint") for k in ("offset", "count"))
    return F.when((c > 0) & (o >= c) & (o % c == 0), F.floor(o / c)).cast("bigint")


def answers_page(platform: Column, url: Column, query: Column, page: Column) -> Column:
    """Whether a candidate answer belongs to the page of a query that was asked for."""
    keyword = F.try_url_decode(one_query_value(url, "keyword"))
    own = F.when(platform == "bilibili", one_query_value(url, "page") == page.cast("string")).otherwise(douyin_batch(url) == page)
    return F.coalesce((keyword == query) & own, F.lit(False))


def source_page_fits(asked: Column, seen: Column, page: Column) -> Column:
    """Whether a page that was reached is the one asked for: the same URL but for what pages it, and the page's number."""
    bare = lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"([?&])(?:page|offset|count)=[^&#]*", "$1"), r"&{2,}", "&"), r"\?&|[?&](?=#|$)", "?")
    plain = lambda u: F.regexp_replace(bare(u), r"\?$", "")
    return F.coalesce((plain(asked) == plain(seen)) & (page_number(seen) == page), F.lit(False))


def safe_file_name(key: Column) -> Column:
    """Whether an id can name a file everywhere."""
    return (
        key.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~key.endswith(".") & ~F.upper(F.substring_index(key, ".", 1)).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    )


def looks_raw(value: Column) -> Column:
    """Ids that look like a platform's own; fixed pattern."""
    return value.rlike(r"(?i)^(?:raw[-_]|BV[0-9A-Za-z]|\d{15,})")
