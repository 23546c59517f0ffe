"""SQL of the core queries, written independently of the operators."""

from __future__ import annotations

_TARGET = """CASE WHEN t IS NULL THEN 200 WHEN t < 0 THEN NULL WHEN t <= 200 THEN t
  WHEN t <= 2000 THEN least(500, greatest(200, ceil(t * 0.25::DOUBLE))) WHEN t >= 10000 THEN 1000
  ELSE least(1000, greatest(500, ceil(10 * sqrt(t)))) END::BIGINT"""

_QUALITY = """q0 AS (SELECT *, least(collected_total::DOUBLE / greatest(collection_target, 1), 1.0) AS completion,
    pages_succeeded::DOUBLE / greatest(pages_requested, 1) AS page_rate, author_id_present::DOUBLE / greatest(collected_total, 1) AS author_rate,
    CASE WHEN sampling_schema_version = '1.1' AND exact_duplicate_count IS NOT NULL
      THEN (exact_duplicate_count + normalized_duplicate_count)::DOUBLE / greatest(collected_total, 1) END AS duplicate_rate FROM sampling_manifests),
q AS (SELECT *, CASE WHEN completion >= 0.9 AND page_rate >= 0.9 AND author_rate >= 0.8 AND duplicate_rate <= 0.25 AND distinct_author_count >= 3 THEN 'usable'
    WHEN completion >= 0.6 AND page_rate >= 0.6 AND author_rate >= 0.5 AND len(available_strata) >= 2 AND distinct_author_count >= 3 THEN 'degraded'
    ELSE 'insufficient' END AS status FROM q0)"""


def _dynamic(cap: int) -> str:
    return f"""CASE WHEN pop <= 0 THEN 0 ELSE least(ceil(least(pop, ceil(32 + 14 * log2(greatest(pop, 1)::DOUBLE)), {cap})::DOUBLE * df * qf), pop, {cap}) END::BIGINT"""


_POP = """SELECT *, coalesce(reported_total, len(candidate_comment_ids)) AS pop, CASE WHEN status = 'degraded' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS qf,
  CASE direction WHEN 'software_tool' THEN 1.1::DOUBLE WHEN 'tutorial_workflow' THEN 1.1::DOUBLE WHEN 'ecommerce_marketing' THEN 0.9::DOUBLE
    WHEN 'entertainment_culture' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS df FROM q"""

_PAYLOAD = "hash(raw_author_id, raw_parent_comment_id, text, published_at, collected_at, like_count, reply_count, is_video_author, source_stratum, source_page_or_rank)"


def _run(source: str, where: str = "true") -> str:
    return f"""(SELECT platform, raw_video_id, raw_comment_id, arg_min(arrival_seq, arrival_seq) AS arrival_seq, arg_min(coalesce(raw_author_id, chr(1)), arrival_seq) AS au, arg_min(coalesce(text, chr(1)), arrival_seq) AS tx,
  count(DISTINCT (coalesce(raw_author_id, chr(1)), coalesce(text, chr(1)))) > 1 AS conflict, count(*) - count(DISTINCT {_PAYLOAD}) AS exact_duplicates
  FROM {source} WHERE {where} GROUP BY ALL)"""


_RUNS = f"""WITH prev AS MATERIALIZED (SELECT * FROM {_run('raw_comments', "collected_at < TIMESTAMP '2026-06-15 00:00:00'")} WHERE NOT conflict),
cur AS MATERIALIZED (SELECT * FROM {_run('raw_comments', "collected_at >= TIMESTAMP '2026-06-15 00:00:00'")} WHERE NOT conflict),
both_ AS MATERIALIZED (SELECT coalesce(p.platform, c.platform) AS platform, coalesce(p.raw_video_id, c.raw_video_id) AS raw_video_id, coalesce(p.raw_comment_id, c.raw_comment_id) AS raw_comment_id,
  p.arrival_seq AS pa, c.arrival_seq AS ca, p.au IS DISTINCT FROM c.au AS da, p.tx IS DISTINCT FROM c.tx AS dt
  FROM prev p FULL JOIN cur c ON p.platform = c.platform AND p.raw_video_id = c.raw_video_id AND p.raw_comment_id = c.raw_comment_id)
"""

_FIRSTS = "firsts AS MATERIALIZED (SELECT * FROM raw_comments QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id, raw_comment_id ORDER BY arrival_seq) = 1)"

_RECORDS = """rec AS MATERIALIZED (SELECT * FROM evaluation_records WHERE video_id IS NOT NULL AND comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, comment_id
  ORDER BY predicted_signal NULLS FIRST, gold_signal NULLS FIRST, predicted_cluster_id NULLS FIRST, gold_cluster_id NULLS FIRST, adjudication NULLS FIRST, reference_status NULLS FIRST, reference_accepted NULLS FIRST) = 1)"""

_PAIRS = """und AS (SELECT * FROM rec WHERE adjudication IS NULL OR adjudication <> 'disputed_pending'),
pp AS (SELECT a.video_id, count(*) AS n FROM und a JOIN und b ON a.video_id = b.video_id AND a.comment_id < b.comment_id AND a.predicted_cluster_id = b.predicted_cluster_id GROUP BY 1),
gp AS (SELECT a.video_id, count(*) AS n FROM und a JOIN und b ON a.video_id = b.video_id AND a.comment_id < b.comment_id AND a.gold_cluster_id = b.gold_cluster_id GROUP BY 1),
mp AS (SELECT a.video_id, count(*) AS n FROM und a JOIN und b ON a.video_id = b.video_id AND a.comment_id < b.comment_id AND a.gold_cluster_id = b.gold_cluster_id AND a.predicted_cluster_id = b.predicted_cluster_id GROUP BY 1)"""

_CONSENSUS = f"""WITH {_RECORDS},
mem AS (SELECT DISTINCT video_id, predicted_cluster_id AS cluster_id, comment_id FROM rec WHERE predicted_cluster_id IS NOT NULL),
com AS MATERIALIZED (SELECT raw_video_id AS video_id, raw_comment_id AS comment_id, raw_author_id AS author_id, collected_at AS first_collected_at FROM raw_comments
  QUALIFY row_number() OVER (PARTITION BY raw_video_id, raw_comment_id ORDER BY arrival_seq) = 1),
auth AS (SELECT raw_video_id AS video_id, arg_min(raw_author_id, arrival_seq) FILTER (WHERE raw_author_id IS NOT NULL) AS x FROM raw_comments GROUP BY 1),
com2 AS MATERIALIZED (SELECT raw_video_id AS video_id, raw_comment_id AS comment_id, arg_min(raw_author_id, arrival_seq) AS author_id, arg_min(collected_at, arrival_seq) AS first_collected_at FROM raw_comments GROUP BY ALL),
own AS (SELECT raw_video_id AS video_id, max(raw_author_id) FILTER (WHERE raw_author_id NOT IN ('0', 'unknown')) AS owner FROM raw_videos WHERE raw_video_id IS NOT NULL GROUP BY 1),
ev AS (SELECT m.video_id, m.cluster_id, c.author_id, c.comment_id, row_number() OVER (PARTITION BY m.video_id, m.cluster_id, c.author_id ORDER BY c.first_collected_at, c.comment_id) AS r
  FROM mem m JOIN com2 c USING (video_id, comment_id) JOIN own o USING (video_id) WHERE c.author_id IS NOT NULL AND o.owner IS NOT NULL AND c.author_id <> o.owner)
"""

_BATCH = """held AS (SELECT plan_id, item_id, estimated_input_tokens AS tokens FROM batch_items WHERE plan_id IS NOT NULL AND item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY plan_id, item_id ORDER BY estimated_at DESC NULLS LAST, estimated_input_tokens DESC NULLS LAST) = 1),
pl AS (SELECT plan_id, least(per_call_input_limit, signal_input_limit) AS lim, signal_input_limit AS budget, coalesce(fixed_input_tokens, 0) AS fx FROM batch_plans),
it AS MATERIALIZED (SELECT h.plan_id, item_id, tokens, lim, budget, fx, row_number() OVER (PARTITION BY h.plan_id ORDER BY item_id) AS r FROM held h JOIN pl USING (plan_id) WHERE tokens > 0),
walk AS (SELECT plan_id, item_id, tokens, lim, fx, r, 0::BIGINT AS batch, fx + tokens AS used FROM it WHERE r = 1
  UNION ALL SELECT i.plan_id, i.item_id, i.tokens, i.lim, i.fx, i.r, CASE WHEN w.used + i.tokens > i.lim THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.used + i.tokens > i.lim THEN i.fx + i.tokens ELSE w.used + i.tokens END FROM walk w JOIN it i ON i.plan_id = w.plan_id AND i.r = w.r + 1),
su AS (SELECT plan_id, max(tokens) AS largest, sum(tokens) AS total FROM it GROUP BY 1),
us AS (SELECT plan_id, max(batch) + 1 AS nb, sum(tokens) + max(fx) * (max(batch) + 1) AS used FROM walk GROUP BY 1),
st AS (SELECT pl.plan_id, CASE WHEN su.plan_id IS NULL THEN 'empty' WHEN fx + largest > lim THEN 'item_exceeds_call' WHEN total + fx <= budget AND nb > 63 THEN 'calls_exhausted'
  WHEN used > budget THEN 'budget_exhausted' ELSE 'planned' END AS status FROM pl LEFT JOIN su USING (plan_id) LEFT JOIN us USING (plan_id))"""

_LABELS = "held AS MATERIALIZED (SELECT * FROM comment_labels QUALIFY row_number() OVER (PARTITION BY video_id, annotator_id, comment_id ORDER BY labelled_at DESC NULLS LAST, label_seq DESC) = 1)"

_FOLD = """
-- Greedy fold as recursion over eight steps: four quotas, four refills; a step's state is the set of ids taken so far.
"""


def _fold_ctes(scope: str, order: str, quota: dict[str, str]) -> str:
    """pool(scope, stratum, id, o..) and tgt(scope, target) to steps s1..s8(scope, stratum, id)."""
    steps = [("top", quota["top"]), ("recent", quota["recent"]), ("replies", quota["replies"]), ("long_tail", quota["long_tail"]), ("long_tail", "target"), ("recent", "target"), ("top", "target"), ("replies", "target")]
    out, taken = [], None
    for n, (stratum, most) in enumerate(steps, 1):
        anti = f"ANTI JOIN {taken} USING ({scope}, id)" if taken else ""
        used = f"LEFT JOIN (SELECT {scope}, count(*) AS n FROM {taken} GROUP BY ALL) u USING ({scope})" if taken else ""
        have = "coalesce(u.n, 0)" if taken else "0"
        out.append(f"c{n} AS MATERIALIZED (SELECT {scope}, id, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) AS r FROM (SELECT * FROM pool WHERE stratum = '{stratum}') {anti})")
        out.append(f"s{n} AS MATERIALIZED (SELECT {scope}, '{stratum}' AS stratum, id FROM c{n} JOIN tq USING ({scope}) {used} WHERE r <= {most} AND r <= target - {have})")
        new = f"t{n}"
        out.append(f"{new} AS MATERIALIZED (SELECT * FROM s{n}" + (f" UNION ALL SELECT * FROM {taken})" if taken else ")"))
        taken = new
    return ",\n".join(out)


_W = {"top": 35, "recent": 25, "replies": 20, "long_tail": 20}
_ALPHA = sorted(_W)
_ORDER = list(_W)


def _quotas(source: str, whole: bool) -> str:
    """Largest remainder over a table with ``target``, as extra columns q_*."""
    lines = []
    for s, w in _W.items():
        f, r = (f"target * {w} // 100", f"target * {w} % 100") if whole else (f"floor(target * {w / 100}::DOUBLE)", f"target * {w / 100}::DOUBLE - floor(target * {w / 100}::DOUBLE)")
        lines.append(f"{f} AS f_{s}, {r} AS r_{s}")
    tie = _ALPHA if whole else _ORDER
    cols = []
    for s in _W:
        ahead = " + ".join(f"(r_{o} > r_{s} OR (r_{o} = r_{s} AND {tie.index(o) < tie.index(s)}))::INT" for o in _W if o != s)
        cols.append(f"(f_{s} + CASE WHEN {ahead} < target - f_top - f_recent - f_replies - f_long_tail THEN 1 ELSE 0 END)::BIGINT AS q_{s}")
    return f"(SELECT *, {', '.join(cols)} FROM (SELECT *, {', '.join(lines)} FROM {source}))"


_QSRC = "(SELECT DISTINCT target_count AS target FROM sampling_targets WHERE target_count IS NOT NULL UNION SELECT unnest(range(0, 1001)))"
_QSEL = ", ".join(f"q_{s} AS {s}" for s in _W)
_FOLD_Q = {s: f"q_{s}" for s in _W}


def _split(rounding: str, special: bool) -> str:
    dev, cal = "ceil(n * 0.4::DOUBLE)", f"{rounding}(n * 0.3::DOUBLE)"
    if special:
        dev, cal = f"CASE WHEN n = 24 THEN 10 ELSE {dev} END", f"CASE WHEN n = 24 THEN 7 ELSE {cal} END"
    return f"""WITH v AS (SELECT DISTINCT raw_video_id AS video_id FROM raw_videos WHERE raw_video_id IS NOT NULL),
r AS (SELECT video_id, row_number() OVER (ORDER BY sha256(video_id), video_id) AS r, count(*) OVER () AS n FROM v)
SELECT video_id, CASE WHEN r <= {dev} THEN 'development' WHEN r <= {dev} + {cal} THEN 'calibration' ELSE 'holdout' END AS split FROM r"""


_KEY = b"0123456789abcdef0123456789abcdef".ljust(64, b"\0")
_PADS = [bytes(b ^ x for b in _KEY).hex() for x in (0x36, 0x5C)]

_SPACE = r"'[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"



def _pseudonym(kind: str, column: str) -> str:
    """Keyed digest by hand: two nested digests over the padded key."""
    return f"'{kind}_' || left(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode('{kind}') || '\\x00'::BLOB || encode({column})))), 32)"


SQL = {
    "ref_video_urls": """SELECT capture_seq, CASE WHEN platform = 'bilibili' THEN 'https://search.bilibili.com/video?keyword=' || e || '&page=' || (p + 1) ELSE 'https://www.douyin.com/search/' || e || '?type=general&page=' || (p + 1) END AS next_url,
  (p + 1)::BIGINT AS page, CASE WHEN platform = 'bilibili' THEN '/video' ELSE '/search/' || e END AS path
FROM (SELECT capture_seq, platform, url_encode(title) AS e, capture_seq % 7 + 1 AS p FROM raw_videos WHERE platform IS NOT NULL AND title IS NOT NULL)""",
    "ref_prepared_splits": f"""WITH v AS (SELECT DISTINCT {_pseudonym('video', 'raw_video_id')} AS video_id FROM raw_comments
  SEMI JOIN (SELECT platform, raw_video_id FROM raw_videos WHERE platform = 'bilibili') USING (platform, raw_video_id)),
r AS (SELECT video_id, row_number() OVER (ORDER BY sha256(video_id), video_id) AS r, count(*) OVER () AS n FROM v)
SELECT video_id, CASE WHEN r <= CASE WHEN n = 24 THEN 10 ELSE ceil(n * 0.4::DOUBLE) END THEN 'development'
  WHEN r <= CASE WHEN n = 24 THEN 17 ELSE ceil(n * 0.4::DOUBLE) + floor(n * 0.3::DOUBLE) END THEN 'calibration' ELSE 'holdout' END AS split FROM r""",
    "ref_comment_scale": "SELECT capture_seq, CASE WHEN total_comment_count <= 200 THEN 'up_to_200' WHEN total_comment_count <= 2000 THEN '201_to_2000' WHEN total_comment_count > 2000 THEN 'over_2000' END AS comment_scale FROM raw_videos",
    "ref_collection_target": f"SELECT capture_seq, {_TARGET} AS target FROM (SELECT capture_seq, total_comment_count AS t FROM raw_videos)",
    "ref_quality": f"WITH {_QUALITY} SELECT manifest_id, completion, page_rate, author_rate, duplicate_rate, status FROM q",
    "ref_dynamic_target": f"WITH {_QUALITY} SELECT manifest_id, {_dynamic(200)} AS target FROM ({_POP})",
    "ref_text_tokens": "SELECT arrival_seq, greatest(1, ceil(strlen(nfc_normalize(text)) / 3.0::DOUBLE))::BIGINT AS tokens FROM raw_comments WHERE text IS NOT NULL",
    "ref_input_split": "SELECT plan_id, ceil(t * 0.25::DOUBLE)::BIGINT AS merge_tokens, (t - ceil(t * 0.25::DOUBLE))::BIGINT AS signal_tokens, (t // 8)::BIGINT AS per_call FROM (SELECT plan_id, signal_input_limit + merge_input_reserve AS t FROM batch_plans)",
    "ref_active_comments": "SELECT arrival_seq FROM raw_comments WHERE collected_at <= TIMESTAMP '2026-06-20 00:00:00' AND TIMESTAMP '2026-06-20 00:00:00' < collected_at + INTERVAL 10 DAY",
    "ref_safe_names": r"SELECT DISTINCT raw_video_id, regexp_full_match(raw_video_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AND NOT raw_video_id LIKE '%.' AND NOT regexp_full_match(upper(split_part(raw_video_id, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') AS safe, regexp_matches(raw_video_id, '^(?:raw[-_]|BV[0-9A-Za-z]|\d{15,})', 'i') AS raw FROM raw_videos",
    "ref_response_kinds": """WITH u AS (SELECT capture_seq, platform, capture_seq % 7 AS k, ['https://api.bilibili.com/x/v2/reply/wbi/main/?oid=', 'https://www.douyin.com/aweme/v1/web/aweme/detail?id=', 'http://api.bilibili.com/x/v2/reply/reply?id=',
  'https://notbilibili.com/x/v2/reply/reply?id=', 'https://www.douyin.com/aweme/v1/web/comment/list/reply/?id=', 'https://api.bilibili.com/x/web-interface/view?id=', 'https://api.bilibili.com/x/v2/reply/other?id='][k + 1] || capture_seq AS url FROM raw_videos)
SELECT capture_seq, platform, url, CASE WHEN platform = 'bilibili' THEN CASE k WHEN 0 THEN 'comments' WHEN 5 THEN 'video' END WHEN platform = 'douyin' THEN CASE k WHEN 1 THEN 'video' WHEN 4 THEN 'replies' END END AS kind FROM u""",
    "ref_pseudonyms": f"SELECT DISTINCT raw_author_id, {_pseudonym('author', 'raw_author_id')} AS author_id FROM raw_comments WHERE raw_author_id IS NOT NULL",
    "ref_profiles": f"""WITH r AS (SELECT platform, raw_video_id, sum(exact_duplicates) AS ex FROM {_run('raw_comments')} GROUP BY 1, 2), {_FIRSTS},
st AS (SELECT platform, raw_video_id, string_agg(source_stratum || '=' || n, ',' ORDER BY source_stratum) AS strata FROM (SELECT platform, raw_video_id, source_stratum, count(*) AS n FROM firsts WHERE source_stratum IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT f.platform, f.raw_video_id, (count(*) + max(r.ex))::BIGINT AS collected_total, count(raw_author_id) AS author_id_present, count(DISTINCT raw_author_id) AS distinct_author_count, max(st.strata) AS strata, max(r.ex)::BIGINT AS exact_duplicate_count,
  (count(text) - count(DISTINCT trim(regexp_replace(lower(text), {_SPACE}, ' ', 'g'))))::BIGINT AS normalized_duplicate_count
FROM firsts f JOIN r USING (platform, raw_video_id) LEFT JOIN st USING (platform, raw_video_id) GROUP BY 1, 2""",
    "ref_row_tokens": """SELECT arrival_seq, greatest(1, ceil(strlen(nfc_normalize(to_json({'like_count': like_count, 'raw_comment_id': raw_comment_id, 'raw_parent_comment_id': raw_parent_comment_id, 'text': text})::VARCHAR)) / 3.0::DOUBLE))::BIGINT AS tokens FROM raw_comments""",
    "ref_signal_ids": f"SELECT label_seq, 'sig_' || left(sha256(concat_ws(chr(31), comment_id, signal_kind, trim(regexp_replace(nfc_normalize(normalized_need), {_SPACE}, ' ', 'g')), 'v1')), 24) AS signal_id FROM comment_labels WHERE normalized_need IS NOT NULL AND signal_kind IS NOT NULL",
    "ref_cluster_ids": "SELECT video_id, predicted_cluster_id, 'clu_' || left(sha256(concat_ws(chr(30), array_to_string(list_sort(list(DISTINCT comment_id)), chr(31)), predicted_cluster_id, 'v1')), 24) AS cluster_id FROM evaluation_records WHERE predicted_cluster_id IS NOT NULL AND comment_id IS NOT NULL GROUP BY 1, 2",
    "ref_merged_run": f"SELECT platform, raw_video_id, raw_comment_id, arrival_seq, conflict, exact_duplicates FROM {_run('raw_comments')}",
    "ref_upserted": _RUNS + "SELECT platform, raw_video_id, raw_comment_id, CASE WHEN pa IS NULL THEN ca WHEN ca IS NULL OR da OR dt THEN pa ELSE ca END AS arrival_seq FROM both_",
    "ref_upsert_conflicts": _RUNS + "SELECT platform, raw_video_id, raw_comment_id, concat_ws(',', CASE WHEN da THEN 'raw_author_id' END, CASE WHEN dt THEN 'text' END) AS fields FROM both_ WHERE pa IS NOT NULL AND ca IS NOT NULL AND (da OR dt)",
    "ref_duplicate_provenance": _RUNS + """, acc AS (SELECT * FROM both_ WHERE ca IS NOT NULL AND NOT (pa IS NOT NULL AND (da OR dt))),
obs AS (SELECT r.platform, r.raw_video_id, count(*) - count(DISTINCT r.raw_comment_id) AS rep FROM raw_comments r JOIN acc USING (platform, raw_video_id, raw_comment_id) WHERE r.collected_at >= TIMESTAMP '2026-06-15 00:00:00' GROUP BY ALL),
ag AS (SELECT platform, raw_video_id, count(pa) AS again FROM acc GROUP BY ALL),
m AS (SELECT platform, video_id AS raw_video_id, arg_min(exact_duplicate_count, manifest_id) AS p, true AS k FROM sampling_manifests GROUP BY ALL),
m2 AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE false)
SELECT platform, raw_video_id, (CASE WHEN k IS NULL THEN rep + again ELSE p + rep + again END)::BIGINT AS exact_duplicate_count FROM obs JOIN ag USING (platform, raw_video_id) LEFT JOIN m2 USING (platform, raw_video_id)""",
    "ref_first_captures": "SELECT platform, raw_video_id, capture_seq, title FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1",
    "ref_normalized_duplicates": f"WITH {_FIRSTS} SELECT platform, raw_video_id, (count(*) - count(DISTINCT trim(regexp_replace(lower(text), {_SPACE}, ' ', 'g'))))::BIGINT AS normalized_duplicate_count FROM firsts WHERE text IS NOT NULL GROUP BY ALL",
    "ref_exclusions": "SELECT manifest_id, CASE WHEN collected_total = 0 THEN 'no_comments' WHEN pages_succeeded = 0 THEN 'no_successful_pages' END AS reason FROM sampling_manifests",
    "ref_platform_results": "SELECT platform, bool_or(pages_succeeded = 0) AS stopped, count(*) FILTER (WHERE pages_succeeded = pages_requested) AS successes, bool_and(pages_succeeded = pages_requested) AS success FROM sampling_manifests GROUP BY 1",
    "ref_quotas_whole": f"SELECT target, {_QSEL} FROM {_quotas(_QSRC, True)}",
    "ref_quotas_double": f"SELECT target, {_QSEL} FROM {_quotas(_QSRC, False)}",
    "ref_selected_comments": f"WITH {_FIRSTS}, pool AS MATERIALIZED (SELECT platform, raw_video_id, source_stratum AS stratum, raw_comment_id AS id, coalesce(source_page_or_rank, 1::BIGINT << 40) AS o FROM firsts WHERE raw_comment_id IS NOT NULL),\n"
    + f"vid AS (SELECT platform, raw_video_id, total_comment_count AS t FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1),\ntgt AS (SELECT platform, raw_video_id, {_TARGET} AS target FROM vid WHERE {_TARGET} IS NOT NULL),\n"
    + f"tq AS MATERIALIZED (SELECT * FROM {_quotas('tgt', True)}),\n" + _fold_ctes("platform, raw_video_id", "o, id", _FOLD_Q) + "\nSELECT platform, raw_video_id, stratum, id AS raw_comment_id FROM t8",
    "ref_sampling_plan": f"WITH {_QUALITY}, ok AS MATERIALIZED (SELECT manifest_id, stratum_comment_ids, {_dynamic(200)} AS t FROM ({_POP}) WHERE status <> 'insufficient'),\n"
    + "pool AS MATERIALIZED (SELECT DISTINCT manifest_id, e.key AS stratum, unnest(e.value) AS id FROM (SELECT manifest_id, unnest(map_entries(stratum_comment_ids)) AS e FROM ok)),\n"
    + "tgt AS (SELECT manifest_id, least(t, n) AS target FROM ok JOIN (SELECT manifest_id, count(DISTINCT id) AS n FROM pool GROUP BY 1) USING (manifest_id)),\n"
    + f"tq AS MATERIALIZED (SELECT * FROM {_quotas('tgt', False)}),\n" + _fold_ctes("manifest_id", "id", _FOLD_Q) + "\nSELECT manifest_id, stratum, id AS comment_id FROM t8",
    "ref_evaluation_split": _split("ceil", False),
    "ref_dataset_split": _split("floor", True),
    "ref_coverage": """WITH v AS (SELECT *, CASE WHEN total_comment_count <= 200 THEN 'up_to_200' WHEN total_comment_count <= 2000 THEN '201_to_2000' WHEN total_comment_count > 2000 THEN 'over_2000' END AS cs
  FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1),
w AS (SELECT * FROM (VALUES ('platform', 'bilibili', 12), ('platform', 'douyin', 12), ('comment_scale', 'up_to_200', 8), ('comment_scale', '201_to_2000', 8), ('comment_scale', 'over_2000', 8)) t(dimension, value, expected))
SELECT * FROM (SELECT dimension, value, expected::BIGINT AS expected, CASE WHEN dimension = 'platform' THEN (SELECT count(*) FROM v WHERE platform = value) ELSE (SELECT count(*) FROM v WHERE cs = value) END AS actual FROM w
  UNION ALL SELECT 'total', '*', 24, (SELECT count(*) FROM v)) WHERE expected <> actual""",
    "ref_suggestions": """SELECT raw_video_id, capture_seq, CASE WHEN total_comment_count IS NULL THEN 2 WHEN total_comment_count > 2000 THEN 0 ELSE 1 END::BIGINT AS priority FROM raw_videos
WHERE raw_video_id IS NOT NULL AND raw_video_id NOT IN (SELECT unnest(development) FROM dataset_splits) QUALIFY row_number() OVER (PARTITION BY raw_video_id ORDER BY capture_seq) = 1""",
    "ref_skipped": """SELECT manifest_id, coalesce(max((pages_succeeded < pages_requested * 0.7::DOUBLE)::INT) OVER (PARTITION BY platform ORDER BY manifest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped
FROM sampling_manifests WHERE platform IS NOT NULL""",
    "ref_page_ranks": "SELECT arrival_seq, CASE WHEN source_page_or_rank IS NOT NULL AND source_stratum IS NOT NULL THEN dense_rank() OVER (PARTITION BY platform, raw_video_id, source_stratum ORDER BY source_page_or_rank) END AS page_rank FROM raw_comments",
    "ref_discovered": """WITH f AS (SELECT platform, raw_video_id, capture_seq, capture_seq // 20 AS page FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1),
t AS (SELECT * FROM f ORDER BY page, capture_seq LIMIT 50)
SELECT platform, raw_video_id, capture_seq, (SELECT count(DISTINCT capture_seq // 20) FROM raw_videos WHERE capture_seq // 20 <= (SELECT max(page) FROM t)) AS pages FROM t""",
    "ref_reported_counts": """SELECT v.capture_seq, CASE WHEN v.platform = 'bilibili' AND v.total_comment_count IS NULL THEN k.f ELSE v.total_comment_count END AS total FROM raw_videos v
LEFT JOIN (SELECT raw_video_id, max(total_comment_count) AS f FROM raw_videos WHERE platform = 'bilibili' GROUP BY 1) k USING (raw_video_id)""",
    "ref_duplicate_records": "SELECT video_id, comment_id, count(*) AS rows FROM evaluation_records GROUP BY 1, 2 HAVING count(*) > 1",
    "ref_cluster_pairs": f"""WITH {_RECORDS}, {_PAIRS}, v AS (SELECT DISTINCT video_id FROM und WHERE predicted_cluster_id IS NOT NULL OR gold_cluster_id IS NOT NULL)
SELECT video_id, coalesce(pp.n, 0) AS predicted_pairs, coalesce(gp.n, 0) AS gold_pairs, coalesce(mp.n, 0) AS matched_pairs FROM v LEFT JOIN pp USING (video_id) LEFT JOIN gp USING (video_id) LEFT JOIN mp USING (video_id)""",
    "ref_evaluation_report": f"""WITH {_RECORDS}, {_PAIRS}, s AS (SELECT count(*) FILTER (WHERE coalesce(adjudication, '') <> 'disputed_pending') AS sample_count, count(*) FILTER (WHERE coalesce(adjudication, '') = 'disputed_pending') AS disputed_pending_count,
  count(*) FILTER (WHERE coalesce(adjudication, '') <> 'disputed_pending' AND predicted_signal) AS predicted_positive_count,
  count(*) FILTER (WHERE coalesce(adjudication, '') <> 'disputed_pending' AND predicted_signal AND gold_signal) AS tp,
  count(*) FILTER (WHERE reference_accepted AND coalesce(reference_status, '') <> 'valid') AS accepted_forged FROM rec),
p AS (SELECT (SELECT coalesce(sum(n), 0) FROM pp)::BIGINT AS predicted_pairs, (SELECT coalesce(sum(n), 0) FROM gp)::BIGINT AS gold_pairs, (SELECT coalesce(sum(n), 0) FROM mp)::BIGINT AS matched_pairs),
r AS (SELECT *, coalesce(tp / nullif(predicted_positive_count, 0)::DOUBLE, 0) AS signal_precision, coalesce(matched_pairs / nullif(predicted_pairs, 0)::DOUBLE, 0) AS cluster_precision, coalesce(matched_pairs / nullif(gold_pairs, 0)::DOUBLE, 0) AS cluster_recall FROM s, p)
SELECT sample_count, disputed_pending_count, predicted_positive_count, signal_precision, accepted_forged, predicted_pairs, gold_pairs, matched_pairs, cluster_precision, cluster_recall,
  signal_precision >= 0.9 AND cluster_precision >= 0.9 AND cluster_recall >= 0.75 AND accepted_forged = 0 AS all_gates_passed FROM r""",
    "ref_consensus_evidence": _CONSENSUS + "SELECT video_id, cluster_id, author_id, comment_id FROM ev WHERE r = 1",
    "ref_consensus_decisions": _CONSENSUS + """, n AS (SELECT video_id, cluster_id, count(*) AS authors FROM ev WHERE r = 1 GROUP BY ALL),
k AS (SELECT m.video_id, m.cluster_id, bool_or(c.comment_id IS NULL) AS lost FROM mem m LEFT JOIN com2 c USING (video_id, comment_id) GROUP BY ALL),
r AS (SELECT k.video_id, k.cluster_id, coalesce(n.authors, 0) AS authors, CASE WHEN lost THEN 'cluster_references_unknown_comment' WHEN o.owner IS NULL THEN 'video_author_unknown'
  WHEN coalesce(n.authors, 0) < 3 THEN 'insufficient_independent_authors' ELSE 'independent_author_threshold_met' END AS reason_code
  FROM k LEFT JOIN n USING (video_id, cluster_id) LEFT JOIN own o USING (video_id))
SELECT *, reason_code = 'independent_author_threshold_met' AS passed FROM r""",
    "ref_cache_expiry": _CONSENSUS + "SELECT video_id, cluster_id, epoch_us(min(first_collected_at) + INTERVAL 10 DAY)::BIGINT AS expires_us FROM mem JOIN com2 USING (video_id, comment_id) GROUP BY ALL",
    "ref_batch_status": f"WITH RECURSIVE {_BATCH} SELECT plan_id, status FROM st",
    "ref_batches": f"""WITH RECURSIVE {_BATCH} SELECT plan_id, batch, count(*) AS items, sum(tokens)::BIGINT AS tokens,
  'batch_' || left(sha256(plan_id || chr(31) || string_agg(item_id::VARCHAR, chr(31) ORDER BY item_id)), 24) AS batch_id FROM walk SEMI JOIN (SELECT plan_id FROM st WHERE status = 'planned') USING (plan_id) GROUP BY plan_id, batch""",
    "ref_cover_violations": f"""WITH {_RECORDS}, i AS (SELECT DISTINCT video_id, comment_id FROM rec WHERE gold_cluster_id IS NOT NULL), c AS (SELECT * FROM rec WHERE predicted_cluster_id IS NOT NULL)
SELECT DISTINCT video_id AS batch_id, 'unknown' AS code FROM c ANTI JOIN i USING (video_id, comment_id)
UNION ALL SELECT DISTINCT video_id, 'omitted' FROM i ANTI JOIN c USING (video_id, comment_id)
UNION ALL SELECT DISTINCT video_id, 'split' FROM (SELECT video_id, gold_cluster_id FROM c WHERE gold_cluster_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT predicted_cluster_id) > 1)""",
    "ref_label_completeness": f"""WITH {_LABELS} SELECT video_id, annotator_id, count(*) AS comments, annotator_id IS NOT NULL AND NOT bool_or(coalesce(need_signal, 'unlabeled') = 'unlabeled' OR coalesce(signal_kind, 'unlabeled') = 'unlabeled'
  OR coalesce(noise_kind, 'unlabeled') = 'unlabeled' OR coalesce(video_reception, 'unlabeled') = 'unlabeled' OR (need_signal = 'yes' AND coalesce(length(normalized_need), 0) = 0)) AS complete FROM held GROUP BY video_id, annotator_id""",
    "ref_label_agreement": f"""WITH {_LABELS} SELECT video_id, comment_id, count(DISTINCT annotator_id) AS annotators, count(DISTINCT need_signal) <= 1 AS need_signal_agreed, count(DISTINCT signal_kind) <= 1 AS signal_kind_agreed,
  count(DISTINCT noise_kind) <= 1 AS noise_kind_agreed, count(DISTINCT video_reception) <= 1 AS video_reception_agreed FROM held GROUP BY ALL HAVING count(DISTINCT annotator_id) > 1""",
    "ref_label_structure": f"""WITH {_LABELS}, {_RECORDS}, cl AS (SELECT DISTINCT h.video_id, h.annotator_id, r.gold_cluster_id AS k, r.comment_id FROM held h JOIN rec r USING (video_id) WHERE r.gold_cluster_id IS NOT NULL)
SELECT DISTINCT video_id, annotator_id, 'cross_video_cluster_member' AS code FROM cl ANTI JOIN held USING (video_id, annotator_id, comment_id)""",
    "ref_split_checks": """WITH l AS (SELECT split_id, 'd' AS g, unnest(development) AS v FROM dataset_splits UNION ALL SELECT split_id, 'c', unnest(calibration) FROM dataset_splits UNION ALL SELECT split_id, 'h', unnest(holdout) FROM dataset_splits)
SELECT 'dataset_split' AS entity, split_id || '/' || v AS key, CASE WHEN count(DISTINCT g) > 1 THEN 'groups_overlap' ELSE 'group_repeats' END AS code FROM l GROUP BY split_id, v HAVING count(*) > 1""",
    "ref_reference_checks": """SELECT DISTINCT 'comment_label' AS entity, video_id AS key, 'video_unknown' AS code FROM comment_labels WHERE video_id NOT IN (SELECT raw_video_id FROM raw_videos WHERE raw_video_id IS NOT NULL)
UNION ALL SELECT DISTINCT 'video_link', v, 'video_unknown' FROM (SELECT video_id AS v FROM video_links UNION SELECT linked_video_id FROM video_links) WHERE v NOT IN (SELECT raw_video_id FROM raw_videos WHERE raw_video_id IS NOT NULL)""",
    "ref_manifest_checks": """WITH m AS (SELECT *, flatten(map_values(stratum_comment_ids)) AS fl FROM sampling_manifests)
SELECT 'sampling_manifest' AS entity, manifest_id AS key, code FROM (
  SELECT manifest_id, unnest([CASE WHEN pages_succeeded > pages_requested THEN 'pages_succeeded_exceed_requested' END, CASE WHEN author_id_present > collected_total THEN 'authors_exceed_collected' END,
    CASE WHEN distinct_author_count > author_id_present THEN 'distinct_authors_exceed_present' END,
    CASE WHEN coalesce(exact_duplicate_count, 0) + coalesce(normalized_duplicate_count, 0) > collected_total THEN 'duplicates_exceed_collected' END,
    CASE WHEN len(list_distinct(candidate_comment_ids)) < len(candidate_comment_ids) THEN 'candidate_ids_repeat' END, CASE WHEN len(candidate_comment_ids) > collected_total THEN 'candidates_exceed_collected' END,
    CASE WHEN list_sort(list_distinct(available_strata)) <> list_sort(map_keys(stratum_comment_ids)) THEN 'strata_differ_from_keys' END,
    CASE WHEN len(list_filter(map_values(stratum_comment_ids), lambda x: len(list_distinct(x)) < len(x))) > 0 THEN 'stratum_ids_repeat' END,
    CASE WHEN NOT list_has_all(candidate_comment_ids, fl) THEN 'stratum_ids_outside_pool' END]) AS code FROM m) WHERE code IS NOT NULL""",
    "ref_comment_checks": r"""SELECT 'raw_comment' AS entity, arrival_seq::VARCHAR AS key, code FROM (
  SELECT arrival_seq, unnest([CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{0b}]') THEN 'text_blank' END,
    CASE WHEN raw_parent_comment_id = raw_comment_id THEN 'replies_to_itself' END, CASE WHEN NOT regexp_full_match(raw_comment_id, '\S{1,256}') THEN 'identifier_invalid' END,
    CASE WHEN source_stratum NOT IN ('top', 'recent', 'replies', 'long_tail') THEN 'stratum_unknown' END, CASE WHEN like_count < 0 OR reply_count < 0 OR source_page_or_rank < 1 THEN 'count_negative' END,
    CASE WHEN collected_at < published_at THEN 'collected_before_published' END]) AS code FROM raw_comments) WHERE code IS NOT NULL""",
    "ref_line_codes": """SELECT line_id, CASE WHEN trim(coalesce(body, '')) = '' THEN 'blank_line' WHEN NOT json_valid(body) THEN 'not_json' END AS code FROM comment_lines""",
    "ref_line_fields": """SELECT line_id, j->>'raw_comment_id' AS l_raw_comment_id, j->>'raw_author_id' AS l_raw_author_id, (j->>'like_count')::BIGINT AS l_like_count, (j->>'is_video_author')::BOOLEAN AS l_is_video_author, j->>'text' AS l_text,
  epoch_us((j->>'collected_at')::TIMESTAMPTZ)::BIGINT AS collected_us FROM (SELECT line_id, body::JSON AS j FROM comment_lines WHERE json_valid(body))""",
}
