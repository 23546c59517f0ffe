"""SQL of the whole pipelines, written independently of the operators."""

from __future__ import annotations

from threadquarry.operators.analysis import CLOSE, ENVELOPE, INSTRUCTION, OPEN
from threadquarry.plans.inventory import _WORD, _redaction_sql
from threadquarry.plans.reference_sql import _FIRSTS, _FOLD_Q, _SPACE, _TARGET, _fold_ctes, _pseudonym, _quotas, _run

_CUT = "TIMESTAMP '2026-06-15 00:00:00'"

_COLLECT = f"""WITH prev AS MATERIALIZED (SELECT * FROM {_run('raw_comments', f'collected_at < {_CUT}')} WHERE NOT conflict),
run AS MATERIALIZED (SELECT * FROM {_run('raw_comments', f'collected_at >= {_CUT}')}),
torn AS MATERIALIZED (SELECT DISTINCT platform, raw_video_id FROM run WHERE conflict),
clean AS MATERIALIZED (SELECT r.*, c.source_stratum, c.source_page_or_rank FROM run r JOIN raw_comments c USING (arrival_seq) ANTI JOIN torn ON torn.platform = r.platform AND torn.raw_video_id = r.raw_video_id),
pool AS MATERIALIZED (SELECT platform, raw_video_id, source_stratum AS stratum, raw_comment_id AS id, coalesce(source_page_or_rank, 1::BIGINT << 40) AS o FROM clean WHERE raw_comment_id IS NOT NULL),
vid AS (SELECT platform, raw_video_id, total_comment_count AS t FROM raw_videos QUALIFY row_number() OVER (PARTITION BY platform, raw_video_id ORDER BY capture_seq) = 1),
tgt AS MATERIALIZED (SELECT platform, raw_video_id, {_TARGET} AS target FROM vid WHERE {_TARGET} IS NOT NULL),
tq AS MATERIALIZED (SELECT * FROM {_quotas('tgt', True)}),
{_fold_ctes('platform, raw_video_id', 'o, id', _FOLD_Q)},
picked AS MATERIALIZED (SELECT c.* FROM clean c SEMI JOIN t8 ON t8.platform = c.platform AND t8.raw_video_id = c.raw_video_id AND t8.id = c.raw_comment_id),
both_ AS MATERIALIZED (SELECT coalesce(p.platform, c.platform) AS platform, coalesce(p.raw_video_id, c.raw_video_id) AS raw_video_id, p.arrival_seq AS pa, c.arrival_seq AS ca, p.au IS DISTINCT FROM c.au OR p.tx IS DISTINCT FROM c.tx AS off
  FROM prev p FULL JOIN picked c ON p.platform = c.platform AND p.raw_video_id = c.raw_video_id AND p.raw_comment_id = c.raw_comment_id)
"""

_CLEAN = _redaction_sql() + f""", {_FIRSTS}, ok AS (SELECT DISTINCT platform, raw_video_id FROM raw_videos WHERE platform IS NOT NULL AND raw_video_id IS NOT NULL),
pc AS MATERIALIZED (SELECT f.platform, {_pseudonym('video', 'f.raw_video_id')} AS video_id, {_pseudonym('comment', 'f.raw_comment_id')} AS comment_id, {_pseudonym('author', 'f.raw_author_id')} AS author_id,
  {_pseudonym('comment', 'f.raw_parent_comment_id')} AS parent_comment_id, r.t7 AS text, f.source_stratum, r.n7 > 0 AS review FROM firsts f JOIN r7 r USING (arrival_seq) SEMI JOIN ok USING (platform, raw_video_id))
"""

#: Limits of the registered analysis: a call, calls, input, and what of it signals may use.
PER_CALL, CALLS, INPUT = 2_000, 64, 64_000
_EMPTY = f"{INSTRUCTION['signals']}\n{OPEN}\n" + '{"video_id":"","comments":[]}' + f"\n{CLOSE}"
_OWNERS = "own AS (SELECT raw_video_id AS video_id, max(raw_author_id) FILTER (WHERE raw_author_id NOT IN ('0', 'unknown')) AS owner FROM raw_videos WHERE raw_video_id IS NOT NULL GROUP BY 1)"

_ANALYSIS = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT raw_video_id AS video_id, raw_comment_id AS comment_id, arg_min_null(raw_author_id, arrival_seq) AS author, arg_min_null(text, arrival_seq) AS text, arg_min_null(source_stratum, arrival_seq) AS stratum
  FROM raw_comments WHERE raw_video_id IS NOT NULL AND raw_comment_id IS NOT NULL GROUP BY 1, 2),
pool AS MATERIALIZED (SELECT video_id, stratum, comment_id AS id FROM c), tgt AS (SELECT DISTINCT video_id, 200 AS target FROM c),
tq AS MATERIALIZED (SELECT * FROM {_quotas('tgt', False)}),
{_fold_ctes('video_id', 'id', _FOLD_Q)},
ch AS MATERIALIZED (SELECT c.* FROM c SEMI JOIN t8 ON t8.video_id = c.video_id AND t8.id = c.comment_id),
it AS MATERIALIZED (SELECT video_id, comment_id, greatest(1, ceil(strlen(nfc_normalize(to_json({{'comment_id': comment_id, 'text': text}})::VARCHAR)) / 3.0::DOUBLE))::BIGINT AS t, ceil(({len(_EMPTY.encode())} + strlen(video_id)) / 3.0::DOUBLE)::BIGINT + {ENVELOPE} AS fx,
  row_number() OVER (PARTITION BY video_id ORDER BY comment_id) AS r FROM ch),
wk AS (SELECT video_id, r, 0::BIGINT AS b, fx + t AS used FROM it WHERE r = 1
  UNION ALL SELECT i.video_id, i.r, CASE WHEN w.used + i.t > {PER_CALL} THEN w.b + 1 ELSE w.b END, CASE WHEN w.used + i.t > {PER_CALL} THEN i.fx + i.t ELSE w.used + i.t END FROM wk w JOIN it i ON i.video_id = w.video_id AND i.r = w.r + 1),
su AS (SELECT video_id, count(*) AS items, max(t) AS largest, sum(t) AS total, max(fx) AS fx FROM it GROUP BY 1),
nb AS (SELECT video_id, max(b) + 1 AS batches FROM wk GROUP BY 1),
pl AS MATERIALIZED (SELECT video_id, items, CASE WHEN fx + largest <= {PER_CALL} AND total + fx <= {INPUT - INPUT // 4} THEN batches END AS batches, CASE WHEN fx + largest > {PER_CALL} THEN 'item_exceeds_call' WHEN total + fx > {INPUT - INPUT // 4} THEN 'budget_exhausted' WHEN batches > {CALLS - 1} THEN 'calls_exhausted'
  WHEN total + fx * batches > {INPUT - INPUT // 4} THEN 'budget_exhausted' END AS code FROM su JOIN nb USING (video_id)),
w AS MATERIALIZED (SELECT * FROM (SELECT ch.*, {_WORD} AS summary FROM ch JOIN pl USING (video_id) WHERE code IS NULL) WHERE summary IS NOT NULL),
{_OWNERS}
"""

SQL = {
    "ref_collection_status": _COLLECT + """SELECT t.platform, t.raw_video_id, t.target, coalesce(n.n, 0) AS chosen, coalesce(x.n, 0) AS conflicts, CASE WHEN torn.platform IS NOT NULL THEN 'conflict' WHEN coalesce(n.n, 0) < t.target THEN 'partial' ELSE 'complete' END AS status
FROM tgt t LEFT JOIN (SELECT platform, raw_video_id, count(*) AS n FROM t8 GROUP BY 1, 2) n ON n.platform = t.platform AND n.raw_video_id = t.raw_video_id
LEFT JOIN (SELECT platform, raw_video_id, count(*) AS n FROM both_ WHERE pa IS NOT NULL AND ca IS NOT NULL AND off GROUP BY 1, 2) x ON x.platform = t.platform AND x.raw_video_id = t.raw_video_id
LEFT JOIN torn ON torn.platform = t.platform AND torn.raw_video_id = t.raw_video_id""",
    "ref_collected_comments": _COLLECT + "SELECT c.* EXCLUDE (published_at, collected_at), epoch_us(published_at) AS published_us, epoch_us(collected_at) AS collected_us FROM raw_comments c JOIN (SELECT CASE WHEN pa IS NULL THEN ca WHEN ca IS NULL OR off THEN pa ELSE ca END AS arrival_seq FROM both_) USING (arrival_seq)",
    "ref_prepared_comments": _CLEAN + "SELECT * FROM pc",
    "ref_prepared_profiles": _CLEAN + f""", st AS (SELECT platform, video_id, string_agg(source_stratum || '=' || n, ',' ORDER BY source_stratum) AS strata FROM (SELECT platform, video_id, source_stratum, count(*) AS n FROM pc WHERE source_stratum IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT platform, video_id, count(*) AS collected_total, count(author_id) AS author_id_present, count(DISTINCT author_id) AS distinct_author_count, max(strata) AS strata, NULL::BIGINT AS exact_duplicate_count,
  (count(text) - count(DISTINCT trim(regexp_replace(lower(text), {_SPACE}, ' ', 'g'))))::BIGINT AS normalized_duplicate_count FROM pc LEFT JOIN st USING (platform, video_id) GROUP BY 1, 2""",
    "ref_prepared_splits_all": f"""WITH v AS (SELECT DISTINCT {_pseudonym('video', 'raw_video_id')} AS video_id FROM raw_comments SEMI JOIN (SELECT platform, raw_video_id FROM raw_videos) USING (platform, raw_video_id)),
r AS (SELECT video_id, row_number() OVER (ORDER BY sha256(video_id), video_id) AS r, count(*) OVER () AS n FROM v)
SELECT video_id, CASE WHEN r <= CASE WHEN n = 24 THEN 10 ELSE ceil(n * 0.4::DOUBLE) END THEN 'development'
  WHEN r <= CASE WHEN n = 24 THEN 17 ELSE ceil(n * 0.4::DOUBLE) + floor(n * 0.3::DOUBLE) END THEN 'calibration' ELSE 'holdout' END AS split FROM r""",
    "ref_sanitize_reports": _CLEAN + f"""SELECT f.platform, {_pseudonym('video', 'f.raw_video_id')} AS video_id, count(*) AS comments, sum(n1)::BIGINT AS n_email, sum(n2)::BIGINT AS n_phone, sum(n3)::BIGINT AS n_identity, sum(n4 + n5)::BIGINT AS n_handle,
  sum(n6 + n7)::BIGINT AS n_address, count(*) FILTER (WHERE n7 > 0) AS reviews FROM firsts f JOIN r7 r USING (arrival_seq) SEMI JOIN ok USING (platform, raw_video_id) GROUP BY 1, 2""",
    "ref_published_dataset": _CLEAN + """, n AS (SELECT 'comments' AS name, count(*) AS rows FROM pc UNION ALL SELECT 'profiles', count(DISTINCT (platform, video_id)) FROM pc UNION ALL SELECT 'splits', count(DISTINCT video_id) FROM pc
  UNION ALL SELECT 'reports', count(DISTINCT (platform, video_id)) FROM pc) SELECT name, rows, rows AS found FROM n""",
    "ref_analysis": _ANALYSIS + """, m AS (SELECT video_id, summary, count(*) AS comments, 'clu_' || left(sha256(string_agg(comment_id, chr(31) ORDER BY comment_id) || chr(30) || summary || chr(30) || 'v1'), 24) AS cluster_id FROM w GROUP BY 1, 2),
e AS (SELECT video_id, summary, count(DISTINCT author) FILTER (WHERE author <> owner) AS authors FROM w LEFT JOIN own USING (video_id) GROUP BY 1, 2),
x AS (SELECT m.*, e.authors, CASE WHEN owner IS NULL THEN 'video_author_unknown' WHEN authors < 3 THEN 'insufficient_independent_authors' ELSE 'independent_author_threshold_met' END AS reason_code FROM m JOIN e USING (video_id, summary) LEFT JOIN own USING (video_id))
SELECT *, reason_code = 'independent_author_threshold_met' AS passed FROM x""",
    "ref_analysis_status": _ANALYSIS + """, k AS (SELECT video_id, count(DISTINCT summary) AS clusters FROM w GROUP BY 1), v AS (SELECT DISTINCT video_id FROM ch UNION SELECT video_id FROM own)
SELECT v.video_id, CASE WHEN pl.video_id IS NULL THEN 'no_comments' WHEN code IS NOT NULL THEN 'plan' WHEN k.video_id IS NULL THEN 'no_signal' ELSE 'complete' END AS status, code, coalesce(items, 0) AS items, coalesce(batches, 0) AS batches, coalesce(clusters, 0) AS clusters
FROM v LEFT JOIN pl USING (video_id) LEFT JOIN k USING (video_id)""",
}
