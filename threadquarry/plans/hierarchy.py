"""Queries over reply trees (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadquarry.operators.hierarchy import descendant_pairs, resolve, with_descendant_counts
from threadquarry.runtime import table

SCOPE = ["platform", "raw_video_id"]
NODE = "raw_comment_id"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(table(spark, sf_dir, "raw_comments"), SCOPE, NODE, "raw_parent_comment_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("status != 'rooted'").select(*SCOPE, NODE, F.col("status").alias("kind"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_descendant_counts(_resolved(spark, sf_dir), SCOPE, NODE)
    return out.select(*SCOPE, NODE, "status", "root", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", "/").alias("path"), "descendants")


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_pairs(_resolved(spark, sf_dir), SCOPE, NODE)


QUERIES = {"p3_found": found, "p3_tree": tree, "p3_descendants": descendants}

# UNION (not ALL) ends the walk of a ring by itself: states repeat.
_WALK = """
WITH RECURSIVE n AS MATERIALIZED (
  SELECT platform, raw_video_id, raw_comment_id, max(nullif(raw_parent_comment_id, '')) AS par
  FROM raw_comments WHERE raw_comment_id IS NOT NULL GROUP BY ALL),
held AS MATERIALIZED (
  SELECT n.*, p.raw_comment_id IS NOT NULL AS ok FROM n LEFT JOIN n p
  ON p.platform = n.platform AND p.raw_video_id = n.raw_video_id AND p.raw_comment_id = n.par),
down AS (
  SELECT platform, raw_video_id, raw_comment_id,
         CASE WHEN par IS NULL THEN 'rooted' ELSE 'lost_root' END AS status,
         CASE WHEN par IS NULL THEN raw_comment_id END AS root, 0::BIGINT AS depth, raw_comment_id AS path
  FROM held WHERE par IS NULL OR NOT ok
  UNION ALL
  SELECT h.platform, h.raw_video_id, h.raw_comment_id, d.status, d.root, d.depth + 1, d.path || '/' || h.raw_comment_id
  FROM down d JOIN held h ON h.platform = d.platform AND h.raw_video_id = d.raw_video_id AND h.par = d.raw_comment_id AND h.ok),
stuck AS MATERIALIZED (
  SELECT h.* FROM held h ANTI JOIN down d USING (platform, raw_video_id, raw_comment_id)),
up AS (
  SELECT platform, raw_video_id, raw_comment_id AS start, par AS cur FROM stuck
  UNION
  SELECT u.platform, u.raw_video_id, u.start, s.par FROM up u JOIN stuck s
  ON s.platform = u.platform AND s.raw_video_id = u.raw_video_id AND s.raw_comment_id = u.cur),
ring AS (SELECT DISTINCT platform, raw_video_id, start FROM up WHERE start = cur),
placed AS (
  SELECT platform, raw_video_id, raw_comment_id, status, root, depth, path FROM down
  UNION ALL
  SELECT s.platform, s.raw_video_id, s.raw_comment_id,
         CASE WHEN r.start IS NULL THEN 'below_cycle' ELSE 'in_cycle' END, NULL, NULL, NULL
  FROM stuck s LEFT JOIN ring r ON r.platform = s.platform AND r.raw_video_id = s.raw_video_id AND r.start = s.raw_comment_id),
pairs AS (
  SELECT platform, raw_video_id, raw_comment_id AS descendant, depth, unnest(string_split(path, '/')) AS ancestor,
         generate_subscripts(string_split(path, '/'), 1) - 1 AS lvl
  FROM down)
"""

SQL = {
    "p3_found": _WALK + "SELECT platform, raw_video_id, raw_comment_id, status AS kind FROM placed WHERE status <> 'rooted'",
    "p3_tree": _WALK + """SELECT p.*, coalesce(c.n, 0)::BIGINT AS descendants FROM placed p LEFT JOIN (
  SELECT platform, raw_video_id, ancestor, count(*) AS n FROM pairs WHERE ancestor <> descendant GROUP BY ALL) c
  ON c.platform = p.platform AND c.raw_video_id = p.raw_video_id AND c.ancestor = p.raw_comment_id""",
    "p3_descendants": _WALK + """SELECT platform, raw_video_id, ancestor, descendant, (depth - lvl)::BIGINT AS distance
  FROM pairs WHERE lvl < depth""",
}
