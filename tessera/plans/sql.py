"""Common table expressions of the oracles: the model tables on the harness tables."""

from __future__ import annotations

ROI = """roi AS (
  SELECT vec_id AS roi_id, (vec_id % 8)::INTEGER AS session_id, vec_id * 7919 % 512 AS cy, vec_id * 104729 % 512 AS cx,
    CASE WHEN label = 9 THEN -1 ELSE label END AS label
  FROM embeddings)"""

UCID = """ucid AS (
  SELECT (vec_id % 8)::INTEGER AS session_id, vec_id // 8 AS roi_idx, (CASE WHEN label = 9 THEN -1 ELSE label END)::BIGINT AS ucid
  FROM embeddings)"""

NN = """nn AS (SELECT vec_id AS roi_id, embedding[1:32]::DOUBLE[] AS vec FROM embeddings)"""
SWT = """swt AS (SELECT vec_id AS roi_id, embedding[33:64]::DOUBLE[] AS vec FROM embeddings)"""

EDGES = """edges AS (
  SELECT a.roi_id AS i, b.roi_id AS j, CASE WHEN list_cosine_similarity(a.vec, b.vec) > 1 - 1e-5 THEN 1.0 ELSE list_cosine_similarity(a.vec, b.vec) END AS s
  FROM nn a JOIN nn b ON a.roi_id <> b.roi_id WHERE list_cosine_similarity(a.vec, b.vec) > 0.35)"""

FOOTPRINT = """footprint AS (
  SELECT roi_id, (s_nationkey % 8)::INTEGER AS session_id, pixel, weight
  FROM (SELECT l_suppkey AS roi_id, l_partkey AS pixel, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
  JOIN supplier ON s_suppkey = roi_id)"""

TRACE = """trace AS (
  SELECT (user_id % 8)::INTEGER AS session_id, user_id // 8 AS roi_idx, ts::DATE AS day, sum(value) AS value FROM events GROUP BY ALL)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
