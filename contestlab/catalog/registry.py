"""Query registry: every entry pairs a Spark callable with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STAT_SQL = ", ".join(
    f"CAST(sum(CASE WHEN rd = {r} THEN q ELSE 0 END) AS BIGINT) AS att_rd{r}, "
    f"CAST(sum(CASE WHEN rd = {r} AND l_returnflag = 'R' THEN q ELSE 0 END) AS BIGINT) AS land_rd{r}, "
    f"CAST(sum(CASE WHEN rd = {r} THEN 60 ELSE 0 END) AS BIGINT) AS secs_rd{r}"
    for r in (1, 2, 3)
)

SIDES = f"""
raw AS (SELECT l_orderkey AS order_id, l_suppkey AS entity_id,
  CAST(sum(q) AS BIGINT) AS att,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN q ELSE 0 END) AS BIGINT) AS land,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN q ELSE 0 END) AS BIGINT) AS ctrl,
  CAST(sum(CASE WHEN l_returnflag = 'R' AND q >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS kd,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS sub_att,
  CAST(sum(60) AS BIGINT) AS secs,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, {_STAT_SQL}
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, (l_linenumber - 1) % 3 + 1 AS rd FROM lineitem) GROUP BY 1, 2),
sided AS (SELECT * EXCLUDE (rn), order_id * 1009 + (rn - 1) // 2 AS contest_id, (rn - 1) % 2 + 1 AS side
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY entity_id) AS rn FROM raw)),
head0 AS (SELECT a.order_id, a.contest_id, a.entity_id AS entity1_id, b.entity_id AS entity2_id,
  CASE WHEN a.cents > b.cents THEN 1 WHEN a.cents < b.cents THEN 0 ELSE 2 END AS result
  FROM sided a JOIN sided b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2),
headers AS (SELECT h.* EXCLUDE (order_id), CAST(o_orderdate AS DATE) AS event_date,
  CAST(((CAST(o_orderdate AS DATE) - DATE '1990-01-01') * 2 + o_custkey % 2) * 7919 % 100003 AS BIGINT) AS event_id,
  o_orderpriority AS grp,
  CASE o_orderstatus WHEN 'F' THEN 'KO/TKO' WHEN 'P' THEN 'Submission' ELSE 'Decision - Unanimous' END AS method,
  CAST(o_custkey % 3 + 1 AS INTEGER) AS end_round, CAST(o_custkey % 270 + 30 AS INTEGER) AS end_time
  FROM head0 h JOIN orders ON o_orderkey = order_id),
sides AS MATERIALIZED (SELECT h.event_id, h.event_date, h.grp, h.method, h.end_round, h.end_time, h.result,
  CASE WHEN r.side = 1 THEN h.entity2_id ELSE h.entity1_id END AS opponent_id, r.* EXCLUDE (order_id)
  FROM sided r JOIN headers h ON h.contest_id = r.contest_id)
"""

ENTITIES = """
entities AS (SELECT s_suppkey AS entity_id, s_name AS name, s_nationkey AS nation,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE DATE '1960-01-31' + CAST((s_suppkey * 131) % 9000 AS INTEGER) END AS dob,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(65 + s_suppkey % 18 AS INTEGER) END AS reach,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(62 + (s_suppkey * 5) % 17 AS INTEGER) END AS height
  FROM supplier)
"""


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``oracle`` may use the view CTEs."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def over_sides(body: str, *ctes: str) -> str:
    """Oracle text starting from the contest view; ``body`` may open with more CTEs."""
    pre = ",".join([SIDES, *ctes])
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {pre}, {body[5:]}"
    return f"WITH {pre} {body}"
