"""Role tables: the given tables read as match logs, decision logs, predictions and so on.

Each role is one SQL text that both Spark and DuckDB accept, so a query and its check
start from literally the same derived rows. Operators know nothing about these names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ROLES: dict[str, str] = {
    # one row per order = one game of a matchup
    "v_games": """
        SELECT o.o_orderkey AS game_index, o.o_orderpriority AS matchup,
          CAST(o.o_orderkey % 2 AS INT) AS hero_seat,
          CAST(CASE WHEN o.o_orderstatus = 'P' THEN NULL
                    WHEN o.o_orderstatus = 'F' THEN o.o_orderkey % 2
                    ELSE 1 - o.o_orderkey % 2 END AS INT) AS winner,
          o.o_orderstatus = 'F' AS hero_won,
          COALESCE(l.steps, 0) AS steps, COALESCE(l.turns, 0) AS turns,
          COALESCE(l.skipped, 0) AS skipped, COALESCE(l.single_valid, 0) AS single_valid,
          o.o_totalprice > 480000 AS aborted, o.o_totalprice / 1000.0 AS duration,
          COALESCE(l.hero_r, 0) AS hero_r, COALESCE(l.hero_a, 0) AS hero_a,
          COALESCE(l.hero_n, 0) AS hero_n, COALESCE(l.villain_r, 0) AS villain_r,
          COALESCE(l.villain_a, 0) AS villain_a, COALESCE(l.villain_n, 0) AS villain_n
        FROM orders o LEFT JOIN (
          SELECT l_orderkey, COUNT(*) AS steps, CAST(SUM(l_linenumber) AS BIGINT) AS turns,
            CAST(SUM(CASE WHEN l_tax < 0.04 THEN l_linenumber ELSE 0 END) AS BIGINT) AS skipped,
            CAST(SUM(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS single_valid,
            CAST(SUM(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS hero_r,
            CAST(SUM(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS hero_a,
            CAST(SUM(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS hero_n,
            CAST(SUM(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS villain_r,
            CAST(SUM(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS villain_a,
            CAST(SUM(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS villain_n
          FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    # one row per line item = one seat leg between two nations
    "v_matches": """
        SELECT sn.n_name AS player_a, cn.n_name AS player_b, l.l_orderkey AS deal_block,
          CAST(l.l_linenumber % 2 AS INT) AS leg, CAST(l.l_linenumber % 2 AS INT) AS player_a_seat,
          CASE l.l_returnflag WHEN 'R' THEN 1.0E0 WHEN 'A' THEN 0.0E0 ELSE 0.5E0 END AS score_a,
          l.l_quantity >= 49 AS truncated,
          CASE WHEN l.l_tax = 0.08 AND l.l_linestatus = 'O' THEN 'truncated' ELSE 'terminal' END
            AS termination_reason,
          l.l_quantity AS game_seconds, l.l_partkey AS part_key, l.l_suppkey AS supp_key
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
          JOIN customer c ON c.c_custkey = o.o_custkey
          JOIN supplier s ON s.s_suppkey = l.l_suppkey
          JOIN nation sn ON sn.n_nationkey = s.s_nationkey
          JOIN nation cn ON cn.n_nationkey = c.c_nationkey
        WHERE sn.n_name <> cn.n_name""",
    # the same legs between regions; a block is one order month
    "v_region_matches": """
        SELECT sr.r_name AS player_a, cr.r_name AS player_b,
          CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) AS BIGINT) AS deal_block,
          CAST(l.l_linenumber % 2 AS INT) AS player_a_seat,
          CASE l.l_returnflag WHEN 'R' THEN 1.0E0 WHEN 'A' THEN 0.0E0 ELSE 0.5E0 END AS score_a,
          l.l_quantity >= 49 AS truncated, 'terminal' AS termination_reason
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
          JOIN customer c ON c.c_custkey = o.o_custkey
          JOIN supplier s ON s.s_suppkey = l.l_suppkey
          JOIN nation sn ON sn.n_nationkey = s.s_nationkey
          JOIN nation cn ON cn.n_nationkey = c.c_nationkey
          JOIN region sr ON sr.r_regionkey = sn.n_regionkey
          JOIN region cr ON cr.r_regionkey = cn.n_regionkey
        WHERE sr.r_name <> cr.r_name""",
    # events with the integer of the props document
    "v_events": """
        SELECT event_id, ts, user_id, event_type, value,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    # one row per event = one decision of the observed player
    "v_log": """
        SELECT user_id AS evaluation_id, user_id * 400 + dayofyear(ts) AS game_index,
          event_id AS step, CAST(event_id % 2 AS INT) AS player,
          CASE event_type WHEN 'click' THEN 'attack' WHEN 'view' THEN 'pass'
            WHEN 'purchase' THEN 'spell' WHEN 'signup' THEN 'land' ELSE 'block' END AS action_type,
          k % 2 = 1 AS attack_available, k % 4 >= 2 AS land_available,
          k % 8 >= 4 AS spell_available, k % 16 >= 8 AS pass_available, k % 32 >= 16 AS block_available,
          CASE WHEN k % 10 = 0 THEN NULL ELSE value / 1000 END AS pass_prob,
          CASE WHEN k % 10 = 0 THEN NULL ELSE value / 2000 END AS land_prob,
          CASE WHEN k % 10 = 0 THEN NULL ELSE value / 3000 END AS spell_prob,
          CASE WHEN k % 10 = 0 THEN NULL ELSE value / 4000 END AS attack_prob,
          CAST(k % 2 + CASE WHEN k % 4 >= 2 THEN 1 ELSE 0 END + CASE WHEN k % 8 >= 4 THEN 1 ELSE 0 END
            + CASE WHEN k % 16 >= 8 THEN 1 ELSE 0 END + CASE WHEN k % 32 >= 16 THEN 1 ELSE 0 END AS INT)
            AS num_valid_actions,
          value, k
        FROM v_events""",
    # one row per line item = one probabilistic prediction
    "v_pred": """
        SELECT l_orderkey AS game_index, l_linenumber AS phase, l_linestatus AS source,
          l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END AS y,
          l_quantity AS weight, l_returnflag AS flag, l_extendedprice AS price, l_tax AS tax,
          CAST(l_linenumber % 2 AS INT) AS seat,
          CAST(CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN l_linenumber % 2
               ELSE 1 - l_linenumber % 2 END AS INT) AS winner
        FROM lineitem""",
    # one row per line item = one worker of a repeat of a measurement cell
    "v_workers": """
        SELECT l_returnflag || l_linestatus AS cell_id, l_orderkey AS repeat, l_linenumber AS worker,
          (l_orderkey % 17 + 1) / 8.0E0 AS barrier_wall_seconds, l_quantity / 4 AS elapsed_seconds,
          l_partkey AS simulations, l_suppkey AS transitions,
          CAST(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS BIGINT) AS cap_hits, l_partkey * 10 AS rss_peak_bytes,
          CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN NULL ELSE l_partkey END AS allocation_count,
          CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN NULL ELSE l_suppkey END AS journal_bytes
        FROM lineitem""",
    # hidden pools: per supplier the number of parts of each type, modulo four
    "v_pool": """
        SELECT l_suppkey AS space_id, p_type AS name, CAST(COUNT(DISTINCT l_partkey) % 4 AS INT) AS n
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type""",
    # visits of one action in one world under one condition
    "v_cells": """
        SELECT event_type AS condition, user_id AS world, k % 8 AS action, COUNT(*) AS visits,
          SUM(CASE WHEN value > 500 THEN 1.0E0 ELSE value / 500 END) AS value_sum,
          SUM(CASE WHEN value > 500 THEN 1.0E0 ELSE value / 500 END) / COUNT(*) AS q
        FROM v_events GROUP BY event_type, user_id, k % 8""",
    # span timings from url paths: every prefix of a path is a span
    "v_spans": """
        SELECT page_id AS run, p AS path, (1 + page_id % 7) / 4.0E0 AS seconds FROM (
          SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS p FROM pages
          UNION ALL
          SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+/[0-9])', 1) AS p FROM pages
        ) x WHERE p <> ''""",
}

_WORD = re.compile(r"\bv_[a-z_]+\b")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _WORD.findall(sql):
        if name in ROLES and name not in seen:
            _needed(ROLES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_roles(sql: str, roles: tuple[str, ...] = ()) -> str:
    """Prefix ``sql`` with the role definitions it mentions."""
    names = _needed(sql, list(roles))
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({ROLES[n]})" for n in names)
    body = sql.strip()
    upper = body[:15].upper()
    if upper.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if upper.startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"


# Sizes of a task's share of a file and of a shuffle, and of the smallest split. Rows of the role tables take up to thirty times their
# stored size in an aggregation, so that a task of Spark's default sizes holds some gigabytes.
TASK_SIZES = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"), "spark.sql.files.openCostInBytes": ("4194304b", "1m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "12m"),
}


class Tables:
    """Access to the base tables and role tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for key, (default, size) in TASK_SIZES.items():
            if spark.conf.get(key, default) == default:  # a size that the session sets itself stays
                spark.conf.set(key, size)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over base and role tables (used by adapters only)."""
        full = with_roles(text)
        for name in BASE:
            if re.search(rf"\b{name}\b", full):
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def role(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            return self.role(name)
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)
