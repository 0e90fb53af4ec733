"""Registered queries for gates, decisions, validation, streaming folds and the scoring hook."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions.joins import attach_row
from scoreloom.functions.scoring import score_batches
from scoreloom.operators import decisions as G
from scoreloom.operators import validation as V
from scoreloom.operators.aggregates import evaluation_metrics
from scoreloom.operators.ratings import payoff_matrix
from scoreloom.plans.registry import ORACLES, query
from scoreloom.plans.roles import ROLES
from scoreloom.plans.sqltext import ct, r6
from scoreloom.sources.io import REPORT_METRICS, scratch_folder
from scoreloom.streaming import incremental as Z


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


RULES = (
    G.Rule("passed_when_able", ">=", 0.8, "behaviour"), G.Rule("landed_when_able", ">", 0.4, "behaviour"),
    G.Rule("could_pass", ">=", 20, "volume"), G.Rule("decisions", "<=", 70, "volume"), G.Rule("not_measured", ">=", 0, "volume"),
)
_M = f"""em AS (SELECT evaluation_id, COUNT(*) AS decisions, {ct("action_type='pass'")}/nullif({ct('pass_available')},0) AS passed_when_able,
  {ct("action_type='land'")}/nullif({ct('land_available')},0) AS landed_when_able, {ct('pass_available')} AS could_pass FROM v_log GROUP BY 1)"""
_GATE = f"""{_M}, ga AS (SELECT evaluation_id, 'behaviour' AS "group", 'passed_when_able' AS clause, COALESCE(passed_when_able,0) AS actual, '>=' AS op, 0.8 AS bound, COALESCE(passed_when_able,0)>=0.8 AS passed FROM em
  UNION ALL SELECT evaluation_id, 'behaviour', 'landed_when_able', COALESCE(landed_when_able,0), '>', 0.4, COALESCE(landed_when_able,0)>0.4 FROM em
  UNION ALL SELECT evaluation_id, 'volume', 'could_pass', could_pass, '>=', 20, could_pass>=20 FROM em
  UNION ALL SELECT evaluation_id, 'volume', 'decisions', decisions, '<=', 70, decisions<=70 FROM em
  UNION ALL SELECT evaluation_id, 'volume', 'not_measured', NULL, '>=', 0, false FROM em)"""


def _gate_rows(t):
    m = evaluation_metrics(t.v_log)
    values = G.stack_values(m, ["evaluation_id"], [r.clause for r in RULES if r.clause != "not_measured"])
    return G.gates(values, RULES, ["evaluation_id"])


@query("G01_gates", f"""WITH {_GATE} SELECT evaluation_id, "group", clause, {r6('actual')} AS actual, op, {r6('bound')} AS bound, passed FROM ga""")
def g01(t):
    return rounded(_gate_rows(t))


@query("G01_verdict", f"WITH {_GATE} SELECT evaluation_id, bool_and(passed) AS passed, {ct('NOT passed')} AS failed_clauses, COUNT(*) AS clauses FROM ga GROUP BY 1")
def g01b(t):
    return G.verdict(_gate_rows(t), ["evaluation_id"])


# Events of a user as the evaluations of a run; metrics are scaled values.
_EV = "ev AS (SELECT user_id AS run_id, event_id AS id, k AS step, CASE event_type WHEN 'click' THEN 'baseline' WHEN 'view' THEN 'final' ELSE 'checkpoint' END AS kind, " + ", ".join(
    f"{e} AS {m}" for m, e in zip(
        REPORT_METRICS,
        ("value/600", "value/500", "k/100.0E0", "value/200", "k/99.0E0", "k/150.0E0", "value/400", "k/200.0E0", "value/300"),
    )
) + " FROM v_events)"
_BF = f"""{_EV}, bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, id) AS rn FROM ev WHERE kind='baseline') z WHERE rn=1),
 fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, id DESC) AS rn FROM ev WHERE kind='final') z WHERE rn=1)"""


@query(
    "G03_run_deltas",
    f"WITH {_BF} " + " UNION ALL ".join(f"SELECT fi.run_id, '{m}' AS metric, {r6(f'fi.{m}-bl.{m}')} AS delta FROM fi JOIN bl ON bl.run_id=fi.run_id" for m in REPORT_METRICS),
)
def g03(t):
    return rounded(G.run_deltas(t.sql(f"WITH {_EV} SELECT * FROM ev")))


@query(
    "G02_recommend",
    f"""WITH {_BF}, j AS (SELECT fi.run_id, fi.win_rate-bl.win_rate>=0.05 AND fi.win_ci_lower>=greatest(0.0, bl.win_rate-0.02) AS w,
      fi.landed_when_able>=greatest(0.35, bl.landed_when_able-0.05) AND fi.pass_land_land_rate>fi.pass_land_pass_rate AND fi.mean_land_prob_when_pass_land>fi.mean_pass_prob_when_pass_land AS l,
      fi.cast_when_able>=0.7 AS s FROM fi JOIN bl ON bl.run_id=fi.run_id)
    SELECT run_id, CASE WHEN w AND l AND s THEN 'Move on to auxiliary-head experiments' WHEN NOT w THEN 'Stay in first-light: random-opponent win signal is too weak'
      WHEN NOT l THEN 'Stay in first-light: pass-collapse still dominates land decisions' ELSE 'Stay in first-light: creature-play signal remains weak' END AS recommendation,
    w AS win_signal_ok, l AS land_chain_ok, s AS spell_chain_ok FROM j""",
)
def g02(t):
    return G.recommend(t.sql(f"WITH {_EV} SELECT * FROM ev"))


def _matches(t):
    k = F.col("part_key") % 50
    return t.v_matches.withColumns(
        {"replay_passed": F.col("game_seconds") > 0, "integrity": F.create_map(F.lit("illegal"), F.when(k == 0, 1).otherwise(0), F.lit("drift"), F.lit(0))}
    )


@query(
    "G04_promotion_disposition",
    """SELECT bool_and(part_key % 50 <> 0) AND bool_and(game_seconds > 0) AS passed, CASE WHEN bool_and(part_key % 50 <> 0) THEN 'rated_not_promotion_eligible' ELSE 'invalid_integrity' END AS disposition,
    CASE WHEN bool_and(part_key % 50 <> 0) THEN 'incumbent_not_in_cohort' ELSE 'zero_tolerance_gate' END AS reason, 'cand' AS candidate FROM v_matches""",
)
def g04(t):
    profile = t.supplier.select(F.lit(0).alias("root_mutations"), F.lit(0).alias("illegal_actions"), F.lit(0.0).alias("playout_cap_rate"))
    return G.promotion_disposition(G.integrity(_matches(t), profile, True), False, "cand")


_ARMS = """ar AS (SELECT CASE event_type WHEN 'click' THEN 'uniform' WHEN 'view' THEN 'chosen' ELSE 'visit' END AS arm, AVG(value)/100 AS score, AVG(k)/100 AS label_agreement,
  COUNT(*) AS competency, AVG(value) AS p95_seconds, AVG(value)*2 AS nodes_per_second FROM v_events WHERE event_type IN ('click','view','purchase') GROUP BY 1)"""


@query(
    "G04_diagnostic_clauses",
    f"""WITH {_ARMS}, j AS (SELECT a.*, u.score AS us, u.label_agreement AS ul, u.p95_seconds AS up, u.nodes_per_second AS un, o.score AS os, o.competency AS oc FROM ar a
      JOIN ar u ON u.arm='uniform' JOIN ar o ON o.arm<>'uniform' AND o.arm<>a.arm WHERE a.arm<>'uniform'),
    w AS (SELECT arm, 'arena_delta' AS clause, score-us AS actual, '>=' AS op, 0.05 AS bound FROM j UNION ALL SELECT arm, 'arena_separation', score-os, '>=', 0.05 FROM j
      UNION ALL SELECT arm, 'high_budget_label_agreement_improvement', label_agreement-ul, '>=', 0.05 FROM j UNION ALL SELECT arm, 'competency_noninferiority', competency-oc, '>=', 0 FROM j
      UNION ALL SELECT arm, 'p95_latency_ratio', p95_seconds/up, '<=', 1.1 FROM j UNION ALL SELECT arm, 'nodes_per_second_ratio', nodes_per_second/un, '>=', 0.9 FROM j)
    SELECT arm, 'all' AS "group", clause, {r6('actual')} AS actual, op, {r6('bound')} AS bound, CASE op WHEN '>=' THEN actual>=bound ELSE actual<=bound END AS passed FROM w""",
)
def g04b(t):
    arms = t.sql(f"WITH {_ARMS} SELECT * FROM ar")
    ok = arms.agg(F.lit(True).alias("passed"))
    return rounded(G.diagnostic_disposition(arms, ok)[0])


_STR = """st AS (SELECT CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'policy_only' ELSE 'policy_value' END AS series, user_id % 5 AS seed, AVG(value)/200 AS rate FROM v_events
  WHERE event_type IN ('click','view','purchase') GROUP BY 1, 2)"""
_CMP = """cp AS (SELECT CASE WHEN o_orderstatus='F' THEN 'search' ELSE 'student' END AS subject, o_totalprice > 1000 AS passed FROM orders)"""


@query(
    "G05_admission",
    f"""WITH {_STR}, {_CMP}, s AS (SELECT series, quantile_cont(rate,0.5)>=0.2 AND {ct('rate>0.2')}>=3 AS ok FROM st GROUP BY 1),
    d AS (SELECT MAX(CASE WHEN series='search' THEN ok END) AS ss, MAX(CASE WHEN series='policy_only' THEN ok END) AND MAX(CASE WHEN series='policy_value' THEN ok END) AS sd FROM s),
    c AS (SELECT bool_and(passed OR subject<>'search') AS sc, bool_and(passed OR subject<>'student') AS tc FROM cp)
    SELECT ss AS search_strength, sd AS student_strength, sc AS search_competency, tc AS student_competency,
    CASE WHEN ss AND sc THEN 'admit_student_search' WHEN sd AND tc THEN 'admit_student' ELSE 'prototype_failure' END AS decision,
    CASE WHEN (ss AND sc) OR (sd AND tc) THEN 'continue' ELSE 'revise' END AS disposition FROM d, c""",
)
def g05(t):
    return G.admission(t.sql(f"WITH {_STR} SELECT * FROM st"), t.sql(f"WITH {_CMP} SELECT * FROM cp"), 0.2, 0.2, 3)


_CR = "cr AS (SELECT l_linenumber AS scenario, l_returnflag AS player_id, AVG(l_quantity)/50 AS correct_rate FROM lineitem WHERE NOT (l_linenumber=7 AND l_returnflag='R') GROUP BY 1, 2)"


@query(
    "G06_nonregression",
    f"""WITH {_CR} SELECT scenario, {r6("MAX(CASE WHEN player_id='R' THEN correct_rate END)")} AS candidate, {r6("MAX(CASE WHEN player_id='A' THEN correct_rate END)")} AS baseline,
    COALESCE(MAX(CASE WHEN player_id='R' THEN correct_rate END) >= MAX(CASE WHEN player_id='A' THEN correct_rate END) - 0.001, false) AS passed FROM cr GROUP BY 1""",
)
def g06(t):
    return rounded(G.nonregression(t.sql(f"WITH {_CR} SELECT * FROM cr"), ["scenario"], "R", "A", 0.001))


_VC = """vc AS (SELECT l_returnflag AS driver, 'cell-' || CAST(l_linenumber AS VARCHAR(20)) AS cell_id, AVG(l_quantity)*CASE WHEN l_returnflag='A' THEN 1.5 ELSE 1 END AS simulations_per_second,
  AVG(l_extendedprice) AS root_latency_seconds_p99, AVG(l_quantity)*CASE WHEN l_returnflag='N' THEN 0.5 ELSE 1 END AS rss_peak_bytes, AVG(l_tax)*CASE WHEN l_returnflag='N' THEN 0.5 ELSE 1 END AS rss_peak_delta_bytes
  FROM lineitem GROUP BY l_returnflag, l_linenumber)"""


@query(
    "G07_select_variant",
    f"""WITH {_VC}, w AS (SELECT f.cell_id, u.simulations_per_second/f.simulations_per_second AS us, u.root_latency_seconds_p99/f.root_latency_seconds_p99 AS ul, u.rss_peak_bytes/f.rss_peak_bytes AS ur,
      p.simulations_per_second/f.simulations_per_second AS ps, p.root_latency_seconds_p99/f.root_latency_seconds_p99 AS pl, p.rss_peak_bytes/f.rss_peak_bytes AS pr, p.rss_peak_delta_bytes/f.rss_peak_delta_bytes AS pd
      FROM vc f JOIN vc u ON u.cell_id=f.cell_id AND u.driver='A' JOIN vc p ON p.cell_id=f.cell_id AND p.driver='N' WHERE f.driver='R'),
    a AS (SELECT bool_and(us>=1.2 AND ul<=1.1 AND ur<=1.1) FILTER (cell_id IN ('cell-1','cell-2')) AS u, bool_and(ps>=0.9 AND pr<=1.0) FILTER (cell_id IN ('cell-3','cell-4')) AND
      bool_and(pr<=0.85 AND pd<=0.6) FILTER (cell_id='cell-4') AND bool_and(pd<=0.75) FILTER (cell_id='cell-3') AS r, bool_and(ps>=0.9 AND pl<=1.1 AND pr<=1.1) FILTER (cell_id IN ('cell-1','cell-2')) AS g FROM w)
    SELECT u AS undo_sequential, r AS page_retained, r AND g AS page_general, CASE WHEN r AND g THEN 'page_general' WHEN r AND u THEN 'hybrid_undo_page' WHEN r THEN 'hybrid_full_page' WHEN u THEN 'hybrid_undo_full' ELSE 'full_clone' END AS selection FROM a""",
)
def g07(t):
    return G.select_variant(t.sql(f"WITH {_VC} SELECT * FROM vc"), "R", "A", "N", ["cell-1", "cell-2"], "cell-3", "cell-4")


@query(
    "G08_resource_caps",
    f"""WITH r AS (SELECT user_id, event_id, SUM(value) OVER w AS wt, MAX(k) OVER w AS bp FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, {r6('wt')} AS wall_total, {r6('wt*4')} AS core_total, bp AS bytes_peak, wt<=2000 AND wt*4<=10000 AND bp<=95 AS passed, wt<2000 AND wt*4<10000 AND bp<95 AS launchable FROM r""",
)
def g08(t):
    led = t.v_events.select("user_id", F.col("event_id").alias("ordinal"), F.col("value").alias("wall_seconds"), F.col("k").alias("artifact_bytes"))
    out = G.resource_caps(led, ["user_id"], 2000.0, 10000.0, 95.0, 4)
    return rounded(out.select("user_id", F.col("ordinal").alias("event_id"), "wall_total", "core_total", "bytes_peak", "passed", "launchable"))


@query(
    "G09_arm_decision",
    f"""WITH a AS (SELECT l_returnflag AS arm, AVG(l_quantity)/50 AS x FROM lineitem GROUP BY 1), w AS (SELECT MAX(CASE WHEN arm='R' THEN x END) AS t, MAX(CASE WHEN arm='A' THEN x END) AS a, MAX(CASE WHEN arm='N' THEN x END) AS n FROM a)
    SELECT {r6('t')} AS target_accuracy, {r6('t-a')} AS "uplift_over_A", {r6('t-n')} AS "uplift_over_N", t>=0.5 AND t-a>=-0.01 AND t-n>=-0.01 AS criterion_met,
    CASE WHEN t>=0.5 AND t-a>=-0.01 AND t-n>=-0.01 THEN 'preliminary_opcode_alignment_signal' ELSE 'null_opcode_alignment_result' END AS decision FROM w""",
)
def g09(t):
    acc = t.lineitem.groupBy(F.col("l_returnflag").alias("arm")).agg((F.avg("l_quantity") / 50).alias("accuracy"))
    return rounded(G.arm_decision(acc, "R", ["A", "N"], 0.5, -0.01))


@query(
    "G10_budget_verdict",
    f"""WITH {_GATE}, e AS (SELECT "group", clause, bool_and(passed) AS passed FROM ga GROUP BY 1, 2), x AS (SELECT * FROM e UNION ALL SELECT 'overall', clause, passed FROM e)
    SELECT "group", CASE WHEN bool_and(passed) THEN 'pass' ELSE 'miss' END AS status, COALESCE(string_agg(CASE WHEN NOT passed THEN clause END, ',' ORDER BY clause), '') AS failures FROM x GROUP BY 1""",
)
def g10(t):
    per = _gate_rows(t).groupBy("group", "clause").agg(E.all_true(F.col("passed")).alias("passed"))
    return G.budget_verdict(per)


# ------------------------------------------------------------------ V


_ROW = """mr AS (SELECT l_orderkey AS match_id, 'p' || l_returnflag AS player_a, 'p' || l_linestatus AS player_b,
  CASE WHEN l_tax=0.01 THEN 'x' WHEN l_returnflag < l_linestatus THEN 'p' || l_returnflag || '__p' || l_linestatus ELSE 'p' || l_linestatus || '__p' || l_returnflag END AS cell_id,
  CAST(l_linenumber % 2 AS INT) AS leg, CAST(CASE WHEN l_quantity=3 THEN 1-l_linenumber % 2 ELSE l_linenumber % 2 END AS INT) AS player_a_seat, CAST(CASE WHEN l_discount=0 THEN NULL ELSE 0 END AS INT) AS winner,
  CASE WHEN l_discount=0 THEN 0.5E0 WHEN l_quantity=7 THEN 0.25E0 WHEN (CASE WHEN l_quantity=3 THEN 1-l_linenumber % 2 ELSE l_linenumber % 2 END)=0 THEN 1.0E0 ELSE 0.0E0 END AS score_a,
  l_tax=0.02 AS truncated, CASE WHEN l_tax=0.02 AND l_quantity<>9 THEN 'truncated' ELSE 'win' END AS termination_reason, l_quantity<>11 AS terminated,
  'd' || CAST(l_partkey AS VARCHAR(20)) AS trace_sha256, 'd' || CAST(CASE WHEN l_quantity=13 THEN 0 ELSE l_partkey END AS VARCHAR(20)) AS game_trace_sha256 FROM lineitem)"""


@query(
    "V01_match_rows",
    f"""WITH {_ROW}, g AS (SELECT match_id, cell_id <> least(player_a,player_b) || '__' || greatest(player_a,player_b) AS c, player_a_seat<>leg AS l,
      score_a <> CASE WHEN winner IS NULL THEN 0.5 WHEN winner=player_a_seat THEN 1.0 ELSE 0.0 END AS s, truncated <> (termination_reason='truncated') AS t, NOT (truncated OR terminated) AS n,
      trace_sha256<>game_trace_sha256 AS d FROM mr), k AS (SELECT *, CAST(match_id AS VARCHAR) AS key FROM g)
    SELECT 'cell_identity' AS rule, key, '' AS detail FROM k WHERE c UNION ALL SELECT 'leg_is_seat', key, '' FROM k WHERE l UNION ALL SELECT 'score_matches_winner', key, '' FROM k WHERE s
    UNION ALL SELECT 'truncation_reason', key, '' FROM k WHERE t UNION ALL SELECT 'terminal', key, '' FROM k WHERE n UNION ALL SELECT 'trace_digest', key, '' FROM k WHERE d""",
)
def v01(t):
    m = t.sql(f"WITH {_ROW} SELECT * FROM mr").withColumn("trace_path", F.concat(F.lit("traces/"), F.col("cell_id"), F.lit(".commands.jsonl.gz")))
    return V.violations_match_rows(m)


@query(
    "V02_registrations",
    """WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_nationkey % 2 = 0 AS code, c_acctbal<0 AS neg, c_mktsegment='BUILDING' AS b FROM customer)
    SELECT 'code_identity' AS rule, key, '' AS detail FROM k WHERE code AND neg UNION ALL SELECT 'code_is_production', key, '' FROM k WHERE code AND b
    UNION ALL SELECT 'checkpoint_identity', key, '' FROM k WHERE NOT code AND neg UNION ALL SELECT 'mutable_alias', key, '' FROM k WHERE NOT code AND b AND NOT neg""",
)
def v02(t):
    code, neg, b = F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    some = F.when(~code, F.lit(1))
    regs = t.customer.select(
        F.col("c_custkey").alias("player_id"), F.when(code, "code").otherwise("checkpoint").alias("runner_kind"), F.when(code & ~neg, "s").alias("source_sha256"),
        F.when(b, "smoke").otherwise("production").alias("evidence_class"), some.alias("checkpoint_sha256"), some.alias("checkpoint_bytes"), some.alias("parameter_count"), some.alias("training_seed"),
        F.when(~code & ~neg, F.when(b, "model-Latest").otherwise("model-1")).alias("artifact_id"),
    )
    return V.violations_registrations(regs)


@query("V03_integrity", "SELECT 'integrity_counter' AS rule, CAST(deal_block AS VARCHAR) AS key, '' AS detail FROM v_matches WHERE part_key % 50 = 0")
def v03(t):
    return V.violations_integrity(_matches(t), "deal_block")


@query(
    "V04_rederived",
    """WITH s AS (SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY 1), d AS (SELECT o_custkey AS c, COUNT(*) AS n FROM orders WHERE o_totalprice>20000 GROUP BY 1)
    SELECT CASE WHEN d.c IS NULL THEN 'not_derivable' ELSE 'n' END AS rule, CAST(s.c AS VARCHAR) AS key, '' AS detail FROM s LEFT JOIN d ON d.c=s.c WHERE d.c IS NULL OR s.n<>d.n""",
)
def v04(t):
    count = lambda df: df.groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return V.violations_rederived(count(t.orders), count(t.orders.filter("o_totalprice > 20000")), ["c"], ["n"])


@query(
    "V05_matched_corpora",
    """WITH s AS (SELECT o_orderkey AS position, l_returnflag AS player, MIN(l_linenumber) AS root FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1, 2),
    g AS (SELECT position, COUNT(*) AS n, MIN(root) AS lo, MAX(root) AS hi FROM s GROUP BY 1)
    SELECT 'same_root' AS rule, CAST(position AS VARCHAR) AS key, '' AS detail FROM g WHERE lo<>hi UNION ALL SELECT 'all_players', CAST(position AS VARCHAR), '' FROM g WHERE n<>3""",
)
def v05(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("position"), F.col("l_returnflag").alias("player_id")).agg(F.min("l_linenumber").alias("root_id"))
    return V.violations_matched_corpora(s.join(t.orders.select(F.col("o_orderkey").alias("position")), "position", "left_semi"))


def _index(t):
    k, u = F.col("k"), F.col("user_id")
    offer = lambda i, a: F.struct(i.cast("bigint").alias("id"), a.cast("bigint").alias("actor"))
    d = t.v_events.select(
        F.col("event_id").alias("decision_id"), F.when(k == 1, "other").otherwise("m").alias("match_id"), F.when(k == 2, "x").otherwise("c").alias("content_hash"), F.lit("a").alias("asset_manifest_hash"),
        u.alias("viewer"), F.when(k == 3, u + 1).otherwise(u).alias("prompt_actor"), k.alias("prompt_id"), offer(k, u).alias("offer"),
        F.array(offer(F.when(k == 4, F.lit(-1)).otherwise(k), u), offer(F.lit(-2), u)).alias("offers"), k.alias("revision"), (k % 10 == 5).alias("automatic"),
        F.when(k == 6, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("opponent_hand"),
        F.struct(F.when(k == 1, "other").otherwise("m").alias("match_id"), F.when(k == 7, F.lit(-1)).otherwise(k).alias("expected_revision"), k.alias("prompt_id"), k.alias("offer_id")).alias("played"),
    )
    marks = t.v_events.filter("event_type = 'view'").select(F.col("event_id").alias("decision_id"), F.when(k == 8, F.array(F.lit("branching_choice"), F.lit("target_selection"))).otherwise(F.array(F.lit("branching_choice"))).alias("reasons"))
    return V.violations_decision_index(d, marks, {"match_id": "m", "content_hash": "c", "asset_manifest_hash": "a"})


@query(
    "V06_decision_index",
    """WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS key FROM v_events)
    SELECT CASE k WHEN 1 THEN 'match' WHEN 2 THEN 'content_pack' WHEN 3 THEN 'viewer_binding' WHEN 4 THEN 'offer_in_frame' WHEN 6 THEN 'opponent_hand' ELSE 'played_command' END AS rule, key, '' AS detail
    FROM e WHERE k IN (1,2,3,4,6,7) UNION ALL SELECT 'landmark_not_forced', key, '' FROM e WHERE event_type='view' AND k % 10 = 5
    UNION ALL SELECT 'landmark_reasons', key, '' FROM e WHERE event_type='view' AND k=8""",
)
def v06(t):
    return _index(t)


def _workers(t):
    w = t.v_workers.select(
        "cell_id", "repeat", (F.col("worker") - 1).alias("worker"), F.when(F.col("elapsed_seconds") == 1, "b").otherwise("a").alias("driver"), F.lit(7).alias("root_seed"), F.lit("whole").alias("shape"),
        F.lit(3).alias("action_count"), F.when(F.col("elapsed_seconds") == 2, 11).otherwise(12).alias("simulations"),
    )
    cells = t.v_workers.select("cell_id").distinct().select(
        "cell_id", F.lit(2).alias("workers"), F.lit("a").alias("driver"), F.lit(7).alias("root_seed"), F.lit("whole").alias("shape"), F.lit(1).alias("actors_per_worker"), F.lit(2).alias("worlds"),
        F.lit(2).alias("rollouts_per_world"), F.lit(True).alias("whole"),
    )
    return V.violations_workers(w, cells)


@query(
    "V07_workers",
    """WITH w AS (SELECT *, cell_id || '/' || CAST(repeat AS VARCHAR) AS g FROM v_workers), t AS (SELECT g, COUNT(*) AS n, COUNT(DISTINCT worker) AS k, MIN(worker) AS lo, MAX(worker) AS hi FROM w GROUP BY 1)
    SELECT 'driver' AS rule, g || '/' || CAST(worker-1 AS VARCHAR) AS key, '' AS detail FROM w WHERE elapsed_seconds=1 UNION ALL SELECT 'simulations', g || '/' || CAST(worker-1 AS VARCHAR), '' FROM w WHERE elapsed_seconds=2
    UNION ALL SELECT 'topology', g, '' FROM t WHERE NOT (n=2 AND k=2 AND lo=1 AND hi=2)""",
)
def v07(t):
    return _workers(t)


@query(
    "V08_workload",
    """WITH g AS (SELECT CAST(game_index AS VARCHAR) AS key, * FROM v_games) SELECT 'terminal' AS rule, key, '' AS detail FROM g WHERE winner IS NULL UNION ALL SELECT 'decision_count', key, '' FROM g WHERE steps<=0 OR steps>8
    UNION ALL SELECT 'rows_match_decisions', key, '' FROM g WHERE turns<>steps UNION ALL SELECT 'traversals', key, '' FROM g WHERE skipped<>steps*2""",
)
def v08(t):
    g = t.v_games.select(F.col("game_index").alias("game_id"), F.col("winner").isNotNull().alias("terminal"), F.col("steps").alias("decisions"), F.col("turns").alias("rows"), F.col("skipped").alias("traversals"))
    return V.violations_workload(g, None, 2, 8)


@query(
    "V09_contract",
    """SELECT 'contract_mismatch' AS rule, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment || '->BUILDING' AS detail FROM customer WHERE c_mktsegment<>'BUILDING'""",
)
def v09(t):
    key = F.col("c_custkey").cast("string").alias("key")
    return V.violations_contract(t.customer.select(key, F.col("c_mktsegment").alias("value")), t.customer.select(key, F.lit("BUILDING").alias("value")))


@query(
    "V10_calibration_points",
    """SELECT 'truth_in_support' AS rule, CAST(event_id AS VARCHAR) AS key, '' AS detail FROM v_events WHERE k<5 UNION ALL SELECT 'finite_log_loss', CAST(event_id AS VARCHAR), '' FROM v_events WHERE k=7
    UNION ALL SELECT 'finite_ratio', CAST(event_id AS VARCHAR), '' FROM v_events WHERE k=8""",
)
def v10(t):
    inf, k = F.lit(float("inf")), F.col("k")
    p = t.v_events.select(
        F.col("event_id").alias("point_id"), F.when(k >= 5, k).alias("posterior_index"), k.alias("prior_index"), F.when(k == 7, inf).otherwise(1.0).alias("posterior_log_loss"), F.lit(1.0).alias("prior_log_loss"),
        F.when(k == 8, inf).otherwise(1.0).alias("mass_ratio"),
    )
    return V.violations_calibration_points(p)


@query("V11_forbidden_keys", "SELECT 'forbidden_key' AS rule, CAST(event_id AS VARCHAR) AS key, '' AS detail FROM v_events WHERE k % 4 = 0")
def v11(t):
    doc = F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.array(F.struct(F.col("props").alias("hand"))).alias("a")))).otherwise(F.to_json(F.struct(F.array("props").alias("hands"))))
    return V.violations_forbidden_keys(t.v_events.join(t.events.select("event_id", "props"), "event_id").select("event_id", doc.alias("doc")), "event_id", "doc", ["hand"])


@query(
    "V12_probe_rows",
    """WITH p AS (SELECT l_returnflag AS run, l_orderkey AS k, COUNT(*) AS n, MAX(l_linestatus) AS s FROM lineitem GROUP BY 1, 2), g AS (SELECT k, COUNT(*) AS c, COUNT(DISTINCT (n, s)) AS d FROM p GROUP BY 1)
    SELECT 'identical_row' AS rule, CAST(k AS VARCHAR) AS key, '' AS detail FROM g WHERE d>1 UNION ALL SELECT 'in_every_run', CAST(k AS VARCHAR), '' FROM g WHERE c<>3""",
)
def v12(t):
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("l_linestatus").alias("s"))
    return V.violations_probe_rows(p, "run", ["k"], ["n", "s"])


def _kept_matches(t):
    """The rows of ``v_matches``, written once in buckets by deal, so that groups that have a deal among their keys need no shuffle.

    Customers are joined to orders, which are fewer than line items; line items are cut to what a match needs before they are shuffled, meet
    their deals after all else that may need a shuffle, so that a task writes few buckets, and get names at the end. The table's name is
    given up at once; its files are scratch.
    """
    seats = "sn.n_name AS player_a, cn.n_name AS player_b,"
    legs = t.sql(ROLES["v_matches"].split("FROM lineitem l")[0].replace(seats, "") + "FROM lineitem l").drop("game_seconds")
    sellers = t.supplier.select("s_suppkey", "s_nationkey")
    deals = t.sql("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
    home = lambda seat, key: t.nation.select(F.col("n_name").alias(seat), F.col("n_nationkey").alias(key))
    rows = legs.join(sellers, F.col("supp_key") == F.col("s_suppkey")).join(deals, F.col("deal_block") == F.col("o_orderkey"))
    rows = rows.join(home("player_a", "s_nationkey"), "s_nationkey").join(home("player_b", "c_nationkey"), "c_nationkey").filter("player_a <> player_b")
    rows = rows.select("player_a", "player_b", *legs.columns)
    size = int(str(t.lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(1, min(int(t.spark.conf.get("spark.sql.shuffle.partitions")), size >> 21))
    name = f"kept_matches_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "deal_block").sortBy("deal_block").option("path", scratch_folder(t.spark, "matches")).saveAsTable(name)
    kept = t.spark.table(name)
    t.spark.sql(f"DROP TABLE {name}")
    return kept


def _bundle(t):
    m = _kept_matches(t).withColumns(
        {"match_id": F.concat_ws("/", "deal_block", "part_key", "supp_key"), "game_trace_sha256": F.concat_ws("-", "deal_block", "part_key", "supp_key", "leg"),
         "deal_seed": F.when(F.col("part_key") == 5, -1).otherwise(F.col("deal_block"))}
    )
    regs = t.nation.filter("n_nationkey <> 3").select(F.col("n_name").alias("player_id"))
    traces = m.filter("part_key <> 9").select("game_trace_sha256", "match_id")
    seeds = t.orders.select(F.col("o_orderkey").alias("deal_block"), F.col("o_orderkey").alias("deal_seed"))
    players = t.nation.select(F.col("n_name").alias("player"))
    return V.violations_bundle(m, regs, traces, players, 5, seeds, payoff_matrix(m).withColumn("draws", F.col("draws") + F.when(F.col("games") > 170, 1).otherwise(0)))


@query(
    "V13_bundle",
    """WITH m AS (SELECT *, CAST(deal_block AS VARCHAR) || '/' || CAST(part_key AS VARCHAR) || '/' || CAST(supp_key AS VARCHAR) AS id, CAST(deal_block AS VARCHAR) || '-' || CAST(part_key AS VARCHAR) || '-' || CAST(supp_key AS VARCHAR) || '-' || CAST(leg AS VARCHAR) AS tr FROM v_matches),
    h AS (SELECT least(player_a,player_b) || '__' || greatest(player_a,player_b) AS c, deal_block AS b, leg AS l, COUNT(*) AS n FROM v_matches GROUP BY 1, 2, 3),
    w AS (SELECT x.n_name || '__' || y.n_name AS c, r.b, s.l FROM nation x JOIN nation y ON x.n_name<y.n_name, range(5) r(b), range(2) s(l)),
    g AS (SELECT CASE WHEN n IS NULL THEN 'schedule_missing' WHEN w.c IS NULL THEN 'schedule_unexpected' ELSE 'schedule_duplicate' END AS rule, COALESCE(w.c,h.c) || '/' || CAST(COALESCE(w.b,h.b) AS VARCHAR) || '/' || CAST(COALESCE(w.l,h.l) AS VARCHAR) AS key, CAST(COALESCE(n,0) AS VARCHAR) AS detail
      FROM w FULL JOIN h ON w.c=h.c AND w.b=h.b AND w.l=h.l WHERE n IS NULL OR w.c IS NULL OR n>1),
    k AS (SELECT least(player_a,player_b) || '__' || greatest(player_a,player_b) AS c, COUNT(*) AS n FROM v_matches WHERE NOT truncated AND termination_reason<>'truncated' GROUP BY 1)
    SELECT 'trace_digest_repeated' AS rule, tr AS key, CAST(COUNT(*) AS VARCHAR) AS detail FROM m GROUP BY tr HAVING COUNT(*)>1 UNION ALL SELECT * FROM g
    UNION ALL SELECT 'deal_seed', id, '' FROM m WHERE part_key=5 UNION ALL SELECT 'row_without_trace', id, '' FROM m WHERE part_key=9
    UNION ALL SELECT 'unregistered_player', id, 'NATION_3' FROM m WHERE player_a='NATION_3' OR player_b='NATION_3' UNION ALL SELECT 'payoff_draws', c, '' FROM k WHERE n>170""",
)
def v13(t):
    return _bundle(t)


_WORD = lambda k: f"lpad(lower(to_hex((SUM(('0x' || substr(h, {1 + 8 * k}, 8))::HUGEINT) % 18446744073709551616)::UBIGINT)), 16, '0')"


@query(
    "V13_table_digests",
    f"""SELECT shard, COUNT(*) AS rows, {" || ".join(_WORD(k) for k in range(4))} AS digest FROM (
      SELECT o_orderkey % 16 AS shard, md5(concat_ws(chr(31), coalesce(o_custkey::VARCHAR, '\\N'), coalesce(o_orderkey::VARCHAR, '\\N'), coalesce(o_orderpriority, '\\N'))) AS h FROM orders) GROUP BY 1""",
)
def v13_digests(t):
    """The orders as sixteen shards, each with the digest of its rows."""
    d = t.orders.select((F.col("o_orderkey") % 16).alias("shard"), "o_orderkey", "o_custkey", "o_orderpriority")
    return V.multiset_digest(d, by=["shard"])


@query(
    "V13_artifacts",
    "SELECT 'artifact_mismatch' AS rule, 'payoff' AS key, COUNT(*)::VARCHAR || '/' || COUNT(*)::VARCHAR AS detail FROM (SELECT DISTINCT least(player_a,player_b), greatest(player_a,player_b) FROM v_matches WHERE NOT truncated AND termination_reason<>'truncated')",
)
def v13_artifacts(t):
    """Payoff cells with one changed, and untouched costs, as stored artifacts."""
    payoff = payoff_matrix(t.v_matches)
    first = payoff.agg(F.min("cell_id").alias("c"))
    changed = attach_row(payoff, first).withColumn("draws", F.when(F.col("cell_id") == F.col("c"), F.col("draws") + 1).otherwise(F.col("draws"))).drop("c")
    cost = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return V.violations_artifacts({"payoff": (changed, payoff), "cost": (cost.repartition(7), cost)})


# ------------------------------------------------------------------ Z and U


def _run_to_end(stream):
    """Run a stream over all available input into a table of files and read it back."""
    spark = stream.sparkSession
    path = scratch_folder(spark, "stream-out")
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", scratch_folder(spark, "stream-state"))
    writer.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.parquet(path)


def _kept(t, stream, keys):
    """Run a stream in update mode into a keyed table and read it back."""
    table = Z.KeyedTable(scratch_folder(t.spark, "keyed"), tuple(keys), buckets=16)
    table.start(stream, scratch_folder(t.spark, "stream-state"), availableNow=True).awaitTermination()
    return table.read(t.spark)


def _file_stream(t, name):
    # The table may be one file or a folder of files; a stream takes a file only by a pattern.
    return t.spark.readStream.schema(t.base(name).schema).parquet(f"{t.sf_dir}/{name}[.]parquet")


@query(
    "Z03_running_health",
    f"""SELECT user_id AS run, {ct("event_type='error'")} AS errors, {ct("value>100")} AS large FROM events GROUP BY 1""",
)
def z03(t):
    s = _file_stream(t, "events").select(F.col("user_id").alias("run"), (F.col("event_type") == "error").alias("errors"), (F.col("value") > 100).alias("large"), "ts")
    return _kept(t, Z.running_health(s, ["errors", "large"], ["run"]), ["run"])


@query("Z03_running_metrics")
def z03_metrics(t):
    """The decision log as a stream of files; each batch merges the evaluations that changed."""
    path = scratch_folder(t.spark, "decision-log")
    t.v_log.write.parquet(path)
    out = _kept(t, Z.running_metrics(t.spark.readStream.schema(t.v_log.schema).parquet(path)), ["evaluation_id"])
    return rounded(out)


ORACLES["Z03_running_metrics"] = ORACLES["A06_evaluation_metrics"]


@query(
    "Z02_ledger_stream",
    """SELECT conv_id AS ledger_id, turn AS ordinal, CASE WHEN turn=0 THEN CAST(NULL AS VARCHAR) ELSE 'chain_mismatch' END AS violation FROM conversations
    WHERE turn<=1 UNION ALL SELECT conv_id, turn, 'out_of_order' FROM conversations WHERE turn>1""",
)
def z02(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", Z.STATE_CONF["spark.sql.streaming.stateStore.providerClass"])
    body = F.concat(F.lit('{"kind":"'), F.col("role"), F.lit('","previous_event_sha256":null,"turn":'), F.col("turn").cast("string"), F.lit("}"))
    event = F.concat(F.lit('{"event_sha256":"'), F.sha2(body, 256), F.lit('",'), F.substr(body, F.lit(2)))
    s = _file_stream(t, "conversations").select(F.col("conv_id").cast("string").alias("ledger_id"), F.col("turn").cast("bigint").alias("ordinal"), event.alias("event"))
    out = _run_to_end(Z.verify_ledger_stream(s))
    return out.select(F.col("ledger_id").cast("bigint").alias("ledger_id"), "ordinal", "violation")


@query(
    "Z01_live_beliefs",
    """WITH d AS (SELECT user_id AS game, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS sequence FROM v_events),
    g AS (SELECT game, MIN(sequence) AS gap FROM d WHERE sequence>0 AND k=13 GROUP BY 1)
    SELECT CAST(d.game AS VARCHAR) AS game, sequence, CASE WHEN sequence=0 THEN 'reset' WHEN gap IS NULL OR sequence<gap THEN 'updated' ELSE 'invalid' END AS status,
    CASE WHEN gap IS NULL OR sequence<gap THEN 2 ELSE 0 END AS support_size FROM d LEFT JOIN g ON g.game=d.game""",
)
def z01(t):
    """One transition per event: the first resets, a jump of the revision invalidates the key."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", Z.STATE_CONF["spark.sql.streaming.stateStore.providerClass"])
    from scoreloom.functions import ordered as O

    seq = O.row_numbers(t.v_events, ["user_id"], "event_id", "rn").withColumn("sequence", F.col("rn") - 1)
    worlds = F.array(F.lit(0), F.lit(1)).cast("array<bigint>")
    rows = seq.select(
        F.col("user_id").cast("string").alias("game"), F.lit(0).alias("viewer"), "sequence",
        F.when((F.col("sequence") > 0) & (F.col("k") == 13), F.col("sequence") + 10).otherwise(F.col("sequence")).alias("before_revision"), (F.col("sequence") + 1).alias("after_revision"),
        (F.col("sequence") == 0).alias("reset"), worlds.alias("sources"), worlds.alias("targets"), F.array(F.lit(0.5), F.lit(0.25)).alias("factors"),
        F.lit(None).cast("array<bigint>").alias("evidence_worlds"), F.lit(None).cast("array<double>").alias("evidence"),
    )
    path = scratch_folder(t.spark, "transitions")
    rows.write.parquet(path)
    s = t.spark.readStream.schema(rows.schema).parquet(path)
    out = _run_to_end(Z.live_beliefs(s))
    return out.select("game", "sequence", "status", "support_size")


@query("U01_batch_scoring", f"SELECT vec_id, {r6('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))')} AS value FROM embeddings")
def u01(t):
    import pyarrow as pa

    def scorer(batch):
        import numpy as np

        lists = batch.column(batch.schema.get_field_index("embedding"))
        width = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        owner = np.repeat(np.arange(len(width)), width)
        return {"value": pa.array(np.bincount(owner, weights=flat, minlength=len(width)))}

    return rounded(score_batches(t.embeddings.select("vec_id", "embedding"), scorer, "value double").select("vec_id", "value"))
