"""Registered queries for ratings, paired tests, payoff tables and connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.operators import ratings as R
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6, rate, wilson


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


_KEPT = "NOT COALESCE(truncated, false) AND COALESCE(termination_reason,'') <> 'truncated'"

_ORIENT = f"""o AS (SELECT least(player_a, player_b) AS a, greatest(player_a, player_b) AS b, deal_block,
  CASE WHEN player_a > player_b THEN 1 - score_a ELSE score_a END AS s,
  CASE WHEN player_a > player_b THEN 1 - player_a_seat ELSE player_a_seat END AS seat FROM v_matches WHERE {_KEPT})"""


@query(
    "P01_retained",
    f"""SELECT player_a, termination_reason, COUNT(*) AS n, {ct('truncated')} AS flagged FROM v_matches WHERE {_KEPT} GROUP BY 1, 2""",
)
def p01(t):
    return R.retained(t.v_matches).groupBy("player_a", "termination_reason").agg(
        F.count(F.lit(1)).alias("n"), E.count_true(F.col("truncated")).alias("flagged")
    )


@query(
    "P02_orient_pairs",
    f"WITH {_ORIENT} SELECT a AS player_a, b AS player_b, seat AS player_a_seat, COUNT(*) AS n, {r6('SUM(s)')} AS score_a FROM o GROUP BY 1, 2, 3",
)
def p02(t):
    d = R.orient_pairs(R.retained(t.v_matches))
    return rounded(d.groupBy("player_a", "player_b", "player_a_seat").agg(F.count(F.lit(1)).alias("n"), F.sum("score_a").alias("score_a")))


@query(
    "P03_score_for",
    """SELECT deal_block, part_key, supp_key, CASE WHEN player_a='NATION_3' THEN score_a ELSE 1-score_a END AS score
    FROM v_matches WHERE player_a='NATION_3' OR player_b='NATION_3'""",
)
def p03(t):
    d = t.v_matches.withColumn("score", R.score_for(F.lit("NATION_3")))
    return d.filter(F.col("score").isNotNull()).select("deal_block", "part_key", "supp_key", "score")


_PAYOFF = f"""{_ORIENT}, bl AS (SELECT a, b, deal_block, COUNT(*) AS n, SUM(s) AS s, {ct('s=1')} AS w, {ct('s=0.5')} AS d, {ct('s=0')} AS l,
    {ct('seat=0')} AS n0, {ct('seat=1')} AS n1, SUM(CASE WHEN seat=0 THEN s ELSE 0 END) AS s0, SUM(CASE WHEN seat=1 THEN s ELSE 0 END) AS s1
    FROM o GROUP BY 1, 2, 3),
  m AS (SELECT a, b, CAST(SUM(n) AS BIGINT) AS games, SUM(s) AS score, CAST(SUM(w) AS BIGINT) AS w, CAST(SUM(d) AS BIGINT) AS d, CAST(SUM(l) AS BIGINT) AS l,
    CAST(SUM(n0) AS BIGINT) AS n0, CAST(SUM(n1) AS BIGINT) AS n1, SUM(s0) AS s0, SUM(s1) AS s1, COUNT(*) AS blocks,
    {ct('n=2 AND w=2')} AS sa, {ct('n=2 AND w=1 AND l=1')} AS sp, {ct('n=2 AND l=2')} AS sb FROM bl GROUP BY 1, 2)"""


@query(
    "A19_payoff_matrix",
    f"""WITH {_PAYOFF} SELECT a AS player_a, b AS player_b, a || '__' || b AS cell_id, games, {r6('score')} AS score_a,
    w AS wins_a, d AS draws, l AS wins_b, n0 AS games_seat0, n1 AS games_seat1, {r6('s0')} AS score_a_seat0, {r6('s1')} AS score_a_seat1,
    sa AS sweeps_a, sp AS splits, sb AS sweeps_b, {r6('score/games')} AS mean_score_a, {r6(rate('s0', 'n0', 'NULL'))} AS mean_score_a_seat0,
    {r6(rate('s1', 'n1', 'NULL'))} AS mean_score_a_seat1, blocks - sa - sp - sb AS draw_or_mixed FROM m""",
)
def a19(t):
    return rounded(R.payoff_matrix(t.v_matches))


@query("A19_payoff_matrix_expected")
def a19b(t):
    fit = R.fit_ratings(t.v_region_matches, "AFRICA")
    res = R.rating_residuals(t.v_region_matches, *R.split_fit(fit))
    return rounded(R.payoff_matrix(res, predicted=True))


@query("R01_fit_ratings")
def r01(t):
    return R.fit_ratings(t.v_region_matches, "AFRICA")


@query("R01_fit_ratings_by_year")
def r01b(t):
    m = t.v_region_matches.withColumn("year", F.floor((F.col("deal_block") - 1) / 12))
    return R.fit_ratings(m, "AFRICA", by=["year"])


@query("R02_rating_residuals")
def r02(t):
    fit = R.fit_ratings(t.v_region_matches, "AFRICA")
    return R.rating_residuals(t.v_region_matches, *R.split_fit(fit))


# Declared ratings: one per region, and a seat effect.
_GIVEN = f"""g AS (SELECT r_name AS player, 1000.0E0 + 35.0E0*r_regionkey AS rating FROM region),
  e AS (SELECT m.*, 1/(1+exp(-(ga.rating - gb.rating + CASE WHEN player_a_seat=0 THEN -20.0E0 ELSE 20.0E0 END)*ln(10.0E0)/400)) AS p
    FROM v_region_matches m JOIN g ga ON ga.player=player_a JOIN g gb ON gb.player=player_b WHERE {_KEPT}),
  x AS (SELECT *, 2*(CASE WHEN score_a>0 THEN score_a*ln(score_a/p) ELSE 0 END + CASE WHEN score_a<1 THEN (1-score_a)*ln((1-score_a)/(1-p)) ELSE 0 END) AS dev FROM e)"""


def _given(t):
    ratings = t.region.select(F.col("r_name").alias("player"), (1000.0 + 35.0 * F.col("r_regionkey")).alias("rating"))
    seat = t.region.agg(F.lit(-20.0).alias("seat0_elo"))
    return R.rating_residuals(t.v_region_matches, ratings, seat)


@query(
    "R02_given_ratings",
    f"""WITH {_GIVEN} SELECT player_a, player_b, deal_block, player_a_seat, score_a, {r6('p')} AS predicted_score_a, {r6('score_a-p')} AS raw_residual,
    {r6('(score_a-p)/sqrt(p*(1-p))')} AS pearson_residual, {r6('dev')} AS deviance FROM x""",
)
def r02_given(t):
    return rounded(_given(t).drop("truncated", "termination_reason"))


@query(
    "A19_expected_given_ratings",
    f"""WITH {_GIVEN}, o AS (SELECT least(player_a, player_b) AS a, greatest(player_a, player_b) AS b, CASE WHEN player_a>player_b THEN 1-score_a ELSE score_a END AS s,
      CASE WHEN player_a>player_b THEN 1-p ELSE p END AS p, dev FROM x)
    SELECT a || '__' || b AS cell_id, COUNT(*) AS games, {r6('SUM(p)')} AS expected_score_a, {r6('SUM(p)/COUNT(*)')} AS expected_mean_score_a,
    {r6('100*(SUM(s)-SUM(p))/COUNT(*)')} AS raw_residual_percentage_points, {r6('(SUM(s)-SUM(p))/sqrt(SUM(p*(1-p)))')} AS pearson_residual, {r6('SUM(dev)')} AS cell_deviance
    FROM o GROUP BY a, b""",
)
def a19_given(t):
    m = R.payoff_matrix(_given(t), predicted=True)
    return rounded(m.select("cell_id", "games", "expected_score_a", "expected_mean_score_a", "raw_residual_percentage_points", "pearson_residual", "cell_deviance"))


@query("R03_bootstrap_ratings")
def r03(t):
    return R.bootstrap_ratings(t.v_region_matches, "AFRICA", replicates=200, seed=63001)


@query(
    "R04_top_residuals",
    f"""WITH {_PAYOFF}, r AS (SELECT a || '__' || b AS cell_id, 100*(score/games - 0.5) AS x FROM m)
    SELECT cell_id, {r6('x')} AS raw_residual_percentage_points FROM r ORDER BY abs(x) DESC, cell_id LIMIT 10""",
)
def r04(t):
    m = R.payoff_matrix(t.v_matches).withColumn("raw_residual_percentage_points", 100 * (F.col("mean_score_a") - 0.5))
    return rounded(R.top_residuals(m, 10).select("cell_id", "raw_residual_percentage_points"))


# Paired outcomes: one answer per (scenario, seed) of two players.
_PAIR = """pl AS (SELECT o_orderpriority AS scenario, o_orderkey AS run_seed, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS correct FROM orders),
  pr AS (SELECT o_orderpriority AS scenario, CASE WHEN o_orderstatus <> 'P' OR o_totalprice > 100000 THEN o_orderkey ELSE -o_orderkey END AS run_seed,
    CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS correct FROM orders)"""


def _pair(t):
    left = t.sql(f"WITH {_PAIR} SELECT * FROM pl")
    right = t.sql(f"WITH {_PAIR} SELECT * FROM pr")
    return R.paired_join(left, right, ["scenario", "run_seed"], "correct")


@query(
    "J01_paired_join",
    f"WITH {_PAIR} SELECT pl.scenario, pl.run_seed, pl.correct AS left_value, pr.correct AS right_value FROM pl JOIN pr ON pl.scenario=pr.scenario AND pl.run_seed=pr.run_seed",
)
def j01(t):
    return _pair(t)[0]


@query(
    "J01_paired_join_violations",
    f"""WITH {_PAIR} SELECT 'unpaired_key' AS rule, pl.scenario || '/' || CAST(pl.run_seed AS VARCHAR) AS key, '1:0' AS detail
    FROM pl ANTI JOIN pr ON pl.scenario=pr.scenario AND pl.run_seed=pr.run_seed
    UNION ALL SELECT 'unpaired_key', pr.scenario || '/' || CAST(pr.run_seed AS VARCHAR), '0:1' FROM pr ANTI JOIN pl ON pl.scenario=pr.scenario AND pl.run_seed=pr.run_seed""",
)
def j01b(t):
    return _pair(t)[1]


@query(
    "R05_paired_difference",
    f"""WITH {_PAIR} SELECT pl.scenario, {r6('AVG(pl.correct-pr.correct)')} AS point_difference, COUNT(*) AS pairs,
    AVG(pl.correct-pr.correct) >= -0.05 AS point_passed FROM pl JOIN pr ON pl.scenario=pr.scenario AND pl.run_seed=pr.run_seed GROUP BY 1""",
)
def r05(t):
    return rounded(R.noninferiority(_pair(t)[0], 0.05, replicates=200).select("scenario", "point_difference", "pairs", "point_passed"))


@query("R05_noninferiority")
def r05b(t):
    return R.noninferiority(_pair(t)[0], 0.05, replicates=2000, seed=7)


@query(
    "R06_cluster_contrast",
    f"""WITH {_PAIR}, d AS (SELECT pl.scenario, pl.correct-pr.correct AS v FROM pl JOIN pr ON pl.scenario=pr.scenario AND pl.run_seed=pr.run_seed),
    a AS (SELECT scenario, AVG(v) AS md, COUNT(*) AS clusters, {ct('v>0')} AS wins, {ct('v<0')} AS losses, {ct('v=0')} AS ties FROM d GROUP BY 1),
    p AS (SELECT scenario, SUM(exp(lgamma(wins+losses+1)-lgamma(i+1)-lgamma(wins+losses-i+1)-(wins+losses)*ln(2))) AS tail
      FROM a, UNNEST(range(0, least(wins, losses) + 1)) r(i) GROUP BY 1)
    SELECT a.scenario, {r6('md')} AS mean_difference, clusters, wins, losses, ties, {r6('least(1.0, 2*tail)')} AS two_sided_exact_sign_p
    FROM a JOIN p ON p.scenario=a.scenario""",
)
def r06(t):
    out = R.cluster_contrast(_pair(t)[0], ["scenario"], replicates=100)
    return rounded(out.drop("ci95_low", "ci95_high"))


@query("R06_cluster_contrast_interval")
def r06b(t):
    return R.cluster_contrast(_pair(t)[0], ["scenario"])


_CL = """cl AS (SELECT l_orderkey AS program, l_suppkey % 3 AS model_seed, l_linestatus AS deck, l_linenumber % 2 AS seat,
  l_orderkey % 7 < 3 OR l_linenumber = 7 AS correct FROM lineitem)"""


def _clusters(t):
    return t.sql(f"WITH {_CL} SELECT * FROM cl")


@query(
    "R07_cluster_outcomes",
    f"""WITH {_CL} SELECT model_seed, program, bool_and(correct) AS correct FROM cl GROUP BY 1, 2 HAVING COUNT(DISTINCT correct)=1""",
)
def r07(t):
    return R.cluster_outcomes(_clusters(t))[0]


@query(
    "R07_cluster_outcome_violations",
    f"""WITH {_CL} SELECT 'unstable_cluster' AS rule, CAST(model_seed AS VARCHAR) || '/' || CAST(program AS VARCHAR) AS key,
    CAST(COUNT(*) AS VARCHAR) AS detail FROM cl GROUP BY model_seed, program HAVING COUNT(DISTINCT correct)>1""",
)
def r07b(t):
    return R.cluster_outcomes(_clusters(t))[1]


_Z = "1.959963984540054"


@query(
    "R08_cluster_accuracy",
    f"""WITH {_CL}, o AS (SELECT model_seed, program, bool_and(correct) AS correct FROM cl GROUP BY 1, 2 HAVING COUNT(DISTINCT correct)=1),
    s AS (SELECT 'clusters' AS scope, 'all' AS level, correct FROM o UNION ALL SELECT 'deck', deck, correct FROM cl
      UNION ALL SELECT 'seat', CAST(seat AS VARCHAR), correct FROM cl),
    a AS (SELECT scope, level, {ct('correct')} AS successes, COUNT(*) AS total FROM s GROUP BY 1, 2)
    SELECT a.*, {r6('successes/total')} AS accuracy, {r6(wilson('successes', 'total', 'lo', _Z))} AS ci95_low,
    {r6(wilson('successes', 'total', 'hi', _Z))} AS ci95_high FROM a""",
)
def r08(t):
    return rounded(R.cluster_accuracy(_clusters(t), ["model_seed", "program"], ["deck", "seat"]))


_SEED = """sd AS (SELECT event_type AS arm, k % 4 AS family, user_id % 5 AS seed, AVG(value)/500 AS acc FROM v_events GROUP BY 1, 2, 3)"""


@query(
    "R09_t_interval",
    f"""WITH {_SEED}, a AS (SELECT arm, family, COUNT(acc) AS n, AVG(acc) AS m, stddev_samp(acc) AS s, MIN(acc) AS mn, MAX(acc) AS mx FROM sd GROUP BY 1, 2)
    SELECT arm, family, n, {r6('m')} AS mean, {r6('s')} AS stdev, {r6('mn')} AS min, {r6('mx')} AS max, n=5 AS valid,
    CASE WHEN n=5 THEN {r6('m-2.7764451051977987*s/sqrt(5)')} END AS t95_low, CASE WHEN n=5 THEN {r6('m+2.7764451051977987*s/sqrt(5)')} END AS t95_high FROM a""",
)
def r09(t):
    return rounded(R.t_interval(t.sql(f"WITH {_SEED} SELECT * FROM sd"), "acc", ["arm", "family"]))


@query(
    "R10_uplift",
    f"""WITH {_SEED}, d AS (SELECT l.family, l.acc-r.acc AS x FROM sd l JOIN sd r ON l.seed=r.seed AND l.family=r.family WHERE l.arm='click' AND r.arm='view'),
    a AS (SELECT family, COUNT(x) AS n, AVG(x) AS m, stddev_samp(x) AS s, MIN(x) AS mn, MAX(x) AS mx FROM d GROUP BY 1)
    SELECT family, n, {r6('m')} AS mean, {r6('s')} AS stdev, {r6('mn')} AS min, {r6('mx')} AS max, n=5 AS valid,
    {r6('m-2.7764451051977987*s/sqrt(5)')} AS t95_low, {r6('m+2.7764451051977987*s/sqrt(5)')} AS t95_high FROM a""",
)
def r10(t):
    sd = t.sql(f"WITH {_SEED} SELECT * FROM sd")
    return rounded(R.uplift(sd.filter("arm = 'click'"), sd.filter("arm = 'view'"), ["family", "seed"], "acc", ["family"]))


@query(
    "R11_wilson_variants",
    f"""WITH a AS (SELECT l_suppkey, {ct("l_returnflag='R'")} AS wins, {ct("l_quantity > 45")} AS total, {ct("l_returnflag='R' AND l_quantity > 45")} AS w FROM lineitem GROUP BY 1)
    SELECT l_suppkey, {r6(wilson('w', 'total', 'lo'))} AS lower_zero, {r6(wilson('w', 'total', 'hi'))} AS upper_zero,
    {r6(wilson('w', 'total', 'hi', empty=('0.0', '1.0')))} AS upper_one, {r6(wilson('w', 'total', 'lo', _Z))} AS lower_exact FROM a""",
)
def r11(t):
    a = t.lineitem.groupBy("l_suppkey").agg(
        E.count_true(F.col("l_quantity") > 45).alias("total"),
        E.count_true((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("w"),
    )
    lo, hi = E.wilson("w", "total")
    _, one = E.wilson("w", "total", empty=(0.0, 1.0))
    ex, _ = E.wilson("w", "total", E.Z95_EXACT)
    return rounded(a.select("l_suppkey", lo.alias("lower_zero"), hi.alias("upper_zero"), one.alias("upper_one"), ex.alias("lower_exact")))


@query(
    "R12_mean_ci95",
    f"""SELECT user_id, COUNT(value) AS n, {r6('AVG(value)')} AS mean,
    {r6('CASE WHEN COUNT(*)>=2 THEN AVG(value)-1.96*stddev_samp(value)/sqrt(COUNT(*)) ELSE AVG(value) END')} AS ci95_lower,
    {r6('CASE WHEN COUNT(*)>=2 THEN AVG(value)+1.96*stddev_samp(value)/sqrt(COUNT(*)) ELSE AVG(value) END')} AS ci95_upper FROM events GROUP BY 1""",
)
def r12(t):
    return rounded(R.mean_ci95(t.events, "value", ["user_id"]))


@query(
    "R13_spearman",
    f"""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1)/2.0 AS rx,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1)/2.0 AS ry FROM lineitem)
    SELECT l_returnflag, COUNT(*) AS n, {r6('corr(rx, ry)')} AS spearman FROM r GROUP BY 1""",
)
def r13(t):
    return rounded(R.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query(
    "R14_arm_gap",
    f"""WITH a AS (SELECT matchup, COUNT(*) AS n, {ct('hero_won')} AS w FROM v_games GROUP BY 1),
    s AS (SELECT matchup, {rate('w', 'n')} AS r, {wilson('w', 'n', 'lo')} AS lo, {wilson('w', 'n', 'hi')} AS hi FROM a)
    SELECT {r6('l.r')} AS left_win_rate, {r6('l.lo')} AS left_win_ci_lower, {r6('l.hi')} AS left_win_ci_upper,
    {r6('r.r')} AS right_win_rate, {r6('r.lo')} AS right_win_ci_lower, {r6('r.hi')} AS right_win_ci_upper, {r6('l.r-r.r')} AS win_rate_delta
    FROM s l, s r WHERE l.matchup='1-URGENT' AND r.matchup='5-LOW'""",
)
def r14(t):
    from scoreloom.operators.aggregates import matchup_summary

    return rounded(R.arm_gap(matchup_summary(t.v_games), "matchup", "1-URGENT", "5-LOW"))


@query(
    "R15_cross_seed",
    f"""WITH {_SEED} SELECT arm, {r6('quantile_cont(acc,0.5)')} AS median_rate, {ct('acc>0.1')} AS seeds_above, COUNT(acc) AS seeds,
    quantile_cont(acc,0.5) >= 0.1 AND {ct('acc>0.1')} >= 10 AS passed FROM sd GROUP BY 1""",
)
def r15(t):
    return rounded(R.cross_seed(t.sql(f"WITH {_SEED} SELECT * FROM sd"), "acc", ["arm"], 0.1, 0.1, 10))


# Edges only between nations of one region: the graph falls into one component per region.
_EDGE = """ed AS (SELECT DISTINCT least(m.player_a, m.player_b) AS a, greatest(m.player_a, m.player_b) AS b FROM v_matches m
  JOIN nation x ON x.n_name=m.player_a JOIN nation y ON y.n_name=m.player_b WHERE x.n_regionkey=y.n_regionkey)"""


def _edges(t):
    return t.sql(f"WITH {_EDGE} SELECT * FROM ed"), t.nation.select(F.col("n_name").alias("player"))


@query(
    "R16_connectivity",
    f"""WITH RECURSIVE {_EDGE}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    reach AS (SELECT n_name AS src, n_name AS dst FROM nation UNION SELECT r.src, bo.b FROM reach r JOIN bo ON bo.a=r.dst),
    c AS (SELECT src, MIN(dst) AS comp FROM reach GROUP BY 1), n AS (SELECT COUNT(*) AS nodes, COUNT(DISTINCT comp) AS cc FROM c),
    e AS (SELECT COUNT(*) AS oe FROM ed)
    SELECT nodes, oe AS observed_edges, CAST(nodes*(nodes-1)/2 AS BIGINT) AS expected_edges, cc AS component_count, cc=1 AS anchor_reaches_all,
    CAST(nodes*(nodes-1)/2 AS BIGINT)-oe AS missing_edges, 0 AS unexpected_edges, nodes*(nodes-1)/2=oe AS complete_graph FROM n, e""",
)
def r16(t):
    e, p = _edges(t)
    return R.connectivity(p, e, "NATION_3")[0]


@query(
    "R16_connectivity_gaps",
    f"""WITH {_EDGE} SELECT 'missing_edge' AS rule, x.n_name || '__' || y.n_name AS key, '' AS detail FROM nation x JOIN nation y ON x.n_name<y.n_name
    ANTI JOIN ed ON ed.a=x.n_name AND ed.b=y.n_name""",
)
def r16b(t):
    e, p = _edges(t)
    return R.connectivity(p, e, "NATION_3")[1]


@query("R16_adjacency", f"WITH {_EDGE} SELECT a AS player, b AS neighbour FROM ed UNION SELECT b, a FROM ed")
def r16c(t):
    return R.adjacency(_edges(t)[0])


@query("R17_uncertainty_violations")
def r17(t):
    boot = R.bootstrap_ratings(t.v_region_matches, "AFRICA", replicates=50, seed=63001)
    return R.uncertainty(boot, t.region.select(F.col("r_name").alias("player")), 50)[1]


_DECLARED = """p AS (SELECT s_suppkey, s_name AS name, s_nationkey FROM supplier),
    iv AS (SELECT 'rating' AS kind, name, CASE WHEN s_suppkey % 5 = 0 THEN 49 ELSE 50 END AS fits FROM p WHERE s_nationkey <> 3
    UNION ALL SELECT 'difference', a.name || '__minus__' || b.name, 50 FROM p a JOIN p b ON a.name < b.name WHERE (a.s_suppkey + b.s_suppkey) % 7 <> 0
    UNION ALL SELECT 'failure', '', 2 FROM region WHERE r_regionkey = 0)"""


def _declared_differences(t):
    """The differences of ``iv``, equal ones once: whether two names have one depends on their keys modulo 7 only.

    The pairs are dealt to tasks by number, because the roster is small in bytes and would be paired in one task; a roster whose pairs can be
    listed is sent to all tasks, whatever the session's limit is, as a product of shuffled rows takes longer.
    """
    names = t.supplier.select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).alias("k")).distinct()
    left = names.select(F.col("name").alias("a"), F.col("k").alias("j")).repartition(16 * t.spark.sparkContext.defaultParallelism)
    pairs = left.join(F.broadcast(names), (F.col("a") < F.col("name")) & ((F.col("j") + F.col("k")) % 7 != 0))
    return pairs.select(F.lit("difference").alias("kind"), F.concat_ws("__minus__", "a", "name").alias("name"), F.lit(50).alias("fits"))


@query(
    "R17_declared_intervals",
    f"""WITH {_DECLARED}, want AS (SELECT 'rating' AS kind, name FROM p UNION ALL SELECT 'seat', 'seat0_elo'
      UNION ALL SELECT 'difference', a.name || '__minus__' || b.name FROM p a JOIN p b ON a.name < b.name)
    SELECT 'missing_interval' AS rule, kind || '/' || name AS key, '' AS detail FROM want ANTI JOIN iv USING (kind, name)
    UNION ALL SELECT 'failed_replicates', kind || '/' || name, CAST(fits AS VARCHAR) FROM iv WHERE kind = 'failure' OR fits <> 50""",
)
def r17_declared(t):
    """Intervals of all suppliers with gaps: a nation without ratings, some differences, no seat effect, short and failed replicates."""
    intervals = t.sql(f"WITH {_DECLARED} SELECT * FROM iv WHERE kind <> 'difference'").unionByName(_declared_differences(t))
    return R.uncertainty(intervals, t.supplier.select(F.col("s_name").alias("player")), 50)[1]
