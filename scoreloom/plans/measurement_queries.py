"""Registered queries for latency, search, measurement-cell, span and data-set summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.operators import measurements as M
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6, rate


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


# Long form of the embedding table read as visit counts and priors (DuckDB side).
EMB = """e AS (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, CAST(i AS INT) AS i FROM
  (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) u),
 v AS (SELECT vec_id, label, i, x, CAST(floor(abs(x)*1000) AS BIGINT) AS visits, abs(x) AS a FROM e),
 d AS (SELECT *, visits/SUM(visits) OVER (PARTITION BY vec_id) AS p, a/SUM(a) OVER (PARTITION BY vec_id) AS prior,
   MAX(visits) OVER (PARTITION BY vec_id) AS vmax, MAX(a) OVER (PARTITION BY vec_id) AS amax FROM v)"""


def samples(t):
    """Embeddings as root samples: scaled magnitudes are visit counts, magnitudes the prior."""
    mag = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return t.embeddings.select(
        "vec_id", "label", "embedding",
        F.transform(mag, lambda x: F.floor(x * 1000)).alias("visit_counts"),
        E.normalised(mag).alias("input_prior"),
        mag.alias("magnitude"),
    )


@query(
    "A15_search_cost",
    f"""WITH l AS (SELECT o_orderpriority AS player_id, l_quantity/10 AS s FROM lineitem JOIN orders ON o_orderkey=l_orderkey),
    q AS (SELECT player_id, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95 FROM l GROUP BY 1),
    b AS (SELECT o_orderpriority AS player_id, o_orderkey, COUNT(*) AS decisions, SUM(l_quantity/10) AS seconds,
      CAST(SUM(l_partkey) AS BIGINT) AS simulations, {ct('l_tax=0')} AS cap_hits, CAST(SUM(l_linenumber) AS BIGINT) AS ds,
      MAX(l_linenumber) AS dm FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1, 2),
    a AS (SELECT player_id, CAST(SUM(decisions) AS BIGINT) AS decisions, SUM(seconds) AS sec, CAST(SUM(simulations) AS BIGINT) AS simulations,
      CAST(SUM(cap_hits) AS BIGINT) AS cap_hits, SUM(ds) AS ds, MAX(dm) AS max_depth_max FROM b GROUP BY 1)
    SELECT a.player_id, decisions, {r6('sec')} AS seconds, simulations, cap_hits, max_depth_max,
    {r6('sec/decisions')} AS mean_seconds_per_decision, {r6('p50')} AS median_seconds_per_decision,
    {r6('simulations/decisions')} AS mean_sims_per_decision, {r6('cap_hits/simulations')} AS cap_rate,
    {r6('p50*1000')} AS p50_decision_ms, {r6('p95*1000')} AS p95_decision_ms, {r6('decisions/sec')} AS labels_per_second,
    {r6('ds/decisions')} AS mean_max_depth FROM a JOIN q ON q.player_id = a.player_id""",
)
def a15(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    blocks = j.groupBy(F.col("o_orderpriority").alias("player_id"), "o_orderkey").agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(F.col("l_quantity") / 10).alias("seconds"),
        F.sum("l_partkey").alias("simulations"), E.count_true(F.col("l_tax") == 0).alias("cap_hits"),
        F.sum("l_linenumber").alias("max_depth_sum"), F.max("l_linenumber").alias("max_depth"),
        F.collect_list(F.col("l_quantity") / 10).alias("decision_seconds"),
    )
    return rounded(M.search_cost(blocks))


def _latency_matches(t):
    g = t.v_games
    block = lambda f: F.struct(
        F.col("steps").alias("count"), (F.col("duration") * f).alias("seconds"),
        F.when(F.col("steps") > 0, F.col("duration") / 10 * f).alias("p50"),
        F.when(F.col("steps") > 0, F.col("duration") / 5 * f).alias("p95"),
    )
    return g.select(
        "game_index", F.col("duration").alias("game_seconds"),
        F.create_map(F.col("matchup"), block(1.0), F.lit("shared"), block(0.5)).alias("latency"),
    )


_LAT = """l AS (SELECT matchup AS player_id, game_index, steps, duration AS sec, duration AS gs,
   CASE WHEN steps > 0 THEN duration/10 END AS p50, CASE WHEN steps > 0 THEN duration/5 END AS p95 FROM v_games
   UNION ALL SELECT 'shared', game_index, steps, duration*0.5, duration, CASE WHEN steps > 0 THEN duration/10*0.5 END,
   CASE WHEN steps > 0 THEN duration/5*0.5 END FROM v_games)"""


@query(
    "A16_native_profile",
    f"""WITH {_LAT}, a AS (SELECT player_id, CAST(SUM(steps) AS BIGINT) AS decisions, SUM(sec) AS s, COUNT(*) AS games,
    SUM(gs) AS g, COUNT(p50) AS quantile_cells FROM l GROUP BY 1)
    SELECT player_id, decisions, {r6('s')} AS decision_seconds, games, {r6('g')} AS game_seconds, quantile_cells,
    {r6(rate('decisions', 's', 'NULL'))} AS decisions_per_second, {r6(rate('games', 'g', 'NULL'))} AS games_per_second FROM a""",
)
def a16(t):
    return rounded(M.native_profile(_latency_matches(t)))


@query(
    "A16_native_profile_cells",
    f"""WITH {_LAT} SELECT game_index, player_id, {r6('p50', 9)} AS p50, {r6('p95', 9)} AS p95 FROM l WHERE p50 IS NOT NULL""",
)
def a16b(t):
    return rounded(M.native_profile_cells(_latency_matches(t), ["game_index"]), 9)


@query(
    "A17_isolated_profile",
    f"""WITH a AS (SELECT l_returnflag AS player_id, COUNT(*) AS samples, SUM(l_quantity/1000) AS el,
    SUM(l_partkey) AS sims, {ct('l_tax=0')} AS caps, SUM(l_suppkey) AS nodes, MAX(l_partkey) AS pk, MIN(l_suppkey) AS bs,
    quantile_cont(l_quantity/1000, 0.5) AS p50, quantile_cont(l_quantity/1000, 0.95) AS p95 FROM lineitem GROUP BY 1)
    SELECT player_id, samples, {r6('el')} AS elapsed, {r6('p50')} AS p50_seconds, {r6('p95')} AS p95_seconds,
    {r6('samples/el')} AS decisions_per_second, {r6('sims/el')} AS simulations_per_second, {r6('nodes/el')} AS nodes_per_second,
    {r6('el/samples')} AS cpu_seconds_per_label, {r6('nodes/samples')} AS nodes_per_label, {r6('caps/sims')} AS playout_cap_rate,
    greatest(0, pk - bs) AS peak_rss_delta_bytes FROM a""",
)
def a17(t):
    s = t.lineitem.select(
        F.col("l_returnflag").alias("player_id"), (F.col("l_quantity") / 1000).alias("latency_seconds"),
        F.col("l_partkey").alias("simulations"), F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("cap_hits"),
        F.col("l_suppkey").alias("tree_nodes"), F.col("l_partkey").alias("peak_rss_bytes"),
        F.col("l_suppkey").alias("baseline_rss_bytes"),
    )
    return rounded(M.isolated_profile(s))


def _decks(t):
    return t.v_matches.select(
        F.when(F.col("player_a_seat") == 0, F.array("player_a", "player_b"))
        .otherwise(F.array("player_b", "player_a")).alias("seat_decks"),
        F.when(F.col("score_a") == 0.5, F.lit(None))
        .when(F.col("score_a") == 1.0, F.col("player_a_seat"))
        .otherwise(1 - F.col("player_a_seat")).cast("int").alias("winner_seat"),
    )


_DECK = """r AS (SELECT CASE WHEN player_a_seat=0 THEN player_a ELSE player_b END AS d0,
  CASE WHEN player_a_seat=0 THEN player_b ELSE player_a END AS d1,
  CASE WHEN score_a=0.5 THEN NULL WHEN score_a=1 THEN player_a_seat ELSE 1-player_a_seat END AS w FROM v_matches)"""


@query(
    "A18_deck_wins",
    f"""WITH {_DECK} SELECT CASE WHEN w IS NULL THEN 'draw' WHEN w=0 THEN d0 ELSE d1 END AS deck, COUNT(*) AS wins,
    CASE WHEN deck <> 'draw' THEN {r6('COUNT(*)/(SELECT COUNT(*) FROM r)')} END AS rate FROM r GROUP BY 1""",
)
def a18(t):
    return rounded(M.deck_wins(_decks(t))[0])


@query(
    "A18_deck_seats",
    f"""WITH {_DECK}, s AS (SELECT d0 AS deck, 0 AS seat, w FROM r UNION ALL SELECT d1, 1, w FROM r)
    SELECT deck, seat, COUNT(*) AS games, {ct('w=seat')} AS wins, {r6(ct('w=seat') + '/COUNT(*)')} AS win_rate
    FROM s GROUP BY 1, 2""",
)
def a18b(t):
    return rounded(M.deck_wins(_decks(t))[1])


_MECH = f"""{EMB}, m AS (SELECT vec_id, ANY_VALUE(label) AS label,
   -SUM(CASE WHEN p>0 THEN p*ln(p) ELSE 0 END) AS ent, SUM(abs(p-prior)) AS l1,
   0.5*SUM(CASE WHEN p>0 THEN p*ln(p/((p+prior)/2)) ELSE 0 END)
   +0.5*SUM(CASE WHEN prior>0 THEN prior*ln(prior/((p+prior)/2)) ELSE 0 END) AS jsd,
   CASE WHEN MIN(CASE WHEN visits=vmax THEN i END)=MIN(CASE WHEN a=amax THEN i END) THEN 1 ELSE 0 END AS agree
   FROM d GROUP BY vec_id)"""


@query(
    "A20_root_mechanism",
    f"""WITH {_MECH} SELECT vec_id, {r6('ent')} AS visit_entropy, {r6('ent/ln(64)')} AS normalized_visit_entropy,
    {r6('l1')} AS prior_visit_l1, {r6('jsd')} AS prior_visit_jsd, agree AS prior_top_search_top_agreement FROM m""",
)
def a20(t):
    out = M.root_mechanism(samples(t)).select("vec_id", *M.MECHANISM_COLUMNS)
    return rounded(out)


@query(
    "A21_mechanism_summary",
    f"""WITH {_MECH}, b AS (SELECT label % 3 AS player_id, 'aggregate' AS bucket, * FROM m WHERE label % 3 <> 2
      UNION ALL SELECT label % 3, 'k' || CAST(label AS VARCHAR) || '__legal-64', * FROM m WHERE label % 3 <> 2)
    SELECT player_id, bucket, COUNT(*) AS roots, {r6('AVG(ent)')} AS mean_visit_entropy,
    {r6('AVG(ent/ln(64))')} AS mean_normalized_visit_entropy, {r6('AVG(l1)')} AS mean_prior_visit_l1,
    {r6('AVG(jsd)')} AS mean_prior_visit_jsd, {r6('AVG(agree)')} AS mean_prior_top_search_top_agreement, true AS available
    FROM b GROUP BY 1, 2
    UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false""",
)
def a21(t):
    s = samples(t).withColumns(
        {
            "player_id": F.col("label") % 3,
            "action_space_kind": F.concat(F.lit("k"), F.col("label").cast("string")),
            "legal_action_count": F.size("embedding"),
            "visit_counts": F.when(F.col("label") % 3 != 2, F.col("visit_counts")),
        }
    )
    return rounded(M.mechanism_summary(s))


_REPEATS = [0, 1, 2, 3, 4]


@query(
    "A22_root_stability",
    f"""WITH {EMB}, s AS (SELECT *, label % 2 AS budget, CAST(floor(vec_id/10) AS BIGINT)*10+label AS root,
        vec_id % 5 AS seed FROM d),
      u AS (SELECT budget, root, seed FROM s GROUP BY 1,2,3 HAVING COUNT(DISTINCT vec_id)=1),
      w AS (SELECT s.* FROM s JOIN u ON s.budget=u.budget AND s.root=u.root AND s.seed=u.seed),
      act AS (SELECT budget, root, seed, vec_id, MIN(CASE WHEN visits=vmax THEN i END) AS fi,
        arg_max(i, visits*1000.0 + x) AS act FROM w GROUP BY 1,2,3,4),
      pr AS (SELECT l.budget, l.root, l.seed AS ls, r.seed AS rs,
         0.5*SUM(CASE WHEN l.p>0 THEN l.p*ln(l.p/((l.p+r.p)/2)) ELSE 0 END)
        +0.5*SUM(CASE WHEN r.p>0 THEN r.p*ln(r.p/((l.p+r.p)/2)) ELSE 0 END) AS js
        FROM w l JOIN w r ON l.budget=r.budget AND l.root=r.root AND l.i=r.i AND l.seed<r.seed GROUP BY 1,2,3,4),
      pa AS (SELECT pr.*, a.act = b.act AS same FROM pr JOIN act a ON a.budget=pr.budget AND a.root=pr.root AND a.seed=ls
        JOIN act b ON b.budget=pr.budget AND b.root=pr.root AND b.seed=rs),
      sh AS (SELECT budget, vec_id, -SUM(CASE WHEN p>0 THEN p*ln(p) ELSE 0 END) AS ent, AVG(CASE WHEN p>0 THEN 1.0 ELSE 0 END) AS cov,
        MAX(visits) AS nodes, MIN(visits) AS dep FROM w GROUP BY 1,2),
      x AS (SELECT budget, COUNT(*) AS searches, {r6('AVG(ent)')} AS mean_target_entropy, {r6('AVG(cov)')} AS mean_visit_coverage,
        {r6('AVG(nodes)')} AS mean_tree_nodes, {r6('AVG(dep)')} AS mean_max_depth, CAST(SUM(vec_id % 3) AS BIGINT) AS cap_hits
        FROM sh GROUP BY 1),
      y AS (SELECT budget, COUNT(*) AS pairs, {r6('AVG(CASE WHEN same THEN 1.0 ELSE 0 END)')} AS top_action_agreement,
        {r6('quantile_cont(js, 0.5)')} AS median_js_divergence FROM pa GROUP BY 1)
    SELECT x.*, y.pairs, y.top_action_agreement, y.median_js_divergence FROM x LEFT JOIN y ON x.budget=y.budget""",
)
def a22(t):
    s = samples(t).select(
        (F.col("label") % 2).alias("budget"),
        (F.floor(F.col("vec_id") / 10) * 10 + F.col("label")).alias("root_id"),
        (F.col("vec_id") % 5).alias("repeat_seed"), "visit_counts",
        F.transform("embedding", lambda x: x.cast("double")).alias("q_values"),
        F.array_max("visit_counts").alias("tree_nodes"), F.array_min("visit_counts").alias("max_depth"),
        (F.col("vec_id") % 3).alias("cap_hits"),
    )
    # A repeat seed must be unique in its root; ambiguous repeats are not repeats.
    unique = s.groupBy("budget", "root_id", "repeat_seed").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    s = s.join(unique.drop("n"), ["budget", "root_id", "repeat_seed"], "left_semi")
    return rounded(M.root_stability(s, _REPEATS))


@query(
    "A23_mechanism_contrast",
    f"""WITH {EMB}, g AS (SELECT vec_id, vec_id % 2 AS arm, CAST(floor(vec_id/2) AS BIGINT) AS root_id,
        CAST(floor(vec_id/2) AS BIGINT) % 3 AS seed, i, prior FROM d),
      act AS (SELECT vec_id, MIN(CASE WHEN visits=vmax THEN i END) AS action, MAX(x) AS rv FROM d GROUP BY 1),
      j AS (SELECT a.seed, a.root_id, a.vec_id AS lv, b.vec_id AS rv,
        SUM(a.prior*ln((a.prior+1e-12)/(b.prior+1e-12))) AS kl FROM g a JOIN g b ON a.root_id=b.root_id AND a.i=b.i
        AND a.arm=0 AND b.arm=1 GROUP BY 1,2,3,4)
    SELECT j.seed, COUNT(*) AS roots, {r6('AVG(CASE WHEN x.action=y.action THEN 1.0 ELSE 0 END)')} AS action_agreement,
    {r6('AVG(abs(x.rv-y.rv))')} AS mean_absolute_root_value_delta, bool_and(j.lv % 7 = (j.rv-1) % 7) AS forward_count_match,
    {r6('AVG(kl)')} AS mean_prior_kl FROM j JOIN act x ON x.vec_id=j.lv JOIN act y ON y.vec_id=j.rv GROUP BY 1""",
)
def a23(t):
    half = F.floor(F.col("vec_id") / 2)
    s = samples(t).select(
        (F.col("vec_id") % 2).alias("arm"), half.alias("root_id"), (half % 3).alias("seed"),
        E.first_argmax("visit_counts").alias("action"),
        F.array_max("embedding").cast("double").alias("root_value"),
        ((F.col("vec_id") - F.col("vec_id") % 2) % 7).alias("forward_calls"), "input_prior",
    )
    left, right = s.filter("arm = 0"), s.filter("arm = 1")
    return rounded(M.mechanism_contrast(left, right, ["seed"]))


@query(
    "A24_guidance_agreement",
    f"""WITH {EMB}, act AS (SELECT 'p' || CAST(label AS VARCHAR) AS player_id, vec_id % 50 AS root_id, vec_id,
        MIN(CASE WHEN visits=vmax THEN i END) AS action FROM d GROUP BY 1,2,3),
      f AS (SELECT player_id, root_id, MAX(action) AS action FROM act GROUP BY 1,2),
      c AS (SELECT * FROM (VALUES ('zero_one','p0','p1'),('zero_two','p0','p2'),('two_three','p2','p3')) x(comparison,a,b))
    SELECT comparison, COUNT(*) AS roots, {ct('l.action=r.action')} AS agreements,
    {r6('AVG(CASE WHEN l.action=r.action THEN 1.0 ELSE 0 END)')} AS agreement_rate
    FROM c JOIN f l ON l.player_id=a JOIN f r ON r.player_id=b AND r.root_id=l.root_id GROUP BY 1""",
)
def a24(t):
    s = samples(t).select(
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("player_id"),
        (F.col("vec_id") % 50).alias("root_id"), E.first_argmax("visit_counts").alias("action"),
    )
    pairs = {"zero_one": ("p0", "p1"), "zero_two": ("p0", "p2"), "two_three": ("p2", "p3")}
    return rounded(M.guidance_agreement(s, pairs))


@query(
    "A24_guidance_mechanism",
    f"""WITH {_MECH}, p AS (SELECT label, COUNT(*) AS samples, quantile_cont(1+vec_id%100, 0.5) AS p50, SUM(1+vec_id%100) AS el FROM embeddings GROUP BY 1)
    SELECT 'p' || CAST(p.label AS VARCHAR) AS player_id, 'arm' || CAST(p.label % 2 AS VARCHAR) AS arm, p.label*16 AS budget,
    MAX(p.samples) AS samples, {r6('MAX(p50)')} AS p50_seconds, {r6('MAX(p.samples/el)')} AS decisions_per_second,
    {r6('AVG(ent)')} AS mean_visit_entropy, {r6('AVG(jsd)')} AS mean_prior_visit_jsd
    FROM p JOIN m ON m.label=p.label GROUP BY p.label""",
)
def a24b(t):
    s = samples(t).withColumns(
        {
            "player_id": F.concat(F.lit("p"), F.col("label").cast("string")),
            "latency_seconds": (1 + F.col("vec_id") % 100).cast("double"),
            "simulations": F.lit(64), "cap_hits": F.lit(0), "tree_nodes": F.lit(64),
            "peak_rss_bytes": F.col("vec_id"), "baseline_rss_bytes": F.lit(0),
            "action_space_kind": F.lit("priority"), "legal_action_count": F.size("embedding"),
        }
    )
    variants = s.select(
        "player_id", F.concat(F.lit("arm"), (F.col("label") % 2).cast("string")).alias("arm"),
        (F.col("label") * 16).alias("budget"),
    ).distinct()
    out = M.guidance_mechanism(s, variants)
    return rounded(
        out.select(
            "player_id", "arm", "budget", "samples", "p50_seconds", "decisions_per_second",
            "mean_visit_entropy", "mean_prior_visit_jsd",
        )
    )


@query(
    "A25_cell_summary",
    f"""WITH r AS (SELECT cell_id, repeat, MAX(barrier_wall_seconds) AS b, MAX(elapsed_seconds) AS lat, MAX(rss_peak_bytes) AS rss,
      SUM(simulations) AS s, SUM(transitions) AS tr, SUM(cap_hits) AS c,
      CASE WHEN COUNT(allocation_count)=COUNT(*) THEN SUM(allocation_count) END AS al,
      CASE WHEN COUNT(journal_bytes)=COUNT(*) THEN SUM(journal_bytes) END AS jb FROM v_workers GROUP BY 1, 2)
    SELECT cell_id, COUNT(*) AS repeats, {r6('SUM(b)')} AS barrier_wall_seconds, CAST(SUM(s) AS BIGINT) AS simulations,
    CAST(SUM(tr) AS BIGINT) AS transitions, CAST(SUM(c) AS BIGINT) AS cap_hits, MAX(rss) AS rss_peak_bytes,
    CAST(CASE WHEN COUNT(al)=COUNT(*) THEN SUM(al) END AS BIGINT) AS allocation_count,
    CAST(CASE WHEN COUNT(jb)=COUNT(*) THEN MAX(jb) END AS BIGINT) AS journal_bytes_peak,
    {r6('quantile_disc(lat,0.5)')} AS root_latency_seconds_p50, {r6('quantile_disc(lat,0.95)')} AS root_latency_seconds_p95,
    {r6('quantile_disc(lat,0.99)')} AS root_latency_seconds_p99, {r6('SUM(s)/SUM(b)')} AS simulations_per_second,
    {r6('SUM(tr)/SUM(b)')} AS transitions_per_second, {r6('SUM(c)/SUM(s)')} AS cap_rate FROM r GROUP BY 1""",
)
def a25(t):
    return rounded(M.cell_summary(t.v_workers))


@query(
    "A26_latency_summary",
    f"""SELECT event_type, COUNT(value) AS count, {r6('MIN(value)')} AS min, {r6('MAX(value)')} AS max,
    round_even(AVG(value), 0) AS mean, {r6('quantile_disc(value,0.5)')} AS p50, {r6('quantile_disc(value,0.95)')} AS p95,
    {r6('quantile_disc(value,0.99)')} AS p99 FROM events GROUP BY 1""",
)
def a26(t):
    return rounded(M.latency_summary(t.events, ["event_type"], "value"))


def _workload(t):
    g = t.v_games.join(t.orders.select(F.col("o_orderkey").alias("game_index"), "o_orderstatus"), "game_index")
    games = g.select(
        F.col("o_orderstatus").alias("surface"), F.col("steps").alias("commands"),
        F.col("duration").alias("game_seconds"), "game_index",
        F.when(
            F.col("matchup") == "5-LOW",
            F.create_map(F.lit("a"), F.col("hero_r"), F.lit("b"), F.col("hero_a"), F.lit("c"), F.col("hero_n")),
        ).otherwise(F.create_map(F.lit("a"), F.col("hero_r"), F.lit("b"), F.col("hero_a"))).alias("fallback_counters"),
    )
    commands = t.lineitem.join(
        t.orders, F.col("o_orderkey") == F.col("l_orderkey")
    ).select(F.col("o_orderstatus").alias("surface"), F.col("l_quantity").alias("duration_ms"))
    return games, commands


@query(
    "A27_workload_summary",
    f"""WITH g AS (SELECT o_orderstatus AS surface, COUNT(*) AS games, CAST(SUM(steps) AS BIGINT) AS commands, SUM(duration) AS sec
      FROM v_games JOIN orders ON o_orderkey=game_index GROUP BY 1),
    c AS (SELECT o_orderstatus AS surface, {r6('MIN(l_quantity)')} AS min_ms, {r6('MAX(l_quantity)')} AS max_ms, {r6('AVG(l_quantity)')} AS mean_ms,
      {r6('quantile_cont(l_quantity,0.5)')} AS p50_ms, {r6('quantile_cont(l_quantity,0.95)')} AS p95_ms
      FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1)
    SELECT g.surface, games, commands, {r6('sec')} AS seconds, min_ms, max_ms, mean_ms, p50_ms, p95_ms,
    {r6('commands/sec')} AS steps_per_second, {r6('games/sec')} AS games_per_second FROM g JOIN c ON g.surface=c.surface""",
)
def a27(t):
    return rounded(M.workload_summary(*_workload(t), ["a", "b"])[0])


@query(
    "A27_workload_counters",
    """SELECT 'a' AS counter, CAST(SUM(hero_r) AS BIGINT) AS total FROM v_games
    UNION ALL SELECT 'b', CAST(SUM(hero_a) AS BIGINT) FROM v_games""",
)
def a27b(t):
    return M.workload_summary(*_workload(t), ["a", "b"])[1]


@query(
    "A27_workload_violations",
    """SELECT 'counter_keys' AS rule, o_orderstatus AS key, 'a,b,c' AS detail FROM orders WHERE o_orderpriority='5-LOW'""",
)
def a27c(t):
    return M.workload_summary(*_workload(t), ["a", "b"])[2]


# Orders as repetitions of a customer's workload: the status is the end state, the priority the trace.
_IDENTITIES = """rp AS (SELECT o_custkey AS surface, md5(o_orderstatus) AS terminal_state_sha256, md5(o_orderpriority) AS logical_trace_sha256 FROM orders)"""


def _repeats(t):
    return t.sql(f"WITH {_IDENTITIES} SELECT * FROM rp")


@query(
    "A27_workload_inner",
    f"""WITH q AS (SELECT o_orderstatus AS s, l_quantity AS x, l_tax = 0 AND o_orderstatus <> 'P' AS inside FROM lineitem JOIN orders ON o_orderkey=l_orderkey),
    r AS (SELECT q.s, x FROM q JOIN (SELECT s, bool_or(inside) AS has_inner FROM q GROUP BY 1) u ON u.s = q.s WHERE inside = has_inner)
    SELECT s AS surface, {r6('MIN(x)')} AS inner_min_ms, {r6('MAX(x)')} AS inner_max_ms, {r6('AVG(x)')} AS inner_mean_ms,
    {r6('quantile_cont(x,0.5)')} AS inner_p50_ms, {r6('quantile_cont(x,0.95)')} AS inner_p95_ms FROM r GROUP BY 1""",
)
def a27d(t):
    games, commands = _workload(t)
    inner = t.sql("SELECT o_orderstatus AS surface, l_quantity AS duration_ms FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_tax = 0 AND o_orderstatus <> 'P'")
    out = M.workload_summary(games, commands, ["a", "b"], inner=inner)[0]
    return rounded(out.select("surface", *[c for c in out.columns if c.startswith("inner_")]))


@query(
    "A27_workload_identity",
    f"""WITH {_IDENTITIES} SELECT surface, COUNT(*) AS games,
    CASE WHEN COUNT(DISTINCT terminal_state_sha256) = 1 THEN MIN(terminal_state_sha256) END AS terminal_state_sha256,
    CASE WHEN COUNT(DISTINCT logical_trace_sha256) = 1 THEN MIN(logical_trace_sha256) END AS logical_trace_sha256 FROM rp GROUP BY 1""",
)
def a27e(t):
    return M.workload_identity(_repeats(t))[0]


@query(
    "A27_workload_identity_violations",
    f"""WITH {_IDENTITIES}, g AS (SELECT surface, COUNT(*) AS n, COUNT(DISTINCT terminal_state_sha256) AS t, COUNT(DISTINCT logical_trace_sha256) AS l,
      {ct("terminal_state_sha256 <> md5('O')")} AS drift FROM rp GROUP BY 1)
    SELECT 'nondeterministic_terminal_state_sha256' AS rule, CAST(surface AS VARCHAR) AS key, CAST(n AS VARCHAR) AS detail FROM g WHERE t > 1
    UNION ALL SELECT 'nondeterministic_logical_trace_sha256', CAST(surface AS VARCHAR), CAST(n AS VARCHAR) FROM g WHERE l > 1
    UNION ALL SELECT 'terminal_state_drift', CAST(surface AS VARCHAR), CAST(drift AS VARCHAR) FROM g WHERE drift > 0
    UNION ALL SELECT 'surfaces_differ_in_terminal_state_sha256', 'all', '' FROM rp HAVING COUNT(DISTINCT terminal_state_sha256) > 1
    UNION ALL SELECT 'surfaces_differ_in_logical_trace_sha256', 'all', '' FROM rp HAVING COUNT(DISTINCT logical_trace_sha256) > 1""",
)
def a27f(t):
    import hashlib

    return M.workload_identity(_repeats(t), hashlib.md5(b"O").hexdigest())[1]


# Orders as training games and their lines as decisions, with a few games that break a rule each.
_TRAINING = """tg AS (SELECT o_custkey % 40 AS run, o_orderkey AS game, COALESCE(n, 0) + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS decisions,
      COALESCE(n, 0) * 16 + CASE WHEN o_orderkey % 103 = 0 THEN 1 ELSE 0 END AS traversals, o_totalprice / 1000 AS cpu_seconds, o_orderkey % 107 <> 0 AS terminal
      FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) x ON l_orderkey = o_orderkey),
    tr AS (SELECT o_custkey % 40 AS run, l_orderkey AS game, l_quantity AS puct_ms, l_extendedprice / 1000 AS command_ms,
      CASE WHEN l_tax = 0.08 THEN 0 ELSE 1 END AS native_actions FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    tc AS (SELECT o_custkey % 40 AS run, SUM(o_totalprice) / 8000 AS wall_seconds FROM orders GROUP BY o_custkey % 40)"""


def _training(t):
    games, rows, clock = (t.sql(f"WITH {_TRAINING} SELECT * FROM {name}") for name in ("tg", "tr", "tc"))
    return M.training_summary(games, rows, clock, simulations=16, max_decisions=6)


def _times(value, prefix):
    parts = {"min": f"MIN({value})", "max": f"MAX({value})", "mean": f"AVG({value})", "p50": f"quantile_cont({value},0.5)", "p95": f"quantile_cont({value},0.95)"}
    return ", ".join(f"{r6(e)} AS {prefix}{n}_ms" for n, e in parts.items())


@query(
    "A27_training_summary",
    f"""WITH {_TRAINING}, g AS (SELECT run, COUNT(*) AS games, CAST(SUM(decisions) AS BIGINT) AS decisions, CAST(SUM(traversals) AS BIGINT) AS traversals,
      SUM(cpu_seconds) AS cpu FROM tg GROUP BY 1),
    r AS (SELECT run, {_times('puct_ms', 'puct_')}, {_times('command_ms', 'command_')}, {ct('native_actions <> 1')} AS native_apply_mismatches FROM tr GROUP BY 1)
    SELECT g.run, games, decisions, traversals, {r6('cpu')} AS worker_cpu_seconds, r.* EXCLUDE (run), {r6('wall_seconds')} AS wall_seconds,
    {r6('decisions/wall_seconds')} AS steps_per_second, {r6('traversals/wall_seconds')} AS traversals_per_second, {r6('games/wall_seconds')} AS games_per_second
    FROM g JOIN r ON r.run = g.run JOIN tc ON tc.run = g.run""",
)
def a27g(t):
    return rounded(_training(t)[0])


@query(
    "A27_training_violations",
    f"""WITH {_TRAINING}, h AS (SELECT run, game, COUNT(*) AS n FROM tr GROUP BY 1, 2),
    j AS (SELECT tg.*, COALESCE(n, 0) AS n, CAST(tg.run AS VARCHAR) || '/' || CAST(tg.game AS VARCHAR) AS key,
      CAST(decisions AS VARCHAR) || ':' || CAST(COALESCE(n, 0) AS VARCHAR) || ':' || CAST(traversals AS VARCHAR) AS detail
      FROM tg LEFT JOIN h ON h.run = tg.run AND h.game = tg.game)
    SELECT 'nonterminal_game' AS rule, key, detail FROM j WHERE NOT terminal
    UNION ALL SELECT 'decision_count', key, detail FROM j WHERE decisions < 1 OR decisions > 6
    UNION ALL SELECT 'decision_rows', key, detail FROM j WHERE decisions <> n
    UNION ALL SELECT 'traversal_count', key, detail FROM j WHERE traversals <> decisions * 16""",
)
def a27h(t):
    return _training(t)[1]


def _census(t):
    return t.documents.select(
        F.col("lang").alias("viewer_group"), F.col("doc_id").alias("ordinal"), F.col("source").alias("viewer"),
        (F.col("doc_id") % 50).alias("visible_object_references"),
        F.floor(F.col("n_chars") / 100).alias("expanded_semantic_tokens"),
        (F.col("doc_id") % 2).alias("overflow_count"), (F.col("doc_id") % 3).alias("projection_failures"),
        (F.col("doc_id") % 5).alias("unadmitted_visible_definitions"),
    )


@query(
    "A28_token_census_distribution",
    f"""WITH s AS (SELECT lang AS viewer_group, 'visible_object_references' AS metric, CAST(doc_id % 50 AS DOUBLE) AS value FROM documents
      UNION ALL SELECT lang, 'expanded_semantic_tokens', floor(n_chars/100) FROM documents)
    SELECT viewer_group, metric, COUNT(*) AS count, {r6('AVG(value)')} AS mean, MIN(value) AS min, MAX(value) AS max,
    {r6('quantile_cont(value,0.5)')} AS p50, {r6('quantile_cont(value,0.95)')} AS p95 FROM s GROUP BY 1, 2""",
)
def a28(t):
    return rounded(M.token_census(_census(t), ["viewer_group"])[0])


@query(
    "A28_token_census_maximum",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY floor(n_chars/100) DESC, doc_id) AS rn FROM documents),
      a AS (SELECT lang, CAST(SUM(doc_id%2) AS BIGINT) AS o, CAST(SUM(doc_id%3) AS BIGINT) AS p, CAST(SUM(doc_id%5) AS BIGINT) AS u FROM documents GROUP BY 1)
    SELECT s.lang AS viewer_group, doc_id AS ordinal, source AS viewer, doc_id % 50 AS visible_object_references,
    CAST(floor(n_chars/100) AS BIGINT) AS expanded_semantic_tokens, o AS overflow_count, p AS projection_failures,
    u AS unadmitted_visible_definitions FROM s JOIN a ON a.lang=s.lang WHERE rn=1""",
)
def a28b(t):
    return M.token_census(_census(t), ["viewer_group"])[1]


@query(
    "A29_span_tree",
    f"""WITH s AS (SELECT path, SUM(seconds) AS tt, COUNT(*) AS n, MIN(seconds) AS mn, MAX(seconds) AS mx, AVG(seconds) AS av,
      quantile_cont(seconds,0.05) AS p5, quantile_cont(seconds,0.95) AS p95 FROM v_spans GROUP BY 1),
    a AS (SELECT SUM(tt) AS al FROM s WHERE NOT contains(path,'/'))
    SELECT s.path, {r6('s.tt')} AS total_time, s.n AS count, {r6('s.mn')} AS min, {r6('s.mx')} AS max, {r6('s.av')} AS mean,
    {r6('s.p5')} AS p5, {r6('s.p95')} AS p95,
    {r6("100*s.tt/CASE WHEN contains(s.path,'/') THEN p.tt ELSE al END")} AS pct_of_parent, {r6('100*s.tt/al')} AS pct_of_total
    FROM s, a LEFT JOIN s p ON p.path = regexp_replace(s.path, '/[^/]*$', '') AND contains(s.path,'/')""",
)
def a29(t):
    return rounded(M.span_tree(t.v_spans))


def dataset(t):
    """Embeddings as a labelled decision data set; the sign is the legality mask."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    mag = F.transform(x, lambda v: F.floor(F.abs(v) * 1000))
    masked = F.zip_with(x, mag, lambda a, m: F.when(a > 0, m).otherwise(0))
    return t.embeddings.select(
        "vec_id", F.col("label").alias("round"), (F.col("vec_id") % 40).alias("game_index"),
        (F.col("vec_id") % 2).alias("seat"),
        F.when(F.col("label") % 3 < 2, F.col("label") % 3).alias("winner"),
        F.transform(x, lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("actions_valid"),
        F.size(F.filter(x, lambda v: v > 0)).alias("num_valid"),
        masked.alias("visit_counts"),
        F.transform(x, lambda v: F.when(v > 0, v).otherwise(-1.0)).alias("scores"),
        (E.first_argmax(masked) + F.when(F.col("vec_id") % 9 == 0, 1).otherwise(0)).alias("action"),
        F.array_max(x).alias("root_value"),
    )


# The same data set in long form (DuckDB side).
DATA = """e AS (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, CAST(i AS INT) AS i FROM
   (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) u),
 m AS (SELECT *, CASE WHEN x>0 THEN floor(abs(x)*1000) ELSE 0 END AS visits FROM e),
 n AS (SELECT *, SUM(visits) OVER (PARTITION BY vec_id) AS tot, MAX(visits) OVER (PARTITION BY vec_id) AS vmax FROM m),
 act AS (SELECT vec_id, MIN(CASE WHEN visits=vmax THEN i END) + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS action FROM n GROUP BY vec_id),
 ds AS (SELECT n.*, act.action, n.visits/n.tot AS p FROM n JOIN act ON act.vec_id=n.vec_id)"""


@query(
    "A30_dataset_diagnostics",
    f"""WITH {DATA}, r AS (SELECT vec_id, ANY_VALUE(label) AS round, SUM(CASE WHEN x>0 THEN 1 ELSE 0 END) AS nv,
      -SUM(p*ln(greatest(p,1e-12))) AS ent, list_sort(list(p) FILTER (x>0), 'DESC') AS ps, MAX(x) AS rv,
      BOOL_OR(i=action AND x>0) AS legal FROM ds GROUP BY vec_id)
    SELECT round, COUNT(*) AS decisions, COUNT(DISTINCT vec_id % 40) AS games, {r6('AVG(nv)')} AS mean_valid_actions,
    {r6('AVG(ent)')} AS mean_target_entropy, {r6('AVG(CASE WHEN nv>1 THEN ps[1]-ps[2] END)')} AS mean_top_two_margin,
    {ct('round % 3 = 2')} AS winnerless_rows, {ct('NOT legal')} AS invalid_teacher_actions, {r6('AVG(rv)')} AS mean_root_value
    FROM r GROUP BY 1""",
)
def a30(t):
    return rounded(M.dataset_diagnostics(dataset(t), ["round"]))


@query(
    "A31_dataset_checks",
    f"""WITH {DATA}, r AS (SELECT vec_id, ANY_VALUE(label) AS round, SUM(visits) AS s, MAX(x) AS rv FROM ds GROUP BY 1),
    a AS (SELECT round, COUNT(*) AS decisions, true AS finite_visits, true AS finite_q_values, true AS finite_root_values,
      bool_and(s=3000) AS visit_mass, true AS visits_within_legal_mask, bool_and(rv BETWEEN 0 AND 1) AS root_values_in_range,
      bool_and(round % 3 < 2) AS terminal_outcomes_present FROM r GROUP BY 1)
    SELECT a.*, visit_mass AND root_values_in_range AND terminal_outcomes_present AS passed FROM a""",
)
def a31(t):
    return M.dataset_checks(dataset(t), 3000, ["round"])


@query(
    "A32_audit_integrity",
    f"""WITH {DATA}, r AS (SELECT vec_id, ANY_VALUE(label) AS round, SUM(visits) AS s, ANY_VALUE(vmax) AS vmax, MAX(x) AS rv,
      MAX(CASE WHEN i=action THEN visits END) AS cv, ANY_VALUE(action) AS action, MAX(2*x) AS mq FROM ds GROUP BY 1),
    a AS (SELECT round, {ct('s <> CASE WHEN vec_id % 4 = 0 THEN s+1 ELSE s END')} AS invalid_visit_rows,
      {ct('mq > 1 OR rv NOT BETWEEN 0 AND 1')} AS invalid_value_rows,
      {ct('action >= 60 + vec_id % 5')} AS invalid_legal_rows, {ct('action < 60 + vec_id % 5 AND cv <> vmax')} AS invalid_selected_rows,
      {ct('60 + vec_id % 5 <> 64')} AS shape_mismatches, {ct('60 + vec_id % 5 <> 64')} AS encoded_offer_mismatches,
      {ct('vec_id % 11 = 0')} AS mutated_authoritative_roots FROM r GROUP BY 1)
    SELECT a.*, invalid_visit_rows+invalid_value_rows+invalid_legal_rows+invalid_selected_rows+shape_mismatches
      +encoded_offer_mismatches+mutated_authoritative_roots = 0 AS passed FROM a""",
)
def a32(t):
    d = dataset(t).withColumns(
        {
            "q_values": F.transform("scores", lambda s: F.when(s > 0, 2 * s).otherwise(0.0)),
            "simulations": E.array_sum("visit_counts") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0),
            "offer_ids": F.sequence(F.lit(0), (59 + F.col("vec_id") % 5).cast("int")),
            "command": F.col("action"), "encoded_legal_count": F.lit(64),
            "root_unchanged": F.col("vec_id") % 11 != 0,
        }
    )
    return M.audit_integrity(d, ["round"])


def _index_rows(t):
    k = F.col("k")
    return t.v_events.select(
        (F.col("user_id") * 1000 + k).alias("decision_id"), F.col("event_type").alias("kind"),
        (F.col("user_id") % 2).alias("viewer"), (k % 2 == 0).alias("automatic"), (k % 4).alias("n_offers"),
        (k > 3).alias("restored"), (k > 90).alias("candidate"),
    )


_KINDS = ["click", "view", "purchase", "signup", "error", "never"]


@query(
    "A33_index_receipt",
    f"""SELECT COUNT(*) AS decision_count, {ct('k%2=0')} AS automatic_decisions, {ct('k%4<=1')} AS forced_decisions,
    {ct('k>90')} AS eligible_landmark_candidates, COUNT(*) - COUNT(DISTINCT user_id*1000+k) AS duplicate_decision_ids,
    {r6(ct('k>3') + '/COUNT(*)')} AS exact_restoration_ratio, {r6('COUNT(*)/20000')} AS completeness_ratio,
    'ranked' AS ranking_status FROM v_events""",
)
def a33(t):
    return rounded(M.index_receipt(_index_rows(t), _KINDS, declared=20000)[0])


@query(
    "A33_index_kinds",
    """SELECT event_type AS kind, COUNT(*) AS count FROM events GROUP BY 1 UNION ALL SELECT 'never', 0""",
)
def a33b(t):
    return M.index_receipt(_index_rows(t), _KINDS)[1]


_DENSE = """w AS (SELECT DISTINCT condition, world FROM v_cells),
  ac AS (SELECT condition, action, SUM(visits) AS vis, SUM(value_sum) AS vs FROM v_cells GROUP BY 1, 2),
  dense AS (SELECT w.condition, w.world, ac.action, COALESCE(c.q, 0.5) AS q FROM w JOIN ac ON ac.condition=w.condition
    LEFT JOIN v_cells c ON c.condition=w.condition AND c.world=w.world AND c.action=ac.action),
  se AS (SELECT condition, action, stddev_samp(q)/sqrt(COUNT(*)) AS se, COUNT(*) AS n FROM dense GROUP BY 1, 2)"""


@query(
    "A34_condition_values",
    f"""SELECT condition, action, CAST(SUM(visits) AS BIGINT) AS visits, {r6('SUM(value_sum)/SUM(visits)')} AS q
    FROM v_cells GROUP BY 1, 2""",
)
def a34(t):
    return rounded(M.condition_result(t.v_cells)[0])


@query(
    "A34_condition_uncertainty",
    f"""WITH {_DENSE} SELECT condition, MAX(n) AS worlds, {r6('AVG(se)')} AS uncertainty FROM se GROUP BY 1""",
)
def a34b(t):
    return rounded(M.condition_result(t.v_cells)[1])


@query(
    "A35_policy_agreement",
    f"""SELECT l_returnflag, COUNT(*) AS decisions, {r6('AVG(CASE WHEN l_linenumber % 3 = l_partkey % 3 THEN 1.0 ELSE 0 END)')} AS agreement,
    {r6('AVG(CASE WHEN l_discount > l_tax THEN l_discount - l_tax END)')} AS mean_score_gap_when_disagree
    FROM lineitem WHERE l_linenumber > 1 GROUP BY 1""",
)
def a35(t):
    d = t.lineitem.select(
        "l_returnflag", F.col("l_linenumber").alias("num_valid"), (F.col("l_linenumber") % 3).alias("action_left"),
        (F.col("l_partkey") % 3).alias("action_right"), F.col("l_discount").alias("score_left"),
        F.col("l_tax").alias("score_right"),
    )
    return rounded(M.policy_agreement(d, ["l_returnflag"]))


_EV = """ev AS (SELECT event_type AS arm, user_id % 5 AS seed, CASE WHEN k % 2 = 0 THEN 'identity' ELSE 'composition' END AS split,
  AVG(value/500) AS exact_agreement, AVG(k) AS policy_loss FROM v_events GROUP BY 1, 2, 3)"""


def _evals(t):
    return t.sql(f"WITH {_EV} SELECT * FROM ev")


@query(
    "A37_transfer_means",
    f"""WITH {_EV} SELECT arm, split, {r6('AVG(exact_agreement)')} AS mean_exact_agreement, {r6('AVG(policy_loss)')} AS mean_policy_loss,
    {r6('MIN(exact_agreement)')} AS min_exact_agreement, {r6('MAX(exact_agreement)')} AS max_exact_agreement FROM ev GROUP BY 1, 2""",
)
def a37(t):
    return rounded(M.transfer_outcome(_evals(t), "click", ["view", "purchase"], "identity", "composition")[0])


@query(
    "A37_transfer_verdict",
    f"""WITH {_EV}, m AS (SELECT arm, split, AVG(exact_agreement) AS a, MIN(exact_agreement) AS mn, MAX(exact_agreement) AS mx FROM ev GROUP BY 1, 2),
    c AS (SELECT * FROM m WHERE arm='click'), o AS (SELECT split, MAX(a) AS b FROM m WHERE arm IN ('view','purchase') GROUP BY 1),
    v AS (SELECT bool_and(c.a > o.b) AS ok, MAX(CASE WHEN c.split='composition' THEN mx-mn END) AS sp FROM c JOIN o ON c.split=o.split)
    SELECT ok AS claim_supported, CASE WHEN ok THEN 'semantic_structure_advantage' ELSE 'null_or_ambiguous_structure_evidence' END AS verdict,
    sp <> 0 AS varies_across_seeds FROM v""",
)
def a37b(t):
    return M.transfer_outcome(_evals(t), "click", ["view", "purchase"], "identity", "composition")[1]


@query(
    "A38_method_table",
    f"""WITH o AS (SELECT o_custkey, AVG(o_totalprice) AS s, {ct("o_orderstatus='F'")} AS c, MAX(o_totalprice) AS p FROM orders GROUP BY 1),
    a AS (SELECT c_mktsegment AS arm, AVG(c_acctbal) AS r, AVG(s) AS sc, CAST(SUM(c) AS BIGINT) AS cc, AVG(p) AS pp
      FROM customer JOIN o ON o_custkey=c_custkey GROUP BY 1),
    h AS (SELECT c_mktsegment AS arm, AVG(o_totalprice) AS h FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1)
    SELECT a.arm, {r6('r')} AS mean_rating, {r6('sc')} AS mean_anchor_score, cc AS competency_correct, {r6('pp')} AS mean_p95_seconds,
    {r6('h')} AS head_to_head_score, cc - (SELECT cc FROM a WHERE arm='BUILDING') AS competency_delta,
    cc - (SELECT cc FROM a WHERE arm='BUILDING') >= 0 AS competency_noninferior FROM a JOIN h ON h.arm=a.arm""",
)
def a38(t):
    c = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("arm"), "c_acctbal")
    o = t.orders.groupBy(F.col("o_custkey").alias("player_id"))
    scores = o.agg(F.avg("o_totalprice").alias("anchor_score"))
    comp = o.agg(E.count_true(F.col("o_orderstatus") == "F").alias("correct"))
    prof = o.agg(F.max("o_totalprice").alias("p95_seconds"))
    h2h = t.orders.join(c, F.col("o_custkey") == F.col("player_id")).select("arm", F.col("o_totalprice").alias("score"))
    out = M.method_table(
        c.select("player_id", "arm"), c.select("player_id", F.col("c_acctbal").alias("rating")),
        scores, h2h, comp, prof, "BUILDING",
    )
    return rounded(out)


_EFF = """pc AS (SELECT c_mktsegment AS arm, c_nationkey AS seed, AVG(c_acctbal) AS rating, AVG(c_acctbal*2) AS score,
  CAST(COUNT(*) AS DOUBLE) AS nodes_per_label, CAST(COUNT(*) AS DOUBLE)/10 AS cpu_seconds_per_label FROM customer GROUP BY 1, 2)"""


@query(
    "A39_search_efficiency",
    f"""WITH {_EFF} SELECT p.arm, p.seed, {r6('p.rating-b.rating')} AS rating_uplift, {r6('p.score-b.score')} AS score_uplift,
    {r6('(p.rating-b.rating)/p.nodes_per_label')} AS rating_uplift_per_node, {r6('(p.rating-b.rating)/p.cpu_seconds_per_label')} AS rating_uplift_per_cpu_second,
    {r6('(p.score-b.score)/p.nodes_per_label')} AS score_uplift_per_node, {r6('(p.score-b.score)/p.cpu_seconds_per_label')} AS score_uplift_per_cpu_second
    FROM pc p JOIN pc b ON b.seed=p.seed AND b.arm='BUILDING' WHERE p.arm<>'BUILDING'""",
)
def a39(t):
    return rounded(M.efficiency(t.sql(f"WITH {_EFF} SELECT * FROM pc"), "BUILDING"))


@query(
    "A40_rollout_health",
    f"""WITH p AS (SELECT user_id AS run, dayofyear(ts) AS update, {ct('k%2=0')} AS resets, {ct('k%7=0')} AS aborts FROM v_events GROUP BY 1, 2)
    SELECT p.*, CAST(SUM(resets) OVER w AS BIGINT) AS resets_total, CAST(SUM(aborts) OVER w AS BIGINT) AS aborts_total FROM p
    WINDOW w AS (PARTITION BY run ORDER BY update)""",
)
def a40(t):
    ev = t.v_events.select(
        F.col("user_id").alias("run"), F.dayofyear("ts").alias("update"),
        (F.col("k") % 2 == 0).alias("resets"), (F.col("k") % 7 == 0).alias("aborts"),
    )
    return M.rollout_health(ev, ["resets", "aborts"])


_PE = """pe AS (SELECT l_returnflag AS split, CASE WHEN l_linenumber=1 THEN 'target' WHEN l_linenumber=2 THEN 'combat' ELSE 'pass' END AS kind,
  l_quantity/50 AS loss, l_tax > 0.03 AS offer_correct, l_discount > 0.04 AS candidate_exact,
  l_tax > 0.03 AND l_discount > 0.04 AS exact FROM lineitem)"""


@query(
    "A42_policy_evaluation",
    f"""WITH {_PE} SELECT split, COUNT(*) AS examples, {r6('AVG(loss)')} AS policy_loss,
    {r6('AVG(CASE WHEN offer_correct THEN 1.0 ELSE 0 END)')} AS offer_accuracy,
    {r6('AVG(CASE WHEN candidate_exact THEN 1.0 ELSE 0 END)')} AS candidate_exact_accuracy,
    {r6('AVG(CASE WHEN exact THEN 1.0 ELSE 0 END)')} AS exact_agreement FROM pe GROUP BY 1""",
)
def a42(t):
    return rounded(M.policy_evaluation(t.sql(f"WITH {_PE} SELECT * FROM pe"))[0])


@query(
    "A42_competency_accuracy",
    f"""WITH {_PE}, c AS (SELECT 'priority' AS competency, offer_correct AS ok FROM pe UNION ALL
      SELECT 'targeting', candidate_exact FROM pe WHERE kind='target' UNION ALL SELECT 'combat', candidate_exact FROM pe WHERE kind='combat')
    SELECT competency, COUNT(*) AS examples, {r6('AVG(CASE WHEN ok THEN 1.0 ELSE 0 END)')} AS accuracy FROM c GROUP BY 1""",
)
def a42b(t):
    return rounded(M.policy_evaluation(t.sql(f"WITH {_PE} SELECT * FROM pe"))[1])


_BP = """bp AS (SELECT l_returnflag AS player_id, l_orderkey AS decision, l_linenumber AS world_index,
  CASE WHEN l_linenumber=1 THEN l_quantity/1000 END AS search, CASE WHEN l_linenumber=1 THEN l_extendedprice/1000 END AS command,
  l_partkey AS simulations FROM lineitem)"""


@query(
    "A43_belief_player_cost",
    f"""WITH {_BP} SELECT player_id, COUNT(*) AS sampled_worlds, COUNT(DISTINCT (decision, world_index)) AS unique_sampled_worlds,
    {r6('quantile_cont(search,0.5)*1000')} AS p50_search_ms, {r6('quantile_cont(search,0.95)*1000')} AS p95_search_ms,
    {r6('quantile_cont(command,0.5)*1000')} AS p50_command_ms, {r6('quantile_cont(command,0.95)*1000')} AS p95_command_ms,
    {r6('SUM(simulations)/SUM(search)')} AS rollouts_per_second,
    {r6('1.0-COUNT(DISTINCT (decision, world_index))/COUNT(*)')} AS sample_collision_rate FROM bp GROUP BY 1""",
)
def a43(t):
    return rounded(M.belief_player_cost(t.sql(f"WITH {_BP} SELECT * FROM bp"), ["search", "command"], ["player_id"]))


@query(
    "A44_dataset_rollup",
    f"""WITH g AS (SELECT o_custkey AS shard, v.* FROM v_games v JOIN orders ON o_orderkey=game_index),
    s AS (SELECT shard, COUNT(*) AS n, CAST(SUM(turns) AS BIGINT) AS d, SUM(duration) AS w, SUM(steps) AS st, {ct('winner=0')} AS w0, MAX(turns) AS md FROM g GROUP BY 1)
    SELECT COUNT(*) AS shards, CAST(SUM(n) AS BIGINT) AS games, CAST(SUM(d) AS BIGINT) AS decisions, {r6('SUM(w)')} AS engine_seconds,
    CAST(SUM(d) AS BIGINT) AS search_decisions, {r6('SUM(w)')} AS search_seconds, CAST(SUM(d) AS BIGINT)*16 AS search_simulations,
    CAST(SUM(n) AS BIGINT) AS search_cap_hits, CAST(SUM(d) AS BIGINT)*3 AS search_max_depth_sum, MAX(md) AS search_max_depth_max,
    {r6('SUM(w)/3600.0')} AS engine_core_hours, {r6('SUM(st)/SUM(n)')} AS mean_steps_per_game, {r6('SUM(w0)/SUM(n)')} AS seat0_win_rate,
    {r6('SUM(d)*3/SUM(d)')} AS mean_max_depth FROM s""",
)
def a44(t):
    g = t.v_games.join(t.orders.select(F.col("o_orderkey").alias("game_index"), F.col("o_custkey").alias("shard")), "game_index")
    shards = g.groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_games"), F.sum("turns").alias("decisions"), F.sum("duration").alias("wall_seconds"),
        F.collect_list("steps").alias("steps_per_game"),
        F.collect_list(F.coalesce("winner", F.lit(-1))).alias("winners"), F.max("turns").alias("md"),
    ).withColumn(
        "search",
        F.struct(
            F.col("decisions"), F.col("wall_seconds").alias("seconds"), (F.col("decisions") * 16).alias("simulations"),
            F.col("num_games").alias("cap_hits"), (F.col("decisions") * 3).alias("max_depth_sum"),
            F.col("md").alias("max_depth_max"),
        ),
    )
    return rounded(M.dataset_rollup(shards))


@query(
    "A45_action_evidence",
    f"""WITH b AS (SELECT condition, world, MAX(q) AS best FROM v_cells GROUP BY 1, 2),
    t AS (SELECT condition, SUM(visits) AS tot FROM v_cells GROUP BY 1),
    p AS (SELECT c.condition, c.action, CAST(SUM(visits) AS BIGINT) AS visits, SUM(visits*c.q) AS vq, COUNT(*) AS cov,
      {ct('abs(c.q-best) <= greatest(1e-12, 1e-9*greatest(abs(c.q),abs(best)))')} AS cb, stddev_samp(c.q) AS sd
      FROM v_cells c JOIN b ON b.condition=c.condition AND b.world=c.world GROUP BY 1, 2)
    SELECT p.condition, action, visits, {r6('visits/tot')} AS probability, {r6('vq/visits')} AS q, CAST(NULL AS VARCHAR) AS q_reason,
    cov AS covered_worlds, cb AS co_best_worlds, {r6('cb/cov')} AS robustness, CAST(NULL AS VARCHAR) AS robustness_reason,
    CASE WHEN cov>=2 THEN {r6('sd/sqrt(cov)')} END AS uncertainty,
    CASE WHEN cov<2 THEN 'insufficient_world_coverage' END AS uncertainty_reason FROM p JOIN t ON t.condition=p.condition""",
)
def a45(t):
    return rounded(M.action_evidence(t.v_cells))


# Every user is a condition whose worlds are days; a few declare a simulation too many or too few worlds.
_ROOTS = """rw AS (SELECT user_id AS condition, dayofyear(ts) AS world, AVG(value) AS root_value FROM v_events GROUP BY user_id, dayofyear(ts)),
    rcell AS (SELECT user_id AS condition, dayofyear(ts) AS world, k % 8 AS action, COUNT(*) AS visits, AVG(value) AS q FROM v_events
      GROUP BY user_id, dayofyear(ts), k % 8),
    rc AS (SELECT user_id AS condition, CASE WHEN user_id % 50 = 0 THEN 0 ELSE COUNT(*) + CASE WHEN user_id % 50 = 1 THEN 1 ELSE 0 END END AS simulations,
      AVG(value) AS root_value FROM v_events GROUP BY user_id)"""


def _roots(t, *names):
    return (t.sql(f"WITH {_ROOTS} SELECT * FROM {name}") for name in names)


@query(
    "A45_root_evidence",
    f"""WITH {_ROOTS}, w AS (SELECT condition, COUNT(root_value) AS n, stddev_samp(root_value) AS sd FROM rw GROUP BY 1)
    SELECT rc.condition, simulations, CASE WHEN simulations > 0 THEN {r6('root_value')} END AS root_value,
    CASE WHEN simulations = 0 THEN 'no_realized_simulations' END AS root_value_reason, n AS covered_worlds,
    CASE WHEN n >= 2 THEN {r6('sd/sqrt(n)')} END AS root_uncertainty, CASE WHEN n < 2 THEN 'insufficient_world_coverage' END AS root_uncertainty_reason
    FROM rc JOIN w ON w.condition = rc.condition""",
)
def a45c(t):
    return rounded(M.root_evidence(*_roots(t, "rc", "rw")))


@query(
    "A45_evidence_violations",
    f"""WITH {_ROOTS}, v AS (SELECT condition, CAST(SUM(visits) AS BIGINT) AS visits FROM rcell GROUP BY 1)
    SELECT 'policy_mass' AS rule, CAST(rc.condition AS VARCHAR) AS key, CAST(visits AS VARCHAR) || ':' || CAST(simulations AS VARCHAR) AS detail
    FROM rc JOIN v ON v.condition = rc.condition WHERE visits <> simulations
    UNION ALL SELECT 'offer_alignment', 'action ' || CAST(action AS VARCHAR), '0' FROM (SELECT DISTINCT action FROM rcell) a WHERE action = 7
    UNION ALL SELECT 'offer_alignment', 'offer 0', '2' FROM (SELECT DISTINCT action FROM rcell WHERE action = 0 OR action = 6) b HAVING COUNT(*) = 2""",
)
def a45d(t):
    conditions, cells = _roots(t, "rc", "rcell")
    offers = cells.select("action").distinct().filter("action < 7").withColumn("offer_id", F.col("action") % 6)
    return M.evidence_violations(conditions, cells, offers)


@query(
    "A45_sampled_robustness",
    f"""SELECT condition, action, {r6('AVG(CASE WHEN q>0.5 THEN 1.0 ELSE 0 END)')} AS robustness FROM v_cells GROUP BY 1, 2""",
)
def a45b(t):
    return rounded(M.sampled_robustness(t.v_cells))


@query(
    "A46_confidence",
    f"""WITH {EMB}, s AS (SELECT vec_id, ANY_VALUE(label) AS label, 1/SUM(exp(8*x-mx)) AS c FROM
      (SELECT *, MAX(8*x) OVER (PARTITION BY vec_id) AS mx FROM d) z GROUP BY vec_id)
    SELECT label, {r6('AVG(c)')} AS mean_confidence, {r6('MIN(c)')} AS min_confidence, {r6('MAX(c)')} AS max_confidence FROM s GROUP BY 1""",
)
def a46(t):
    d = t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double") * 8).alias("logits"))
    return rounded(M.confidence(d, ["label"]))


def _objects(t):
    o = t.lineitem.select(
        F.col("l_returnflag").alias("viewer"), F.col("l_linestatus").alias("zone"), F.col("l_partkey").alias("definition")
    )
    c = t.part.select(
        F.col("p_partkey").alias("definition"), F.col("p_brand").alias("name"),
        F.col("p_size").alias("definition_tokens"), (F.col("p_size") * 2).alias("program_tokens"),
    )
    return o, c


@query(
    "A47_tokens_by_zone",
    """SELECT l_returnflag AS viewer, l_linestatus AS zone, CAST(SUM(p_size*3) AS BIGINT) AS tokens
    FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1, 2""",
)
def a47(t):
    return M.token_attribution(*_objects(t))[0]


@query(
    "A47_tokens_by_definition",
    """SELECT l_returnflag AS viewer, p_brand AS name, CAST(SUM(p_size*3) AS BIGINT) AS tokens
    FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1, 2""",
)
def a47b(t):
    return M.token_attribution(*_objects(t))[1]


@query(
    "A48_family_counts",
    """SELECT 'prompt_families' AS family_kind, event_type AS family, CAST(SUM(k) AS BIGINT) AS count FROM v_events GROUP BY 2
    UNION ALL SELECT 'offer_families', 'o' || CAST(k % 5 AS VARCHAR), COUNT(*) FROM v_events GROUP BY 2""",
)
def a48(t):
    d = t.v_events.select(
        F.create_map(F.col("event_type"), F.col("k")).alias("prompt_families"),
        F.create_map(F.concat(F.lit("o"), (F.col("k") % 5).cast("string")), F.lit(1).cast("bigint")).alias("offer_families"),
        "k",
    )
    return M.family_counts(d, ["prompt_families", "offer_families"], "k")[0]


_LED = """ledg AS (SELECT l_returnflag AS run, l_linestatus AS scope, l_quantity AS wall_seconds, l_tax AS user_cpu_seconds,
  l_discount AS system_cpu_seconds, l_partkey AS peak_rss_bytes, l_suppkey AS artifact_bytes_after,
  CASE WHEN l_quantity=50 THEN 'failed' ELSE 'completed' END AS status FROM lineitem)"""


@query(
    "A49_ledger_totals",
    f"""WITH {_LED} SELECT run, scope, {r6('SUM(wall_seconds)')} AS wall_seconds, {r6('SUM(user_cpu_seconds)')} AS user_cpu_seconds,
    {r6('SUM(system_cpu_seconds)')} AS system_cpu_seconds, MAX(peak_rss_bytes) AS peak_rss_bytes, MAX(artifact_bytes_after) AS artifact_bytes,
    COUNT(*) AS attempts, {ct("status='failed'")} AS failed_attempts FROM ledg GROUP BY 1, 2""",
)
def a49(t):
    return rounded(M.ledger_totals(t.sql(f"WITH {_LED} SELECT * FROM ledg")))
