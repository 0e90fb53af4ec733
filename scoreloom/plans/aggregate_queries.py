"""Registered queries for the A-ops over games, logs, probes and scenario runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.operators import aggregates as A
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6, rate, wilson


def rounded(df, cols):
    return df.withColumns({c: E.r6(c) for c in cols})


def _ci(name, w, n):
    return (
        f"{r6(rate(w, n))} AS {name[0]}, {r6(wilson(w, n, 'lo'))} AS {name[1]}, "
        f"{r6(wilson(w, n, 'hi'))} AS {name[2]}"
    )


_A01 = f"""
WITH a AS (SELECT matchup, COUNT(*) AS num_games, {ct('hero_won')} AS wins, AVG(steps) AS ms,
  {ct('winner IS NULL')} AS draws_or_caps, {ct('hero_seat=0')} AS games_on_play,
  {ct('hero_seat=0 AND hero_won')} AS wins_on_play, {ct('hero_seat=1')} AS games_on_draw,
  {ct('hero_seat=1 AND hero_won')} AS wins_on_draw FROM v_games GROUP BY matchup)
SELECT matchup, num_games, wins, {r6('ms')} AS mean_steps, draws_or_caps, games_on_play, wins_on_play,
  games_on_draw, wins_on_draw, {_ci(('win_rate', 'win_ci_lower', 'win_ci_upper'), 'wins', 'num_games')},
  {_ci(('win_rate_on_play', 'win_ci_lower_on_play', 'win_ci_upper_on_play'), 'wins_on_play', 'games_on_play')},
  {_ci(('win_rate_on_draw', 'win_ci_lower_on_draw', 'win_ci_upper_on_draw'), 'wins_on_draw', 'games_on_draw')}
FROM a"""


@query("A01_matchup_summary", _A01)
def a01(t):
    out = A.matchup_summary(t.v_games)
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


@query(
    "A02_seat_advantage",
    f"""WITH a AS (SELECT matchup, {ct('winner=0')} AS seat0_wins, COUNT(winner) AS decided_games
    FROM v_games GROUP BY matchup)
    SELECT matchup, seat0_wins, decided_games,
    {_ci(('seat0_win_rate', 'ci_lower', 'ci_upper'), 'seat0_wins', 'decided_games')} FROM a""",
)
def a02(t):
    return rounded(A.seat_advantage(t.v_games, ["matchup"]), ["seat0_win_rate", "ci_lower", "ci_upper"])


def _dist_sql(rows, keys, probs=(("median", 0.5), ("p95", 0.95)), full=True, fn="quantile_cont"):
    ks = ", ".join(keys)
    q = ", ".join(f"{r6(f'{fn}(value, {p})')} AS {n}" for n, p in probs)
    ci = (
        f", {r6('CASE WHEN COUNT(value) >= 2 THEN AVG(value) - 1.96*stddev_samp(value)/sqrt(COUNT(value)) ELSE AVG(value) END')} AS ci95_lower"
        f", {r6('CASE WHEN COUNT(value) >= 2 THEN AVG(value) + 1.96*stddev_samp(value)/sqrt(COUNT(value)) ELSE AVG(value) END')} AS ci95_upper"
        if full else ""
    )
    return (
        f"SELECT {ks}, COUNT(value) AS count, {r6('AVG(value)')} AS mean, {r6('MIN(value)')} AS min, "
        f"{r6('MAX(value)')} AS max, {q}{ci} FROM ({rows}) r GROUP BY {ks}"
    )


@query(
    "A03_distribution_lineitem",
    _dist_sql(
        """SELECT l_returnflag, 'quantity' AS metric, l_quantity AS value FROM lineitem
        UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem
        UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem""",
        ["l_returnflag", "metric"],
    ),
)
def a03(t):
    out = A.distribution(
        t.lineitem,
        {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"},
        ["l_returnflag"],
    )
    return rounded(out, ["mean", "min", "max", "median", "p95", "ci95_lower", "ci95_upper"])


@query(
    "A03_null_group",
    _dist_sql("SELECT nullif(l_returnflag, 'N') AS flag, 'quantity' AS metric, l_quantity AS value FROM lineitem", ["flag", "metric"]),
)
def a03_null(t):
    li = t.lineitem.withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return rounded(A.distribution(li, {"quantity": "l_quantity"}, ["flag"]), ["mean", "min", "max", "median", "p95", "ci95_lower", "ci95_upper"])


@query(
    "A03_distribution_overall",
    _dist_sql(
        "SELECT 'total' AS metric, o_totalprice AS value FROM orders", ["metric"],
        (("p50", 0.5), ("p95", 0.95)), False,
    ),
)
def a03b(t):
    out = A.distribution(
        t.orders, {"total": "o_totalprice"}, [], {"p50": 0.5, "p95": 0.95}, full=False
    )
    return rounded(out, ["mean", "min", "max", "p50", "p95"])


def _profile_games(t):
    """Wide counts to maps without zero entries, so that missing kinds are exercised."""
    g = t.v_games
    for role in ("hero", "villain"):
        g = g.withColumn(
            f"{role}_decisions",
            F.map_filter(
                F.create_map(
                    F.lit("priority"), F.col(f"{role}_r"),
                    F.lit("declare_attacker"), F.col(f"{role}_a"),
                    F.lit("declare_blocker"), F.col(f"{role}_n"),
                ),
                lambda k, v: v > 0,
            ),
        )
    return g


def _profile_rows():
    tot_h, tot_v = "(hero_r+hero_a+hero_n)", "(villain_r+villain_a+villain_n)"
    cols = {
        "surfaced_total": f"{tot_h}+{tot_v}", "surfaced_hero": tot_h, "surfaced_villain": tot_v,
        "skipped": "skipped", "collapse_ratio": rate("skipped", f"skipped+{tot_h}+{tot_v}"),
        "turns": "turns", "hero_priority": "hero_r", "villain_priority": "villain_r",
        "hero_declare_attacker": "hero_a", "villain_declare_attacker": "villain_a",
        "hero_declare_blocker": "hero_n", "villain_declare_blocker": "villain_n",
        "hero_choose_target": "0", "villain_choose_target": "0",
    }
    return " UNION ALL ".join(
        f"SELECT matchup, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM v_games WHERE NOT aborted"
        for n, e in cols.items()
    )


@query("A04_decision_profile_distributions", _dist_sql(_profile_rows(), ["matchup", "metric"]))
def a04(t):
    dist, _ = A.decision_profile(_profile_games(t), by=["matchup"])
    return rounded(dist, ["mean", "min", "max", "median", "p95", "ci95_lower", "ci95_upper"])


@query(
    "A04_decision_profile_wins",
    f"""WITH a AS (SELECT matchup, COUNT(*) AS num_games, {ct('aborted')} AS num_aborted,
    {ct('NOT aborted')} AS clean_games, {ct('NOT aborted AND winner=hero_seat')} AS hero_wins,
    {ct('NOT aborted AND winner IS NOT NULL')} AS decided_games, {ct('NOT aborted AND winner=0')} AS seat0_wins,
    CAST(SUM(CASE WHEN NOT aborted THEN single_valid ELSE 0 END) AS BIGINT) AS single_valid_total,
    {ct('NOT aborted AND hero_seat=0')} AS games_seat0, {ct('NOT aborted AND hero_seat=0 AND winner=hero_seat')} AS wins_seat0,
    {ct('NOT aborted AND hero_seat=1')} AS games_seat1, {ct('NOT aborted AND hero_seat=1 AND winner=hero_seat')} AS wins_seat1
    FROM v_games GROUP BY matchup)
    SELECT a.*, {_ci(('hero_win_rate', 'hero_ci_lower', 'hero_ci_upper'), 'hero_wins', 'clean_games')},
    {_ci(('seat0_player_win_rate', 'seat0_player_ci_lower', 'seat0_player_ci_upper'), 'seat0_wins', 'decided_games')},
    {_ci(('hero_seat0_win_rate', 'hero_seat0_ci_lower', 'hero_seat0_ci_upper'), 'wins_seat0', 'games_seat0')},
    {_ci(('hero_seat1_win_rate', 'hero_seat1_ci_lower', 'hero_seat1_ci_upper'), 'wins_seat1', 'games_seat1')}
    FROM a""",
)
def a04b(t):
    _, out = A.decision_profile(_profile_games(t), by=["matchup"])
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


@query(
    "A05_collapse_ratio",
    f"""SELECT game_index, {r6(rate('skipped', 'skipped + turns'))} AS collapse_ratio FROM v_games""",
)
def a05(t):
    return t.v_games.select("game_index", E.r6(A.collapse_ratio("skipped", "turns")).alias("collapse_ratio"))


def _metrics_sql():
    kinds = ("attack", "land", "spell", "pass")
    sel = ["COUNT(*) AS decisions"]
    for k in kinds:
        sel.append(f"{ct(f"action_type='{k}'")} AS {k}_count")
        sel.append(f"{ct(f'{k}_available')} AS could_{k}")
    both = "pass_available AND land_available"
    sel += [
        f"{ct('num_valid_actions<=1')} AS single_valid_decisions",
        f"{ct('num_valid_actions>1')} AS multi_valid_decisions",
        f"{ct(both)} AS pass_land_decisions",
    ]
    for k in ("pass", "land", "spell"):
        sel.append(f"{ct(f"{both} AND action_type='{k}'")} AS pass_land_{k}")
    for k in kinds:
        sel.append(f"{r6(f'COALESCE(AVG({k}_prob), 0)')} AS mean_{k}_prob")
    for k in ("pass", "land"):
        sel.append(
            f"{r6(f'COALESCE(AVG(CASE WHEN land_available THEN {k}_prob END), 0)')} AS mean_{k}_prob_when_land_available"
        )
        sel.append(
            f"{r6(f'COALESCE(AVG(CASE WHEN {both} THEN {k}_prob END), 0)')} AS mean_{k}_prob_when_pass_land"
        )
    combos = {
        "land": (1, 0, 0), "spell": (0, 1, 0), "pass": (0, 0, 1), "land_spell": (1, 1, 0),
        "land_pass": (1, 0, 1), "spell_pass": (0, 1, 1), "land_spell_pass": (1, 1, 1), "none": (0, 0, 0),
    }
    for n, bits in combos.items():
        cond = " AND ".join(
            f"{'' if b else 'NOT '}{k}_available" for k, b in zip(("land", "spell", "pass"), bits)
        )
        sel.append(f"{ct(cond)} AS priority_choice_{n}")
    inner = f"SELECT evaluation_id, {', '.join(sel)} FROM v_log GROUP BY evaluation_id"
    rates = {
        "attack_rate": ("attack_count", "decisions"), "passed_when_able": ("pass_count", "could_pass"),
        "attacked_when_able": ("attack_count", "could_attack"),
        "landed_when_able": ("land_count", "could_land"), "cast_when_able": ("spell_count", "could_spell"),
        "pass_land_pass_rate": ("pass_land_pass", "pass_land_decisions"),
        "pass_land_land_rate": ("pass_land_land", "pass_land_decisions"),
        "pass_land_spell_rate": ("pass_land_spell", "pass_land_decisions"),
    }
    outer = ", ".join(f"{r6(rate(n, d))} AS {k}" for k, (n, d) in rates.items())
    return f"SELECT a.*, {outer} FROM ({inner}) a"


@query("A06_evaluation_metrics", _metrics_sql())
def a06(t):
    out = A.evaluation_metrics(t.v_log)
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


@query(
    "A06_evaluation_games",
    f"""WITH a AS (SELECT matchup AS evaluation_id, COUNT(*) AS num_games, {ct('hero_won')} AS wins,
    {r6('AVG(steps)')} AS mean_steps, {ct('hero_seat=0')} AS games_on_play,
    {ct('hero_seat=0 AND hero_won')} AS wins_on_play, {ct('hero_seat=1')} AS games_on_draw,
    {ct('hero_seat=1 AND hero_won')} AS wins_on_draw FROM v_games GROUP BY matchup)
    SELECT a.*, {r6(rate('wins', 'num_games'))} AS win_rate, {r6(wilson('wins', 'num_games', 'lo'))} AS win_ci_lower,
    {r6(rate('wins_on_play', 'games_on_play'))} AS win_rate_on_play,
    {r6(rate('wins_on_draw', 'games_on_draw'))} AS win_rate_on_draw FROM a""",
)
def a06b(t):
    out = A.evaluation_games(t.v_games.withColumnRenamed("matchup", "evaluation_id"))
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


_CS_ALL = (
    "CASE WHEN concat_ws('+', {0}) = '' THEN 'none' ELSE concat_ws('+', {0}) END"
)


def _cs(kinds):
    return _CS_ALL.format(", ".join(f"CASE WHEN {k}_available THEN '{k}' END" for k in kinds))


@query(
    "A07_choice_set_counts",
    f"""SELECT evaluation_id, scope, choice_set, COUNT(*) AS count FROM (
    SELECT evaluation_id, 'all' AS scope, {_cs(('land', 'spell', 'pass', 'attack', 'block'))} AS choice_set FROM v_log
    UNION ALL SELECT evaluation_id, 'priority', {_cs(('land', 'spell', 'pass'))} FROM v_log) x
    GROUP BY evaluation_id, scope, choice_set""",
)
def a07(t):
    return A.choice_set_counts(t.v_log.withColumn("target_available", F.lit(False)))


@query(
    "P06_choice_set",
    f"""SELECT step, {_cs(('land', 'spell', 'pass', 'attack', 'block'))} AS choice_set,
    {_cs(('land', 'spell', 'pass'))} AS priority_choice FROM v_log""",
)
def p06(t):
    d = t.v_log.withColumn("target_available", F.lit(False))
    return d.select(
        "step", A.choice_set().alias("choice_set"),
        A.choice_set(("land", "spell", "pass")).alias("priority_choice"),
    )


@query(
    "A08_simulation_summary",
    f"""WITH a AS (SELECT matchup, COUNT(*) AS total_games, {ct('winner=hero_seat')} AS hero_wins,
    {ct('winner<>hero_seat')} AS villain_wins, {ct('winner IS NULL')} AS timeouts, {r6('AVG(steps)')} AS avg_steps,
    {r6('AVG(duration)')} AS avg_duration,
    {r6('COALESCE(AVG(CASE WHEN winner=hero_seat THEN steps END), 0)')} AS avg_steps_to_win
    FROM v_games GROUP BY matchup)
    SELECT a.*, {r6(rate('hero_wins', 'total_games'))} AS hero_win_rate,
    {r6(rate('villain_wins', 'total_games'))} AS villain_win_rate FROM a""",
)
def a08(t):
    out = A.simulation_summary(t.v_games, ["matchup"])
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


_OUT = "CASE WHEN winner IS NULL THEN 'timeout' WHEN winner=hero_seat THEN 'hero_win' ELSE 'villain_win' END"


@query(
    "A09_turn_distribution",
    f"""SELECT matchup, outcome, COUNT(*) AS count, MIN(turns) AS min, MAX(turns) AS max,
    {r6('quantile_cont(turns, 0.25)')} AS p25, {r6('quantile_cont(turns, 0.5)')} AS p50,
    {r6('quantile_cont(turns, 0.75)')} AS p75 FROM (
    SELECT matchup, {_OUT} AS outcome, CAST(turns AS DOUBLE) AS turns FROM v_games
    UNION ALL SELECT matchup, 'all', CAST(turns AS DOUBLE) FROM v_games) x GROUP BY matchup, outcome""",
)
def a09(t):
    g = t.v_games.drop("steps").withColumnRenamed("turns", "steps")
    return rounded(A.turn_analysis(g, ["matchup"]), ["p25", "p50", "p75"])


@query(
    "A09_win_rate_by_band",
    "WITH a AS (SELECT matchup, "
    + ", ".join(
        f"{ct(c)} AS {n}_games, {ct(c + ' AND winner=hero_seat')} AS {n}_wins"
        for n, c in (("early", "turns BETWEEN 0 AND 10"), ("mid", "turns BETWEEN 11 AND 25"), ("late", "turns >= 26"))
    )
    + " FROM v_games GROUP BY matchup) SELECT a.*, "
    + ", ".join(f"{r6(rate(f'{n}_wins', f'{n}_games'))} AS {n}_win_rate" for n in ("early", "mid", "late"))
    + " FROM a",
)
def a09b(t):
    g = t.v_games.drop("steps").withColumnRenamed("turns", "steps")
    out = A.win_rate_by_band(g, ["matchup"])
    return rounded(out, ["early_win_rate", "mid_win_rate", "late_win_rate"])


@query(
    "A09_turn_histogram",
    f"""WITH s AS (SELECT matchup, MIN(duration) AS lo, MAX(duration) AS hi FROM v_games GROUP BY matchup),
    c AS (SELECT g.matchup, CAST(least(floor((g.duration - s.lo) / ((s.hi - s.lo) / 20)), 19) AS INT) AS bin,
      COUNT(*) AS n FROM v_games g JOIN s ON g.matchup = s.matchup GROUP BY 1, 2),
    spine AS (SELECT matchup, lo, hi, CAST(b AS INT) AS bin FROM s, range(20) r(b))
    SELECT spine.matchup, spine.bin, COALESCE(c.n, 0) AS count,
    {r6('spine.lo + spine.bin * (spine.hi - spine.lo) / 20')} AS bin_lower
    FROM spine LEFT JOIN c ON c.matchup = spine.matchup AND c.bin = spine.bin""",
)
def a09c(t):
    return rounded(A.histogram(t.v_games, "duration", 20, ["matchup"]), ["bin_lower"])


@query(
    "A10_behaviour_summary",
    f"""WITH kv AS (SELECT event_type AS key, CAST(k AS VARCHAR) AS value, event_id AS ordinal FROM v_events
      WHERE event_type IN ('click', 'view')
      UNION ALL SELECT event_type, 'bucket' || CAST(k % 7 AS VARCHAR), event_id FROM v_events
      WHERE event_type NOT IN ('click', 'view')),
    p AS (SELECT key, value, COUNT(*) AS n, MIN(ordinal) AS f, TRY_CAST(value AS DOUBLE) AS num FROM kv GROUP BY key, value),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS rn FROM p)
    SELECT key, {r6('CASE WHEN bool_and(num IS NOT NULL) THEN SUM(num*n)/SUM(n) END')} AS mean,
    CASE WHEN NOT bool_and(num IS NOT NULL) THEN MAX(CASE WHEN rn=1 THEN value END) END AS mode FROM r GROUP BY key""",
)
def a10(t):
    ev = t.v_events
    numeric = F.col("event_type").isin("click", "view")
    kv = ev.select(
        F.col("event_type").alias("key"),
        F.when(numeric, F.col("k").cast("string"))
        .otherwise(F.concat(F.lit("bucket"), (F.col("k") % 7).cast("string"))).alias("value"),
        F.col("event_id").alias("ordinal"),
    )
    return rounded(A.behaviour_summary(kv), ["mean"])


@query(
    "A11_span_summary",
    f"""WITH s AS (SELECT run, path, SUM(seconds) AS total, COUNT(*) AS count FROM v_spans GROUP BY run, path)
    SELECT path, {r6('SUM(total)/COUNT(*)')} AS avg_total_time, {r6('SUM(count)/COUNT(*)')} AS avg_call_count,
    {r6('SUM(total)/SUM(count)')} AS avg_time_per_call FROM s GROUP BY path""",
)
def a11(t):
    per_run = t.v_spans.groupBy("run", "path").agg(
        F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("count")
    )
    return rounded(A.span_summary(per_run), ["avg_total_time", "avg_call_count", "avg_time_per_call"])


@query(
    "A12_scenario_aggregate",
    f"""WITH a AS (SELECT l_shipmode.player_id, l_shipmode.scenario, COUNT(*) AS runs, {ct('ok')} AS correct
      FROM (SELECT l_returnflag AS player_id, l_linenumber AS scenario, l_quantity > 25 AS ok FROM lineitem) l_shipmode
      GROUP BY 1, 2)
    SELECT a.*, {_ci(('correct_rate', 'ci_lower', 'ci_upper'), 'correct', 'runs')} FROM a""",
)
def a12(t):
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("player_id"), F.col("l_linenumber").alias("scenario"),
        (F.col("l_quantity") > 25).alias("correct"),
    )
    return rounded(
        A.scenario_aggregate(runs, ["player_id", "scenario"]), ["correct_rate", "ci_lower", "ci_upper"]
    )


@query(
    "A12_scenario_details",
    f"""SELECT l_returnflag AS player_id, 'late' AS key, NULL AS label, CAST({ct('l_tax > 0.04')} AS DOUBLE) AS result
      FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT l_returnflag, 'quantity', NULL, {r6('AVG(CASE WHEN l_discount > 0.02 THEN l_quantity END)')}
      FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT l_returnflag, 'status', l_linestatus, CAST(COUNT(*) AS DOUBLE) FROM lineitem GROUP BY 1, 3""",
)
def a12b(t):
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("player_id"),
        F.create_map(
            F.lit("late"), (F.col("l_tax") > 0.04).cast("string"),
            F.lit("quantity"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity").cast("string")),
            F.lit("status"), F.col("l_linestatus"),
        ).alias("detail"),
    )
    return rounded(A.scenario_details(runs, ["player_id"]), ["result"])


def _probe_rows(t):
    """Orders as games; line numbers and flags as probe counters."""
    li = t.lineitem.select(
        F.col("l_orderkey").alias("game_index"), "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    q = F.col("l_quantity")
    conds = {
        "counter_windows": q > 10, "counter_casts": q > 20, "counter_casts_first_window": q > 30,
        "bolt_casts": q > 5, "bolt_biggest": q > 40, "bolt_face": q < 8, "bolt_own": q > 47,
        "bolt_multi_choice": q > 25, "hold_windows": q > 15, "hold_breaks": q > 45,
    }
    return li.groupBy("game_index").agg(
        *[E.count_true(c).alias(n) for n, c in conds.items()],
        F.collect_list(F.when(q > 20, F.col("l_linenumber"))).alias("countered_mana_values"),
    )


_PROBE_CONDS = {
    "counter_windows": "l_quantity > 10", "counter_casts": "l_quantity > 20",
    "counter_casts_first_window": "l_quantity > 30", "bolt_casts": "l_quantity > 5",
    "bolt_biggest": "l_quantity > 40", "bolt_face": "l_quantity < 8", "bolt_own": "l_quantity > 47",
    "bolt_multi_choice": "l_quantity > 25", "hold_windows": "l_quantity > 15", "hold_breaks": "l_quantity > 45",
}


@query(
    "A13_behaviour_cell",
    f"""WITH p AS (SELECT o.o_orderpriority AS cell, {', '.join(f"{ct(c)} AS {n}" for n, c in _PROBE_CONDS.items())},
      AVG(CASE WHEN l_quantity > 20 THEN l_linenumber END) AS mv, {ct('l_quantity > 20 AND l_linenumber <= 2')} AS low
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1),
    h AS (SELECT matchup AS cell, COUNT(*) AS games, {ct('hero_won')} AS wins, AVG(turns) AS mt,
      {ct('winner IS NULL')} AS draws_or_caps,
      {rate(ct('hero_seat=0 AND hero_won'), ct('hero_seat=0'), 'NULL')} AS rp,
      {rate(ct('hero_seat=1 AND hero_won'), ct('hero_seat=1'), 'NULL')} AS rd FROM v_games GROUP BY 1)
    SELECT h.cell, games, wins, {r6('mt')} AS mean_turns, draws_or_caps, {r6('rp')} AS win_rate_on_play,
    {r6('rd')} AS win_rate_on_draw, {_ci(('win_rate', 'ci_lower', 'ci_upper'), 'wins', 'games')},
    {', '.join(_PROBE_CONDS)},
    {r6(rate('counter_casts', 'counter_windows', 'NULL'))} AS counter_cast_rate_per_window,
    {r6(rate('counter_casts_first_window', 'counter_casts', 'NULL'))} AS counter_first_window_rate,
    {r6('mv')} AS countered_mv_mean, {r6(rate('low', 'counter_casts', 'NULL'))} AS countered_mv_le2_share,
    {r6(rate('bolt_biggest', 'bolt_multi_choice', 'NULL'))} AS bolt_biggest_rate_multi,
    {r6(rate('bolt_face', 'bolt_casts', 'NULL'))} AS bolt_face_share,
    {r6(rate('bolt_own', 'bolt_casts', 'NULL'))} AS bolt_own_share,
    {r6('1.0 - ' + rate('hold_breaks', 'hold_windows', 'NULL'))} AS instant_holding_rate
    FROM h LEFT JOIN p ON p.cell = h.cell""",
)
def a13(t):
    records = t.v_games.withColumnRenamed("matchup", "cell")
    probes = _probe_rows(t).join(records.select("game_index", "cell"), "game_index")
    out = A.behaviour_cell(records, probes)
    return rounded(out, [c for c, d in out.dtypes if d == "double"])


def _probe_log(t):
    ev = t.v_events
    return ev.select(
        F.col("user_id").alias("game"), F.col("event_id").alias("ordinal"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "priority")
        .when(F.col("event_type") == "signup", "target").otherwise("other").alias("kind"),
        (F.col("k") % 3 != 0).alias("counter_available"),
        F.when(F.col("k") % 4 == 0, "counter").when(F.col("k") % 4 == 1, "bolt").alias("cast"),
        (F.col("k") % 2 + 1).alias("stack_size"), F.lit("a").alias("stack_name"),
        (F.col("k") % 6).alias("stack_value"), (F.col("k") % 5 == 0).alias("hold_risk"),
        (F.col("k") % 10 == 0).alias("cast_creature"),
        F.when(F.col("k") % 3 == 0, "face").when(F.col("k") % 3 == 1, "enemy").otherwise("own").alias("target_side"),
        (F.col("k") % 4).alias("enemy_creatures"), (F.col("k") % 5).alias("target_power"),
        F.lit(3).alias("max_enemy_power"), F.lit("b").alias("target_name"), (F.col("k") % 7).alias("target_value"),
    )


@query(
    "A14_behaviour_probe",
    f"""WITH d AS (SELECT user_id AS game, event_id AS o, k,
      CASE WHEN event_type IN ('click','view','purchase') THEN 'priority' WHEN event_type='signup' THEN 'target' ELSE 'other' END AS kind,
      CASE WHEN k % 4 = 0 THEN 'counter' WHEN k % 4 = 1 THEN 'bolt' ELSE 'none' END AS c FROM v_events),
    e AS (SELECT *, lag(kind) OVER w AS pk, lag(c) OVER w AS pc, lag(k) OVER w AS pkk,
      MIN(CASE WHEN kind='priority' AND k % 3 <> 0 THEN o END) OVER (PARTITION BY game) AS f
      FROM d WINDOW w AS (PARTITION BY game ORDER BY o)),
    g AS (SELECT *, kind='priority' AND k % 3 <> 0 AS win, kind='priority' AND k % 3 <> 0 AND c='counter' AS cast_c,
      COALESCE(kind='target' AND pk='priority' AND pc='bolt', false) AS ab,
      COALESCE(kind='target' AND pk='priority' AND pc='counter' AND pkk % 3 <> 0 AND pkk % 2 + 1 <> 1, false) AS ac FROM e)
    SELECT game, {ct('win')} AS counter_windows, {ct('cast_c')} AS counter_casts,
    {ct('cast_c AND o = f')} AS counter_casts_first_window,
    {ct('(cast_c AND k % 2 + 1 = 1) OR ac')} AS countered,
    CAST(SUM(CASE WHEN cast_c AND k % 2 + 1 = 1 THEN k % 6 WHEN ac THEN k % 7 END) AS BIGINT) AS countered_value,
    {ct('CASE WHEN cast_c AND k % 2 + 1 = 1 THEN k % 6 WHEN ac THEN k % 7 END <= 2')} AS countered_value_le2,
    {ct("kind='priority' AND c='bolt'")} AS bolt_casts, {ct('ab AND k % 4 >= 2')} AS bolt_multi_choice,
    {ct('ab AND k % 4 >= 2 AND k % 3 = 1 AND k % 5 >= 3')} AS bolt_biggest, {ct('ab AND k % 3 = 0')} AS bolt_face,
    {ct('ab AND k % 3 = 2')} AS bolt_own, {ct("kind='priority' AND k % 5 = 0")} AS hold_windows,
    {ct("kind='priority' AND k % 10 = 0")} AS hold_breaks FROM g GROUP BY game""",
)
def a14(t):
    return A.behaviour_probe(_probe_log(t))


@query(
    "A36_took_rates",
    f"""SELECT evaluation_id, {', '.join(f"{ct(f'{k}_available')} AS {k}_available_count, "
        f"{ct(f"{k}_available AND action_type='{k}'")} AS {k}_took_count" for k in ('land', 'spell', 'attack'))}
    FROM v_log GROUP BY evaluation_id""",
)
def a36(t):
    return A.took_rates(t.v_log, ["evaluation_id"])


@query(
    "A41_sanity",
    f"""WITH g AS (SELECT matchup AS scope, hero_won, aborted, steps > 9 AS truncated FROM v_games
      UNION ALL SELECT 'TOTAL', hero_won, aborted, steps > 9 FROM v_games),
    a AS (SELECT scope, COUNT(*) AS games, {ct('hero_won')} AS hero_wins, {ct('aborted')} AS aborts,
      {ct('truncated')} AS truncations FROM g GROUP BY scope)
    SELECT a.*, {_ci(('win_rate', 'ci_lower', 'ci_upper'), 'hero_wins', 'games')} FROM a""",
)
def a41(t):
    return rounded(
        A.sanity(t.v_games.withColumn("truncated", F.col("steps") > 9)), ["win_rate", "ci_lower", "ci_upper"]
    )
