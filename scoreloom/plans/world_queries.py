"""Registered queries for possible worlds and beliefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.operators import tracking as T
from scoreloom.operators import worlds as B
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6
from scoreloom.session import cut_lineage

NAMES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
IDX = range(1, 7)


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


def pools(t):
    """The pools, written once: they take a pass over all line items, and the queries below read them in several places."""
    p = t.role("v_pool").filter("n > 0")
    return cut_lineage(p.groupBy("space_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("pool")).withColumn("hand_size", F.lit(3)))


def worlds(p):
    """The world table, written once: several operators below read it."""
    return cut_lineage(B.enumerate_worlds(p))


def posterior(w):
    return cut_lineage(B.update(B.prior(w), likelihoods(w), 0.1)[0])


def _worlds_cte(h=3, name="ww"):
    n = ", ".join(f"MAX(CASE WHEN name='{x}' THEN n ELSE 0 END) AS n{i}" for i, x in zip(IDX, NAMES))
    ranges = ", ".join(f"range(4) g{i}(k{i})" for i in IDX)
    cap = " AND ".join(f"k{i}<=n{i}" for i in IDX)
    total = "+".join(f"k{i}" for i in IDX)
    weight = "*".join(f"(CASE WHEN k{i}=0 OR k{i}=n{i} THEN 1 ELSE n{i} END)" for i in IDX)  # C(n,k) for n <= 3
    key = ", ".join(f"CASE WHEN k{i}>0 THEN '{x}=' || CAST(k{i} AS VARCHAR) END" for i, x in zip(IDX, NAMES))
    order = ", ".join(f"k{i}" for i in IDX)
    pool = "+".join(f"n{i}" for i in IDX)
    return (
        f"pw{h} AS (SELECT space_id, {n} FROM v_pool GROUP BY 1), "
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY {order})-1 AS world_index FROM "
        f"(SELECT pw{h}.*, {order}, CAST({weight} AS DOUBLE) AS weight, concat_ws(';', {key}) AS hand_key, {pool} AS pool_size "
        f"FROM pw{h}, {ranges} WHERE {cap} AND {total}={h}) z)"
    )


W = _worlds_cte()
P = f"{W}, pr AS (SELECT *, weight/SUM(weight) OVER (PARTITION BY space_id) AS p FROM ww)"
# A commitment that more than a third of the worlds cannot match.
L = f"""{P}, lk AS (SELECT *, (world_index % 7)/10.0E0 + 0.1E0 AS likelihood, 4 AS legal, world_index % 3 AS matching FROM pr),
 mx AS (SELECT *, p * CASE WHEN matching>0 THEN 0.9*likelihood + 0.1*matching/legal ELSE 0 END AS q FROM lk),
 tot AS (SELECT space_id, SUM(q) AS z FROM mx GROUP BY 1 HAVING SUM(q)>0),
 up AS (SELECT mx.*, q/z AS pu FROM mx JOIN tot ON tot.space_id=mx.space_id)"""


def likelihoods(w):
    i = F.col("world_index")
    return w.select("space_id", "world_index", ((i % 7) / 10.0 + 0.1).alias("likelihood"), F.lit(4).alias("legal"), (i % 3).cast("int").alias("matching"))


def _draw_cte(src, p, name="dr"):
    """One hidden draw of every belief row in SQL: move to the successor hand of each name."""
    parts = []
    for j in IDX:
        ks = ", ".join(f"k{i}+1 AS k{i}" if i == j else f"k{i}" for i in IDX)
        parts.append(f"SELECT space_id, {ks}, {p}*(n{j}-k{j})/(pool_size-3) AS m FROM {src} WHERE n{j}-k{j}>0 AND {p}>0")
    key = ", ".join(f"CASE WHEN k{i}>0 THEN '{x}=' || CAST(k{i} AS VARCHAR) END" for i, x in zip(IDX, NAMES))
    return f"{name} AS (SELECT space_id, concat_ws(';', {key}) AS hand_key, SUM(m) AS m FROM ({' UNION ALL '.join(parts)}) z GROUP BY 1, 2)"


QUERIES_DECLARED = [
    B.WorldQuery("true", "true"), B.WorldQuery("has_promo_1", "has", "PROMO", 1), B.WorldQuery("has_small_0", "has", "SMALL", 0),
    B.WorldQuery("lacks_large_2", "lacks", "LARGE", 2), B.WorldQuery("exactly_economy_0", "exactly", "ECONOMY", 0),
    B.WorldQuery("not_exactly_medium_1", "not_exactly", "MEDIUM", 1), B.WorldQuery("exactly_standard_5", "exactly", "STANDARD", 5),
]
_QSQL = {
    "true": "true", "has_promo_1": "k4>=1", "has_small_0": "true", "lacks_large_2": "k2<2", "exactly_economy_0": "k1=0",
    "not_exactly_medium_1": "k3<>1", "exactly_standard_5": "k6=5",
}


@query("P04_world_predicate", f"WITH {W} SELECT space_id, world_index, " + ", ".join(f"{c} AS {n}" for n, c in _QSQL.items() if n != "true") + " FROM ww")
def p04(t):
    w = worlds(pools(t))
    return w.select("space_id", "world_index", *[B.world_predicate(q).alias(q.query_id) for q in QUERIES_DECLARED if q.query_id != "true"])


@query(
    "P05_canonical_predicate",
    """WITH pl AS (SELECT space_id, MAX(CASE WHEN name='PROMO' THEN least(n,3) ELSE 0 END) AS promo, MAX(CASE WHEN name='LARGE' THEN least(n,3) ELSE 0 END) AS large,
      MAX(CASE WHEN name='MEDIUM' THEN least(n,3) ELSE 0 END) AS medium FROM v_pool GROUP BY 1 HAVING MAX(n)>0)
    SELECT space_id, 'true' AS query_id, 'true' AS canonical_kind, CAST(NULL AS VARCHAR) AS card, CAST(NULL AS INT) AS count FROM pl
    UNION ALL SELECT space_id, 'has_promo_1', CASE WHEN promo<1 THEN 'empty' ELSE 'has' END, CASE WHEN promo>=1 THEN 'PROMO' END, CASE WHEN promo>=1 THEN 1 END FROM pl
    UNION ALL SELECT space_id, 'has_small_0', 'true', NULL, NULL FROM pl
    UNION ALL SELECT space_id, 'lacks_large_2', CASE WHEN large<2 THEN 'true' ELSE 'lacks' END, CASE WHEN large>=2 THEN 'LARGE' END, CASE WHEN large>=2 THEN 2 END FROM pl
    UNION ALL SELECT space_id, 'exactly_economy_0', 'lacks', 'ECONOMY', 1 FROM pl
    UNION ALL SELECT space_id, 'not_exactly_medium_1', CASE WHEN medium<1 THEN 'true' ELSE 'not_exactly' END, CASE WHEN medium>=1 THEN 'MEDIUM' END, CASE WHEN medium>=1 THEN 1 END FROM pl
    UNION ALL SELECT space_id, 'exactly_standard_5', 'empty', NULL, NULL FROM pl""",
)
def p05(t):
    return B.canonical_predicates(pools(t), QUERIES_DECLARED)


@query("B01_enumerate_worlds", f"WITH {W} SELECT space_id, world_index, hand_key, CAST(weight AS BIGINT) AS weight FROM ww")
def b01(t):
    return B.enumerate_worlds(pools(t)).select("space_id", "world_index", "hand_key", F.col("weight").cast("bigint").alias("weight"))


@query(
    "B01_total_weights",
    f"WITH {W} SELECT space_id, CAST(SUM(weight) AS BIGINT) AS total_weight FROM ww GROUP BY 1 UNION ALL "
    "SELECT space_id, 0 FROM v_pool GROUP BY 1 HAVING SUM(n)<3 AND SUM(n)>0",
)
def b01b(t):
    return B.total_weights(pools(t))


@query(
    "B02_support",
    f"WITH {W} " + " UNION ALL ".join(
        f"SELECT space_id, '{n}' AS query_id, {ct(c)} AS support_size, CAST(SUM(CASE WHEN {c} THEN weight ELSE 0 END) AS BIGINT) AS total_weight FROM ww GROUP BY 1"
        for n, c in _QSQL.items()
    ),
)
def b02(t):
    out = B.support(B.enumerate_worlds(pools(t)), QUERIES_DECLARED)
    return out.withColumn("total_weight", F.col("total_weight").cast("bigint"))


_PLAN = B.query_plan(B.WorldQuery("has_promo", "has", "PROMO", 1), B.WorldQuery("small_1", "exactly", "SMALL", 1))
_PSQL = {"true": "true", "has_promo": "k4>=1", "not(has_promo)": "k4<1", "small_1": "k5=1", "not(small_1)": "k5<>1"}
_COND = f"{P}, cd AS (" + " UNION ALL ".join(f"SELECT space_id, '{n}' AS condition, world_index, hand_key, weight FROM ww WHERE {c}" for n, c in _PSQL.items()) + ")"


@query(
    "B03_B04_conditions",
    f"""WITH {_COND}, al AS (SELECT space_id, SUM(weight) AS t FROM ww GROUP BY 1)
    SELECT cd.space_id, condition, world_index, hand_key, {r6('weight/SUM(weight) OVER (PARTITION BY cd.space_id, condition)')} AS p,
    {r6('SUM(weight) OVER (PARTITION BY cd.space_id, condition)/t')} AS condition_mass, COUNT(*) OVER (PARTITION BY cd.space_id, condition) AS support_size
    FROM cd JOIN al ON al.space_id=cd.space_id""",
)
def b03(t):
    return rounded(B.conditions(B.enumerate_worlds(pools(t)), _PLAN)[0])


@query(
    "B03_empty_support",
    f"""WITH {_COND}, c AS (SELECT DISTINCT space_id, condition FROM cd), s AS (SELECT DISTINCT space_id FROM ww)
    SELECT 'empty_support' AS rule, CAST(s.space_id AS VARCHAR) || '/' || q.n AS key, '' AS detail
    FROM s, (VALUES {', '.join(f"('{n}')" for n in _PSQL)}) q(n) ANTI JOIN c ON c.space_id=s.space_id AND c.condition=q.n""",
)
def b03b(t):
    return B.conditions(B.enumerate_worlds(pools(t)), _PLAN)[1]


@query("B05_prior", f"WITH {P} SELECT space_id, world_index, hand_key, {r6('ln(p)')} AS log_p FROM pr")
def b05(t):
    return rounded(B.prior(B.enumerate_worlds(pools(t))).drop("hand"))


@query(
    "B05_from_weights",
    f"""WITH b AS (SELECT user_id AS space_id, event_id AS world_index, CASE WHEN k<20 THEN 0 ELSE value END AS w FROM v_events), s AS (SELECT space_id, SUM(w) AS t FROM b GROUP BY 1)
    SELECT b.space_id, world_index, CASE WHEN w>0 THEN {r6('ln(w/t)')} ELSE CAST('-inf' AS DOUBLE) END AS log_p FROM b JOIN s ON s.space_id=b.space_id WHERE t>0""",
)
def b05b(t):
    d = t.v_events.select(F.col("user_id").alias("space_id"), F.col("event_id").alias("world_index"), F.when(F.col("k") < 20, 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("w"))
    out = B.from_weights(d)[0].drop("w")
    return out.withColumn("log_p", F.when(F.col("log_p") > B.NEG_INF, E.r6("log_p")).otherwise(F.col("log_p")))


@query("B06_update", f"WITH {L} SELECT space_id, world_index, {r6('pu')} AS p FROM up")
def b06(t):
    w = worlds(pools(t))
    out, _ = B.update(B.prior(w), likelihoods(w), 0.1)
    return rounded(out.select("space_id", "world_index", F.exp("log_p").alias("p")))


def impossible(w):
    """No offer matches in spaces with an odd id."""
    return likelihoods(w).withColumn("matching", F.when(F.col("space_id") % 2 == 1, 0).otherwise(F.col("matching")))


@query(
    "B06_update_violations",
    f"""WITH {L} SELECT DISTINCT 'no_finite_mass' AS rule, CAST(space_id AS VARCHAR) AS key, '' AS detail FROM mx
    WHERE space_id % 2 = 1 OR space_id NOT IN (SELECT space_id FROM tot)""",
)
def b06b(t):
    w = worlds(pools(t))
    return B.update(B.prior(w), impossible(w), 0.1)[1]


def invalid(rows, key="space_id"):
    """One likelihood of every space with an odd id is out of range."""
    return rows.withColumn("likelihood", F.when((F.col(key) % 2 == 1) & (F.col("world_index") == 0), 1.5).otherwise(F.col("likelihood")))


@query("B06_invalid_space_stops", f"WITH {L} SELECT space_id, world_index, {r6('pu')} AS p FROM up WHERE space_id % 2 = 0")
def b06_stops(t):
    w = worlds(pools(t))
    out, _ = B.update(B.prior(w), invalid(likelihoods(w)), 0.1)
    return rounded(out.select("space_id", "world_index", F.exp("log_p").alias("p")))


@query("B07_draw", f"WITH {L}, {_draw_cte('up', 'pu')} SELECT space_id, hand_key, {r6('m')} AS p FROM dr")
def b07(t):
    pl = pools(t)
    w = worlds(pl)
    return rounded(B.draw(posterior(w), pl).select("space_id", "hand_key", F.exp("log_p").alias("p")))


_MINUS = ", ".join(f"CASE WHEN k{i}{'-1' if i == 4 else ''}>0 THEN '{x}=' || CAST(k{i}{'-1' if i == 4 else ''} AS VARCHAR) END" for i, x in zip(IDX, NAMES))
_PLUS = ", ".join(f"CASE WHEN k{i}{'+1' if i == 4 else ''}>0 THEN '{x}=' || CAST(k{i}{'+1' if i == 4 else ''} AS VARCHAR) END" for i, x in zip(IDX, NAMES))


@query("B08_remove_known", f"WITH {P} SELECT space_id, concat_ws(';', {_MINUS}) AS hand_key, {r6('p')} AS p FROM pr WHERE k4>0")
def b08(t):
    pl = pools(t)
    b = B.prior(B.enumerate_worlds(pl))
    out = B.remove_known(b, pl.select("space_id", F.lit("PROMO").alias("card")))
    return rounded(out.select("space_id", "hand_key", F.exp("log_p").alias("p")))


@query("B08_add_known", f"WITH {P} SELECT space_id, concat_ws(';', {_PLUS}) AS hand_key, {r6('p')} AS p FROM pr")
def b08b(t):
    pl = pools(t)
    b = B.prior(B.enumerate_worlds(pl))
    out = B.add_known(b, pl.select("space_id", F.lit("PROMO").alias("card")))
    return rounded(out.select("space_id", "hand_key", F.exp("log_p").alias("p")))


def _later(pl, hand_size):
    """The spaces after hidden draws, under ids of their own: -1 - id."""
    return pl.withColumns({"space_id": -1 - F.col("space_id"), "hand_size": F.lit(hand_size)})


@query(
    "B09_transport",
    f"WITH {L}, {_draw_cte('up', 'pu')}, {_worlds_cte(4, 'w4')} SELECT -1 - w4.space_id AS space_id, w4.hand_key, {r6('COALESCE(m, 0)')} AS p FROM w4 JOIN (SELECT DISTINCT space_id FROM dr) s ON s.space_id=w4.space_id LEFT JOIN dr ON dr.space_id=w4.space_id AND dr.hand_key=w4.hand_key",
)
def b09(t):
    pl = pools(t)
    w = worlds(pl)
    none = F.array().cast("array<string>")
    facts = pl.select("space_id", (-1 - F.col("space_id")).alias("next_space_id"), none.alias("exits"), none.alias("returns"), F.lit(1).alias("hidden_draws"))
    out, _ = B.transport(posterior(w), pl, facts, worlds(_later(pl, 4)))
    return rounded(out.select("space_id", "hand_key", F.exp("log_p").alias("p")))


@query(
    "B09_transition_links",
    f"""WITH {W}, {_worlds_cte(5, 'w5')} SELECT ww.space_id, ww.world_index AS source, w5.world_index AS target,
    {r6(" * ".join(f"CASE w5.k{i}-ww.k{i} WHEN 0 THEN 1 WHEN 1 THEN ww.n{i}-ww.k{i} ELSE (ww.n{i}-ww.k{i})*(ww.n{i}-ww.k{i}-1)/2 END" for i in IDX) + " / ((ww.pool_size-3)*(ww.pool_size-4)/2)")} AS factor
    FROM ww JOIN w5 ON w5.space_id=ww.space_id AND {" AND ".join(f"w5.k{i}>=ww.k{i}" for i in IDX)}""",
)
def b09_links(t):
    """Two hidden draws from every world of every space."""
    pl = pools(t)
    none = F.array().cast("array<string>")
    facts = T.with_move_id(pl.select(F.col("space_id").alias("before_space"), (-1 - F.col("space_id")).alias("after_space"), none.alias("exits"), none.alias("returns"), F.lit(2).alias("hidden_draws")))
    links = T.transition_links(T.moves(facts), pl, worlds(pl.unionByName(_later(pl, 5))))
    return rounded(links.join(facts.select("move_id", F.col("before_space").alias("space_id")), "move_id").select("space_id", "source", "target", "factor"))


@query(
    "B10_belief_stats",
    f"""WITH {L} SELECT space_id, COUNT(*) AS support_size, {ct('pu>0')} AS positive_support, 0.0 AS normalisation_error, {r6('1/SUM(pu*pu)')} AS effective_size, {r6('MAX(pu)')} AS top_mass FROM up GROUP BY 1""",
)
def b10(t):
    w = worlds(pools(t))
    return rounded(B.belief_stats(posterior(w)))


@query(
    "B11_inclusion",
    f"WITH {P} " + " UNION ALL ".join(
        f"SELECT space_id, '{x}' AS card, {r6(f'SUM(CASE WHEN k{i}>0 THEN p ELSE 0 END)')} AS p FROM pr WHERE n{i}>0 GROUP BY 1" for i, x in zip(IDX, NAMES)
    ) + " UNION ALL SELECT v.space_id, v.name, 0.0 FROM v_pool v ANTI JOIN ww ON ww.space_id=v.space_id WHERE v.n>0",
)
def b11(t):
    pl = pools(t)
    return rounded(B.inclusion(B.prior(B.enumerate_worlds(pl)), pl))


@query(
    "B12_sample_worlds",
    f"""WITH {P}, c AS (SELECT *, SUM(p) OVER w AS hi, MAX(world_index) OVER (PARTITION BY space_id) AS lw FROM pr WINDOW w AS (PARTITION BY space_id ORDER BY world_index)),
    d AS (SELECT *, COALESCE(lag(hi) OVER (PARTITION BY space_id ORDER BY world_index),0) AS lo FROM c), u AS (SELECT i AS draw, (i*37 % 101)/101.0E0 + 0.001E0 AS u FROM range(32) r(i))
    SELECT space_id, draw, world_index FROM d JOIN u ON u.u>=lo AND u.u < CASE WHEN world_index=lw THEN 1.0 ELSE hi END""",
)
def b12(t):
    b = B.prior(B.enumerate_worlds(pools(t)))
    u = t.spark.range(32).select(F.col("id").cast("int").alias("draw"), ((F.col("id") * 37 % 101) / 101.0 + 0.001).alias("u"))
    return B.sample_worlds(b, u)


def _truth(w):
    """Each world of a space as one observed truth."""
    return w.select(F.concat_ws("/", F.col("space_id").cast("string"), F.col("world_index").cast("string")).alias("point_id"), "space_id", "hand")


@query(
    "B13_score_truth",
    f"""WITH {L}, s AS (SELECT space_id, MAX(pu) AS top, 1/SUM(pu*pu) AS ess FROM up GROUP BY 1),
    r AS (SELECT *, CASE WHEN pu>0 THEN CAST(rank() OVER (PARTITION BY space_id ORDER BY ROUND(pu, 12) DESC) AS BIGINT) END AS rk FROM up)
    SELECT CAST(r.space_id AS VARCHAR) || '/' || CAST(world_index AS VARCHAR) AS point_id, r.space_id, world_index AS true_world_index, {r6('pu')} AS probability,
    CASE WHEN pu>0 THEN {r6('-ln(pu)')} ELSE CAST('inf' AS DOUBLE) END AS log_loss, rk AS rank, {r6('top')} AS top_mass, {r6('ess')} AS effective_size,
    CAST((n1>0)::INT+(n2>0)::INT+(n3>0)::INT+(n4>0)::INT+(n5>0)::INT+(n6>0)::INT AS BIGINT) AS n_cards,
    CAST((k1>0)::INT+(k2>0)::INT+(k3>0)::INT+(k4>0)::INT+(k5>0)::INT+(k6>0)::INT AS BIGINT) AS n_present FROM r JOIN s ON s.space_id=r.space_id""",
)
def b13(t):
    pl = pools(t)
    w = worlds(pl)
    # Ranks compare probabilities; rounding keeps equal masses equal in both engines.
    known = posterior(w).withColumn("log_p", F.when(F.col("log_p") > B.NEG_INF, F.log(F.round(F.exp("log_p"), 12))).otherwise(F.col("log_p")))
    out = B.score_truth(cut_lineage(known), pl, _truth(w))
    out = out.withColumns({"n_cards": F.size("cards").cast("bigint"), "n_present": F.size(F.filter("cards", lambda c: c["present"])).cast("bigint")}).drop("cards")
    inf = F.col("log_loss") == float("inf")
    return out.withColumns({"log_loss": F.when(inf, F.col("log_loss")).otherwise(E.r6("log_loss")), **{c: E.r6(c) for c in ("probability", "top_mass", "effective_size")}})


@query(
    "B14_score_paired",
    f"""WITH {L} SELECT CAST(space_id AS VARCHAR) || '/' || CAST(world_index AS VARCHAR) AS point_id, space_id, CASE WHEN pu>0 THEN {r6('-ln(pu)')} ELSE CAST('inf' AS DOUBLE) END AS posterior_log_loss,
    {r6('-ln(p)')} AS prior_log_loss, CASE WHEN pu>0 THEN {r6('ln(pu)-ln(p)')} ELSE CAST('-inf' AS DOUBLE) END AS improvement, {r6('pu/p')} AS mass_ratio FROM up""",
)
def b14(t):
    pl = pools(t)
    w = worlds(pl)
    out = B.score_paired(posterior(w), cut_lineage(B.prior(w)), pl, _truth(w))
    keep = lambda c: F.when(F.abs(F.col(c)) == float("inf"), F.col(c)).otherwise(E.r6(c))
    return out.withColumns({c: keep(c) for c in ("posterior_log_loss", "prior_log_loss", "improvement", "mass_ratio")})


def _tracking(t, spoil=lambda rows: rows):
    """Two transitions per game: an opponent commitment in the first space, then one hidden draw."""
    pl = pools(t)
    spaces = cut_lineage(pl.unionByName(_later(pl, 4)))
    w = worlds(spaces)
    none = F.array().cast("array<string>")
    sid = F.col("space_id")
    first = pl.select(sid.alias("game"), F.lit(0).alias("viewer"), F.lit(0).cast("bigint").alias("sequence"), F.lit(10).alias("before_revision"), F.lit(11).alias("after_revision"),
                      sid.alias("before_space"), sid.alias("after_space"), F.lit(1).alias("acting"), F.lit("cast").alias("commitment_kind"), none.alias("exits"), none.alias("returns"), F.lit(0).alias("hidden_draws"))
    second = pl.select(sid.alias("game"), F.lit(0).alias("viewer"), F.lit(1).cast("bigint").alias("sequence"), F.lit(11).alias("before_revision"), F.lit(12).alias("after_revision"),
                       sid.alias("before_space"), (-1 - sid).alias("after_space"), F.lit(1).alias("acting"), F.lit(None).cast("string").alias("commitment_kind"), none.alias("exits"), none.alias("returns"), F.lit(1).alias("hidden_draws"))
    starts = pl.select(sid.alias("game"), F.lit(0).alias("viewer"), F.lit(10).alias("revision"), sid.alias("space_id"))
    lik = likelihoods(w.filter("space_id >= 0")).select(sid.alias("game"), F.lit(0).alias("viewer"), F.lit(0).cast("bigint").alias("sequence"), "world_index", "likelihood", "legal", "matching")
    return T.track(first.unionByName(second), starts, spaces, w, spoil(lik), 0.1)


@query(
    "B15_track_beliefs",
    f"WITH {L}, {_draw_cte('up', 'pu')}, {_worlds_cte(4, 'w4')} SELECT -1 - w4.space_id AS real_space, w4.hand_key, {r6('COALESCE(m, 0)')} AS p FROM w4 JOIN (SELECT DISTINCT space_id FROM dr) s ON s.space_id=w4.space_id LEFT JOIN dr ON dr.space_id=w4.space_id AND dr.hand_key=w4.hand_key",
)
def b15(t):
    _, final, _ = _tracking(t)
    return rounded(final.select("real_space", "hand_key", F.exp("log_p").alias("p")))


@query(
    "B15_track_records",
    f"""WITH {L}, {_draw_cte('up', 'pu')}, {_worlds_cte(4, 'w4')}, f AS (SELECT w4.space_id, COALESCE(m,0) AS m FROM w4 JOIN (SELECT DISTINCT space_id FROM dr) s ON s.space_id=w4.space_id LEFT JOIN dr ON dr.space_id=w4.space_id AND dr.hand_key=w4.hand_key)
    SELECT space_id AS game, 0 AS sequence, true AS action_update, 0 AS hidden_draws, COUNT(*) AS support_size, {ct('pu>0')} AS positive_support, {r6('1/SUM(pu*pu)')} AS effective_size FROM up GROUP BY 1
    UNION ALL SELECT space_id, 1, false, 1, COUNT(*), {ct('m>0')}, {r6('1/SUM(m*m)')} FROM f GROUP BY 1""",
)
def b15b(t):
    records, _, _ = _tracking(t)
    return rounded(records.select("game", "sequence", "action_update", "hidden_draws", "support_size", "positive_support", "effective_size"))


@query(
    "B15_stops_on_violation",
    f"""WITH {L}, {_draw_cte('up', 'pu')}, {_worlds_cte(4, 'w4')}, f AS (SELECT w4.space_id, COALESCE(m,0) AS m FROM w4 JOIN (SELECT DISTINCT space_id FROM dr) s ON s.space_id=w4.space_id LEFT JOIN dr ON dr.space_id=w4.space_id AND dr.hand_key=w4.hand_key)
    SELECT space_id AS game, 0 AS sequence, COUNT(*) AS support_size FROM up WHERE space_id % 2 = 0 GROUP BY 1
    UNION ALL SELECT space_id, 1, COUNT(*) FROM f WHERE space_id % 2 = 0 GROUP BY 1""",
)
def b15_stops(t):
    records, _, _ = _tracking(t, lambda rows: invalid(rows, "game"))
    return records.select("game", "sequence", "support_size")


def _offers(t):
    li = t.lineitem
    kind = F.when(F.col("l_returnflag") == "R", "cast").when(F.col("l_returnflag") == "A", "play_land").otherwise("pass_priority")
    offer = F.when(F.col("l_tax") > 0, F.when(kind == "pass_priority", F.create_map(F.lit("kind"), kind)).otherwise(
        F.create_map(F.lit("kind"), kind, F.lit("card"), F.col("l_linestatus"))))
    d = li.groupBy(F.col("l_orderkey").alias("space_id")).agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", offer.alias("o"))).alias("x"))
    d = d.withColumn("offers", F.transform("x", lambda e: e["o"]))
    return d.select("space_id", F.lit(0).alias("world_index"), "offers", F.create_map(F.lit("card"), F.lit("O"), F.lit("kind"), F.lit("cast")).alias("observed"))


@query(
    "B16_commitment_match",
    f"""SELECT l_orderkey AS space_id, {ct("l_tax>0 AND l_returnflag='R' AND l_linestatus='O'")} AS matching, COUNT(*) AS legal FROM lineitem GROUP BY 1""",
)
def b16(t):
    return B.commitment_match(_offers(t))[0].select("space_id", "matching", "legal")


@query(
    "B17_policy_likelihood",
    f"""WITH e AS (SELECT vec_id, label, CAST(x AS DOUBLE)*3 AS x, i FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) u),
    s AS (SELECT *, exp(x)/SUM(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e) SELECT vec_id, {r6('SUM(CASE WHEN i<label THEN p ELSE 0 END)')} AS likelihood FROM s GROUP BY 1""",
)
def b17(t):
    d = t.embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("logits"),
        F.when(F.col("label") > 0, F.sequence(F.lit(0), (F.col("label") - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("matching_indexes"),
    )
    return rounded(B.policy_likelihood(d).select("vec_id", "likelihood"))
