"""Registered queries for reliability tables and prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.operators import calibration as C
from scoreloom.plans.measurement_queries import DATA, dataset
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


def flt(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def bin_case(p: str, limits, last="closed") -> str:
    parts = []
    for i, (a, b) in enumerate(limits):
        end = i == len(limits) - 1
        if end and last == "closed":
            cond = f"{p} >= {flt(a)} AND {p} <= {flt(b)}"
        elif end:
            cond = f"(({p} >= {flt(a)} AND {p} < {flt(b)}) OR {p} = 1.0)"
        else:
            cond = f"{p} >= {flt(a)} AND {p} < {flt(b)}"
        parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def summary_sql(rows: str, keys: list[str], limits=None, last="closed") -> str:
    """``rows`` yields keys, p, y."""
    limits = limits or C.bin_edges(10)
    ks = ", ".join(keys)
    q = "greatest(least(p, 1-1e-7), 1e-7)"
    return f"""WITH src AS ({rows}), b AS (SELECT *, {bin_case('p', limits, last)} AS bin FROM src),
    per AS (SELECT {ks}, bin, COUNT(*) AS n, SUM(p) AS sp, SUM(y) AS sy, SUM((p-y)*(p-y)) AS sq,
      SUM(-(y*ln({q})+(1-y)*ln(1-{q}))) AS sb FROM b GROUP BY {ks}, bin)
    SELECT {ks}, CAST(SUM(n) AS BIGINT) AS count, {r6('SUM(sp)/SUM(n)')} AS mean_prediction, {r6('SUM(sy)/SUM(n)')} AS mean_target,
    {r6('SUM(sq)/SUM(n)')} AS brier, {r6('SUM(sb)/SUM(n)')} AS binary_cross_entropy,
    {r6('SUM(CASE WHEN bin IS NOT NULL THEN abs(sp-sy) ELSE 0 END)/SUM(n)')} AS expected_calibration_error,
    CASE WHEN SUM(n) >= 10 THEN 'sufficient' ELSE 'insufficient_n' END AS status FROM per GROUP BY {ks}"""


def bins_sql(rows: str, keys: list[str], limits, last="closed") -> str:
    ks = ", ".join(keys)
    vals = ", ".join(f"({i}, {flt(a)}, {flt(b)})" for i, (a, b) in enumerate(limits))
    on = " AND ".join(f"g.{k}=per.{k}" for k in keys)
    return f"""WITH src AS ({rows}), b AS (SELECT *, {bin_case('p', limits, last)} AS bin FROM src),
    per AS (SELECT {ks}, bin, COUNT(*) AS n, AVG(p) AS mp, AVG(y) AS my FROM b GROUP BY {ks}, bin),
    g AS (SELECT DISTINCT {ks} FROM src), e AS (SELECT * FROM (VALUES {vals}) v(bin, lower, upper))
    SELECT {', '.join('g.' + k for k in keys)}, e.bin, {r6('e.lower')} AS lower, {r6('e.upper')} AS upper, COALESCE(n, 0) AS count,
    {r6('mp')} AS mean_prediction, {r6('my')} AS mean_target FROM g CROSS JOIN e LEFT JOIN per ON {on} AND per.bin=e.bin"""


_ROWS = "SELECT source, phase, p, y FROM v_pred"


@query("C01_reliability_summary", summary_sql(_ROWS, ["source", "phase"]))
def c01(t):
    return rounded(C.reliability(t.v_pred, "p", "y", ["source", "phase"])[0])


@query("C01_reliability_bins", bins_sql(_ROWS, ["source"], C.bin_edges(10)))
def c01b(t):
    return rounded(C.reliability(t.v_pred, "p", "y", ["source"])[1])


@query("C01_reliability_accumulated_edges", bins_sql(_ROWS, ["source"], C.bin_edges(10, "accumulated")))
def c01c(t):
    return rounded(C.reliability(t.v_pred, "p", "y", ["source"], edges="accumulated")[1])


@query("C01_reliability_five_bins", summary_sql(_ROWS, ["phase"], C.bin_edges(5), "one"))
def c01d(t):
    return rounded(C.reliability(t.v_pred, "p", "y", ["phase"], bins=5, last="one")[0])


_LABEL = """SELECT d.lang, CASE WHEN d.n_chars > 10000 THEN 1.0 ELSE d.n_chars/10000.0 END AS p, CAST(l.quality AS DOUBLE) AS y
  FROM documents d JOIN labels l ON l.doc_id=d.doc_id"""


@query("C01_reliability_labels", summary_sql(_LABEL, ["lang"]))
def c01e(t):
    return rounded(C.reliability(t.sql(_LABEL), "p", "y", ["lang"])[0])


_PH = """SELECT t.source AS source, ph.phase AS phase, p, t.y AS y FROM v_pred v,
  LATERAL (SELECT 'outcome' AS source, y UNION ALL SELECT 'root', tax*10 UNION ALL SELECT 'blend', 0.5*y+0.5*tax*10) t,
  LATERAL (SELECT 'overall' AS phase UNION ALL SELECT CAST(v.phase % 5 AS VARCHAR)) ph"""


# Values lie on rounding ties at six digits.
@query("C02_calibration_by_phase", summary_sql(_PH, ["source", "phase"]).replace(", 6) + 0.0)", ", 9) + 0.0)"))
def c02(t):
    d = t.v_pred.select(
        "p", "y", (F.col("tax") * 10).alias("root"), (0.5 * F.col("y") + 0.5 * F.col("tax") * 10).alias("blend"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("phase") % 5, 1.0).otherwise(0.0)).alias("hot"),
    )
    return rounded(C.calibration_by_phase(d, "p", {"outcome": "y", "root": "root", "blend": "blend"}, "hot")[0], 9)


def _vc_rows(empty):
    return f"SELECT source, p, CASE WHEN winner IS NULL THEN {empty} WHEN winner=seat THEN 1.0E0 ELSE 0.0E0 END AS y FROM v_pred" + (
        " WHERE winner IS NOT NULL" if empty == "NULL" else ""
    )


for _rule, _empty in (("excluded", "NULL"), ("half", "0.5E0"), ("loss", "0.0E0")):

    def _make(rule, empty):
        @query(f"C03_value_calibration_{rule}", summary_sql(_vc_rows(empty), ["source"]))
        def c03(t):
            return rounded(C.value_calibration(t.v_pred.withColumnRenamed("p", "root_value"), rule, ["source"])[0])

    _make(_rule, _empty)


# Belief points: one per order; its lines are the cards.
_BP = """bp AS (SELECT o_orderkey AS pt, o_orderpriority AS viewer, o_totalprice/100000 AS log_loss, o_totalprice/500000 AS top_mass,
  CASE WHEN o_orderstatus='P' THEN NULL ELSE o_custkey % 100 END AS rank, o_totalprice/1000 AS effective_size,
  CASE WHEN o_orderstatus='P' THEN NULL ELSE o_custkey END AS true_world_index FROM orders),
 bc AS (SELECT o_orderpriority AS viewer, l_returnflag || l_linestatus AS card, l_discount*10 AS p, CASE WHEN l_tax > 0.04 THEN 1.0E0 ELSE 0.0E0 END AS y
  FROM lineitem JOIN orders ON o_orderkey=l_orderkey)"""


def _points(t):
    p = t.sql(f"WITH {_BP} SELECT * FROM bp")
    cards = t.lineitem.groupBy(F.col("l_orderkey").alias("pt")).agg(
        F.collect_list(
            F.struct(
                F.concat("l_returnflag", "l_linestatus").alias("card"), (F.col("l_discount") * 10).alias("predicted"),
                (F.col("l_tax") > 0.04).alias("present"),
            )
        ).alias("cards")
    )
    return p.join(cards, "pt", "left")


_ECE = bin_case("p", C.bin_edges(10), "one")


@query(
    "C04_belief_calibration",
    f"""WITH {_BP}, a AS (SELECT viewer, COUNT(*) AS points, {r6('AVG(log_loss)')} AS mean_log_loss, {r6('AVG(top_mass)')} AS mean_top_mass,
      {r6('AVG(effective_size)')} AS mean_effective_size, {ct('true_world_index IS NULL')} AS outside_support, {r6('quantile_cont(rank,0.5)')} AS median_rank FROM bp GROUP BY 1),
    b AS (SELECT viewer, {_ECE} AS bin, COUNT(*) AS n, SUM(p) AS sp, SUM(y) AS sy, SUM((p-y)*(p-y)) AS sq FROM bc GROUP BY 1, 2),
    e AS (SELECT viewer, {r6('SUM(sq)/SUM(n)')} AS mean_per_card_brier, {r6('SUM(CASE WHEN bin IS NOT NULL THEN abs(sp-sy) ELSE 0 END)/SUM(n)')} AS per_card_ece FROM b GROUP BY 1)
    SELECT a.*, mean_per_card_brier, per_card_ece FROM a LEFT JOIN e ON e.viewer=a.viewer""",
)
def c04(t):
    return rounded(C.belief_calibration(_points(t), ["viewer"])[0])


@query(
    "C04_belief_calibration_cards",
    f"""WITH {_BP}, b AS (SELECT viewer, card, {_ECE} AS bin, COUNT(*) AS n, SUM(p) AS sp, SUM(y) AS sy, SUM((p-y)*(p-y)) AS sq FROM bc GROUP BY 1, 2, 3)
    SELECT viewer, card, CAST(SUM(n) AS BIGINT) AS points, {r6('SUM(sq)/SUM(n)')} AS brier,
    {r6('SUM(CASE WHEN bin IS NOT NULL THEN abs(sp-sy) ELSE 0 END)/SUM(n)')} AS ece, {r6('SUM(sp)/SUM(n)')} AS mean_predicted_inclusion,
    {r6('SUM(sy)/SUM(n)')} AS observed_inclusion FROM b GROUP BY 1, 2""",
)
def c04b(t):
    return rounded(C.belief_calibration(_points(t), ["viewer"])[1])


_PT = """pt AS (SELECT event_type AS viewer, event_id AS ordinal, k % 3 = 0 AS opponent_commitment, value/100 - k/50.0E0 AS improvement,
  (value+1)/(k+1) AS mass_ratio, k/50.0E0 AS posterior_log_loss, value/100 AS prior_log_loss FROM v_events)"""

_PT_AGG = f"""COUNT(*) AS points, {r6('AVG(improvement)')} AS mean_improvement, {r6('arg_max(improvement, ordinal)')} AS final_improvement,
  {r6('AVG(mass_ratio)')} AS mean_mass_ratio, {r6('AVG(CASE WHEN mass_ratio>1 THEN 1.0 ELSE 0 END)')} AS share_above_prior,
  {r6('AVG(posterior_log_loss)')} AS posterior_mean_log_loss, {r6('AVG(prior_log_loss)')} AS prior_mean_log_loss,
  {r6('quantile_cont(improvement,0.5)')} AS median_improvement, {r6('quantile_cont(mass_ratio,0.5)')} AS median_mass_ratio"""


@query("C05_paired_truth", f"WITH {_PT} SELECT {_PT_AGG} FROM pt")
def c05(t):
    return rounded(C.paired_truth(t.sql(f"WITH {_PT} SELECT * FROM pt")))


@query(
    "C06_truth_by_viewer",
    f"""WITH {_PT}, s AS (SELECT 'all' AS scope, * FROM pt UNION ALL SELECT 'commitment', * FROM pt WHERE opponent_commitment)
    SELECT viewer, scope, {_PT_AGG}, CASE WHEN scope='commitment' THEN AVG(improvement)>0 AND AVG(CASE WHEN mass_ratio>1 THEN 1.0 ELSE 0 END)>0.5 END AS prediction_passed
    FROM s GROUP BY 1, 2""",
)
def c06(t):
    return rounded(C.truth_by_viewer(t.sql(f"WITH {_PT} SELECT * FROM pt")))


_VB = """vb AS (SELECT event_type AS grp, CASE WHEN k < 40 THEN -1 WHEN k < 60 THEN 0 ELSE 1 END AS board_adv,
  CASE WHEN user_id % 2 = 0 THEN 1.0E0 ELSE 0.0E0 END AS holding_interaction, value/500 AS v, k/100.0E0 AS gt FROM v_events WHERE NOT (event_type='view' AND k BETWEEN 40 AND 59))"""


@query(
    "C07_value_buckets",
    f"""WITH {_VB}, x AS (SELECT *, CASE WHEN board_adv>0 THEN 'ahead' WHEN board_adv<0 THEN 'behind' ELSE 'even' END || '/' ||
      CASE WHEN holding_interaction>0.5 THEN 'holding' ELSE 'no-instants' END AS bucket FROM vb),
    r AS (SELECT *, rank() OVER (PARTITION BY grp, bucket ORDER BY v) + (COUNT(*) OVER (PARTITION BY grp, bucket, v)-1)/2.0 AS rx,
      rank() OVER (PARTITION BY grp, bucket ORDER BY gt) + (COUNT(*) OVER (PARTITION BY grp, bucket, gt)-1)/2.0 AS ry FROM x),
    s AS (SELECT grp, bucket, COUNT(*) AS n, {r6('AVG(v)')} AS mean_v, {r6('AVG(gt)')} AS mean_gt, {r6('AVG(v-gt)')} AS bias, {r6('AVG(abs(v-gt))')} AS mae,
      {r6('corr(rx,ry)')} AS spearman FROM r GROUP BY 1, 2),
    spine AS (SELECT g.grp, b.bucket FROM (SELECT DISTINCT grp FROM vb) g, (VALUES ('ahead/holding'),('ahead/no-instants'),('even/holding'),('even/no-instants'),('behind/holding'),('behind/no-instants')) b(bucket))
    SELECT spine.grp, spine.bucket, COALESCE(n,0) AS n, mean_v, mean_gt, bias, mae, spearman FROM spine LEFT JOIN s ON s.grp=spine.grp AND s.bucket=spine.bucket""",
)
def c07(t):
    return rounded(C.value_buckets(t.sql(f"WITH {_VB} SELECT * FROM vb"), ["grp"]))


_POL = f"""{DATA}, lg AS (SELECT *, 4*x AS logit, MAX(4*x) OVER (PARTITION BY vec_id) AS mx FROM ds),
  ls AS (SELECT *, logit - mx - ln(SUM(exp(logit-mx)) OVER (PARTITION BY vec_id)) AS lp FROM lg),
  rw AS (SELECT vec_id, ANY_VALUE(label) AS round, -SUM(p*lp) AS loss, -SUM(p*ln(greatest(p,1e-12))) AS ent,
    CASE WHEN MIN(CASE WHEN logit=mx THEN i END)=ANY_VALUE(action) THEN 1.0 ELSE 0.0 END AS hit, SUM(CASE WHEN x>0 THEN 1 ELSE 0 END) AS nv FROM ls GROUP BY vec_id)"""


@query(
    "C08_policy_metrics",
    f"""WITH {_POL} SELECT round, {r6('AVG(loss)')} AS policy_loss, {r6('greatest(0.0, AVG(loss-ent))')} AS policy_kl, {r6('AVG(hit)')} AS policy_accuracy,
    {r6('AVG(CASE WHEN nv>1 THEN hit END)')} AS policy_accuracy_nontrivial, {r6('AVG(ent)')} AS policy_target_entropy,
    {r6('AVG(1.0/greatest(nv,1))')} AS uniform_policy_probability FROM rw GROUP BY 1""",
)
def c08(t):
    d = dataset(t).join(
        t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("logits")), "vec_id"
    ).withColumn("target", E.normalised("visit_counts"))
    return rounded(C.policy_metrics(d, ["round"]))


@query(
    "C09_value_metrics",
    f"""WITH v AS (SELECT source, (p-0.5)*4 AS x, y AS t, winner IS NOT NULL AS u FROM v_pred)
    SELECT source, {r6('AVG(CASE WHEN u THEN greatest(x,0)-x*t+ln(1+exp(-abs(x))) END)')} AS value_loss,
    {r6('AVG(CASE WHEN u THEN (1/(1+exp(-x))-t)*(1/(1+exp(-x))-t) END)')} AS value_brier,
    {r6('AVG(CASE WHEN u THEN CASE WHEN (1/(1+exp(-x))>=0.5)=(t>=0.5) THEN 1.0 ELSE 0.0 END END)')} AS value_accuracy, {ct('u')} AS value_rows FROM v GROUP BY 1""",
)
def c09(t):
    d = t.v_pred.select(
        "source", ((F.col("p") - 0.5) * 4).alias("value_logit"), F.col("y").alias("value_target"), F.col("winner").isNotNull().alias("usable")
    )
    return rounded(C.value_metrics(d, ["source"]))


_CONF = bin_case("greatest(p,1-p)", [(i / 5, (i + 1) / 5) for i in range(5)])


@query(
    "C10_binary_metrics",
    f"""WITH r AS (SELECT flag, CASE WHEN (p>0.5)=(y=1) THEN 1.0 ELSE 0.0 END AS c, (p-y)*(p-y) AS b, -ln(greatest(CASE WHEN y=1 THEN p ELSE 1-p END,1e-12)) AS l,
      greatest(p,1-p) AS f, {_CONF} AS bin FROM v_pred),
    g AS (SELECT flag, bin, COUNT(*) AS n, SUM(c) AS c, SUM(b) AS b, SUM(l) AS l, SUM(f) AS f FROM r GROUP BY 1, 2)
    SELECT flag, CAST(SUM(n) AS BIGINT) AS total, {r6('SUM(c)/SUM(n)')} AS accuracy, {r6('SUM(b)/SUM(n)')} AS brier, {r6('SUM(abs(c-f))/SUM(n)')} AS ece_5_bin,
    {r6('SUM(l)/SUM(n)')} AS nll FROM g GROUP BY 1""",
)
def c10(t):
    return rounded(C.binary_metrics(t.v_pred, "p", "y", ["flag"]))


@query(
    "C11_explained_variance",
    f"""SELECT phase, {r6('1 - var_pop(y-p)/var_pop(y)')} AS explained_variance FROM v_pred GROUP BY 1""",
)
def c11(t):
    return rounded(C.explained_variance(t.v_pred, "y", "p", ["phase"]))


@query(
    "C12_pair_symmetry",
    f"""WITH g AS (SELECT flag, game_index, COUNT(*) AS n, MAX(p) AS hi, MIN(p) AS lo, COUNT(DISTINCT p>0.5) AS k FROM v_pred GROUP BY 1, 2)
    SELECT flag, {r6('MAX(hi-lo)')} AS maximum_paired_probability_difference, {ct('k>1')} AS paired_prediction_disagreements, COUNT(*) AS pairs FROM g WHERE n=2 GROUP BY 1""",
)
def c12(t):
    return rounded(C.pair_symmetry(t.v_pred, "game_index", "p", ["flag"])[0])


@query(
    "C12_pair_symmetry_violations",
    """SELECT 'incomplete_pair' AS rule, CAST(game_index AS VARCHAR) AS key, CAST(COUNT(*) AS VARCHAR) AS detail FROM v_pred GROUP BY flag, game_index HAVING COUNT(*) <> 2""",
)
def c12b(t):
    return C.pair_symmetry(t.v_pred, "game_index", "p", ["flag"])[1]
