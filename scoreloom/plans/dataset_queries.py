"""Registered queries for data-set construction and the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import canonical as K
from scoreloom.functions import exprs as E
from scoreloom.operators import datasets as D
from scoreloom.operators import measurements as M
from scoreloom.plans.measurement_queries import DATA, EMB, dataset, samples
from scoreloom.plans.registry import query
from scoreloom.plans.sqltext import ct, r6
from scoreloom.sources import io as S


def rounded(df, digits=6):
    return df.withColumns({c: E.r6(c, digits) for c, d in df.dtypes if d == "double"})


_HASH = "CAST('0x' || substring(sha256('7:' || CAST(o_custkey AS VARCHAR)), 1, 13) AS BIGINT)"


@query(
    "X01_split_by_game",
    f"""WITH g AS (SELECT DISTINCT o_custkey, {_HASH} AS h FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY h, o_custkey) AS rn, COUNT(*) OVER () AS n FROM g)
    SELECT o_orderkey, o.o_custkey AS game_index, rn <= greatest(1, round_even(n*0.1, 0)) AS is_validation FROM orders o JOIN r ON r.o_custkey=o.o_custkey""",
)
def x01(t):
    return D.split_by_game(t.orders.select("o_orderkey", F.col("o_custkey").alias("game_index")), 0.1, 7)


_Q = {"train": 40, "validation": 12, "test": 8}


@query(
    "X02_split_pairs",
    """WITH r AS (SELECT p_type AS family, CAST(p_partkey AS VARCHAR) AS pair_id, row_number() OVER (PARTITION BY p_type ORDER BY sha256('suite-1' || CAST(p_partkey AS VARCHAR))) AS rn FROM part)
    SELECT family, pair_id, CASE WHEN rn<=40 THEN 'train' WHEN rn<=52 THEN 'validation' ELSE 'test' END AS split FROM r WHERE rn<=60""",
)
def x02(t):
    p = t.part.select(F.col("p_type").alias("family"), F.col("p_partkey").cast("string").alias("pair_id"))
    return D.split_pairs(p, "suite-1", _Q)[0]


@query("X02_split_pairs_violations", "SELECT 'family_size' AS rule, p_type AS key, CAST(COUNT(*) AS VARCHAR) AS detail FROM part GROUP BY p_type HAVING COUNT(*)<>60")
def x02b(t):
    p = t.part.select(F.col("p_type").alias("family"), F.col("p_partkey").cast("string").alias("pair_id"))
    return D.split_pairs(p, "suite-1", _Q)[1]


@query("X03_fresh_rows", "SELECT event_id, k AS round FROM v_events WHERE k=(SELECT MAX(k) FROM v_events)")
def x03(t):
    return D.fresh_rows(t.v_events.select("event_id", F.col("k").alias("round")))


@query(
    "S05_offset_games",
    """WITH m AS (SELECT k, MAX(user_id)+1 AS n FROM v_events GROUP BY 1), o AS (SELECT k, CAST(COALESCE(SUM(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS off FROM m)
    SELECT event_id, e.k AS round, user_id+off AS game_index FROM v_events e JOIN o ON o.k=e.k""",
)
def s05(t):
    return D.offset_games(t.v_events.select("event_id", F.col("k").alias("round"), F.col("user_id").alias("game_index")))


def slots(t, target):
    """Array of doubles as (vec_id, slot, target) rows."""
    return rounded(dataset(t).select("vec_id", F.posexplode(target).alias("slot", "target")))


@query(
    "X04_soft_targets",
    f"""WITH {DATA}, s AS (SELECT *, MAX(CASE WHEN x>0 THEN x END) OVER (PARTITION BY vec_id) AS mx FROM ds),
    q AS (SELECT *, CASE WHEN x>0 THEN exp((x-mx)/0.25) ELSE 0 END AS r FROM s), z AS (SELECT *, r/SUM(r) OVER (PARTITION BY vec_id) AS t FROM q)
    SELECT vec_id, i AS slot, {r6('t')} AS target FROM z""",
)
def x04(t):
    return slots(t, M.soft_targets("scores", 0.25))


@query("X05_visit_targets", f"WITH {DATA} SELECT vec_id, i AS slot, {r6('p')} AS target FROM ds")
def x05(t):
    return slots(t, D.visit_targets())


@query("X06_one_hot", f"WITH {DATA} SELECT vec_id, i AS slot, CASE WHEN i=action THEN 1.0 ELSE 0.0 END AS target FROM ds")
def x06(t):
    return slots(t, D.one_hot("action", 64))


_VT = """vt AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN 0 ELSE 1 END AS INT) AS winner,
  CAST(l_linenumber % 2 AS INT) AS seat, CASE WHEN l_tax=0.08 THEN CAST('NaN' AS DOUBLE) ELSE l_discount*10 END AS root_value FROM lineitem)"""


def _vt(t):
    return t.sql(f"WITH {_VT} SELECT * FROM vt")


_OUTCOME = "CASE WHEN winner IS NULL THEN 0.0 WHEN winner=seat THEN 1.0 ELSE 0.0 END"
_ROOT = "CASE WHEN isnan(root_value) THEN 0.0 ELSE root_value END"
for _kind, _t, _u in (
    ("terminal_outcome", _OUTCOME, "winner IS NOT NULL"),
    ("root_value", _ROOT, "NOT isnan(root_value)"),
    ("blend", f"0.5*({_OUTCOME})+0.5*({_ROOT})", "winner IS NOT NULL AND NOT isnan(root_value)"),
):

    def _make(kind, tgt, use):
        @query(
            f"X07_value_targets_{kind}",
            f"WITH {_VT} SELECT l_orderkey, l_partkey, l_suppkey, {r6(tgt)} AS value_target, {use} AS value_usable FROM vt",
        )
        def x07(t):
            return rounded(D.value_targets(_vt(t), kind).select("l_orderkey", "l_partkey", "l_suppkey", "value_target", "value_usable"))

    _make(_kind, _t, _u)


@query(
    "X08_dataset_violations",
    f"""WITH {DATA}, r AS (SELECT vec_id, bool_or(i=action AND x>0) AS legal, SUM(CASE WHEN x>0 THEN 1 ELSE 0 END) AS nv FROM ds GROUP BY 1)
    SELECT 'action_not_legal' AS rule, CAST(vec_id AS VARCHAR) AS key, '' AS detail FROM r WHERE NOT legal
    UNION ALL SELECT 'num_valid_mismatch', CAST(vec_id AS VARCHAR), '' FROM r WHERE nv<>32""",
)
def x08(t):
    return D.dataset_violations(dataset(t).withColumn("num_valid", F.lit(32)), ["vec_id"])


def _conditional(t):
    d = dataset(t)
    cond = F.transform(
        F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int")),
        lambda i: F.struct(i.alias("index"), (1.0 / (F.col("vec_id") % 3 + 1)).alias("weight"), F.transform("scores", lambda s: F.abs(s * (i + 1) - 0.1)).alias("scores")),
    )
    return d.withColumn("condition", cond).withColumn("decision_id", F.col("vec_id"))


@query(
    "X09_expand_conditions",
    f"""WITH {DATA}, c AS (SELECT ds.*, g.k, CASE WHEN x>0 THEN abs(x*(g.k+1)-0.1) ELSE -1.0 END AS s FROM ds, range(3) g(k) WHERE g.k <= vec_id % 3),
    mm AS (SELECT *, MAX(s) OVER (PARTITION BY vec_id, k) AS ms FROM c)
    SELECT vec_id, k AS condition_index, {r6('1.0/(vec_id % 3 + 1)')} AS condition_weight, {r6('SUM(s)')} AS score_sum, MIN(CASE WHEN s=ms THEN i END) AS action
    FROM mm GROUP BY vec_id, k""",
)
def x09(t):
    out, _ = D.expand_conditions(_conditional(t))
    return rounded(out.select("vec_id", "condition_index", "condition_weight", E.array_sum("scores").alias("score_sum"), "action"))


def _conds(t):
    return dataset(t).select(
        F.col("round").alias("root"), F.col("vec_id").alias("condition_index"), F.size(F.filter("scores", lambda s: s > 0.05)).cast("double").alias("condition_mass"),
        F.transform("scores", lambda s: s * 20 - 1).alias("q_values"), "actions_valid", "root_value",
    )


@query(
    "X10_condition_rows",
    f"""WITH {DATA}, c AS (SELECT vec_id, ANY_VALUE(label) AS root, CAST(SUM(CASE WHEN x>0.05 THEN 1 ELSE 0 END) AS DOUBLE) AS mass,
      SUM(CASE WHEN x>0 THEN greatest(least(x*20-1,1.0),0.0) ELSE -1.0 END) AS ss, MAX(x) AS rv FROM ds GROUP BY 1)
    SELECT root, vec_id AS condition_index, {r6('mass/SUM(mass) OVER (PARTITION BY root)')} AS condition_weight, {r6('ss')} AS score_sum, {r6('rv')} AS condition_root_value FROM c""",
)
def x10(t):
    out, _ = D.condition_rows(_conds(t), ["root"])
    return rounded(out.select("root", "condition_index", "condition_weight", E.array_sum("condition_scores").alias("score_sum"), F.col("condition_root_value").cast("double").alias("condition_root_value")))


@query("X11_neutral_condition", "SELECT l_orderkey, l_partkey, 0 AS condition_index, 1.0 AS condition_weight FROM lineitem")
def x11(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("condition_index"), F.col("l_tax").alias("condition_weight"))
    return D.neutral_condition(d)


@query(
    "X12_uniform_conditions",
    f"""WITH {DATA} SELECT vec_id, k AS condition_index, 0.2 AS condition_weight, {r6('SUM(CASE WHEN x>0 THEN x ELSE -1.0 END)')} AS score_sum FROM ds, range(5) g(k) GROUP BY 1, 2""",
)
def x12(t):
    d = D.uniform_conditions(dataset(t), 5).select("vec_id", F.explode("condition").alias("c"))
    return rounded(d.select("vec_id", F.col("c.index").cast("int").alias("condition_index"), F.col("c.weight").alias("condition_weight"), E.array_sum("c.scores").alias("score_sum")))


def _manifest(t):
    """Customers as shards with their orders as games."""
    per = t.orders.groupBy(F.col("o_custkey").cast("int").alias("shard_index")).agg(F.count(F.lit(1)).alias("num_games"), F.sum("o_orderkey").alias("decisions"))
    path = F.concat(F.lit("shard_"), F.col("shard_index").cast("string"))
    m = per.select(
        "shard_index", path.alias("path"), F.sha2(path, 256).alias("sha256"), "num_games", "decisions", (F.col("shard_index") * 10).alias("game_offset"),
        F.when(F.col("num_games") == 3, "other").otherwise("run").alias("run_fingerprint"),
    )
    files = t.customer.select(
        F.concat(F.lit("shard_"), F.expr("CASE WHEN c_nationkey <> 7 THEN c_custkey ELSE -c_custkey END").cast("string")).alias("path"), F.col("c_nationkey").cast("bigint").alias("bytes"),
        F.when(F.col("c_acctbal") < 0, "x").otherwise(F.sha2(F.concat(F.lit("shard_"), F.col("c_custkey").cast("string")), 256)).alias("sha256"),
    )
    return m, files


def _last(t):
    """The prefix asked for is all of it: one more than the largest index."""
    return t.orders.agg(F.max("o_custkey")).first()[0] + 1


_MF = """mf AS (SELECT o_custkey AS idx, COUNT(*) AS g, CAST(SUM(o_orderkey) AS BIGINT) AS d FROM orders GROUP BY 1),
  fl AS (SELECT CASE WHEN c_nationkey<>7 THEN c_custkey ELSE -c_custkey END AS idx, c_nationkey AS b, c_acctbal<0 AS broken FROM customer)"""


@query(
    "X13_freeze_prefix_totals",
    f"WITH {_MF} SELECT COUNT(*) AS shards, CAST(SUM(g) AS BIGINT) AS games, CAST(SUM(d) AS BIGINT) AS decisions, CAST(SUM(b) AS BIGINT) AS bytes FROM mf LEFT JOIN fl ON fl.idx=mf.idx",
)
def x13(t):
    return D.freeze_prefix(*_manifest(t), _last(t), "run")[1]


@query(
    "X13_freeze_prefix_violations",
    f"""WITH {_MF} SELECT 'missing_index' AS rule, CAST(r.i AS VARCHAR) AS key, '' AS detail FROM range((SELECT MAX(o_custkey) + 1 FROM orders)) r(i) ANTI JOIN mf ON mf.idx=r.i
    UNION ALL SELECT 'missing_file', CAST(mf.idx AS VARCHAR), 'shard_' || CAST(mf.idx AS VARCHAR) FROM mf ANTI JOIN fl ON fl.idx=mf.idx 
    UNION ALL SELECT 'digest_mismatch', CAST(mf.idx AS VARCHAR), 'shard_' || CAST(mf.idx AS VARCHAR) FROM mf JOIN fl ON fl.idx=mf.idx WHERE broken
    UNION ALL SELECT 'provenance_mismatch', CAST(mf.idx AS VARCHAR), 'shard_' || CAST(mf.idx AS VARCHAR) FROM mf WHERE g=3""",
)
def x13b(t):
    return D.freeze_prefix(*_manifest(t), _last(t), "run")[2]


@query(
    "X14_verify_snapshot",
    """WITH m AS (SELECT DISTINCT o_custkey AS idx FROM orders), f AS (SELECT CASE WHEN c_nationkey<>7 THEN c_custkey ELSE -c_custkey END AS idx, c_acctbal<0 AS broken FROM customer)
    SELECT CASE WHEN f.idx IS NULL THEN 'missing' WHEN m.idx IS NULL THEN 'extra' ELSE 'changed' END AS rule, 'shard_' || CAST(COALESCE(m.idx,f.idx) AS VARCHAR) AS key, '' AS detail
    FROM m FULL JOIN f ON f.idx=m.idx WHERE f.idx IS NULL OR m.idx IS NULL OR broken""",
)
def x14(t):
    m, f = _manifest(t)
    return D.verify_snapshot(m.join(f.select("path", "bytes"), "path", "left").select("path", "bytes", "sha256"), f)


def _resume(t):
    name = lambda c, s: F.concat(F.lit("s"), c.cast("string"), F.lit(s))
    ck = F.col("c_custkey")
    chunks = t.customer.filter("c_nationkey < 20").select(ck.cast("int").alias("shard_index"), name(ck, ".npz").alias("shard_name"), name(ck, ".json").alias("summary_name"),
                                                           F.lit(10).cast("bigint").alias("num_games"), F.lit("run").alias("run_fingerprint"))
    per = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m"))
    shard = per.select(name(F.col("c"), ".npz").alias("name"), F.lit("h").alias("sha256"))
    summ = per.filter("n > 5").select(name(F.col("c"), ".json").alias("name"), F.lit("j").alias("sha256"))
    summaries = per.filter("n > 5").select(F.col("c").cast("int").alias("shard_index"), F.col("n").alias("num_games"), F.col("m").alias("decisions"),
                                            F.lit("run").alias("run_fingerprint"), F.lit("h").alias("sha256"))
    return chunks, shard.unionByName(summ), summaries


_RES = """ch AS (SELECT c_custkey AS c FROM customer WHERE c_nationkey<20), pe AS (SELECT o_custkey AS c, COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders GROUP BY 1),
  rj AS (SELECT ch.c, n, m, CASE WHEN n>5 THEN 'completed' WHEN n IS NOT NULL THEN 'broken' ELSE 'pending' END AS state FROM ch LEFT JOIN pe ON pe.c=ch.c)"""


@query(
    "X15_resume_plan",
    f"WITH {_RES} SELECT c AS shard_index, state, 10 AS num_games, CASE WHEN n>5 THEN m END AS decisions FROM rj",
)
def x15(t):
    return D.resume_plan(*_resume(t))[0]


@query(
    "X15_resume_progress",
    f"""WITH {_RES} SELECT CAST(COALESCE(SUM(CASE WHEN n>5 THEN m END),0) AS BIGINT) AS decisions_completed, {ct('n>5')}*10 AS games_completed, {ct('n>5')} AS shards_completed, COUNT(*) AS shards_total FROM rj""",
)
def x15b(t):
    return D.resume_plan(*_resume(t))[1]


@query(
    "X15_resume_violations",
    f"""WITH {_RES} SELECT 'half_written_pair' AS rule, 's' || CAST(c AS VARCHAR) || '.npz' AS key, '' AS detail FROM rj WHERE state='broken'
    UNION ALL SELECT 'num_games_mismatch', 's' || CAST(c AS VARCHAR) || '.npz', '' FROM rj WHERE n>5 AND n<>10
    UNION ALL SELECT 'unexpected_file', 's' || CAST(pe.c AS VARCHAR) || '.npz', '' FROM pe ANTI JOIN ch ON ch.c=pe.c
    UNION ALL SELECT 'unexpected_file', 's' || CAST(pe.c AS VARCHAR) || '.json', '' FROM pe ANTI JOIN ch ON ch.c=pe.c WHERE pe.n>5""",
)
def x15c(t):
    return D.resume_plan(*_resume(t))[2]


@query(
    "X16_sample_states",
    f"""WITH l AS (SELECT l_orderkey, COUNT(*) AS n, SUM(CASE WHEN l_returnflag='R' THEN greatest(l_partkey-1000,0)+l_suppkey ELSE 0 END) AS own,
      SUM(CASE WHEN l_returnflag='A' THEN greatest(l_partkey-1000,0)+l_suppkey ELSE 0 END) AS oth, bool_or(l_linestatus='O') AS hi, bool_or(l_returnflag='N') AS hn FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CAST(o_orderkey % 2 AS INT) AS seat, n AS num_valid, CAST(own-oth AS DOUBLE) AS board_adv, CAST(o_custkey-100 AS DOUBLE) AS life_adv,
    CASE WHEN hi THEN 1.0 ELSE 0.0 END AS holding_interaction, CASE WHEN hn THEN 1.0 ELSE 0.0 END AS holding_instant, CAST(n AS DOUBLE) AS turn,
    CASE WHEN o_orderstatus='P' THEN 0.5 WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END AS won
    FROM orders JOIN l ON l_orderkey=o_orderkey WHERE n>1 AND CAST('0x' || substring(sha256('11:' || CAST(o_orderkey AS VARCHAR)),1,13) AS BIGINT)/4503599627370496.0 < 0.25""",
)
def x16(t):
    perm = F.struct((F.col("l_partkey") - 1000).alias("power"), F.col("l_suppkey").alias("toughness"))
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("num_valid"), F.collect_list(F.when(F.col("l_returnflag") == "R", perm)).alias("own_permanents"),
        F.collect_list(F.when(F.col("l_returnflag") == "A", perm)).alias("other_permanents"),
        F.array_union(F.collect_set("l_linestatus"), F.collect_set("l_returnflag")).alias("hand"),
    )
    d = t.orders.join(li, "o_orderkey").withColumns(
        {
            "seat": (F.col("o_orderkey") % 2).cast("int"), "own_life": F.col("o_custkey"), "other_life": F.lit(100), "turn": F.col("num_valid"),
            "winner": F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2).when(F.col("o_orderstatus") == "O", 1 - F.col("o_orderkey") % 2),
        }
    )
    return D.sample_states(d, 0.25, 11, ["o_orderkey"], ["O"], ["N"])


@query(
    "X17_ragged_batch",
    """WITH s AS (SELECT o_orderpriority AS batch, o_orderkey, COUNT(l_orderkey) AS size FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1, 2)
    SELECT batch, o_orderkey, size, CAST(SUM(size) OVER w AS BIGINT) AS end_offset, CAST(SUM(size) OVER w - size AS BIGINT) AS start_offset FROM s
    WINDOW w AS (PARTITION BY batch ORDER BY o_orderkey)""",
)
def x17(t):
    d = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    d = d.select(F.col("o_orderpriority").alias("batch"), "o_orderkey", "items")
    return D.ragged_batch(d, ["batch"], "o_orderkey", "items").drop("items")


# ------------------------------------------------------------------ digests and helpers


@query(
    "F01_decision_id",
    """SELECT event_id, sha256('decision:v1:' || '{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}') AS decision_id FROM events""",
)
def f01(t):
    return K.decision_id(t.events, ["user_id", "event_type", "event_id"], "decision:v1:").select("event_id", "decision_id")


@query(
    "F02_canonical_sha256",
    """SELECT o_orderkey, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders""",
)
def f02(t):
    return K.canonical_sha256(t.orders, ["o_orderstatus", "o_custkey", "o_orderpriority"]).select("o_orderkey", "digest")


@query(
    "F02_nullable",
    """SELECT o_orderkey, sha256('{"large":' || CAST(o_orderkey + 9007199254740992 AS VARCHAR) || ',"maybe":'
      || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END || '}') AS digest FROM orders""",
)
def f02_nullable(t):
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") + 9007199254740992).alias("large"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("maybe"))
    return K.canonical_sha256(o, ["large", "maybe"]).select("o_orderkey", "digest")


@query(
    "F04_divergences",
    f"""WITH {EMB}, m AS (SELECT vec_id, -SUM(CASE WHEN p>0 THEN p*ln(p) ELSE 0 END) AS ent, SUM(CASE WHEN p>0 THEN p*ln(p/prior) ELSE 0 END) AS kl,
      SUM((CASE WHEN p>0 THEN p*ln(p/((p+prior)/2)) ELSE 0 END + CASE WHEN prior>0 THEN prior*ln(prior/((p+prior)/2)) ELSE 0 END)/2) AS js FROM d GROUP BY 1)
    SELECT vec_id, {r6('ent')} AS entropy, {r6('kl')} AS kl, {r6('js')} AS js FROM m""",
)
def f04(t):
    s = samples(t).withColumn("p", E.normalised("visit_counts"))
    return rounded(s.select("vec_id", E.entropy("p").alias("entropy"), E.kl_divergence("p", "input_prior").alias("kl"), E.js_divergence("p", "input_prior").alias("js")))


@query("F05_teacher_action", f"WITH {EMB}, r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY floor(abs(x)*20) DESC, x DESC, i) AS rn FROM d) SELECT vec_id, i AS action FROM r WHERE rn=1")
def f05(t):
    s = t.embeddings.select("vec_id", M.teacher_action(F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20)), F.col("embedding")).alias("action"))
    return s


# ------------------------------------------------------------------ sources and sinks


@query("S01_read_matches", "SELECT player_a, player_b, deal_block, leg, score_a FROM v_matches")
def s01(t):
    path = S.scratch_folder(t.spark, "matches")
    t.v_matches.write.json(path, compression="gzip")
    return S.read_matches(t.spark, path).select("player_a", "player_b", "deal_block", "leg", "score_a")


@query(
    "S02_S03_traces_round_trip",
    "SELECT CAST(l_orderkey AS VARCHAR) AS match_id, l_partkey AS revision, COUNT(*) AS n FROM lineitem GROUP BY 1, 2",
)
def s02(t):
    games = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("match_id")).agg(
        F.collect_list(F.struct(F.col("l_partkey").alias("revision"), F.col("l_linenumber").alias("actor"), F.col("l_tax").alias("latency_seconds"))).alias("decisions")
    )
    path = S.scratch_folder(t.spark, "traces")
    S.write_traces(games, path)
    return S.read_traces(t.spark, path).groupBy("match_id", "revision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S04_load_shards",
    """SELECT l_returnflag AS shard, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 9 END AS round, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1""",
)
def s04(t):
    root = S.scratch_folder(t.spark, "shards")
    d = t.lineitem.select("l_returnflag", F.col("l_orderkey").alias("game_index"), F.col("l_partkey").alias("action"), F.col("l_tax").alias("root_value"))
    paths = []
    for flag in ("A", "N", "R"):
        part = d.filter(F.col("l_returnflag") == flag).drop("l_returnflag")
        (part.drop("root_value") if flag == "N" else part).write.parquet(f"{root}/{flag}.parquet")
        paths.append(f"{root}/{flag}.parquet")
    out = S.load_shards(t.spark, paths, [2, 5, 9])
    if "root_value" in out.columns:
        raise AssertionError("an optional column missing in one shard must be dropped")
    return out.groupBy("shard", "round").agg(F.count(F.lit(1)).alias("n"), F.sum("action").alias("s"))


@query(
    "S06_conditional_violations",
    """WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal<0 AS a, c_nationkey=1 AS b, c_mktsegment='BUILDING' AS c FROM customer)
    SELECT 'schema_digest' AS rule, key, '' AS detail FROM p WHERE a UNION ALL SELECT 'policy_target_kind', key, '' FROM p WHERE b UNION ALL SELECT 'value_target_kind', key, '' FROM p WHERE c""",
)
def s06(t):
    p = t.customer.select(
        F.col("c_custkey").alias("shard"), F.when(F.col("c_acctbal") >= 0, "pin").alias("condition_schema_digest"),
        F.when(F.col("c_nationkey") == 1, "other").otherwise("score_softmax").alias("policy_target_kind"),
        F.when(F.col("c_mktsegment") == "BUILDING", "other").otherwise("terminal_outcome").alias("value_target_kind"),
    )
    return S.conditional_violations(p, "pin")


@query(
    "S07_trace_summaries",
    """SELECT COUNT(*) AS traces, CAST(SUM(n) AS BIGINT) AS events, MIN(d) AS first_timestamp, MAX(d) AS last_timestamp FROM (
    SELECT c_nationkey, COUNT(*) AS n, CAST(MAX(c_custkey) AS VARCHAR) AS d FROM customer GROUP BY 1) z""",
)
def s07(t):
    docs = t.customer.groupBy("c_nationkey").agg(
        F.max("c_custkey").cast("string").alias("timestamp"), F.collect_list(F.struct(F.col("c_name").alias("actor"))).alias("events")
    )
    path = S.scratch_folder(t.spark, "play")
    # One document per file, as play traces are stored.
    docs.repartition("c_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return S.trace_summaries(t.spark, path).agg(
        F.count(F.lit(1)).alias("traces"), F.sum("num_events").alias("events"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")
    )


def _store(t):
    """A store written from the events: users are runs, events evaluations."""
    root = S.scratch_folder(t.spark, "store")
    ev = t.v_events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.col("k").alias("step"), F.col("event_type").alias("kind"), F.col("value").alias("win_rate"))
    cs = t.v_events.select(F.col("user_id").alias("run_id"), F.col("k").alias("evaluation_id"), F.lit("all").alias("scope"), F.col("event_type").alias("choice_set")).groupBy(
        "run_id", "evaluation_id", "scope", "choice_set").agg(F.count(F.lit(1)).alias("count"))
    S.append_evaluation(ev, cs, None, root)
    return root


@query("S08_store_round_trip", f"SELECT user_id AS run_id, COUNT(*) AS evaluations, {r6('AVG(value)')} AS win_rate FROM events GROUP BY 1")
def s08(t):
    e = S.read_store(t.spark, _store(t), "evaluations")
    return rounded(e.groupBy("run_id").agg(F.count(F.lit(1)).alias("evaluations"), F.avg("win_rate").alias("win_rate")))


@query(
    "S09_latest_run_status",
    """SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, arg_max(CAST(k AS VARCHAR), event_id) FILTER (k % 3 = 0) AS notes FROM v_events GROUP BY 1""",
)
def s09(t):
    ev = t.v_events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).alias("notes"), F.col("event_id").alias("seq"))
    return S.latest_run_status(ev)


@query("S10_get_evaluations", "SELECT event_id AS id, k AS step, event_type AS kind FROM v_events WHERE user_id=7")
def s10(t):
    e = t.v_events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.col("k").alias("step"), F.col("event_type").alias("kind"))
    return S.get_evaluations(e, 7).drop("run_id")


@query(
    "S10_get_choice_sets",
    "SELECT k AS evaluation_id, event_type AS scope, COUNT(DISTINCT user_id) AS choice_sets, CAST(COUNT(*) AS DOUBLE) AS total FROM v_events GROUP BY 1, 2",
)
def s10b(t):
    cs = t.v_events.groupBy(F.col("k").alias("evaluation_id"), F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("choice_set")).agg(F.count(F.lit(1)).alias("count"))
    m = S.get_choice_sets(cs)
    return m.select("evaluation_id", "scope", F.size("counts").cast("bigint").alias("choice_sets"), E.array_sum(F.map_values("counts")).alias("total"))


@query("S10_get_actions", "SELECT event_id AS id, k AS game_index, event_type AS action_type FROM v_events WHERE user_id=7")
def s10c(t):
    a = t.v_events.select(F.col("user_id").alias("evaluation_id"), F.col("k").alias("game_index"), F.col("k").alias("step"), F.col("event_id").alias("id"), F.col("event_type").alias("action_type"))
    return S.get_actions(a, 7).select("id", "game_index", "action_type")


@query("S10_get_reports", "SELECT event_id AS id, event_type AS report_kind FROM v_events WHERE user_id=7")
def s10d(t):
    r = t.v_events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.col("event_type").alias("report_kind"))
    return S.get_reports(r, 7).drop("run_id")


@query("S10_get_run_configs", "SELECT c_custkey AS run_id, CAST(c_nationkey AS INT) AS seed, c_mktsegment AS label FROM customer WHERE c_custkey=7")
def s10e(t):
    text = F.concat(F.lit('{"seed":'), F.col("c_nationkey").cast("string"), F.lit(',"n":{"label":"'), F.col("c_mktsegment"), F.lit('"}}'))
    c = t.customer.select(F.col("c_custkey").alias("run_id"), *[text.alias(f"{f}_json") for f in S.RUN_CONFIG_FIELDS])
    return S.get_run_configs(c, 7, {"train": "seed int, n struct<label:string>"}).select("run_id", "train.seed", "train.n.label")


@query("S11_parse_spans", f"SELECT event_id, {r6('value')} AS total_time, k AS count FROM v_events WHERE event_type<>'error'")
def s11(t):
    stat = F.when(F.col("event_type") == "error", "total=broken, count=x").otherwise(F.format_string("total=%.2fs, count=%d", "value", "k"))
    return rounded(S.parse_spans(t.v_events.select("event_id", stat.alias("stat"))).drop("stat"))


@query("S11_parse_span_baseline", f"SELECT event_id, event_type AS path, {r6('value')} AS total_time, k AS count FROM v_events WHERE k>=10")
def s11b(t):
    line = F.when(F.col("k") < 5, F.lit("")).when(F.col("k") < 10, F.concat_ws("\t", "event_type", F.lit("nan?"))).otherwise(
        F.concat_ws("\t", "event_type", F.format_string("%.2f", "value"), F.col("k").cast("string")))
    return rounded(S.parse_span_baseline(t.v_events.select("event_id", line.alias("value"))))


@query("S12_file_receipts")
def s12(t):
    return S.file_receipts(t.spark, t.sf_dir, "*.parquet")


@query(
    "S12_receipts_of_written_files",
    """SELECT doc_id // 50 AS part, SUM(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text)) AS sha256
    FROM documents GROUP BY 1""",
)
def s12_written(t):
    """The documents as text files of fifty, written by Spark and read back by their bytes, a few at a time."""
    root = S.scratch_folder(t.spark, "receipts")
    lines = t.documents.select(F.coalesce("text", F.lit("")).alias("value"), F.expr("doc_id div 50").alias("part"), "doc_id", "text")
    lines.repartition("part").sortWithinPartitions("part", "doc_id", "text").select("value", "part").write.partitionBy("part").text(root)
    found = S.file_receipts(t.spark, root, "part-*", chunk=1 << 16)
    return found.select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint").alias("part"), "bytes", "sha256")


@query("S08_repeated_append", f"SELECT user_id AS run_id, event_id AS id, {r6('value')} AS win_rate FROM events")
def s08_repeated(t):
    """Every evaluation appended twice, half of them with another value: the first copy of each stays."""
    root = S.scratch_folder(t.spark, "store")
    ev = t.v_events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.col("value").alias("win_rate"))
    S.append_table(ev, root, "evaluations")
    S.append_table(ev.withColumn("win_rate", F.when(F.col("id") % 2 == 0, F.col("win_rate") + 1).otherwise(F.col("win_rate"))), root, "evaluations")
    return rounded(S.read_store(t.spark, root, "evaluations").select("run_id", "id", "win_rate"))


_EVR = """er AS (SELECT user_id AS run_id, event_id AS id, k AS step, CASE event_type WHEN 'click' THEN 'baseline' WHEN 'view' THEN 'final' ELSE 'checkpoint' END AS kind, value/1000 AS win_rate, k/128.0E0 AS cast_when_able FROM v_events)"""


@query(
    "S13_report_rows",
    f"""WITH {_EVR}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, id) AS rn FROM er WHERE kind='baseline') z WHERE rn=1),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, id DESC) AS rn FROM er WHERE kind='final') z WHERE rn=1),
    j AS (SELECT f.run_id, m.metric, m.label, CASE m.metric WHEN 'win_rate' THEN b.win_rate ELSE b.cast_when_able END AS bv, CASE m.metric WHEN 'win_rate' THEN f.win_rate ELSE f.cast_when_able END AS fv
      FROM f JOIN b ON b.run_id=f.run_id, (VALUES ('win_rate','Win rate'),('cast_when_able','Cast when able')) m(metric,label))
    SELECT run_id, metric, label, {r6('bv')} AS baseline, {r6('fv')} AS final, {r6('fv-bv')} AS delta FROM j""",
)
def s13(t):
    out = S.report_rows(t.sql(f"WITH {_EVR} SELECT * FROM er"), {"win_rate": "Win rate", "cast_when_able": "Cast when able"})
    return rounded(out.drop("baseline_text", "final_text", "delta_text"))


@query(
    "S14_flatten_config",
    """SELECT c_custkey AS run_id, 'train/seed' AS path, CAST(c_nationkey AS VARCHAR) AS value FROM customer
    UNION ALL SELECT c_custkey, 'train/opt/name', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'label', c_name FROM customer""",
)
def s14(t):
    doc = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("seed"), F.struct(F.col("c_mktsegment").alias("name")).alias("opt")).alias("train"), F.col("c_name").alias("label")))
    return S.flatten_config(t.customer.select(F.col("c_custkey").alias("run_id"), doc.alias("document")))
