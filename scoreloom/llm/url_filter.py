"""URL verdicts: declared rules, and trust spread over the links between hosts for what no rule covers.

Trust starts at hosts that an allow rule covers whole and follows links; distrust starts at hosts that a block rule covers
and follows links backwards, to those that point there. Both are personalised PageRank over the weighted host
graph, computed in Spark. A host is blocked if its distrust share reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.joins import attach_row
from scoreloom.llm.tables import written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
# Ranks have settled when their changes in a round add up to less than this part of a seed's share. Changes shrink by the damping at
# least, so that this takes some 205 rounds at most for a million seeds; ROUNDS only ends what rounding errors keep moving. It is looked at
# every LOOK rounds.
TOLERANCE = 1e-8
ROUNDS = 300
LOOK = 5
# Distrust / (trust + distrust) from which a host is blocked.
BLOCK_SHARE = 0.5
# Rounds that the SQL below is written for; it is the same as long as there are no links between hosts.
_SQL_ROUNDS = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _suffixes(host: Column) -> Column:
    """The host and every domain it lies in."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matching_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct (host, path): adds ``rule`` and ``rule_verdict``, null where none fits.

    A rule's host fits itself and its subdomains; its path fits paths that start with it. Rules are met by equality:
    the suffixes of a host, and path prefixes of the lengths that occur in rules of that suffix. Of equal
    rules with different verdicts, block counts.
    """
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host is not null and path is not null")
    lengths = known.select(F.col("host").alias("suffix"), F.length("path").alias("size")).distinct()
    met = (
        places.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix")).join(lengths, "suffix")
        .where(F.length("path") >= F.col("size"))
        .withColumn("prefix", F.expr("substr(path, 1, size)"))
        .join(known.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict"), ["suffix", "prefix"])
        .withColumn("rule", F.concat("suffix", "prefix"))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
    )
    return places.join(met, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts in ``pages`` (url, html). Relative links stay on their host."""
    links = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))
    target = F.col("link")
    return (
        pages.select(url_host(F.col("url").cast("string")).alias("src"), F.explode(links).alias("link"))
        .select("src", url_host(F.when(target.startswith("//"), F.concat(F.lit("x:"), target)).otherwise(target)).alias("dst"))
        .where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    )


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, rank) of personalised PageRank in several graphs at once.

    ``edges``: kind, src, dst, links; ``seeds``: kind, host. A kind's rank starts evenly at its seeds; each round a host
    passes ``damping`` of its rank along its links in proportion to their number, and the seeds share the rest, with what
    hosts without links hold, until every kind has settled (``TOLERANCE``), ``rounds`` at most. A kind without seeds has no rank.
    Each round is written to the shared folder.
    """
    seeds = seeds.distinct()
    total = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    start = written(seeds.join(total, "kind").select("kind", "host", (1.0 / F.col("n")).alias("seed")))
    weight = edges.groupBy("kind", "src").agg(F.sum("links").alias("all"))
    flow = written(edges.join(weight, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all")).alias("part")))
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    if flow.isEmpty():
        return rank  # without links every round gives the seeds back
    for k in range(rounds):
        last = rank
        passed = (
            rank.withColumnRenamed("host", "src").join(flow, ["kind", "src"])
            .groupBy("kind", "dst").agg((F.sum(F.col("rank") * F.col("part")) * damping).alias("came")).withColumnRenamed("dst", "host")
        )
        passed = written(passed)
        rest = start.select("kind").distinct().join(passed.groupBy("kind").agg(F.sum("came").alias("moved")), "kind", "left")
        back = start.join(rest, "kind").select("kind", "host", (F.col("seed") * (1.0 - F.coalesce("moved", F.lit(0.0)))).alias("came"))
        rank = written(passed.unionByName(back).groupBy("kind", "host").agg(F.sum("came").alias("rank")))
        if (k + 1) % LOOK == 0:
            moved = rank.unionByName(last.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("by"))
            unsettled = moved.groupBy("kind").agg(F.sum("by").alias("by")).join(total, "kind").where(F.col("by") * F.col("n") >= TOLERANCE)
            if unsettled.isEmpty():
                break
    return rank


def host_verdicts(hosts: DataFrame, edges: DataFrame, rules: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
                  block_share: float = BLOCK_SHARE) -> DataFrame:
    """(host, trust, distrust, method_verdict) of every host with any rank; all other hosts are allowed.

    Trusted seeds are hosts that an allow rule with path ``/`` (or none) covers; distrusted ones are those with a block rule
    on themselves or on a domain that they lie in.
    """
    covered = (
        hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        .join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict"), "suffix")
    )
    seeds = covered.select(
        F.when((F.col("verdict") == "allow") & F.coalesce("rule_path", F.lit("")).isin("", "/"), "trust").when(F.col("verdict") == "block", "distrust").alias("kind"), "host",
    ).where("kind is not null")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links", F.lit("distrust").alias("kind")))
    rank = personalised_rank(both, seeds, damping, rounds)
    side = rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= block_share * (F.col("trust") + F.col("distrust")))
    return side.withColumn("method_verdict", F.when(blocked, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Returns page_id, host, path, rule (null if none fits), verdict (the rule's, else the method's: block or allow), trust and
    distrust of the host (0 if it has none). A null url or one without ``://`` has an empty host and path, fits no rule and is
    allowed. Null pages have no links. Repeated rows each get a row; their links count as often as they stand there.
    """
    urls = written(pages.select(
        F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path")))
    edges = written(host_edges(pages))
    hosts = urls.select("host").union(edges.select("src")).union(edges.select("dst")).where("host != ''").distinct()
    ruled = written(matching_rule(urls.select("host", "path").distinct(), rules))
    by_host = written(host_verdicts(hosts, edges, rules, **options))
    return (
        urls.join(ruled, ["host", "path"], "left").join(by_host, "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "method_verdict", F.lit("allow")).alias("verdict"),
                F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )


def _rounds_sql(rounds: int) -> str:
    parts = []
    for k in range(rounds):
        parts.append(f"""
p{k} AS MATERIALIZED (SELECT kind, dst AS host, sum(rank * part) * 0.85 AS came FROM r{k} JOIN flow ON flow.kind = r{k}.kind AND flow.src = r{k}.host GROUP BY ALL),
m{k} AS (SELECT kind, sum(came) AS moved FROM p{k} GROUP BY kind),
r{k + 1} AS MATERIALIZED (
    SELECT kind, host, sum(came) AS rank FROM (
        SELECT kind, host, came FROM p{k} UNION ALL SELECT s.kind, s.host, s.seed * (1.0 - coalesce(m.moved, 0)) FROM start s LEFT JOIN m{k} m ON m.kind = s.kind)
    GROUP BY kind, host)""".replace("SELECT kind, dst", "SELECT flow.kind, dst"))
    return ",".join(parts)


ORACLE = r"""
WITH u AS (
    SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS link FROM u),
e AS (
    SELECT src, translate(regexp_extract(CASE WHEN link LIKE '//%' THEN 'x:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM l),
edge AS (SELECT src, dst, count(*) AS links FROM e WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, links FROM edge UNION ALL SELECT 'distrust', dst, src, links FROM edge),
flow AS MATERIALIZED (SELECT kind, src, dst, links::DOUBLE / sum(links) OVER (PARTITION BY kind, src) AS part FROM both_ways),
hosts AS (SELECT host FROM u WHERE host <> '' UNION SELECT src FROM edge UNION SELECT dst FROM edge),
seeds AS (
    SELECT DISTINCT CASE WHEN verdict = 'block' THEN 'distrust' ELSE 'trust' END AS kind, h.host FROM hosts h
    JOIN rules r ON h.host = r.host OR h.host LIKE '%.' || r.host WHERE verdict = 'block' OR path = '/'),
start AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM seeds),
r0 AS (SELECT kind, host, seed AS rank FROM start),""" + _rounds_sql(_SQL_ROUNDS) + r""",
side AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS distrust FROM r""" + str(_SQL_ROUNDS) + r""" GROUP BY host),
fit AS (
    SELECT page_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS k
    FROM u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN distrust >= 1e-12 AND distrust >= 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::DOUBLE AS trust, coalesce(distrust, 0)::DOUBLE AS distrust
FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.k = 1 LEFT JOIN side ON side.host = u.host
"""
