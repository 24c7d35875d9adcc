"""URL filters: rules first, then link-graph propagation for the rest.

Pages that no rule fits are judged by their host. Trust is a personalised
PageRank over the links between hosts, restarted at hosts with allowed pages;
distrust is one over the reversed links, restarted at hosts with blocked pages
(who links to bad hosts is suspect). A host is blocked if distrust, weighed by
the number of blocked pages, outweighs trust beyond a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_broadcast, settle, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Scores have settled when none moves by more than this share of itself, so a host just reached has not.
TOLERANCE = 1e-8
#: Far beyond what any graph of hosts needs (its longest shortest path and about 113 rounds); to go on is an error.
MOST_ROUNDS = 10_000
THRESHOLD = 0.5
#: Scores this close to the threshold, by rounding or what is below the tolerance, count as at it and allow.
TIE = 1e-6
#: Hosts whose scores are broadcast, to links and to pages; with more, the joins shuffle.
BROADCAST_HOSTS = 50_000
#: Parts into which the links of a hub are dealt where scores are shuffled.
SALTS = 32

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one or for null."""
    part = [F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return ascii_lower(part[0]), part[1]


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain of it) and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """(src, dst, w): absolute links between different hosts, counted."""
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: from (host, seed) and (src, dst, w) to (host, score) for all hosts.

    Seeds are scaled to sum to 1; hosts without links out send their score
    back to the seeds. Stops when no score moves by more than ``tolerance`` of
    itself, and fails if that does not come; ``rounds``, if given, stops it
    after so many whatever the scores do.
    """
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    mass = seeds.agg(F.sum("seed")).first()[0]
    if not mass:
        return nodes.select("host", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    flow = settle(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("w")))
    start = nodes.join(seeds, "host", "left").join(out.select(F.col("src").alias("host"), F.lit(True).alias("sends")), "host", "left")
    state = settle(start.select("host", (F.coalesce("seed", F.lit(0.0)) / mass).alias("seed"), F.col("sends").isNotNull().alias("sends")).withColumn("score", F.col("seed")))
    if not flow.limit(1).count():
        return state.select("host", "score")
    small = state.count() <= BROADCAST_HOSTS
    if not small:
        flow = settle(flow.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS))))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))

    def sent(state: DataFrame) -> DataFrame:
        scores = state.select(F.col("host").alias("src"), "score")
        return flow.join(F.broadcast(scores), "src") if small else flow.join(scores.withColumn("salt", salts), ["src", "salt"])

    unsent = F.sum(F.when(~F.col("sends"), F.col("score")))
    lost = state.agg(unsent).first()[0] or 0.0
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        got = sent(state).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        score = F.col("seed") * (1 - damping + damping * lost) + damping * F.coalesce("got", F.lit(0.0))
        new = settle(state.join(got, "host", "left").select("host", "seed", "sends", F.col("score").alias("old"), score.alias("score")))
        lost, moving = new.agg(unsent, F.max(F.abs(F.col("score") - F.col("old")) > tolerance * F.col("score"))).first()
        lost, state = lost or 0.0, new.drop("old")
        if not moving:
            return state.select("host", "score")
    if rounds is None:
        raise RuntimeError("the scores did not settle")
    return state.select("host", "score")


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = (), rules=RULES, threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """For each page: host, path, rule, verdict, and its host's trust and distrust; ``keep`` names columns to pass on.

    A null url, or one without ``://``, has an empty host, which no rule fits
    and the graph does not hold; such pages and hosts that neither score
    reaches are allowed. Null html has no links. Repeated rows are kept (and
    count as pages of their host).
    """
    host, path = host_and_path(F.col(url_col))
    passed = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    read = pages.select(host.alias("host"), path.alias("path"), *passed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = read.withColumn("rule", rule).withColumn("ruled", verdict)
    seeds = settle(ruled.where("rule is not null").groupBy("host").agg(*[F.sum(F.when(F.col("ruled") == v, 1.0).otherwise(0.0)).alias(v) for v in ("allow", "block")]))
    edges = settle(host_links(pages, host, html_col))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    a, b = (seeds.agg(F.sum(v)).first()[0] or 0.0 for v in ("allow", "block"))
    trust = propagate(seeds.where("allow > 0").select("host", F.col("allow").alias("seed")), edges, rounds=rounds).select("host", (F.col("score") * a).alias("trust"))
    distrust = propagate(seeds.where("block > 0").select("host", F.col("block").alias("seed")), back, rounds=rounds).select("host", (F.col("score") * b).alias("distrust"))
    zero = F.lit(0.0)
    scores = settle(trust.join(distrust, "host", "full").select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")))
    scores = bounded_broadcast(scores, scores.count(), BROADCAST_HOSTS)
    bad = F.col("distrust") > (threshold + TIE) * (F.col("trust") + F.col("distrust"))
    judged = ruled.join(scores, "host", "left").withColumn("verdict", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")))
    return judged.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "host", "path", "rule", "verdict")


def _cases() -> tuple[str, str]:
    """The rules in SQL, longest first: which fits, and its verdict."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in ordered)
    return fits, " ".join(f"WHEN rule = '{h}{p}' THEN '{kind}'" for kind, h, p in ordered)


#: The same propagation as a recursive query over fixed rounds.
_SQL = r"""
WITH RECURSIVE
low AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {RULE_CASE} END AS rule FROM low),
said AS (SELECT *, CASE {VERDICT_CASE} END AS ruled_as FROM ruled),
seeds AS (SELECT host, count(*) FILTER (WHERE ruled_as = 'allow')::DOUBLE AS allow, count(*) FILTER (WHERE ruled_as = 'block')::DOUBLE AS block FROM said WHERE rule IS NOT NULL GROUP BY host),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM low),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT 'allow' AS side, src, dst, w FROM edges UNION ALL SELECT 'block', dst, src, w FROM edges),
flow AS (SELECT side, src, dst, w / sum(w) OVER (PARTITION BY side, src) AS w FROM both_ways),
start AS (SELECT 'allow' AS side, host, allow AS n FROM seeds WHERE allow > 0 UNION ALL SELECT 'block', host, block FROM seeds WHERE block > 0),
nodes AS (SELECT DISTINCT side, host FROM (SELECT side, src AS host FROM flow UNION ALL SELECT side, dst FROM flow UNION ALL SELECT side, host FROM start)),
init AS (SELECT nodes.side, nodes.host, coalesce(n, 0) / sum(n) OVER (PARTITION BY nodes.side) AS seed, EXISTS (SELECT 1 FROM flow WHERE flow.side = nodes.side AND flow.src = nodes.host) AS sends
  FROM nodes LEFT JOIN start ON start.side = nodes.side AND start.host = nodes.host),
rounds(i, state) AS (
  SELECT 0, (SELECT map_from_entries(list((side || ' ' || host, seed))) FROM init)
  UNION ALL
  SELECT i + 1, (SELECT map_from_entries(list((n.side || ' ' || n.host, n.seed * (0.15 + 0.85 * coalesce((SELECT sum(state[d.side || ' ' || d.host]) FROM init d WHERE d.side = n.side AND NOT d.sends), 0))
    + 0.85 * coalesce((SELECT sum(f.w * state[f.side || ' ' || f.src]) FROM flow f WHERE f.side = n.side AND f.dst = n.host), 0)))) FROM init n)
  FROM rounds WHERE i < 200 AND EXISTS (SELECT 1 FROM flow)),
final AS (SELECT arg_max(state, i) AS state FROM rounds),
scores AS (SELECT host, sum(CASE WHEN side = 'allow' THEN v ELSE 0 END) AS trust, sum(CASE WHEN side = 'block' THEN v ELSE 0 END) AS distrust
  FROM (SELECT side, host, state[side || ' ' || host] * (SELECT sum(n) FROM start WHERE start.side = init.side) AS v FROM init, final) AS x GROUP BY host)
SELECT page_id, said.host, path, rule, coalesce(ruled_as, CASE WHEN distrust > 0.500001 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM said LEFT JOIN scores ON scores.host = said.host
"""
ORACLE_SQL = _SQL.replace("{RULE_CASE}", _cases()[0]).replace("{VERDICT_CASE}", _cases()[1])
