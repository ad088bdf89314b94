"""URL rules, and link-graph trust for the hosts that no rule names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import LOWER, UPPER, checkpointed, read

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_RULES = 1000
#: Scores are integers, this being the whole trust of a seed, so that sums don't depend on their order.
ONE = 10**12
ROUNDS, DAMPING = 10, 85
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equals, the first in the alphabet) and its verdict; null if none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """Distinct (src, dst): hosts that a page's absolute links name, and a host with its parent domain both ways.

    The hosts of one site seldom link to each other by absolute urls, so the domain tree is part of the
    graph. A top-level domain is no node. Links within a host are left out.
    """
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))).alias("dst"))
    links = links.filter("src <> '' AND dst <> '' AND src <> dst").distinct()
    names = pages.select(host.alias("h")).distinct().unionByName(links.select(F.col("dst").alias("h"))).distinct()
    labels = F.split("h", r"\.")
    # a.b.c.d: (a.b.c.d, b.c.d), (b.c.d, c.d)
    steps = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(
        F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 2, F.size(labels)), ".").alias("b"))))
    tree = names.select(F.explode(steps).alias("s")).select("s.a", "s.b").distinct()
    up, down = tree.selectExpr("a AS src", "b AS dst"), tree.selectExpr("b AS src", "a AS dst")
    return links.unionByName(up).unionByName(down).filter("src <> '' AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust (long) from edges(src, dst) and seeds(host, trust, distrust).

    Trust follows the edges, distrust goes against them; each round a node passes DAMPING hundredths
    of its score in equal parts, and the seeds give the rest. A round is a join on the passing node
    and a pre-aggregated sum; the state is cut to the checkpoint folder every five rounds.
    """
    flows = edges.selectExpr("src AS frm", "dst AS to", "'t' AS kind").unionByName(edges.selectExpr("dst AS frm", "src AS to", "'d' AS kind"))
    degree = flows.groupBy("frm", "kind").agg(F.count("*").alias("deg"))
    flows = checkpointed(flows.join(degree, ["frm", "kind"]))
    given = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("seed")))).alias("s")).select("host", "s.kind", "s.seed")
    nodes = flows.selectExpr("frm AS host", "kind").unionByName(flows.selectExpr("to AS host", "kind")).unionByName(given.select("host", "kind")).distinct()
    given = checkpointed(nodes.join(given, ["host", "kind"], "left").select("host", "kind", F.coalesce("seed", F.lit(0).cast("long")).alias("seed")))
    state = given.withColumn("score", F.col("seed"))
    for k in range(rounds):
        sent = flows.join(state.select(F.col("host").alias("frm"), "kind", "score"), ["frm", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.expr("score div deg")).alias("got"))
        state = given.join(sent, ["host", "kind"], "left").selectExpr("host", "kind", "seed", f"({100 - DAMPING} * seed + {DAMPING} * coalesce(got, 0L)) div 100 AS score")
        if k % 5 == 4 and k + 1 < rounds:
            state = checkpointed(state)
    return state.groupBy("host").agg(F.sum(F.expr("if(kind = 't', score, 0L)")).alias("trust"), F.sum(F.expr("if(kind = 'd', score, 0L)")).alias("distrust"))


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, margin: int = 0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages.

    A host's seed trust is its share of pages that a rule allows, its seed distrust the share that a
    rule blocks. Where no rule fits, a host whose distrust exceeds its trust by more than margin is
    blocked, any other allowed; an unknown host (null or odd url) has 0 of both. Null html has no
    links, repeated rows get a row each, an empty table gives an empty one, other columns are ignored.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    seeds = judged.filter("host <> ''").groupBy("host").agg(
        F.expr(f"({ONE} * count_if(said = 'allow')) div count(*)").alias("trust"), F.expr(f"({ONE} * count_if(said = 'block')) div count(*)").alias("distrust"))
    scores = propagate(host_edges(p, F.col("host")), seeds)
    out = judged.join(scores, "host", "left")
    net = F.coalesce(F.col("distrust"), F.lit(0)) - F.coalesce(F.col("trust"), F.lit(0))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(net > margin, "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0).cast("long")).alias("trust"), F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = []
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits.append((f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash}{rest}') THEN", text, kind))
    rule, said = " ".join(f"{w} '{t}'" for w, t, _ in fits), " ".join(f"{w} '{k}'" for w, _, k in fits)
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    rounds = ",\n".join(
        f"""r{k + 1} AS MATERIALIZED (SELECT host, kind, seed, ({100 - DAMPING} * seed + {DAMPING} * coalesce(got, 0)::BIGINT) // 100 AS score FROM given LEFT JOIN
  (SELECT f.to AS host, f.kind, sum(score // deg)::BIGINT AS got FROM flows f JOIN r{k} s ON s.host = f.frm AND s.kind = f.kind GROUP BY ALL) USING (host, kind))""" for k in range(ROUNDS))
    return f"""
WITH p AS (SELECT page_id, html, coalesce({low.format(f"regexp_extract(url, '{URL}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} END AS said FROM p),
links AS (SELECT DISTINCT host AS src, {low.format("l")} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS l FROM p)),
names AS (SELECT host AS h FROM p UNION SELECT dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst),
steps AS (SELECT string_split(h, '.') AS s, unnest(range(0, len(string_split(h, '.')) - 2)) AS i FROM names),
tree AS (SELECT DISTINCT array_to_string(s[i + 1:], '.') AS a, array_to_string(s[i + 2:], '.') AS b FROM steps),
e AS (SELECT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst UNION SELECT a, b FROM tree UNION SELECT b, a FROM tree),
fl AS (SELECT src AS frm, dst AS "to", 't' AS kind FROM e UNION ALL SELECT dst, src, 'd' FROM e),
flows AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY frm, kind) AS deg FROM fl),
seeds AS (SELECT host, {ONE}::BIGINT * count(*) FILTER (said = 'allow') // count(*) AS t, {ONE}::BIGINT * count(*) FILTER (said = 'block') // count(*) AS d FROM j WHERE host <> '' GROUP BY host),
sd AS (SELECT host, 't' AS kind, t AS seed FROM seeds UNION ALL SELECT host, 'd', d FROM seeds),
nodes AS (SELECT frm AS host, kind FROM flows UNION SELECT "to", kind FROM flows UNION SELECT host, kind FROM sd),
given AS MATERIALIZED (SELECT host, kind, coalesce(seed, 0)::BIGINT AS seed FROM nodes LEFT JOIN sd USING (host, kind)),
r0 AS MATERIALIZED (SELECT *, seed AS score FROM given),
{rounds},
s AS (SELECT host, sum(CASE kind WHEN 't' THEN score ELSE 0 END)::BIGINT AS trust, sum(CASE kind WHEN 'd' THEN score ELSE 0 END)::BIGINT AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM j LEFT JOIN s USING (host)
"""


SQL = _sql()
