"""URL filtering with link-graph propagation, as DataFrame operations.

*Rules* ``(host suffix, path prefix, verdict)`` judge a url where one fits; the longest fits best. *Graph*: an edge from
the page's host to the host of every absolute link in its html, and, weaker, between a host and the next
shorter domain that has pages (a subdomain and its parent answer for each other). Edges are counted per pair of hosts
before anything is shuffled, so a host with a third of all pages is one row per target.

*Trust* is personalised PageRank: mass starts at hosts by their share of pages that rules allow and flows along links.
*Distrust* starts at hosts by their blocked pages and flows against the links: who links to blocked hosts is suspect. A host
is blocked where distrust exceeds ``threshold`` times trust. Mass is counted in whole numbers (``UNIT`` in all), so sums do not
depend on their order and every engine gets the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

UNIT = 10 ** 15
#: of 100: mass that follows edges, the rest returns to the seeds
FOLLOW = 85
ROUNDS = 12
#: checkpoints keep plans short
CUT_EVERY = 4
LINK, KIN = 4, 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: then up to ``? #`` or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits: its host or a subdomain, its path a prefix; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` between different hosts of ``pages(host, html)``; links to unknown hosts are left out."""
    hosts = pages.where("host <> ''").select("host").distinct()
    urls = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^\s\"'<>]+)"), F.lit(1))
    target = host_and_path(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))[0]
    links = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(urls).alias("url")).select("src", target.alias("dst"))
             .where("src <> dst").groupBy("src", "dst").agg((F.count("*") * LINK).alias("weight")))
    links = links.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    # every shorter domain of a host; the longest that has pages is its parent
    bits = F.split("host", r"\.")
    shorter = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(bits)), lambda i: F.array_join(F.slice(bits, i + 1, F.size(bits)), "."))).alias("cut", "parent"))
    kin = (shorter.where("parent <> ''").join(hosts.withColumnRenamed("host", "parent"), "parent", "left_semi")
           .groupBy("host").agg(F.min_by("parent", "cut").alias("parent")))
    kin = kin.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(kin.select("parent", "host")).select("src", "dst", F.lit(KIN).cast("long").alias("weight"))
    return links.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(host, mass)``: personalised PageRank of ``seeds(host, weight)`` over ``edges(src, dst, weight)``, in whole units.

    A host without edges keeps its seed's share; what integer division loses is at most a unit per edge and round.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1
    start = cut_lineage(seeds.where("weight > 0").select("host", F.expr(f"cast(cast(weight as decimal(20,0)) * {UNIT} div {total} as bigint)").alias("seed")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = cut_lineage(edges.join(out, "src"))
    mass = start.select("host", F.col("seed").alias("mass"))
    for i in range(rounds):
        moved = (shares.join(mass.withColumnRenamed("host", "src"), "src")
                 .select(F.col("dst").alias("host"), F.expr(f"cast(cast(mass as decimal(20,0)) * {FOLLOW} * weight div (100 * all) as bigint)").alias("mass")))
        back = start.select("host", F.expr(f"seed * {100 - FOLLOW} div 100").alias("mass"))
        mass = moved.union(back).groupBy("host").agg(F.sum("mass").alias("mass"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            mass = cut_lineage(mass)
    return mass


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: int = 1) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages(page_id, url, html, ...)``.

    The verdict is the rule's, else ``block`` where the host's distrust exceeds ``threshold`` times its trust, else
    ``allow``. A null url or one without ``://`` has an empty host and path, fits no rule, and is allowed. Repeated rows
    each count as a page; of rules of equal length the last in sorted order stands.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "html", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seeds = cut_lineage(rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    edges = cut_lineage(host_edges(rows.select("host", "html")))
    trust = propagate(edges, seeds.select("host", F.col("good").alias("weight"))).withColumnRenamed("mass", "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(against, seeds.select("host", F.col("bad").alias("weight"))).withColumnRenamed("mass", "distrust")
    # both masses sum to one unit whatever the seeds' sizes, so they are compared per seed page
    good, bad = (n or 0 for n in seeds.agg(F.sum("good"), F.sum("bad")).first())
    standing = cut_lineage(seeds.select("host").join(trust, "host", "left").join(distrust, "host", "left").select(
        "host", F.expr(f"coalesce(cast(cast(trust as decimal(20,0)) * {good} div 1000 as bigint), 0L)").alias("trust"),
        F.expr(f"coalesce(cast(cast(distrust as decimal(20,0)) * {bad} div 1000 as bigint), 0L)").alias("distrust")))
    out = rows.drop("html").join(standing, "host", "left")
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * threshold, F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0).cast("long")).alias("trust"), F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"))
