"""URL filters: rules first, then trust and distrust spread over host links.

A rule is a host and the start of a path; it fits the host and its subdomains. Of the rules that
fit a url the longest wins. Urls without a rule are judged by their host: personalised PageRank
spreads trust from hosts of allowed pages along links, and distrust spreads from hosts of blocked
pages against them (who links to a blocked host is suspect). A host is blocked where its distrust
is above `ratio` times its trust, however many hosts share it.

Edges between hosts: absolute links in the pages' html, and a host and its parent domain (the name
without its first label, down to the name below a public suffix: one label, or two where a registry's
word such as `co` or `com` stands before a country) in both directions, because a parent answers for its
subdomains. What rose from a host to its parents does not fall from them to their other subdomains:
one bad subdomain of thousands says nothing about the rest. Edges are aggregated to one row per pair of hosts before the iterations, so that hot
hosts and repeated links cost one row each; scores are rows of a table, never collected.

Cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed;
null html has no links; equal rows are kept and count again as seeds; hosts that nothing reaches
have no trust and no distrust and are allowed; an empty table gives no rows. Columns of other names
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, ROUNDS, RATIO = 0.85, 10, 1.0
#: Words under which registries give out names (fixed values): co.uk and com.au are suffixes, not parents.
REGISTRY = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Equally long: the first by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda x: (len(x[0] + x[1]), x[0] + x[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of different hosts, from host and html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.expr(r"""regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["\']?([a-z][a-z0-9+.-]*://[^"\'\\s>]+)', 1)""")
    linked = pages.select("host", html.alias("html")).where(html.contains("://")).select(F.col("host").alias("src"), F.explode(links).alias("link"))
    linked = linked.select("src", host_of(F.col("link")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    linked = linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").union(linked.select("dst")).where("host <> ''").distinct()
    up = hosts.select("host", F.split("host", r"\.").alias("x"))
    suffix = F.when((F.length(F.element_at("x", -1)) == 2) & F.try_element_at("x", F.lit(-2)).isin(*REGISTRY), 2).otherwise(1)
    up = up.withColumn("suffix", suffix).where(F.size("x") > F.col("suffix") + 1)
    up = up.select("host", F.explode(F.transform(F.sequence(F.lit(0), F.size("x") - F.col("suffix") - 2), lambda k: F.struct(F.array_join(F.slice("x", k + 1, 1000), ".").alias("src"), F.array_join(F.slice("x", k + 2, 1000), ".").alias("dst")))).alias("e"))
    up = up.select("e.src", "e.dst").distinct()
    family = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return linked.union(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, cuts: Cuts, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: (host, score) from seeds (host, seed), whose sum is 1.

    A fixed number of rounds of one join and one aggregation each. Hosts without outgoing links give
    their score back to no one. Score that rose to a parent is kept apart (`rose`): it moves on along all
    edges but those to subdomains. Every third round's scores are written, which bounds the lineage.
    """
    placed = edges.withColumns({"up": F.col("src").endswith(F.concat(F.lit("."), "dst")), "down": F.col("dst").endswith(F.concat(F.lit("."), "src"))})
    out = placed.groupBy("src").agg(F.sum("weight").alias("total"), F.sum(F.when(~F.col("down"), F.col("weight"))).alias("beside"))
    risen = F.when(F.col("down"), 0.0).otherwise(F.col("weight") / F.col("beside")).alias("risen_share")
    shares = cuts.write(placed.join(out, "src").select("src", "dst", "up", (F.col("weight") / F.col("total")).alias("share"), risen))
    scores = seeds.select("host", F.lit(False).alias("rose"), F.col("seed").alias("score"))
    for k in range(rounds):
        share = F.when(F.col("rose"), F.col("risen_share")).otherwise(F.col("share"))
        moved = shares.join(scores, shares.src == scores.host).where(share > 0).select(F.col("dst").alias("host"), F.col("up").alias("rose"), (F.col("score") * share * damping).alias("score"))
        back = seeds.select("host", F.lit(False).alias("rose"), (F.col("seed") * (1 - damping)).alias("score"))
        scores = moved.union(back).groupBy("host", "rose").agg(F.sum("score").alias("score"))
        if k % 3 == 2 or k == rounds - 1:
            scores = cuts.write(scores)
    return scores.groupBy("host").agg(F.sum("score").alias("score"))


def judge_pages(pages: DataFrame, rules: tuple = RULES, ratio: float = RATIO, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html)."""
    cuts = Cuts(pages.sparkSession, "linkgraph")
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = placed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    edges = cuts.write(host_edges(placed))
    counts = cuts.write(ruled.where("host <> '' AND found IS NOT NULL").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("allow"), F.count_if(F.col("found.verdict") == "block").alias("block")))
    total = counts.agg(F.sum("allow"), F.sum("block")).first()
    allowed = counts.where("allow > 0").select("host", (F.col("allow") / F.lit(float(total[0] or 1))).alias("seed"))
    blocked = counts.where("block > 0").select("host", (F.col("block") / F.lit(float(total[1] or 1))).alias("seed"))
    trust = spread(edges, allowed, cuts, rounds, damping)
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), blocked, cuts, rounds, damping)
    hosts = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "score"))
    hosts = hosts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    judged = ruled.drop("html").join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
