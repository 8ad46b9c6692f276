"""URL filter by rules and by link-graph propagation.

A page's url is judged by the longest rule that fits its host and path. The other urls are judged by their host:
trust spreads from hosts with allowed urls along links (personalised PageRank), distrust spreads from hosts with
blocked urls against the links (PageRank on the reversed graph), and a host is blocked if its distrust is above its
trust. Host edges come from the absolute and scheme-less links in the pages; a host and its parent domain are linked
both ways.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule fits it; hosts that
neither score reaches are allowed; links of null html are none; repeated pages count as often as they stand there; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.storage import stored

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = None
    for name, start, verdict in ordered:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        answer = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, answer) if found is None else found.when(fits, answer)
    return found


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted before they are shuffled."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""), F.lit(1))
    out = pages.select(F.col(host).alias("src"), F.explode(links).alias("url")).select(
        "src", F.translate(F.regexp_extract("url", r"//(.*)$", 1), UPPER, LOWER).alias("dst")
    )
    counted = out.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(
        F.count("*").cast("double").alias("weight")
    )
    names = pages.select(F.col(host).alias("src")).where("src <> ''").distinct()
    parents = names.select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst")).where("dst <> ''")
    both = parents.unionByName(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return counted.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(
        F.sum("weight").alias("weight")
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut_every: int = 4) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps of both walks.

    ``seeds`` has (host, kind, mass); kind t walks along the edges, kind d against them. Each kind's mass is shared to
    sum to 1. Both walks run in one join per step; mass of hosts without out-links returns to nobody.
    """
    directed = edges.select(F.lit("t").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    totals = directed.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = stored(
        directed.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")),
        "host-edges",
    )
    sums = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = stored(
        seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass")), "host-seeds"
    )  # at most two rows are broadcast
    rank = start
    for i in range(rounds):
        moved = rank.join(steps, (rank["kind"] == steps["kind"]) & (rank["host"] == steps["src"])).select(
            rank["kind"], F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass")
        )
        back = start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
        rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if (i + 1) % cut_every == 0 or i == rounds - 1:
            rank = stored(rank, "host-rank")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    ratio: float = 1.0,
) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust of every url; blocked beyond ``ratio`` times the trust."""
    read = pages.select(
        F.col(key), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("found.verdict") == "allow", "t").otherwise("d")
    seeds = read.where("found IS NOT NULL").groupBy("host", kind.alias("kind")).agg(F.count("*").cast("double").alias("mass"))
    scores = propagate(host_edges(read), seeds)
    judged = read.drop("html").join(scores, "host", "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * ratio, "block").otherwise("allow")
    return judged.select(
        key,
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
