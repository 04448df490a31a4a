"""Operator 4: URL verdicts from rules and from trust propagated over host links.

Base: the longest matching (host, path) rule decides. Where no rule fits, the method
decides. The rules are its only seeds: a host is a trusted seed by the share of its pages that
allow rules fit and a blocked seed by the share that block rules fit; one without pages
of its own by a rule for all of its paths. Personalised PageRank carries trust along links from
the trusted seeds and distrust against them from the blocked ones. Both are divided by
their seeds' sum, so many seeds of one kind don't outweigh few of the other. A host is blocked when
its distrust exceeds its trust and half of what a wholly blocked host without links has.

Ranks are whole numbers (billionths), so sums don't depend on the order in which Spark adds
them. Links are counted per (host, host) before anything is joined, so an iteration moves
host edges, not pages; nothing is collected. Every few iterations ranks are checkpointed, and
iterations end when none of them changes any more, or after ``iterations``.

Null or malformed urls have empty host and path; no rule fits them and they are allowed.
Repeated rows are judged each on its own, extra columns are ignored, links within a host
carry nothing. Pages without links simply spread nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulae.llm.common import ensure_checkpoints

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
ONE = 1_000_000_000
ITERATIONS = 32


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule; of two of the same length the first in code-point order."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = pages.select(
        host_of(pages["url"]).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(pages["html"], F.lit("")), F.lit("(?i)href\\s*=\\s*[\"']?((?:https?:)?//[^\"'\\s>]+)"), F.lit(1))).alias("link"),
    )
    links = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, keep: float = 0.85, every: int = 4) -> DataFrame:
    """(host, trust, distrust) for seeds (kind, host, rank): kind 0 walks along links and
    kind 1 against them, in one join a step. Mass at hosts without an outgoing step is
    dropped; seeds get theirs again each step."""
    ensure_checkpoints(seeds.sparkSession)
    steps = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    steps = steps.unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    total = steps.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    steps = steps.join(total, ["kind", "host"]).checkpoint()
    seeds = seeds.checkpoint()
    ranks = seeds
    given = seeds.select("kind", "host", F.floor(F.col("rank").cast("double") * F.lit(100 - round(keep * 100)) / 100).cast("long").alias("rank"))
    before = None
    for k in range(iterations):
        moved = ranks.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.floor(F.col("rank").cast("double") * F.lit(round(keep * 100)) * F.col("n") / (100 * F.col("total"))).cast("long").alias("rank"))
        ranks = moved.unionByName(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (k + 1) % every == 0:
            # whole numbers: once a fixed point is reached, further steps change nothing
            ranks = ranks.checkpoint()
            now = tuple(ranks.agg(F.count("*"), F.sum(F.xxhash64("kind", "host", "rank").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("rank")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("rank")).otherwise(0)).alias("distrust"))


def seed_ranks(rows: DataFrame, edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(kind, host, rank) of the seeds: ``ONE`` times the share of a host's pages that rules of
    the kind fit; for linked hosts without pages all or nothing. ``rows`` has host and decided."""
    own = rows.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("b"))
    named = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().join(own, "host", "left_anti")
    whole = rule_of(F.col("host"), F.lit("/"), rules)
    verdict = F.lit(None).cast("string")
    for rule, v in rules:
        verdict = F.when(whole == rule, F.lit(v)).otherwise(verdict)
    linked = named.select("host", F.lit(1).cast("long").alias("n"), F.when(verdict == "allow", 1).otherwise(0).cast("long").alias("a"), F.when(verdict == "block", 1).otherwise(0).cast("long").alias("b"))
    hosts = own.unionByName(linked)
    share = lambda kind, c: hosts.filter(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", F.floor(F.col(c).cast("double") * ONE / F.col("n")).cast("long").alias("rank"))
    return share(0, "a").unionByName(share(1, "b"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, iterations: int = ITERATIONS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rules = RULES if rules is None else rules
    rows = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for rule, verdict in rules:
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    rows = rows.withColumn("decided", decided)
    ensure_checkpoints(pages.sparkSession)
    edges = host_edges(pages).checkpoint()
    seeds = seed_ranks(rows, edges, rules).checkpoint()
    sums = seeds.agg(F.sum(F.when(F.col("kind") == 0, F.col("rank"))).alias("trust_sum"), F.sum(F.when(F.col("kind") == 1, F.col("rank"))).alias("distrust_sum"))
    ranks = propagate(seeds, edges, iterations).crossJoin(F.broadcast(sums))  # one row
    per_seed = F.col("distrust").cast("double") / F.coalesce("distrust_sum", F.lit(1)) > F.col("trust").cast("double") / F.coalesce("trust_sum", F.lit(1))
    ranks = ranks.select("host", "trust", "distrust", (per_seed & (F.col("distrust") >= F.lit(threshold * 0.15 * ONE))).alias("blocked"))
    # ``host`` is the hot key: ranks are one row a host, so AQE may broadcast or split the join
    out = rows.join(ranks, "host", "left")
    verdict = F.coalesce("decided", F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
