"""Operator 4: URL rules, then link-graph propagation over hosts, in DataFrame operations only.

Pages that a rule fits take its verdict. For the others their host decides:
personalised PageRank spreads trust from trusted seed hosts along links, and
distrust from blocked seed hosts against them (who links to bad hosts is
suspect). Seeds are hosts of whose pages over half are allowed, or blocked,
by rules. A host is blocked if its distrust exceeds both its trust and
``threshold`` times the mean distrust that a host would have.

Mass is counted in whole units, so sums don't depend on their order and every
run gives the same verdicts. Both kinds of mass are scaled to one total, so
they can be held against each other. Each round is a join and a sum over host edges,
kept as a table in the shared folder; pages are aggregated to host edges
before any join, so a hot host is one row for each host it links to.

Defined results: null urls and urls without ``://`` have empty host and path,
fit no rule, take part in no edge and are allowed; null html has no links;
repeated rows are judged alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Units of mass that all seeds of a kind share.
MASS = 1 << 50
_HREF = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
_SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, lower-cased, and the path up to query or fragment."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``source, target, weight``: pages of one host that link to another, by absolute links."""
    host, _ = host_and_path(F.col("url"))
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1)), _ascii_lower))
    linked = pages.select(host.alias("source"), links.alias("links")).where((F.col("source") != "") & (F.size("links") > 0))
    edges = linked.select("source", F.explode("links").alias("target")).where("source <> target")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.02) -> DataFrame:
    """``kind, host, mass``: personalised PageRank for each kind of seed, of ``MASS`` in all a kind.

    ``edges``: kind, source, target, weight. ``seeds``: kind, host. Each kind's
    seeds share ``MASS`` equally. Rounds go on until no more than ``tolerance``
    of the mass still moves. Mass at hosts without links ends there; scaling
    each kind to ``MASS`` at the end then scores as if it returned to the seeds.
    """
    total = written(edges.groupBy("kind", "source").agg(F.sum("weight").alias("all")), "totals")  # a table, so a hub's edges can be split
    shares = edges.join(total, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("weight") / F.col("all") * damping).alias("share"))
    shares = written(shares, "edges")
    counts = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    moving = written(seeds.join(F.broadcast(counts), "kind").select("kind", "host", F.floor(F.lit(MASS) / F.col("n")).alias("mass")), "mass")  # a count for each of two kinds
    tables, began = [moving], None
    while True:
        moves = moving.agg(F.sum("mass").alias("n")).first().n or 0
        began = moves if began is None else began
        if moves <= tolerance * began:
            break
        moved = moving.join(shares, ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.floor(F.col("mass") * F.col("share"))).alias("mass"))
        moving = written(moved.where("mass > 0"), "mass")
        tables.append(moving)
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    scored = every.groupBy("kind", "host").agg(F.sum("mass").alias("own"))
    whole = scored.groupBy("kind").agg(F.sum("own").alias("whole"))
    return scored.join(F.broadcast(whole), "kind").select("kind", "host", F.floor(F.col("own") / F.col("whole") * MASS).alias("mass"))  # a sum for each of two kinds


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 0.02) -> DataFrame:
    """``host, trust, distrust, share``: both masses, and the mean mass of a host."""
    host, path = host_and_path(F.col("url"))
    ruled = pages.select(host.alias("host"), rule_for(host, path, rules)[1].alias("ruled")).where("host <> ''")
    by_host = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    by_host = written(by_host, "hosts")
    edges = written(host_edges(pages), "links")
    forward = edges.select(F.lit("trust").alias("kind"), "source", "target", "weight")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    seeds = by_host.where("2 * allowed > n").select(F.lit("trust").alias("kind"), "host").unionByName(by_host.where("2 * blocked > n").select(F.lit("distrust").alias("kind"), "host"))
    scores = propagate(forward.unionByName(back), seeds, damping, tolerance)
    wide = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")])
    hosts = by_host.count()  # one number
    return wide.withColumn("share", F.lit(MASS // max(1, hosts)).cast("long"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 0.02) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): host, path, rule, verdict, by_graph."""
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_for(host, path, rules)
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("ruled"))
    scores = host_scores(pages, rules, damping, tolerance)
    suspect = scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.col("share") * threshold)).select("host")
    # a hot host's pages are dealt over several tasks: its one row is repeated for each salt
    salted = suspect.select("host", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")).withColumn("suspect", F.lit(True))
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALTS)).cast("int"))
    joined = judged.join(salted, ["host", "salt"], "left")
    by_graph = F.col("ruled").isNull() & F.coalesce("suspect", F.lit(False))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(by_graph, "block").otherwise("allow")).alias("verdict"), by_graph.alias("by_graph"))
