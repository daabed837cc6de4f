"""URL filter: longest-prefix rules first, then trust and distrust spread over the graph of linked hosts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.llm.common import lower_ascii
from persona_spark.scale import lookup_join
from persona_spark.session import stage_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: Share of a host's trust or distrust that goes on over its links; the rest goes back to the seeds.
DAMPING = 0.85
ITERATIONS = 12
#: The lineage of the ranks is cut after so many iterations.
STAGE_EVERY = 4
#: A host is blocked when its distrust is over its trust and over this share of an even spread over all hosts.
MIN_DISTRUST = 0.1

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ? or #, A-Z lower-cased; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
    return host & F.startswith("path", F.lit(rule.path))


def rule_of(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null for none; of two as long, the earlier."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        name = F.when(_fits(rule), F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(_fits(rule), F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their number: from, to, n. Summed on the map side, so that a host that
    everyone links to costs no more than others. Relative links stay within their host and say nothing about it."""
    return (
        pages.filter(F.col("host") != "")
        .select(F.col("host").alias("from"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
        .select("from", lower_ascii(F.col("to")).alias("to"))
        .filter(F.col("from") != F.col("to"))
        .groupBy("from", "to")
        .agg(F.count("*").alias("n"))
    )


def seeds_of(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Hosts with their seed: `block` where a rule blocks the whole host, `allow` where none does and a page of
    it falls under an allow rule, else null."""
    whole = F.lit(False)
    for rule in rules:
        if rule.verdict == "block" and rule.path in ("", "/"):
            whole = whole | (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
    allowed = F.max((F.col("_verdict") == "allow").cast("int")) == 1
    return (
        pages.filter(F.col("host") != "")
        .groupBy("host")
        .agg(allowed.alias("_allowed"))
        .select("host", F.when(whole, "block").when(F.col("_allowed"), "allow").alias("seed"))
    )


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS
) -> DataFrame:
    """Trust and distrust of every host: personalised PageRank from the allow seeds along links, and from the block
    seeds against them, both as shares of one. Rank that reaches a host without further links ends there.

    One join and one aggregate per iteration over (kind, host); sums are made on the map side, and the join of
    a host with many links is left to Spark's splitting of skewed joins. The number of iterations is fixed.
    """
    out = edges.groupBy("from").agg(F.sum("n").alias("_all"))
    back = edges.groupBy("to").agg(F.sum("n").alias("_all"))
    flows = stage_table(
        edges.join(out, "from")
        .select(F.lit("allow").alias("kind"), F.col("from").alias("host"), F.col("to"), (F.col("n") / F.col("_all")).alias("share"))
        .unionByName(
            edges.join(back, "to").select(
                F.lit("block").alias("kind"), F.col("to").alias("host"), F.col("from").alias("to"), (F.col("n") / F.col("_all")).alias("share")
            )
        ),
        "host_flows",
    )
    sizes = {r.seed: r.n for r in seeds.groupBy("seed").agg(F.count("*").alias("n")).collect()}
    source = seeds.filter("seed IS NOT NULL").select(
        F.col("seed").alias("kind"),
        "host",
        F.when(F.col("seed") == "allow", F.lit(1.0 / max(sizes.get("allow", 0), 1)))
        .otherwise(F.lit(1.0 / max(sizes.get("block", 0), 1)))
        .alias("rank"),
    )
    source = stage_table(source, "host_seeds")
    given = source.withColumn("rank", F.col("rank") * (1 - damping))
    ranks = source
    for i in range(1, iterations + 1):
        moved = ranks.join(flows, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
        )
        ranks = moved.unionByName(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % STAGE_EVERY == 0:
            ranks = stage_table(ranks, "host_ranks")
    return ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("rank"))), F.lit(0.0)).alias("distrust"),
    )


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    min_distrust: float = MIN_DISTRUST,
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, and its host's trust and distrust.

    The longest rule decides a page; the others are blocked if their host's distrust is over its trust and at
    least `min_distrust` of an even share over all hosts. Hosts that nothing reaches, pages without a host and null
    URLs are allowed. Null html has no links. Repeated rows stay; other columns are left out.
    """
    name, verdict = rule_of(rules)
    placed = (
        pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("rule", name)
        .withColumn("_verdict", verdict)
    )
    seeds = stage_table(seeds_of(placed, rules), "host_list")
    n_hosts = seeds.count()
    edges = stage_table(host_edges(placed), "host_edges")
    scores = propagate(edges, seeds, damping, iterations).withColumn(
        "_blocked",
        (F.col("distrust") > F.col("trust")) & (F.col("distrust") * n_hosts >= min_distrust),
    )
    judged = lookup_join(placed.drop("html"), scores, ["host"], "left", spread=["page_id", "path"], stage=True)
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("_verdict", F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
