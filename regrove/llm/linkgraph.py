"""URL filters: allow and block rules, and for the urls that none fits, trust and distrust propagated over host edges.

Personalised PageRank starts from hosts with allowed pages and follows links; its reverse starts from hosts with
blocked pages and follows links backwards, to the hosts that point at them. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, kept_names, lower_ascii, packed, unpacked, written

#: A link to another host in HTML: with a scheme or relative to it.
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>]+)"
#: Distance of the ranks from converged ones, as a part of the mean rank of a host.
SETTLED = 1e-2
OUT = ("host", "path", "rule", "verdict", "trust", "distrust")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path, such as ``example.org/en/``."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", *, parents: bool = True) -> DataFrame:
    """(src, dst, weight): pages of host src with a link to dst; with ``parents``, also each host to and from its parent domain, with weight 1.

    Links to the own host are left out. Counts are summed map-side, so a host with most of the pages costs no more.
    """
    host = url_host(F.col(html_safe(url)))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_safe(html)), F.lit("")), F.lit(LINK), F.lit(1)), lower_ascii))).alias("dst"))
    edges = links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not parents:
        return edges
    known = pages.select(host.alias("src")).where("src != ''").distinct()
    up = known.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where("dst like '%.%' and dst != src")
    both = up.select("src", "dst").union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return edges.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def html_safe(name: str) -> str:
    return f"`{name}`"


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, cut_every: int = 4) -> DataFrame:
    """(kind, host, rank): PageRank of each kind from its seeds (kind, host). Mass of hosts without edges goes back to the seeds.

    ``edges``: (kind, src, dst, weight). Rounds go on until the ranks of a kind are together at most ``tolerance`` away from the converged ones;
    ``rounds`` makes it so many rounds of power iteration instead. Lineage is cut every few rounds (with
    ``rounds``, in each) by a table in the shared folder, so that a plan never grows with the number of rounds.
    """
    if not 0 < damping < 1:
        raise ValueError("damping lies between 0 and 1")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    edges = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("part")), "edges")
    sizes = seeds.groupBy("kind").agg((1.0 / F.count("*")).alias("seed"))  # a row for each kind
    seeds = written(seeds.join(F.broadcast(sizes), "kind").select("kind", "host", "seed"), "seeds")
    ranks = before = seeds.withColumnRenamed("seed", "rank")
    # Converged ranks are in proportion to the sum of all that a unit of seeds sends on, round after round. A round shrinks the rest of
    # that sum, damping / (1 - damping) at most, to its damping part or less; scaling to 1 at most doubles the error.
    shrunk = damping**cut_every
    enough = math.log(tolerance * (1 - shrunk) * (1 - damping) / (2 * shrunk * damping)) / math.log(damping)
    most = rounds if rounds is not None else cut_every * (2 + max(1, math.ceil(enough / cut_every)))
    for k in range(most):
        moved = ranks.join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        if rounds is None:
            back = seeds.withColumnRenamed("seed", "rank")
        else:
            moved = written(moved.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "moved")  # read twice
            flow = moved.groupBy("kind").agg(F.sum("rank").alias("flow"))
            back = seeds.join(F.broadcast(flow), "kind", "left").select("kind", "host", (F.col("seed") * (1.0 - F.coalesce("flow", F.lit(0.0)))).alias("rank"))
        ranks = moved.union(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if rounds is None and (k + 1) % cut_every == 0:
            ranks = written(ranks, "ranks")
            if _distance(ranks, before) * shrunk / (1 - shrunk) <= tolerance / 2:
                break
            before = ranks
    else:
        if rounds is None:
            raise RuntimeError("ranks did not settle")
        return ranks
    whole = ranks.groupBy("kind").agg(F.sum("rank").alias("whole"))
    return ranks.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def _distance(a: DataFrame, b: DataFrame) -> float:
    """The summed difference of two (kind, host, rank) as a part of the sum of ``a``, of the kind where it is largest."""
    both = a.select("kind", "host", "rank", F.lit(0.0).alias("was")).union(b.select("kind", "host", F.lit(0.0), "rank"))
    both = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
    return both.groupBy("kind").agg((F.sum(F.abs(F.col("rank") - F.col("was"))) / F.sum("rank")).alias("part")).agg(F.max("part")).first()[0] or 0.0


def judge_urls(pages: DataFrame, rules: list[Rule], *, url: str = "url", html: str = "html", factor: float = 1.0, rounds: int | None = None, damping: float = 0.85) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null), ``verdict``, ``trust`` and ``distrust``.

    Verdict: the rule's; without one, block if the host's distrust is above its trust and above ``factor`` times the
    mean over all hosts, else allow; ranks are converged unless ``rounds`` limits them. Seeds are the hosts of pages that an allow (trust) or block (distrust) rule fits.
    Null urls, or urls without ``://``, have an empty host, fit no rule and are allowed; null HTML has no links.
    Repeated pages are judged one by one alike. Without seeds nobody has trust or distrust. Input columns named like
    an output are replaced. Two rules of equal length that both fit: the first given wins.
    """
    names = kept_names(pages, *OUT)
    page = pages.select(packed(pages, *OUT).alias("_row"), url_host(F.col(html_safe(url))).alias("host"), url_path(F.col(html_safe(url))).alias("path"))
    chosen = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):  # what comes later goes before
        fits = rule.fits(F.col("host"), F.col("path"))
        chosen, verdict = F.when(fits, rule.pattern).otherwise(chosen), F.when(fits, rule.verdict).otherwise(verdict)
    slim = pages.select(url_host(F.col(html_safe(url))).alias("host"), url_path(F.col(html_safe(url))).alias("path")).withColumn("verdict", verdict)
    hosts = slim.where("host != ''").groupBy("host").agg(F.max(F.col("verdict") == "allow").alias("good"), F.max(F.col("verdict") == "block").alias("bad"))
    hosts = written(hosts, "hosts")
    edges = written(host_edges(pages, url, html), "links")
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    seeds = hosts.where("good").select(F.lit("trust").alias("kind"), "host").union(hosts.where("bad").select(F.lit("distrust"), F.col("host")))
    n_hosts = hosts.count()
    ranks = personalised_rank(kinds, seeds, damping=damping, rounds=rounds, tolerance=SETTLED / max(1, n_hosts))
    scores = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    scores = scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = written(scores.join(hosts, "host", "left_semi"), "scores")  # linked hosts without pages have no row to judge
    if n_hosts <= BROADCAST_ROWS:  # else by shuffle, where adaptive execution splits hot hosts
        scores = F.broadcast(scores)
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when((d > t) & (d > factor / max(1, n_hosts)), "block").otherwise("allow")
    out = page.withColumns({"rule": chosen, "_ruled": verdict}).join(scores, "host", "left")
    return out.select(*unpacked(out, names), "host", "path", "rule", F.coalesce("_ruled", by_host).alias("verdict"), t.alias("trust"), d.alias("distrust"))
