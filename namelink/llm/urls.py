"""URL filters: explicit rules first, then a path-template tree with labelled purity.

Per host, a path is cut into segments, as many as it has; numbers and long hex
strings become placeholders.  The tree grows level by level until no node has two
shapes (paths deeper than ``LEVELS`` keep the rest as one last segment): a level
whose values hardly repeat becomes one wildcard.  Then branches are merged from
the deepest level up: children whose share of bad labels does not differ
significantly from that of their siblings together form one branch.  A template's
purity is its share of bad labels, smoothed towards its host's and that towards
the overall share; templates above the limit are rejected.

Pages are first counted by host and shape (placeholders put in), so the tree
works on shapes; a host with a third of all pages meets only in counts.

A null url, or one without "://", has empty host and path and is judged like any
other; very long urls are read whole; unlabelled pages only add to counts; of
rules that fit equally well the first in order of length, then of the list, wins;
repeated rows count each; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level becomes a wildcard from so many values, if on average they occur less than so often.
WILD_VALUES = 20
WILD_REPEATS = 5
#: Segments that form levels of their own; what a deeper path has beyond is its last segment.
LEVELS = 16
#: Squared z-score up to which a branch counts as similar to its siblings.
SIMILAR = 4.0
STRENGTH = 10.0
LIMIT = 0.5


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix; it fits the host, its subdomains, and paths that start so."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first "://" with A-Z lowered, path up to "?" or "#"."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """The path with numbers and long hex strings generalised."""
    return F.regexp_replace(F.regexp_replace(path, r"\b[0-9a-f]{12,}\b", "{h}"), "[0-9]+", "{n}")


def _segments(shaped: Column) -> Column:
    """Each segment with its slash, at most ``LEVELS`` and the rest."""
    parts = F.transform(F.split(shaped, "/"), lambda s: F.concat(F.lit("/"), s))
    rest = F.array_join(F.slice(parts, F.lit(LEVELS + 2), F.greatest(F.size(parts) - LEVELS - 1, F.lit(0))), "")
    first = F.slice(parts, F.lit(2), F.lit(LEVELS))
    return F.when(F.size(parts) > LEVELS + 1, F.concat(first, F.array(rest))).otherwise(first)


def _grow(shapes: DataFrame) -> tuple[DataFrame, int]:
    """``shapes`` (host, shape, n, labelled, bad) with ``marks``, their segments or wildcards by level, and the number of levels."""
    tree = shapes.select("*", _segments(F.col("shape")).alias("rest"), F.lit("").alias("node"), F.array().cast("array<string>").alias("marks"))
    levels = 0
    while True:
        open_ = tree.where("size(rest) > 0").select("host", "node")
        several = tree.groupBy("host", "node").agg(F.count("*").alias("c")).where("c > 1").select("host", "node")
        if open_.join(several, ["host", "node"], "left_semi").isEmpty():
            return tree, levels
        levels += 1
        values = tree.where("size(rest) > 0").groupBy("host", "node", F.get("rest", F.lit(0)).alias("s")).agg(F.sum("n").alias("n"))
        wild = values.groupBy("host", "node").agg(F.count("*").alias("_d"), F.sum("n").alias("_t"))
        wild = wild.where(f"_d >= {WILD_VALUES} and _d * {WILD_REPEATS} > _t").select("host", "node", F.lit(True).alias("_wild"))
        mark = F.when(F.col("_wild"), F.lit("/*")).otherwise(F.get("rest", F.lit(0)))
        stepped = tree.join(wild, ["host", "node"], "left").withColumn("_mark", mark)
        there = F.size("rest") > 0
        tree = materialize(
            stepped.select(
                *shapes.columns, F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
                F.when(there, F.concat("node", "_mark")).otherwise(F.col("node")).alias("node"),
                F.when(there, F.concat("marks", F.array("_mark"))).otherwise(F.col("marks")).alias("marks"),
            ),
            "url-tree",
        )


def _similar(bad: str, labelled: str, all_bad: str, all_labelled: str) -> Column:
    """Whether a branch's bad share is within SIMILAR squared standard errors of its siblings' together."""
    p = F.col(all_bad) / F.when(F.col(all_labelled) > 0, F.col(all_labelled)).otherwise(1)
    off = F.col(bad) - F.col(labelled) * p
    return off * off <= F.lit(SIMILAR) * F.col(labelled) * p * (1 - p)


def _merge(tree: DataFrame, levels: int) -> DataFrame:
    """Adds ``template``: from the deepest level up, similar siblings become "~"; a path that ends where no other goes on has nothing to merge."""
    tree = tree.withColumn("template", F.array_join("rest", ""))
    for level in range(levels, 0, -1):
        nodes = tree.withColumn("_parent", F.array_join(F.slice("marks", 1, level - 1), "")) if level > 1 else tree.withColumn("_parent", F.lit(""))
        nodes = nodes.withColumn("_branch", F.concat(F.coalesce(F.get("marks", F.lit(level - 1)), F.lit("")), "template")).withColumn("_here", F.size("marks") >= level - 1)
        each = nodes.where("_here").groupBy("host", "_parent", "_branch").agg(F.sum("bad").alias("_b"), F.sum("labelled").alias("_l"))
        together = each.groupBy("host", "_parent").agg(F.sum("_b").alias("_ab"), F.sum("_l").alias("_al"), F.max("_branch").alias("_any"))
        named = each.join(together, ["host", "_parent"]).select("host", "_parent", "_branch", F.lit(True).alias("_here"), (_similar("_b", "_l", "_ab", "_al") & (F.col("_any") != "")).alias("_same"))
        joined = nodes.join(named, ["host", "_parent", "_branch", "_here"], "left")
        label = F.when(~F.col("_here"), F.col("template")).when(F.col("_same"), F.lit("~")).otherwise(F.col("_branch"))
        tree = materialize(joined.withColumn("template", label).select(tree.columns), "url-merged")
    return tree


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``pages`` has page_id and url; ``labels`` has page_id (unique) and bad (0 or 1).
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    shaped = parsed.select("page_id", "host", "path", shape(F.col("path")).alias("shape"))
    known = labels.select(F.col("page_id").cast("long").alias("_page"), F.col("bad").cast("long").alias("bad"))
    counts = shaped.join(known, F.col("page_id") == F.col("_page"), "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree = _merge(*_grow(materialize(counts, "url-shapes")))
    total = tree.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    overall = (total["b"] + 1) / (total["l"] + 2)
    by_host = tree.groupBy("host").agg(((F.sum("bad") + STRENGTH * overall) / (F.sum("labelled") + STRENGTH)).alias("host_purity"))
    branches = tree.groupBy("host", "template").agg(F.sum("bad").alias("_b"), F.sum("labelled").alias("_l"))
    scored = branches.join(by_host, "host").select(
        "host", "template", F.round((F.col("_b") + STRENGTH * F.col("host_purity")) / (F.col("_l") + STRENGTH), 6).alias("purity")
    )
    verdicts = materialize(tree.join(scored, ["host", "template"]).select("host", "shape", F.concat("host", "template").alias("template"), "purity"), "url-verdicts")
    small = F.broadcast(verdicts) if small_enough(verdicts, 2000) else verdicts
    joined = shaped.join(small, ["host", "shape"])
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") > LIMIT, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
