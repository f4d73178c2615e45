"""Review of borderline pairs by an injected assessor, behind guardrails."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring, text

# What makes a reason too vague, and what shows outside knowledge.
VAGUE = (
    "they look similar", "i think", "i believe", "probably", "might be", "could be", "seems like", "based on my knowledge", "as far as i know", "in my opinion",
)
OUTSIDE = (
    "is a company that", "is known for", "provides services", "sells products", "operates in", "headquartered in", "founded in", "ceo is", "specializes in",
    "industry leader", "market share", "financial services company", "technology company", "retail chain", "e-commerce", "software company",
)
ANSWER = "decision string, confidence double, reasoning string"
SYSTEM_PROMPT = (
    "You compare two organisation names and decide, from the names alone, whether they denote the same organisation. "
    "Use no outside knowledge. Answer in JSON with decision (same, different or unknown), confidence (0 to 1) and reasoning "
    "that quotes words of both names. If the names alone do not settle it, answer unknown."
)


def prompt(a: Column, b: Column, similarity: Column) -> Column:
    return F.concat(
        F.lit("Name 1: "), a, F.lit("\nName 2: "), b, F.lit("\nMeasured similarity: "), F.format_string("%.1f", similarity * 100), F.lit("%\nSame organisation?")
    )


def borderline(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pairs whose distance lies in the review range, bounds included."""
    distance = F.round(1 - F.col("score"), 12)
    return scored.where(distance.between(cfg.review_low, cfg.review_high))


def vague_phrase(reason: Column) -> Column:
    """The first vague phrase in the reason, else null."""
    lowered = F.lower(reason)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in VAGUE])


def outside_knowledge(reason: Column) -> Column:
    lowered = F.lower(reason)
    found = F.lit(False)
    for p in OUTSIDE:
        found = found | F.contains(lowered, F.lit(p))
    return found


def weak_reason(reason: Column, a: Column, b: Column) -> Column:
    """What is wrong with a reason, else null: too short, vague, or it mentions none of the names' words."""
    long = lambda n: F.array_distinct(F.filter(text.words(F.lower(n)), lambda w: F.length(w) > 2))
    x, y, said = long(a), long(b), text.words(F.lower(reason))
    shared = F.array_intersect(x, y)
    unsaid = lambda words: (F.size(words) > 0) & (F.size(F.array_intersect(words, said)) == 0)
    silent = F.when(F.size(shared) > 0, unsaid(shared)).otherwise(unsaid(x) | unsaid(y))
    return (
        F.when(F.length(reason) < 30, "Reasoning too short (< 30 chars)")
        .when(vague_phrase(reason).isNotNull(), F.concat(F.lit("Generic/uncertain phrase detected: '"), vague_phrase(reason), F.lit("'")))
        .when(silent, "Reasoning doesn't reference the actual names")
    )


def parse(answers: DataFrame, content: str = "content") -> DataFrame:
    """decision, confidence and reasoning out of an answer's JSON (fenced or not); all null if it cannot be read."""
    parsed = answers.withColumn("_p", F.from_json(text.fenced_json(F.col(content)), ANSWER, {"mode": "PERMISSIVE"}))
    return parsed.select("*", "_p.decision", "_p.confidence", "_p.reasoning").drop("_p")


def guard(answers: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``answers`` (a, b, similarity, decision, confidence, reasoning) behind the guardrails.

    Adds the final decision, llm_confidence, adjusted_similarity,
    guardrails_triggered, guardrail_reason and low_confidence.  Unusable answers
    are unknown with confidence 0; of the later guards the last that fires names
    the reason and all keep the confidence.
    """
    decision, sure, reason = F.col("decision"), F.col("confidence"), F.col("reasoning")
    missing = decision.isNull() | sure.isNull() | reason.isNull()
    invalid = ~missing & ~decision.isin("same", "different", "unknown")
    unsure = (decision != "unknown") & (sure < cfg.review_min_confidence)
    weak = weak_reason(reason, F.col("a"), F.col("b"))
    outside = outside_knowledge(reason)
    unsure_text = F.concat(F.lit("Confidence "), F.format_string("%.2f", sure), F.lit(f" below threshold {cfg.review_min_confidence}"))
    late = F.coalesce(
        F.when(outside, "Possible hallucination detected in reasoning"), F.when(weak.isNotNull(), F.concat(F.lit("Weak reasoning: "), weak)), F.when(unsure, unsure_text)
    )
    why = (
        F.when(missing, "Invalid response structure: missing required fields")
        .when(invalid, F.concat(F.lit("Invalid decision value: "), decision))
        .otherwise(late)
    )
    final = F.when(why.isNotNull(), "unknown").otherwise(decision)
    kept = F.when(missing | invalid, 0.0).otherwise(sure)
    guarded = answers.select(
        *[c for c in answers.columns if c not in ("decision", "confidence")], final.alias("decision"), kept.alias("llm_confidence"), why.alias("guardrail_reason"),
        why.isNotNull().alias("guardrails_triggered"), F.coalesce(unsure & ~missing & ~invalid, F.lit(False)).alias("low_confidence"),
    )
    return guarded.withColumn("adjusted_similarity", scoring.review_adjusted(F.col("similarity"), F.col("decision"), F.col("llm_confidence"), cfg.review_strength))


def assess(pairs: DataFrame, assessor: Callable[[list[tuple[str, str, float]]], list[str]] | None, cache: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """Guarded answers for ``pairs`` (a, b, similarity), one per unordered pair of names, with ``cached``.

    ``assessor`` maps a batch of (a, b, similarity) to answer texts; without one,
    or if it fails on a batch, answers are empty and hence unknown.  ``cache``
    (a, b, content) answers pairs without asking.
    """
    x, y = text.pair_key(F.col("a"), F.col("b"))
    asked = pairs.select(x.alias("a"), y.alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    size = cfg.review_batch

    def run(frames):
        for frame in frames:
            answers: list[str | None] = []
            rows = list(frame[["a", "b", "similarity"]].itertuples(index=False, name=None))
            for at in range(0, len(rows), size):
                some = rows[at : at + size]
                try:
                    answers += assessor(some)
                except Exception:  # an assessor's failure is an undecided answer by contract
                    answers += [None] * len(some)
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": frame["similarity"], "content": answers, "cached": False})

    schema = "a string, b string, similarity double, content string, cached boolean"
    known = None
    if cache is not None:
        known = asked.join(cache.select("a", "b", "content"), ["a", "b"]).select("a", "b", "similarity", "content", F.lit(True).alias("cached"))
        asked = asked.join(cache.select("a", "b"), ["a", "b"], "left_anti")
    if assessor is None:
        fresh = asked.select("a", "b", "similarity", F.lit(None).cast("string").alias("content"), F.lit(False).alias("cached"))
    else:
        fresh = asked.mapInPandas(run, schema)
    return guard(parse(fresh if known is None else known.unionByName(fresh)), cfg)


def apply(scored: DataFrame, assessments: DataFrame) -> DataFrame:
    """``scored`` (a, b, score, ...) with reviewed similarities in place of the measured ones, and llm_decision."""
    x, y = text.pair_key(F.col("a"), F.col("b"))
    answers = assessments.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "adjusted_similarity", F.col("decision").alias("llm_decision"))
    joined = scored.join(answers, (x == F.col("_x")) & (y == F.col("_y")), "left")
    reviewed = F.col("adjusted_similarity").isNotNull()
    return joined.withColumn("score", F.coalesce("adjusted_similarity", "score")).withColumn("llm_reviewed", reviewed).drop("_x", "_y", "adjusted_similarity")


def statistics(assessments: DataFrame, cost: float = 0.0002) -> DataFrame:
    """One row of counts by decision, guardrails, mean confidence, adjustments made, cache hits and estimated cost."""
    d = F.col("decision")
    changed = F.abs(F.col("adjusted_similarity") - F.col("similarity")) > 0.001
    return assessments.agg(
        F.count("*").alias("total_assessments"), F.count_if("guardrails_triggered").alias("guardrails_triggered"), F.count_if(d == "unknown").alias("unknown"),
        F.count_if(d == "same").alias("same"), F.count_if(d == "different").alias("different"), F.coalesce(F.avg("llm_confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.count_if("low_confidence").alias("low_confidence_converted"), F.count_if(changed).alias("adjustments_applied"), F.count_if("cached").alias("cache_hits"),
        (F.count_if(~F.col("cached")) * cost).alias("cost_estimate"),
    )
