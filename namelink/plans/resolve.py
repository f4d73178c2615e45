"""The whole linkage: names in; mappings, audit log, summary and metadata out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring, text
from ..operators import blocking, calibrate, clustering, graph, pairs, review
from .tables import written


@dataclass
class Resolution:
    mappings: DataFrame
    audit: DataFrame
    summary: DataFrame
    clusters: DataFrame
    thresholds: scoring.Thresholds | None = None
    mixture: scoring.Mixture | None = None
    review: DataFrame | None = None
    fallback: str | None = None


def resolve(names: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None, assessor=None, cache: DataFrame | None = None) -> Resolution:
    """``names`` (ord, name, distinct).  ``vectors`` (norm, embedding) and ``assessor`` are optional parts.

    Normal forms are clustered, not names: equal forms score 1, so they always
    share a group, and only distinct forms are compared.
    """
    attributed = written(pairs.attributes(names, cfg, vectors), "attributes")
    forms = written(pairs.distinct_forms(attributed), "forms")
    nodes = forms.select("ord")
    thresholds = mixture = reviewed = fallback = None
    if cfg.mode == "adaptive_gmm":
        keyed = written(blocking.keys(names), "keys")
        sample = written(pairs.score(blocking.stratified_sample(keyed, cfg), attributed, cfg), "sample")
        mixture, _ = calibrate.fit_scores(sample, cfg)
        thresholds = mixture.thresholds() if mixture else None
        if thresholds is None:
            fallback = "too few pairs or no usable mixture; fixed threshold used"
    if cfg.mode == "hac":
        similar = written(_similarities(forms, cfg), "similar")
        if cfg.review:
            named = _named(similar, forms)
            reviewed = written(review.assess(review.borderline(named, cfg).select("a", "b", F.col("score").alias("similarity")), assessor, cache, cfg), "review")
            similar = written(review.apply(named, reviewed).select("a_ord", "b_ord", "score"), "similar")
        found = clustering.hierarchical(forms.select("ord", "n_names"), similar, cfg.hac_threshold, cfg.hac_linkage)
    elif thresholds is not None:
        by_form = sample.join(_form_ord(attributed, "a_ord", "x"), "a_ord").join(_form_ord(attributed, "b_ord", "y"), "b_ord")
        accepted = by_form.where(scoring.same_group(F.col("score"), F.col("phonetic_agree"), thresholds) & (F.col("x") != F.col("y")))
        found = clustering.leader_clusters(nodes, accepted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    else:
        if cfg.redistribute_weights or vectors is not None or _text_only_best(cfg) >= cfg.similarity_threshold:
            scored = written(pairs.all_pairs(forms, cfg, cfg.similarity_threshold).select("a_ord", "b_ord", "score"), "similar")
            found = clustering.leader_clusters(nodes, pairs.edges(scored, cfg.similarity_threshold))
        else:  # no two forms can reach the threshold: each is a group
            found = graph.numbered(nodes.withColumn("leader", F.col("ord")), "leader").select("ord", "group_id")
    by_norm = forms.select("norm", "ord").join(found, "ord").select("norm", "group_id")
    members = written(attributed.select("ord", "name", "norm").join(by_norm, "norm").select("ord", "name", "group_id"), "members")
    mapped = _mapped(members, attributed, cfg, thresholds, mixture, reviewed)
    info = replace(cfg, mode="fixed") if fallback else cfg
    return Resolution(mapped, audit_log(mapped), _summary(members, info, thresholds, fallback), members, thresholds, mixture, reviewed, fallback)


def _text_only_best(cfg: Config) -> float:
    """The best score of two different forms without vectors."""
    return cfg.weight_wratio + cfg.weight_token_set + 0.04


def _form_ord(attributed: DataFrame, column: str, name: str) -> DataFrame:
    first = attributed.groupBy("norm").agg(F.min("ord").alias(name))
    return attributed.join(first, "norm").select(F.col("ord").alias(column), name)


def _similarities(forms: DataFrame, cfg: Config) -> DataFrame:
    """All pairs' scores: average linkage needs every pair of a component, also the distant ones."""
    return pairs.all_pairs(forms, cfg, 0.0).select("a_ord", "b_ord", "score")


def _named(similar: DataFrame, forms: DataFrame) -> DataFrame:
    side = lambda s: forms.select(F.col("ord").alias(f"{s}_ord"), F.col("norm").alias(s))
    return similar.join(side("a"), "a_ord").join(side("b"), "b_ord")


def _mapped(members: DataFrame, attributed: DataFrame, cfg: Config, thresholds, mixture, reviewed) -> DataFrame:
    mapped = clustering.mappings(members)
    own = mapped.select(F.col("ord").alias("a_ord"), F.col("canonical_ord").alias("b_ord"))
    scores = pairs.score(own, attributed, cfg).select(F.col("a_ord").alias("ord"), "score", "phonetic_agree")
    joined = mapped.join(scores, "ord")
    value = F.col("score")
    if thresholds is not None:
        value = scoring.adjusted_confidence(F.col("score"), mixture.posterior(F.col("score")), F.col("phonetic_agree"), thresholds)
    final = F.when(F.col("ord") == F.col("canonical_ord"), 1.0).otherwise(value)
    if reviewed is not None:
        norms = attributed.select(F.col("ord").alias("_o"), "norm")
        canon = attributed.select(F.col("ord").alias("_c"), F.col("norm").alias("canonical_norm"))
        with_norms = joined.join(norms, F.col("ord") == F.col("_o")).join(canon, F.col("canonical_ord") == F.col("_c"))
        x, y = text.pair_key(F.col("norm"), F.col("canonical_norm"))
        answers = reviewed.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("decision").alias("llm_decision"))
        joined = with_norms.join(answers, (x == F.col("_x")) & (y == F.col("_y")), "left")
    else:
        joined = joined.withColumn("llm_decision", F.lit(None).cast("string"))
    return joined.select(
        F.col("name").alias("original_name"), "canonical_name", final.alias("confidence_score"), "group_id", "alternatives",
        F.col("llm_decision").isNotNull().alias("llm_reviewed"), "llm_decision",
    )


def audit_log(mapped: DataFrame) -> DataFrame:
    return mapped.select(
        F.current_timestamp().alias("timestamp"), "original_name", "canonical_name", "confidence_score", "group_id",
        text.reasoning(F.col("original_name"), F.col("canonical_name"), F.col("confidence_score")).alias("reasoning"),
    )


def _summary(members: DataFrame, cfg: Config, thresholds, fallback: str | None) -> DataFrame:
    t = thresholds
    info = F.struct(
        F.lit(cfg.mode).alias("method"), F.lit(t.t_low if t else None).cast("double").alias("t_low"), F.lit(t.s_90 if t else None).cast("double").alias("s_90"),
        F.lit(t.t_high if t else None).cast("double").alias("t_high"), F.lit(cfg.similarity_threshold if cfg.mode == "fixed" else None).cast("double").alias("fixed_threshold"),
        F.lit(fallback).cast("string").alias("fallback_reason"), F.lit(cfg.hac_threshold if cfg.mode == "hac" else None).cast("double").alias("hac_threshold"),
        F.lit(cfg.hac_linkage if cfg.mode == "hac" else None).cast("string").alias("hac_linkage"),
    )
    return clustering.summary(members).withColumn("threshold_info", info)
