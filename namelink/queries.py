"""Registered queries of the linkage engine and the SQL they are held against.

Names are derived from ``part``: p_name in initial capitals and a legal form
chosen by p_size, which gives names that collide once normalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import phonetic, scoring, similarity, text
from .functions.scoring import Mixture, Thresholds
from .operators import blocking, calibrate, clustering, evaluation, graph, pairs, review
from .plans.resolve import resolve
from .plans.tables import written
from .sources import files

T = Thresholds(0.30, 0.60, 0.80)
MIX = Mixture((0.6, 0.4), (0.3, 0.9), (0.02, 0.005))
FORMS = ("", " Inc.", " Corp", ", LLC", " Company")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """(ord, name) distinct, ord the smallest part key."""
    p = table(spark, d, "part")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select(F.concat(F.initcap("p_name"), form).alias("name"), F.col("p_partkey").alias("ord")).groupBy("name").agg(F.min("ord").alias("ord")).select("ord", "name")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


def vector_scores(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    return pairs.similar_vectors(vectors(spark, d), threshold)


def labelled_groups(spark: SparkSession, d: str) -> DataFrame:
    """A clustering to be measured: vectors by their strongest of the first eight coordinates, truth the label."""
    first = F.slice("embedding", 1, 8)
    return vectors(spark, d).select(
        "ord", F.concat(F.lit("v"), "ord").alias("name"), F.col("label").alias("truth"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("group_id")
    )


def norm_groups(spark: SparkSession, d: str) -> DataFrame:
    """Names with group_id by normal form: what fixed mode gives without vectors."""
    names = part_names(spark, d).withColumn("norm", text.normalize(F.col("name")))
    return graph.numbered(names, "norm").select("ord", "name", "group_id")


def keyed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names with the token alone as blocking key: codes never change the blocks."""
    return part_names(spark, d).withColumn("form", text.blocking_form(F.col("name"))).withColumn("block_key", text.first_token(F.col("form")))


def simple_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a score, an agreement flag and a certainty, all from line numbers: inputs of the decision expressions."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919) % 1001 / 1000.0).alias("score"), (F.col("o_orderkey") % 3 == 0).alias("agree"),
        ((F.col("o_orderkey") * 31) % 101 / 100.0).alias("certainty"),
        F.element_at(F.array(*map(F.lit, ("same", "different", "unknown"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("decision"),
    )


def _r(c, n: int = 6):
    return F.round(c, n)


def q_extract(spark, d):
    found = files.names_of(table(spark, d, "part").select("p_name", "p_partkey")).select("name")
    first = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return found.join(first, "name").select("ord", "name")


def q_normalize(spark, d):
    return part_names(spark, d).select("ord", "name", text.normalize(F.col("name")).alias("norm"))


def q_fold(spark, d):
    """The whole text of every document, transliterated."""
    return table(spark, d, "documents").select("doc_id", F.lower(text.fold(F.col("text"))).alias("folded"))


def q_blocking_token(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("The "), "s_name").alias("name"))
    both = part_names(spark, d).union(s.select(F.col("ord") + 1_000_000_000, "name"))
    form = text.blocking_form(F.col("name"))
    token = text.first_token(form)
    return both.select("ord", form.alias("form"), token.alias("token"), phonetic.blockable(token).alias("blockable"), phonetic.encodable(token).alias("encodable"))


def q_name_shape(spark, d):
    n = F.col("name")
    return part_names(spark, d).select("ord", F.length(n).alias("length"), text.word_count(n).alias("words"), text.capitals(n).alias("capitals"))


def q_norm_groups(spark, d):
    return norm_groups(spark, d)


def q_canonical(spark, d):
    return clustering.canonical_names(norm_groups(spark, d)).select("group_id", "canonical_name")


def q_mappings(spark, d):
    m = clustering.mappings(norm_groups(spark, d))
    return m.select("ord", "name", "canonical_name", "group_id", F.array_join("alternatives", "|").alias("alternatives"))


def q_audit(spark, d):
    m = clustering.mappings(norm_groups(spark, d)).withColumn("confidence", F.lit(1.0))
    return m.select("ord", text.reasoning(F.col("name"), F.col("canonical_name"), F.col("confidence")).alias("reasoning"), text.confidence_level(F.col("confidence")).alias("level"))


def q_summary(spark, d):
    return clustering.summary(norm_groups(spark, d)).select(
        "total_input_names", "total_groups_created", _r(F.col("reduction_percentage")).alias("reduction_percentage"), _r(F.col("average_group_size")).alias("average_group_size")
    )


def q_group_sizes(spark, d):
    return clustering.group_sizes(norm_groups(spark, d))


def q_blocks(spark, d):
    return blocking.blocks(keyed_parts(spark, d), Config(max_block_pairs=20)).select("block_key", "n", "first_ord", "all_pairs", "n_pairs", "capped")


def q_block_summary(spark, d):
    return blocking.block_summary(keyed_parts(spark, d), Config(max_block_pairs=20))


def q_allocation(spark, d):
    cfg = Config(max_block_pairs=200)
    return blocking.allocation(blocking.blocks(keyed_parts(spark, d), cfg), 100, cfg).select("block_key", "n_pairs", "allocated")


def q_within(spark, d):
    return blocking.within_pairs(keyed_parts(spark, d)).select("block_key", "a_ord", "b_ord")


def q_capped(spark, d):
    return blocking.capped_pairs(keyed_parts(spark, d), Config(max_block_pairs=20)).select("block_key", "a_ord", "b_ord", "pair_no")


def q_within_sample(spark, d):
    return blocking.within_sample(keyed_parts(spark, d), 100, Config(max_block_pairs=200)).groupBy("block_key").agg(F.count("*").alias("n"))


def q_cross_sample(spark, d):
    return blocking.cross_sample(keyed_parts(spark, d), 50).agg(F.count("*").alias("n"), F.count_if(F.col("a_ord") >= F.col("b_ord")).alias("unordered"))


def q_cosine(spark, d):
    return vector_scores(spark, d, 0.35).select("a_ord", "b_ord", _r(F.col("score"), 5).alias("score"))


def q_cosine_topk(spark, d):
    return vector_scores(spark, d, 0.3).select("a_ord", "b_ord", _r(F.col("score"), 5).alias("score")).orderBy(F.desc("score"), "a_ord", "b_ord").limit(20)


def q_edges(spark, d):
    return pairs.edges(vector_scores(spark, d, 0.3), 0.4)


def q_borderline(spark, d):
    return review.borderline(vector_scores(spark, d, 0.3), Config(review_low=0.5, review_high=0.65)).select("a_ord", "b_ord")


def q_components(spark, d):
    v = vectors(spark, d)
    return graph.components(v.select("ord"), pairs.edges(vector_scores(spark, d, 0.45), 0.45)).select("ord", "component")


def q_leaders(spark, d):
    v = vectors(spark, d)
    return graph.leaders(v.select("ord"), pairs.edges(vector_scores(spark, d, 0.4), 0.4)).select("ord", "leader")


def q_hac_average(spark, d):
    return clustering.hierarchical_vectors(vectors(spark, d), 0.55)


def q_hac_single(spark, d):
    v = vectors(spark, d)
    return clustering.hierarchical(v.select("ord"), vector_scores(spark, d, 0.45), 0.55, "single")


def q_hac_distances(spark, d):
    got = clustering.distance_summary(labelled_groups(spark, d).select("ord", "group_id"), vector_scores(spark, d, 0.0))
    return got.select(
        "total_names", "total_clusters", "max_cluster_size", "singleton_clusters",
        *[_r(F.col(c), 5).alias(c) for c in ("avg_cluster_size", "reduction_percentage", "avg_distance_all_pairs", "avg_distance_within_clusters")],
    )


def q_percentiles(spark, d):
    got = clustering.threshold_advice(pairs.score_distribution(vectors(spark, d), clustering.SHARES))
    return got.select(*[_r(F.col(c), 5).alias(c) for c in got.columns])


def q_indel(spark, d):
    """Indel ratio of every supplier's name with its nation's name."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lower("s_name").alias("x"), F.col("s_nationkey").alias("b"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("b"), F.lower("n_name").alias("y"))
    return a.join(b, "b").select("a", "b", _r(similarity.indel_ratio("x", "y")).alias("ratio"))


def q_text_scores(spark, d):
    n = part_names(spark, d).withColumn("norm", text.normalize(F.col("name"))).groupBy("norm").agg(F.min("ord").alias("ord"))
    token = F.get(F.split("norm", " "), F.lit(0))
    a = n.select(token.alias("k"), F.col("ord").alias("a_ord"), F.col("norm").alias("a"))
    b = n.select(token.alias("k"), F.col("ord").alias("b_ord"), F.col("norm").alias("b"))
    got = a.join(b, "k").where("a_ord < b_ord").withColumn("s", similarity.text_scores("a", "b"))
    return got.select("a_ord", "b_ord", _r(F.col("s.wratio")).alias("wratio"), _r(F.col("s.token_set")).alias("token_set"))


def q_pair_scores(spark, d):
    keyed = written(keyed_parts(spark, d), "keyed")
    attributed = written(pairs.attributes(keyed.select("ord", "name")), "attributes")
    got = pairs.score(blocking.within_pairs(keyed).select("a_ord", "b_ord"), attributed)
    return got.select("a_ord", "b_ord", "phonetic", "phonetic_agree", _r(F.col("score")).alias("score"))


def q_word_overlap(spark, d):
    p = part_names(spark, d).withColumn("w", F.array_distinct(F.split(text.normalize(F.col("name")), " "))).withColumn("k", F.get("w", F.lit(0)))
    a = p.select("k", F.col("ord").alias("a_ord"), F.col("w").alias("a"))
    b = p.select("k", F.col("ord").alias("b_ord"), F.col("w").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "k").where("a_ord < b_ord").select(
        "a_ord", "b_ord", _r(text.jaccard(x, y)).alias("jaccard"), F.size(F.array_intersect(x, y)).alias("shared"), (text.is_subset(x, y) | text.is_subset(y, x)).alias("subset")
    )


def q_zone(spark, d):
    s, a = F.col("score"), F.col("agree")
    return simple_scores(spark, d).select("id", scoring.same_group(s, a, T).alias("same"), evaluation.zone(s, a, T).alias("zone"), evaluation.risk(s, 0.85).alias("risk"))


def q_penalty(spark, d):
    return simple_scores(spark, d).select("id", _r(scoring.margin_penalty(F.col("score"), T)).alias("penalty"))


def q_posterior(spark, d):
    return simple_scores(spark, d).select("id", _r(MIX.posterior(F.col("score"))).alias("posterior"))


def q_adjusted(spark, d):
    s = F.col("score")
    return simple_scores(spark, d).select("id", _r(scoring.adjusted_confidence(s, MIX.posterior(s), F.col("agree"), T)).alias("confidence"))


def q_review_adjust(spark, d):
    return simple_scores(spark, d).select("id", _r(scoring.review_adjusted(F.col("score"), F.col("decision"), F.col("certainty"), 0.15)).alias("similarity"))


def q_weighted(spark, d):
    s = 100 * F.col("score")
    got = scoring.confidence(F.col("id") % 50 == 0, s, 100 - s, F.when(F.col("agree"), s), F.when(F.col("agree"), 4.0).otherwise(-2.0), Config())
    return simple_scores(spark, d).select("id", _r(got).alias("score"))


def q_distance_threshold(spark, d):
    return simple_scores(spark, d).select("id", _r(text.to_distance(F.when(F.col("agree"), F.col("score") * 100).otherwise(F.col("score")))).alias("distance"))


def q_formatters(spark, d):
    return simple_scores(spark, d).select("id", text.percent(F.col("score")).alias("percent"), text.thousands(F.col("id")).alias("thousands"))


def q_guardrails(spark, d):
    """Guardrail predicates over conversation texts; names are the two words that begin each text."""
    c = table(spark, d, "conversations")
    w = text.words(F.col("text"))
    a, b = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I think so "), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" operates in sales"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", review.vague_phrase(said).alias("vague"), review.outside_knowledge(said).alias("outside"), review.weak_reason(said, a, b).alias("weak"))


def _answers(spark, d):
    s = simple_scores(spark, d)
    reason = F.when(F.col("id") % 5 == 0, "short").otherwise(F.concat(F.lit("alpha"), F.col("id") % 7, F.lit(" corp and alpha"), F.col("id") % 7, F.lit(" share their first word")))
    return s.select(
        F.concat(F.lit("alpha"), F.col("id") % 7, F.lit(" corp")).alias("a"), F.concat(F.lit("alpha"), F.col("id") % 7, F.lit(" ag")).alias("b"),
        F.col("score").alias("similarity"), F.when(F.col("id") % 11 != 0, F.col("decision")).alias("decision"), F.col("certainty").alias("confidence"), reason.alias("reasoning"), "id",
    )


def q_guard(spark, d):
    got = review.guard(_answers(spark, d))
    return got.select("id", "decision", "llm_confidence", "guardrails_triggered", "guardrail_reason", "low_confidence", _r(F.col("adjusted_similarity")).alias("adjusted_similarity"))


def q_review_stats(spark, d):
    got = review.statistics(review.guard(_answers(spark, d)).withColumn("cached", F.col("id") % 2 == 0))
    return got.select(*[_r(F.col(c), 5).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def q_assess(spark, d):
    """Review with a deterministic assessor that compares first words."""

    def assessor(batch):
        same = [a.split()[0] == b.split()[0] for a, b, _ in batch]
        return [f'```json\n{{"decision": "{"same" if s else "different"}", "confidence": 0.9, "reasoning": "both {a} and {b} were compared by words"}}\n```' for s, (a, b, _) in zip(same, batch)]

    n = part_names(spark, d).withColumn("norm", text.normalize(F.col("name"))).groupBy("norm").agg(F.min("ord").alias("ord"))
    k = F.get(F.split("norm", " "), F.lit(0))
    a, b = n.select(k.alias("k"), F.col("norm").alias("a")), n.select(k.alias("k"), F.col("norm").alias("b"))
    asked = a.join(b, "k").where("a < b").select("a", "b", F.lit(0.6).alias("similarity"))
    return review.assess(asked, assessor).select("a", "b", "decision", _r(F.col("adjusted_similarity")).alias("adjusted_similarity"))


def q_purity(spark, d):
    return evaluation.purity(labelled_groups(spark, d)).select(_r(F.col("value")).alias("purity"))


def q_completeness(spark, d):
    return evaluation.completeness(labelled_groups(spark, d)).select(_r(F.col("value")).alias("completeness"))


def _rates(df):
    return df.select("tp", "fp", "fn", "tn", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_confusion(spark, d):
    return _rates(evaluation.pair_confusion(labelled_groups(spark, d)))


def q_pair_sets(spark, d):
    part = labelled_groups(spark, d).withColumn("truth", F.when(F.col("ord") % 10 != 0, F.col("truth")))
    total = vectors(spark, d).groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    return _rates(evaluation.pair_sets(part, total))


def q_mixed_groups(spark, d):
    return evaluation.mixed_groups(labelled_groups(spark, d))


def q_false_pairs(spark, d):
    return evaluation.false_pairs(labelled_groups(spark, d).withColumn("truth", F.col("truth").cast("string"))).groupBy("group_id").agg(F.count("*").alias("n"))


def q_missed_pairs(spark, d):
    return evaluation.missed_pairs(labelled_groups(spark, d)).groupBy("truth").agg(F.count("*").alias("n"))


def q_categories(spark, d):
    n = part_names(spark, d).withColumn("norm", text.normalize(F.col("name"))).withColumn("k", F.get(F.split("norm", " "), F.lit(0)))
    side = lambda s: n.select("k", F.col("ord").alias(f"{s}_ord"), F.col("name").alias(s), F.col("norm").alias(f"{s}_norm"))
    numbers = side("a").join(side("b"), "k").where("a_ord < b_ord").select(
        "*", (F.col("a_ord") % 101).cast("double").alias("wratio"), (F.col("b_ord") % 101).cast("double").alias("token_set"),
        (F.col("a_ord") % 91).cast("double").alias("embedding"), ((F.col("b_ord") % 100) / 100.0).alias("score"),
    )
    return numbers


def q_category_counts(spark, d):
    got = evaluation.category_counts(evaluation.miss_categories(q_categories(spark, d)))
    return got.select("category", "n", _r(F.col("share")).alias("share"))


def q_shared_words(spark, d):
    return evaluation.shared_word_counts(q_categories(spark, d)).orderBy(F.desc("n"), "word").limit(10)


def q_patterns(spark, d):
    got = evaluation.pattern_summary(q_categories(spark, d))
    return got.select(*[_r(F.col(c), 5).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def q_risky(spark, d):
    c = table(spark, d, "customer").select(
        F.concat(F.element_at(F.array(*map(F.lit, ("American ", "United ", "First ", "Blue "))), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_nationkey")).alias("canonical_name"),
        F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"),
    )
    return evaluation.risky_pairs(c.select("canonical_name").distinct(), c)


def q_histogram(spark, d):
    return evaluation.confidence_histogram(simple_scores(spark, d), "score")


def q_three_bins(spark, d):
    got = evaluation.three_bins(simple_scores(spark, d), 0.9, 0.7, score="score")
    return got.select(*[_r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def q_spread(spark, d):
    s = simple_scores(spark, d).withColumn("group_id", (F.col("id") % 400).cast("int"))
    got = evaluation.group_spread(s, "score").select("group_id", "n", _r(F.col("spread")).alias("spread"))
    return got.orderBy(F.desc("n"), F.desc("spread"), "group_id").limit(25)


def q_text_filter(spark, d):
    return part_names(spark, d).where(text.contains_text("AN", F.col("name"))).select("ord", "name")


def q_set_operations(spark, d):
    """Sizes of intersection, differences and union of predicted and true pairs, over every vector, from contingency counts instead of pairs."""
    cells = labelled_groups(spark, d).groupBy("group_id", "truth").agg(F.count("*").alias("n"))
    pairs_of = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("n"))
    side = lambda k: pairs_of(cells.where(F.col(k).isNotNull()).groupBy(k).agg(F.sum("n").alias("n")))
    both = pairs_of(cells.dropna(subset=["group_id", "truth"])).withColumnRenamed("n", "both")
    counted = both.crossJoin(side("group_id").withColumnRenamed("n", "p")).crossJoin(side("truth").withColumnRenamed("n", "t"))
    kinds = {"both": F.col("both"), "only_predicted": F.col("p") - F.col("both"), "only_true": F.col("t") - F.col("both"), "either": F.col("p") + F.col("t") - F.col("both")}
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in kinds.items()])).alias("x")).select("x.kind", "x.n")


def q_json(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    body = F.concat(F.lit('{"decision": "same", "confidence": 0.'), F.col("id") % 10, F.lit(', "reasoning": "r"}'))
    content = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.col("id") % 4 == 1, F.concat(F.lit("```"), body, F.lit("```")))
    raw = o.select("id", content.when(F.col("id") % 4 == 2, body).otherwise("no json").alias("content"))
    return review.parse(raw).select("id", "decision", "confidence", "reasoning")


def q_gmm(spark, d):
    mixture, n = calibrate.fit_scores(simple_scores(spark, d))
    return calibrate.metadata(spark, mixture, n)


def q_resolve(spark, d):
    r = resolve(part_names(spark, d))
    return r.mappings.select("original_name", "canonical_name", "confidence_score", "group_id", F.array_join("alternatives", "|").alias("alternatives"), "llm_reviewed")


def q_resolve_adaptive(spark, d):
    return resolve(part_names(spark, d), Config(mode="adaptive_gmm")).mappings.select("original_name", "canonical_name", "confidence_score", "group_id")


def q_resolve_hac(spark, d):
    return resolve(part_names(spark, d), Config(mode="hac", hac_threshold=0.5)).mappings.select("original_name", "canonical_name", "confidence_score", "group_id")


def q_phonetic_codes(spark, d):
    return blocking.keys(part_names(spark, d)).select("ord", "token", "phon", "block_key")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_") and name != "q_categories"}


def queries() -> dict:
    return dict(QUERIES)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query: names resolved to canonical names."""
    return q_resolve(spark, sf_dir)
