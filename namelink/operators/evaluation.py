"""Clustering quality, pair metrics, error analysis and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import Thresholds

# Fixed values of the error analysis.
HISTORY_WORDS = ("old", "former", "merged", "acquired")
INFORMAL_MARKS = ("co", "corp", "group", "inc", "ltd")
COMMON_WORDS = ("american", "united", "general", "national", "international", "global", "world", "first", "new", "group")


def contingency(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """(group, truth, n): everything below needs only these counts, never pairs."""
    return assigned.groupBy(group, truth).agg(F.count("*").alias("n"))


def purity(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """Mean share of a group's most frequent truth among its labelled members; singletons count 1, unlabelled groups not at all."""
    per = contingency(assigned, truth, group).groupBy(group).agg(
        F.sum("n").alias("members"), F.sum(F.when(F.col(truth).isNotNull(), F.col("n"))).alias("known"), F.max(F.when(F.col(truth).isNotNull(), F.col("n"))).alias("most")
    )
    value = F.when(F.col("members") == 1, 1.0).otherwise(F.col("most") / F.col("known"))
    return per.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("value"))


def completeness(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """Purity with the roles of groups and truth exchanged."""
    return purity(assigned.where(F.col(truth).isNotNull()), truth=group, group=truth)


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_confusion(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1 over all pairs of labelled names."""
    cells = contingency(assigned.where(F.col(truth).isNotNull() & F.col(group).isNotNull()), truth, group)
    one = F.lit(1).alias("_one")
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("tp"), F.sum("n").alias("names"), one)
    rows = cells.groupBy(group).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("predicted"), one)
    cols = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("actual"), one)
    return _rates(both.join(rows, "_one").join(cols, "_one"))


def pair_sets(assigned: DataFrame, truth_pairs: int, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """As ``pair_confusion``, but recall counts ``truth_pairs`` pairs of the whole ground truth, and unlabelled names' pairs are false."""
    cells = contingency(assigned, truth, group)
    one = F.lit(1).alias("_one")
    both = cells.where(F.col(truth).isNotNull()).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("tp"), one)
    rows = cells.groupBy(group).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("predicted"), F.sum("n").alias("names"), one)
    return _rates(both.join(rows, "_one").withColumn("actual", F.lit(float(truth_pairs))))


def _rates(counted: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("actual") - F.col("tp")
    whole = _pairs(F.col("names"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = counted.select(*[c.cast("long").alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", whole - tp - fp - fn))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    rated = counts.select("*", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mixed_groups(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """Groups of several members with more than one truth."""
    per = assigned.groupBy(group).agg(F.count("*").alias("members"), F.count_distinct(truth).alias("truths"))
    return per.where("members > 1 and truths > 1")


def false_pairs(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """Pairs inside a mixed group whose truths differ; a missing truth reads UNKNOWN."""
    label = F.coalesce(F.col(truth), F.lit("UNKNOWN"))
    inside = assigned.withColumn(truth, label).join(mixed_groups(assigned.withColumn(truth, label), truth, group).select(group), group)
    side = lambda s: inside.select(group, F.col("ord").alias(f"{s}_ord"), F.col("name").alias(s), F.col(truth).alias(f"{s}_truth"))
    return side("a").join(side("b"), group).where("a_ord < b_ord and a_truth <> b_truth")


def missed_pairs(assigned: DataFrame, truth: str = "truth", group: str = "group_id") -> DataFrame:
    """Pairs of one truth that were put into different groups."""
    side = lambda s: assigned.where(F.col(truth).isNotNull()).select(
        truth, F.col("ord").alias(f"{s}_ord"), F.col("name").alias(s), F.col(group).alias(f"{s}_group")
    )
    return side("a").join(side("b"), truth).where("a_ord < b_ord and a_group <> b_group")


def miss_categories(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, a_norm, b_norm, wratio, token_set, embedding, score) with ``categories``, all that apply.

    score is a share, the others percentages.
    """
    a, b = F.split("a_norm", " "), F.split("b_norm", " ")
    length = lambda f: f(F.length("a_norm"), F.length("b_norm"))
    short = lambda n: (F.length(n) <= 5) & ~F.contains(F.col(n), F.lit(" ")) & (F.col(n) == F.upper(n)) & F.col(n).rlike(r"\p{Lu}")
    either = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("a_norm"), t) | F.contains(F.col("b_norm"), t))
    shared = F.array_intersect(a, b)
    single = ~F.contains(F.col("a_norm"), F.lit(" ")) | ~F.contains(F.col("b_norm"), F.lit(" "))
    both_differ = (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    found = {
        "ABBREVIATION": F.when(length(F.greatest) > 0, length(F.least) / length(F.greatest)) < 0.5,
        "ACRONYM": short("a_norm") | short("b_norm"),
        "TYPO": (F.col("wratio") > 70) & (F.col("score") * 100 < 50),
        "WORD_ORDER": (text.jaccard(a, b) > 0.6) & (F.col("token_set") > 70),
        "PARTIAL_NAME": text.is_subset(a, b) | text.is_subset(b, a),
        "HISTORICAL": either(HISTORY_WORDS),
        "LOW_SEMANTIC": F.coalesce("embedding", F.lit(0.0)) < 40,
        "NICKNAME": single & either(INFORMAL_MARKS),
        "TRANSLITERATION": F.concat("a", "b").rlike(r"[^\x00-\x7F]") & F.concat("a", "b").rlike(r"[\x00-\x7F]"),
        "COMMON_WORD_COLLISION": F.arrays_overlap(shared, F.array(*map(F.lit, COMMON_WORDS))) & both_differ,
    }
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda t: t.isNotNull())
    return pairs.withColumn("categories", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("OTHER"))))


def category_counts(categorised: DataFrame) -> DataFrame:
    """(category, n, share): a pair counts in each of its categories; the share is of all pairs."""
    total = categorised.count()
    return categorised.select(F.explode("categories").alias("category")).groupBy("category").agg(
        F.count("*").alias("n"), (F.count("*") / F.lit(max(1, total))).alias("share")
    )


def shared_word_counts(pairs: DataFrame, least_length: int = 3) -> DataFrame:
    """(word, n) over the words that both normal forms of a pair hold."""
    words = F.array_intersect(F.split("a_norm", " "), F.split("b_norm", " "))
    return pairs.select(F.explode(words).alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def pattern_summary(pairs: DataFrame) -> DataFrame:
    """Shares of pairs with a shared word and with one name inside the other, component means, dominant component, score range."""
    a, b = F.split("a_norm", " "), F.split("b_norm", " ")
    parts = {"wratio": 0.40 * F.col("wratio"), "token_set": 0.15 * F.col("token_set"), "embedding": 0.45 * F.coalesce("embedding", F.lit(0.0))}
    top = F.greatest(*parts.values())
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.size(F.array_intersect(a, b)) > 0, 1.0).otherwise(0.0)).alias("share_shared_word"),
        F.avg(F.when(text.is_subset(a, b) | text.is_subset(b, a), 1.0).otherwise(0.0)).alias("share_subset"),
        *[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"avg_{c}") for c in parts],
        *[F.count_if(v == top).alias(f"dominant_{c}") for c, v in parts.items()],
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def risky_pairs(canonicals: DataFrame, variants: DataFrame, hand_written: DataFrame | None = None, words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """(a, b) that share a common word though their canonicals differ: the first variant of one with the last of the other.

    ``canonicals`` has canonical_name; ``variants`` has canonical_name, name, ord.
    """
    ends = variants.groupBy("canonical_name").agg(F.min_by("name", "ord").alias("first"), F.max_by("name", "ord").alias("last"))
    hit = canonicals.select("canonical_name", F.explode(F.array(*map(F.lit, words))).alias("word")).where(F.contains(F.lower("canonical_name"), F.col("word")))
    known = hit.join(ends, "canonical_name")
    left = known.select("word", F.col("canonical_name").alias("x"), F.col("first").alias("a"))
    right = known.select("word", F.col("canonical_name").alias("y"), F.col("last").alias("b"))
    pairs = left.join(right, "word").where("x < y").select("a", "b")
    if hand_written is not None:
        pairs = pairs.union(hand_written.select("a", "b"))
    low = [F.lower("a"), F.lower("b")]
    return pairs.withColumn("_x", F.least(*low)).withColumn("_y", F.greatest(*low)).groupBy("_x", "_y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def risk(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "WOULD_MATCH").when(score >= 0.75, "HIGH_RISK").otherwise("LOW_RISK")


def confidence_histogram(scored: DataFrame, score: str = "confidence_score") -> DataFrame:
    """(bin, n) over eight bins, from [0.999, 1] down to below 0.60."""
    bounds = [0.999, 0.95, 0.90, 0.85, 0.80, 0.70, 0.60]
    label = F.lit("<0.600")
    for b in reversed(bounds):
        label = F.when(F.col(score) >= b, F.lit(f">={b:.3f}")).otherwise(label)
    return scored.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def three_bins(scored: DataFrame, high: float, low: float, inclusive: bool = True, score: str = "confidence_score") -> DataFrame:
    above = F.col(score) >= high if inclusive else F.col(score) > high
    return scored.agg(
        F.count_if(above).alias("high"), F.count_if(~above & (F.col(score) >= low)).alias("middle"), F.count_if(F.col(score) < low).alias("low"),
        F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"),
    )


def group_spread(scored: DataFrame, score: str = "confidence_score", group: str = "group_id") -> DataFrame:
    return scored.groupBy(group).agg(F.count("*").alias("n"), (F.max(score) - F.min(score)).alias("spread")).where("n > 1")


def compare_runs(runs: DataFrame, base: str) -> DataFrame:
    """``runs`` (run, f1, precision, recall, seconds) with differences from the run named ``base`` and the ratio of seconds."""
    one = runs.where(F.col("run") == base).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_{c}") for c in ("f1", "precision", "recall", "seconds")])
    joined = runs.withColumn("_one", F.lit(1)).join(one, "_one")
    deltas = [(F.col(c) - F.col(f"_{c}")).alias(f"{c}_change") for c in ("f1", "precision", "recall")]
    return joined.select(*runs.columns, *deltas, F.when(F.col("_seconds") > 0, F.col("seconds") / F.col("_seconds")).alias("seconds_ratio"))


def best_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run", "f1").alias("run"), F.max("f1").alias("f1"))


def zone(score: Column, phonetic: Column, t: Thresholds) -> Column:
    return (
        F.when(score >= t.t_high, "accept").when((score >= t.s_90) & phonetic, "promote").when(score >= t.t_low, "review").otherwise("reject")
    )
