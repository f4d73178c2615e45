"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words.  A document's expected copies are its
preference times its source's scale, at most ``max_copies``; the scale is such
that the expected words are the target (what capped documents cannot take goes to
the others).  The whole part is taken for certain, the fraction is its inclusion
probability p.  Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first ones are taken until the source's
words come closest to its target: a sample of fixed size, in words.

The preference used here (``by_length``) follows the length: documents of 50
words and more are taken twice, of 500 and more three times as readily as shorter ones.

Only two numbers per document travel (its rank key and its size).  The cut is
found by buckets of the rank key, so a source with a third of all rows is
spread over its buckets and only the bucket that holds the cut is ordered.
Rank keys are digests of the doc_id, so reruns and retries agree.

Null texts have size 0; very long texts count in full; the null source is a source of its own, last in order;
rows that share doc_id and source are ranked by the same number (and drawn together if equally long); an empty table or a
corpus without words takes nothing; columns with clashing names stay untouched
because the work is done on a separate slim table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, once, small_enough, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Rows of a source per bucket of its rank key.
BUCKET_ROWS = 1024
SALT = "mix"
EDGE = 1e-9
#: (least words, preference), by which ``by_length`` prefers documents.
LENGTH_CLASSES = ((0, 1), (50, 2), (500, 3))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the doc_id: the leading 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SALT}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _inside(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source (source, source_size): its target.  Weights repeat over the sources in code point order, null last.

    Shares of the total are capped at ``max_copies`` times a source's size and
    the excess is reshared by weight; that ends at min(cap, level * weight),
    whose level follows from the sources sorted by cap over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    named = (
        sources.withColumn("_n", F.row_number().over(order) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    )
    sweep = Window.orderBy(F.col("_cap") / F.col("_weight"), "_n")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_cap").over(sweep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_weight").over(sweep.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") - before) / after
    fits = named.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    chosen = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_n"), F.col("_level").alias("level")))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(chosen["level"] * F.col("_weight"), F.col("_cap")))
    return fits.withColumn("target", F.round(target, 6)).select("source", "source_size", "source_rows", "target")


def _ranked(slim: DataFrame, stats: DataFrame, max_copies: int) -> DataFrame:
    """``slim`` with its source's figures, whole copies and a rank key in (0, 1) that orders as the Pareto ratio does.

    The key maps the ratio back to the scale of u at the source's own rate, so
    buckets of equal width hold about as many rows each.
    """
    with_source = slim.join(_one_row_each(stats), slim["source"].eqNullSafe(stats["source"]), "left").drop(stats["source"])
    expected = F.least(F.col("scale") * F.col("preference"), F.lit(float(max_copies)))
    whole = F.floor(F.col("_expected"))
    p, rate = _inside(F.col("_expected") - F.col("whole")), _inside(F.col("rate") - F.floor("rate"))
    scaled = _odds(uniform(F.col("doc_id"))) / _odds(p) * _odds(rate)
    return (
        with_source.withColumn("_expected", expected)
        .withColumn("whole", whole)
        .withColumn("rank", F.when(F.col("whole") >= max_copies, F.lit(2.0)).otherwise(scaled / (1 + scaled)))
        .drop("_expected")
    )


def _one_row_each(stats: DataFrame, rows: int = 10_000) -> DataFrame:
    """One row per source; broadcast while there are few sources, else shuffled with skewed sources split by Spark."""
    return F.broadcast(stats) if small_enough(stats, rows) else stats


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source_size, target, rate and the cut of the rank order.

    ``slim`` holds doc_id, source, size and optionally preference (default 1).
    """
    slim = _with_preference(slim)
    classes = materialize(
        slim.groupBy("source", "preference").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("preference")).alias("weighted"), F.count("*").alias("rows")), "mix-sources"
    )
    sums = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("source_rows"))
    size = F.nullif(F.col("source_size"), F.lit(0)).cast("double")
    stats = targets(sums, weights, max_copies).withColumn("rate", F.least(F.coalesce(F.col("target") / size, F.lit(0.0)), F.lit(float(max_copies))))
    stats = _scaled(materialize(stats, "mix-targets"), classes, max_copies)
    buckets = F.greatest(F.ceil(F.col("source_rows") / BUCKET_ROWS), F.lit(1))
    ranked = _ranked(slim, stats, max_copies).where("rank < 2").withColumn("bucket", F.floor(F.col("rank") * buckets))
    certain = _ranked(slim, stats, max_copies).groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = materialize(
        stats.join(certain.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", (F.col("target") - F.col("certain")).alias("need")),
        "mix-need",
    )
    by_bucket = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = by_bucket.withColumn("upto", F.sum("words").over(running))
    crossing = (
        summed.join(_one_row_each(need).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where("need > 0 and upto >= need")
        .groupBy("source")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "need"), "bucket").alias("at"))
        .select(F.col("source").alias("_s"), F.col("at.*"))
    )
    crossing = materialize(crossing, "mix-crossing").withColumnRenamed("bucket", "_bucket")
    inside = ranked.join(
        _one_row_each(crossing), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_bucket"))
    ).groupBy("source", "rank", "doc_id", "before", "need").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = inside.withColumn("upto", F.col("before") + F.sum("words").over(within)).where("upto >= need")
    cuts = reach.groupBy("source").agg(F.min_by(F.struct("rank", "doc_id", "upto", "words", "need"), F.struct("rank", "doc_id")).alias("c"))
    takes_crossing = F.col("c.upto") - F.col("c.need") < F.col("c.need") - (F.col("c.upto") - F.col("c.words"))
    cuts = cuts.select(F.col("source").alias("_s"), F.col("c.rank").alias("cut_rank"), F.col("c.doc_id").alias("cut_id"), takes_crossing.alias("cut_in"))
    out = stats.join(need.withColumnRenamed("source", "_n"), F.col("source").eqNullSafe(F.col("_n"))).join(
        cuts, F.col("source").eqNullSafe(F.col("_s")), "left"
    )
    return materialize(out.drop("_n", "_s"), "mix-plan")


def _scaled(stats: DataFrame, classes: DataFrame, max_copies: int) -> DataFrame:
    """``stats`` with ``scale``: expected copies are least(scale * preference, max_copies) and their words the target.

    ``classes`` has the words of each source and preference.  Documents at the cap
    give the rest to the others, which may put more of them at the cap; ends when none is added.
    """
    scaled = stats.withColumn("scale", F.lit(0.0)).withColumn("at_cap", F.lit(-1).cast("long"))
    while True:
        of = classes.withColumnRenamed("source", "_s").join(_one_row_each(scaled.select("source", "scale")), F.col("_s").eqNullSafe(F.col("source")))
        full = F.col("scale") * F.col("preference") >= max_copies
        left = of.groupBy("_s").agg(
            F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).cast("double").alias("_full"),
            F.nullif(F.coalesce(F.sum(F.when(~full, F.col("weighted"))), F.lit(0)).cast("double"), F.lit(0.0)).alias("_open"), F.count_if(full).alias("_n"),
        )
        joined = scaled.join(left, F.col("source").eqNullSafe(F.col("_s")))
        after = joined.withColumn("_changed", F.col("_n") != F.col("at_cap")).withColumn("scale", F.coalesce((F.col("target") - max_copies * F.col("_full")) / F.col("_open"), F.col("scale")))
        after = materialize(after.withColumn("at_cap", F.col("_n")).drop("_s", "_full", "_open", "_n"), "mix-scale")
        if after.where("_changed").isEmpty():
            return after.drop("_changed", "at_cap")
        scaled = after.drop("_changed")


def by_length(slim: DataFrame) -> DataFrame:
    """``slim`` with a preference that grows with the length."""
    preference = F.lit(LENGTH_CLASSES[0][1])
    for least, value in LENGTH_CLASSES[1:]:
        preference = F.when(F.col("size") >= least, value).otherwise(preference)
    return slim.withColumn("preference", preference.cast("long"))


def _with_preference(slim: DataFrame) -> DataFrame:
    return slim if "preference" in slim.columns else slim.withColumn("preference", F.lit(1).cast("long"))


def copies(slim: DataFrame, planned: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``slim`` with source_size, target and the number of copies taken of each document."""
    ranked = _ranked(_with_preference(slim), planned, max_copies)
    # A source whose order never reaches its need takes all of it; one without need takes none.
    before = (F.col("rank") < F.col("cut_rank")) | (
        (F.col("rank") == F.col("cut_rank"))
        & (F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull()))
    )
    at = (F.col("rank") == F.col("cut_rank")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    drawn = F.when(F.col("need") <= 0, False).when(F.col("cut_rank").isNull(), F.col("rank") < 2).otherwise(before | (at & F.col("cut_in")))
    return ranked.withColumn("copies", (F.col("whole") + F.when(drawn, 1).otherwise(0)).cast("long")).drop(
        "preference", "rate", "scale", "need", "whole", "rank", "source_rows", "cut_rank", "cut_id", "cut_in"
    )


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size) of each document, kept in the shared folder so that texts are read once."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col(text)).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns as they were."""
    names = docs.columns
    planned = plan(by_length(sized(docs)))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"))
    rows = once(rows, size=word_count(F.col("_row.text")))
    taken = copies(by_length(rows), planned).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
