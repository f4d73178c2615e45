"""Blocking keys, blocks, candidate pairs and the stratified pair sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import phonetic, text
from ..functions.phonetic import code
from ..plans.tables import written


def keys(names: DataFrame) -> DataFrame:
    """``names`` (ord, name) with form, token, phon and block_key: token_CODE, or the token, or the whole form.

    Codes are made once per distinct token.  Without a usable token the folded
    name itself is the key; the empty key stays and is dropped by ``blocks``.
    """
    formed = names.withColumn("form", text.blocking_form(F.col("name"))).withColumn("token", text.first_token(F.col("form")))
    coded = formed.where(phonetic.blockable(F.col("token"))).select("token").distinct().select("token", code("token").alias("phon"))
    joined = formed.join(coded, "token", "left").withColumn("phon", F.nullif(F.col("phon"), F.lit("")))
    return joined.withColumn("block_key", F.when(F.col("token") == "", F.col("form")).otherwise(F.concat_ws("_", "token", "phon")))


def skip_reasons(keyed: DataFrame) -> DataFrame:
    """Why names have no phonetic part, counted."""
    reason = F.when(~phonetic.blockable(F.col("token")), "non_phonetic_token").otherwise("no_usable_code")
    return keyed.where("token <> '' and phon is null").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def pair_count(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def blocks(keyed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per key of at least min_block_size names: n, first_ord, all_pairs, n_pairs (capped), capped."""
    sized = keyed.where("block_key <> ''").groupBy("block_key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    counted = sized.where(F.col("n") >= cfg.min_block_size).withColumn("all_pairs", pair_count(F.col("n")))
    return counted.withColumn("n_pairs", F.least("all_pairs", F.lit(cfg.max_block_pairs).cast("long"))).withColumn(
        "capped", F.col("all_pairs") > cfg.max_block_pairs
    )


def block_summary(keyed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row: names, keys, blocks, singletons dropped, largest block (the first of equals), capped blocks, pairs."""
    sized = keyed.where("block_key <> ''").groupBy("block_key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    kept = F.col("n") >= cfg.min_block_size
    pairs = pair_count(F.col("n"))
    return sized.agg(
        F.sum("n").alias("total_names"),
        F.count("*").alias("total_keys"),
        F.count_if(kept).alias("total_blocks"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("singletons_filtered"),
        F.max(F.when(kept, F.col("n"))).alias("largest_block_size"),
        F.max_by("block_key", F.when(kept, F.struct(F.col("n"), -F.col("first_ord")))).alias("largest_block"),
        F.max(F.when(kept, pairs)).alias("largest_block_pairs"),
        F.count_if(kept & (pairs > cfg.max_block_pairs)).alias("blocks_capped"),
        F.coalesce(F.sum(F.when(kept, F.least(pairs, F.lit(cfg.max_block_pairs).cast("long")))), F.lit(0)).alias("within_block_pairs"),
    )


def within_pairs(keyed: DataFrame) -> DataFrame:
    """(block_key, a_ord, b_ord, a, b) of every pair inside a block, a_ord < b_ord."""
    a = keyed.where("block_key <> ''").select("block_key", F.col("ord").alias("a_ord"), F.col("name").alias("a"))
    b = keyed.where("block_key <> ''").select("block_key", F.col("ord").alias("b_ord"), F.col("name").alias("b"))
    return a.join(b, "block_key").where("a_ord < b_ord")


def capped_members(keyed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Members that can occur among a block's first max_block_pairs pairs, with their place in the block.

    Pairs are taken in (first, second) order, so a block of n names needs no
    first member beyond the one whose pairs reach the cap; a hot block's self
    join is cut to the cap before it is made, not after.
    """
    place = F.row_number().over(Window.partitionBy("block_key").orderBy("ord")) - 1
    return keyed.where("block_key <> ''").withColumn("place", place).join(blocks(keyed, cfg).select("block_key", "n"), "block_key")


def capped_pairs(keyed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Within-block pairs up to the cap: (block_key, a_ord, b_ord, a, b, pair_no), pair_no from 1 in (a, b) order."""
    members = written(capped_members(keyed, cfg).select("block_key", "ord", "name", "place", "n"), "members")
    start = lambda i: i * F.col("n") - i * (i + 1) / 2  # pairs before those that begin with place i
    a = members.where((start(F.col("place")) < cfg.max_block_pairs) & (F.col("place") < F.col("n") - 1))
    a = a.select("block_key", "n", F.col("ord").alias("a_ord"), F.col("name").alias("a"), F.col("place").alias("i"))
    b = members.select("block_key", F.col("ord").alias("b_ord"), F.col("name").alias("b"), F.col("place").alias("j"))
    number = (start(F.col("i")) + F.col("j") - F.col("i")).cast("long")
    joined = a.join(b, "block_key").where((F.col("i") < F.col("j"))).withColumn("pair_no", number)
    return joined.where(F.col("pair_no") <= cfg.max_block_pairs).select("block_key", "a_ord", "b_ord", "a", "b", "pair_no")


def allocation(sized: DataFrame, budget: int, cfg: Config = Config()) -> DataFrame:
    """``sized`` (block_key, n_pairs, first_ord) with the pairs to draw from each block.

    All of them if they fit the budget; else a proportional and an even share,
    the rounding rest going round-robin to the largest blocks (in order of
    first_ord among equals), and never more than a block has.
    """
    total = sized.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("pairs"), F.count("*").alias("n")).first()
    if total["pairs"] <= budget:
        return sized.withColumn("allocated", F.col("n_pairs").cast("long"))
    each = int(budget * cfg.floor_share) // total["n"]
    proportional = int(budget * cfg.proportional_share)
    shared = written(sized.withColumn("_base", F.floor(F.lit(float(proportional)) * (F.col("n_pairs") / F.lit(float(total["pairs"])))) + each), "shares")
    rest = budget - shared.agg(F.sum("_base")).first()[0]
    whole, more = divmod(max(rest, 0), total["n"])
    # Only the blocks that get one more are ranked: a bounded top list, not an order over all blocks.
    extra = shared.orderBy(F.desc("n_pairs"), "first_ord").limit(more).select(F.col("block_key").alias("_k"), F.lit(1).alias("_one"))
    got = shared.join(extra, F.col("block_key") == F.col("_k"), "left")
    given = F.col("_base") + whole + F.coalesce("_one", F.lit(0))
    return got.withColumn("allocated", F.least(given, F.col("n_pairs")).cast("long")).drop("_k", "_one", "_base")


def sample_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def within_sample(keyed: DataFrame, budget: int, cfg: Config = Config()) -> DataFrame:
    """A uniform sample of each block's (capped) pairs, as many as allocated; the same seed draws the same pairs."""
    pairs = capped_pairs(keyed, cfg)
    quota = allocation(blocks(keyed, cfg), budget, cfg).select("block_key", "allocated")
    rank = F.row_number().over(Window.partitionBy("block_key").orderBy(sample_order(cfg.seed, "a_ord", "b_ord"), "a_ord", "b_ord"))
    return pairs.withColumn("_rank", rank).join(quota, "block_key").where("_rank <= allocated").drop("_rank", "allocated")


def cross_sample(keyed: DataFrame, size: int, cfg: Config = Config()) -> DataFrame:
    """Pairs of names from different blocks: a sample of block pairs, expanded to their members, sampled down to ``size``.

    Block pairs are drawn by giving every block a seeded place on a ring and
    pairing it with the blocks that follow it, as many steps as needed; that
    takes about ``size`` rows and never lists all pairs of blocks.
    """
    wanted = blocks(keyed, cfg).select("block_key")
    n = wanted.count()
    empty = keyed.select(F.col("ord").alias("a_ord"), F.col("ord").alias("b_ord"), F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    if n < 2 or size < 1:
        return empty
    possible = n * (n - 1) // 2
    draw = possible if 10 * possible < size else min(possible, max(1, size // 10))
    chosen = wanted.orderBy(sample_order(cfg.seed, "block_key"), "block_key").limit(min(n, 2 * draw + 1))
    ring = written(chosen.withColumn("r", F.row_number().over(Window.orderBy(sample_order(cfg.seed, "block_key"), "block_key")) - 1), "ring")
    m = ring.count()
    steps = min(m // 2, -(-draw // m)) if draw < possible else m // 2
    ahead = ring.select(F.col("block_key").alias("k1"), F.explode(F.sequence(F.lit(1), F.lit(max(1, steps)))).alias("s"), "r")
    ahead = ahead.select("k1", F.pmod(F.col("r") + F.col("s"), F.lit(m)).alias("r"))
    block_pairs = ahead.join(ring.withColumnRenamed("block_key", "k2"), "r").select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).where("k1 <> k2").distinct()
    block_pairs = written(block_pairs.orderBy(sample_order(cfg.seed, "k1", "k2"), "k1", "k2").limit(draw), "block-pairs")
    # At most 10 candidates per wanted pair: a few members of each block stand for it, chosen by hash.
    per_block = max(1, int((10 * size / max(1, draw)) ** 0.5) + 1)
    rank = F.row_number().over(Window.partitionBy("block_key").orderBy(sample_order(cfg.seed + 1, "ord"), "ord"))
    members = keyed.where("block_key <> ''").select("block_key", "ord", "name", rank.alias("_r")).where(F.col("_r") <= per_block)
    a = members.select(F.col("block_key").alias("k1"), F.col("ord").alias("x"), F.col("name").alias("xn"))
    b = members.select(F.col("block_key").alias("k2"), F.col("ord").alias("y"), F.col("name").alias("yn"))
    pairs = block_pairs.join(a, "k1").join(b, "k2")
    swapped = F.col("x") > F.col("y")
    ordered = pairs.select(
        F.least("x", "y").alias("a_ord"), F.greatest("x", "y").alias("b_ord"),
        F.when(swapped, F.col("yn")).otherwise(F.col("xn")).alias("a"), F.when(swapped, F.col("xn")).otherwise(F.col("yn")).alias("b"),
    )
    return ordered.orderBy(sample_order(cfg.seed, "a_ord", "b_ord"), "a_ord", "b_ord").limit(size)


def stratified_sample(keyed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Within-block and cross-block pairs in the configured shares, at most sample_pairs, each pair once."""
    keyed = written(keyed, "keyed")
    inside = within_sample(keyed, int(cfg.sample_pairs * cfg.within_share), cfg).select("a_ord", "b_ord", "a", "b", F.lit(True).alias("within"))
    across = cross_sample(keyed, int(cfg.sample_pairs * cfg.cross_share), cfg).select("a_ord", "b_ord", "a", "b", F.lit(False).alias("within"))
    return inside.unionByName(across).orderBy(sample_order(cfg.seed, "a_ord", "b_ord"), "a_ord", "b_ord").limit(cfg.sample_pairs)
