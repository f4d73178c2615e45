"""Names with their attributes, pairs of distinct forms, and their scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import phonetic, scoring, text
from ..functions.similarity import text_scores

#: Pairs per task of the scoring function.
PAIRS_PER_TASK = 200_000
#: Vectors per tile at least, and at most from so many tiles on: a task holds two tiles and some rows of their product.
VECTORS_PER_TILE = 512
LARGEST_TILE = 2048
TILES = 24
STRIP = 256
#: Tasks that pairs of tiles are dealt out to.
TASKS = 96
#: Bins of the scores from 0 to 1, and of each of these again.
BINS = 4096


def attributes(names: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None) -> DataFrame:
    """``names`` (ord, name) with norm, tokens, phon and embedding, each computed once per name.

    ``vectors`` (norm, embedding) is a lookup table; forms it lacks get null.
    """
    normed = names.withColumn("norm", text.normalize(F.col("name"), cfg.suffixes))
    forms = normed.withColumn("tokens", text.words(text.fold(F.col("norm"))))
    coded = forms.withColumn("phon", phonetic.codes(F.col("tokens")))
    if vectors is None:
        return coded.withColumn("embedding", F.lit(None).cast("array<double>"))
    return coded.join(vectors.select("norm", scoring.unit(F.col("embedding")).alias("embedding")), "norm", "left")


def encode_missing(names: DataFrame, cache: DataFrame, encoder) -> DataFrame:
    """``cache`` (norm, embedding) with the forms of ``names`` that it lacks, each encoded once, in batches.

    ``encoder`` takes a list of texts and returns a list of vectors.
    """
    missing = names.select("norm").distinct().join(cache.select("norm"), "norm", "left_anti")

    def run(frames):
        for frame in frames:
            yield frame.assign(embedding=[list(map(float, v)) for v in encoder(frame["norm"].tolist())])

    return cache.select("norm", F.col("embedding").cast("array<float>").alias("embedding")).union(missing.mapInPandas(run, "norm string, embedding array<float>"))


def distinct_forms(attributed: DataFrame) -> DataFrame:
    """One row per normal form, with its first name's ord: equal forms score 1 and need no scoring."""
    return attributed.groupBy("norm").agg(
        F.min("ord").alias("ord"), F.first("phon").alias("phon"), F.first("embedding").alias("embedding"), F.count("*").alias("n_names")
    )


def score(pairs: DataFrame, attributed: DataFrame, cfg: Config = Config(), least: float = 0.0) -> DataFrame:
    """``pairs`` (a_ord, b_ord) with wratio, token_set, embedding, phonetic, score and phonetic_agree.

    ``least``: only scores of at least this are wanted; pairs whose vectors
    cannot reach it are dropped before the text function runs.
    """
    side = lambda s: attributed.select(
        F.col("ord").alias(f"{s}_ord"), *[F.col(c).alias(f"{s}_{c}") for c in ("norm", "phon", "embedding")]
    )
    joined = pairs.join(side("a"), "a_ord").join(side("b"), "b_ord")
    return _scored(joined, cfg, least)


def _scored(joined: DataFrame, cfg: Config, least: float) -> DataFrame:
    have = F.col("a_embedding").isNotNull() & F.col("b_embedding").isNotNull()
    vector = F.when(have, 100 * scoring.clamp(scoring.dot(F.col("a_embedding"), F.col("b_embedding"))))
    rated = joined.withColumn("embedding", vector)
    bound = scoring.least_embedding(least, cfg)
    if bound > 0 and not cfg.redistribute_weights:
        rated = rated.where((F.coalesce("embedding", F.lit(0.0)) >= bound) | (F.col("a_norm") == F.col("b_norm")))
    texts = rated.withColumn("_t", text_scores(F.col("a_norm"), F.col("b_norm")))
    bonus = phonetic.bonus(F.col("a_phon"), F.col("b_phon"))
    full = texts.select("*", F.col("_t.wratio").alias("wratio"), F.col("_t.token_set").alias("token_set"), bonus.alias("phonetic"))
    total = scoring.confidence(
        F.col("a_norm") == F.col("b_norm"), F.col("wratio"), F.col("token_set"), F.col("embedding"), F.col("phonetic"), cfg
    )
    scored = full.withColumn("score", total).withColumn("phonetic_agree", F.col("phonetic") > 0)
    dropped = ("_t", "a_norm", "b_norm", "a_phon", "b_phon", "a_embedding", "b_embedding")
    return scored.drop(*dropped).where(F.col("score") >= least)


def all_pairs(forms: DataFrame, cfg: Config = Config(), least: float = 0.0) -> DataFrame:
    """Scores of every pair of distinct forms (a_ord < b_ord): the complete matrix that fixed and hac modes are defined on.

    The forms are cut into blocks and the block pairs are dealt out as keys, so
    the comparison is spread over all tasks; nothing is broadcast.
    """
    columns = ("ord", "norm", "phon", "embedding")
    slim = forms.select(*columns)
    n = max(1, int((slim.count() ** 2 / 2 / PAIRS_PER_TASK) ** 0.5) + 1)
    tiled = slim.withColumn("tile", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int"))
    a = tiled.select(F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(n - 1))).alias("j"), F.struct(*columns).alias("a"))
    b = tiled.select(F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.struct(*columns).alias("b"))
    met = a.join(b, ["i", "j"]).where("i < j or a.ord < b.ord").withColumn("turned", F.col("a.ord") > F.col("b.ord"))
    turned = met.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"))
    return _scored(turned.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in columns]), cfg, least)


def edges(scored: DataFrame, threshold: float, how: Column | None = None) -> DataFrame:
    """(a, b) of pairs at or above ``threshold``, or by the given condition."""
    return scored.where(F.col("score") >= threshold if how is None else how).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as rows of length 1; null, empty and zero vectors are rows of zeros, shorter ones end with zeros."""
    length = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    x = np.zeros((len(length), length.max(initial=0)))
    row = np.repeat(np.arange(len(length)), length)
    begin = np.cumsum(length) - length
    x[row, np.arange(len(row)) - begin[row]] = np.array(column.drop_null().combine_chunks().flatten().cast(pa.float64()), np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _tiles(items: DataFrame, rows: int, largest: int):
    """``items`` (ord, embedding) as one group (i, j) for each pair of tiles; grouped by them, each group is one task's bounded work.

    Tiles have ``rows`` vectors, up to ``largest`` where there would be more than
    ``TILES``: each vector travels once for every tile.
    """
    slim = items.select("ord", "embedding")
    total = slim.count()
    n = max(1, min(-(-total // rows), max(TILES, -(-total // max(rows, largest)))))
    tiled = slim.withColumn("tile", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = tiled.select(F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "ord", "embedding")
    return dealt.repartition(min(n * (n + 1) // 2, TASKS), "i", "j").groupBy("i", "j")


def _strips(table: pa.Table):
    """(ords, ords, scores, which pairs count or None for all) of a pair of tiles, some rows of the product at a time; the same on every run."""
    if not table.num_rows:
        return
    tile, ord_ = (table[c].to_numpy() for c in ("tile", "ord"))
    x = unit_rows(table["embedding"])
    order = np.lexsort((*x.T[:1], ord_))
    tile, ord_, x = tile[order], ord_[order], x[order]
    first, last = tile == table["i"][0].as_py(), tile == table["j"][0].as_py()
    mine, other, y = ord_[first], ord_[last], x[last].T
    for at in range(0, len(mine), STRIP):
        score = x[first][at : at + STRIP] @ y
        np.clip(score, 0.0, 1.0, out=score)
        some = mine[at : at + STRIP]
        yield some, other, score, some[:, None] < other[None] if (first & last).any() else None


def similar_vectors(items: DataFrame, threshold: float, rows: int = VECTORS_PER_TILE) -> DataFrame:
    """(a_ord, b_ord, score) of ``items`` (ord, embedding) whose cosine is at least ``threshold``, a_ord < b_ord.

    All pairs by definition: the vectors are cut into tiles and each pair of tiles
    is one matrix product of bounded size; only pairs that reach the threshold leave it.
    """
    kind = dict(items.dtypes)["ord"]

    def product(table: pa.Table) -> pa.Table:
        found = []
        for one, other, score, counted in _strips(table):
            a, b = np.nonzero(score >= threshold if counted is None else (score >= threshold) & counted)
            low, high = one[a], other[b]
            found.append(pa.table({"a_ord": np.minimum(low, high), "b_ord": np.maximum(low, high), "score": score[a, b]}))
        return pa.concat_tables(found) if found else pa.table({"a_ord": table["ord"], "b_ord": table["ord"], "score": pa.array([], pa.float64())})

    return _tiles(items, rows, LARGEST_TILE).applyInArrow(product, f"a_ord {kind}, b_ord {kind}, score double")


def score_distribution(items: DataFrame, shares: tuple[float, ...], rows: int = VECTORS_PER_TILE) -> DataFrame:
    """(score, n): how often scores occur among all pairs of ``items`` (ord, embedding); its percentiles at ``shares`` are those of all pairs.

    Scores are counted in bins where they are computed, so pairs never leave a
    tile.  The bins that hold a wanted rank (or its neighbour) are counted again in
    finer bins, and of those that hold one the exact scores are counted; scores of
    any other bin stand at its lower bound.
    """
    spark = items.sparkSession
    scale = float(BINS)

    def counted(kind: str, inner) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            found: dict = {}
            for _, _, score, which in _strips(table):
                for value, n in zip(*inner(score.ravel() if which is None else score[which])):
                    found[value] = found.get(value, 0) + n
            return pa.table({"value": pa.array(found.keys(), pa.float64() if kind == "double" else pa.int64()), "n": pa.array(found.values(), pa.int64())})

        return _tiles(items, rows, 2 * LARGEST_TILE).applyInArrow(run, f"value {kind}, n long").groupBy("value").agg(F.sum("n").alias("n"))

    def bins(value: np.ndarray):
        n = np.bincount((value * scale).astype(np.int32), minlength=BINS + 1)
        at = np.flatnonzero(n)
        return at.tolist(), n[at].tolist()

    def wanted(counts: list[tuple[int, int]], before: dict[int, int]) -> set[int]:
        """Bins of the ranks, of sorted ``counts``; before: how many scores are lower than a bin's."""
        ranks = {int(f(p * (total - 1))) for p in shares for f in (np.floor, np.ceil)}
        return {b for b, n in counts if any(before[b] <= r < before[b] + n for r in ranks)}

    def chosen(value: np.ndarray, coarse: set[int]) -> np.ndarray:
        table = np.zeros(BINS + 1, bool)
        table[list(coarse)] = True
        return value[table[(value * scale).astype(np.int32)]]

    first = sorted((r["value"], r["n"]) for r in counted("long", bins).collect())
    total, below = 0, {}
    for b, n in first:
        below[b] = total
        total += n
    coarse = wanted(first, below) if total else set()

    def finer(value: np.ndarray):
        value = chosen(value, coarse)
        slot = np.zeros(BINS + 1, np.int64)
        places = np.array(sorted(coarse), np.int64)
        slot[places] = np.arange(len(places))
        fine = (value * (scale * scale)).astype(np.int64)
        n = np.bincount(slot[fine // BINS] * BINS + fine % BINS, minlength=1)
        at = np.flatnonzero(n)
        return (places[at // BINS] * BINS + at % BINS).tolist(), n[at].tolist()

    second = sorted((r["value"], r["n"]) for r in counted("long", finer).collect()) if total else []
    at, inside = {}, {}
    for b, n in second:
        at[b] = below[b // BINS] + inside.get(b // BINS, 0)
        inside[b // BINS] = inside.get(b // BINS, 0) + n
    fine = wanted(second, at)
    places = np.array(sorted(fine), np.int64)

    def exact(value: np.ndarray):
        value = chosen(value, coarse)
        none = int((value == 0).sum()) if 0 in fine else 0  # half of all pairs may have it: not sorted
        value = value[value != 0]
        found, n = np.unique(value[np.isin((value * (scale * scale)).astype(np.int64), places)], return_counts=True)
        return [0.0] * (none > 0) + found.tolist(), [none] * (none > 0) + n.tolist()

    rest = [(b / scale, n) for b, n in first if b not in coarse] + [(b / scale / scale, n) for b, n in second if b not in fine]
    known = spark.createDataFrame(rest, "score double, n long")
    return known.union(counted("double", exact).select(F.col("value").alias("score"), "n")) if total else known
