"""End-to-end counts on a labelled list of 739 company names, where one is at hand.

NAMELINK_NAMES: CSV with the names in its first column; NAMELINK_TRUTH: CSV of
name and canonical name.  The list itself is not part of this repository.
"""

import csv
import os

import pytest
from namelink.config import Config
from namelink.operators import blocking, evaluation
from namelink.plans.resolve import resolve

NAMES, TRUTH = os.environ.get("NAMELINK_NAMES"), os.environ.get("NAMELINK_TRUTH")
pytestmark = pytest.mark.skipif(not (NAMES and TRUTH), reason="no list given")


def rows(path):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.reader(f))[1:]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows(NAMES))], "ord long, name string")


def test_blocks(names):
    got = blocking.block_summary(blocking.keys(names), Config()).first()
    assert (got.total_names, got.total_keys, got.total_blocks, got.singletons_filtered) == (739, 283, 146, 137)
    assert (got.largest_block_size, got.largest_block_pairs, got.within_block_pairs) == (11, 55, 1160)


@pytest.mark.parametrize("cfg", [Config(), Config(mode="adaptive_gmm"), Config(mode="hac", hac_threshold=0.42), Config(mode="hac", hac_threshold=0.3)])
def test_groups_and_metrics(spark, names, cfg):
    result = resolve(names, cfg)
    sizes = [r["n"] for r in result.clusters.groupBy("group_id").agg({"*": "count"}).toDF("group_id", "n").collect()]
    assert (len(sizes), sizes.count(1), max(sizes)) == (490, 350, 5)
    truth = spark.createDataFrame([(r[0], r[1]) for r in rows(TRUTH)], "name string, truth string")
    told = result.clusters.join(truth, "name", "left")
    total = truth.groupBy("truth").count().selectExpr("sum(count * (count - 1) div 2)").first()[0]
    sets = evaluation.pair_sets(told, total).first()
    assert (sets.tp, sets.fp, sets.fn) == (401, 1, 1020)
    pairs = evaluation.pair_confusion(told.where("truth is not null")).first()
    assert (pairs.tp, pairs.fp, pairs.fn) == (401, 0, 980)
