import math
import random

import pytest
from namelink.config import Config
from namelink.functions import phonetic, scoring, similarity, text
from namelink.functions.scoring import Mixture, Thresholds
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    names = ["Apple Inc.", "Microsoft Corporation", "Google LLC", "Amazon.com, Inc.", "Company", "!!!", "", None, "S.A.", "Honда  Motor\tCo", "São Paulo_1 S/A", "AT&T"]
    want = ["apple", "microsoft", "google", "amazon com", "company", "", "", "", "s a", "honда motor", "são paulo_1 s a", "at t"]
    got = column(spark, names, text.normalize)
    assert got == want
    assert column(spark, got, text.normalize) == want


def test_fold_and_first_token(spark):
    assert column(spark, ["São Ærø", "Straße", "да", "Łódź", "naïve"], text.fold) == ["Sao AEro", "Strasse", "da", "Lodz", "naive"]
    forms = ["apple inc", "the apple company", "the a an", "", "a 3m"]
    assert column(spark, forms, text.first_token) == ["apple", "apple", "", "", "3m"]


def test_eligibility(spark):
    tokens = ["apple", "ibm", "ge", "a", "3m", "7eleven", ""]
    assert column(spark, tokens, phonetic.encodable) == [True, True, True, False, False, False, False]
    assert column(spark, tokens, phonetic.blockable) == [True, True, False, False, False, False, False]


def test_metaphone():
    assert phonetic.metaphone("apple") == "APL" and phonetic.metaphone("microsoft") == "MKRSFT"
    assert phonetic.metaphone("smith") == phonetic.metaphone("smyth") and phonetic.metaphone("orange") != "APL"
    assert phonetic.metaphone("") == "" and phonetic.metaphone("knight") == phonetic.metaphone("night")
    rng = random.Random(1)
    for _ in range(2000):  # any word ends
        phonetic.metaphone("".join(rng.choice("abcdefghijklmnopqrstuvwxyzçñé'- ") for _ in range(rng.randrange(12))))


def test_bonus(spark):
    pairs = [("smith", "smyth", 4.0), ("apple", "orange", -2.0), ("3m", "3m", 0.0), ("apple orange", "apple pear", -2.0), ("", "", 0.0), ("apple 3m x", "apple", 4.0)]
    frame = spark.createDataFrame([(a.split(), b.split(), w) for a, b, w in pairs], "a array<string>, b array<string>, w double")
    for r in frame.select("w", phonetic.bonus(phonetic.codes("a"), phonetic.codes("b")).alias("g")).collect():
        assert r.w == r.g


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_similarity():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        assert similarity.lcs(a, b) == plain_lcs(a, b)
        for f in (similarity.ratio, similarity.wratio, similarity.token_set_ratio, similarity.partial_ratio):
            assert 0 <= f(a, b) <= 100 and math.isclose(f(a, b), f(b, a))
    assert math.isclose(similarity.ratio("american general insurance", "american family insurance"), 100 * 42 / 51)
    assert math.isclose(similarity.token_set_ratio("american general insurance", "american family insurance"), 100 * (1 - 7 / 43))
    assert similarity.wratio("adobe", "adobe rent a car") == 90 and similarity.token_set_ratio("adobe", "adobe rent a car") == 100
    assert similarity.wratio("", "x") == 0 and similarity.token_set_ratio("a b", "b a a") == 100


def test_scores(spark):
    frame = spark.createDataFrame([(True, 0.0, 0.0, None, 0.0), (False, 100.0, 100.0, 100.0, 4.0), (False, 50.0, 40.0, None, 4.0), (False, 0.0, 0.0, 0.0, -2.0)],
                                  "same boolean, w double, t double, e double, b double")
    args = [F.col(c) for c in ("same", "w", "t", "e", "b")]
    assert [round(r[0], 6) for r in frame.select(scoring.confidence(*args, Config())).collect()] == [1.0, 1.0, 0.30, 0.0]
    spread = [r[0] for r in frame.select(scoring.confidence(*args, Config(redistribute_weights=True))).collect()]
    assert abs(spread[2] - (50 * 0.40 / 0.55 + 40 * 0.15 / 0.55 + 4) / 100) < 1e-9
    assert abs(scoring.least_embedding(0.85, Config()) - 57.77777) < 1e-3
    vectors = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in vectors.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [0.6, 0.0, 0.0]


def test_zones_and_penalty(spark):
    t = Thresholds(0.5, 0.85, 0.95)
    assert [round(x, 9) for x in column(spark, [0.95, 0.85, 0.90, 0.2], lambda c: scoring.margin_penalty(c, t), "double")] == [0, 10, 5, 10]
    assert column(spark, [0.95, 0.9, 0.8], lambda c: scoring.same_group(c, F.lit(True), t), "double") == [True, True, False]
    assert column(spark, [0.95, 0.9, 0.8], lambda c: scoring.same_group(c, F.lit(False), t), "double") == [True, False, False]
    frame = spark.createDataFrame([(0.65, "same", 0.8), (0.65, "different", 0.9), (0.65, "unknown", 0.8), (0.95, "same", 1.0), (0.1, "different", 1.0)], "s double, d string, c double")
    got = [round(r[0], 6) for r in frame.select(scoring.review_adjusted(F.col("s"), F.col("d"), F.col("c"), 0.15)).collect()]
    assert got == [0.77, 0.515, 0.65, 1.0, 0.0]


def test_mixture():
    m = Mixture((0.5, 0.5), (0.3, 0.9), (0.01, 0.0025))
    t = m.thresholds()
    assert t.t_low < t.s_90 < t.t_high and abs(m.posterior_at(t.s_90) - 0.9) < 1e-6
    assert Mixture((0.5, 0.5), (0.0, 0.1), (1.0, 1.0)).threshold(0.98) == 1.0


def test_config():
    for wrong in ({"mode": "x"}, {"weight_wratio": 0.5}, {"min_block_size": 1}, {"hac_threshold": 2.0}, {"sample_pairs": 0}, {"review_low": 0.9}):
        with pytest.raises(ValueError):
            Config(**wrong)
    assert Config(hac_threshold=0.0).hac_threshold == 0.0


def test_display(spark):
    assert column(spark, [0.95, 0.9, 0.7, 0.1], text.confidence_level, "double") == ["HIGH", "HIGH", "MEDIUM", "LOW"]
    assert column(spark, [0.1234], text.percent, "double") == ["12.3%"] and column(spark, [1234567], text.thousands, "long") == ["1,234,567"]
    assert column(spark, ["a.CSV", "a.txt"], lambda c: text.has_extension(c, ".csv")) == [True, False]
    assert column(spark, ['x ```json {"a": 1} ``` y', "```{}```", " {} "], text.fenced_json) == ['{"a": 1}', "{}", "{}"]


# Recorded scores (weighted ratio, token set ratio, phonetic bonus) of name pairs.
RECORDED = [
    ("adobe", "adobe rent a car", 90.0, 100.0, 4.0), ("american general insurance", "american family insurance", 82.352941, 83.72093, 4.0),
    ("united", "united parcel service", 90.0, 100.0, 4.0), ("american express", "american", 90.0, 100.0, 4.0), ("delta air", "delta community credit union", 85.5, 71.428571, -2.0),
    ("united parcel service", "united rentals", 85.5, 62.857143, -2.0), ("delta airlines", "delta community credit union", 85.5, 52.631579, -2.0),
    ("delta air lines", "delta community credit union", 85.5, 51.162791, -2.0), ("american express", "american airlines", 72.727273, 72.727273, -2.0),
    ("american express", "american family insurance", 85.5, 66.666667, -2.0), ("american airlines", "american telephone and telegraph", 85.5, 64.0, -2.0),
    ("united airlines", "united parcel service", 66.666667, 66.666667, -2.0), ("american airlines", "american general insurance", 85.5, 65.116279, -2.0),
    ("dhl", "dell", 57.142857, 57.142857, 4.0), ("general electric", "general dynamics", 62.5, 62.5, -2.0), ("general mills", "general dynamics", 75.862069, 75.862069, -2.0),
    ("united parcel service", "united healthcare", 57.894737, 57.894737, -2.0), ("adobe systems", "adobe rent a car", 52.777778, 55.555556, -2.0),
    ("dhl express", "dell", 51.428571, 26.666667, 4.0), ("dhl logistics", "dell", 51.428571, 35.294118, 4.0),
    ("american telephone and telegraph", "american family insurance", 50.0, 52.631579, -2.0),
]


def test_recorded_scores(spark):
    frame = spark.createDataFrame([(a, b, a.split(), b.split(), w, t, p) for a, b, w, t, p in RECORDED], "a string, b string, x array<string>, y array<string>, w double, t double, p double")
    got = frame.withColumn("s", similarity.text_scores("a", "b")).withColumn("bonus", phonetic.bonus(phonetic.codes("x"), phonetic.codes("y")))
    for r in got.collect():
        assert abs(r.s.wratio - r.w) < 1e-5 and abs(r.s.token_set - r.t) < 1e-5 and r.bonus == r.p, (r.a, r.b)
