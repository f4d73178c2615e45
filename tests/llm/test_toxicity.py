import math
import random

import numpy as np
import random
import zlib

from namelink.llm import queries, toxicity


def test_query(spark):
    out = queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    again = queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in out}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    accuracy = sum(r.predicted == r.toxic for r in out) / len(out)
    ranked = sorted(out, key=lambda r: r.score)
    places = [k for k, r in enumerate(ranked) if r.toxic]
    auc = (sum(places) - len(places) * (len(places) - 1) / 2) / (len(places) * (len(ranked) - len(places)))
    found = sum(r.predicted for r in out if r.toxic) / len(places)
    print("held out", len(out), "accuracy", accuracy, "auc", auc, "recall", found)
    assert accuracy > 0.93 and auc > 0.8


def test_edges(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["apple", "pear", "plum", "fig"])
    rows = [(i, " ".join(word() for _ in range(30)) + (" moron" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows] + [(None, None, "c"), (500, "", "c"), (501, "Moron " * 100_000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and out[501] >= 0.5 and out[500] < 0.5 and out[None] == out[500]
    assert toxicity.train(docs, labels.limit(0)).score(toxicity.features("x", __import__("numpy").zeros(1 << toxicity.BITS, "u1"))) == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_features(text):
    """Ids of the distinct n-grams, one by one."""
    mask, out = (1 << 64) - 1, set()
    points = [ord(c) for c in f" {text.lower()} "]
    for n in toxicity.ORDERS:
        for i in range(len(points) - n + 1):
            h = points[i]
            for k in range(1, n):
                h = h * 0x9E3779B97F4A7C15 & mask
                h = (h ^ h >> 29) + points[i + k] & mask
            out.add((h * 0xBF58476D1CE4E5B9 & mask) >> 64 - toxicity.BITS)
    return sorted(out)


def plain_fit(rows, labels):
    """The same steps with dictionaries, feature by feature."""
    y, n = labels, len(labels)
    share = (sum(y) + 1) / (n + 2)
    counts = {}
    for r, label in zip(rows, y):
        for f in r:
            counts.setdefault(f, [0, 0])[label] += 1
    ratio = {f: math.log((1 + c[1]) / (2 + sum(y)) / ((1 + c[0]) / (2 + n - sum(y)))) for f, c in counts.items() if sum(c) >= min(toxicity.MIN_DOCUMENTS, n / 4)}
    weight, squares = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8)
    bias, bias_squares = math.log(share / (1 - share)), 1e-8
    rng = np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 32):
            batch = order[at : at + 32]
            z = {i: bias + sum(weight[f] * ratio[f] for f in rows[i] if f in ratio) for i in batch}
            error = {i: (1 / (1 + math.exp(-z[i])) - y[i]) / len(batch) for i in batch}
            slope = {f: toxicity.DECAY * w for f, w in weight.items()}
            for i in batch:
                for f in rows[i]:
                    if f in ratio:
                        slope[f] += error[i] * ratio[f]
            for f, g in slope.items():
                squares[f] += g * g
                weight[f] -= toxicity.RATE * g / math.sqrt(squares[f])
            g = sum(error.values())
            bias_squares += g * g
            bias -= toxicity.RATE * g / math.sqrt(bias_squares)
    return {f: weight[f] * ratio[f] for f in ratio}, bias


def test_against_plain_model():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("good", "fine", "bad", "awful", "über")) for _ in range(rng.randrange(1, 9))) for _ in range(70)] + ["", "x"]
    labels = [int("bad" in t or "awful" in t) for t in texts]
    table = np.zeros(1 << toxicity.BITS, np.uint8)
    rows = [toxicity.features(t, table) for t in texts]
    assert [r.tolist() for r in rows[:-2]] == [plain_features(t) for t in texts[:-2]]
    for some in (*rows, np.arange(0, 1 << toxicity.BITS, 3), np.array([0, 70_000, (1 << toxicity.BITS) - 1])):
        packed = toxicity._bytes(some, table)
        assert toxicity._unpacked(packed).tolist() == some.tolist() and len(packed) <= (1 << toxicity.BITS) // 8 + 1 and not table.any()
    model, (weights, bias) = toxicity.fit(texts, labels), plain_fit([r.tolist() for r in rows], labels)
    assert abs(model.bias - bias) < 1e-6
    assert set(np.flatnonzero(model.weights).tolist()) <= set(weights)
    assert all(abs(model.weights[f] - w) < 1e-5 for f, w in weights.items())
