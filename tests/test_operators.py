import random

import numpy as np
import pytest
from namelink.config import Config
from namelink.operators import blocking, calibrate, clustering, evaluation, graph, pairs, review
from namelink.plans.resolve import resolve
from namelink.sources import files
from namelink.streaming import incremental
from pyspark.sql import functions as F

NAMES = ["Apple Inc.", "Apple", "Apple Corporation", "Google LLC", "Google Inc.", "Microsoft Corp", "Microsoft", "3M Company", "The A & An", "!!!"]


def names(spark, values=NAMES):
    return spark.createDataFrame(list(enumerate(values)), "ord long, name string")


def test_blocking(spark):
    keyed = blocking.keys(names(spark, ["Apple Inc.", "3M Company", "GE Corporation", "The Apple Company", "The A & An", "", "123"]))
    got = {r.ord: r.block_key for r in keyed.collect()}
    assert got == {0: "apple_APL", 1: "3m", 2: "ge", 3: "apple_APL", 4: "the a an", 5: "", 6: "123"}
    assert {r.reason: r.n for r in blocking.skip_reasons(keyed).collect()} == {"non_phonetic_token": 3}
    sized = {r.block_key: r for r in blocking.blocks(blocking.keys(names(spark))).collect()}
    assert sized["apple_APL"].n == 3 and sized["apple_APL"].all_pairs == 3 and "3m" not in sized


def test_allocation(spark):
    cfg = Config()
    two = spark.createDataFrame([("x", 3, 0), ("y", 1, 5)], "block_key string, n_pairs long, first_ord long")
    assert {r.block_key: r.allocated for r in blocking.allocation(two, 100, cfg).collect()} == {"x": 3, "y": 1}
    big = spark.createDataFrame([("giant", 4950, 0), ("tiny", 1, 200)], "block_key string, n_pairs long, first_ord long")
    got = {r.block_key: r.allocated for r in blocking.allocation(big, 1000, cfg).collect()}
    assert got["tiny"] > 0 and got["giant"] > 10 * got["tiny"] and sum(got.values()) <= 1000


def test_samples(spark):
    many = names(spark, [f"Acme {i}" for i in range(40)] + [f"Blue {i}" for i in range(30)] + [f"Cyan {i}" for i in range(20)])
    keyed = blocking.keys(many).cache()
    assert blocking.capped_pairs(keyed, Config(max_block_pairs=50)).groupBy("block_key").count().where("count > 50").isEmpty()
    inside = blocking.within_sample(keyed, 100)
    first, again = sorted(map(tuple, inside.collect())), sorted(map(tuple, blocking.within_sample(keyed, 100).collect()))
    assert first == again and 90 <= len(first) <= 100
    across = blocking.cross_sample(keyed, 60)
    key = {r.ord: r.block_key for r in keyed.collect()}
    rows = across.collect()
    assert len(rows) == 60 == len({(r.a_ord, r.b_ord) for r in rows})
    assert all(key[r.a_ord] != key[r.b_ord] and r.a_ord < r.b_ord for r in rows)
    assert blocking.cross_sample(keyed.where("block_key like 'acme%'"), 60).isEmpty()


def random_graph(rng, n, m):
    return {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}


def test_graph_against_plain(spark):
    rng = random.Random(4)
    for n, m in ((40, 30), (60, 120), (30, 0)):
        e = random_graph(rng, n, m)
        nodes = spark.createDataFrame([(i,) for i in range(n)], "ord long")
        edges = spark.createDataFrame(sorted(e), "a long, b long") if e else spark.createDataFrame([], "a long, b long")
        label = list(range(n))
        for _ in range(n):
            for a, b in e:
                label[a] = label[b] = min(label[a], label[b])
        assert {r.ord: r.component for r in graph.components(nodes, edges).collect()} == dict(enumerate(label))
        leader = {}
        for i in range(n):
            if i not in leader:
                for j in range(i, n):
                    if j not in leader and (i == j or (i, j) in e):
                        leader[j] = i
        assert {r.ord: r.leader for r in graph.leaders(nodes, edges).collect()} == leader


def plain_linkage(d, threshold, method):
    """Flat clusters straight from the definitions (average, single, complete)."""
    clusters = [[i] for i in range(len(d))]
    f = {"average": np.mean, "single": np.min, "complete": np.max}[method]
    while len(clusters) > 1:
        height, i, j = min((float(f(d[np.ix_(a, b)])), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if height > threshold:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward"])
def test_hierarchical(spark, method):
    rng = np.random.default_rng(8)
    points = rng.random((28, 2))
    d = np.clip(np.linalg.norm(points[:, None] - points[None], axis=2), 0, 1)
    labels = clustering.agglomerate(d, 0.25, method)
    whole = {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}
    if method != "ward":
        assert whole == plain_linkage(d, 0.25, method)
    nodes = spark.createDataFrame([(i,) for i in range(28)], "ord long")
    rows = [(i, j, float(1 - d[i, j])) for i in range(28) for j in range(i + 1, 28)]
    found = clustering.hierarchical(nodes, spark.createDataFrame(rows, "a_ord long, b_ord long, score double"), 0.25, method).collect()
    got = {}
    for r in found:
        got.setdefault(r.group_id, set()).add(r.ord)
    assert {frozenset(g) for g in got.values()} == whole
    # items of a size stand for copies
    twice = np.r_[np.arange(28), [3, 3, 5]]
    sizes = np.ones(28)
    sizes[[3, 5]] = 3, 2
    weighted = clustering.agglomerate(d, 0.25, method, sizes)
    expanded = clustering.agglomerate(d[np.ix_(twice, twice)], 0.25, method)[:28]
    assert {tuple(np.flatnonzero(weighted == k)) for k in set(weighted)} == {tuple(np.flatnonzero(expanded == k)) for k in set(expanded)}
    assert -1 <= clustering.cophenetic_correlation(d, method) <= 1


def clustered(n, seed):
    """Unit vectors around a few centres and far from them, some equal, one of zeros."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, n)] + rng.normal(size=(n, 12)) * rng.choice([0.2, 0.6, 1.5], (n, 1))
    x[n // 2 : n // 2 + 9], x[-1] = x[3], 0
    return x


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.55, 0.8])
def test_average_linkage_from_close_pairs(threshold):
    for seed in range(6):
        x = clustered(150, seed)[:-1]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sizes = np.random.default_rng(seed).integers(1, 4, len(x))
        distance = 1 - np.clip(x @ x.T, 0, 1)
        a, b = np.nonzero(np.triu(distance <= threshold + 1e-12, 1))
        assert (clustering.agglomerate(distance, threshold, "average", sizes) == clustering.agglomerate_vectors(x, sizes, a, b, 1 - distance[a, b], threshold)).all()


@pytest.mark.parametrize("dense", [0, 25])
def test_hierarchical_vectors_write_close_pairs_only(spark, monkeypatch, dense):
    monkeypatch.setattr(clustering, "CELLS_PER_PAIR", dense)
    tables, write = [], clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, name: tables.append(write(df, name)) or tables[-1])
    x = clustered(120, 3)
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(200, None, "c"), (201, [], "c"), (202, [0.0], "c")]
    items = spark.createDataFrame(rows, "ord long, embedding array<float>, component string")
    got = {r.ord: r.group_id for r in clustering.hierarchical_vectors(items, 0.4).collect()}
    scores = [t for t in tables if "score" in t.columns]
    assert scores and all(t.where("score < 0.59").isEmpty() for t in scores)
    every = spark.createDataFrame([(i, j, float(s)) for i, j, s in pairs.similar_vectors(items, 0.0).collect()], "a_ord long, b_ord long, score double")
    want = {r.ord: r.group_id for r in clustering.hierarchical(items.select("ord"), every, 0.4).collect()}
    assert got == want and len(got) == 123 and got[60] == got[3] and len(set(got.values())) < 110
    assert every.count() == 123 * 122 // 2
    assert clustering.hierarchical_vectors(items.limit(0), 0.4).count() == 0


def test_percentiles_without_pairs(spark, monkeypatch):
    """Bins, finer bins and exact scores give the percentiles of all pairs; at most a fraction of the pairs leaves a tile."""
    x = clustered(300, 5)
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, embedding array<float>")
    every = pairs.similar_vectors(items, 0.0)
    want = clustering.threshold_advice(every).first()
    for bins, tile in ((4096, 512), (8, 64)):
        monkeypatch.setattr(pairs, "BINS", bins)
        held = pairs.score_distribution(items, clustering.SHARES, tile)
        got = clustering.threshold_advice(held).first()
        assert got.asDict() == pytest.approx(want.asDict(), abs=1e-12)
        assert held.agg(F.sum("n")).first()[0] == every.count() == 300 * 299 // 2 and held.count() < every.count() // 4
    assert clustering.threshold_advice(pairs.score_distribution(items.limit(1), clustering.SHARES)).first().p25 is None
    assert clustering.threshold_advice(pairs.score_distribution(items.limit(0), clustering.SHARES)).first().p25 is None
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "ord long, embedding array<float>")
    assert clustering.threshold_advice(pairs.score_distribution(same, clustering.SHARES)).first().p90 == pytest.approx(1)


def test_canonical_and_mappings(spark):
    members = names(spark, ["Apple Inc.", "Apple", "APPLE", "Solo"]).withColumn("group_id", F.when(F.col("ord") < 3, 0).otherwise(1))
    assert {r.group_id: r.canonical_name for r in clustering.canonical_names(members).collect()} == {0: "APPLE", 1: "Solo"}
    got = {r.name: r.alternatives for r in clustering.mappings(members).collect()}
    assert got == {"APPLE": ["Apple Inc.", "Apple"], "Apple": ["APPLE", "Apple Inc.", "Apple"], "Apple Inc.": ["APPLE", "Apple Inc.", "Apple"], "Solo": []}
    assert {r.name: r.alternatives for r in clustering.mappings(members, False).collect()}["Apple"] == ["APPLE", "Apple Inc."]


def test_resolve_modes(spark):
    r = resolve(names(spark))
    assert {m.original_name: m.canonical_name for m in r.mappings.collect()}["Apple Corporation"] == "Apple"
    s = r.summary.first()
    assert (s.total_input_names, s.total_groups_created, s.threshold_info.method) == (10, 6, "fixed")
    assert r.audit.where("reasoning = 'Selected as canonical name'").count() == 6
    adaptive = resolve(names(spark), Config(mode="adaptive_gmm"))
    assert adaptive.fallback and adaptive.summary.first().threshold_info.method == "fixed"

    def assessor(batch):
        return ['{"decision": "same", "confidence": 1.0, "reasoning": "both names hold the word apple or google or microsoft"}'] * len(batch)

    vectors = spark.createDataFrame([("apple", [1.0, 0.0]), ("google", [0.0, 1.0]), ("microsoft", [0.0, 1.0])], "norm string, embedding array<double>")
    hac = resolve(names(spark), Config(mode="hac", review=True, review_low=0.3, review_high=0.6), vectors, assessor)
    assert hac.review.count() >= 1 and hac.mappings.count() == 10
    empty = resolve(names(spark, ["x"]).limit(0))
    assert empty.mappings.count() == 0


def test_shared_vectors_are_encoded_once(spark):
    cache = spark.createDataFrame([("a", [1.0])], "norm string, embedding array<float>")
    out = pairs.encode_missing(spark.createDataFrame([("a",), ("b",), ("b",)], "norm string"), cache, lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.norm for r in out.collect()) == ["a", "b"]


def test_mixture_fit():
    rng = np.random.default_rng(42)
    x = np.clip(np.r_[rng.normal(0.3, 0.1, 100), rng.normal(0.9, 0.05, 100)], 0, 1)
    t = calibrate.fit(x, np.ones(200)).thresholds()
    assert t.t_low < t.s_90 < t.t_high


def test_metrics_against_pairs(spark):
    rng = random.Random(3)
    rows = [(i, f"n{i}", rng.randrange(6), rng.choice([*"abcd", None])) for i in range(60)]
    frame = spark.createDataFrame(rows, "ord long, name string, group_id int, truth string")
    known = [r for r in rows if r[3]]
    both = [(a[2] == b[2], a[3] == b[3]) for i, a in enumerate(known) for b in known[i + 1 :]]
    got = evaluation.pair_confusion(frame).first()
    assert (got.tp, got.fp, got.fn, got.tn) == tuple(sum(p == (g, t) for p in both) for g, t in ((True, True), (True, False), (False, True), (False, False)))
    shares = []
    for g in {r[2] for r in rows}:
        members = [r[3] for r in rows if r[2] == g]
        seen = [m for m in members if m]
        shares.append(1.0 if len(members) == 1 else max(map(seen.count, seen)) / len(seen))
    assert abs(evaluation.purity(frame).first().value - sum(shares) / len(shares)) < 1e-9
    assert evaluation.false_pairs(frame).count() == sum(a[2] == b[2] and (a[3] or "UNKNOWN") != (b[3] or "UNKNOWN") for i, a in enumerate(rows) for b in rows[i + 1 :])


def test_review(spark):
    rows = [
        ("Tesla Motors", "Tesla Inc", 0.6, "same", 0.9, "Both names begin with the word tesla and differ in form", None),
        ("Tesla Motors", "Tesla Inc", 0.6, "same", 0.4, "Both names begin with the word tesla and differ in form", "Confidence 0.40 below threshold 0.6"),
        ("Tesla Motors", "Tesla Inc", 0.6, "same", 0.9, "short", "Weak reasoning: Reasoning too short (< 30 chars)"),
        ("Tesla Motors", "Tesla Inc", 0.6, "same", 0.9, "I think these two are the tesla company", "Weak reasoning: Generic/uncertain phrase detected: 'i think'"),
        ("Tesla Motors", "Tesla Inc", 0.6, "different", 0.9, "tesla operates in a market of its own, so it is", "Possible hallucination detected in reasoning"),
        ("Ford", "Opel", 0.6, "different", 0.9, "these two share no word and no letters at all", "Weak reasoning: Reasoning doesn't reference the actual names"),
        ("A", "B", 0.6, "maybe", 0.9, "x", "Invalid decision value: maybe"), ("A", "B", 0.6, None, 0.9, "x", "Invalid response structure: missing required fields"),
    ]
    frame = spark.createDataFrame(rows, "a string, b string, similarity double, decision string, confidence double, reasoning string, want string")
    for r in review.guard(frame).collect():
        assert r.guardrail_reason == r.want and r.guardrails_triggered == (r.want is not None)
        assert abs(r.adjusted_similarity - (0.735 if r.want is None else 0.6)) < 1e-9
    asked = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.5), ("c", "d", 0.5)], "a string, b string, similarity double")
    cache = spark.createDataFrame([("c", "d", '{"decision": "unknown", "confidence": 0.1, "reasoning": "no way to tell these two names apart"}')], "a string, b string, content string")

    def failing(batch):
        raise RuntimeError("down")

    out = review.assess(asked, failing, cache)
    assert out.count() == 2 and review.statistics(out).first().cache_hits == 1 and out.where("decision <> 'unknown'").isEmpty()


def test_files(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text('company,x\n"Acme, ""Best""",1\nNA,2\nAcme B,3\nAcme B,4\n"two\nlines",5\n,6\n', encoding="utf-8")
    got = [r.name for r in files.read_names(spark, str(path)).orderBy("ord").collect()]
    assert got == ['Acme, "Best"', "Acme B", "two\nlines"]
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "latin.csv").write_bytes("n\nHermès\n".encode("latin-1"))
    for bad in ("empty.csv", "latin.csv", "names.txt"):
        with pytest.raises(ValueError):
            files.read_names(spark, str(tmp_path / bad))
    (tmp_path / "truth.csv").write_text("Original Name,Canonical Name\na,x\na,y\n")
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "truth.csv")).collect()] == [("a", "y")]
    fixed = spark.createDataFrame([("HermÃ¨s",), ("Plain",), ("Zoë",)], "s string").select(files.repair_mojibake("s"))
    assert [r[0] for r in fixed.collect()] == ["Hermès", "Plain", "Zoë"]
    mapped = spark.createDataFrame([('A "q"', "A", 0.98765, 0)], "original_name string, canonical_name string, confidence_score double, group_id int")
    files.write_mappings(mapped, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv")).splitlines()
    assert '"A ""q""","A","0.988","0"' in lines
    (tmp_path / "report.txt").write_text("TESTING: one\nGroup 1\n  Canonical: Acme\n  - Acme Inc  98.5%\n  - Acme\nGroup 2\n  Canonical: B\n  - B  100%\n")
    rows = files.read_report(spark, str(tmp_path / "report.txt")).collect()
    assert [(r.test, r.grp, r.canonical, r.member, r.share) for r in rows] == [("one", 1, "Acme", "Acme Inc", 0.985), ("one", 1, "Acme", "Acme", None), ("one", 2, "B", "B", 1.0)]
    assert files.with_variations(names(spark)).count() == 10 + len(files.VARIATIONS)
    assert files.markdown(mapped).count("\n") == 2


def test_stream(spark, tmp_path):
    known = spark.createDataFrame([("apple", 0, "Apple")], "norm string, group_id int, canonical_name string")
    names(spark).select("name").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    query = incremental.assign(stream, known).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select * from assigned where group_id = 0").count() == 3 and spark.table("assigned").count() == 10


def test_tables_are_released(spark):
    from namelink.plans import tables

    df = tables.written(spark.range(5), "t")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert df.count() == 5 and os.path.isdir(folder)
    tables.release(spark)
    assert not os.path.isdir(folder)
