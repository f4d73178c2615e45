import hashlib
import random

from namelink.llm import mixing


def plain_targets(sizes):
    """Capped shares by repeated resharing, as the contract states it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def rank(doc_id):
    return int(hashlib.md5(f"mix:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.F.lit("clash"))
    slim = mixing.sized(frame)
    return frame, mixing.copies(slim, mixing.plan(slim)).collect()


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rng = random.Random(3)
    names = ["a", "b", "c", "d", "é", None]
    rows = [(i, rng.choice(names + ["a"] * 6), "w " * rng.randrange(0, 60)) for i in range(900)] + [(900, "tiny", "one two"), (901, "none", None)]
    _, out = run(spark, rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = plain_targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-4 and 0 <= r.copies <= 3
    for s in sizes:
        mine = sorted((r for r in out if r.source == s), key=lambda r: (rank(r.doc_id), r.doc_id))
        whole = int(min(3, target[s] / sizes[s])) if sizes[s] else 0
        need, best = target[s] - whole * sizes[s], (0, 0)
        sums, upto = [0], 0
        for r in mine:
            upto += r.size
            sums.append(upto)
        best = min(range(len(sums)), key=lambda k: (abs(sums[k] - need), k)) if need > 0 else 0
        assert sum(r.copies * r.size for r in mine) == whole * sizes[s] + sums[best], s


def test_edges(spark):
    rows = [(None, None, "a b"), (1, "s", None), (1, "s", "x y z"), (1, "s", "x y z"), (2, "t", ""), (3, "s", "w " * 50000)]
    frame, out = run(spark, rows)
    assert len(out) == 6 and all(0 <= r.copies <= 3 for r in out)
    first = sorted((r.doc_id or 0, r.size, r.copies) for r in out)
    assert first == sorted((r.doc_id or 0, r.size, r.copies) for r in run(spark, rows[::-1])[1])
    assert mixing.mix_documents(frame).columns == frame.columns
    assert mixing.mix_documents(frame.limit(0)).count() == 0
    assert run(spark, [(1, "s", None)])[1][0].copies == 0


def test_preference_changes_inclusion(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * 20) for i in range(3000)]
    slim = mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    slim = slim.withColumn("preference", mixing.F.when(mixing.F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    out = mixing.copies(slim, mixing.plan(slim)).where("source = 'b'").collect()
    taken = [sum(r.copies for r in out if r.doc_id % 2 == k) for k in (0, 1)]
    assert taken[0] > 2 * taken[1] > 0
    assert abs(sum(taken) * 20 - out[0].target) <= 10


def test_inclusion_by_length(spark, monkeypatch):
    """Over salts, each length class is taken as often as its scale says, and a class at the cap leaves the rest to the others."""
    rows = [(i, "abc"[i % 3], "w " * (20, 100, 600)[i % 7 % 3]) for i in range(2400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counts, expected, n = {}, {}, {}
    for salt in ("one", "two", "three"):
        monkeypatch.setattr(mixing, "SALT", salt)
        slim = mixing.by_length(mixing.sized(frame))
        planned = mixing.plan(slim)
        scale = {r.source: (r.scale, r.target) for r in planned.collect()}
        taken = {}
        for r in mixing.copies(slim, planned).collect():
            k = (r.source, r.size)
            want = min(3.0, scale[r.source][0] * {20: 1, 100: 2, 600: 3}[r.size])
            assert int(want) <= r.copies <= int(want) + 1 and r.copies <= 3
            counts[k], expected[k], n[k] = counts.get(k, 0) + r.copies, expected.get(k, 0) + want, n.get(k, 0) + 1
            taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        for s, (_, target) in scale.items():
            assert abs(taken[s] - target) <= 600
    assert len({round(expected[k] / n[k], 6) for k in expected if k[0] == "c"}) == 3
    for k in counts:
        assert abs(counts[k] - expected[k]) <= 4 * (n[k] * 0.25) ** 0.5 + 1, (k, counts[k], expected[k])
