import random
from collections import defaultdict

import numpy as np
import xxhash
from namelink.llm import queries, simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """doc index -> smallest index reachable, over links of at most three bits."""
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{fp:016x}", rows[c].doc_id) for r, fp, c in zip(rows, fps, plain_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf).collect()}
    assert got == want


def test_dense_and_hot_keys(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 900:  # one cloud sharing a segment, one without structure, chains
        fps.add(centre ^ sum({1 << rng.randrange(0, 24) for _ in range(rng.randrange(1, 6))}))
    while len(fps) < 1100:
        fps.add(rng.getrandbits(64))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = defaultdict(set)
    for i, c in enumerate(plain_components(fps)):
        want[c].add(signed[i])
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for hot in (simhash.HOT, 50):
        monkeypatch.setattr(simhash, "HOT", hot)
        frame = spark.createDataFrame([(s,) for s in signed], "fp long")
        found = simhash.components(simhash.links(frame)).collect()
        got = defaultdict(set)
        for r in found:
            got[r.root].add(r.node)
        assert {frozenset(v) for v in got.values()} == want


def test_table_span_equals_search():
    rng = random.Random(1)
    fps = np.array(sorted({rng.getrandbits(14) << 20 for _ in range(600)}), np.uint64)
    a, b = simhash._span_by_table(fps)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    c, d = simhash.span(fps)
    assert len(a) == len(c)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (None, "one two"), (6, "ÀB c d"), (6, "ÀB c d"), (7, "x " * 70000)]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    out = simhash.groups(frame).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == "0" * 16 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[4].component_id == by[5].component_id == by[None].component_id == 4
    assert by[6].fingerprint == f"{plain_fingerprint('ÀB c d'):016x}"
    assert by[7].fingerprint == f"{plain_fingerprint('x ' * 70000):016x}"
    assert simhash.groups(frame.limit(0)).count() == 0
