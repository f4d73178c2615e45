import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from namelink.llm import packing, queries
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, length=2048):
    """Pieces tile their documents, sequences are gapless; returns the padding and the sequences."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = sorted((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length
        by_doc[r.doc_id].append((r.start, tuple(ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    got = sorted((i, tuple(x for _, p, _ in sorted(parts) for x in p)) for i, parts in by_doc.items())
    assert got == want
    for i, parts in by_doc.items():
        assert {p[2] for p in parts} == {sum(len(p[1]) for p in parts)}
    pad = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        pad += length - at
    return pad, len(by_sequence)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), VOCABULARY).collect()
    pad, n = check(rows, docs)
    assert pad < 2048 + 0.02 * n * 2048
    out = queries.op6_packing(spark, sf).collect()
    ids = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in out} == ids


def test_edges(spark):
    odd = "<|endoftext|> x <|endoftext|>"
    docs = [(1, None), (2, ""), (3, odd), (4, "a" * 30000), (5, " " * 9000 + "z"), (6, "日本語 🙂 été\n\n\t x" * 700)]
    frame = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, ids string")
    check(packing.pack(frame, VOCABULARY, group_docs=2).collect(), docs)
    assert packing.pack(frame.limit(0), VOCABULARY).count() == 0
    twice = packing.pack(frame.where("doc_id = 6").union(frame.where("doc_id = 6")), VOCABULARY).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    assert packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), VOCABULARY).collect()[0].doc_id is None


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))]
        free, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit_decreasing(sizes, 100) == want
        bins = [[] for _ in free]
        for i, k in enumerate(want):
            bins[k].append([i, 0, sizes[i]])
        filled = packing.fill_gaps(bins, 100, 1)
        assert sum(p[2] for b in filled for p in b) == sum(sizes) and all(sum(p[2] for p in b) <= 100 for b in filled)
        assert len(filled) == -(-sum(sizes) // 100)
