"""Packing documents into sequences of a fixed number of tokens.

Documents are dealt into groups by a digest (randomised, so groups look alike)
and each group is packed on its own: a document's full-length pieces fill
sequences by themselves, its rest goes first-fit decreasing into bins that a
tournament tree of free capacities finds in log time.  As documents may be cut
freely, the emptiest bins are then cut up to fill gaps of at least ``MIN_GAP``
tokens in the others, so a group ends with one sequence that is not full.

A group is streamed: full pieces leave at once, and ``GROUP_DOCS`` rests on average,
``4 * GROUP_DOCS`` at most, of under one sequence each wait for the packing.  Texts are
shuffled once; group, order and result depend on the rows alone, so a task that
is run again gives the same rows.

A null text is empty; every document ends with the end id, so an empty one is
a piece of one token; repeated rows are packed each on its own (they share a
group, which is then packed in parts); very long texts are cut into pieces as they
are; rests of equal length go by their order; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 1024
MIN_GAP = 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Tokenised at a time.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """text -> ids of the vocabulary file.

    Where the same vocabulary lies beside it as ranks, those are used (about five
    times as fast, same ids); texts that name a special token, or that the
    faster encoder refuses, go to the file's own tokenizer.
    """
    import json
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranked = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return plain
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    with open(ranked, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # a Rust panic is not an Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return plain(text)

    return encode


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item: largest first, each into the first bin with room (leftmost leaf of the tree that fits)."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item] = node - leaves
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def fill_gaps(bins: list[list[list[int]]], capacity: int, least: int = MIN_GAP) -> list[list[list[int]]]:
    """Cut the emptiest bins up to fill gaps of at least ``least`` in the others.  A piece is [document, start, length]."""
    load = lambda b: sum(p[2] for p in b)
    ordered = sorted(bins, key=lambda b: -load(b))
    loads = [load(b) for b in ordered]
    last = len(ordered) - 1
    for i, b in enumerate(ordered):
        gap = capacity - loads[i]
        while gap >= least and last > i:
            piece = ordered[last][-1]
            if piece[2] <= gap:
                ordered[last].pop()
                moved = piece
            else:
                piece[2] -= gap
                moved = [piece[0], piece[1] + piece[2], gap]
            b.append(moved)
            gap -= moved[2]
            loads[i] += moved[2]
            loads[last] -= moved[2]
            if not ordered[last]:
                last -= 1
        if last <= i:
            break
    return [b for b in ordered if b]


def _pack_group(group: int, rests: list[tuple[int | None, int, np.ndarray, int]], first_sequence: int, length: int) -> tuple[list[tuple], int]:
    """Pieces of a group's rests: (doc_id, start, ids, doc_tokens, sequence_id, offset), and the next sequence's number."""
    places = first_fit_decreasing([len(r[2]) for r in rests], length)
    bins: list[list[list[int]]] = [[] for _ in range(max(places, default=-1) + 1)]
    for item in sorted(range(len(rests)), key=lambda i: (-len(rests[i][2]), i)):
        bins[places[item]].append([item, 0, len(rests[item][2])])
    out, filled = [], fill_gaps(bins, length)
    for k, pieces in enumerate(filled):
        offset = 0
        for item, start, size in pieces:
            doc_id, before, ids, total = rests[item]
            out.append((doc_id, before + start, ids[start : start + size], total, group << 32 | first_sequence + k, offset))
            offset += size
    return out, first_sequence + len(filled)


def _packer(vocabulary: str, length: int):
    def run(batches):
        encode = _encoder(vocabulary)
        out: list[tuple] = []
        held = 0
        group, rests, sequences = None, [], 0
        for b in batches:
            for at in range(b.num_rows):
                g, doc_id = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                if g != group:
                    if group is not None:
                        out += _pack_group(group, rests, sequences, length)[0]
                    group, rests, sequences = g, [], 0
                ids = np.array(encode(b.column(2)[at].as_py()) + [END_ID], "<u4")
                total, start = len(ids), 0
                while total - start >= length:
                    out.append((doc_id, start, ids[start : start + length], total, group << 32 | sequences, 0))
                    sequences, start = sequences + 1, start + length
                if start < total:
                    rests.append((doc_id, start, ids[start:].copy(), total))
                    if len(rests) >= 4 * GROUP_DOCS:  # equal rows share a group: however many there are, a bounded number waits
                        done, sequences = _pack_group(group, rests, sequences, length)
                        out += done
                        rests = []
                held += total
                if held > BATCH_BYTES // 4:
                    yield from _pieces(out)
                    out, held = [], 0
        if group is not None:
            out += _pack_group(group, rests, sequences, length)[0]
        yield from _pieces(out)

    return run


def _pieces(rows: list[tuple], step: int = 1024):
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in some], pa.int64()),
                pa.array([r[1] for r in some], pa.int64()),
                pa.array([len(r[2]) for r in some], pa.int64()),
                pa.array([r[2].tobytes() for r in some], pa.binary()),
                pa.array([r[3] for r in some], pa.int64()),
                pa.array([r[4] for r in some], pa.int64()),
                pa.array([r[5] for r in some], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, text: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit) and place: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    row = F.xxhash64(F.lit("pack"), "doc_id", "text")
    dealt = source.withColumn("row", row).select(F.pmod(F.col("row"), F.lit(groups)).alias("grp"), "doc_id", "text", "row")
    ordered = dealt.repartition("grp").sortWithinPartitions("grp", "row", "doc_id")
    return ordered.mapInArrow(_packer(vocabulary, length), SCHEMA)
