"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of at most three
differing bits, one segment holds at most one, so each fingerprint is indexed
under its one-wildcard variants (segment, position, segment with that bit
cleared): two fingerprints within three bits share a key.  Keys meet by an
equality shuffle; candidates are verified by popcount.

Only distinct fingerprints are indexed, so copies cost one row.  A key shared
by many fingerprints emits a spanning forest of its verified links, never all
pairs.  A key above ``HOT`` members is dealt out again under variants of the
other segment's halves; such a group shares at least 46 of its 64 bits, so it
cannot exceed 2^18 members whatever the input, and is spanned by table lookups.
Every link between different fingerprints is covered by a path of links.

Null and empty texts have no words and fingerprint zero; a text of one or two
words hashes its whole sequence; repeated rows share a fingerprint; an empty
table gives an empty result; extra columns are not read.  A component's id is
its smallest non-null doc_id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, components, hint_by_size, keyed, materialize, own_keys

SEED = 42
MAX_BITS = 3
HOT = 2048
CHUNK = 255 * 128
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """A bit is 1 if set in over half of the shingle hashes (XXH64, seed 42), repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, SEED), "big")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    first, last = starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    n = len(first)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        packed = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])])
        counts += _bit_counts(packed)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(packed: bytes) -> np.ndarray:
    """How often each bit is set over 8-byte digests, most significant first; 255 digests are summed per byte lane."""
    values = np.frombuffer(packed, "<u8")
    padded = np.zeros(-(-len(values) // 255) * 255, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, 255)
    out = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = ((blocks >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        out[:, 7 - k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long): the fingerprint of each whole text, as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [_signed(fingerprint(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _variants(batches):
    """Each fingerprint under its 64 keys: segment, wildcard position, segment with that bit cleared."""
    position = np.arange(32, dtype=np.uint64)
    clear = ~(np.uint64(1) << position) & np.uint64(0xFFFFFFFF)
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b.column(0).slice(at, 4096).to_numpy().view(np.uint64)
            keys = []
            for seg in (0, 1):
                part = (fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
                keys.append(((np.uint64(32 * seg) + position) << np.uint64(32)) | (part[:, None] & clear))
            key = np.hstack(keys).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], ["key", "fp"])


def _refined(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of a hot key under the one-wildcard variants of the other segment's 16-bit halves."""
    seg = key >> 37
    other = (fp >> np.uint64(0 if seg else 32)) & np.uint64(0xFFFFFFFF)
    position = np.arange(16, dtype=np.uint64)
    clear = ~(np.uint64(1) << position) & np.uint64(0xFFFF)
    keys = []
    for half in (0, 1):
        part = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        tail = ((np.uint64(16 * half) + position) << np.uint64(16)) | (part[:, None] & clear)
        keys.append((np.uint64(key) << np.uint64(21)) | tail)
    return np.hstack(keys).reshape(-1), np.repeat(fp, 32)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def span(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    if len(fp) > 2 * HOT:
        return _span_by_table(fp)
    rest, left, right = fp, [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = _near(rest, at)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), at))
                right.append(found)
                frontier.extend(found)
                rest = rest[~hit]
    return _joined(left), _joined(right)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _span_by_table(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``span``, for many fingerprints that differ in few positions: neighbours are looked up, not compared."""
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    places = [i for i in range(64) if varying >> i & 1]
    masks = [0]
    for a, i in enumerate(places):
        masks.append(1 << i)
        for b, j in enumerate(places[:a]):
            masks.append(1 << i | 1 << j)
            masks.extend(1 << i | 1 << j | 1 << k for k in places[:b])
    masks = np.array(masks[1:], np.uint64)
    ordered = np.sort(fp)
    seen = np.zeros(len(ordered), bool)
    left, right = [], []
    for start in range(len(ordered)):
        if seen[start]:
            continue
        seen[start] = True
        frontier = ordered[start : start + 1]
        while len(frontier):
            following = []
            for at in range(0, len(frontier), 256):
                some = frontier[at : at + 256]
                near = (some[:, None] ^ masks).reshape(-1)
                index = np.searchsorted(ordered, near)
                index[index == len(ordered)] = 0
                ok = (ordered[index] == near) & ~seen[index]
                index, first = np.unique(index[ok], return_index=True)
                seen[index] = True
                left.append(np.repeat(some, len(masks))[ok][first])
                right.append(ordered[index])
                following.append(ordered[index])
            frontier = _joined(following)
    return _joined(left), _joined(right)


def _runs(key: np.ndarray, fp: np.ndarray, level: int):
    """Links within runs of equal keys; ``key`` is sorted."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    for size in np.unique(sizes):
        if size < 2:
            continue
        at = starts[sizes == size]
        if size <= 8:
            for i in range(size):
                for j in range(i + 1, size):
                    a, b = fp[at + i], fp[at + j]
                    ok = _near(a, b)
                    if level == 1:
                        ok &= _first_key(key[at], a, b)
                    left.append(a[ok])
                    right.append(b[ok])
        else:
            for s in at:
                a, b = span(fp[s : s + size])
                left.append(a)
                right.append(b)
    return _joined(left), _joined(right)


def _first_key(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the keys that a pair shares in a segment, the one that links it: a pair with equal segments shares all 32."""
    place = key >> np.uint64(32)
    shift = np.where(place >= 32, 32, 0).astype(np.uint64)
    differs = ((a ^ b) >> shift) & np.uint64(0xFFFFFFFF)
    return (differs != 0) | (place % np.uint64(32) == 0)


def _rows(kind: int, a: np.ndarray, b: np.ndarray):
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["kind", "a", "b"]
        )


def _linker(level: int):
    """Links (kind 0) of a stream sorted by key; at level 1 members of hot keys come back as (kind 1, finer key, fp)."""

    def run(batches):
        key = fp = np.empty(0, np.uint64)
        hot = None
        for b in batches:
            k, f = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if hot is not None:
                n = int(np.searchsorted(k, hot, "right")) if len(k) and k[0] == hot else 0
                if n:
                    yield from _rows(1, *_refined(int(hot), f[:n]))
                    k, f = k[n:], f[n:]
                if len(k):
                    hot = None
                else:
                    continue
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            yield from _big_or_small(level, key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if level == 1 and len(key) > HOT:
                hot = key[0]
                yield from _rows(1, *_refined(int(hot), fp))
                key = fp = np.empty(0, np.uint64)
        yield from _big_or_small(level, key, fp)

    return run


def _big_or_small(level: int, key: np.ndarray, fp: np.ndarray):
    if not len(key):
        return
    if level == 1:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= HOT, sizes)
        for s, n in zip(starts[sizes > HOT], sizes[sizes > HOT]):
            yield from _rows(1, *_refined(int(key[s]), fp[s : s + n]))
        key, fp = key[small], fp[small]
    if len(key):
        yield from _rows(0, *_runs(key, fp, level))


def links(fps: DataFrame) -> DataFrame:
    """(a long, b long): verified links that connect all of ``fps`` (fp long, distinct) within three bits."""
    schema = "kind int, a long, b long"
    keyed = fps.select("fp").mapInArrow(_variants, "key long, fp long")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(1), schema), "simhash-links")
    plain = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    finer = hot.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(2), schema)
    return plain.union(finer.select("a", "b"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, fp) for every row of ``docs``."""
    by_doc = materialize(fingerprints(docs, text, doc_id), "simhash-fp")
    distinct = materialize(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct))
    root_ids = roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(root_ids, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("_linked"), F.lit(True).alias("_has"))
    known = distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("_has"), F.col("_linked")).otherwise(F.col("least")).alias("component_id")
    )
    # Written first: with a plain exchange on either side Spark splits a fingerprint that many copies share.
    known = materialize(known, "simhash-known")
    return by_doc.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each component the document with the smallest id stays, all columns as they were.

    Rows without a doc_id, or whose doc_id other rows have too, go by a hash of id
    and text (``keyed``), and of rows equal in both one stays.
    """
    known = keyed(docs, text=text)
    rows = known.select(KEY, F.struct(*[known[f"`{c}`"] for c in docs.columns]).alias("_row"))
    found = groups(rows.select(F.col(KEY).alias("doc_id"), F.col(f"_row.`{text}`").alias("text")))
    removed = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_removed")).distinct(), "simhash-removed")
    kept = rows.join(hint_by_size(removed), F.col(KEY) == F.col("_removed"), "left_anti")
    others = kept.where(own_keys(KEY))
    if others.isEmpty():
        return kept.select("_row.*")
    equal = others.select(KEY, "_row", F.col(f"_row.`{text}`").alias("_text"), F.col("_row.doc_id").alias("_id")).dropDuplicates([KEY, "_text", "_id"])
    return kept.where(~own_keys(KEY)).select("_row").union(equal.select("_row")).select("_row.*")
