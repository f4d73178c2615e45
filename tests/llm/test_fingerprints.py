import hashlib
import unicodedata

from namelink.llm import fingerprints, queries


def plain(rows):
    """rows: (doc_id, text) in order; canonical forms are compared as they are."""
    form = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out[doc_id] = (len(text), sha, float(form(text) == form(changed)), float(form(text) == form(following)), form(text), form(changed))
    return out


def compare(got, want):
    assert len(got) == len(want)
    names = {}
    for r in got:
        n, sha, edited, following, form, changed = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, edited, following), r.doc_id
        for f, name in ((form, r.fingerprint), (changed, r.edited_fingerprint)):
            assert names.setdefault(f, name) == name
    assert len(set(names.values())) == len(names)


def test_query(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 16)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    compare(queries.op2_fingerprints(spark, sf).collect(), plain(rows))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    rows = [(None, "first"), (-5, None), (3, ""), (4, "Straße  ﬁn"), (5, "STRASSE fin "), (9, "x" * 100_001), (10, "é🙂" * 3)]
    frame = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = fingerprints.fingerprint(frame).collect()
    compare(got, plain(rows))
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[4] == by[5] and by[-5] == by[3]
    one = fingerprints.fingerprint(frame.where("doc_id = 4")).collect()
    compare(one, plain([(4, rows[3][1])]))
    assert fingerprints.fingerprint(frame.limit(0)).count() == 0
    assert fingerprints.fingerprint(frame.union(frame)).count() == 14
    assert fingerprints.fingerprint(frame.where("doc_id is null")).count() == 1


def test_buckets_are_compared(spark):
    rows = [(i, f"text {i % 40}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame, digits=1).collect()}
    assert len(set(got.values())) == 40 and all(got[i] == got[i % 40] for i in range(60))
    assert any("-" in f for f in got.values())
