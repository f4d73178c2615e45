from namelink.llm import quality


def plain(text):
    words = (text or "").split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", "  \n ", "one", "a b c a b c", "a a a a a", "x # $$ | <b>", "l m\nl m\n\nl m \nl m", "é è ê é è ê é",
    " ".join(f"w{i % 70}" for i in range(300)), " ".join(f"w{i}" for i in range(100)), "q " * 5000,
]


def test_measurements(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "y"), (None, "a b", None)], "doc_id long, text string, n_words string")
    out = quality.ledger(frame).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)


def test_scan_and_sort_agree(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    monkeypatch.setattr(quality, "SCAN_WINDOWS", 0)
    for r in quality.measure(frame).collect():
        assert r.n_repeat_words == plain(TEXTS[r.doc_id])[-1]


def test_policies_and_ablation(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    frame = spark.createDataFrame([(0, clean), (1, "a b"), (2, "q " * 80), (3, clean + " #" * 60)], "doc_id long, text string")
    entries = quality.ledger(frame)
    policy = quality.POLICIES["2024-1"]
    assert {r.doc_id for r in entries.where(~quality.rejects(policy)).collect()} == {0}
    assert {r.doc_id for r in entries.where(~quality.rejects(quality.BASE)).collect()} == {0, 3} - {3 for r in entries.collect() if r.doc_id == 3 and r.failed & 3}
    report = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(entries, policy).collect()}
    assert report["few_words"][0] == 1 and report["symbols"][0] == 1
    kept = quality.keep_documents(frame.withColumn("failed", frame.doc_id))
    assert kept.columns == ["doc_id", "text", "failed"] and [r.doc_id for r in kept.collect()] == [0]
    assert quality.ledger(frame.limit(0)).count() == 0
