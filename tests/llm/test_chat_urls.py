import duckdb
from namelink.llm import chat, queries, urls


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (2, 0, "user", "hi", "x"), (2, 1, "assistant", "yo", "x"), (3, 0, "user", "hi", "x"), (3, 1, "assistant", "yo", "x"),
        (3, 2, "user", None, "x"), (4, 0, "user", "other <|im_end|>", "x"), (5, 0, "user", "other <|im_end|>", "x"), (None, 1, None, "b", "x"), (None, 0, "user", "a", "x"),
        (6, 0, "use", "rhi", "x"), (7, 5, "user", "hi", "x"), (7, 5, "user", "hi", "x"), (8, None, "user", "z" * 100_000, "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefix string")
    out = {r.conv_id: r for r in chat.render(frame, chat.maximal(frame)).collect()}
    assert set(out) == {3, 4, None, 6, 7, 8}
    assert out[3].n_turns == 3 and out[3].n_equal == 1 and out[4].n_equal == 2
    assert out[4].text == "<|im_start|>user\nother < |im_end|><|im_end|>\n"
    assert out[None].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>\nb<|im_end|>\n"
    assert chat.render(frame.limit(0), chat.maximal(frame.limit(0))).count() == 0


def as_rows(rows):
    return sorted(map(repr, rows))


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in ("op1_mixing", "op5_quality", "op8_chat", "op9_urls"):
        got = queries.queries()[name](spark, sf)
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert as_rows(tuple(r[c] for c in names) for r in got.collect()) == as_rows(cursor.fetchall()), name


def test_urls(spark):
    rows = [
        (1, "http://Sub.Example.COM/en/71?x", "example.com/en/7", "allow"), (2, "http://a.com/en/5", "com/en/", "block"), (3, "x://a.com/EN/5", None, "allow"),
        (4, "http://example.net/de/81", "example.net/de/8", "block"), (5, "http://b.net/de/9#f", "net/de/", "allow"), (6, "http://b.net", None, "allow"),
        (7, "http://b.net/", None, "allow"), (8, None, None, "allow"), (9, "no scheme.com/en/", None, "allow"), (10, "a://b://c.com/en/1", None, "allow"),
        (11, "http://myexample.com/en/7", "com/en/", "block"), (12, "http://a.org/es/\n1", "org/es/", "block"), (12, "http://a.org/es/\n1", "org/es/", "block"),
    ]
    bad = [(100 + k, f"http://farm.edu/deals/{k}", None, "block") for k in range(40)] + [(200 + k, f"http://farm.edu/news/{k}", None, "allow") for k in range(40)]
    wild = [(300 + k, f"http://w.edu/{chr(97 + k)}{chr(98 + k)}x/y", None, "allow") for k in range(24)]
    frame = spark.createDataFrame([r[:2] + ("c",) for r in rows + bad + wild], "page_id long, url string, host string")
    labels = spark.createDataFrame([(r[0], int(100 <= r[0] < 140)) for r in bad if r[0] % 2 == 0], "page_id long, bad int")
    out = urls.judge(frame, labels, queries.URL_RULES).collect()
    assert len(out) == len(rows + bad + wild)
    by = {r.page_id: r for r in out}
    for page, _, rule, verdict in rows + bad + wild:
        assert (by[page].rule, by[page].verdict) == (rule, verdict), page
    assert by[1].host == "sub.example.com" and by[1].path == "/en/71" and by[8].host == by[9].path == ""
    assert (by[10].host, by[10].path) == ("b:", "//c.com/en/1") and by[3].path == "/EN/5"
    assert by[301].template == by[302].template
    assert urls.judge(frame.limit(0), labels, queries.URL_RULES).count() == 0


def plain_tree(paths):
    """One host's shapes by definition: {shape: marks}, wildcards where at least 20 values occur less than 5 times each."""
    split = {p: ["/" + x for x in p.split("/")[1:]] for p in paths}
    marks = {p: [] for p in paths}
    for level in range(max(map(len, split.values()), default=0)):
        nodes = {}
        for p, segments in split.items():
            if len(segments) > level:
                nodes.setdefault(tuple(marks[p]), {}).setdefault(segments[level], []).append(p)
        for values in nodes.values():
            wild = len(values) >= 20 and len(values) * 5 > sum(paths[p] for ps in values.values() for p in ps)
            for value, ps in values.items():
                for p in ps:
                    marks[p].append("/*" if wild else value)
    return marks


def test_deep_paths(spark):
    """A variable third segment hides neither the good nor the bad branch below it; very deep paths keep their rest as one segment."""
    rows, labels = [], []
    for k in range(60):
        for leaf, bad in (("spam", 1), ("ok", 0)):
            rows.append((len(rows), f"http://s.edu/shop/items/{chr(97 + k % 26)}{chr(97 + k // 26)}q/{leaf}"))
            if k % 2:
                labels.append((rows[-1][0], bad))
    deep = "/".join(["d"] * 300)
    rows += [(1000, f"http://s.edu/{deep}/x"), (1001, f"http://s.edu/{deep}/y"), (1002, "http://long.edu/" + "z" * 200_000), (1003, "http://s.edu/shop/items/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"), ()).collect()}
    assert len(out) == len(rows)
    assert all(out[i].verdict == ("block" if url.endswith("spam") else "allow") for i, url in rows)
    assert out[0].template == "s.edu/shop/items/*/spam"
    counts = {"/" + r[1].split("/", 3)[3]: 1 for r in rows if "s.edu" in r[1] and r[0] < 1000}
    grown, levels = urls._grow(spark.createDataFrame([("s.edu", p, n, 0, 0) for p, n in counts.items()], "host string, shape string, n long, labelled long, bad long"))
    assert levels == 4 and {r["shape"]: r["marks"] for r in grown.collect()} == plain_tree(counts)
