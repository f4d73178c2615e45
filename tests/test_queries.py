import os
import unicodedata

import __spark_entry__ as entry_points
import duckdb
import pytest
from namelink import queries, queries_sql

CHEAP = ["normalize", "mappings", "blocks", "allocation", "capped", "leaders", "components", "confusion", "guard", "category_counts", "histogram", "set_operations", "resolve", "percentiles", "cosine", "fold", "indel", "hac_distances"]


def text(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    cursor = con.execute(queries_sql.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted([text(r[c]) for c in columns] for r in got.collect()) == sorted([text(v) for v in r] for r in cursor.fetchall())


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_set_operations_over_all_vectors(spark, sf):
    rows = queries.labelled_groups(spark, sf).collect()
    pairs_by = lambda k: {(a["ord"], b["ord"]) for a in rows for b in rows if a["ord"] < b["ord"] and a[k] == b[k] and a[k] is not None}
    p, t = pairs_by("group_id"), pairs_by("truth")
    got = {r.kind: r.n for r in queries.queries()["set_operations"](spark, sf).collect()}
    assert len(rows) > 200 and got == {"both": len(p & t), "only_predicted": len(p - t), "only_true": len(t - p), "either": len(p | t)}


def test_fold_of_every_document(spark, sf, tmp_path):
    several = {"ß": "ss", "æ": "ae", "œ": "oe", "ж": "zh", "щ": "shch", "ю": "iu", "λ": "l", "д": "d", "о": "o", "м": "m", "ø": "o"}

    def plain(t):
        out = []
        for c in t:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            out.append(several.get(c.lower()) or several.get(base.lower()) or (base if base.isascii() else c))
        return "".join(out).lower()

    rows = [(1, "de", "Übergröße 12, Äpfel!\nÖl"), (2, "en", "ŒUVRE Æther naïve É"), (3, "ru", "Дом ЖЩЮ λ Øre"), (4, "fr", "été 3: où?"), (5, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf):
        want = {r.doc_id: None if r.text is None else plain(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        assert {r.doc_id: r.folded for r in queries.queries()["fold"](spark, d).collect()} == want
