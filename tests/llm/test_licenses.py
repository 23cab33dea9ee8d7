import duckdb

from stacksight.llm import licenses


def rows(df):
    return sorted((r.doc_id, r.template, r.n_shingles, r.n_found) for r in df.collect())


def test_scan_matches_sql(spark):
    table = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{table}'")
    want = sorted((r[0], r[1], r[3], r[4]) for r in con.execute(licenses.oracle_sql()).fetchall())
    assert rows(licenses.scan(spark.read.parquet(table))) == want and want


def test_changed_texts_and_odd_rows(spark):
    text = {t[0]: t[2] for t in licenses.TEMPLATES}
    mit = text["mit-text"].split()
    mit[10] = mit[40] = "changed"
    broken = " ".join(w for k, w in enumerate(mit) if k % 4)
    data = [
        (1, "intro words here " + " ".join(mit) + " and more", 1), (2, broken, 1), (3, None, 1), (4, "", 1), (5, "MIT License", 1),
        (6, "x\nRELEASED  under the\tMIT license!\ny", 1), (None, text["isc-text"], 1), (8, text["isc-text"], 1), (8, text["isc-text"], 1),
        (9, "word " * 30000 + text["gpl-header"], 1),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, license long")
    got = licenses.scan(docs)
    assert {(a, b) for a, b, _, _ in rows(got)} == {(1, "mit-text"), (6, "mit-line"), (8, "isc-text"), (9, "gpl-header")}
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, []).count() == 0
