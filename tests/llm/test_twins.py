import duckdb
import pytest

from stacksight.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op6_minhash_near_dedup", "op8_recompression", "op11_source_divergence", "op13_centroid_clustering"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op6_minhash_near_dedup", "op8_recompression"])
def test_sql_of_no_documents(name):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    assert con.execute(queries.ORACLE_SQL[name]).fetchall() == []
    con.execute("insert into documents values (1, null), (2, ''), (3, ' \n\t '), (4, 'Ünï cödé')")
    assert len(con.execute(queries.ORACLE_SQL[name]).fetchall()) == 4
