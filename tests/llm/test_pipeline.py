import corpus_pipeline
from stacksight.llm import common, decontaminate
from tests.llm import brute
from tests.llm.test_decontaminate import brute as leaks

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    known, kept, distinct, short, clean = texts
    assert len(kept) >= 0.9 * len(known) and all(t is not None and any(c.isalpha() for c in t) for t in kept.values())
    groups = brute.near_duplicates(kept, 5)
    assert set(distinct) == {d for d, (_, c) in groups.items() if c == d} and len(distinct) < len(kept)
    want = brute.substring_dedup(distinct)
    for d, t in short.items():
        if want[d][1] == 0:
            assert t == distinct[d]
        else:
            assert abs(len(t.encode()) - (want[d][0] - want[d][1])) <= 6 * want[d][2]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    some = {d: short[d] for d in sorted(short)[:60]}
    assert {d for d, _ in leaks(some, items)} == set(some) - set(clean)
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(clean)


def test_run_and_odd_documents(spark, tmp_path):
    text = "The cat and the dog are in the house with the old man and his boat. " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, text, "en", "s", 1), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5), (5, text, "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1}
