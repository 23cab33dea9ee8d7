import math

import numpy as np

from stacksight.llm import language

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 4000")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    known = docs.select("doc_id", "lang", language.held_out().alias("out")).where("out and lang is not null").collect()
    right = sum(got[r.doc_id].lang_pred == r.lang for r in known if got[r.doc_id].lang_pred != "und")
    said = sum(got[r.doc_id].lang_pred != "und" for r in known)
    assert said > 0.95 * len(known) and right >= 0.99 * said
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = language.predict(docs, language.train(docs)).select("doc_id", "lang_pred").collect()
    hidden = docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["when"]).when(~language.held_out(), docs.lang).otherwise("xx"))
    assert sorted(a) == sorted(language.predict(docs, language.train(hidden)).select("doc_id", "lang_pred").collect())


def test_odd_rows(spark):
    text = "Der Hund und die Katze sind im Haus und der alte Mann ist nicht da. "
    rows = [(4, text * 3, "de", 0.5), (8, text * 5, "de", 0.1), (12, "The dog and the cat are in the house with the old man. " * 3, "en", 0.0), (16, None, "de", 1.0), (20, "", "en", 1.0), (24, "123 -- 45", None, 1.0), (24, text, None, 1.0), (None, text, "de", 1.0), (28, text * 40000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(docs)
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in language.predict(docs, model).collect())
    assert got == [(4, "de", False), (8, "de", False), (12, "en", False), (16, "und", True), (20, "und", True), (24, "de", False), (24, "und", True), (28, "de", False)]
    kept = language.kept_documents(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 8, 12, 24, 28]
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"} and language.predict(docs.limit(0), model).count() == 0


def test_rejection_by_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    strange = [(1, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 4), (2, "xqzv wkjq zzxq vvkq jjqx qwzx kxqj zvqk " * 4), (3, "いろはにほへと ちりぬるを わかよたれそ つねならむ " * 4)]
    odd = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in strange], docs.schema)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(odd, model).collect()}
    assert all(rejected for _, rejected in got.values()) and len(got) == 3
    assert language.kept_documents(odd, model).count() == 0
    known = language.predict(docs, model).where("lang_pred <> 'und'")
    assert known.where("rejected").count() <= 0.01 * known.count()


def test_prediction_by_brute_force(spark):
    """Every text against every centroid, in plain Python from the text's own n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    model = language.train(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        counts = language.gram_counts(data, np.array([0, len(data)]))[0]
        x = {k: math.log1p(float(n)) * float(model.idf[k]) for k, n in enumerate(counts) if n}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        cosines = [sum(v / norm * float(c[k]) for k, v in x.items()) for c in model.centroids]
        best = max(cosines)
        if not any(ch.isalpha() for ch in text or ""):
            assert got[doc].lang_pred == "und"
            continue
        assert abs(got[doc].score - min(1, max(0, best))) < 1e-4
        near = [k for k, v in enumerate(cosines) if v > best - 1e-5]
        assert got[doc].lang_pred in {model.languages[k] for k in near}
        assert got[doc].rejected == (best < model.floor[near[0]]) or abs(best - model.floor[near[0]]) < 1e-4
