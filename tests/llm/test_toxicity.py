import math

import numpy as np

from stacksight.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    out = labels.where("doc_id % 3 = 0 and toxic is not null")
    got = toxicity.predict(docs.join(out.select("doc_id"), "doc_id", "left_semi"), model).join(out, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) > 20
    # about one toxic label in fifteen lies on a text without any toxic word
    assert sum(r.toxic_pred for r in toxic) >= 0.92 * len(toxic) and sum(r.toxic_pred for r in clean) <= 0.02 * len(clean)
    assert min(sum(r.severity for r in toxic) / len(toxic), 1.0) > 5 * sum(r.severity for r in clean) / len(clean)
    assert all(0 <= r.severity <= 2 and abs(r.severity - r.p_mild - 2 * r.p_severe) < 1e-9 for r in got)


def test_odd_rows(spark):
    rows = [(k, "nasty vile words here" if k % 2 else "a calm and kind text of the day", 0) for k in range(40)] + [(100, None, 0), (101, "", 0), (102, "nasty vile " + "kind day " * 150000, 0), (None, "nasty", 0), (1, "nasty vile words here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (100, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxic_pred for r in toxicity.predict(docs, model).collect()}
    assert all(got[k] == bool(k % 2) for k in range(40)) and not got[100] and not got[101] and None not in got
    assert toxicity.predict(docs, model).count() == len(rows) - 1 and toxicity.predict(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r.severity for r in toxicity.predict(docs, nothing).collect()) < 1e-6


def test_fit_by_brute_force():
    """The weights are a stationary point of the penalised likelihood, which is counted here document by document."""
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 22, 60)
    docs = [r.choice(words[:40], r.integers(1, 12)) if k % 3 else np.append(r.choice(words[:40], 4), r.choice(words[40:], r.integers(1, 5))) for k in range(240)]
    toxic = np.array([k % 3 == 0 for k in range(240)])
    model = toxicity.fit(docs, toxic, steps=4000)

    def grades():
        totals = [sum(math.log1p(int((d == f).sum())) for f in model.features) for d in docs]
        middle = sorted(t for t, x in zip(totals, toxic, strict=True) if x)
        middle = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
        return [0 if not x else 1 + (t > middle) for t, x in zip(totals, toxic, strict=True)]

    known = grades()

    def loss(weights, thresholds):
        out = 0.5e-3 * sum(w * w for w in weights)
        for d, x, g in zip(docs, toxic, known, strict=True):
            z = sum(w * math.log1p(int((d == f).sum())) for w, f in zip(weights, model.features, strict=True))
            below = [0.0, *(1 / (1 + math.exp(-(t - z))) for t in thresholds), 1.0]
            out -= 0.5 / (toxic.sum() if x else (~toxic).sum()) * math.log(below[g + 1] - below[g])
        return out

    best = loss(model.weights, model.thresholds)
    for k in range(0, len(model.weights), 3):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model.weights, moved) > best - 1e-5


def test_prediction_by_brute_force(spark):
    """Expected grades of whole texts, counted word by word."""
    rows = [(k, "nasty vile words here nasty" if k % 2 else "a calm and kind text of the day") for k in range(40)] + [(50, "Nasty, vile! kind"), (51, "x"), (52, "nasty " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    for r in toxicity.predict(docs, model).collect():
        data = np.frombuffer(dict(rows)[r.doc_id].encode(), np.uint8)
        _, word = toxicity.words(data, np.array([0, len(data)]))
        z = sum(w * math.log1p(int((word == f).sum())) for w, f in zip(model.weights, model.features, strict=True))
        above = [1 - 1 / (1 + math.exp(-(t - z))) for t in model.thresholds]
        assert abs(r.severity - sum(above)) < 1e-6 and abs(r.p_severe - above[1]) < 1e-6 and r.toxic_pred == (above[0] >= 0.5)
