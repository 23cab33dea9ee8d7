import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksight.llm import prefix_forest


def brute(rows, k=10):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - ok[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = found(prefix_forest.search(d)), brute([(r.vec_id, r.embedding) for r in d.collect()])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    print("recall", hits / sum(map(len, want.values())))
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q in want for i, s in got[q] if i in exact[q])


def test_equal_vectors_and_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 1300)] + [(i, r.standard_normal(3).tolist()) for i in range(2000, 2400)]
    rows += [(5000, None), (5100, [0.0, 0.0, 0.0]), (5200, [1.0, None, 2.0]), (5300, [1.0, float("nan"), 2.0]), (5400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(prefix_forest.search(d)), brute([x for x in rows if x[0] is not None])
    assert got.keys() == want.keys()
    assert [i for i, _ in got[300]] == list(range(10)) and [i for i, _ in got[0]] == list(range(1, 11))
    assert got == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in want.items()}


def test_recall_without_structure(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((9000, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    got, want = found(prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    print("recall without structure", hits / sum(map(len, want.values())))
    assert hits >= 0.92 * sum(map(len, want.values()))


def test_clusters_of_near_copies(spark):
    """A third of all vectors lie in one tight group, others in pairs: nearest ones are much nearer than the rest."""
    r = np.random.default_rng(3)
    one = r.standard_normal(16)
    x = np.concatenate((one + 1e-3 * r.standard_normal((1000, 16)), np.repeat(r.standard_normal((1000, 16)), 2, axis=0) + 0.01 * r.standard_normal((2000, 16))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1)), brute(rows, 1)
    assert got.keys() == want.keys()
    assert sum(got[q][0][0] == want[q][0][0] for q in want) >= 0.9 * len(want)


def test_met_at_is_what_strings_show():
    r = np.random.default_rng(4)
    a, b = r.standard_normal((2, 300, 24))
    cosine = 0.6
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = cosine * a + 0.8 * b / np.linalg.norm(b, axis=1)[:, None]
    met = prefix_forest.met_at(np.array([cosine]))[0]
    differ = np.frexp((prefix_forest.strings(a, 64) ^ prefix_forest.strings(b, 64)).astype(float))[1]
    for level in (1, 4, 5, 8, 12):
        assert abs((prefix_forest.BITS - differ >= level).mean() - met[level]) < 0.03


def test_each_entry_lies_once_in_each_tree(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(6).tolist(), i % 400 == 0) for i in range(1200)]
    entries = spark.createDataFrame(rows, "entry long, vector array<double>, asked boolean").coalesce(1)
    array, bounds, counts = prefix_forest.nodes(entries, np.zeros(6), 4)
    each = array.select("part", "block", F.explode("entries").alias("entry"))
    assert [r["count"] for r in each.groupBy("entry").count().select("count").distinct().collect()] == [4]
    assert each.count() == sum(counts) == 4800 and array.count() == array.select("part", "block").distinct().count()
    assert max(r.n for r in array.select(F.size("entries").alias("n")).collect()) == prefix_forest.BLOCK
    levels = prefix_forest.BITS
    assert bounds.count() == bounds.distinct().count() == 3 * 2 * (4 * levels + 1)


def test_ascending_offers_each_place_once(spark):
    """What a higher node offers without the lower one, and what the lower one offers, is what the higher one offers; parts and blocks do not matter."""
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(6).tolist(), i % 300 == 0) for i in range(1500)]
    entries = spark.createDataFrame(rows, "entry long, vector array<double>, asked boolean").coalesce(1)
    array, bounds, counts = prefix_forest.nodes(entries, np.zeros(6), 5)
    asked = entries.where("asked").select(F.col("entry").alias("query"))
    at = lambda level: asked.select("query", F.lit(level).alias("level"))
    offers = lambda *levels: sorted(tuple(x) for x in prefix_forest._offered(array, bounds, counts, *levels).collect())
    strings = prefix_forest.strings(np.array([x[1] for x in rows]), 5)
    for high, low in ((0, 9), (2, 7), (4, 5), (1, prefix_forest.BITS)):
        whole = offers(at(high))
        parts = sorted(offers(at(low)) + offers(at(high), at(low)))
        assert parts == whole if high else set(parts) == set(whole)  # at level 0 the other trees no longer count
        shift = prefix_forest.BITS - high
        trees = range(5) if high else range(1)
        want = [(q, i) for q in range(0, 1500, 300) for t in trees for i in range(1500) if i != q and strings[q, t] >> shift == strings[i, t] >> shift]
        assert whole == sorted(want)


def test_repeated_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], "a", 1), (0, [0.5, 0.0], "b", 2), (7, [0.0, 1.0], "c", 3), (9, [0.0, 1.0], "c", 3)], "vec_id int, embedding array<float>, query string, entry long")
    assert [(r.vec_id, r["rank"]) for r in prefix_forest.search(d).orderBy("rank").collect()] == [(7, 1), (9, 2)]


def test_small_and_empty_tables(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in v] for q, v in found(prefix_forest.search(d)).items()} == {0: [100, 7], 100: [0, 7]}
    assert prefix_forest.search(d.limit(0)).count() == 0
