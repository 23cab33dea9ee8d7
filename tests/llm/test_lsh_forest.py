import importlib
import random

import pytest

from stacksight.llm import lsh_forest
from stacksight.llm.components import components
from tests.llm import brute


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates_match_brute_force(spark, seed, size):
    texts = brute.corpus(seed, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(brute.table(spark, texts), size=size).collect()}
    assert got == brute.near_duplicates(texts, size)
    assert len({c for _, c in got.values()}) < len(got) - 10


def test_large_groups_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "CELL", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    texts = {}
    for d in range(120):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        texts[d] = " ".join(w)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in lsh_forest.near_duplicates(brute.table(spark, texts), size=2).collect()}
    assert got == brute.near_duplicates(texts, 2)


@pytest.mark.parametrize("limit", [1 << 18, 20])
def test_components_of_long_chains(spark, monkeypatch, limit):
    monkeypatch.setattr(importlib.import_module("stacksight.llm.components"), "LOCAL_EDGES", limit)
    r = random.Random(3)
    ids = list(range(300))
    r.shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(299) if k % 60 != 59]
    got = {x.doc: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    for k in range(0, 300, 60):
        part = ids[k : k + 60]
        assert {got[x] for x in part} == {min(part)}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (1, None, 7, "x"), (None, "lost", 1, "y"), (2, None, 3, None), (3, " ", 3, None), (4, "A  B", 1, "z")], "doc_id long, text string, n long, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 1, False)}
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0


def test_rows_with_repeated_ids_may_hold_maps(spark):
    docs = spark.createDataFrame([(1, "b", {"x": 2}), (1, "a", {"x": 3}), (1, "a", {"x": 1}), (1, None, None), (2, "c", None)], "doc_id long, text string, m map<string,int>")
    kept = lsh_forest.kept_documents(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text, r.m) for r in kept.collect()) == [(1, "a", {"x": 1}), (2, "c", None)]
