import random

import pytest

from stacksight.llm import divergence

from . import brute

FIELDS = "text string, lang string, source string"


def audited(spark, rows, **how):
    docs = spark.createDataFrame(rows, FIELDS)
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **how).collect()}


def words(r, n, spread):
    return " ".join(r.choice("aAzÉéñß") + r.choice("bcdE") * (1 + int(spread * r.random() ** 4)) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """Three languages, one source with a third of all rows, ties, and terms of one source alone."""
    r = random.Random(seed)
    rows = [(words(r, r.randrange(1, 60), 3 + 9 * seed), r.choice(["en", "fr", None]), r.choice(["hot"] * 4 + list("ABCDEFGH"))) for _ in range(400)]
    rows += [("solo " * 12, "en", "A")] * 10 + [("one two three", "xx", s) for s in "AB"]
    want = brute.divergence(rows)
    assert audited(spark, rows) == want and any(x[2] == "term" and x[5] == 10 for x in want)


def test_many_rounds_of_buckets(spark, monkeypatch):
    """Buckets of one count each: the first holds too few terms above the language's share, so more must be opened."""
    monkeypatch.setattr(divergence, "STEPS", 64)
    r = random.Random(5)
    rows = [(" ".join(f"{'xyz'[k % 3]}{'ab' * (1 + int(40 * r.random() ** 3))}" for k in range(80)), "en", f"s{r.randrange(6)}") for _ in range(200)]
    assert audited(spark, rows) == brute.divergence(rows)


def test_pairs_put_out_early(spark, monkeypatch):
    """Sums by pair that leave a task more than once, and terms that lie across batches."""
    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(divergence, "ROWS", 5)
    r = random.Random(6)
    rows = [(words(r, 40, 6), "en", f"s{r.randrange(9)}") for _ in range(150)]
    assert audited(spark, rows) == brute.divergence(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "A"), ("123 !?", "en", "B"), ("Word " * 200_000, "en", "C"), (None, "en", None), ("Zoë zoë ZOË", "fr", "A"), ("Zoë", "fr", "A")] + [("word other", "en", "D")] * 11
    assert audited(spark, rows) == brute.divergence(rows)
    assert audited(spark, rows, least=1, top=2) == brute.divergence(rows, 1, 2)
    assert divergence.audit(spark.createDataFrame([], FIELDS)).count() == 0
    named = spark.createDataFrame([(t, l, s, 1, {"a": 2}) for t, l, s in rows], FIELDS + ", n long, term map<string,long>")
    assert divergence.audit(named).count() == len(brute.divergence(rows))


def test_large_counts_stay_exact(spark):
    n, total, terms = 3_000_000_000_000, 9_000_000_000_000, 1_000_000
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share(df.n, df.total, df.terms)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
