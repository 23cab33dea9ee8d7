import random
from collections import Counter

import numpy as np
import pytest

from stacksight.llm import recompression, suffix_array
from tests.llm import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_spans_match_brute_force(spark, seed, monkeypatch):
    texts = brute.corpus(seed)
    if seed == 2:  # every anchor with more than two variants by window fingerprints, and long texts in chunks
        monkeypatch.setattr(suffix_array, "VARIANTS_IN_ONE_ARRAY", 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.deduplicate(brute.table(spark, texts)).collect()}
    want = brute.substring_dedup(texts)
    assert {d for d in want if got[d] != want[d]} == set() and got.keys() == want.keys()
    assert sum(v[1] for v in want.values()) > 1000


@pytest.mark.parametrize("seed", [1, 3])
def test_passages_match_brute_force(spark, seed):
    texts = brute.corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate(brute.table(spark, texts)).collect()}
    want = brute.passage_dedup(texts)
    assert {d for d in want if got[d] != want[d]} == set() and got.keys() == want.keys()
    assert sum(v[1] for v in want.values()) > 500


def long_texts(seed: int) -> dict:
    """Texts of over 600,000 bytes that share stretches of some 20,000 words, some with single words changed, beside short ones."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    shared = words(20_000)
    edited = [w if r.random() > 0.003 else "edit" for w in shared]
    texts = {1: words(60_000) + shared + words(40_000), 2: words(30_000) + edited + words(70_000), 3: edited[5_000:] + words(100), 4: shared[100:160], 5: words(50)}
    return {d: " ".join(w) for d, w in texts.items()}


def test_long_texts_match_brute_force(spark):
    texts = long_texts(7)
    assert max(map(len, texts.values())) > 2 * (1 << 18)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate(brute.table(spark, texts)).collect()}
    assert got == brute.passage_dedup(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.deduplicate(brute.table(spark, texts)).collect()}
    assert got == brute.substring_dedup(texts)


@pytest.mark.parametrize("least", [13, 20])
def test_long_symbols_name_repeats_at_several_levels(spark, least):
    r = random.Random(5)
    words = lambda n: [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(n)]
    shared = words(900)
    texts = {1: shared, 2: words(30) + shared[100:] + words(50), 3: ["x"] * 500, 4: words(20) + ["x"] * 400, 5: words(400)}
    found = recompression.long_repeats(brute.table(spark, {d: " ".join(w) for d, w in texts.items()}), least=least).collect()
    assert {f.doc_id for f in found} <= {2, 4} and len({f.level for f in found}) > 2
    for f in found:
        part = texts[f.doc_id][f.start : f.end]
        assert any(part == w[i : i + len(part)] for d, w in texts.items() if d < f.doc_id for i in range(len(w) - len(part) + 1))
    assert max(f.end - f.start for f in found if f.doc_id == 2) > 300


def test_maximal_repeats_hold_all_occurrences():
    segments = [b"xabcabcy", b"zabcabcw", b"abc"]
    found = {segments[o[0][0]][o[0][1] : o[0][1] + n]: sorted(o) for n, o in ((n, list(o)) for n, o in suffix_array.maximal_repeats(segments, __import__("numpy").array([8, 8, 3]), 3))}
    assert found[b"abcabc"] == [(0, 1), (1, 1)]
    assert found[b"abc"] == [(0, 1), (0, 4), (1, 1), (1, 4), (2, 0)]


@pytest.mark.parametrize("operator", [suffix_array.deduplicate, recompression.deduplicate])
def test_odd_tables(spark, operator):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (1, None, 7, "x"), (None, "lost", 1, "y"), (2, None, 3, None)], "doc_id long, text string, n long, kept string")
    assert sorted(r.doc_id for r in operator(docs).collect()) == [1, 2]
    assert operator(docs.limit(0)).count() == 0
    assert operator(docs.where("doc_id = 2")).collect()[0][1] == 0


def near_copies(seed: int, groups: int = 12, copies: int = 10, size: int = 700) -> dict:
    """Groups of copies of one text, each with single letters changed at places of its own."""
    r = random.Random(seed)
    texts = {}
    for g in range(groups):
        base = r.choices("abcdefghijklmnopqrstuvwxyz ", k=size)
        for c in range(copies):
            text = list(base)
            for _ in range(r.randint(1, 3)):
                text[r.randrange(size)] = r.choice("ABCDEFGH")
            texts[g * 100 + c] = "".join(text)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_match_brute_force(spark, seed):
    texts = near_copies(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.deduplicate(brute.table(spark, texts)).collect()}
    assert got == brute.substring_dedup(texts)


@pytest.mark.parametrize(("seed", "size"), [(1, 368), (2, 368), (3, 200), (4, 1100)])
def test_maximal_repeats_cover_every_repeated_window(seed, size):
    segments = [t.encode() for t in dict.fromkeys(near_copies(seed, groups=1, copies=40, size=size).values())]
    starts = np.full(len(segments), size - 199)
    got = {(k, off + i) for n, o in suffix_array.maximal_repeats(segments, starts, 200) for k, off in o for i in range(n - 199)}
    seen = Counter(s[p : p + 200] for s in segments for p in range(size - 199))
    assert got == {(k, p) for k, s in enumerate(segments) for p in range(size - 199) if seen[s[p : p + 200]] > 1}


def test_shortened_documents_keep_odd_columns(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, text, "s", 300, {"a": 1}), (2, text, "t", 300, None), (2, text, "t", 300, None), (3, "short", None, 5, None), (None, text, "u", 300, None)]
    d = spark.createDataFrame(rows, "doc_id int, text string, spans string, n_chars int, m map<string,int>")
    got = sorted((r.doc_id, r.text, r.spans, r.n_chars) for r in suffix_array.shortened_documents(d).collect())
    assert got == [(1, "", "s", 0), (2, "", "t", 0), (2, "", "t", 0), (3, "short", None, 5)]
