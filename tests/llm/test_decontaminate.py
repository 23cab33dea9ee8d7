import random

import numpy as np

from stacksight.llm import decontaminate as dc


def brute(docs: dict, items: dict, edits: float = dc.EDITS) -> dict:
    out = {}
    own = dict(dc.item_words(items.items()))
    for d, text in docs.items():
        raw = (text or "").encode()
        names, _ = dc.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for i, w in own.items():
            row = [0] * (len(names) + 1)
            for k, x in enumerate(w, 1):
                new = [k]
                for j, y in enumerate(names, 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= int(len(w) * edits):
                out[d, i] = min(row)
    return out


def edited(r: random.Random, words: list, n: int) -> list:
    w = list(words)
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], [w[k], f"n{r.randrange(999)}"], [f"n{r.randrange(999)}"]])
    return w


def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    prose = lambda n: [f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(n)]
    items = {i: " ".join(prose(r.randint(8, 40))) for i in range(12)} | {90: None, 91: "w1 w2", 92: ""}
    docs = {d: " ".join(prose(r.randint(0, 60)) + (edited(r, items[d % 12].split(), r.randint(0, 4)) if d % 2 else []) + prose(r.randint(0, 60))) for d in range(40)} | {70: None, 71: ""}
    got = dc.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got, want = {(x.doc_id, x.item_id): x.edits for x in got.collect()}, brute(docs, items)
    assert got.items() <= want.items() and len(want) > 15
    assert len(got) >= 0.97 * len(want)


def test_recall_at_the_limit():
    r = random.Random(9)
    hits = total = 0
    for _ in range(300):
        n = r.choice([15, 30, 45])
        item = [f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(n)]
        index = dc.Index(dc.item_words([(1, " ".join(item))]))
        raw = " ".join(["q"] * 20 + edited(r, item, int(n * dc.EDITS)) + ["q"] * 20).encode()
        names, first = dc.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        hits += bool(list(index.search(names, first)))
        total += 1
    print("recall at the limit", hits / total)
    assert hits >= 0.98 * total


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 7), (1, None, 7), (None, "a b c d e f g h i j", 1), (2, "x " * 50000 + "A, b c d-e f g h i j", 0)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(5, "a b c d e f g h i j", 1), (5, None, 2), (None, "q w e r t y u i o p", 3)], "item_id long, text string, doc_id long")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, bench).collect()) == [(1, 5, 0), (2, 5, 0)]
    assert dc.clean_documents(docs, bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.leaks(docs.limit(0), bench).count() == 0
    assert dc.clean_documents(docs, bench.limit(0)).columns == docs.columns


def found(item: list, text: list) -> list:
    names, first = dc.words(*(lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))(" ".join(["q"] * 20 + text + ["q"] * 20).encode()))
    return list(dc.Index(dc.item_words([(1, " ".join(item))])).search(names, first))


def test_edits_of_early_words_are_found():
    for n in range(8, 15):
        item = [f"w{n}x{k}" for k in range(n)]
        most = int(n * dc.EDITS)
        early = ["n1", *item[1:]], [item[0], "n1", *item[2:]], item[1:], [item[0], *item[2:]], [item[0], "n1", *item[1:]]
        if most > 1:
            early += (["n1", item[1], "n2", *item[3:]], [item[0], "n1", item[2], "n2", *item[4:]], [item[0], "n1", "n2", *item[1:]])
        for text in early:
            assert [x[:2] for x in found(item, text)] == [(0, 0)], (n, text)
        assert found(item, item) == [(0, 0, 20, 0)]
        assert found(item, [*item[: n - 1], "n1"]) == [(0, 0, 20, 1)]


def test_recall_of_short_items_at_the_limit():
    r = random.Random(9)
    for n in range(8, 15):
        hits = 0
        for _ in range(200):
            item = [f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(n)]
            hits += bool(found(item, edited(r, item, int(n * dc.EDITS))))
        print("recall at the limit", n, hits / 200)
        assert hits >= 198, n


def test_items_below_eight_words_are_all_found():
    r = random.Random(11)
    for n in range(1, 8):
        for _ in range(100):
            item = [f"w{r.randrange(30)}" for _ in range(n)]
            text = edited(r, item, int(n * dc.EDITS))
            got = found(item, text)
            assert got and got[0][3] <= int(n * dc.EDITS), (item, text)
        assert not found([f"w{k}" for k in range(n)], [f"v{k}" for k in range(40)])


def test_long_texts_are_searched_part_by_part():
    r = random.Random(12)
    item, short = [f"w{k}" for k in range(30)], ["s1", "s2", "s3"]
    names = [f"v{r.randrange(3000)}" for _ in range(3 * dc.WORDS_AT_ONCE)]
    for at in (10, dc.WORDS_AT_ONCE - 15, 2 * dc.WORDS_AT_ONCE - 2, len(names) - 40):
        text = [*names[:at], *item, *names[at:]]
        raw = " ".join([*text, *short]).encode()
        index = dc.Index(dc.item_words([(1, " ".join(item)), (2, " ".join(short))]))
        best = {}
        for _, k, start, edits in index.search(*dc.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))):
            best[k] = min(best.get(k, (99, 0)), (edits, start))
        assert best == {0: (0, at), 1: (0, len(text))}
