import zlib

import numpy as np
import pytest

from stacksight.llm import packing


def whole(texts: dict) -> dict:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [packing.SEPARATOR], "<u4") for d, x in texts.items()}


def check(rows, texts: dict, window: int) -> None:
    ids, pieces, sequences = whole(texts), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.sequence_tokens for r in own} == {at}
    # full, or left over at the very end: no length twice, all of them powers of two, so nothing is padded
    lengths = [sum(r.length for r in own) for own in sequences.values()]
    short = [n for n in lengths if n < window]
    assert sum(short) < window and len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short)


def test_round_trip_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500").repartition(6)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(packing.pack(docs).collect(), texts, packing.WINDOW)


@pytest.mark.parametrize("open_windows", [2, 16])
def test_odd_texts_in_small_windows(spark, open_windows):
    texts = {1: None, 2: "", 3: "Hello, WORLD! it's 3.14 <|endoftext|> x", 4: "ÀÉ naïve  éclair ΟΔΟΣ 日本語 🎉🎉", 5: "word " * 900, 6: "a\x1cb \x85 c​d", 7: "don't stop\r\n\t'll go!!! ...", 8: "x" * 5000}
    docs = spark.createDataFrame([(d, t, d, 0) for d, t in texts.items()], "doc_id long, text string, start long, sequence_id long").repartition(3)
    check(packing.pack(docs, window=64, open_windows=open_windows).collect(), texts, 64)


def test_repeated_lost_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    # both rows whole, whether in one piece or cut for the powers of two at the end
    assert {r.doc_id for r in rows} == {1} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sorted(k for r in rows for k in range(r.start, r.start + r.length)) == sorted(2 * list(range(rows[0].doc_tokens)))
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("fan_in", [2, 64])
def test_leftovers_of_many_partitions_and_ties(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    texts = {d: " ".join(["same"] * (d % 5)) for d in range(300)} | {1000: "long text of words " * 40_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    check(packing.pack(docs, window=32, open_windows=3).collect(), texts, 32)


def test_windows_of_one_fill(spark):
    space = packing.Open(8, 2)
    piece = lambda d, n: packing.Piece(d, 0, bytes(4 * n), n)
    assert space.place(piece(1, 5)) == [] and space.place(piece(2, 5)) == []
    (full,) = space.place(piece(3, 4))  # fits none: the first of the fullest is topped up and goes
    assert [(p.doc_id, p.start, len(p.ids) // 4) for p in full] == [(1, 0, 5), (3, 0, 3)]
    assert [[p.doc_id for p in rows] for rows in space.pieces] == [[2, 3]] and space.used == [6]
    assert list(space.drain()) == [] and space.used == [6]
    assert [sum(len(p.ids) // 4 for p in rows) for rows in space.powers()] == [4, 2]


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("limit", [0, 3, 700_000])
def test_words_of_a_block_as_the_vocabulary_encodes_the_texts(limit):
    odd = ["", " ", "the cat", "the. the, The### THE&&& (the) the's the'; don't. '' _ a_b a__ | ||| x|<", "café cafe\u0301 CAFÉ!", "<|endoftext|> the", "< | the", "ΟΔΟΣ. İstanbul Straße ß? \u1e9e", "a\xa0b \u2003 c\u3000d.\xa0", "a\x1cb", "a\u200bb the", "\xa0", "1.5 a1 2b. ½ x² 日本語。 🎉!", "\v\f\r\n\tthe\x0bcat"]
    rng = np.random.default_rng(4)
    signs = [*"aBé.,'#|<$ \n_-1Σσςİ", "\xa0", "\u0301", "\u0130", "\u0345", "\u2028", "\x1f", "\u0600", "ǅ", "ª", "٣", "\U0001d400", "the", "'s", " "]
    odd += ["".join(rng.choice(signs, n)) for n in rng.integers(1, 30, 1500)]
    words = packing.WordCache(packing.tokenizer_path(), limit)
    for lo, hi in ((0, 2), (0, 14), (14, 500), (400, len(odd)), (0, len(odd))):
        for text, ids in zip(odd[lo:hi], words.encode(*block(odd[lo:hi])), strict=True):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
        assert len(words.words) <= limit


def test_a_word_is_looked_up_once_in_a_block(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Counted(dict):
        seen = 0

        def get(self, *key):
            Counted.seen += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.seen += 1
            return super().__contains__(key)

    class Task:
        get = staticmethod(lambda: type("Context", (), {"partitionId": staticmethod(lambda: 0)}))

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    monkeypatch.setattr(packing, "_CACHES", {})
    path = packing.tokenizer_path()
    packing.cache(path).words = Counted()
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["one two. two three " * 50] * 100})
    (*full, left) = packing._token_pieces(path, 64, packing.SEPARATOR, 4, packing.CACHE_WORDS)(iter([rows]))
    assert sum(sum(b.column("length").to_pylist()) for b in [*full, left]) == 100 * (50 * 5 + 1)
    assert Counted.seen <= 3 * 4  # twenty thousand words, four different ones


def test_size_of_blocks_changes_no_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 200").coalesce(1)
    runs = [sorted(map(tuple, packing.pack(docs, cache_words=n, block_bytes=b).collect())) for b, n in ((1, 100), (3000, 700_000), (1 << 22, 0))]
    assert runs[0] == runs[1] == runs[2]
