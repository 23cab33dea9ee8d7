import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from stacksight.llm import queries, semi_crf
from stacksight.llm.semi_crf import Candidate

SF = "/root/testdata/sf0.001"
PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    checked = lambda d: sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = (lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and checked(digits(s)), lambda s: 10 <= len(digits(s)) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if rules[k](m[0]))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return semi_crf.train(corpus.where("doc_id % 2 = 0"), windows=400)


def test_base_spans():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("ab@.-+_%() 0123459٣é\n") for _ in range(r.randrange(60)))
        assert semi_crf.base_spans(t) == plain_base(t), t
    for _ in range(2000):
        t = " ".join(r.choice(["+1 (234) 555-0100", "4845168114407329", "4845 1681-1440 7329", "1.2.3.4", "256.1.1.1", "000001.2.3.255", "a@b.c@d.e", "@", "x@-.-", "+", "12345678901234567890"]) for _ in range(6)).replace(" ", r.choice(["", " ", "-"]))
        assert semi_crf.base_spans(t) == plain_base(t), t


def segmentations(spans):
    for n in range(len(spans) + 1):
        for some in itertools.combinations(range(len(spans)), n):
            some = sorted(some, key=lambda k: spans[k].start)
            if all(spans[a].end <= spans[b].start for a, b in zip(some, some[1:])):
                yield some, sum(spans[a].end == spans[b].start for a, b in zip(some, some[1:]))


def test_dynamic_program_equals_enumeration():
    r = random.Random(2)
    for _ in range(60):
        spans = sorted({(e, s, k) for _ in range(r.randrange(1, 9)) for s in [r.randrange(12)] for e in [s + r.randrange(1, 5)] for k in [r.randrange(4)]})
        spans = [Candidate(s, k, e) for e, s, k in spans]
        scores, adjacent = [r.uniform(-2, 2) for _ in spans], r.uniform(-2, 1)
        each = [(some, sum(scores[k] for k in some) + adjacent * pairs, pairs) for some, pairs in segmentations(spans)]
        z = sum(math.exp(x) for _, x, _ in each)
        total, p, neighbours = semi_crf.likelihood(spans, np.array(scores), adjacent)
        assert total == pytest.approx(math.log(z))
        for k in range(len(spans)):
            assert p[k] == pytest.approx(sum(math.exp(x) for some, x, _ in each if k in some) / z)
        assert neighbours == pytest.approx(sum(math.exp(x) * n for _, x, n in each) / z)
        top = max(each, key=lambda x: x[1])[0]
        assert semi_crf.best(spans, scores, adjacent) == [spans[k] for k in top]


def test_held_out_spans(corpus, model):
    """Entities of documents that the fit has not seen, written otherwise: found whole and of the right kind; text without any stays as it is."""
    texts = [r.text for r in corpus.where("doc_id % 2 = 1 and text is not null").select("text").collect()]
    found = wanted = 0
    for text in texts:
        spans = semi_crf.base_spans(text)
        for start, kind, end in spans[:2]:
            left, right = text[max(0, start - 40) : start], text[end : end + 40]
            if semi_crf.base_spans(left) or semi_crf.base_spans(right) or re.search(r"[0-9@]", left + right):
                continue
            for new in semi_crf.rewritten(kind, text[start:end]):
                wanted += 1
                found += semi_crf.added_spans(left + new + right, [], model) == [(len(left), kind, len(left) + len(new))]
    assert wanted > 500 and found >= 0.95 * wanted
    clean = [t for t in texts if not semi_crf.base_spans(t)]
    assert sum(bool(semi_crf.added_spans(t, [], model)) for t in clean) <= 0.002 * len(clean)


def test_what_it_adds(model):
    told = lambda t: [(semi_crf.KINDS[k], t[s:e]) for s, k, e in semi_crf.added_spans(t, semi_crf.base_spans(t), model)]
    assert told("write to jane.doe at mail dot example dot com today") == [("email", "jane.doe at mail dot example dot com")]
    assert told("host 10[.]20[.]30[.]40 is down") == [("ip", "10[.]20[.]30[.]40")]
    assert told("call (017) 555-7713 now") == [("phone", "(017) 555-7713")]
    assert told("version 1.2.3 of 2021.04.05 on 2021-04-05 12:30") == [] and told("id 4845168114407328 no") == []
    assert told("mail a@b.org, 1.2.3.4") == []  # base spans are no additions


def test_query_over_whole_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        base = plain_base(text)
        named = [f"{semi_crf.KINDS[k]}:{s}:{e}" for s, k, e in base]
        r = got[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) | ({""} if not named else set()) and len(r.spans.split(",")) - (r.spans == "") == len(base) + r.n_added


def test_odd_rows(spark, model):
    long = "word " * 200_000 + "a@b.org " + "1 " * 50_000 + "9" * 300_000 + " x@y.z " + "." * 100_000 + "é 1.2.3.4"
    rows = [(1, None), (2, ""), (3, "x@y.org +1 (234) 555-0100"), (3, "x@y.org +1 (234) 555-0100"), (4, long), (None, "a@b.org"), (5, "à@b.org é@x.yz")]
    docs = spark.createDataFrame([(i, t, 0, {"a": 1}) for i, t in rows], "doc_id long, text string, n_email int, spans map<string,int>")
    got = semi_crf.find(docs, model).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4, 5]
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == "email:0:7,phone:8:25" and by[5].spans == ""
    assert by[4].n_email == 2 and by[4].n_ip == 1
    assert semi_crf.find(docs.limit(0), model).count() == 0
    nothing = semi_crf.train(docs.limit(0))
    assert not nothing.kinds and {r.n_added for r in semi_crf.find(docs, nothing).collect()} == {0}
