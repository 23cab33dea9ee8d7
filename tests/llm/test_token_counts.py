import numpy as np
import pytest

from stacksight.llm import tokencounts


def brute(text: str, rule: str) -> list:
    import public_tokenizers

    e = tokencounts.spans(public_tokenizers.path(tokencounts.VOCABULARY)).encoding
    raw, edges = text.encode(), [0]
    for k, b in enumerate(raw):
        if b == 10 and k + 1 < len(raw):
            edges.append(k + 1)
    edges.append(len(raw))
    out, at = [0] * (len(edges) - 1), 0
    for token in e.encode_ordinary(text):
        end = at + len(e.decode_single_token_bytes(token))
        shares = [max(0, min(end, hi) - max(at, lo)) for lo, hi in zip(edges, edges[1:])]
        out[next(k for k, s in enumerate(shares) if s) if rule == "first" else int(np.argmax(shares))] += 1
        at = end
    return out


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_counts_match_brute_force(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    texts = {r.doc_id: r.text for r in docs.collect()} | {9000: "a\n\n\n  b\n", 9001: "\n\n", 9002: "é\nü 日本\n x  \n\ty", 9003: "one line"}
    own = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in tokencounts.section_tokens(own, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section_id] = r.n_tokens
    assert {d: [v[k] for k in sorted(v)] for d, v in got.items()} == {d: brute(t or "", rule) for d, t in texts.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a\nb", "z"), (3, "a\nb", "z"), (None, "lost", "w"), (4, "w " * 200000, "v")], "doc_id long, text string, kind string")
    rows = tokencounts.section_tokens(docs).collect()
    assert sorted((r.doc_id, r.section_id, r.kind) for r in rows) == [(1, 0, "title"), (2, 0, "title"), (3, 0, "title"), (3, 0, "title"), (3, 1, "body"), (3, 1, "body"), (4, 0, "title")]
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0} and next(r.n_tokens for r in rows if r.doc_id == 4) >= 200000
    assert tokencounts.section_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokencounts.section_tokens(docs, rule="none")
