"""The import queries work on every row of title_cases, not only on those that are written out in the view."""

import pytest

from stacksight.plans import registry
from stacksight.sources.library import Library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cases(spark):
    return [r.asDict() for r in Library(spark, SF).cases.collect()]


def good(rows):
    return [r for r in rows if (r["title"] or "").strip() and (r["author"] or "").strip()]


@pytest.mark.parametrize("key", ["P12_typed_rows", "P17_series_evidence"])
def test_every_row_is_typed(spark, cases, key):
    got = [r.row_number for r in registry.queries()[key](spark, SF).collect()]
    assert sorted(got) == sorted(r["id"] + 1 for r in cases) and len(got) > 21


@pytest.mark.parametrize("key", ["D1_import", "F86_book_payload"])
def test_every_good_row_is_imported(spark, cases, key):
    got = {r.row_number: r for r in registry.queries()[key](spark, SF).collect()}
    want = {r["id"] + 1: r for r in good(cases)}
    assert got.keys() == want.keys() and len(want) > 21
    assert all(got[n].title == want[n]["title"].strip() for n in want)
    of_books = {n: r for n, r in want.items() if n > 1001}
    assert {n: got[n].linked_series for n in of_books} == {n: r["series"] for n, r in of_books.items()}


def test_every_series_is_named(spark, cases):
    got = {r.key for r in registry.queries()["K8_series_of_import"](spark, SF).collect()}
    assert got >= {r["series"].strip().lower() for r in good(cases) if r["id"] > 1000 and r["series"]}
