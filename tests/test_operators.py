"""Ordered rules against plain Python, ingest of a sheet, and independence of row order."""

import pytest
from pyspark.sql import functions as F

from stacksight.operators import entity, ingest, integrity, intelligence, lists, persist, snapshots
from stacksight.sources.library import AS_OF, Library


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, "/root/testdata/sf0.001")


def test_row_order_does_not_matter(lib):
    shuffled = lib.hits.orderBy(F.rand(7)).repartition(7)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(entity.fused(lib.hits, lib.series)) == key(entity.fused(shuffled, lib.series))
    assert key(persist.merged(lib.hits, lib.books, lib.series, AS_OF)) == key(persist.merged(shuffled, lib.books, lib.series, AS_OF))


def test_sheet_is_imported(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Title,Author,Series,Book #,Publish Date,Status,Shelf\nStone,Ann Bee,Unbound,2,7/4/2021,Finished,A1\n,Ann Bee,Unbound,3,,,\n"Fall, The",Bob,-,,45292,tbr,B2\nRise Book 4,Ann Bee,unbound,,2020,,\nLone,Cy,— Cy,,,,\n')
    rows, unknown = ingest.mapped(ingest.load(spark, str(path)))
    rows = ingest.typed(rows).withColumn("row_number", F.monotonically_increasing_id() + ingest.FIRST_ROW)
    assert unknown == ["Shelf"]
    series = spark.createDataFrame([(7, "p1", "UNBOUND")], "series_id long, profile_id string, name string")
    good, bad, of = ingest.imported(rows, series, "p1")
    got = {r.title: (r.linked_series, r.series_id, r.book_number, r.is_read, str(r.publication_date)) for r in good.collect()}
    assert got == {"Stone": ("Unbound", 7, 2.0, True, "2021-07-04"), "Fall, The": (None, None, None, False, "2024-01-01"), "Rise Book 4": ("Unbound", 7, 4.0, False, "2020-01-01"), "Lone": (None, None, None, False, "None")}
    assert [(r.row_number, r.errors) for r in bad.collect()] == [(3, ["missing_title"])]
    assert [(r.name, r.is_new) for r in of.collect()] == [("Unbound", False)]
    with pytest.raises(ValueError):
        ingest.load(spark, "x.txt")


def test_patches_clear_and_set(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, asin string")
    patches = spark.createDataFrame([(1, ["asin"], None, None), (2, ["title"], "c", "ignored")], "id long, set array<string>, title string, asin string")
    assert sorted(snapshots.patched(table, patches, "id").collect()) == [(1, "a", None), (2, "c", "y")]


def test_intelligence_of_a_small_library(spark):
    series = spark.createDataFrame([(1, "p0", False, False), (2, "p0", True, False)], "series_id long, profile_id string, is_finished boolean, has_new_books boolean")
    b = "book_id long, series_id long, profile_id string, title string, book_number double, is_read boolean, read_status string, record_status string"
    books = spark.createDataFrame([(1, 1, "p0", "One", 1.0, True, "read", None), (2, 1, "p0", "Books 3-4", None, False, "available", None), (3, 1, "p0", "Six", 6.0, False, "available", "archived"), (4, 1, "p0", "Nine", 9.0, False, "available", "deleted"), (5, 1, "p1", "Foreign", 8.0, False, "available", None), (6, 1, "p0", "Half", 6.5, False, "upcoming", None)], b)
    known = intelligence.series_intelligence(books, series)
    got = {r.series_id: (r.total_covered, r.missing, r.next_unread, r.next_upcoming, r.read_count, r.unread_count) for r in known.collect()}
    assert got == {1: (6, [2, 5], 6, 6.5, 1, 3), 2: (0, [], None, None, 0, 0)}
    state = {r.series_id: (r.is_caught_up, r.series_status) for r in intelligence.series_state(known, series).collect()}
    assert state == {1: (False, "ongoing"), 2: (True, "finished")}


def test_gaps_of_high_volumes_and_wide_ranges(spark):
    """Ranges are never laid out: volume 3,000,000 and `Books 1-50000` cost what volume 3 costs."""
    series = spark.createDataFrame([(1, "p0", False, False), (2, "p0", False, False), (3, "p0", False, False)], "series_id long, profile_id string, is_finished boolean, has_new_books boolean")
    b = "book_id long, series_id long, profile_id string, title string, book_number double, is_read boolean, read_status string, record_status string"
    rows = [(1, 1, "p0", "One", 1.0, True, "read", None), (2, 1, "p0", "Far", 3_000_000.0, True, "read", None), (3, 2, "p0", "Books 1-50000", None, True, "read", None), (4, 2, "p0", "Books 40000-60000", None, True, "read", None),
            (5, 2, "p0", "Sixty", 60_002.0, True, "read", None), (6, 3, "p0", "Books 2-123456789012", None, True, "read", None)]
    books = spark.createDataFrame(rows, b)
    known = intelligence.series_intelligence(books, series)
    got = {r.series_id: (r.total_covered, [tuple(g) for g in r.gaps]) for r in known.select("series_id", "total_covered", "gaps").collect()}
    assert got == {1: (3_000_000, [(2, 2_999_999)]), 2: (60_002, [(60_001, 60_001)]), 3: (123_456_789_012, [(1, 1)])}
    assert {r.series_id: r.n for r in known.select("series_id", intelligence.n_numbers(F.col("gaps")).alias("n")).collect()} == {1: 2_999_998, 2: 1, 3: 1}
    assert known.where("series_id = 1").select(intelligence.first_numbers(F.col("gaps"), 3)).first()[0] == [2, 3, 4]
    assert {r.series_id: [tuple(g) for g in r.gaps] for r in intelligence.client_gaps(books).select("series_id", "gaps").collect()} == {1: [(2, 2_999_999)]}
    other = spark.createDataFrame([(1, [(5, 9), (2_999_999, 3_000_010)]), (2, [(70_000, 70_001), (70_002, 70_009)])], "series_id long, gaps array<struct<lo:long,hi:long>>")
    both = {r.series_id: [tuple(g) for g in r.gaps] for r in intelligence.merged_gaps(known, other).select("series_id", "gaps").collect()}
    assert both == {1: [(2, 3_000_010)], 2: [(60_001, 60_001), (70_000, 70_009)], 3: [(1, 1)]}
    want = spark.createDataFrame([(1, 5_000_000), (2, 3), (3, 0)], "series_id long, expected int")
    have = spark.createDataFrame([(1, 2), (1, 4_999_999), (1, 6_000_000), (2, 1), (2, 2), (2, 3)], "series_id long, n long")
    assert {r.series_id: [tuple(g) for g in r.gaps] for r in intelligence.expected_gaps(want, have).select("series_id", "gaps").collect()} == {1: [(1, 1), (3, 4_999_998), (5_000_000, 5_000_000)], 2: [], 3: []}


def test_orders_of_few_profiles_are_dealt_evenly(spark):
    """Five profiles, one with three fifths of all rows: the places equal a window's, and no range has twice the median's rows."""
    p = F.when(F.col("id") % 10 < 6, "p0").otherwise(F.concat(F.lit("p"), (F.col("id") % 10 - 5).cast("string")))
    rows = spark.range(40_000).select("id", p.alias("profile_id"), (F.xxhash64("id") % 500).alias("score"))
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    got = {r.id: r.place for r in lists.placed(rows, order, ("profile_id",)).collect()}
    assert got == {r.id: r.place for r in lists.numbered(rows, order, None, ("profile_id",)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in lists.in_ranges(rows.repartition(3), order, ("profile_id",)).groupBy("range").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 3 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_healing_is_stable(lib):
    once = integrity.healed(lib.books, AS_OF)
    again = integrity.healed(lib.books.drop("read_status", "is_missing", "is_upcoming_auto", "is_upcoming_final").join(once.drop("changed"), "book_id"), AS_OF)
    assert once.where("changed").count() > 0 and again.where("changed").count() == 0
