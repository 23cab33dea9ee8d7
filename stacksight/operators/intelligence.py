"""What a library knows of its series: coverage, gaps, what to read next, state and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksight.functions import dates as d

RANGES = "array<struct<lo:bigint,hi:bigint>>"


def active(c: Column | None = None) -> Column:
    """Not deleted: no record status, or another one. Archived books count."""
    c = F.col("record_status") if c is None else c
    return c.isNull() | (c != "deleted")


def read() -> Column:
    return d.flag(F.col("is_read")) | (d.status(F.col("read_status")) == "read")


def upcoming() -> Column:
    return d.status(F.col("read_status")) == "upcoming"


def of_own_profile(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books of a series that belong to its profile. Series are the small side, so the join is left to the optimiser."""
    return books.join(series.select("series_id", "profile_id"), ["series_id", "profile_id"], "left_semi")


def series_aggregates(books: DataFrame, series: DataFrame) -> DataFrame:
    """Highest number of an active book, and counts of active, deleted and upcoming ones; series without books have zeros."""
    n = F.col("book_number")
    counted = of_own_profile(books, series).groupBy("series_id").agg(
        F.max(F.when(active() & (n > 0), F.floor(n))).alias("total_books"),
        F.count_if(active()).alias("active_count"), F.count_if(~active()).alias("deleted_count"), F.count_if(active() & upcoming()).alias("upcoming_count"),
    )
    names = ("total_books", "active_count", "deleted_count", "upcoming_count")
    return series.select("series_id").join(counted, "series_id", "left").select("series_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))


def own_range() -> Column:
    """The whole number of a book as ranges: one, or none."""
    n = F.col("book_number")
    one = F.struct(n.cast("bigint").alias("lo"), n.cast("bigint").alias("hi"))
    return F.when((n > 0) & (n == F.floor(n)), F.array(one)).otherwise(F.array().cast(RANGES))


def reach_before(by: str = "series_id") -> Column:
    """Of rows (lo, hi): the highest number that any earlier range reaches, 0 before the first. Rows of a series stream by in order, none is laid out."""
    w = Window.partitionBy(by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max("hi").over(w), F.lit(0))


def between_ranges(reach: str = "reach") -> Column:
    """Aggregate over rows (lo, hi, reach): the gaps between the ranges, as ranges in order."""
    gap = F.struct((F.col(reach) + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    return F.array_sort(F.collect_list(F.when(F.col("lo") > F.col(reach) + 1, gap)))


def n_numbers(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["hi"] - r["lo"] + 1)


def first_numbers(ranges: Column, n: int) -> Column:
    """The first n numbers of ranges in order; wide ranges are laid out no further."""
    few = F.transform(F.slice(ranges, 1, n), lambda r: F.sequence(r["lo"], F.least(r["hi"], r["lo"] + n - 1)))
    return F.slice(F.flatten(few), 1, n)


def series_intelligence(books: DataFrame, series: DataFrame) -> DataFrame:
    """Per series: total, gaps, next unread and next upcoming number, finished flag, read and unread counts.

    A book covers its own whole number and every number of an omnibus range in its title. Ranges are sorted, and a gap
    lies where one starts beyond what all before it reach, so no number needs to be laid out: `gaps` holds ranges, and
    `missing` lays them out for display (it costs nothing where it is not selected). One shuffle by series.
    """
    n = F.col("book_number")
    whole = (n > 0) & (n == F.floor(n))
    covers = F.concat(own_range(), d.omnibus_ranges(F.col("title")))
    per_book = of_own_profile(books.where(active()), series).select("series_id", n.alias("n"), whole.alias("whole"), read().alias("read"), upcoming().alias("upcoming"), F.posexplode_outer(covers).alias("pos", "range"))
    rows = per_book.select("*", F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"), (F.coalesce("pos", F.lit(0)) == 0).alias("once"))
    counted = rows.withColumn("reach", reach_before()).groupBy("series_id").agg(
        F.max("hi").alias("total"), between_ranges().alias("gaps"),
        F.min(F.when(F.col("whole") & ~F.col("read") & ~F.col("upcoming"), F.col("n"))).cast("bigint").alias("next_unread"),
        F.min(F.when((F.col("n") > 0) & F.col("upcoming"), F.col("n"))).alias("next_upcoming"),
        F.count_if(F.col("once") & F.col("read")).alias("read_count"), F.count_if(F.col("once") & ~F.col("read")).alias("unread_count"),
    )
    ranges = F.coalesce("gaps", F.array().cast(RANGES))
    return series.join(counted, "series_id", "left").select(
        "series_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total_covered"), ranges.alias("gaps"), d.laid_out(ranges).alias("missing"), "next_unread", "next_upcoming",
        d.flag(F.col("is_finished")).alias("is_finished"), F.coalesce("read_count", F.lit(0)).alias("read_count"), F.coalesce("unread_count", F.lit(0)).alias("unread_count"),
    )


def series_state(intelligence: DataFrame, series: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """has_new (which stays once set, or is set by added series_ids), has_unread, has_upcoming, is_caught_up, status."""
    unread, coming = F.col("next_unread").isNotNull(), F.col("next_upcoming").isNotNull()
    new = series.select("series_id", d.flag(F.col("has_new_books")).alias("had_new"))
    if added is not None:
        new = new.join(added.select("series_id").distinct().withColumn("added", F.lit(True)), "series_id", "left").withColumn("had_new", F.col("had_new") | d.flag(F.col("added")))
    return intelligence.join(new, "series_id").select(
        "series_id", F.col("had_new").alias("has_new_books"), unread.alias("has_unread_books"), coming.alias("has_upcoming_books"),
        (~unread & ~coming & (F.size("gaps") == 0)).alias("is_caught_up"), F.when(F.col("is_finished"), "finished").otherwise("ongoing").alias("series_status"),
    )


def recalculated(books: DataFrame, series: DataFrame) -> DataFrame:
    """Intelligence, state and aggregates of every series in one table; total_covered and total_books are both kept."""
    known = series_intelligence(books, series)
    return known.join(series_state(known, series), "series_id").join(series_aggregates(books, series), "series_id")


def missing_text(c: str = "missing") -> Column:
    """A list of numbers as text, for comparison and display."""
    return F.array_join(F.col(c).cast("array<string>"), ",")


def counters(books: DataFrame) -> DataFrame:
    """Per series with active books: total, unread, read, upcoming; upcoming is asked before read."""
    coming = upcoming() | d.flag(F.col("is_upcoming_auto")) | d.flag(F.col("is_upcoming_final"))
    return books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_books"), F.count_if(~coming & ~read()).alias("unread_books"), F.count_if(~coming & read()).alias("read_books"), F.count_if(coming).alias("upcoming_books"),
    )


def status_bar(intelligence: DataFrame) -> DataFrame:
    return intelligence.select("series_id", F.when(F.col("is_finished"), "finished").otherwise("ongoing").alias("status"), "next_unread", "next_upcoming", missing_text().alias("missing"))


def fractional_collisions(books: DataFrame) -> DataFrame:
    """Series and whole numbers under which several different numbers lie, with a deleted book among them."""
    n = F.col("book_number")
    return books.where(F.col("series_id").isNotNull() & (n > 0)).groupBy("series_id", F.floor(n).cast("bigint").alias("whole_number")).agg(
        F.count_distinct(n).alias("n_numbers"), F.count(F.lit(1)).alias("n_books"), F.array_sort(F.collect_list("book_id")).alias("members"), F.bool_or(~active()).alias("deleted"),
    ).where("n_numbers > 1 and deleted").drop("deleted")


def new_flags(books: DataFrame) -> DataFrame:
    """Whether any active book is new and available, or upcoming."""
    return books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(
        F.bool_or(d.flag(F.col("is_missing")) & ~upcoming()).alias("has_new_available"), F.bool_or(upcoming() | d.flag(F.col("is_upcoming_final"))).alias("has_new_upcoming"),
    )


def read_counts(books: DataFrame) -> DataFrame:
    """By the read flag alone."""
    return books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(F.count_if(d.flag(F.col("is_read"))).alias("read_count"), F.count_if(~d.flag(F.col("is_read"))).alias("unread_count"))


def client_gaps(books: DataFrame) -> DataFrame:
    """Gaps below the highest owned number, where two whole numbers are owned at least; omnibus ranges fill gaps but do not raise the top."""
    own = own_range()
    rows = books.where(active() & F.col("series_id").isNotNull()).select("series_id", F.get(own, F.lit(0))["lo"].alias("own"), F.explode(F.concat(own, d.omnibus_ranges(F.col("title")))).alias("range"))
    whole = Window.partitionBy("series_id")
    rows = rows.select("series_id", "own", F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"), F.max("own").over(whole).alias("top"), F.min("own").over(whole).alias("bottom"))
    rows = rows.where("top <> bottom and lo <= top").withColumn("hi", F.least("hi", "top"))
    found = rows.withColumn("reach", reach_before()).groupBy("series_id").agg(between_ranges().alias("gaps"))
    return found.select("series_id", "gaps", d.laid_out(F.col("gaps")).alias("missing"))


def merged_gaps(known: DataFrame, inferred: DataFrame) -> DataFrame:
    """For each series of `known`: the numbers that lie in a gap of either side, as ranges that neither touch nor overlap."""
    both = known.select("series_id", F.explode_outer("gaps").alias("range")).unionByName(inferred.select("series_id", F.explode("gaps").alias("range")).join(known.select("series_id"), "series_id", "left_semi"))
    rows = both.select("series_id", F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi")).withColumn("starts", (F.col("lo") > reach_before() + 1).cast("int"))
    island = F.sum("starts").over(Window.partitionBy("series_id").orderBy("lo", "hi"))
    merged = rows.withColumn("island", island).groupBy("series_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = merged.groupBy("series_id").agg(F.array_sort(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("gaps"))
    return found.select("series_id", "gaps", d.laid_out(F.col("gaps")).alias("missing"))


def expected_gaps(expected: DataFrame, have: DataFrame) -> DataFrame:
    """Numbers 1..expected that nobody has. expected: series_id, expected; have: series_id, n. A range just behind the last number closes the last gap."""
    end = expected.where("expected >= 0").select("series_id", (F.col("expected").cast("bigint") + 1).alias("lo"))
    rows = have.where("n > 0").select("series_id", F.col("n").cast("bigint").alias("lo")).join(end.withColumnRenamed("lo", "end"), "series_id").where("lo < end").select("series_id", "lo").unionByName(end)
    found = rows.withColumn("hi", F.col("lo")).withColumn("reach", reach_before()).groupBy("series_id").agg(between_ranges().alias("gaps"))
    return expected.join(found, "series_id").select("series_id", "expected", "gaps", d.laid_out(F.col("gaps")).alias("missing"))


def owned_top(books: DataFrame) -> DataFrame:
    """Highest number owned (gaps excluded), the next one, and the ceiling of owned and missing numbers."""
    n = F.col("book_number")
    return books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(
        F.max(F.when(~d.flag(F.col("is_missing")), F.floor(n))).cast("bigint").alias("highest_owned"), F.max(n).alias("ceiling"),
    ).select("series_id", "highest_owned", (F.floor("ceiling") + 1).cast("bigint").alias("next_number"), F.coalesce("ceiling", F.lit(0.0)).alias("ceiling"))


def percent(done: Column, total: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(done * 100, total)), F.lit(0)).cast("bigint")
