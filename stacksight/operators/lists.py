"""List views: slim projections, filters, facets, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions.text import blank, text
from stacksight.operators.intelligence import active
from stacksight.operators.steps import kept

PAGE_LIMIT = 200
STATUS_ORDER = ("available", "upcoming", "read")


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page in order of key; the limit is held between 1 and PAGE_LIMIT."""
    return df.orderBy(key).offset(max(0, offset)).limit(min(max(1, limit), PAGE_LIMIT))


def slim_books(books: DataFrame, series: DataFrame) -> DataFrame:
    of = series.select("series_id", F.col("name").alias("series_name"))
    return books.join(of, "series_id", "left").select("book_id", "title", "author", "series_id", "series_name", "book_number", "read_status", "is_read", "is_upcoming_final")


def by_name(series: DataFrame, profile_id: str, name: str) -> DataFrame:
    """The series of a profile by name, an exact match before one that differs in case."""
    wanted = name.strip()
    return series.where((F.col("profile_id") == profile_id) & (F.lower("name") == wanted.lower())).orderBy((F.col("name") == wanted).desc(), "series_id").limit(1)


def status_priority(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for k, name in enumerate(STATUS_ORDER):
        out = F.when(status == name, F.lit(k)).otherwise(out)
    return out


def with_status(books: DataFrame, as_of: str, *, flags: bool = True, signals: bool = False) -> DataFrame:
    return books.withColumn("status", d.library_status({c: F.col(c) for c in ("is_read", "read_status", "release_date", "publication_date", "is_upcoming_auto", "is_upcoming_final", "is_missing", "series_id", "book_number")}, as_of, flags=flags, signals=signals))


def library_order(rows: DataFrame) -> list[Column]:
    """Available, upcoming, read, others; upcoming by date (latest first), then the newest row, then title."""
    date = F.coalesce("release_date", "publication_date")
    return [status_priority(F.col("status")), F.when(F.col("status") == "upcoming", date).desc_nulls_last(), F.col("book_id").desc(), F.col("title")]


def numbered(rows: DataFrame, order: list[Column], n: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their place in the order, within each `by` where it is given; the first n of them.

    For lists of a series, whose rows are few, and for a top-n, taken before the single window that numbers it; whole
    orders of a profile are `placed`.
    """
    if n is not None and not by:
        rows = rows.orderBy(*order).limit(n)
    rows = rows.withColumn("place", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order)))
    return rows if n is None else rows.where(F.col("place") <= n)


def in_ranges(rows: DataFrame, order: list[Column], by: tuple[str, ...]) -> DataFrame:
    """Rows dealt by ranges of (by, order), which Spark draws from a sample; stored, so that the ranges stay what they are."""
    return kept(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))


def placed(rows: DataFrame, order: list[Column], by: tuple[str, ...]) -> DataFrame:
    """Rows with their place in the whole order of each `by`, of which there may be few: no task gets more of one than a range of it.

    The place of a row is the number of rows of its `by` in the ranges before, told by one count for each range, and its
    number within its own.
    """
    parted = in_ranges(rows, order, by)
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parted.groupBy("range", *by).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("range", *by, F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range", *by).orderBy(*order))
    return parted.withColumn("within", within).join(offsets, ["range", *by]).withColumn("place", F.col("before") + F.col("within")).drop("range", "within", "before")


def status_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.trim(F.col(column)).alias("value")).where("value <> ''").distinct()


def search(series: DataFrame, needle: str) -> DataFrame:
    """Series whose name or author contains the needle, whatever the case."""
    low = needle.strip().lower()
    return series.where(F.lower(F.concat_ws(" ", text(F.col("name")), text(F.col("author")))).contains(low))


def standalone(books: DataFrame) -> DataFrame:
    return books.where(active() & (F.col("series_id").isNull() | (F.col("series_id") == 0)))


def unverified(books: DataFrame) -> DataFrame:
    return books.where(active() & d.needs_verification(F.col("read_status"), F.col("publication_date"), F.col("release_date")))


def pinned_first(books: DataFrame, pinned: list[int]) -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, pinned)), F.col("book_id"))
    return [F.when(place > 0, place).otherwise(len(pinned) + 1), F.coalesce("book_number", F.lit(0.0)), F.col("book_id")]


def recap(books: DataFrame, before: float | None = None) -> DataFrame:
    """Read books of each series with number and title, by number; the last one is what to remember, the others what came before."""
    rows = books.where(active() & (d.flag(F.col("is_read")) | (d.status(F.col("read_status")) == "read")) & F.col("book_number").isNotNull() & F.col("series_id").isNotNull() & ~blank(F.col("title")))
    if before is not None:
        rows = rows.where(F.col("book_number") < before)
    entries = F.array_sort(F.collect_list(F.struct("book_number", "book_id", "title")))
    return rows.groupBy("series_id").agg(entries.alias("entries")).select("series_id", F.element_at("entries", -1)["title"].alias("last"), F.array_join(F.transform(F.slice("entries", F.lit(1), F.size("entries") - 1), lambda e: e["title"]), " | ").alias("earlier"))


def eligible_for_discovery(known: DataFrame, state: DataFrame, series: DataFrame, books: DataFrame) -> DataFrame:
    """Series that a sweep may check: unfinished and caught up, nothing unread, upcoming or missing, a real author, and no active book to resolve again.

    known and state are those of intelligence; a deleted book's mark does not count.
    """
    from stacksight.functions.text import is_placeholder_author

    flagged = books.where(active() & d.flag(F.col("needs_reresolution"))).select("series_id").distinct()
    calm = state.where(F.col("is_caught_up") & ~F.col("has_unread_books") & ~F.col("has_upcoming_books")).select("series_id")
    whole = known.where(F.size("gaps") == 0).select("series_id")
    named = series.where(~d.flag(F.col("is_finished")) & ~blank(F.col("author")) & ~is_placeholder_author(F.col("author")))
    return named.join(calm, "series_id", "left_semi").join(whole, "series_id", "left_semi").join(flagged, "series_id", "left_anti").select("series_id", "profile_id", "name", "author")


def swept(eligible: DataFrame, profiles: DataFrame, running: DataFrame, deltas: DataFrame, now: str) -> DataFrame:
    """What a sweep does with each eligible series of the profiles whose last full sweep lies a cooldown back: checked with what its job brought, or skipped as a check of it is running.

    running: series_id; deltas: series_id, new_books, delta of the jobs.
    """
    free = profiles.where(d.cooldown_left(F.col("last_full_discovery_run_at"), F.lit(now).cast("timestamp")) == 0).select("profile_id")
    rows = eligible.join(free, "profile_id", "left_semi").join(running.select("series_id").distinct().withColumn("busy", F.lit(True)), "series_id", "left").join(deltas, "series_id", "left")
    checked = F.col("busy").isNull()
    told = lambda c: F.when(checked, F.coalesce(c, F.lit(0)))
    return rows.select("profile_id", "series_id", F.col("name").alias("series_name"), F.when(checked, "checked").otherwise("skipped_already_running").alias("outcome"), told("new_books").alias("new_books_found"), told("delta").alias("discovery_delta_count"))


def sweep_totals(outcomes: DataFrame) -> DataFrame:
    """Of each profile's sweep: series looked at, checked, books found and the sum of deltas; series that were skipped count for nothing."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return outcomes.groupBy("profile_id").agg(F.count(F.lit(1)).alias("completed"), F.count_if(F.col("outcome") == "checked").alias("checked"), count("new_books_found"), count("discovery_delta_count"))


def compared(books: DataFrame, a: int, b: int, fields: tuple[str, ...]) -> DataFrame:
    """Two rows field by field, and whether they differ."""
    rows = books.where(F.col("book_id").isin(a, b)).select("book_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", "value"))
    return rows.groupBy("field").agg(F.max(F.when(F.col("book_id") == a, F.col("value"))).alias("first"), F.max(F.when(F.col("book_id") == b, F.col("value"))).alias("second")).select("field", "first", "second", (~F.col("first").eqNullSafe(F.col("second"))).alias("different"))
