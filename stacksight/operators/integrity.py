"""Reports on rows that contradict each other, and repairs as functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions.text import author_identity, blank, is_placeholder_author
from stacksight.operators.intelligence import active


def ghost_books(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books whose profile differs from that of their series."""
    of = series.select("series_id", F.col("profile_id").alias("series_profile"), F.col("name").alias("series_name"))
    return books.join(of, "series_id").where(F.col("profile_id") != F.col("series_profile")).select("book_id", "title", "series_id", "series_name", "profile_id", "series_profile")


def rehomed(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books with the profile of their series; changed tells where it differed."""
    of = series.select("series_id", F.col("profile_id").alias("series_profile"))
    home = F.coalesce("series_profile", "profile_id")
    return books.join(of, "series_id", "left").withColumn("changed", home != F.col("profile_id")).withColumn("profile_id", home).drop("series_profile")


def deleted_books(books: DataFrame, series: DataFrame) -> DataFrame:
    of = series.select("series_id", F.col("name").alias("series_name"))
    return books.where(~active()).join(of, "series_id", "left").select("book_id", "title", "author", "series_id", "series_name", "book_number")


def orphans(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books that name a series that is not there. A null series_id would pass an anti join, so it is sorted out before."""
    return books.where("series_id is not null").join(series.select("series_id"), "series_id", "left_anti").select("book_id", "title", "series_id", "profile_id")


def without_orphans(books: DataFrame, series: DataFrame) -> DataFrame:
    return books.join(series.select("series_id").withColumn("there", F.lit(True)), "series_id", "left").where("series_id is null or there").drop("there")


def restored(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted books among ids made active; status tells of each id what came of it."""
    asked = ids.select("book_id").distinct().join(books.select("book_id", "record_status"), "book_id", "left")
    status = F.when(F.col("record_status").isNull() & ~F.col("known"), "not_found").when(active(), "not_deleted").otherwise("restored")
    known = asked.join(books.select("book_id").withColumn("known", F.lit(True)), "book_id", "left").withColumn("known", d.flag(F.col("known")))
    return known.select("book_id", status.alias("status"))


def stale_flags(books: DataFrame) -> DataFrame:
    """Read books that still carry a mark of a missing or upcoming one."""
    marks = [d.flag(F.col(c)) for c in ("is_missing", "is_upcoming_auto", "is_upcoming_final")]
    return books.where((d.flag(F.col("is_read")) | (d.status(F.col("read_status")) == "read")) & (marks[0] | marks[1] | marks[2])).select("book_id", "series_id", "is_missing", "is_upcoming_auto", "is_upcoming_final")


def healed(books: DataFrame, as_of: str, key: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """read_status, is_missing and upcoming flags as dates and flags demand, and whether anything changed."""
    c = F.col
    new = d.healed_status(c("is_read"), c("read_status"), c("publication_date"), c("release_date"), c("is_upcoming_auto"), c("is_upcoming_final"), as_of)
    out = books.withColumn("new_status", new)
    missing = F.when(c("new_status") == "read", False).otherwise(d.flag(c("is_missing")))
    auto = F.when(c("new_status") == "available", False).otherwise(d.flag(c("is_upcoming_auto")))
    final = F.when(c("new_status") == "available", False).otherwise(d.flag(c("is_upcoming_final")))
    changed = ~d.status(c("read_status")).eqNullSafe(c("new_status")) | (missing != d.flag(c("is_missing"))) | (auto != d.flag(c("is_upcoming_auto"))) | (final != d.flag(c("is_upcoming_final")))
    return out.select(*key, c("new_status").alias("read_status"), missing.alias("is_missing"), auto.alias("is_upcoming_auto"), final.alias("is_upcoming_final"), changed.alias("changed"))


def recovered_fields(books: DataFrame, fields: tuple[str, ...] = ("publication_date", "release_date", "isbn13", "asin", "edition")) -> DataFrame:
    """Active books take fields that they lack from deleted ones of the same series and number, the smallest book_id first."""
    lost = books.where(~active() & F.col("series_id").isNotNull() & F.col("book_number").isNotNull())
    given = lost.groupBy("series_id", "book_number").agg(*(F.min_by(f, F.when(~blank(F.col(f)), F.col("book_id"))).alias(f"lost_{f}") for f in fields))
    live = books.where(active() & F.col("series_id").isNotNull() & F.col("book_number").isNotNull()).join(given, ["series_id", "book_number"])
    gets = [blank(F.col(f)) & ~blank(F.col(f"lost_{f}")) for f in fields]
    return live.select("book_id", *(F.when(g, F.col(f"lost_{f}")).otherwise(F.col(f)).alias(f) for f, g in zip(fields, gets, strict=True)), F.array_compact(F.array(*(F.when(g, F.lit(f)) for f, g in zip(fields, gets, strict=True)))).alias("changed")).where("size(changed) > 0")


def authors_from_books(books: DataFrame, series: DataFrame) -> DataFrame:
    """Series without author whose active books agree on one; outcome tells filled, conflict or none."""
    known = books.where(active() & ~blank(F.col("author")) & ~is_placeholder_author(F.col("author"))).groupBy("series_id").agg(F.count_distinct(author_identity(F.col("author"))).alias("names"), F.min(F.trim("author")).alias("found"))
    return series.where(blank(F.col("author"))).join(known, "series_id", "left").select(
        "series_id", F.when(F.col("names") == 1, F.col("found")).alias("author"), F.when(F.col("names") == 1, "filled").when(F.col("names") > 1, "conflict").otherwise("none").alias("outcome"),
    )


def without_placeholder_authors(series: DataFrame) -> DataFrame:
    return series.withColumn("cleared", is_placeholder_author(F.col("author"))).withColumn("author", F.when(~F.col("cleared"), F.col("author")))


def checked_links(books: DataFrame, series: DataFrame) -> DataFrame:
    """Error codes of each book: a number without a series, a series of another profile or none."""
    of = series.select("series_id", F.col("profile_id").alias("home"))
    codes = F.array_compact(F.array(
        F.when(F.col("book_number").isNotNull() & F.col("series_id").isNull(), "number_without_series"),
        F.when(F.col("series_id").isNotNull() & F.col("home").isNull(), "unknown_series"),
        F.when(F.col("home") != F.col("profile_id"), "series_of_other_profile"),
    ))
    return books.join(of, "series_id", "left").select("book_id", codes.alias("errors")).where("size(errors) > 0")


def skeletons(books: DataFrame) -> DataFrame:
    """The durable lineup of each series: its numbered active books as structs in order of number."""
    entry = F.struct("book_number", "title", F.col("read_status").alias("status"), F.lit("high").alias("confidence"), F.coalesce("release_date", "publication_date").alias("release_date"), F.array_compact(F.array("edition")).alias("edition_hints"))
    return books.where(active() & F.col("series_id").isNotNull() & F.col("book_number").isNotNull()).groupBy("series_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
