"""Mutations as functions from one snapshot of a table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t


def requested(requests: DataFrame, series: DataFrame) -> DataFrame:
    """Requests for new books as they would be written, and why one is refused (error, null where it is not).

    requests: profile_id, title, series_id, book_number, find_confidence. The title is trimmed; a number that is not
    given is told by the title, and where it comes from is kept; a book bound to a hit found is the provider's (to be
    resolved again where the hit was of low confidence), any other the user's. A series must be one of the profile, and a
    number needs a series.
    """
    of = series.select("series_id", F.col("profile_id").alias("home"), F.col("name").alias("series_name"))
    rows = requests.join(of, "series_id", "left").withColumn("title", F.trim("title"))
    told = t.inferred_number(F.col("title"), F.coalesce("series_name", F.lit("")))
    number, source = F.coalesce("book_number", told), F.when(F.col("book_number").isNotNull(), "user").when(told.isNotNull(), "title_inferred")
    origin = d.provenance(F.col("find_confidence"))
    foreign = F.col("series_id").isNotNull() & ~F.coalesce(F.col("home") == F.col("profile_id"), F.lit(False))
    error = F.when(foreign, "series_of_other_profile").when(F.col("series_id").isNull() & F.col("new_number").isNotNull(), "number_without_series")
    rows = rows.withColumns({"new_number": number, "book_number_source": source, "origin": origin})
    keep = [c for c in requests.columns if c not in ("title", "series_id", "book_number", "find_confidence")]
    order = F.when(F.col("new_number") == F.floor("new_number"), F.col("new_number").cast("bigint"))
    return rows.select(*keep, "title", "series_id", F.col("new_number").alias("book_number"), "book_number_source", order.alias("series_order"), "origin.metadata_source", "origin.needs_reresolution", error.alias("error"))


def created(table: DataFrame, requests: DataFrame) -> DataFrame:
    """The table with the requests that were not refused."""
    return table.unionByName(requests.where("error is null").drop("error"), allowMissingColumns=True)


def patched(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Rows with the values that patches set. A patch has key, a column `set` with the names it sets, and those columns; null clears."""
    names = [c for c in patches.columns if c not in (key, "set")]
    p = patches.select(key, F.col("set").alias("__set"), *(F.col(c).alias(f"__{c}") for c in names))
    out = table.join(p, key, "left")
    return out.select(*(F.when(F.array_contains("__set", c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def deleted(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def series_deleted(books: DataFrame, series: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and series without those of ids."""
    return deleted(books, ids, "series_id"), deleted(series, ids, "series_id")


def series_finished(books: DataFrame, series: DataFrame, ids: DataFrame, finished: bool) -> tuple[DataFrame, DataFrame]:
    """The flag on series of ids and on their active books."""
    marked = ids.select("series_id").distinct().withColumn("__hit", F.lit(True))
    b = books.join(marked, "series_id", "left").withColumn("is_series_finished", F.when(F.col("__hit") & (F.col("record_status").isNull() | (F.col("record_status") != "deleted")), F.lit(finished)))
    s = series.join(marked, "series_id", "left").withColumn("is_finished", F.when(F.col("__hit"), F.lit(finished)).otherwise(F.col("is_finished")))
    return b.drop("__hit"), s.drop("__hit")


def profile_reset(table: DataFrame, profile_id: str) -> DataFrame:
    return table.where(F.col("profile_id") != profile_id)


def dismissed(notifications: DataFrame, at: str, *, profile_id: str | None = None, notification_id: int | None = None) -> DataFrame:
    """Notifications with dismissed_at set where they are live and meant; those already dismissed keep their time."""
    meant = F.lit(True)
    if profile_id is not None:
        meant = meant & (F.col("profile_id") == profile_id)
    if notification_id is not None:
        meant = meant & (F.col("notification_id") == notification_id)
    return notifications.withColumn("dismissed_at", F.when(F.col("dismissed_at").isNull() & meant, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("dismissed_at")))


def new_profiles(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """Ids made of names, trimmed and in lower case, with the reason where one cannot be taken."""
    asked = names.select(F.lower(F.trim("name")).alias("profile_id"), F.trim("name").alias("display_name"))
    taken = profiles.select("profile_id").withColumn("taken", F.lit(True))
    reason = F.when(F.col("profile_id") == "", "blank").when(F.col("taken"), "taken").otherwise("ok")
    return asked.join(taken, "profile_id", "left").select("profile_id", "display_name", reason.alias("outcome"))
