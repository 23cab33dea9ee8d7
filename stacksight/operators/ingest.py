"""Spreadsheet rows to books: headers, types, validation, series links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.sources.sheets import read_xlsx

# The canonical fields and the headers that mean them, without punctuation.
HEADERS: dict[str, tuple[str, ...]] = {
    "title": ("title", "titles", "book title", "name", "bookname"),
    "subtitle": ("subtitle", "sub title"),
    "author": ("author", "authors", "writer", "book author"),
    "series_name": ("series", "series name", "series title", "series names"),
    "series_confirmed": ("series confirmed", "confirm series", "series confirmation", "is series confirmed"),
    "book_number": ("book number", "book", "number", "order", "sequence", "seq"),
    "publication_date": ("publication date", "pub date", "published", "publish date"),
    "publisher": ("publisher", "publishing house", "imprint"),
    "edition": ("edition", "ed"),
    "format": ("format", "binding", "media"),
    "pages": ("pages", "page count", "num pages"),
    "language": ("language", "lang"),
    "isbn": ("isbn", "isbn10", "isbn 10"),
    "isbn13": ("isbn13", "isbn 13"),
    "asin": ("asin", "amazon id"),
    "google_books_id": ("google books id", "google id"),
    "goodreads_id": ("goodreads id", "gr id"),
    "storygraph_id": ("storygraph id", "sg id"),
    "date_added": ("date added", "added"),
    "date_started": ("date started", "started", "start date"),
    "date_finished": ("date finished", "finished", "finish date", "completed date", "date read", "read date"),
    "release_date": ("release date", "next release date"),
    "read_status": ("read status", "record status", "status", "reading status"),
    "series_finished": ("series finished", "series complete", "series completed"),
    "rating": ("rating", "stars", "score"),
    "review": ("review", "review text", "comments"),
    "notes": ("notes", "note", "personal notes"),
    "tags": ("tags", "labels", "categories"),
}
DATES = ("publication_date", "date_added", "date_started", "date_finished", "release_date")
#: The first row of data in a sheet whose first row has the headers.
FIRST_ROW = 2


def header_field(header: str) -> str | None:
    words = re.findall("[a-z0-9]+", header.lower())
    return next((field for field, names in HEADERS.items() if " ".join(words) in names), None)


def fields_of(headers: DataFrame, column: str) -> DataFrame:
    """Headers of many sheets, a row each, with the canonical field that they mean; null where none is known."""
    aliases = F.create_map(*(F.lit(x) for field, names in HEADERS.items() for name in names for x in (name, field)))
    return headers.withColumn("field", F.try_element_at(aliases, t.header_key(F.col(column))))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as text: blank cells are empty, nothing is guessed. Rows keep their order as row_number, within the file's splits."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000", emptyValue="", multiLine=True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .csv, or .xlsx read in tasks. The older binary .xls has to be saved as .xlsx before."""
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".xlsx"):
        return read_xlsx(spark, path)
    raise ValueError(f"not a sheet that can be read: {path}")


def mapped(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The sheet with canonical columns, unknown ones gathered in import_raw_row, and the unknown headers. Of headers that mean one field the last wins."""
    fields = {h: header_field(h) for h in rows.columns}
    unknown = [h for h, f in fields.items() if f is None]
    last = {f: h for h, f in fields.items() if f}
    raw = F.create_map(*[x for h in unknown for x in (F.lit(h), F.col(f"`{h}`"))]) if unknown else F.create_map().cast("map<string,string>")
    return rows.select(*(F.col(f"`{last[f]}`").alias(f) if f in last else F.lit(None).cast("string").alias(f) for f in HEADERS), raw.alias("import_raw_row")), unknown


def typed(rows: DataFrame) -> DataFrame:
    """Dates (a bare year is its first day), numbers and reading flags of mapped rows, error codes, and the number that the title tells where the cell is blank."""
    status = d.status(F.col("read_status"))
    own = t.number(F.col("book_number"))
    inferred = t.inferred_number(F.col("title"), F.col("series_name"))
    errors = F.array_compact(F.array(F.when(t.blank(F.col("title")), "missing_title"), F.when(t.blank(F.col("author")), "missing_author")))
    return rows.withColumns(
        {c: F.coalesce(F.when(t.text(F.col(c)).rlike(r"^\s*[12]\d{3}\s*$"), d.strict_date(F.col(c))), d.spreadsheet_date(F.col(c))) for c in DATES}
        | {"pages": d.whole_number(F.col("pages")), "rating": d.whole_number(F.col("rating")), "read_status": status, "is_read": status.isin(*d.READ_WORDS), "is_upcoming": status.isin(*d.UPCOMING_WORDS), "series_finished": d.series_finished(F.col("series_finished"))}
        | {"book_number": F.coalesce(own, inferred), "book_number_source": F.when(own.isNotNull(), "user").when(inferred.isNotNull(), "title_inferred"), "errors": errors}
    ).withColumn("date_read", F.col("date_finished"))


def link_reason() -> Column:
    named = t.is_meaningful_series(F.col("series_name"), F.col("author"))
    return F.when(t.blank(F.col("series_name")), "no_series_name_provided").when(~named, "series_name_looks_like_placeholder").otherwise("explicit_series_name")


def has_series_evidence() -> Column:
    """A number, a total above one, a marker in the title, or a series name that is not the title."""
    s, n = t.title_or_series_text(F.col("series_name")), t.title_or_series_text(F.col("title"))
    return (s != "") & (F.col("book_number").isNotNull() | t.text(F.col("title")).rlike(r"(?i)\bbook\s*\d+") | ((n != "") & (s != n)))


def series_of_rows(rows: DataFrame, series: DataFrame, profile_id: str) -> DataFrame:
    """Series named by linked rows: the one the profile has under that name, whatever its case, or a new one; the last row tells whether it is finished."""
    named = rows.where(link_reason() == "explicit_series_name").groupBy(F.lower(F.trim("series_name")).alias("key")).agg(F.min_by(F.trim("series_name"), "row_number").alias("name"), F.max_by("series_finished", "row_number").alias("is_finished"))
    own = series.where(F.col("profile_id") == profile_id).groupBy(F.lower("name").alias("key")).agg(F.min("series_id").alias("series_id"))
    return named.join(own, "key", "left").select("key", "series_id", "name", "is_finished", F.col("series_id").isNull().alias("is_new"))


def imported(rows: DataFrame, series: DataFrame, profile_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows with their series, bad rows with their errors, and the series. rows: typed, with row_number."""
    good = rows.where("size(errors) = 0")
    of = series_of_rows(good, series, profile_id)
    key = F.when(link_reason() == "explicit_series_name", F.lower(F.trim("series_name")))
    keyed = good.withColumn("key", key)
    # rows without a series have nothing to look for and would all meet in the task of the null key
    linked = keyed.where("key is not null").join(of.select("key", F.col("name").alias("linked_series"), "series_id"), "key", "left")
    alone = keyed.where("key is null").withColumns({"linked_series": F.lit(None).cast("string"), "series_id": F.lit(None).cast("long")})
    return linked.unionByName(alone).drop("key"), rows.where("size(errors) > 0"), of


#: The columns of a book; what else a sheet has stays in its raw row.
BOOK_COLUMNS = tuple(f for f in HEADERS if f not in ("series_name", "series_confirmed", "date_finished", "series_finished")) + ("is_read", "date_read")


def payload(rows: DataFrame) -> DataFrame:
    """Imported rows as books to be written, with the series that they are linked to: only columns that books have, the title trimmed, a whole number as the order too; `given` names the columns that have a value."""
    number = F.col("book_number")
    order = F.when(number == F.floor(number), number.cast("bigint"))
    given = F.array_compact(F.array(*(F.when(~t.blank(F.col(c)), F.lit(c)) for c in BOOK_COLUMNS)))
    return rows.select("row_number", "series_id", "linked_series", *(F.trim(c).alias(c) if c == "title" else F.col(c) for c in BOOK_COLUMNS), "book_number_source", order.alias("series_order"), F.array_sort(given).alias("given"))


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of the sheet; each task keeps n at most."""
    return rows.orderBy("row_number").limit(n)
