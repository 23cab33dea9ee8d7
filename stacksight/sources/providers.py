"""Raw answers of book catalogs (one JSON text a row) to hits of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksight.functions import text as t

GOOGLE = "volumeInfo struct<title:string,subtitle:string,authors:array<string>,publishedDate:string,description:string,language:string,infoLink:string,industryIdentifiers:array<struct<type:string,identifier:string>>>"
OPENLIBRARY = "title string, author_name array<string>, first_publish_year int, isbn array<string>, language array<string>, key string"
HARDCOVER = "title string, author_names array<string>, release_date string, isbns array<string>, unreleased boolean, series struct<name:string,position:double,books_count:int,primary_books_count:int>"
WEB = "title string, description string, url string"


def _hit(source: str, **fields: Column) -> list[Column]:
    kinds = {"title": "string", "authors": "array<string>", "published_date": "string", "description": "string", "isbn13": "string", "source_url": "string", "language": "string", "series_number_hint": "double", "upcoming_hint": "boolean", "series_name_hint": "string", "series_total_hint": "int"}
    return [F.lit(source).alias("source"), *(fields.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items())]


def isbn13_of(c: Column) -> Column:
    return F.get(F.filter(c, lambda x: F.length(x) == 13), F.lit(0))


def google_hits(raw: DataFrame, key: str) -> DataFrame:
    """Title with subtitle, the identifier of type ISBN_13; rows without title are dropped."""
    v = F.from_json("raw", GOOGLE)["volumeInfo"]
    rows = raw.select(key, v.alias("v"))
    isbn = F.get(F.filter("v.industryIdentifiers", lambda x: x["type"] == "ISBN_13"), F.lit(0))["identifier"]
    title = F.concat_ws(": ", t.filled(F.col("v.title")), t.filled(F.col("v.subtitle")))
    return rows.where(~t.blank(F.col("v.title"))).select(key, *_hit("google_books", title=title, authors=F.col("v.authors"), published_date=F.col("v.publishedDate"), description=F.col("v.description"), isbn13=isbn, source_url=F.col("v.infoLink"), language=F.col("v.language")))


def openlibrary_hits(raw: DataFrame, key: str) -> DataFrame:
    """The year as date, the first ISBN of 13 characters, the first language."""
    rows = raw.select(key, F.from_json("raw", OPENLIBRARY).alias("v"))
    return rows.where(~t.blank(F.col("v.title"))).select(key, *_hit("openlibrary", title=F.trim("v.title"), authors=F.col("v.author_name"), published_date=F.col("v.first_publish_year"), isbn13=isbn13_of(F.col("v.isbn")), source_url=F.concat(F.lit("https://openlibrary.org"), F.col("v.key")), language=F.get("v.language", F.lit(0))))


def hardcover_hits(raw: DataFrame, key: str) -> DataFrame:
    """Series name, place and size (its main books, else all), and whether it is out."""
    rows = raw.select(key, F.from_json("raw", HARDCOVER).alias("v"))
    total = F.coalesce("v.series.primary_books_count", "v.series.books_count")
    return rows.where(~t.blank(F.col("v.title"))).select(key, *_hit("hardcover", title=F.trim("v.title"), authors=F.col("v.author_names"), published_date=F.col("v.release_date"), isbn13=isbn13_of(F.col("v.isbns")), series_number_hint=F.col("v.series.position"), upcoming_hint=F.col("v.unreleased"), series_name_hint=F.col("v.series.name"), series_total_hint=total))


def web_hits(raw: DataFrame, key: str) -> DataFrame:
    """Title, description and url; rows that lack title or url are dropped."""
    return raw.select(key, F.from_json("raw", WEB).alias("v")).where(~t.blank(F.col("v.title")) & ~t.blank(F.col("v.url"))).select(key, "v.title", "v.description", "v.url")


def judged_web_hits(web: DataFrame, verdicts: DataFrame, target: str) -> DataFrame:
    """Web hits with their verdicts (url, accepted, title, authors, number, published_date, is_upcoming): accepted ones as hits, undated ones as upcoming."""
    rows = web.select("url").join(verdicts.where("accepted"), "url")
    upcoming = F.coalesce("is_upcoming", F.lit(False)) | t.blank(F.col("published_date"))
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit(target)))
    return rows.select("url", *_hit("web_search", title=F.col("title"), authors=authors, published_date=F.col("published_date"), source_url=F.col("url"), series_number_hint=F.col("number").cast("bigint"), upcoming_hint=upcoming))
