"""Candidates against a series' durable lineup: what is missing or malformed, and how sure each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksight.functions import text as t

#: Metadata below this share is too thin.
LEAST_METADATA = 0.5
GRADES = ("zero", "low", "medium", "high")
# The grade of a provider, and the reasons that concern title or number.
PROVIDER_GRADES = {"hardcover": "high", "google_books": "medium", "openlibrary": "low", "web_search": "low"}
TITLE_REASONS = ("missing_title", "placeholder_title", "title_is_series_variant")
NUMBER_REASONS = ("invalid_number", "negative_number", "duplicate_number")


def is_variant() -> Column:
    return t.is_series_variant(F.col("title"), F.col("target"), F.col("isbn13"), F.col("series_number_hint"))


def malformed_reason(variant: Column | None = None) -> Column:
    """The first thing that is wrong with a candidate (title, target, isbn13, series_number_hint, completeness)."""
    n = F.col("series_number_hint")
    return (
        F.when(t.blank(F.col("title")), "missing_title").when(t.is_placeholder_title(F.col("title")), "placeholder_title")
        .when(is_variant() if variant is None else variant, "title_is_series_variant").when(F.isnan(n), "invalid_number").when(n <= 0, "negative_number")
        .when(F.col("completeness") < LEAST_METADATA, "insufficient_metadata")
    )


def _compared(candidates: DataFrame, lineup: DataFrame) -> DataFrame:
    """Candidates with variant, reasons, missing and the columns of the lineup (series_id, series_number_hint, known, one row a number).

    What meets the lineup lies by series and number, so how many sound candidates share a number is counted there and
    then: candidates are computed once.
    """
    same = Window.partitionBy("series_id", "series_number_hint")
    rows = candidates.withColumn("variant", is_variant()).withColumn("reason", malformed_reason(F.col("variant"))).join(lineup, ["series_id", "series_number_hint"], "left")
    rows = rows.withColumn("sharing", F.count_if(F.col("reason").isNull()).over(same))
    twice = F.col("reason").isNull() & F.col("series_number_hint").isNotNull() & (F.col("sharing") > 1)
    reasons = F.array_compact(F.array(F.col("reason"), F.when(twice, "duplicate_number")))
    return rows.withColumns({"reasons": reasons, "missing": F.col("reason").isNull() & F.col("known").isNull()}).drop("sharing", "reason")


def delta(candidates: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Candidates with their reasons (duplicate numbers among sound ones included) and whether the lineup lacks them. skeleton: series_id, book_number."""
    known = skeleton.select("series_id", F.col("book_number").alias("series_number_hint")).distinct().withColumn("known", F.lit(True))
    return _compared(candidates, known).drop("known", "variant")


def numbering_gaps(candidates: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Numbers of the lineup that no sound candidate has."""
    found = candidates.where(malformed_reason().isNull() & F.col("series_number_hint").isNotNull()).select("series_id", F.col("series_number_hint").alias("book_number"))
    return skeleton.select("series_id", "book_number").distinct().join(found.distinct(), ["series_id", "book_number"], "left_anti")


def provider_grade(sources: Column) -> Column:
    rank = lambda s: F.when(s == "hardcover", 3).when(s == "google_books", 2).otherwise(1)
    return F.element_at(F.array(*map(F.lit, GRADES)), F.coalesce(F.array_max(F.transform(sources, rank)), F.lit(1)) + 1)


def title_grade() -> Column:
    flagged = F.exists("reasons", lambda r: r.isin(*TITLE_REASONS)) | F.col("variant")
    same = t.normalized(F.col("title")) == t.normalized(F.col("known_title"))
    return F.when(flagged, "zero").when(F.col("known_title").isNull(), "unverified").when(same, "high").when(t.core_title_key(F.col("title")) == t.core_title_key(F.col("known_title")), "medium").otherwise("low")


def number_grade() -> Column:
    n = F.col("series_number_hint")
    return F.when(F.exists("reasons", lambda r: r.isin(*NUMBER_REASONS)) | n.isNull() | F.isnan(n) | (n <= 0), "low").when(F.col("known_title").isNotNull(), "high").otherwise("medium")


def overall(*grades: Column) -> Column:
    """Any zero is zero; all high is high; nothing below medium or unverified is medium; else low."""
    g = F.array(*grades)
    return F.when(F.exists(g, lambda x: x == "zero"), "zero").when(F.forall(g, lambda x: x == "high"), "high").when(F.forall(g, lambda x: x.isin("high", "medium", "unverified")), "medium").otherwise("low")


def graded(candidates: DataFrame, skeleton: DataFrame) -> DataFrame:
    """The four grades and the overall one. skeleton: series_id, book_number, title, ord (the last entry of a number counts)."""
    entry = skeleton.where("book_number is not null").groupBy("series_id", F.col("book_number").alias("series_number_hint")).agg(F.max_by("title", "ord").alias("known_title")).withColumn("known", F.lit(True))
    rows = _compared(candidates, entry)
    rows = rows.withColumns({"provider_grade": provider_grade(F.col("sources")), "title_grade": title_grade(), "number_grade": number_grade(), "alignment_grade": t.series_alignment(F.array("author"), F.col("target_author"))})
    return rows.withColumn("overall", overall(*(F.col(f"{g}_grade") for g in ("provider", "title", "number", "alignment")))).drop("known", "variant")

