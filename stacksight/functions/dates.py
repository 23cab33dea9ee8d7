"""Dates, numbers and status flags. What depends on today takes it as as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacksight.functions.text import NUMBER_WORDS, number, text

STALE_AFTER, VERY_STALE_AFTER = 183, 365
COOLDOWN_DAYS = 7
UPCOMING_WORDS = ("upcoming", "tbr", "to be read")
READ_WORDS = ("read", "completed", "finished")


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def status(c: Column) -> Column:
    return F.lower(F.trim(text(c)))


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD, or YYYY for its first day; null for all else."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd"))


def flexible_date(c: Column) -> Column:
    t = F.trim(text(c))
    return F.coalesce(strict_date(c), F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd")))


def spreadsheet_date(c: Column) -> Column:
    """ISO, month/day/year, day-month-year, or a serial day number of a spreadsheet."""
    t = F.trim(text(c))
    part = lambda k, n: F.lpad(F.regexp_extract(t, k, n), 2, "0")
    us, eu = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    of = lambda k, y, m, d: F.when(t.rlike(k), F.try_to_date(F.concat_ws("-", F.regexp_extract(t, k, y), part(k, m), part(k, d)), "yyyy-MM-dd"))
    serial = F.when(t.rlike(r"^\d{1,6}$"), F.date_add(F.lit("1899-12-30").cast("date"), t.cast("int")))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), of(us, 3, 1, 2), of(eu, 3, 2, 1), serial)


def client_date(c: Column) -> Column:
    """ISO, month/day/year with two or four digits of the year, year/month/day."""
    t = F.trim(text(c))
    us, iso = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    get = lambda k, n: F.regexp_extract(t, k, n)
    pad = lambda x: F.lpad(x, 2, "0")
    year = F.when(F.length(get(us, 3)) == 2, F.concat(F.lit("20"), get(us, 3))).otherwise(get(us, 3))
    return F.coalesce(F.when(t.rlike(iso), F.try_to_date(F.concat_ws("-", get(iso, 1), pad(get(iso, 2)), pad(get(iso, 3))), "yyyy-MM-dd")), F.when(t.rlike(us), F.try_to_date(F.concat_ws("-", year, pad(get(us, 1)), pad(get(us, 2))), "yyyy-MM-dd")))


def is_placeholder_date(c: Column) -> Column:
    return F.trim(text(c)).rlike(r"^\d{4}-01-01$")


def is_upcoming(date: Column, hint: Column, as_of: str) -> Column:
    return F.coalesce(date > F.lit(as_of).cast("date"), hint, F.lit(False))


def healed_status(read: Column, read_status: Column, publication: Column, release: Column, auto: Column, final: Column, as_of: str) -> Column:
    """read, upcoming or available: reading wins, then a known date, then the flags."""
    known = F.coalesce(release, publication)
    upcoming = F.coalesce(known > F.lit(as_of).cast("date"), flag(auto) | flag(final) | (status(read_status) == "upcoming"))
    return F.when(flag(read) | (status(read_status) == "read"), "read").when(upcoming, "upcoming").otherwise("available")


def discovery_health(last_checked: Column, as_of: str) -> Column:
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), last_checked))
    return F.when(last_checked.isNull(), "never").when(age <= STALE_AFTER, "healthy").when(age <= VERY_STALE_AFTER, "stale").otherwise("very_stale")


def cooldown_left(last_run: Column, now: Column) -> Column:
    """Seconds until the next sweep may start; 0 where it may."""
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(last_run) + COOLDOWN_DAYS * 86400 - F.unix_timestamp(now)), F.lit(0)).cast("bigint")


def cooldown_hours(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(seconds / 3600).cast("int"))


def roman(c: Column) -> Column:
    """The value of roman digits, read from the right: a smaller one before a larger one is taken off."""
    t = F.upper(F.trim(text(c)))
    value = lambda d: F.when(d == "I", 1).when(d == "V", 5).when(d == "X", 10).when(d == "L", 50).when(d == "C", 100).when(d == "D", 500).otherwise(1000)
    digits = F.reverse(F.split(t, ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    step = lambda a, d: F.struct((a["total"] + F.when(value(d) < a["most"], -value(d)).otherwise(value(d))).alias("total"), F.greatest(a["most"], value(d)).alias("most"))
    total = F.aggregate(digits, start, step, lambda a: a["total"])
    return F.when(t.rlike("^[IVXLCDM]+$") & (total > 0), total)


def token_number(c: Column) -> Column:
    """The number of digits, a word up to twenty or roman digits."""
    t = F.lower(F.trim(text(c)))
    n = F.when(t.rlike(r"^\d{1,9}$"), t.cast("int"))
    word = F.nullif(F.coalesce(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), t), F.lit(0)), F.lit(0)).cast("int")
    return F.when(n.isNotNull(), F.when(n > 0, n)).otherwise(F.coalesce(word, roman(t)))


_TOKEN = r"(?:\d+|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r"|[ivxlcdm]+)"
_RANGE = rf"(?i)\b({_TOKEN})\b\s*(?:-|–|—|to|thru|through)\s*\b({_TOKEN})\b"


def _range_end(c: Column) -> Column:
    """An end of a range: any number that a long holds."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^\d{10,18}$"), t.cast("bigint")).otherwise(token_number(c).cast("bigint"))


def omnibus_ranges(c: Column) -> Column:
    """The ranges (lo, hi) of a title that has a word for book or volume: `Books 1-3`, `Volume I to III`; of any width, as they are not laid out."""
    t = text(c)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(_RANGE), F.lit(2)).alias("b"))
    ends = F.transform(pairs, lambda p: F.struct(_range_end(p["a"]).alias("a"), _range_end(p["b"]).alias("b")))
    fine = F.filter(ends, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    ranges = F.transform(fine, lambda p: F.struct(F.least(p["a"], p["b"]).alias("lo"), F.greatest(p["a"], p["b"]).alias("hi")))
    return F.when(t.rlike(r"(?i)\b(?:books?|volumes?|vol\.?)\b"), ranges).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))


def laid_out(ranges: Column) -> Column:
    """Every number of an array of ranges, for display."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))


def omnibus_numbers(c: Column) -> Column:
    """The numbers of all ranges of a title, laid out; operators work on omnibus_ranges instead."""
    return F.array_distinct(laid_out(omnibus_ranges(c)))


def truncated_number(c: Column) -> Column:
    n = number(c)
    return F.when(n > 0, n.cast("bigint"))


def integral_number(c: Column) -> Column:
    n = number(c)
    return F.when(n == F.floor(n), n.cast("bigint"))


def whole_number(c: Column) -> Column:
    return number(c).cast("bigint")


def parsed_flag(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t.isin("1", "true", "t", "yes", "y", "confirmed"), True).when(t.isin("0", "false", "f", "no", "n", "unconfirmed"), False)


def series_finished(c: Column) -> Column:
    return ~F.lower(F.trim(text(c))).isin("no", "false", "n")


def reading_status(c: Column) -> Column:
    t = status(c)
    return F.when(t.isin(*READ_WORDS), "read").when(t.isin(*UPCOMING_WORDS), "upcoming").otherwise("other")


def provenance(tier: Column) -> Column:
    """metadata_source and needs_reresolution of a record bound at a tier; without a tier it was typed by the user."""
    known = status(tier).isin("low", "medium", "high")
    return F.struct(F.when(known, "provider").otherwise("user").alias("metadata_source"), F.when(known, status(tier) == "low").alias("needs_reresolution"))


def library_status(b: dict[str, Column], as_of: str, *, flags: bool, signals: bool = False) -> Column:
    """read, upcoming, available or unread as a list shows it. flags: whether marks, gaps and numbers decide where no date does."""
    today = F.lit(as_of).cast("date")
    known = F.coalesce(b["release_date"], b["publication_date"])
    said = status(b["read_status"])
    out = F.when(flag(b["is_read"]) | (said == "read"), "read")
    out = out.when((said == "upcoming") & (known <= today), "available").when(said == "upcoming", "upcoming").when(said == "available", "available")
    out = out.when(known > today, "upcoming").when(known.isNotNull(), "available")
    if flags:
        out = out.when(flag(b["is_upcoming_final"]) | flag(b["is_upcoming_auto"]), "upcoming").when(flag(b["is_missing"]), "available").when(b["series_id"].isNotNull() & b["book_number"].isNotNull(), "available")
    if signals:
        out = out.when(said.isin(*UPCOMING_WORDS), "upcoming")
    return out.otherwise("unread")


def needs_verification(read_status: Column, publication: Column, release: Column) -> Column:
    return status(read_status).isin("upcoming", "available") & publication.isNull() & release.isNull()
