"""Golden cases of the scalar rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.functions import titles as w


@pytest.fixture(scope="module")
def value(spark):
    def of(expression, **columns):
        names, values = list(columns), [tuple(columns.values())]
        kinds = {str: "string", float: "double", int: "int", type(None): "string", dt.date: "date", list: "array<string>", bool: "boolean"}
        row = spark.createDataFrame(values, ", ".join(f"{n} {kinds[type(v)]}" for n, v in columns.items())) if names else spark.range(1)
        return row.select(expression.alias("v")).collect()[0]["v"]

    return of


A, B, N = "a", "b", "n"


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (t.title_identity, "Iron Flame SIGNED", "iron flame"), (t.title_identity, "Iron Flame (Kindle Edition)", "iron flame"), (t.title_identity, "The Signed Confession", "the signed confession"),
        (t.author_identity, "Ann Bee and 2 more", "ann bee"), (t.author_identity, "Bob, Editor", "bob"), (t.is_placeholder_author, "Unknown author", True), (t.is_placeholder_author, "", False),
        (t.series_identity, "The Empyrean Series", "the empyrean"), (t.core_segment, "Crown: A Tale (Unbound Book 9)", "Crown"), (t.bare_title_key, "The Reality of Everything: x", "reality of everything"),
        (t.core_title_key, "Crown: A LitRPG: (Unbound Book 9)", "crown 9"), (t.inferred_number, "Onyx #3.5", 3.5), (t.inferred_number, "Unbound Book Seven", 7.0), (t.inferred_number, "Vol. 12: The End", 12.0), (t.inferred_number, "Plain", None),
        (t.is_placeholder_title, "Untitled Book 4", True), (t.is_placeholder_title, "Batbane", False), (t.is_not_new_release, "The Complete Series", True), (t.is_not_new_release, "Tales, 3 books in 1", True), (t.is_not_new_release, "A Real Book", False),
        (t.branding_name, "Duchy of Terra Universe", "duchy of terra"), (t.series_hint, "A Little Too Close - Madigan Mountain #2", "Madigan Mountain"), (t.series_hint, "X: a Foo Bar universe novella", "Foo Bar"),
        (t.clean_display_title, "A Little Too Close - Madigan Mountain #2", "A Little Too Close"), (t.edition_from_title, "X (Audible Audio)", "audio"), (t.edition_from_title, "X: Mass Market Paperback", "paperback"), (t.primary_author, "J.N Chaney; Terry Maggert", "J.N Chaney"),
        (t.identity_number, "3.0", "3"), (t.identity_number, "x1 ", "x1"), (w.cleaned, "Crown:  An Epic LitRPG Adventure (Unbound Book 9)", "Crown: A LitRPG (Unbound Book 9)"), (w.cleaned, "Stone ebook", "Stone"), (w.name_only, "Stone - A Tale: (Unbound Book 2)", "Stone"),
        (w.number_in_title, "Stone Book 2.5", 2.5), (d.roman, "MCMXCIV", 1994), (d.roman, "abc", None), (d.token_number, "Twelve", 12), (d.token_number, "0", None), (d.omnibus_numbers, "Books One to Three", [1, 2, 3]), (d.omnibus_numbers, "Volumes III-I", [3, 2, 1][::-1]), (d.omnibus_numbers, "1-3", []),
        (d.flexible_date, "2023-11", dt.date(2023, 11, 1)), (d.flexible_date, "2023-02-30", None), (d.strict_date, "2023", dt.date(2023, 1, 1)), (d.spreadsheet_date, "45292", dt.date(2024, 1, 1)), (d.spreadsheet_date, "7/4/2021", dt.date(2021, 7, 4)), (d.spreadsheet_date, "25-12-2021", dt.date(2021, 12, 25)),
        (d.client_date, "1/2/24", dt.date(2024, 1, 2)), (d.parsed_flag, " Yes", True), (d.parsed_flag, "maybe", None), (d.series_finished, "no", False), (d.series_finished, "maybe", True), (t.has_series_number, "Crown, Part 3", True), (t.has_series_number, "Area 51", False),
    ],
)
def test_rules(value, rule, given, want):
    got = value(rule(F.col(A)), a=given)
    assert (sorted(got) if isinstance(got, list) else got) == want


def test_number_keys(value):
    key = lambda s, n: value(t.series_book_key(F.col(A), F.col(N)), a=s, n=n)
    assert key("Unbound Series", 3.0) == "unbound|3" and key("Unbound", 3.5) == "unbound|3.5" and key("Unbound", 0.0) is None and key("", 3.0) is None


def test_names_and_variants(value):
    two = lambda f, a, b: value(f(F.col(A), F.col(B)), a=a, b=b)
    assert two(t.series_names_compatible, "Jonathan Hunt", "Jonathan Hunt Thriller Series") and not two(t.series_names_compatible, "Jonathan Hunt", "Hunt for Red October")
    assert two(t.same_author, "Ann Bee", "ann bee, author") and not two(t.same_author, "", "") and not two(t.same_author_as_written, "Ann Bee", "ann bee, author")
    variant = lambda title, series, isbn, n: value(t.is_series_variant(F.col("x"), F.col("y"), F.col("z"), F.col(N)), x=title, y=series, z=isbn, n=n)
    assert variant("A Jonathan Hunt Thriller", "Jonathan Hunt", "", 0.0) and not variant("A Jonathan Hunt Thriller", "Jonathan Hunt", "978", 0.0)
    assert variant("Mistborn", "Mistborn", "", 6.0) and not variant("Mistborn", "Mistborn", "", 1.0)
    align = lambda c, s: value(t.series_alignment(F.array(F.col(A)), F.col(B)), a=c, b=s)
    assert [align("Georgia Wagner", "GJ Wagner"), align("Wagner Georgia", "Georgia Wagner"), align("Ann Bee", "Georgia Wagner"), align("Ann", "")] == ["medium", "high", "zero", "low"]
    assert value(t.inferred_number(F.col(A), F.col(B)), a="Dungeon Crawler Carl 5", b="Dungeon Crawler Carl") == 5.0


def test_titles_with_series(value):
    of = lambda f, **k: value(f, **k)
    assert of(w.new_clean(F.col(A), F.col(B), F.col(N)), a="Crown: A LitRPG (Unbound Book 9)", b="Unbound", n=9.0) == "Crown (Unbound Book 9)"
    assert of(w.clean_up(F.col(A), F.col(B)), a="Unbound: Unbound The Fall", b="Unbound") == "Unbound: The Fall"
    assert of(w.storage_title(F.col(A), F.col(B), F.col(N)), a="Book 13", b="Lifesteal", n=13.0) == "Lifesteal 13: (Lifesteal Book 13)"
    assert of(w.custom_pattern("{series_name} {book_number}: {book_title} ({book_subtitle})", F.col(A), F.col(B), F.col(N), F.lit("")), a="Crown", b="Unbound", n=9.0) == "Unbound 9: Crown"


def test_health_and_status(value):
    day = lambda x: value(d.discovery_health(F.col("day"), "2024-07-01"), day=x)
    assert [day(dt.date(2024, 7, 1) - dt.timedelta(k)) for k in (183, 184, 365, 366, -9)] == ["healthy", "stale", "stale", "very_stale", "healthy"]
    heal = lambda read, status, pub: value(d.healed_status(F.col("r"), F.col("s"), F.col("p"), F.lit(None).cast("date"), F.lit(False), F.lit(None), "2024-07-01"), r=read, s=status, p=pub)
    assert [heal(False, "upcoming", dt.date(2024, 1, 1)), heal(False, "available", dt.date(2025, 1, 1)), heal(True, "upcoming", dt.date(2025, 1, 1))] == ["available", "upcoming", "read"]
