"""Scalar rules over titles, authors, numbers and dates (inventory F)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import sql
from stacksight.functions import text as t
from stacksight.functions import titles as w
from stacksight.plans import duck
from stacksight.plans.registry import register
from stacksight.sources.library import AS_OF

EPIC = "A LitRPG Adventure"


def scalar(key: str, value: Callable[[], Column], sql: str | None = None) -> None:
    """The value over the title cases, and its twin."""
    register(key, lambda v: v.cases.select("id", value().alias("value")), sql and f"SELECT id, {sql} AS value FROM title_cases")


def words_of(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


scalar("F1_discovered_title_key", lambda: t.discovered_title_key(F.col("title")), duck.discovered_title("title"))
scalar("F2_identity_text", lambda: t.identity_text(F.col("title")), duck.identity("title"))
scalar("F3_author_identity", lambda: t.author_identity(F.col("author")), duck.author("author"))
register(
    "F4_authors_match",
    lambda v: v.cases.select("id", t.same_author(F.col("author"), F.concat(F.col("author"), F.lit(", Editor"))).alias("strict"), t.same_author_as_written(F.col("author"), F.upper(F.col("author"))).alias("lenient"), t.same_author(F.col("author"), F.col("series")).alias("other")),
    f"""SELECT id, {duck.author('author')} <> '' AND {duck.author("author || ', Editor'")} <> '' AND {duck.author('author')} = {duck.author("author || ', Editor'")} AS strict,
    lower(trim({duck.text('author')})) <> '' AS lenient, {duck.author('author')} <> '' AND {duck.author('series')} <> '' AND {duck.author('author')} = {duck.author('series')} AS other FROM title_cases""",
)
scalar("F5_placeholder_author", lambda: t.is_placeholder_author(F.col("author")), f"{duck.author('author')} IN ('unknown', 'n a', 'none', 'various')")
scalar("F6_series_identity", lambda: t.series_identity(F.col("series")), duck.series("series"))
scalar("F7_title_identity", lambda: t.title_identity(F.col("title")), duck.title("title"))
scalar("F8_positive_number", lambda: t.positive_number(F.col("num")), duck.positive("num"))
scalar("F9_series_book_key", lambda: t.series_book_key(F.col("series"), F.col("num")), f"CASE WHEN {duck.series('series')} <> '' AND ({duck.positive('num')}) IS NOT NULL THEN {duck.series('series')} || '|' || {duck.number_text('num')} END")
scalar("F10_title_key", lambda: t.title_key(F.col("title")), f"nullif({duck.title('title')}, '')")
scalar("F11_display_title", lambda: t.display_title(F.col("title"), F.when(F.col("id") % 4 == 0, F.col("series"))), f"coalesce(CASE WHEN id % 4 = 0 THEN {duck.filled('series')} END, {duck.text('title')})")
register("F12_edition_priority", lambda v: v.books.select("book_id", t.edition_rank(F.col("edition")).alias("value")), "SELECT book_id, CASE edition WHEN 'hardcover' THEN 5 WHEN 'paperback' THEN 4 WHEN 'ebook' THEN 3 WHEN 'audio' THEN 2 ELSE 1 END AS value FROM books")
scalar("F13_normalized", lambda: t.normalized(F.col("title")), duck.normalized("title"))
scalar("F14_without_article", lambda: t.without_article(t.normalized(F.col("title"))), duck.no_article(duck.normalized("title")))
scalar("F15_core_segment", lambda: t.core_segment(F.col("title")), duck.core("title"))
scalar("F16_core_title_key", lambda: t.core_title_key(F.col("title")), duck.core_key("title"))
scalar("F17_bare_title_key", lambda: t.bare_title_key(F.col("title")), duck.bare_key("title"))
scalar("F18_number_context", lambda: t.number_context(F.col("title")), duck.context("title"))
scalar("F19_parse_positive_number", lambda: t.positive_number(F.col("date_text")), duck.positive("date_text"))
_clean, _series = duck.normalized("title"), duck.normalized("series")
scalar(
    "F20_inferred_number", lambda: t.inferred_number(F.col("title"), F.col("series")),
    f"coalesce({duck.inferred('title')}, CASE WHEN {_series} <> '' AND starts_with({_clean}, {_series}) THEN {duck.positive(duck.get(f'trim(substr({_clean}, length({_series}) + 1))', r'^(\d+)\b'))} END, "
    f"CASE WHEN {_series} <> '' THEN {duck.positive(f'nullif(regexp_extract({_clean}, {chr(39)}(?:^| ){chr(39)} || {_series} || {chr(39)} ([0-9]+)(?: |$){chr(39)}, 1), {chr(39)}{chr(39)})')} END)",
)
scalar("F21_series_position", lambda: t.extract(t.text(F.col("title")), r"(?i)\b(?:book|volume)\s*#?\s*(\d+)\b|#\s*(\d+)").cast("bigint"), f"CAST({duck.get(duck.text('title'), r'\b(?:book|volume)\s*#?\s*(\d+)\b|#\s*(\d+)', 1, 'i')} AS BIGINT)")
scalar("F22_placeholder_title", lambda: t.is_placeholder_title(F.col("title")), f"{duck.normalized('title')} = '' OR " + " OR ".join(f"contains(' ' || {duck.normalized('title')} || ' ', ' {m} ')" for m in t.PLACEHOLDER_TITLES))
scalar("F23_branding_name", lambda: t.branding_name(F.col("series")), duck.branding("series"))
scalar("F24_not_new_release", lambda: t.is_not_new_release(F.col("title")), "(" + " OR ".join([f"contains({duck.normalized('title')}, '{m.replace(chr(39), chr(39) * 2)}')" for m in t.NOT_A_NEW_RELEASE] + [duck.has(duck.normalized("title"), p) for p in t.NOT_A_NEW_RELEASE_PATTERNS]) + ")")
register("F25_english_or_unknown", lambda v: v.hits.groupBy("language").agg(F.count(F.lit(1)).alias("n")).select("language", "n", t.is_english_or_unknown(F.col("language")).alias("value")), "SELECT language, count(*) AS n, trim(lower(language)) IN ('', 'en', 'eng', 'en-us', 'en-gb') AS value FROM candidate_hits GROUP BY language")
register(
    "F26_token_overlap", lambda v: v.cases.select("id", words_of(t.tokens(F.col("title"))).alias("tokens"), F.round(t.overlap_ratio(t.tokens(F.col("title")), t.tokens(F.col("series"))), 6).alias("ratio")),
    f"SELECT id, {duck.joined(duck.tokens('title'))} AS tokens, round({duck.overlap(duck.tokens('title'), duck.tokens('series'))}, 6) AS ratio FROM title_cases",
)
_x, _y = duck.branding("title"), duck.branding("series")
_a, _b = duck.tokens(_x), duck.tokens(_y)
scalar("F27_series_names_compatible", lambda: t.series_names_compatible(F.col("title"), F.col("series")), f"({_x} <> '' AND {_y} <> '' AND ({_x} = {_y} OR ({duck.shared(_a, _b)} >= 2 AND ({duck.shared(_a, _b)} IN (len({_a}), len({_b})) OR {duck.overlap(_a, _b)} >= 0.5))))")
scalar("F28_series_variant", lambda: t.is_series_variant(F.col("title"), F.col("series"), F.col("isbn13"), F.col("num")))
_i = lambda x: f"({_s} = {x} OR {duck.no_article(_s)} <> '' AND {duck.no_article(x)} = {duck.no_article(_s)})"
_s, _n = duck.normalized("series"), duck.normalized("title")
scalar("F29_series_index_entry", lambda: t.is_series_index_entry(F.col("title"), F.col("series"), F.col("isbn13"), F.col("num").isNotNull()), f"{duck.filled('isbn13')} IS NULL AND num IS NULL AND {_n} <> '' AND {_s} <> '' AND ({_i(_n)} OR {duck.branding('title')} <> '' AND {_i(duck.branding('title'))})")
_m1 = duck.get(duck.text("title"), r":\s*a\s+(.+?)\s+(?:universe|series|saga|world)\s+(?:novella|short story|story|book|companion)\b", 1, "i")
_m2 = duck.get(duck.text("title"), r"\s-\s+(.+?)\s*#\s*[\d.]+\s*$")
scalar("F30_series_hint", lambda: t.series_hint(F.col("title")), f"coalesce(nullif({duck.squeeze(_m1)}, ''), nullif({duck.squeeze(_m2)}, ''))")
scalar("F31_clean_display_title", lambda: t.clean_display_title(F.col("title")), f"coalesce(nullif(trim({duck.sub(duck.text('title'), r'\s-\s+(.+?)\s*#\s*[\d.]+\s*$')}), ''), {duck.text('title')})")
scalar("F32_author_names", lambda: F.array_join(t.author_names(F.col("author")), "|"), f"coalesce(array_to_string({duck.names('author')}, '|'), '')")
scalar("F33_primary_author", lambda: t.primary_author(F.col("author")), f"coalesce({duck.names('author')}[1], trim({duck.text('author')}))")
register(
    "F34_author_matches", lambda v: v.hits.join(v.series.select("series_id", F.col("author").alias("target")), "series_id").select("hit_pos", t.author_matches(F.array("author"), F.coalesce("target", F.lit(""))).alias("value")),
    f"""SELECT hit_pos, len(list_filter({duck.names("coalesce(s.author, '')")}, lambda n: len(list_filter(string_split({duck.normalized('n')}, ' '), lambda w: length(w) > 1)) > 0 AND
    len(list_filter(string_split({duck.normalized('n')}, ' '), lambda w: length(w) > 1 AND NOT contains({duck.normalized('h.author')}, w))) = 0)) > 0 AS value FROM candidate_hits h JOIN series s ON h.series_id = s.series_id""",
)
_l = f"lower({duck.text('title')})"
scalar("F35_edition_from_title", lambda: t.edition_from_title(F.col("title")), f"CASE WHEN {duck.has(_l, r'\b(?:audible(?:\s+audio)?|audio\s*cd|audiobook)\b')} THEN 'audio' WHEN {duck.has(_l, r'\bkindle(?:\s+edition)?\b')} THEN 'ebook' WHEN {duck.has(_l, r'\bpaperback\b')} THEN 'paperback' WHEN {duck.has(_l, r'\bhardcover\b')} THEN 'hardcover' ELSE 'unknown' END")
def same_books(v) -> DataFrame:
    """Each case's class (title key and number; its smallest id) and how many other cases are the same book: those of its class and those that lack a number on either side.

    Classes are counted before anything is joined, so pairs of a title are never laid out.
    """
    keyed = v.cases.select("id", t.title_key(F.col("title")).alias("key"), "num")
    classes = keyed.where("key is not null").groupBy("key", "num").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    titles = classes.groupBy("key").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("num").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"))
    own = classes.withColumnsRenamed({"key": "own", "num": "of"})
    rows = keyed.join(own, (F.col("key") == F.col("own")) & F.col("num").eqNullSafe(F.col("of")), "left").join(titles, "key", "left")
    others = F.when(F.col("num").isNull(), F.col("total")).otherwise(F.col("n") + F.col("unnumbered")) - 1
    return rows.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce(others, F.lit(0)).alias("same_books"))


register(
    "F36_same_underlying_book", same_books,
    f"""WITH k AS (SELECT id, nullif({duck.title('title')}, '') AS key, num FROM title_cases), c AS (SELECT *, min(id) OVER (PARTITION BY key, num) AS first, count(*) OVER (PARTITION BY key, num) AS n, count(*) OVER (PARTITION BY key) AS total, sum(CASE WHEN num IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS free FROM k)
    SELECT id, CASE WHEN key IS NULL THEN id ELSE first END AS class_id, CAST(CASE WHEN key IS NULL THEN 0 WHEN num IS NULL THEN total - 1 ELSE n + free - 1 END AS BIGINT) AS same_books FROM c""",
)
_plain = lambda x: f"trim({duck.sub(duck.sub(f'lower({duck.text(x)})', '[^a-z0-9' + chr(92) + 's]+', ' '), chr(92) + 's+', ' ')})"
_ptok = lambda x: f"list_distinct(list_filter(string_split({_plain(x)}, ' '), lambda t: t <> ''))"
register(
    "F37_title_stem", lambda v: v.cases.select("id", t.title_stem(F.col("title")).alias("stem"), t.title_pattern_match(F.col("title"), F.col("series"), F.array(F.lit("Unbound Book 1"), F.lit("Iron Flame"))).alias("matches")), None)
_refs = f"({_plain('title')} <> '' AND {_plain('series')} <> '' AND (contains({_plain('title')}, {_plain('series')}) OR ({duck.overlap(_ptok('title'), _ptok('series'))} >= 0.75 AND {duck.shared(_ptok('title'), _ptok('series'))} >= 2)))"
register(
    "F38_title_references_series", lambda v: v.cases.select("id", t.references_series(F.col("title"), F.col("series")).alias("refers"), t.partial_series_match(F.col("title"), F.col("series")).alias("partly")),
    f"SELECT id, {_refs} AS refers, {duck.overlap(_ptok('title'), _ptok('series'))} >= 0.5 AS partly FROM title_cases",
)
scalar("F39_universe_tie_in", lambda: t.is_universe_tie_in(F.col("title")), duck.has(duck.text("title"), r"\buniverse\s+(?:novel|novella|book|story)\b", "i"))
register("F40_series_alignment", lambda v: v.cases.select("id", t.series_alignment(F.when(~t.blank(F.col("author")), t.author_names(F.col("author"))), F.when(F.col("id") % 3 == 0, F.col("author")).when(F.col("id") % 3 == 1, F.lit("R. Yarros; G Wagner")).otherwise(F.lit("Ann Writer7"))).alias("value")))
register("F41_initials_variant", lambda v: v.cases.select("id", t.initials_variant(t.tokens(F.col("author")), t.tokens(F.substring(F.col("author"), 1, 3))).alias("value")))
scalar("F42_identity_number", lambda: t.identity_number(F.col("date_text")), f"CASE WHEN ({duck.number('date_text')}) IS NULL THEN trim({duck.text('date_text')}) ELSE {duck.number_text('(' + duck.number('date_text') + ')')} END")
scalar("F43_header_key", lambda: t.header_key(F.col("title")), duck.identity("title"))
scalar("F44_title_or_series_text", lambda: t.title_or_series_text(F.col("title")), duck.sub(duck.sub(f"lower(trim({duck.text('title')}))", ":+$"), r"\s+", " "))
scalar("F45_cache_key", lambda: t.cache_key(F.col("title")), f"lower({duck.squeeze(duck.text('title'))})")
scalar("F46_client_text", lambda: F.lower(F.trim(t.text(F.col("title")))), f"lower(trim({duck.text('title')}))")
scalar("F50_number_text", lambda: t.number_text(F.col("num")), duck.number_text("num"))
scalar("F51_number_in_title", lambda: w.number_in_title(F.col("title")), f"CAST({duck.get(duck.text('title'), r'\bbook\s+(\d+(?:\.\d+)?)\b', 1, 'i')} AS DOUBLE)")
scalar("F52_cleaned_title", lambda: w.cleaned(F.col("title")), duck.cleaned("title"))
scalar("F53_short_subtitle", lambda: w.short_subtitle(t.text(F.col("title"))))
scalar("F54_clean_up", lambda: w.clean_up(F.col("title"), F.col("series")))
scalar("F55_name_only", lambda: w.name_only(F.col("title")), duck.name_only("title"))
scalar("F56_new_clean_title", lambda: w.new_clean(F.col("title"), F.col("series"), F.col("num")))
register(
    "F58_mode_names", lambda v: v.profiles.select("profile_id", w.mode_name(F.element_at(F.array(*map(F.lit, ("off", "safe", "Series_Consistent", "clean_up", "no such"))), (F.substring("profile_id", 2, 1).cast("int") + 1))).alias("value"), w.mode_name(F.lit(None).cast("string")).alias("of_none")),
    "SELECT profile_id, CASE profile_id WHEN 'p0' THEN 'keep_original' WHEN 'p1' THEN 'clean_up' WHEN 'p2' THEN 'match_other_titles' WHEN 'p3' THEN 'clean_up' END AS value, 'keep_original' AS of_none FROM profiles",
)
scalar("F59_custom_pattern", lambda: w.custom_pattern("{series_name} {book_number} - {book_title} ({book_subtitle})", F.col("title"), F.col("series"), F.col("num"), F.lit("")))
scalar("F62_storage_title", lambda: w.storage_title(F.col("title"), F.col("series"), F.col("num")))
register(
    "F63_metadata_defaults", lambda v: v.cases.select("id", F.coalesce(F.nullif(w.storage_title(F.col("title"), F.col("series"), F.col("num")), F.lit("")), F.concat(F.lit("Book "), F.col("num").cast("string")), F.lit("Untitled")).alias("title"), F.coalesce(t.filled(F.col("series")), F.lit("")).alias("series_name")))
scalar("F64_publication_date", lambda: d.strict_date(F.col("date_text")), duck.strict_date("date_text"))
scalar("F65_flexible_date", lambda: d.flexible_date(F.col("date_text")), duck.flexible_date("date_text"))
_t = f"trim({duck.text('date_text')})"
_us, _eu = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
_mk = lambda p, y, m, e: f"CASE WHEN {duck.has(_t, p)} THEN TRY_CAST({duck.get(_t, p, y)} || '-' || lpad({duck.get(_t, p, m)}, 2, '0') || '-' || lpad({duck.get(_t, p, e)}, 2, '0') AS DATE) END"
scalar("F66_spreadsheet_date", lambda: d.spreadsheet_date(F.col("date_text")), f"coalesce(CASE WHEN {duck.has(_t, r'^\d{4}-\d{2}-\d{2}$')} THEN TRY_CAST({_t} AS DATE) END, {_mk(_us, 3, 1, 2)}, {_mk(_eu, 3, 2, 1)}, CASE WHEN {duck.has(_t, r'^\d{1,6}$')} THEN DATE '1899-12-30' + CAST({_t} AS INTEGER) END)")
scalar("F67_client_date", lambda: d.client_date(F.col("date_text")))
scalar("F68_placeholder_date", lambda: d.is_placeholder_date(F.col("date_text")), duck.has(_t, r"^\d{4}-01-01$"))
register(
    "F69_upcoming_hits", lambda v: v.hits.select("hit_pos", d.is_upcoming(d.flexible_date(F.col("published_date")), F.col("upcoming_hint"), AS_OF).alias("value")),
    f"SELECT hit_pos, coalesce({duck.flexible_date('published_date')} > DATE '{AS_OF}', upcoming_hint, false) AS value FROM candidate_hits",
)
register(
    "F75_discovery_health", lambda v: v.series.select("series_id", d.discovery_health(F.col("last_checked"), AS_OF).alias("value")),
    f"SELECT series_id, CASE WHEN last_checked IS NULL THEN 'never' WHEN DATE '{AS_OF}' - last_checked <= 183 THEN 'healthy' WHEN DATE '{AS_OF}' - last_checked <= 365 THEN 'stale' ELSE 'very_stale' END AS value FROM series",
)


def _now() -> Column:
    return F.lit(f"{AS_OF} 12:00:00").cast("timestamp")


register(
    "F76_cooldown", lambda v: v.series.select("series_id", d.cooldown_left(F.col("last_checked").cast("timestamp"), _now()).alias("seconds"), d.cooldown_hours(d.cooldown_left(F.col("last_checked").cast("timestamp"), _now())).alias("hours")),
    f"""SELECT series_id, CAST(coalesce(greatest(0, epoch(CAST(last_checked AS TIMESTAMP)) + 604800 - epoch(TIMESTAMP '{AS_OF} 12:00:00')), 0) AS BIGINT) AS seconds,
    CAST(greatest(1, round_even(coalesce(greatest(0, epoch(CAST(last_checked AS TIMESTAMP)) + 604800 - epoch(TIMESTAMP '{AS_OF} 12:00:00')), 0) / 3600.0, 0)) AS INTEGER) AS hours FROM series""",
)
register("F77_roman_numbers", lambda v: v.books.select("book_id", d.roman(F.element_at(F.array(*map(F.lit, ("IV", "xii", "MCMXCIV", "IIX", "A", "", "XL"))), (F.col("book_id") % 7 + 1).cast("int"))).alias("value")),
         "SELECT book_id, CASE book_id % 7 WHEN 0 THEN 4 WHEN 1 THEN 12 WHEN 2 THEN 1994 WHEN 3 THEN 8 WHEN 6 THEN 40 END AS value FROM books")
register("F78_token_numbers", lambda v: v.books.select("book_id", d.token_number(F.element_at(F.array(*map(F.lit, ("7", "Twelve", "ix", "0", "x2"))), (F.col("book_id") % 5 + 1).cast("int"))).alias("value")),
         "SELECT book_id, CASE book_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 12 WHEN 2 THEN 9 END AS value FROM books")
register(
    "F79_omnibus_numbers", lambda v: v.books.select("book_id", F.array_join(F.array_sort(d.omnibus_numbers(F.col("title"))), ",").alias("value")),
    f"SELECT book_id, CASE WHEN {duck.has('title', r'\bbooks? (\d+)-(\d+)', 'i')} THEN array_to_string(range(CAST({duck.get('title', r'books? (\d+)-(\d+)', 1, 'i')} AS INTEGER), CAST({duck.get('title', r'books? (\d+)-(\d+)', 2, 'i')} AS INTEGER) + 1), ',') ELSE '' END AS value FROM books",
)
register("F80_truncated_number", lambda v: v.books.select("book_id", d.truncated_number(F.col("book_number")).alias("value")), "SELECT book_id, CASE WHEN book_number > 0 THEN CAST(floor(book_number) AS BIGINT) END AS value FROM books")
_flag = lambda x: f"CASE WHEN lower(trim({x})) IN ('1', 'true', 't', 'yes', 'y', 'confirmed') THEN true WHEN lower(trim({x})) IN ('0', 'false', 'f', 'no', 'n', 'unconfirmed') THEN false END"
register(
    "F81_coercions", lambda v: v.cases.select("id", t.number(F.col("date_text")).alias("as_float"), d.whole_number(F.col("date_text")).alias("as_int"), d.parsed_flag(F.coalesce(F.col("date_text"), F.lit("Yes "))).alias("as_flag"), d.series_finished(F.substring(t.text(F.col("title")), 1, 1)).alias("finished")),
    f"SELECT id, {duck.number('date_text')} AS as_float, CAST(trunc({duck.number('date_text')}) AS BIGINT) AS as_int, {_flag(chr(99) + 'oalesce(date_text, ' + chr(39) + 'Yes ' + chr(39) + ')')} AS as_flag, lower(trim(substr({duck.text('title')}, 1, 1))) NOT IN ('no', 'false', 'n') AS finished FROM title_cases",
)
register("F82_truncated_or_integral", lambda v: v.books.select("book_id", d.whole_number(F.col("book_number")).alias("truncated"), d.integral_number(F.col("book_number")).alias("integral")),
         "SELECT book_id, CAST(floor(book_number) AS BIGINT) AS truncated, CASE WHEN book_number = floor(book_number) THEN CAST(book_number AS BIGINT) END AS integral FROM books")
register("F83_reading_status", lambda v: v.books.select("book_id", d.reading_status(F.col("read_status")).alias("value")), "SELECT book_id, CASE WHEN read_status IN ('read', 'completed', 'finished') THEN 'read' WHEN read_status IN ('upcoming', 'tbr', 'to be read') THEN 'upcoming' ELSE 'other' END AS value FROM books")
register(
    "F84_provenance", lambda v: v.books.select("book_id", d.provenance(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("none")), (F.col("book_id") % 4 + 1).cast("int"))).alias("p"), F.coalesce(F.col("metadata_source").isin("provider", "discovery"), F.lit(False)).alias("verified")).select("book_id", "p.*", "verified"),
    "SELECT book_id, CASE WHEN book_id % 4 = 3 THEN 'user' ELSE 'provider' END AS metadata_source, CASE WHEN book_id % 4 < 3 THEN book_id % 4 = 0 END AS needs_reresolution, coalesce(metadata_source IN ('provider', 'discovery'), false) AS verified FROM books",
)
register("F85_number_provenance", lambda v: v.cases.select("id", F.coalesce(F.col("num"), t.inferred_number(F.col("title"))).alias("number"), F.when(F.col("num").isNotNull(), "user").when(t.inferred_number(F.col("title")).isNotNull(), "title_inferred").alias("source")),
         f"SELECT id, coalesce(num, {duck.inferred('title')}) AS number, CASE WHEN num IS NOT NULL THEN 'user' WHEN ({duck.inferred('title')}) IS NOT NULL THEN 'title_inferred' END AS source FROM title_cases")
scalar("F87_suffixed_title", lambda: F.when(t.references_series(F.col("title"), F.col("series")) | t.blank(F.col("series")) | F.col("num").isNull(), t.text(F.col("title"))).otherwise(F.concat(t.text(F.col("title")), F.lit(": ("), F.col("series"), F.lit(" Book "), t.number_text(F.col("num")), F.lit(")"))),
       f"CASE WHEN {_refs} OR {duck.filled('series')} IS NULL OR num IS NULL THEN {duck.text('title')} ELSE {duck.text('title')} || ': (' || series || ' Book ' || {duck.number_text('num')} || ')' END")
register("F88_identifier", lambda v: v.hits.select("hit_pos", F.coalesce(t.filled(F.col("isbn13")), F.concat_ws(":", "source", F.col("hit_pos").cast("string"))).alias("value")), "SELECT hit_pos, coalesce(isbn13, source || ':' || CAST(hit_pos AS VARCHAR)) AS value FROM candidate_hits")
scalar("F89_query_variants", lambda: F.array_join(t.query_variants(F.col("title")), "|"), f"CASE WHEN trim({duck.text('title')}) = '' THEN '' WHEN trim({duck.core('title')}) IN (trim(title), '') THEN trim(title) ELSE trim(title) || '|' || trim({duck.core('title')}) END")
register("F90_group_key", lambda v: v.hits.select("hit_pos", t.group_key(F.col("isbn13"), F.col("title")).alias("value")), f"SELECT hit_pos, coalesce('isbn:' || isbn13, 'title:' || {duck.core_key('title')}) AS value FROM candidate_hits")
_v2, _v3 = duck.sub(duck.text("title"), r"\s*\([^)]*book\s*\d+[^)]*\)\s*$", "", "gi"), duck.sub(duck.text("title"), r"\s*:\s*[^:]*book\s*\d+.*$", "", "gi")
scalar("F91_summary_variants", lambda: F.array_join(F.filter(F.array_distinct(F.array(F.trim(t.text(F.col("title"))), F.trim(F.regexp_replace(t.text(F.col("title")), r"(?i)\s*\([^)]*book\s*\d+[^)]*\)\s*$", "")), F.trim(F.regexp_replace(t.text(F.col("title")), r"(?i)\s*:\s*[^:]*book\s*\d+.*$", "")))), lambda q: q != ""), "|").cast("string"),
       f"array_to_string(list_filter([trim({duck.text('title')}), CASE WHEN trim({_v2}) <> trim({duck.text('title')}) THEN trim({_v2}) ELSE '' END, CASE WHEN trim({_v3}) NOT IN (trim({duck.text('title')}), trim({_v2})) THEN trim({_v3}) ELSE '' END], lambda q: q <> ''), '|')")
scalar("F96_subtitle", lambda: w.subtitle_of(F.col("title")))


# the rules called from SQL text
_CALLED = {
    "title_key": duck.title("title"), "author_identity": duck.author("author"), "series_identity": duck.series("series"), "normalized_text": duck.normalized("title"), "bare_title_key": duck.bare_key("title"), "branding_name": duck.branding("series"),
    "discovered_title_key": duck.discovered_title("title"), "identity_text": duck.identity("title"),
}
_ARGUMENT = {"author_identity": "author", "series_identity": "series", "branding_name": "series"}


def called_from_sql(v):
    sql.register(v.spark)
    return v.spark.sql("SELECT id, " + ", ".join(f"{n}({_ARGUMENT.get(n, 'title')}) AS {n}" for n in _CALLED) + ", same_author(author, author) AS named, flexible_date(date_text) AS day FROM {cases} WHERE NOT is_placeholder_title(title)", cases=v.cases)


register(
    "F_rules_from_sql", called_from_sql,
    "SELECT id, " + ", ".join(f"nullif({x}, '') AS {n}" if n == "title_key" else f"{x} AS {n}" for n, x in _CALLED.items()) + f", {duck.author('author')} <> '' AS named, {duck.flexible_date('date_text')} AS day FROM title_cases WHERE NOT ({duck.normalized('title')} = '' OR "
    + " OR ".join(f"contains(' ' || {duck.normalized('title')} || ' ', ' {m} ')" for m in t.PLACEHOLDER_TITLES) + ")",
)
