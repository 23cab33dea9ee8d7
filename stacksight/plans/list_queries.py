"""Projections, filters, orders, pages, windows and arrays (inventory P, O, W, L, and the status rules among F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.operators import entity, integrity, intelligence, lists
from stacksight.operators.intelligence import active, read, upcoming
from stacksight.plans import duck
from stacksight.plans.catalog_queries import AGGREGATES, KNOWN, LIVE, QUEUE, READ, STATE, queue
from stacksight.plans.registry import register
from stacksight.sources.library import AS_OF

TODAY, KNOWN_DATE = f"DATE '{AS_OF}'", "coalesce(release_date, publication_date)"
_HEAD = f"WHEN {READ} THEN 'read' WHEN read_status = 'upcoming' AND {KNOWN_DATE} <= {TODAY} THEN 'available' WHEN read_status = 'upcoming' THEN 'upcoming' WHEN read_status = 'available' THEN 'available' WHEN {KNOWN_DATE} > {TODAY} THEN 'upcoming' WHEN {KNOWN_DATE} IS NOT NULL THEN 'available'"
_FLAGS = "WHEN is_upcoming_final OR is_upcoming_auto THEN 'upcoming' WHEN is_missing THEN 'available' WHEN series_id IS NOT NULL AND book_number IS NOT NULL THEN 'available'"
LIBRARY = f"CASE {_HEAD} {_FLAGS} ELSE 'unread' END"
BARE = f"CASE {_HEAD} ELSE 'unread' END"
#: The books as they come lack an unread status; in every third it is dropped, so that dates and flags decide.
UNSET = "SELECT * REPLACE (CASE WHEN book_id % 3 = 0 THEN NULL ELSE read_status END AS read_status) FROM books"


def unset(v):
    return v.books.withColumn("read_status", F.when(F.col("book_id") % 3 != 0, F.col("read_status")))


_N = LIBRARY.replace(READ, "(is_read OR coalesce(read_status, '') = 'read')")
_B = BARE.replace(READ, "(is_read OR coalesce(read_status, '') = 'read')")
register("F73_library_status", lambda v: lists.with_status(unset(v), AS_OF).select("book_id", "status"), f"SELECT book_id, {_N} AS status FROM ({UNSET})")
register("F73b_standalone_status", lambda v: lists.with_status(unset(v), AS_OF, flags=False).select("book_id", "status"), f"SELECT book_id, {_B} AS status FROM ({UNSET})")
register("F73c_detail_status", lambda v: lists.with_status(v.books.withColumn("read_status", F.when(F.col("book_id") % 3 == 0, "TBR").otherwise(F.col("read_status"))), AS_OF, flags=False, signals=True).select("book_id", "status"),
         f"SELECT book_id, {BARE.replace('ELSE', 'WHEN read_status = ' + chr(39) + 'TBR' + chr(39) + ' THEN ' + chr(39) + 'upcoming' + chr(39) + ' ELSE')} AS status FROM (SELECT * REPLACE (CASE WHEN book_id % 3 = 0 THEN 'TBR' ELSE read_status END AS read_status) FROM books)")
register("F72_upcoming_in_future", lambda v: v.books.where(upcoming() & (F.col("publication_date") > F.lit(AS_OF).cast("date"))).select("book_id"), f"SELECT book_id FROM books WHERE read_status = 'upcoming' AND publication_date > {TODAY}")
register("F95_without_upcoming", lambda v: v.books.where(~F.coalesce(upcoming() & (F.col("publication_date") > F.lit(AS_OF).cast("date")), F.lit(False))).select("book_id"), f"SELECT book_id FROM books WHERE NOT coalesce(read_status = 'upcoming' AND publication_date > {TODAY}, false)")
register("F71_discovered_status", lambda v: v.hits.withColumn("day", d.flexible_date(F.col("published_date"))).select("hit_pos", F.when(d.is_upcoming(F.col("day"), F.col("upcoming_hint"), AS_OF) | t.is_placeholder_title(F.col("title")), "upcoming").otherwise("available").alias("status"), F.when(F.col("day") > F.lit(AS_OF).cast("date"), F.col("day")).alias("expected")),
         f"SELECT hit_pos, CASE WHEN coalesce(day > {TODAY}, upcoming_hint, false) OR title LIKE '%untitled%' THEN 'upcoming' ELSE 'available' END AS status, CASE WHEN day > {TODAY} THEN day END AS expected FROM (SELECT *, {duck.flexible_date('published_date')} AS day FROM candidate_hits)")
register("F74_display_date", lambda v: lists.with_status(v.books, AS_OF).select("book_id", F.when(F.col("status") == "upcoming", F.coalesce("release_date", "publication_date")).otherwise(F.coalesce("publication_date", "release_date")).alias("shown")),
         f"SELECT book_id, CASE WHEN {LIBRARY} = 'upcoming' THEN {KNOWN_DATE} ELSE coalesce(publication_date, release_date) END AS shown FROM books")
register("F94_upcoming_signals", lambda v: v.books.select("book_id", (d.status(F.col("read_status")).isin(*d.UPCOMING_WORDS) | (~d.flag(F.col("is_read")) & F.coalesce(F.coalesce("release_date", "publication_date") > F.lit(AS_OF).cast("date"), F.lit(False)))).alias("value")),
         f"SELECT book_id, read_status = 'upcoming' OR (NOT is_read AND coalesce({KNOWN_DATE} > {TODAY}, false)) AS value FROM books")
register("F93_cooldown_text", lambda v: v.books.select("book_id", F.concat(F.lit("Try again in "), d.cooldown_hours(F.col("book_id") * 600 % 604800).cast("string"), F.lit(" h")).alias("value")), "SELECT book_id, 'Try again in ' || CAST(CAST(greatest(1, round_even(book_id * 600 % 604800 / 3600.0, 0)) AS INTEGER) AS VARCHAR) || ' h' AS value FROM books")

# projections and filters
register("P1_active", lambda v: v.books.where(active()).select("book_id"), f"SELECT book_id FROM books WHERE {LIVE}")
_SLIM = "SELECT b.book_id, b.title, b.author, b.series_id, s.name AS series_name, b.book_number, b.read_status, b.is_read, b.is_upcoming_final FROM books b LEFT JOIN series s ON s.series_id = b.series_id"
register("P2_slim_books", lambda v: lists.slim_books(v.books, v.series), _SLIM)
_SLIM = ("name", "author", "last_checked")


def slim_series(v):
    """What a list of series shows: names, counts, state and how long ago it was checked."""
    rows = intelligence.recalculated(v.books, v.series).drop("gaps", "missing").join(v.series.select("series_id", *_SLIM), "series_id")
    return rows.select("series_id", *_SLIM, "total_books", "read_count", "unread_count", "is_finished", "has_new_books", "has_unread_books", "has_upcoming_books", "is_caught_up", d.discovery_health(F.col("last_checked"), AS_OF).alias("discovery_health"))


_AGE = f"greatest(0, date_diff('day', s.last_checked, {TODAY}))"
register(
    "P3_slim_series", slim_series,
    f"""WITH {KNOWN}, {AGGREGATES} SELECT k.series_id, s.name, s.author, s.last_checked, coalesce(c.total_books, 0) AS total_books, k.read_count, k.unread_count, k.is_finished, k.has_new_books, {STATE.rsplit(', ', 1)[0]},
CASE WHEN s.last_checked IS NULL THEN 'never' WHEN {_AGE} <= 183 THEN 'healthy' WHEN {_AGE} <= 365 THEN 'stale' ELSE 'very_stale' END AS discovery_health FROM known k JOIN series s USING (series_id) LEFT JOIN counted c USING (series_id)""",
)
register("P4_series_detail", lambda v: v.series.join(v.books.where(active()).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("book_number", F.lit(0.0)).alias("k"), "book_id", "author"))).alias("e")), "series_id", "left").select("series_id", F.coalesce(t.filled(F.col("author")), F.get("e", F.lit(0))["author"]).alias("author"), F.coalesce(F.array_join(F.transform("e", lambda x: x["book_id"].cast("string")), ","), F.lit("")).alias("books")),
         f"SELECT s.series_id, coalesce({duck.filled('any_value(s.author)')}, arg_min(b.author, coalesce(b.book_number, 0) * 1000000000 + b.book_id)) AS author, coalesce(string_agg(CAST(b.book_id AS VARCHAR), ',' ORDER BY coalesce(b.book_number, 0), b.book_id), '') AS books FROM series s LEFT JOIN (SELECT * FROM books WHERE {LIVE}) b ON b.series_id = s.series_id GROUP BY s.series_id")
register("P5_series_with_books", lambda v: v.series.select("series_id").join(v.books.where(active()).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("title")), "|").alias("titles")), "series_id", "left").select("series_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("titles", F.lit("")).alias("titles")),
         f"SELECT s.series_id, count(b.book_id) AS n, coalesce(string_agg(DISTINCT b.title, '|' ORDER BY b.title), '') AS titles FROM series s LEFT JOIN (SELECT * FROM books WHERE {LIVE}) b ON b.series_id = s.series_id GROUP BY s.series_id")
register("P6_reresolution_queue", lambda v: queue(v).select("book_id"), f"SELECT book_id FROM books WHERE {QUEUE}")
register("P7_open_notices", lambda v: v.notifications.where("kind = 'series_discovery_delta' and dismissed_at is null").select("notification_id", "series_id"), "SELECT notification_id, series_id FROM notifications WHERE kind = 'series_discovery_delta' AND dismissed_at IS NULL")
_MEANT = f"{duck.author('s.author')} NOT IN ('', 'unknown', 'n a', 'none', 'various') AND trim(coalesce(s.author, '')) <> ''"
ELIGIBLE = f"""eligible AS (SELECT s.series_id, s.profile_id, s.name, s.author FROM known k JOIN series s USING (series_id)
WHERE NOT s.is_finished AND k.next_unread IS NULL AND k.next_upcoming IS NULL AND k.missing = '' AND {_MEANT}
AND NOT EXISTS (SELECT 1 FROM books b WHERE b.series_id = s.series_id AND b.needs_reresolution AND (b.record_status IS NULL OR b.record_status <> 'deleted')))"""


def eligible(v):
    known = intelligence.series_intelligence(v.books, v.series)
    return lists.eligible_for_discovery(known, intelligence.series_state(known, v.series), v.series, v.books)


register("P8_discovery_eligible", lambda v: eligible(v).select("series_id", "name", "author"), f"WITH {KNOWN}, {ELIGIBLE} SELECT series_id, name, author FROM eligible")
register("P9_deleted_report", lambda v: integrity.deleted_books(v.books, v.series), "SELECT b.book_id, b.title, b.author, b.series_id, s.name AS series_name, b.book_number FROM books b LEFT JOIN series s ON s.series_id = b.series_id WHERE b.record_status = 'deleted'")


def meta():
    return F.to_json(F.struct((F.col("book_id") % 3 == 0).alias("needs_confirmation"), (F.col("book_id") % 6 == 0).alias("resolved")))


def waiting(v):
    """Books whose import metadata asks for a confirmation that is not given yet."""
    return v.books.withColumn("meta", meta()).where((F.get_json_object("meta", "$.needs_confirmation") == "true") & (F.get_json_object("meta", "$.resolved") != "true"))


register("P10_confirmation_queue", lambda v: waiting(v).select("book_id"), "SELECT book_id FROM books WHERE book_id % 3 = 0 AND book_id % 6 <> 0")
register("L3_json_flags", lambda v: v.books.withColumn("meta", meta()).select("book_id", F.get_json_object("meta", "$.resolved").cast("boolean").alias("resolved")), "SELECT book_id, book_id % 6 = 0 AS resolved FROM books")
register("L4_json_merge", lambda v: v.books.select("book_id", F.map_concat(F.create_map(F.lit("source"), F.coalesce("metadata_source", F.lit("none"))), F.create_map(F.lit("seen"), F.lit("yes"))).alias("m")).select("book_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged")), "SELECT book_id, 'seen=yes,source=' || coalesce(metadata_source, 'none') AS merged FROM books")
register("L1_missing_lists", lambda v: v.books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("edition"))), ",").alias("tags")), f"SELECT series_id, coalesce(string_agg(DISTINCT edition, ',' ORDER BY edition), '') AS tags FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
register("L2_raw_row", lambda v: v.books.select("book_id", F.to_json(F.create_map(F.lit("Shelf"), F.coalesce("edition", F.lit("")), F.lit("When"), F.coalesce(F.col("publication_date").cast("string"), F.lit("")))).alias("raw")), "SELECT book_id, '{\"Shelf\":\"' || coalesce(edition, '') || '\",\"When\":\"' || coalesce(CAST(publication_date AS VARCHAR), '') || '\"}' AS raw FROM books")
register("L5_provenance_sources", lambda v: v.hits.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("hit_pos", "source"))).alias("p")).select("series_id", F.array_join(F.array_distinct(F.transform("p", lambda x: x["source"])), ",").alias("sources")),
         "SELECT series_id, string_agg(source, ',' ORDER BY first) AS sources FROM (SELECT series_id, source, min(hit_pos) AS first FROM candidate_hits GROUP BY series_id, source) GROUP BY series_id")
register("L6_skeleton_entries", lambda v: integrity.skeletons(v.books).select("series_id", F.explode("entries").alias("e")).select("series_id", "e.book_number", "e.title", "e.status", "e.release_date"), f"SELECT series_id, book_number, title, read_status AS status, {KNOWN_DATE} AS release_date FROM books WHERE {LIVE} AND series_id IS NOT NULL AND book_number IS NOT NULL")
register("L7_first_isbn13", lambda v: v.hits.select("hit_pos", F.get(F.filter(F.array(F.lit("123"), F.coalesce("isbn13", F.lit(""))), lambda x: F.length(x) == 13), F.lit(0)).alias("isbn13"), F.get(F.filter(F.array("language"), lambda x: x != ""), F.lit(0)).alias("language")), "SELECT hit_pos, isbn13, nullif(language, '') AS language FROM candidate_hits")
for key in ("L8_provider_sets", "L9_author_lists"):
    col = "source" if key[1] == "8" else "author"
    register(key, lambda v, col=col: v.hits.groupBy("series_id", t.title_key(F.col("title")).alias("title_key")).agg(F.array_join(F.array_sort(F.collect_set(col)), ",").alias("value")), f"SELECT series_id, nullif({duck.title('title')}, '') AS title_key, string_agg(DISTINCT {col}, ',' ORDER BY {col}) AS value FROM candidate_hits GROUP BY ALL")
register("P18_series_marker", lambda v: v.cases.select("id", t.has_series_number(F.col("title")).alias("value")), f"SELECT id, {duck.has(duck.text('title'), r'\bbook\s*#?\s*\d+(?:\.\d+)?\b|#\s*\d+(?:\.\d+)?\b|\bvol(?:ume)?\.?\s*\d+(?:\.\d+)?\b|\bepisode\s*\d+(?:\.\d+)?\b|\bpart\s*\d+(?:\.\d+)?\b', 'i')} AS value FROM title_cases")
register("P19_value_filter", lambda v: v.books.where(F.col("read_status").isin("read", "available") & F.col("author").isin("Ann Writer3", "Ann Writer5", "Ann Writer8")).select("book_id"), "SELECT book_id FROM books WHERE read_status IN ('read', 'available') AND author IN ('Ann Writer3', 'Ann Writer5', 'Ann Writer8')")
register("P20_series_search", lambda v: lists.search(v.series, " wRITER1").where(~d.flag(F.col("is_finished"))).select("series_id"), f"SELECT series_id FROM series WHERE contains(lower(name || ' ' || {duck.text('author')}), 'writer1') AND NOT is_finished")
register("P21_standalone", lambda v: lists.standalone(v.books).select("book_id"), f"SELECT book_id FROM books WHERE {LIVE} AND series_id IS NULL")
register("P22_needs_verification", lambda v: lists.unverified(v.books).select("book_id"), f"SELECT book_id FROM books WHERE {LIVE} AND read_status IN ('upcoming', 'available') AND publication_date IS NULL AND release_date IS NULL")
register("P24_foreign_series", lambda v: v.books.where("series_id is not null").join(v.series, ["series_id", "profile_id"], "left_anti").select("book_id"), "SELECT book_id FROM books b WHERE series_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM series s WHERE s.series_id = b.series_id AND s.profile_id = b.profile_id)")
register("P25_flags_to_clear", lambda v: v.books.where(read() & (d.flag(F.col("is_missing")) | d.flag(F.col("is_upcoming_auto")) | (F.col("book_number") > 6))).select("book_id"), f"SELECT book_id FROM books WHERE {READ} AND (is_missing OR is_upcoming_auto OR book_number > 6)")
register("P26_filtered_hits", lambda v: v.hits.where(~t.is_placeholder_title(F.col("title")) & ~t.is_not_new_release(F.col("title")) & t.is_english_or_unknown(F.col("language"))).select("hit_pos"), f"SELECT hit_pos FROM candidate_hits WHERE NOT {duck.has(duck.normalized('title'), r'untitled|box set|[0-9]+ books?( |$)')} AND language IN ('', 'en')")
register("P27_added_entries", lambda v: v.hits.withColumn("day", d.flexible_date(F.col("published_date"))).withColumn("up", d.is_upcoming(F.col("day"), F.col("upcoming_hint"), AS_OF)).select("hit_pos", F.when(~F.col("up"), F.col("day")).alias("publication_date"), F.when(F.col("up"), F.col("day")).alias("expected_date"), (~F.col("up")).alias("is_missing")),
         f"SELECT hit_pos, CASE WHEN NOT up THEN day END AS publication_date, CASE WHEN up THEN day END AS expected_date, NOT up AS is_missing FROM (SELECT *, coalesce(day > {TODAY}, upcoming_hint, false) AS up FROM (SELECT *, {duck.flexible_date('published_date')} AS day FROM candidate_hits))")
register("P29_series_recap", lambda v: lists.recap(v.books, 9.0), f"""SELECT series_id, titles[len(titles)] AS last, array_to_string(titles[1:len(titles) - 1], ' | ') AS earlier FROM (SELECT series_id, list(title ORDER BY book_number, book_id) AS titles FROM books WHERE {LIVE} AND {READ} AND book_number < 9 AND series_id IS NOT NULL GROUP BY series_id)""")
register("P30_name_search", lambda v: v.series.where(F.lower("name").contains("00001")).select("series_id", "name"), "SELECT series_id, name FROM series WHERE contains(lower(name), '00001')")
_CMP = ("book_id", "title", "book_number", "is_read", "read_status", "read_date", "rating", "review", "notes", "publication_date", "release_date", "source_url", "isbn", "isbn13", "asin", "record_status")
register("P31_compared_books", lambda v: lists.compared(v.books, 10, 11, _CMP), " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(a.{f} AS VARCHAR) AS first, CAST(b.{f} AS VARCHAR) AS second, a.{f} IS DISTINCT FROM b.{f} AS different FROM (SELECT * FROM books WHERE book_id = 10) a, (SELECT * FROM books WHERE book_id = 11) b" for f in _CMP))
register("P32_current_profile", lambda v: v.profiles.orderBy((F.col("profile_id") == "p9").desc(), F.col("is_default").desc(), "profile_id").limit(1).select("profile_id"), "SELECT profile_id FROM profiles ORDER BY profile_id = 'p9' DESC, is_default DESC, profile_id LIMIT 1")
register("P33_titled_hits", lambda v: v.hits.where(F.trim("title") != "").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT source, count(*) AS n FROM candidate_hits WHERE trim(title) <> '' GROUP BY source")
register("P34_provider_ledger", lambda v: v.hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("isbn13").alias("i"), F.count("series_total_hint").alias("h")).select(F.concat_ws(" | ", "source", F.concat(F.lit("hits="), F.col("n").cast("string")), F.concat(F.lit("isbn="), F.col("i").cast("string")), F.when(F.col("h") > 0, F.concat(F.lit("totals="), F.col("h").cast("string")))).alias("line")),
         "SELECT concat_ws(' | ', source, 'hits=' || n, 'isbn=' || i, CASE WHEN h > 0 THEN 'totals=' || h END) AS line FROM (SELECT source, count(*) AS n, count(isbn13) AS i, count(series_total_hint) AS h FROM candidate_hits GROUP BY source)")
register("S6_name_lookup", lambda v: lists.by_name(v.series, "p1", " cUSTOMER#000000005 ").unionByName(lists.by_name(v.series, "p1", "Customer#000000010")).select("series_id", "name"),
         "SELECT series_id, name FROM series WHERE profile_id = 'p1' AND lower(name) IN ('customer#000000005', 'customer#000000010')")

# orders and pages: rows carry their place
register("O1_page", lambda v: lists.page(v.books.where("profile_id = 'p1'").select("book_id", "title"), "book_id", 50, 20), "SELECT book_id, title FROM books WHERE profile_id = 'p1' ORDER BY book_id LIMIT 50 OFFSET 20")


def ordered(key, rows, order, sql_rows, sql_order, by=("series_id",), n=None):
    """Every row with its place in the order of its series or profile; n where only the first n are asked for. `rows` gives book_id and what the order needs."""
    split, limit = ", ".join(by), f" QUALIFY place <= {n}" if n else ""
    over = f"PARTITION BY {split} ORDER BY {sql_order}" if by else f"ORDER BY {sql_order}"
    register(key, lambda v: lists.numbered(rows(v), order(), n, by).select("book_id", F.col("place").cast("bigint").alias("place")), f"SELECT book_id, row_number() OVER ({over}) AS place FROM ({sql_rows}){limit}")


def in_series(v):
    return v.books.where(active() & F.col("series_id").isNotNull())


PROFILE = ("profile_id",)


def ordered_by_profile(key, rows, order, columns, sql_rows, sql_order, id_col="book_id"):
    """Every row with its place in the whole order of its profile; `columns` are what the order needs."""
    register(key, lambda v: lists.placed(rows(v).select(id_col, *PROFILE, *columns), order(), PROFILE).select(id_col, "place"), f"SELECT {id_col}, row_number() OVER (PARTITION BY profile_id ORDER BY {sql_order}) AS place FROM ({sql_rows})")


_IN = f"SELECT * FROM books WHERE {LIVE} AND series_id IS NOT NULL"
ordered("O2_by_number", in_series, lambda: [F.col("book_number").asc_nulls_first(), F.col("book_id")], _IN, "book_number NULLS FIRST, book_id")
ordered("O3_by_number_or_zero", in_series, lambda: [F.coalesce("book_number", F.lit(0.0)), F.col("book_id")], _IN, "coalesce(book_number, 0), book_id")
ordered_by_profile("O4_newest_notices", lambda v: v.notifications, lambda: [F.desc("created_at"), F.desc("notification_id")], ("created_at",), "SELECT * FROM notifications", "created_at DESC, notification_id DESC", "notification_id")
register("O5_profiles_in_order", lambda v: lists.numbered(v.profiles, [F.col("created_at"), F.col("profile_id")]).select("profile_id", F.col("place").cast("bigint").alias("place")), "SELECT profile_id, row_number() OVER (ORDER BY created_at, profile_id) AS place FROM profiles")
ordered("O6_reresolution_batch", queue, lambda: [F.col("book_id")], f"SELECT * FROM books WHERE {QUEUE}", "book_id", (), 25)
_RANK = "CASE source WHEN 'hardcover' THEN 0 WHEN 'google_books' THEN 1 WHEN 'openlibrary' THEN 2 ELSE 3 END"
ordered("O7_candidate_order", lambda v: v.hits.withColumnRenamed("hit_pos", "book_id"), lambda: [F.col("series_number_hint").asc_nulls_last(), t.normalized(F.col("title")), entity.provider_rank(F.col("source")), F.col("book_id")], "SELECT *, hit_pos AS book_id FROM candidate_hits", f"series_number_hint NULLS LAST, {duck.normalized('title')}, {_RANK}, book_id")
ordered("O9_discovery_rows", lambda v: v.hits.withColumnRenamed("hit_pos", "book_id"), lambda: [F.col("series_name_hint").asc_nulls_last(), F.col("title"), F.col("book_id")], "SELECT *, hit_pos AS book_id FROM candidate_hits", "series_name_hint NULLS LAST, title, book_id")
_PRI = "CASE status WHEN 'available' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'read' THEN 2 ELSE 3 END"
_LIB = f"SELECT *, {LIBRARY} AS status FROM books WHERE {LIVE}"
_LIBO = f"{_PRI}, CASE WHEN status = 'upcoming' THEN {KNOWN_DATE} END DESC NULLS LAST, book_id DESC, title"


def library(v):
    return lists.with_status(v.books.where(active()), AS_OF)


LIBRARY_COLUMNS = ("status", "release_date", "publication_date", "title", "author")
ordered_by_profile("O10_library_order", library, lambda: lists.library_order(None), LIBRARY_COLUMNS, _LIB, _LIBO)
ordered_by_profile("O11_user_order", library, lambda: [lists.status_priority(F.col("status")), F.lower("author").desc(), *lists.library_order(None)[1:]], LIBRARY_COLUMNS, _LIB, f"{_PRI}, lower(author) DESC, {_LIBO.split(', ', 1)[1]}")


def with_tiers(v):
    """Series with something new first, then those with something unread, then the others."""
    state = intelligence.series_state(intelligence.series_intelligence(v.books, v.series), v.series)
    new = intelligence.new_flags(v.books).where("has_new_available or has_new_upcoming").select("series_id", F.lit(True).alias("new"))
    rows = v.series.join(state.select("series_id", "has_unread_books"), "series_id").join(new, "series_id", "left")
    return rows.withColumn("tier", F.when(F.col("new"), 0).when(F.col("has_unread_books"), 1).otherwise(2))


ordered_by_profile("O12_series_order", with_tiers, lambda: [F.col("tier"), F.lower("name"), F.col("series_id")], ("tier", "name"),
                   f"WITH {KNOWN} SELECT s.*, CASE WHEN s.series_id IN (SELECT series_id FROM books WHERE {LIVE} AND (is_missing OR read_status = 'upcoming' OR is_upcoming_final)) THEN 0 WHEN k.next_unread IS NOT NULL THEN 1 ELSE 2 END AS tier FROM series s JOIN known k USING (series_id)", "tier, lower(name), series_id", "series_id")
ordered("O13_by_title", in_series, lambda: [F.lower("title"), F.col("book_id")], _IN, "lower(title), book_id")
ordered("O14_skeleton_order", lambda v: in_series(v).where("book_number is not null"), lambda: [F.col("series_id"), F.col("book_number"), F.col("book_id")], f"{_IN} AND book_number IS NOT NULL", "series_id, book_number, book_id")
ordered("O15_preview_rows", lambda v: v.books.where("profile_id = 'p2'"), lambda: [F.col("book_id")], "SELECT * FROM books WHERE profile_id = 'p2'", "book_id", (), 10)
ordered_by_profile("O16_confirmation_order", waiting, lambda: [F.col("book_id")], (), "SELECT * FROM books WHERE book_id % 3 = 0 AND book_id % 6 <> 0", "book_id")
ordered_by_profile("O18_standalone_order", lambda v: lists.standalone(v.books), lambda: [F.lower("author").desc(), F.col("book_id")], ("author",), f"SELECT * FROM books WHERE {LIVE} AND series_id IS NULL", "lower(author) DESC, book_id")
ordered("W13_pinned_first", lambda v: v.books.where("series_id = 5"), lambda: lists.pinned_first(None, [40, 7]), "SELECT * FROM books WHERE series_id = 5", "CASE book_id WHEN 40 THEN 1 WHEN 7 THEN 2 ELSE 3 END, coalesce(book_number, 0), book_id")
_GRP = "coalesce(lower(trim(series_name_hint)), '')"
for key in ("A19_candidate_groups", "O17_grouped_candidates"):
    register(key, lambda v: v.hits.groupBy("series_id", F.coalesce(F.lower(F.trim("series_name_hint")), F.lit("")).alias("heading")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("series_number_hint", F.lit(9e15)).alias("n"), "hit_pos"))).alias("c")).select("series_id", "heading", F.array_join(F.transform("c", lambda x: x["hit_pos"].cast("string")), ",").alias("members")),
             f"SELECT series_id, {_GRP} AS heading, string_agg(CAST(hit_pos AS VARCHAR), ',' ORDER BY coalesce(series_number_hint, 9e15), hit_pos) AS members FROM candidate_hits GROUP BY series_id, heading")
register("A34_facets", lambda v: lists.facet(v.books, "author").select(F.lit("author").alias("facet"), "value").unionByName(lists.facet(v.books, "read_status").select(F.lit("status").alias("facet"), "value")), "SELECT DISTINCT 'author' AS facet, trim(author) AS value FROM books WHERE trim(author) <> '' UNION SELECT DISTINCT 'status', trim(read_status) FROM books WHERE trim(read_status) <> ''")

# windows


def hit_key():
    return F.coalesce(t.filled(F.col("isbn13")), t.title_key(F.col("title")), t.discovered_title_key(F.col("title")))


_KSQL = f"coalesce(isbn13, nullif({duck.title('title')}, ''), {duck.discovered_title('title')})"
register("W1_first_of_key", lambda v: v.hits.withColumn("n", F.row_number().over(Window.partitionBy("series_id", hit_key()).orderBy("hit_pos"))).where("n = 1").select("hit_pos"), f"SELECT min(hit_pos) AS hit_pos FROM candidate_hits GROUP BY series_id, {_KSQL}")
register("W2_representative", lambda v: v.hits.groupBy("series_id", hit_key().alias("key")).agg(F.min_by("hit_pos", F.struct(entity.provider_rank(F.col("source")), "hit_pos")).alias("hit_pos")), f"SELECT series_id, {_KSQL} AS key, arg_min(hit_pos, {_RANK} * 1000000000000 + hit_pos) AS hit_pos FROM candidate_hits GROUP BY ALL")
register("W3_first_filled", lambda v: v.hits.groupBy("series_id", hit_key().alias("key")).agg(F.min_by(F.struct(F.nullif("language", F.lit("")).alias("v")), F.when(F.col("language") != "", F.struct(entity.provider_rank(F.col("source")), "hit_pos", "language")))["v"].alias("language")), f"SELECT series_id, {_KSQL} AS key, arg_min(language, CASE WHEN language <> '' THEN ({_RANK} * 1000000000000 + hit_pos, language) END) AS language FROM candidate_hits GROUP BY ALL")
_RICH = "CAST(isbn13 IS NOT NULL AS INTEGER) + CAST(series_number_hint IS NOT NULL AS INTEGER) + CAST(published_date <> '' AS INTEGER)"
register("W4_richest", lambda v: v.hits.groupBy("series_id", t.bare_title_key(F.col("title")).alias("key")).agg(F.min_by("hit_pos", F.struct(-(F.col("isbn13").isNotNull().cast("int") + F.col("series_number_hint").isNotNull().cast("int") + (F.col("published_date") != "").cast("int")), "hit_pos")).alias("hit_pos")), f"SELECT series_id, {duck.bare_key('title')} AS key, arg_min(hit_pos, -({_RICH}) * 1000000000000 + hit_pos) AS hit_pos FROM candidate_hits GROUP BY ALL")
register("W8_first_by_asin", lambda v: v.books.where("asin is not null").groupBy("asin").agg(F.min("book_id").alias("book_id")), "SELECT asin, min(book_id) AS book_id FROM books WHERE asin IS NOT NULL GROUP BY asin")
register("W10_capped_hits", lambda v: v.hits.withColumn("n", F.row_number().over(Window.partitionBy("series_id", "source").orderBy("hit_pos"))).where("n <= 3").select("hit_pos"), "SELECT hit_pos FROM candidate_hits QUALIFY row_number() OVER (PARTITION BY series_id, source ORDER BY hit_pos) <= 3")
register("W11_last_hit_wins", lambda v: v.hits.groupBy("series_id", "source", hit_key().alias("key")).agg(F.max("hit_pos").alias("hit_pos")), f"SELECT series_id, source, {_KSQL} AS key, max(hit_pos) AS hit_pos FROM candidate_hits GROUP BY ALL")
register("W12_unique_flag", lambda v: v.books.where(active()).select("book_id", (F.count(F.lit(1)).over(Window.partitionBy("profile_id", t.title_key(F.col("title")))) == 1).alias("is_unique")), f"SELECT book_id, count(*) OVER (PARTITION BY profile_id, {duck.title('title')}) = 1 AS is_unique FROM books WHERE {LIVE}")
