"""Scans, mutations, reports, joins and aggregates over the catalog (inventory S, K, J, A, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.functions import titles as w
from stacksight.operators import integrity, intelligence, snapshots
from stacksight.operators.intelligence import active
from stacksight.plans import duck
from stacksight.plans.registry import register
from stacksight.sources.library import AS_OF

LIVE = "(record_status IS NULL OR record_status <> 'deleted')"
READ = "(is_read OR read_status = 'read')"
OWN = "books JOIN (SELECT series_id AS sid, profile_id AS pid FROM series) own ON own.sid = series_id AND own.pid = profile_id"
_LO, _HI = duck.get("title", r"books? (\d+)-(\d+)", 1, "i"), duck.get("title", r"books? (\d+)-(\d+)", 2, "i")
COVERED = f"""SELECT series_id, CAST(book_number AS BIGINT) AS n FROM live WHERE book_number > 0 AND book_number = floor(book_number)
UNION SELECT series_id, unnest(range(CAST({_LO} AS BIGINT), CAST({_HI} AS BIGINT) + 1)) AS n FROM live WHERE {duck.has('title', r'books? (\d+)-(\d+)', 'i')}"""
KNOWN = f"""live AS (SELECT * FROM {OWN} WHERE {LIVE}), covered AS (SELECT DISTINCT series_id, CAST(n AS BIGINT) AS n FROM ({COVERED})),
totals AS (SELECT series_id, max(n) AS total FROM covered GROUP BY series_id),
lacking AS (SELECT series_id, n FROM (SELECT series_id, CAST(unnest(range(1, total + 1)) AS BIGINT) AS n FROM totals) EXCEPT SELECT series_id, n FROM covered),
gaps AS (SELECT series_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS missing FROM lacking GROUP BY series_id),
counts AS (SELECT series_id, CAST(min(CASE WHEN book_number > 0 AND book_number = floor(book_number) AND NOT {READ} AND read_status <> 'upcoming' THEN book_number END) AS BIGINT) AS next_unread,
min(CASE WHEN book_number > 0 AND read_status = 'upcoming' THEN book_number END) AS next_upcoming, count(*) FILTER ({READ}) AS read_count, count(*) FILTER (NOT {READ}) AS unread_count FROM live GROUP BY series_id),
known AS (SELECT s.series_id, CAST(coalesce(total, 0) AS BIGINT) AS total_covered, coalesce(missing, '') AS missing, next_unread, next_upcoming, is_finished, coalesce(read_count, 0) AS read_count, coalesce(unread_count, 0) AS unread_count, has_new_books
FROM series s LEFT JOIN totals USING (series_id) LEFT JOIN gaps USING (series_id) LEFT JOIN counts USING (series_id))"""
AGGREGATES = f"""counted AS (SELECT series_id, CAST(max(CASE WHEN {LIVE} AND book_number > 0 THEN floor(book_number) END) AS BIGINT) AS total_books, count(*) FILTER ({LIVE}) AS active_count, count(*) FILTER (NOT {LIVE}) AS deleted_count,
count(*) FILTER ({LIVE} AND read_status = 'upcoming') AS upcoming_count FROM {OWN} GROUP BY series_id)"""
AGG_COLS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total_books", "active_count", "deleted_count", "upcoming_count"))
STATE = "next_unread IS NOT NULL AS has_unread_books, next_upcoming IS NOT NULL AS has_upcoming_books, next_unread IS NULL AND next_upcoming IS NULL AND missing = '' AS is_caught_up, CASE WHEN is_finished THEN 'finished' ELSE 'ongoing' END AS series_status"


def known(v):
    return intelligence.series_intelligence(v.books, v.series)


def shown(df):
    return df.withColumn("missing", intelligence.missing_text()).drop("gaps")


# scans
register("S4_tenant_scan", lambda v: v.books.where("profile_id = 'p1'").select("book_id", "title"), "SELECT book_id, title FROM books WHERE profile_id = 'p1'")
register("S5_point_lookup", lambda v: v.books.where("profile_id = 'p1'").orderBy("book_id").limit(1).select("book_id", "title"), "SELECT book_id, title FROM books WHERE profile_id = 'p1' ORDER BY book_id LIMIT 1")

# series knowledge
register("A3_series_aggregates", lambda v: intelligence.series_aggregates(v.books, v.series), f"WITH {AGGREGATES} SELECT s.series_id, {AGG_COLS} FROM series s LEFT JOIN counted USING (series_id)")
register("A4_series_intelligence", lambda v: shown(known(v)).join(intelligence.series_state(known(v), v.series), "series_id"), f"WITH {KNOWN} SELECT series_id, total_covered, missing, next_unread, next_upcoming, is_finished, read_count, unread_count, has_new_books, {STATE} FROM known")
register("A5_missing_numbers", lambda v: known(v).select("series_id", F.explode("missing").alias("number")), f"WITH {KNOWN} SELECT series_id, n AS number FROM lacking")
register("A6_next_unread", lambda v: known(v).where("next_unread is not null").select("series_id", "next_unread"), f"WITH {KNOWN} SELECT series_id, next_unread FROM known WHERE next_unread IS NOT NULL")
register("A7_next_upcoming", lambda v: known(v).where("next_upcoming is not null").select("series_id", "next_upcoming"), f"WITH {KNOWN} SELECT series_id, next_upcoming FROM known WHERE next_upcoming IS NOT NULL")
register("A8_series_state", lambda v: intelligence.series_state(known(v), v.series, v.notifications.where("kind = 'new_book' and dismissed_at is null")),
         f"WITH {KNOWN} SELECT series_id, has_new_books OR series_id IN (SELECT series_id FROM notifications WHERE kind = 'new_book' AND dismissed_at IS NULL) AS has_new_books, {STATE} FROM known")
_UP = "(read_status = 'upcoming' OR is_upcoming_auto OR is_upcoming_final)"
register("A9_counters", lambda v: intelligence.counters(v.books), f"SELECT series_id, count(*) AS total_books, count(*) FILTER (NOT {_UP} AND NOT {READ}) AS unread_books, count(*) FILTER (NOT {_UP} AND {READ}) AS read_books, count(*) FILTER ({_UP}) AS upcoming_books FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
register("A10_status_bar", lambda v: intelligence.status_bar(known(v)), f"WITH {KNOWN} SELECT series_id, CASE WHEN is_finished THEN 'finished' ELSE 'ongoing' END AS status, next_unread, next_upcoming, missing FROM known")
register("A11_fractional_collisions", lambda v: intelligence.fractional_collisions(v.books).withColumn("members", F.array_join("members", ",")),
         f"SELECT series_id, CAST(floor(book_number) AS BIGINT) AS whole_number, count(DISTINCT book_number) AS n_numbers, count(*) AS n_books, string_agg(CAST(book_id AS VARCHAR), ',' ORDER BY book_id) AS members FROM books WHERE series_id IS NOT NULL AND book_number > 0 GROUP BY series_id, floor(book_number) HAVING count(DISTINCT book_number) > 1 AND bool_or(NOT {LIVE})")
register("A12_new_flags", lambda v: intelligence.new_flags(v.books), f"SELECT series_id, bool_or(is_missing AND read_status <> 'upcoming') AS has_new_available, bool_or(read_status = 'upcoming' OR is_upcoming_final) AS has_new_upcoming FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
register("A13_read_counts", lambda v: intelligence.read_counts(v.books), f"SELECT series_id, count(*) FILTER (is_read) AS read_count, count(*) FILTER (NOT is_read) AS unread_count FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
register("A1_books_per_profile", lambda v: v.profiles.join(v.books.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")), "profile_id", "left").select("profile_id", F.coalesce("n", F.lit(0)).alias("n_books"), (F.coalesce("n", F.lit(0)) > 0).alias("has_data")),
         "SELECT p.profile_id, count(book_id) AS n_books, count(book_id) > 0 AS has_data FROM profiles p LEFT JOIN books b ON b.profile_id = p.profile_id GROUP BY p.profile_id")
QUEUE = f"{LIVE} AND (metadata_source IS NULL OR metadata_source IN ('user', 'import') OR coalesce(needs_reresolution, false))"


def queue(v):
    return v.books.where(active() & (F.col("metadata_source").isNull() | F.col("metadata_source").isin("user", "import") | d.flag(F.col("needs_reresolution"))))


register("A2_reresolution_count", lambda v: queue(v).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT profile_id, count(*) AS n FROM books WHERE {QUEUE} GROUP BY profile_id")
register("A14_status_summary", lambda v: v.books.where(active()).groupBy("read_status").agg(F.count(F.lit(1)).alias("n")), f"SELECT read_status, count(*) AS n FROM books WHERE {LIVE} GROUP BY read_status")
register("A15_ongoing_finished", lambda v: v.series.join(intelligence.counters(v.books).select("series_id", "total_books"), "series_id", "left").groupBy("profile_id").agg(F.count_if(~d.flag(F.col("is_finished"))).alias("ongoing"), F.count_if("is_finished").alias("finished"), F.coalesce(F.sum("total_books"), F.lit(0)).alias("tracked")),
         f"SELECT s.profile_id, count(*) FILTER (NOT is_finished) AS ongoing, count(*) FILTER (is_finished) AS finished, CAST(coalesce(sum(n), 0) AS BIGINT) AS tracked FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM books WHERE {LIVE} GROUP BY series_id) c ON c.series_id = s.series_id GROUP BY s.profile_id")
_TOP = f"SELECT series_id, max(CASE WHEN NOT is_missing THEN CAST(floor(book_number) AS BIGINT) END) AS highest_owned, CAST(floor(max(book_number)) + 1 AS BIGINT) AS next_number, coalesce(max(book_number), 0.0) AS ceiling FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id"
register("A16_next_number", lambda v: intelligence.owned_top(v.books).select("series_id", "next_number"), f"SELECT series_id, next_number FROM ({_TOP})")
register("A41_highest_owned", lambda v: intelligence.owned_top(v.books).select("series_id", "highest_owned"), f"SELECT series_id, highest_owned FROM ({_TOP})")
register("A44_number_ceiling", lambda v: intelligence.owned_top(v.books).join(known(v).select("series_id", F.coalesce(F.try_element_at("gaps", F.lit(-1))["hi"], F.lit(0)).alias("gap")), "series_id").select("series_id", F.greatest("ceiling", "gap").alias("ceiling")),
         f"WITH {KNOWN}, top AS ({_TOP}), far AS (SELECT series_id, max(n) AS gap FROM lacking GROUP BY series_id) SELECT top.series_id, greatest(ceiling, CAST(coalesce(gap, 0) AS DOUBLE)) AS ceiling FROM top JOIN series USING (series_id) LEFT JOIN far USING (series_id)")
register("A17_detail_counts", lambda v: v.books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(F.count_if(intelligence.read()).alias("read"), F.count_if(intelligence.upcoming()).alias("upcoming"), F.count_if(~intelligence.read() & ~intelligence.upcoming()).alias("unread"), F.count_if(d.needs_verification(F.col("read_status"), F.col("publication_date"), F.col("release_date"))).alias("unverified")),
         f"SELECT series_id, count(*) FILTER ({READ}) AS read, count(*) FILTER (read_status = 'upcoming') AS upcoming, count(*) FILTER (NOT {READ} AND read_status <> 'upcoming') AS unread, count(*) FILTER (read_status IN ('upcoming', 'available') AND publication_date IS NULL AND release_date IS NULL) AS unverified FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
_FD = duck.flexible_date("published_date")
register("A18_series_maturity", lambda v: v.hits.withColumn("day", d.flexible_date(F.col("published_date"))).where("series_name_hint is not null").groupBy("series_name_hint").agg(F.count(F.lit(1)).alias("found"), F.max("series_total_hint").alias("total"), F.max(F.when(F.col("day") <= F.lit(AS_OF).cast("date"), F.col("day"))).alias("last_available"), F.min(F.when(F.col("day") > F.lit(AS_OF).cast("date"), F.col("day"))).alias("next_upcoming"), F.bool_or(d.is_upcoming(F.col("day"), F.col("upcoming_hint"), AS_OF)).alias("has_upcoming")),
         f"SELECT series_name_hint, count(*) AS found, max(series_total_hint) AS total, max(CASE WHEN {_FD} <= DATE '{AS_OF}' THEN {_FD} END) AS last_available, min(CASE WHEN {_FD} > DATE '{AS_OF}' THEN {_FD} END) AS next_upcoming, bool_or(coalesce({_FD} > DATE '{AS_OF}', upcoming_hint, false)) AS has_upcoming FROM candidate_hits WHERE series_name_hint IS NOT NULL GROUP BY series_name_hint")
register("A20_unique_bare_titles", lambda v: v.books.where(active()).groupBy("profile_id", t.bare_title_key(F.col("title")).alias("title_key")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("profile_id", "title_key"),
         f"SELECT profile_id, {duck.bare_key('title')} AS title_key FROM books WHERE {LIVE} GROUP BY ALL HAVING count(*) = 1")
register("A23_expected_total", lambda v: v.hits.groupBy("series_id").agg(F.max("series_total_hint").alias("expected"), F.count("series_total_hint").alias("hints")), "SELECT series_id, max(series_total_hint) AS expected, count(series_total_hint) AS hints FROM candidate_hits GROUP BY series_id")
_HAVE = f"SELECT DISTINCT series_id, CAST(floor(book_number) AS BIGINT) AS n FROM books WHERE {LIVE} AND book_number > 0"


def expected(v):
    return v.hits.groupBy("series_id").agg(F.max("series_total_hint").alias("expected")).where("expected is not null")


def numbers(rows, c, whole):
    n = F.col(c)
    return rows.where((n > 0) & F.col("series_id").isNotNull() & (F.lit(True) if not whole else n == F.floor(n))).select("series_id", F.floor(n).alias("n"))


def external_gaps(v, whole):
    have = numbers(v.books.where(active()), "book_number", whole)
    return intelligence.expected_gaps(expected(v), have if whole else have.unionByName(numbers(v.hits, "series_number_hint", False)))


_EXP = "wanted AS (SELECT series_id, max(series_total_hint) AS expected FROM candidate_hits GROUP BY series_id HAVING max(series_total_hint) IS NOT NULL), slots AS (SELECT series_id, expected, CAST(unnest(range(1, expected + 1)) AS BIGINT) AS n FROM wanted)"
_WHOLE = f"{_HAVE} AND book_number = floor(book_number)"
register("A24_external_missing", lambda v: external_gaps(v, False).select("series_id", intelligence.missing_text().alias("missing")),
         f"WITH {_EXP}, have AS ({_HAVE} UNION SELECT series_id, CAST(floor(series_number_hint) AS BIGINT) FROM candidate_hits WHERE series_number_hint > 0) SELECT s.series_id, coalesce(string_agg(CASE WHEN h.n IS NULL THEN CAST(s.n AS VARCHAR) END, ',' ORDER BY s.n), '') AS missing FROM slots s LEFT JOIN have h ON h.series_id = s.series_id AND h.n = s.n GROUP BY s.series_id")
register("A25_external_gap_ratio", lambda v: external_gaps(v, True).select("series_id", F.round(F.try_divide(intelligence.n_numbers(F.col("gaps")), F.col("expected")), 4).alias("ratio")),
         f"WITH {_EXP}, have AS ({_WHOLE}) SELECT s.series_id, round(count(*) FILTER (h.n IS NULL) / CAST(max(expected) AS DOUBLE), 4) AS ratio FROM slots s LEFT JOIN have h ON h.series_id = s.series_id AND h.n = s.n GROUP BY s.series_id")
register("A26_number_coverage", lambda v: v.books.where(active()).groupBy("series_id").agg(F.count(F.lit(1)).alias("books"), F.count("book_number").alias("numbered"), F.count_if(F.col("book_number") == F.floor("book_number")).alias("integral")),
         f"SELECT series_id, count(*) AS books, count(book_number) AS numbered, count(*) FILTER (book_number = floor(book_number)) AS integral FROM books WHERE {LIVE} GROUP BY series_id")
register("A32_title_pattern_vote", lambda v: v.books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(F.count_if(w.has_series_suffix(F.col("title"))).alias("with_suffix"), F.count_if(~w.has_series_suffix(F.col("title"))).alias("title_only")).withColumn("pattern", F.when(F.col("with_suffix") >= F.col("title_only"), "with_suffix").otherwise("title_only")),
         f"SELECT series_id, with_suffix, title_only, CASE WHEN with_suffix >= title_only THEN 'with_suffix' ELSE 'title_only' END AS pattern FROM (SELECT series_id, count(*) FILTER ({duck.has('title', r'\([^)]*\bbook\s*\d+(?:\.\d+)?[^)]*\)\s*$', 'i')}) AS with_suffix, count(*) FILTER (NOT {duck.has('title', r'\([^)]*\bbook\s*\d+(?:\.\d+)?[^)]*\)\s*$', 'i')}) AS title_only FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id)")
register("A33_series_number_groups", lambda v: v.books.where(active()).select("series_id", "book_number").where("series_id is not null and book_number is not null").distinct(), f"SELECT DISTINCT series_id, book_number FROM books WHERE {LIVE} AND series_id IS NOT NULL AND book_number IS NOT NULL")
_CL = f"live AS (SELECT * FROM books WHERE {LIVE} AND series_id IS NOT NULL), omni AS (SELECT DISTINCT series_id, CAST(unnest(range(CAST({_LO} AS BIGINT), CAST({_HI} AS BIGINT) + 1)) AS BIGINT) AS n FROM live WHERE {duck.has('title', r'books? (\d+)-(\d+)', 'i')}), owned AS (SELECT DISTINCT series_id, CAST(book_number AS BIGINT) AS n FROM live WHERE book_number > 0 AND book_number = floor(book_number)), tops AS (SELECT series_id, max(n) AS top FROM owned GROUP BY series_id HAVING count(*) >= 2), lack AS (SELECT series_id, CAST(unnest(range(1, top + 1)) AS BIGINT) AS n FROM tops EXCEPT SELECT * FROM owned EXCEPT SELECT * FROM omni)"
register("A35_client_gaps", lambda v: shown(intelligence.client_gaps(v.books)), f"WITH {_CL} SELECT tops.series_id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') AS missing FROM tops LEFT JOIN lack USING (series_id) GROUP BY tops.series_id")
_MG = lambda inferred: f"WITH {KNOWN}, {inferred.replace('live AS', 'alive AS').replace('FROM live', 'FROM alive')}, every AS (SELECT series_id, n FROM lacking UNION SELECT series_id, n FROM lack) SELECT series.series_id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') AS missing FROM series LEFT JOIN every USING (series_id) GROUP BY series.series_id"
for key in ("A36_merged_gaps", "U9_gap_union"):
    register(key, lambda v: shown(intelligence.merged_gaps(known(v), intelligence.client_gaps(v.books))), _MG(_CL))
register("A42_standalone_counts", lambda v: v.books.where(active() & F.col("series_id").isNull()).groupBy("profile_id").agg(F.count_if(intelligence.read()).alias("read"), F.count_if(~intelligence.read()).alias("unread")), f"SELECT profile_id, count(*) FILTER ({READ}) AS read, count(*) FILTER (NOT {READ}) AS unread FROM books WHERE {LIVE} AND series_id IS NULL GROUP BY profile_id")
register("A43_progress", lambda v: intelligence.counters(v.books).select("series_id", intelligence.percent(F.col("read_books"), F.col("total_books")).alias("percent")), f"SELECT series_id, CAST(floor(count(*) FILTER (NOT {_UP} AND {READ}) * 100.0 / count(*)) AS BIGINT) AS percent FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id")
register("D17_recalculated", lambda v: shown(intelligence.recalculated(v.books, v.series)), f"WITH {KNOWN}, {AGGREGATES} SELECT series_id, total_covered, missing, next_unread, next_upcoming, is_finished, read_count, unread_count, has_new_books, {STATE}, {AGG_COLS} FROM known LEFT JOIN counted USING (series_id)")

# joins and reports
register("J1_ghost_books", lambda v: integrity.ghost_books(v.books, v.series), "SELECT b.book_id, b.title, b.series_id, s.name AS series_name, b.profile_id, s.profile_id AS series_profile FROM books b JOIN series s ON b.series_id = s.series_id WHERE b.profile_id <> s.profile_id")
register("J2_deleted_books", lambda v: integrity.deleted_books(v.books, v.series), "SELECT b.book_id, b.title, b.author, b.series_id, s.name AS series_name, b.book_number FROM books b LEFT JOIN series s ON b.series_id = s.series_id WHERE b.record_status = 'deleted'")
register("J3_numbered_books", lambda v: v.books.where("book_number is not null").join(v.series.select("series_id", F.col("name").alias("series_name")), "series_id", "left").select("book_id", "series_name", "book_number"), "SELECT b.book_id, s.name AS series_name, b.book_number FROM books b LEFT JOIN series s ON b.series_id = s.series_id WHERE b.book_number IS NOT NULL")
register("J4_orphans", lambda v: integrity.orphans(v.books, v.series), "SELECT book_id, title, series_id, profile_id FROM books WHERE series_id IS NOT NULL AND series_id NOT IN (SELECT series_id FROM series)")
register("J5_series_names", lambda v: v.books.join(v.series.select("series_id", F.col("name").alias("series_name")), "series_id", "left").select("book_id", "series_name"), "SELECT book_id, name AS series_name FROM books LEFT JOIN series ON books.series_id = series.series_id")
register("J9_skeleton_by_number", lambda v: v.hits.where("series_number_hint is not null").select("hit_pos", "series_id", F.col("series_number_hint").alias("n")).join(v.books.where(active() & F.col("book_number").isNotNull()).groupBy("series_id", F.col("book_number").alias("n")).agg(F.max_by("title", "book_id").alias("known")), ["series_id", "n"], "left").select("hit_pos", "known"),
         f"SELECT hit_pos, k.known FROM candidate_hits h LEFT JOIN (SELECT series_id, book_number AS n, arg_max(title, book_id) AS known FROM books WHERE {LIVE} AND book_number IS NOT NULL GROUP BY series_id, book_number) k ON k.series_id = h.series_id AND k.n = h.series_number_hint WHERE h.series_number_hint IS NOT NULL")


def same_author_counts(v):
    """Other series of an author in a profile: one count for each author, never a pair."""
    rows = v.series.select("series_id", "profile_id", t.author_identity(F.col("author")).alias("who")).where("who <> ''")
    sizes = rows.groupBy("profile_id", "who").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return rows.join(sizes, ["profile_id", "who"]).select("series_id", "others")


register("J13_series_of_same_author", same_author_counts,
         f"SELECT a.series_id, count(*) AS others FROM series a JOIN series b ON a.profile_id = b.profile_id AND {duck.author('a.author')} = {duck.author('b.author')} AND a.series_id <> b.series_id WHERE {duck.author('a.author')} <> '' GROUP BY a.series_id")
register("J14_notices", lambda v: v.notifications.join(v.series.select("series_id", "name"), "series_id", "left").join(v.profiles.select("profile_id", "display_name"), "profile_id", "left").select("notification_id", "name", "display_name"), "SELECT n.notification_id, s.name, p.display_name FROM notifications n LEFT JOIN series s ON s.series_id = n.series_id LEFT JOIN profiles p ON p.profile_id = n.profile_id")

# repairs and mutations
def requests(v):
    """Hits that somebody adds as books: some without a series, some under another profile, some bound to what was found."""
    n = F.col("hit_pos")
    tier = F.when(n % 4 == 0, "high").when(n % 4 == 1, "low")
    rows = v.hits.where("isbn13 is not null").join(v.series.select("series_id", "profile_id"), "series_id")
    return rows.select((n + 10_000_000).alias("book_id"), F.when(n % 11 == 0, "p9").otherwise(F.col("profile_id")).alias("profile_id"), F.concat(F.lit(" "), "title").alias("title"), F.when(n % 7 != 0, F.col("series_id")).alias("series_id"), F.col("series_number_hint").alias("book_number"), tier.alias("find_confidence"))


_ASKED = f"""asked AS (SELECT h.hit_pos + 10000000 AS book_id, CASE WHEN hit_pos % 11 = 0 THEN 'p9' ELSE s.profile_id END AS profile_id, s.profile_id AS home, trim(title) AS title, CASE WHEN hit_pos % 7 <> 0 THEN h.series_id END AS series_id, hit_pos % 4 AS tier,
series_number_hint AS given, {duck.inferred('title')} AS told FROM candidate_hits h JOIN series s USING (series_id) WHERE isbn13 IS NOT NULL),
written AS (SELECT *, coalesce(given, told) AS number, CASE WHEN series_id IS NOT NULL AND profile_id <> home THEN 'series_of_other_profile' WHEN series_id IS NULL AND coalesce(given, told) IS NOT NULL THEN 'number_without_series' END AS error FROM asked)"""
register(
    "K1_requests", lambda v: snapshots.requested(requests(v), v.series),
    f"""WITH {_ASKED} SELECT book_id, profile_id, title, series_id, number AS book_number, CASE WHEN given IS NOT NULL THEN 'user' WHEN told IS NOT NULL THEN 'title_inferred' END AS book_number_source,
CASE WHEN number = floor(number) THEN CAST(number AS BIGINT) END AS series_order, CASE WHEN tier < 2 THEN 'provider' ELSE 'user' END AS metadata_source, CASE WHEN tier < 2 THEN tier = 1 END AS needs_reresolution, error FROM written""",
)
register("K1_created", lambda v: snapshots.created(v.books.select("book_id", "title", "series_id", "book_number"), snapshots.requested(requests(v), v.series).select("book_id", "title", "series_id", "book_number", "error")),
         f"WITH {_ASKED} SELECT book_id, title, series_id, book_number FROM books UNION ALL SELECT book_id, title, series_id, number FROM written WHERE error IS NULL")
register("K2_patched", lambda v: snapshots.patched(v.books, v.books.where("book_id % 5 = 0").select("book_id", F.array_compact(F.array(F.lit("title"), F.when(F.col("book_id") % 2 == 0, F.lit("asin")))).alias("set"), F.upper("title").alias("title"), F.lit(None).cast("string").alias("asin")), "book_id").select("book_id", "title", "asin"),
         "SELECT book_id, CASE WHEN book_id % 5 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN book_id % 10 = 0 THEN NULL ELSE asin END AS asin FROM books")
register("K3_deleted", lambda v: snapshots.deleted(v.books, v.books.where("book_id % 3 = 0"), "book_id").select("book_id"), "SELECT book_id FROM books WHERE book_id % 3 <> 0")
register("K5_series_deleted", lambda v: (lambda p: p[0].select("book_id", F.lit("book").alias("kind")).unionByName(p[1].select(F.col("series_id").alias("book_id"), F.lit("series").alias("kind"))))(snapshots.series_deleted(v.books, v.series, v.series.where("series_id % 4 = 1"))),
         "SELECT book_id, 'book' AS kind FROM books WHERE series_id IS NULL OR series_id NOT IN (SELECT series_id FROM series WHERE series_id % 4 = 1) UNION ALL SELECT series_id, 'series' FROM series WHERE series_id % 4 <> 1")
register("K6_series_finished", lambda v: snapshots.series_finished(v.books, v.series, v.series.where("series_id % 4 = 1"), True)[0].where("is_series_finished").select("book_id"), f"SELECT book_id FROM books WHERE {LIVE} AND series_id IN (SELECT series_id FROM series WHERE series_id % 4 = 1)")
register("K9_series_author", lambda v: integrity.authors_from_books(v.books, v.series).where("outcome = 'filled'").select("series_id", "author"),
         f"SELECT s.series_id, min(trim(b.author)) AS author FROM series s JOIN books b ON b.series_id = s.series_id WHERE {duck.filled('s.author')} IS NULL AND {LIVE.replace('record_status', 'b.record_status')} GROUP BY s.series_id HAVING count(DISTINCT {duck.author('b.author')}) = 1")
register("K10_profile_reset", lambda v: snapshots.profile_reset(v.books, "p0").groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")), "SELECT profile_id, count(*) AS n FROM books WHERE profile_id <> 'p0' GROUP BY profile_id")
register("K11_without_orphans", lambda v: integrity.without_orphans(v.books, v.series).select("book_id"), "SELECT book_id FROM books WHERE series_id IS NULL OR series_id IN (SELECT series_id FROM series)")
for key in ("K12_rehomed", "K23_ghost_repair"):
    register(key, lambda v: integrity.rehomed(v.books, v.series).where("changed").select("book_id", "profile_id"), "SELECT b.book_id, s.profile_id FROM books b JOIN series s ON b.series_id = s.series_id WHERE b.profile_id <> s.profile_id")
register("K13_restored", lambda v: integrity.restored(v.books, v.books.where("book_id % 50 = 0").select("book_id").unionByName(v.books.where("book_id % 50 = 1").select((F.col("book_id") + 1_000_000_000).alias("book_id")))),
         f"SELECT book_id, CASE WHEN {LIVE} THEN 'not_deleted' ELSE 'restored' END AS status FROM books WHERE book_id % 50 = 0 UNION ALL SELECT book_id + 1000000000, 'not_found' FROM books WHERE book_id % 50 = 1")
register("K14_stale_flags", lambda v: integrity.stale_flags(v.books.withColumn("is_missing", F.col("is_missing") | (F.col("book_id") % 6 == 0))), f"SELECT book_id, series_id, is_missing OR book_id % 6 = 0 AS is_missing, is_upcoming_auto, is_upcoming_final FROM books WHERE {READ} AND (is_missing OR book_id % 6 = 0 OR is_upcoming_auto OR is_upcoming_final)")
register("K15_skeletons", lambda v: integrity.skeletons(v.books).select("series_id", F.size("entries").cast("bigint").alias("n"), F.array_join(F.transform("entries", lambda e: t.number_text(e["book_number"])), ",").alias("numbers")),
         f"SELECT series_id, count(*) AS n, string_agg({duck.number_text('book_number')}, ',' ORDER BY book_number) AS numbers FROM books WHERE {LIVE} AND series_id IS NOT NULL AND book_number IS NOT NULL GROUP BY series_id")
register("K16_dismissed", lambda v: snapshots.dismissed(v.notifications, "1998-06-01 00:00:00", profile_id="p1").where("dismissed_at = timestamp_ntz'1998-06-01 00:00:00'").select("notification_id"), "SELECT notification_id FROM notifications WHERE profile_id = 'p1' AND dismissed_at IS NULL")
_H = "coalesce(release_date, publication_date)"
_NEW = f"CASE WHEN {READ} THEN 'read' WHEN {_H} > DATE '{AS_OF}' THEN 'upcoming' WHEN {_H} IS NOT NULL THEN 'available' WHEN is_upcoming_auto OR is_upcoming_final OR read_status = 'upcoming' THEN 'upcoming' ELSE 'available' END"
for key in ("K19_library_sync", "F70_healed_status"):
    register(key, lambda v: integrity.healed(v.books, AS_OF),
             f"SELECT book_id, st AS read_status, st <> 'read' AND is_missing AS is_missing, st <> 'available' AND is_upcoming_auto AS is_upcoming_auto, st <> 'available' AND is_upcoming_final AS is_upcoming_final, st <> read_status OR (st = 'read' AND is_missing) OR (st = 'available' AND (is_upcoming_auto OR is_upcoming_final)) AS changed FROM (SELECT *, {_NEW} AS st FROM books)")
_RF = ("publication_date", "release_date", "isbn13", "asin", "edition")
register("K20_recovered_fields", lambda v: integrity.recovered_fields(v.books).withColumn("changed", F.array_join("changed", ",")),
         f"SELECT * FROM (SELECT l.book_id, {', '.join(f'coalesce(l.{f}, g.{f}) AS {f}' for f in _RF)}, concat_ws(',', {', '.join(f'CASE WHEN l.{f} IS NULL AND g.{f} IS NOT NULL THEN {chr(39)}{f}{chr(39)} END' for f in _RF)}) AS changed FROM books l JOIN (SELECT series_id, book_number, {', '.join(f'arg_min({f}, CASE WHEN {f} IS NOT NULL THEN book_id END) AS {f}' for f in _RF)} FROM books WHERE NOT {LIVE} AND series_id IS NOT NULL AND book_number IS NOT NULL GROUP BY series_id, book_number) g ON g.series_id = l.series_id AND g.book_number = l.book_number WHERE {LIVE.replace('record_status', 'l.record_status')}) WHERE changed <> ''")
register("K21_author_outcomes", lambda v: integrity.authors_from_books(v.books, v.series).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
         f"SELECT outcome, count(*) AS n FROM (SELECT s.series_id, CASE WHEN count(b.author) = 0 THEN 'none' WHEN count(DISTINCT {duck.author('b.author')}) = 1 THEN 'filled' ELSE 'conflict' END AS outcome FROM series s LEFT JOIN books b ON b.series_id = s.series_id AND {LIVE.replace('record_status', 'b.record_status')} WHERE {duck.filled('s.author')} IS NULL GROUP BY s.series_id) GROUP BY outcome")
register("K22_placeholder_authors", lambda v: integrity.without_placeholder_authors(v.series).select("series_id", "author", "cleared"), f"SELECT series_id, CASE WHEN NOT p THEN author END AS author, p AS cleared FROM (SELECT *, {duck.author('author')} IN ('unknown', 'n a', 'none', 'various') AS p FROM series)")
register("K24_defaulted_profiles", lambda v: v.books.select("book_id", F.coalesce(F.when(F.col("book_id") % 7 != 0, F.col("profile_id")), F.lit("p0")).alias("profile_id")), "SELECT book_id, coalesce(CASE WHEN book_id % 7 <> 0 THEN profile_id END, 'p0') AS profile_id FROM books")
register("K25_new_profiles", lambda v: snapshots.new_profiles(v.profiles, v.profiles.select(F.upper("profile_id").alias("name")).unionByName(v.profiles.select(F.concat(F.lit(" New "), "profile_id").alias("name"))).unionByName(v.profiles.limit(1).select(F.lit("  ").alias("name")))),
         "SELECT profile_id, upper(profile_id) AS display_name, 'taken' AS outcome FROM profiles UNION ALL SELECT 'new ' || profile_id, 'New ' || profile_id, 'ok' FROM profiles UNION ALL SELECT '', '', 'blank'")
register("P23_number_requires_series", lambda v: integrity.checked_links(v.books, v.series).select("book_id", F.array_join("errors", ",").alias("errors")),
         "SELECT * FROM (SELECT b.book_id, concat_ws(',', CASE WHEN b.book_number IS NOT NULL AND b.series_id IS NULL THEN 'number_without_series' END, CASE WHEN b.series_id IS NOT NULL AND s.series_id IS NULL THEN 'unknown_series' END, CASE WHEN s.profile_id <> b.profile_id THEN 'series_of_other_profile' END) AS errors FROM books b LEFT JOIN series s ON s.series_id = b.series_id) WHERE errors <> ''")

# sets
register("U1_expected_minus_known", lambda v: external_gaps(v, True).select("series_id", F.explode("missing").alias("number")), f"WITH {_EXP}, have AS ({_WHOLE}) SELECT s.series_id, s.n AS number FROM slots s WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.series_id = s.series_id AND h.n = s.n)")
register("U2_skeleton_minus_found", lambda v: v.books.where(active() & F.col("book_number").isNotNull()).select("series_id", F.col("book_number").alias("number")).distinct().join(v.hits.select("series_id", F.col("series_number_hint").alias("number")).distinct(), ["series_id", "number"], "left_anti").where("series_id is not null"),
         f"SELECT series_id, book_number AS number FROM books WHERE {LIVE} AND book_number IS NOT NULL AND series_id IS NOT NULL EXCEPT SELECT series_id, series_number_hint FROM candidate_hits")
register("U3_titles_of_author", lambda v: v.books.select("author", t.title_key(F.col("title")).alias("title_key")).union(v.hits.select("author", t.title_key(F.col("title")))).where("title_key is not null").distinct(), f"SELECT author, {duck.title('title')} AS title_key FROM books WHERE {duck.title('title')} <> '' UNION SELECT author, {duck.title('title')} FROM candidate_hits WHERE {duck.title('title')} <> ''")
register("U5_covered_numbers", lambda v: v.books.where(active() & F.col("series_id").isNotNull()).select("series_id", F.explode(d.laid_out(F.concat(intelligence.own_range(), d.omnibus_ranges(F.col("title"))))).alias("number")).distinct(),
         f"WITH live AS (SELECT * FROM books WHERE {LIVE} AND series_id IS NOT NULL) SELECT DISTINCT series_id, CAST(n AS BIGINT) AS number FROM ({COVERED})")
register("U8_providers_in_order", lambda v: v.hits.select("series_id", F.when(F.col("source") == "hardcover", 0).when(F.col("source") == "google_books", 1).when(F.col("source") == "openlibrary", 2).otherwise(3).alias("rank"), "source").distinct(), "SELECT DISTINCT series_id, CASE source WHEN 'hardcover' THEN 0 WHEN 'google_books' THEN 1 WHEN 'openlibrary' THEN 2 ELSE 3 END AS rank, source FROM candidate_hits")
