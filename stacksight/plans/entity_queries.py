"""Ingest, entity resolution, grading, finding and persistence (inventory D, and what belongs to it among J, K, P, U, W, A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.functions import titles as w
from stacksight.operators import entity, grading, ingest, lists, persist
from stacksight.operators import intelligence
from stacksight.operators.intelligence import active
from stacksight.operators.telemetry import Passes
from stacksight.plans import duck
from stacksight.plans.catalog_queries import KNOWN, LIVE, QUEUE, queue
from stacksight.plans.list_queries import _RANK, eligible
from stacksight.plans.registry import register
from stacksight.sources.library import AS_OF

BLIVE = LIVE.replace("record_status", "b.record_status")
_AM = f"""len(list_filter({duck.names("coalesce(s.author, '')")}, lambda n: len(list_filter(string_split({duck.normalized('n')}, ' '), lambda w: length(w) > 1)) > 0 AND len(list_filter(string_split({duck.normalized('n')}, ' '), lambda w: length(w) > 1 AND NOT contains({duck.normalized('h.author')}, w))) = 0)) > 0"""
_ORD = "(r, hit_pos, title, published_date)"
_FIRST = lambda v, cond: f"arg_min({v}, CASE WHEN {cond} THEN {_ORD} END)"
#: In the views a series name hint is the series' own name or one that shares nothing with it, so compatible means equal.
FUSED = f"""scored AS (SELECT h.*, s.name AS target, coalesce(s.author, '') AS target_author, coalesce(h.isbn13, nullif({duck.core_key('h.title')}, ''), {duck.normalized('h.title')}) AS key, {_RANK.replace('source', 'h.source')} AS r, {_AM} AS by_author
FROM candidate_hits h JOIN series s ON s.series_id = h.series_id),
grouped AS (SELECT series_id, target, target_author, key, arg_min(title, {_ORD}) AS title, coalesce({_FIRST('author', 'by_author')}, arg_min(author, {_ORD})) AS author, bool_or(by_author) AS author_match,
coalesce({_FIRST('language', "language IN ('', 'en')")}, arg_min(language, {_ORD})) AS language, max(isbn13) AS isbn13, {_FIRST('published_date', "published_date <> ''")} AS published_date, {_FIRST('series_name_hint', 'series_name_hint IS NOT NULL')} AS series_name_hint,
{_FIRST('series_number_hint', 'series_number_hint <> 0')} AS series_number_hint, {_FIRST('series_total_hint', 'series_total_hint IS NOT NULL')} AS series_total_hint, {_FIRST('upcoming_hint', 'upcoming_hint IS NOT NULL')} AS upcoming_hint,
list_sort(list(DISTINCT source)) AS sources, count(DISTINCT series_name_hint) AS n_names, count(*) AS n_hits, sum(DISTINCT CASE source WHEN 'hardcover' THEN 0.4 WHEN 'google_books' THEN 0.3 WHEN 'openlibrary' THEN 0.25 ELSE 0.15 END) AS weight FROM scored GROUP BY series_id, target, target_author, key),
fused AS (SELECT *, round(CAST(least(greatest(weight + CASE WHEN len(sources) > 1 THEN 0.1 ELSE 0 END + CASE WHEN isbn13 IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN author_match THEN 0.1 ELSE 0 END - CASE WHEN n_names > 1 THEN 0.1 ELSE 0 END
- CASE WHEN series_name_hint IS NULL THEN 0.05 WHEN series_name_hint <> target THEN 0.1 ELSE 0 END, 0), 1) AS DOUBLE), 4) AS confidence,
round((CAST(series_name_hint IS NOT NULL AS INTEGER) + CAST(isbn13 IS NOT NULL AS INTEGER) + CAST(published_date IS NOT NULL AS INTEGER) + CAST(series_number_hint IS NOT NULL AS INTEGER) + 2) / 7.0, 4) AS completeness FROM grouped)"""
# what fit_for_series comes to on the views
_BAD = f"({duck.has(duck.normalized('title'), r'untitled|box set|[0-9]+ books?( |$)')})"
_TNORM, _TGT = duck.branding("title"), duck.branding("target")


def fused(v) -> DataFrame:
    return entity.fused(v.hits, v.series)


def slim(df: DataFrame) -> DataFrame:
    return df.select("series_id", "key", "title", "author", "isbn13", "published_date", "series_name_hint", "series_number_hint", F.array_join("sources", ",").alias("sources"), "n_hits", "confidence", "completeness")


_SLIM = "series_id, key, title, author, isbn13, published_date, series_name_hint, series_number_hint, array_to_string(sources, ',') AS sources, n_hits, confidence, CAST(completeness AS DOUBLE) AS completeness"
register("D4_fused_candidates", lambda v: slim(fused(v)), f"WITH {FUSED} SELECT {_SLIM} FROM fused")
register("D4a_confidence", lambda v: fused(v).groupBy("confidence").agg(F.count(F.lit(1)).alias("n")), f"WITH {FUSED} SELECT confidence, count(*) AS n FROM fused GROUP BY confidence")
register("D4b_completeness", lambda v: fused(v).groupBy("completeness").agg(F.count(F.lit(1)).alias("n")), f"WITH {FUSED} SELECT CAST(completeness AS DOUBLE) AS completeness, count(*) AS n FROM fused GROUP BY completeness")
_FIT = f"author_match AND NOT {_BAD} AND language IN ('', 'en') AND NOT ({_TNORM} = {_TGT} AND isbn13 IS NULL AND series_number_hint IS NULL)"
register("D6_filtered_candidates", lambda v: entity.filtered(fused(v), v.books.where(active()).select("series_id", t.core_title_key(F.col("title")).alias("title_key")).where("series_id is not null").distinct()).select("series_id", "key", "title"),
         f"WITH {FUSED} SELECT series_id, key, title FROM fused f WHERE {_FIT} AND NOT EXISTS (SELECT 1 FROM books b WHERE b.series_id = f.series_id AND {BLIVE} AND {duck.core_key('b.title')} = {duck.core_key('f.title')})")


def _MEANS(x: str) -> str:
    """The numbers that candidates of x tell, with the highest owned one, and the means of each series."""
    return f"""{x}_owned AS (SELECT series_id, max(CASE WHEN NOT is_missing THEN floor(book_number) END) AS top FROM books WHERE {LIVE} AND series_id IS NOT NULL GROUP BY series_id),
{x}_nums AS (SELECT series_id, n FROM (SELECT series_id, coalesce(nullif(series_number_hint, 0), {duck.inferred('title')}) AS n FROM {x}) WHERE n = floor(n) UNION SELECT series_id, top FROM {x}_owned WHERE top > 0 AND series_id IN (SELECT series_id FROM {x})),
{x}_share AS (SELECT series_id, count(*) / max(n) AS share FROM {x}_nums GROUP BY series_id),
{x}_means AS (SELECT series_id, coalesce(any_value(share), 1.0) AS completeness, avg(confidence) AS mean_confidence FROM {x} LEFT JOIN {x}_share USING (series_id) GROUP BY series_id)"""


_ROUNDED = "series_id, round(completeness, 6) AS completeness, round(mean_confidence + 1e-9, 3) AS mean_confidence"
register("D7a_fallback_gate", lambda v: entity.gate(fused(v), v.books), f"WITH {FUSED}, {_MEANS('fused')} SELECT {_ROUNDED}, completeness < 0.5 OR mean_confidence < 0.35 AS fallback FROM fused_means")
register("A21_completeness", lambda v: entity.gate(fused(v), v.books).drop("fallback"), f"WITH {FUSED}, {_MEANS('fused')} SELECT {_ROUNDED} FROM fused_means")
register("D7b_other_series", lambda v: entity.of_other_series(fused(v)).select("series_id", "key", "series_name_hint"), f"WITH {FUSED} SELECT series_id, key, series_name_hint FROM fused WHERE series_name_hint <> target")


#: The rule of editions over any fused candidates: `x` names the table.
def _EDITIONS(x: str) -> str:
    low = f"lower({duck.text('title')})"
    rank = f"CASE WHEN {duck.has(low, 'audible|audio ?cd|audiobook')} THEN 2 WHEN {duck.has(low, 'kindle')} THEN 3 WHEN {duck.has(low, 'paperback')} THEN 4 WHEN {duck.has(low, 'hardcover')} THEN 5 ELSE 1 END"
    return f"""{x}_rows AS (SELECT *, coalesce(nullif({duck.title('title')}, ''), key) AS book, {rank} AS edition_rank FROM {x}),
{x}_numbers AS (SELECT series_id, book, count(DISTINCT series_number_hint) AS numbers FROM {x}_rows GROUP BY ALL),
{x}_banded AS (SELECT r.*, CASE WHEN numbers > 1 THEN coalesce(series_number_hint, -1) ELSE -1 END AS grp FROM {x}_rows r JOIN {x}_numbers USING (series_id, book)),
{x}_best AS (SELECT series_id, book, grp, max(edition_rank) AS e, max(completeness) AS m, max(confidence) AS c FROM {x}_banded GROUP BY ALL),
{x}_tops AS (SELECT g.*, edition_rank = e AND g.completeness = m AND g.confidence = c AS top FROM {x}_banded g JOIN {x}_best USING (series_id, book, grp)),
{x}_count AS (SELECT series_id, book, grp, count(*) AS members, count(*) FILTER (top) AS tops FROM {x}_tops GROUP BY ALL),
{x}_kept AS (SELECT t.* FROM {x}_tops t JOIN {x}_count USING (series_id, book, grp) WHERE members = 1 OR tops <> 1 OR top)"""


def _fused_from(hits: str, name: str) -> str:
    """The fusion of some hits, its tables under names of their own."""
    out = FUSED.replace("FROM candidate_hits h", f"FROM {hits} h")
    for table in ("scored", "grouped", "fused"):
        out = out.replace(f"{table} AS (", f"{name}_{table} AS (").replace(f"FROM {table}", f"FROM {name}_{table}")
    return out.replace(f"{name}_fused AS", f"{name} AS")


_D7 = f"""t_hits AS (SELECT * FROM candidate_hits WHERE source IN ('hardcover', 'google_books')), {_fused_from('t_hits', 'tar')}, {_EDITIONS('tar')},
{_MEANS('tar')}, wide AS (SELECT series_id FROM tar_means WHERE completeness >= 0.5 AND mean_confidence >= 0.35),
f_all AS (SELECT h.*, coalesce(h.series_name_hint <> s.name, false) AS other FROM candidate_hits h JOIN series s USING (series_id) WHERE source NOT IN ('hardcover', 'google_books') AND series_id NOT IN (SELECT series_id FROM wide)),
f_hits AS (SELECT * EXCLUDE (other) FROM f_all WHERE NOT other), {_fused_from('f_hits', 'fal')}, {_EDITIONS('fal')},
t_fit AS (SELECT *, 'targeted' AS tier FROM tar_kept WHERE {_FIT}), f_fit AS (SELECT *, 'author_fallback' AS tier FROM fal_kept WHERE {_FIT} AND (series_id, {duck.core_key('title')}) NOT IN (SELECT (series_id, {duck.core_key('title')}) FROM t_fit)),
both_passes AS (SELECT * FROM t_fit UNION ALL SELECT * FROM f_fit)"""
_BEST_SOURCE = "list_min(list_transform(sources, lambda x: CASE x WHEN 'hardcover' THEN 0 WHEN 'google_books' THEN 1 WHEN 'openlibrary' THEN 2 ELSE 3 END))"
register("D7_discovered", lambda v: entity.discovered(v.hits, v.series, v.books), f"WITH {_D7} SELECT series_id, key, title, series_number_hint, confidence, tier, CAST(row_number() OVER (PARTITION BY series_id ORDER BY series_number_hint NULLS LAST, {duck.normalized('title')}, {_BEST_SOURCE}, tier, key) AS INTEGER) AS place FROM both_passes")


def pass_counts(v) -> DataFrame:
    """Discovery run once, its rows thrown away, and what it told on the way."""
    passes = Passes()
    entity.discovered(v.hits, v.series, v.books, passes=passes).write.format("noop").mode("overwrite").save()
    return passes.rollup(v.spark)


register(
    "A28_rollup_by_pass", pass_counts,
    f"""WITH {_D7}, told AS (SELECT 'targeted' AS pass, 'hits' AS metric, count(*) AS value FROM t_hits UNION ALL SELECT 'targeted', 'candidates', count(*) FROM tar UNION ALL SELECT 'targeted', 'kept', count(*) FROM t_fit
UNION ALL SELECT 'author_fallback', 'hits', count(*) FROM f_all UNION ALL SELECT 'author_fallback', 'of_other_series', count(*) FROM f_all WHERE other UNION ALL SELECT 'author_fallback', 'candidates', count(*) FROM fal UNION ALL SELECT 'author_fallback', 'kept', count(*) FROM f_fit)
SELECT * FROM told UNION ALL SELECT 'total', metric, CAST(sum(value) AS BIGINT) FROM told GROUP BY metric""",
)
register("D7c_discovered_by_author", lambda v: entity.filtered(fused(v)).where("author_match").groupBy("target_author", t.bare_title_key(F.col("title")).alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence")))
_RATIO = "avg(CAST(n_numbers > 1 OR n_isbns > 1 OR n_names > 1 AS DOUBLE))"
register(
    "A22_reconciliation_means", lambda v: entity.reconciliation_needs(fused(v), v.hits),
    f"""WITH {FUSED}, told AS (SELECT series_id, key, count(DISTINCT round(series_number_hint, 2)) AS n_numbers, count(DISTINCT isbn13) AS n_isbns FROM scored GROUP BY ALL),
rows AS (SELECT f.*, n_numbers, n_isbns, coalesce(nullif(series_number_hint, 0), {duck.inferred('title')}, CASE WHEN {duck.get(duck.normalized('title'), '^customer [0-9]+ ([0-9]+)')} IS NOT NULL THEN 0 END) AS n FROM fused f JOIN told USING (series_id, key)),
means AS (SELECT series_id, count(*) AS candidates, count(DISTINCT CASE WHEN n = floor(n) THEN n END) / max(CASE WHEN n = floor(n) THEN n END) AS share, {_RATIO} AS ratio, avg(completeness) AS mean FROM rows GROUP BY series_id)
SELECT series_id, candidates, round(share, 6) AS series_completeness, round(ratio, 6) AS disagreement_ratio, round(mean + 1e-9, 3) AS mean_completeness, candidates >= 2 AND (coalesce(share < 0.8, false) OR ratio > 0.2 OR mean < 0.5) AS needs FROM means""",
)

register("D5_editions_collapsed", lambda v: entity.editions_collapsed(fused(v)).select("series_id", "key", "title", F.col("edition").cast("int").alias("edition"), "confidence"), f"WITH {FUSED}, {_EDITIONS('fused')} SELECT series_id, key, title, edition_rank AS edition, confidence FROM fused_kept")
register("W7_dominant_editions", lambda v: entity.editions_collapsed(fused(v)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), f"WITH {FUSED}, {_EDITIONS('fused')} SELECT series_id, count(*) AS n FROM fused_kept GROUP BY series_id")

# what is owned
_SBK = lambda s, n: f"CASE WHEN {duck.series(s)} <> '' AND ({duck.positive(n)}) IS NOT NULL THEN {duck.series(s)} || '|' || {duck.number_text(n)} END"
_OWNED = f"""own AS (SELECT b.profile_id, b.isbn13, nullif({duck.title('b.title')}, '') AS tk, {_SBK('s.name', 'b.book_number')} AS nk, {duck.bare_key('b.title')} AS bare FROM books b LEFT JOIN series s ON s.series_id = b.series_id WHERE {BLIVE}),
uniq AS (SELECT profile_id, bare FROM own GROUP BY ALL HAVING count(*) = 1),
h AS (SELECT h.hit_pos, s.profile_id, h.isbn13, nullif({duck.title('h.title')}, '') AS tk, {_SBK('s.name', 'h.series_number_hint')} AS nk, {duck.bare_key('h.title')} AS bare, h.series_number_hint IS NULL AS free FROM candidate_hits h JOIN series s ON s.series_id = h.series_id),
flags AS (SELECT hit_pos, coalesce((profile_id, isbn13) IN (SELECT (profile_id, isbn13) FROM own WHERE isbn13 IS NOT NULL), false) AS by_isbn, coalesce((profile_id, tk) IN (SELECT (profile_id, tk) FROM own WHERE tk IS NOT NULL), false) AS by_title,
nk IS NOT NULL AND coalesce((profile_id, nk) IN (SELECT (profile_id, nk) FROM own WHERE nk IS NOT NULL), false) AS by_number, free AND (profile_id, bare) IN (SELECT (profile_id, bare) FROM uniq) AS by_bare_title FROM h)"""
register("J6_owned_flags", lambda v: entity.owned_flags(v.hits, v.books, v.series), f"WITH {_OWNED} SELECT *, by_isbn OR by_title OR by_number OR by_bare_title AS owned FROM flags")
register("J7_not_in_author_titles", lambda v: v.hits.select("hit_pos", "author", t.title_key(F.col("title")).alias("title_key")).join(v.books.where(active()).select("author", t.title_key(F.col("title")).alias("title_key")).where("title_key is not null").distinct(), ["author", "title_key"], "left_anti").select("hit_pos"),
         f"SELECT hit_pos FROM candidate_hits h WHERE NOT EXISTS (SELECT 1 FROM books b WHERE {BLIVE} AND b.author = h.author AND {duck.title('b.title')} = {duck.title('h.title')} AND {duck.title('b.title')} <> '')")
_MATCH = f"""b AS (SELECT b.series_id, b.book_id, b.isbn13, {_SBK('s.name', 'b.book_number')} AS nk, nullif({duck.title('b.title')}, '') AS tk FROM books b JOIN series s ON s.series_id = b.series_id WHERE {BLIVE}),
b1 AS (SELECT series_id, isbn13, min(book_id) AS book_id FROM b WHERE isbn13 IS NOT NULL GROUP BY ALL), b2 AS (SELECT series_id, nk, min(book_id) AS book_id FROM b WHERE nk IS NOT NULL GROUP BY ALL), b3 AS (SELECT series_id, tk, min(book_id) AS book_id FROM b WHERE tk IS NOT NULL GROUP BY ALL),
hh AS (SELECT h.hit_pos, h.title, h.series_id, h.isbn13, {_SBK('s.name', 'h.series_number_hint')} AS nk, nullif({duck.title('h.title')}, '') AS tk FROM candidate_hits h JOIN series s ON s.series_id = h.series_id)"""
register("J8_prioritised_match", lambda v: entity.matched(v.hits, v.books, v.series).select("hit_pos", "title", "book_id", "reason"),
         f"WITH {_MATCH} SELECT hit_pos, title, coalesce(b1.book_id, b2.book_id, b3.book_id) AS book_id, CASE WHEN b1.book_id IS NOT NULL THEN 'identifier' WHEN b2.book_id IS NOT NULL THEN 'series_number' WHEN b3.book_id IS NOT NULL THEN 'title' END AS reason FROM hh LEFT JOIN b1 ON b1.series_id = hh.series_id AND b1.isbn13 = hh.isbn13 LEFT JOIN b2 ON b2.series_id = hh.series_id AND b2.nk = hh.nk LEFT JOIN b3 ON b3.series_id = hh.series_id AND b3.tk = hh.tk")
register("J12_tracked_series", lambda v: v.hits.where("series_name_hint is not null").select("hit_pos", "series_id", t.branding_name(F.col("series_name_hint")).alias("brand")).join(v.series.groupBy(t.branding_name(F.col("name")).alias("brand")).agg(F.max("series_id").alias("tracked")), "brand", "left").select("hit_pos", "tracked"),
         f"SELECT h.hit_pos, s.tracked FROM candidate_hits h LEFT JOIN (SELECT {duck.branding('name')} AS brand, max(series_id) AS tracked FROM series GROUP BY brand) s ON s.brand = {duck.branding('h.series_name_hint')} WHERE h.series_name_hint IS NOT NULL")
_DF = duck.flexible_date("published_date")
register("J15_dates_backfilled", lambda v: entity.dates_backfilled(v.hits),
         f"WITH dated AS (SELECT * FROM candidate_hits WHERE source = 'hardcover' AND {_DF} IS NOT NULL), d1 AS (SELECT series_id, isbn13, arg_min(published_date, (hit_pos, published_date)) AS x FROM dated WHERE isbn13 IS NOT NULL GROUP BY ALL), d2 AS (SELECT series_id, author, {duck.title('title')} AS tk, arg_min(published_date, (hit_pos, published_date)) AS x FROM dated GROUP BY ALL) SELECT h.hit_pos, h.title, coalesce(d1.x, d2.x) AS published_date FROM candidate_hits h LEFT JOIN d1 ON d1.series_id = h.series_id AND d1.isbn13 = h.isbn13 LEFT JOIN d2 ON d2.series_id = h.series_id AND d2.author = h.author AND d2.tk = {duck.title('h.title')} AND d2.tk <> '' WHERE h.published_date = '' AND coalesce(d1.x, d2.x) IS NOT NULL")
register("J16_hints_enriched", lambda v: entity.hints_enriched(v.hits),
         f"SELECT h.hit_pos, h.title, n.hint AS series_name_hint FROM candidate_hits h JOIN (SELECT author, {duck.bare_key('title')} AS bare, min(series_name_hint) AS hint FROM candidate_hits WHERE series_name_hint IS NOT NULL GROUP BY ALL HAVING count(DISTINCT series_name_hint) = 1) n ON n.author = h.author AND n.bare = {duck.bare_key('h.title')} WHERE h.series_name_hint IS NULL")
register(
    "A39_author_index",
    lambda v: entity.author_identities(v.books, v.series),
    f"""WITH live AS (SELECT profile_id, {duck.author('author')} AS author, series_id, isbn13, title, book_number FROM books WHERE {LIVE} AND {duck.author('author')} <> ''),
held AS (SELECT profile_id, author, 'isbn' AS kind, isbn13 AS key, CAST(NULL AS BIGINT) AS series_id FROM live UNION ALL SELECT profile_id, author, 'title', nullif({duck.core_key('title')}, ''), NULL FROM live
UNION ALL SELECT profile_id, author, 'number', CASE WHEN series_id IS NOT NULL AND book_number IS NOT NULL THEN {duck.number_text('book_number')} END, series_id FROM live),
bare AS (SELECT profile_id, author, nullif({duck.bare_key('title')}, '') AS key FROM live GROUP BY ALL HAVING count(*) = 1)
SELECT DISTINCT * FROM held WHERE key IS NOT NULL UNION ALL SELECT profile_id, author, 'bare', key, NULL FROM bare WHERE key IS NOT NULL
UNION ALL SELECT profile_id, {duck.author('author')}, 'tracked', {duck.branding('name')}, max(series_id) FROM series WHERE {duck.author('author')} <> '' GROUP BY ALL""",
)
register("W14_missing_slots", lambda v: entity.missing_slots(v.books, v.hits).select("series_id", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots")),
         f"WITH want AS (SELECT series_id, max(series_total_hint) AS total FROM candidate_hits GROUP BY series_id HAVING total IS NOT NULL), slot AS (SELECT series_id, CAST(unnest(range(1, total + 1)) AS INTEGER) AS n FROM want), lack AS (SELECT * FROM slot EXCEPT SELECT series_id, CAST(floor(book_number) AS INTEGER) FROM books WHERE {LIVE} AND book_number > 0 EXCEPT SELECT series_id, CAST(floor(series_number_hint) AS INTEGER) FROM candidate_hits WHERE series_number_hint > 0), few AS (SELECT * FROM lack QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n) <= 6) SELECT series_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS slots FROM few GROUP BY series_id")
register("D18_worth_checking", lambda v: entity.worth_checking(v.hits, v.books, v.series, intelligence.series_intelligence(v.books, v.series)),
         f"WITH {KNOWN}, owned AS (SELECT series_id, max(book_number) AS top FROM books WHERE {LIVE} GROUP BY series_id), far AS (SELECT series_id, max(n) AS gap FROM lacking GROUP BY series_id) SELECT h.series_id, bool_or(coalesce(h.series_number_hint > coalesce(greatest(c.top, CAST(far.gap AS DOUBLE)), 0), false) AND {_AM}) AS worth FROM candidate_hits h JOIN series s ON s.series_id = h.series_id LEFT JOIN owned c ON c.series_id = h.series_id LEFT JOIN far ON far.series_id = h.series_id GROUP BY h.series_id")

# delta and grades
_SK = f"sk AS (SELECT series_id, book_number AS n, arg_max(title, book_id) AS known_title FROM books WHERE {LIVE} AND series_id IS NOT NULL AND book_number IS NOT NULL GROUP BY ALL)"
_VARIANT = f"(isbn13 IS NULL AND {_TNORM} = {_TGT} AND NOT coalesce(series_number_hint = 1, false))"
_DELTA = f"""reasoned AS (SELECT *, CASE WHEN {duck.has(duck.normalized('title'), 'untitled')} THEN 'placeholder_title' WHEN {_VARIANT} THEN 'title_is_series_variant' WHEN series_number_hint <= 0 THEN 'negative_number' WHEN completeness < 0.5 THEN 'insufficient_metadata' END AS reason FROM fused),
twice AS (SELECT series_id, series_number_hint FROM reasoned WHERE reason IS NULL AND series_number_hint IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
{_SK}, delta AS (SELECT r.*, sk.known_title, CASE WHEN r.reason IS NOT NULL THEN r.reason WHEN t.series_id IS NOT NULL THEN 'duplicate_number' ELSE '' END AS reasons, r.reason IS NULL AND sk.n IS NULL AS missing FROM reasoned r LEFT JOIN twice t ON t.series_id = r.series_id AND t.series_number_hint = r.series_number_hint LEFT JOIN sk ON sk.series_id = r.series_id AND sk.n = r.series_number_hint)"""


def skeleton(v) -> DataFrame:
    return v.books.where(active() & F.col("series_id").isNotNull() & F.col("book_number").isNotNull()).select("series_id", "book_number", "title", F.col("book_id").alias("ord"))


register("D9_series_delta", lambda v: grading.delta(fused(v), skeleton(v)).select("series_id", "key", F.array_join("reasons", ",").alias("reasons"), "missing"), f"WITH {FUSED}, {_DELTA} SELECT series_id, key, reasons, missing FROM delta")
register("D9_numbering_gaps", lambda v: grading.numbering_gaps(fused(v), skeleton(v)), f"WITH {FUSED}, {_DELTA} SELECT series_id, n AS book_number FROM sk EXCEPT SELECT series_id, series_number_hint FROM reasoned WHERE reason IS NULL")
_PG = "CASE WHEN list_contains(sources, 'hardcover') THEN 'high' WHEN list_contains(sources, 'google_books') THEN 'medium' ELSE 'low' END"
_TG = f"CASE WHEN reasons IN ('placeholder_title', 'title_is_series_variant') OR {_VARIANT} THEN 'zero' WHEN known_title IS NULL THEN 'unverified' WHEN {duck.normalized('title')} = {duck.normalized('known_title')} THEN 'high' WHEN {duck.core_key('title')} = {duck.core_key('known_title')} THEN 'medium' ELSE 'low' END"
_NG = "CASE WHEN reasons IN ('negative_number', 'duplicate_number') OR series_number_hint IS NULL OR series_number_hint <= 0 THEN 'low' WHEN known_title IS NOT NULL THEN 'high' ELSE 'medium' END"
for key, column, sql in (("D10a_provider_grade", "provider_grade", _PG), ("D10b_title_grade", "title_grade", _TG), ("D10c_number_grade", "number_grade", _NG)):
    register(key, lambda v, column=column: grading.graded(fused(v), skeleton(v)).select("series_id", "key", F.col(column).alias("grade")), f"WITH {FUSED}, {_DELTA} SELECT series_id, key, {sql} AS grade FROM delta")
_GRADES = f"""grades AS (SELECT series_id, key, {_PG} AS provider_grade, {_TG} AS title_grade, {_NG} AS number_grade, {duck.alignment('author', 'target_author')} AS alignment_grade FROM delta),
overall AS (SELECT *, [provider_grade, title_grade, number_grade, alignment_grade] AS g FROM grades)"""
_OVERALL = "CASE WHEN list_contains(g, 'zero') THEN 'zero' WHEN len(list_filter(g, lambda x: x <> 'high')) = 0 THEN 'high' WHEN len(list_filter(g, lambda x: x NOT IN ('high', 'medium', 'unverified'))) = 0 THEN 'medium' ELSE 'low' END"
register("D10_graded", lambda v: grading.graded(fused(v), skeleton(v)).select("series_id", "key", "provider_grade", "title_grade", "number_grade", "alignment_grade", "overall"), f"WITH {FUSED}, {_DELTA}, {_GRADES} SELECT * EXCLUDE (g), {_OVERALL} AS overall FROM overall")
register("D10d_overall", lambda v: grading.graded(fused(v), skeleton(v)).groupBy("overall").agg(F.count(F.lit(1)).alias("n")), f"WITH {FUSED}, {_DELTA}, {_GRADES} SELECT {_OVERALL} AS overall, count(*) AS n FROM overall GROUP BY ALL")
register("J10_reasons_by_key", lambda v: (lambda g: v.hits.select("hit_pos", "series_id", F.lower(F.trim("title")).alias("lt"), "isbn13", F.col("series_number_hint").alias("n")).alias("h").join(
    g.groupBy("series_id", F.lower(F.trim("title")).alias("lt"), "isbn13", F.col("series_number_hint").alias("n")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ",").alias("reasons")).alias("g"),
    (F.col("h.series_id") == F.col("g.series_id")) & (F.col("h.lt") == F.col("g.lt")) & F.col("h.isbn13").eqNullSafe(F.col("g.isbn13")) & F.col("h.n").eqNullSafe(F.col("g.n")), "left").select("h.hit_pos", F.coalesce("g.reasons", F.lit("")).alias("reasons")))(grading.delta(fused(v), skeleton(v))),
    f"WITH {FUSED}, {_DELTA}, g AS (SELECT series_id, lower(trim(title)) AS lt, isbn13, series_number_hint AS n, string_agg(DISTINCT nullif(reasons, ''), ',' ORDER BY nullif(reasons, '')) AS reasons FROM delta GROUP BY ALL) SELECT h.hit_pos, coalesce(g.reasons, '') AS reasons FROM candidate_hits h LEFT JOIN g ON g.series_id = h.series_id AND g.lt = lower(trim(h.title)) AND g.isbn13 IS NOT DISTINCT FROM h.isbn13 AND g.n IS NOT DISTINCT FROM h.series_number_hint")


def grades_of_hits(v) -> DataFrame:
    """The grades of the candidate with a hit's title, ISBN and number; of several the last one counts."""
    names = ("provider_grade", "title_grade", "number_grade")
    same = lambda n: [F.lower(F.trim("title")).alias("lt"), "isbn13", F.col("series_number_hint").alias(n)]
    g = grading.graded(fused(v), skeleton(v)).groupBy("series_id", *same("n")).agg(F.max_by(F.struct(*names), "key").alias("last")).alias("g")
    h = v.hits.select("hit_pos", "series_id", *same("n")).alias("h")
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("series_id", "lt", "isbn13", "n")]
    return h.join(g, on, "left").select("h.hit_pos", *(F.col(f"g.last.{c}").alias(c) for c in names))


register("J11_grades_by_key", grades_of_hits,
         f"WITH {FUSED}, {_DELTA}, g AS (SELECT series_id, lower(trim(title)) AS lt, isbn13, series_number_hint AS n, arg_max({_PG}, key) AS provider_grade, arg_max({_TG}, key) AS title_grade, arg_max({_NG}, key) AS number_grade FROM delta GROUP BY ALL) SELECT h.hit_pos, provider_grade, title_grade, number_grade FROM candidate_hits h LEFT JOIN g ON g.series_id = h.series_id AND g.lt = lower(trim(h.title)) AND g.isbn13 IS NOT DISTINCT FROM h.isbn13 AND g.n IS NOT DISTINCT FROM h.series_number_hint")

# find and bind
_FIND = f"""few AS (SELECT * FROM candidate_hits QUALIFY row_number() OVER (PARTITION BY series_id, source ORDER BY hit_pos, title, isbn13 NULLS FIRST) <= 3), keyed AS (SELECT *, coalesce('isbn:' || isbn13, 'title:' || {duck.core_key('title')}) AS key FROM few),
latest AS (SELECT series_id, key, source, arg_max(title, (hit_pos, title)) AS title, arg_max(author, (hit_pos, title)) AS author, max(isbn13) AS isbn13, min(hit_pos) AS first FROM keyed GROUP BY ALL),
grp AS (SELECT series_id, key, arg_min(title, {_RANK}) AS title, max(isbn13) AS isbn13, list(DISTINCT author) AS authors, count(*) AS n, min(first) AS first FROM latest GROUP BY series_id, key),
sig AS (SELECT b.book_id, g.*, list_contains(g.authors, b.author) OR len(list_filter(g.authors, lambda a: starts_with(a, b.author))) > 0 AS author_match, g.isbn13 IS NOT NULL AS isbn_present, {duck.title('g.title')} <> '' AND {duck.title('g.title')} IN ({duck.title('b.title')}, {duck.title(duck.core('b.title'))}) AS strong_title_match FROM books b JOIN grp g ON g.series_id = b.series_id),
ranked AS (SELECT *, greatest(CAST(author_match AS INTEGER) + CAST(isbn_present AS INTEGER) + CAST(strong_title_match AS INTEGER), 1) AS tier FROM sig), found AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY tier DESC, n DESC, first, key) AS rank, CASE tier WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM ranked)"""
for key in ("D2_find", "O8_find_order"):
    register(key, lambda v: entity.find(v.books, v.hits).select("book_id", F.col("rank").cast("bigint").alias("rank"), "key", "title", "confidence"), f"WITH {_FIND} SELECT book_id, rank, key, title, confidence FROM found WHERE rank <= 6")
register("D3_find_signals", lambda v: entity.find(v.books, v.hits).groupBy("author_match", "isbn_present", "strong_title_match", "confidence").agg(F.count(F.lit(1)).alias("n")), f"WITH {_FIND} SELECT author_match, isbn_present, strong_title_match, confidence, count(*) AS n FROM found WHERE rank <= 6 GROUP BY ALL")
register("J19_bound", lambda v: entity.bound(v.books, entity.find(v.books, v.hits)),
         f"WITH {_FIND} SELECT b.book_id, CASE WHEN f.tier > 1 THEN coalesce(b.isbn13, f.isbn13) ELSE b.isbn13 END AS isbn13, CASE WHEN f.tier > 1 THEN f.title END AS canonical_title, CASE WHEN f.tier > 1 THEN 'provider' ELSE b.metadata_source END AS metadata_source, coalesce(f.tier > 1, false) AS resolved FROM books b LEFT JOIN found f ON f.book_id = b.book_id AND f.rank = 1")


def batch(v) -> DataFrame:
    """The first 200 of each profile's queue: what one run resolves again."""
    return lists.numbered(queue(v), [F.col("book_id")], 200, ("profile_id",))


def outcomes(v) -> DataFrame:
    few = batch(v)
    return entity.reresolved(few, entity.find(few, v.hits))


_QUEUED = f"queued AS (SELECT * FROM books WHERE {QUEUE}), batch AS (SELECT * FROM queued QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY book_id) <= 200)"
_OUTCOMES = f"""{_QUEUED}, {_FIND.replace('FROM books b JOIN grp', 'FROM batch b JOIN grp')}, best AS (SELECT book_id AS id, title AS found_title, isbn13 AS found_isbn, confidence FROM found WHERE rank = 1),
outcomes AS (SELECT b.book_id, b.profile_id, CASE WHEN confidence IS NULL THEN 'no_match' ELSE 'updated' END AS outcome, confidence, found_title AS canonical_title, CASE WHEN confidence IS NULL THEN metadata_source ELSE 'provider' END AS metadata_source,
CASE WHEN confidence IS NULL THEN needs_reresolution ELSE confidence = 'low' END AS needs_reresolution, coalesce(isbn13, found_isbn) AS isbn13 FROM batch b LEFT JOIN best ON best.id = b.book_id)"""
register("D14_reresolution_batch", outcomes, f"WITH {_OUTCOMES} SELECT * FROM outcomes")
register(
    "A30_reresolution_outcomes",
    lambda v: outcomes(v).groupBy("profile_id").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(F.col("outcome") == "no_match").alias("no_match"), F.count_if(F.col("confidence") == "low").alias("still_queued")),
    f"WITH {_OUTCOMES} SELECT profile_id, count(*) AS processed, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'no_match') AS no_match, count(*) FILTER (confidence = 'low') AS still_queued FROM outcomes GROUP BY profile_id",
)

# persistence
def events(v, states: bool = True) -> DataFrame:
    return persist.merged(v.hits, v.books, v.series, AS_OF, states)


def _collapse(v, key, **how) -> DataFrame:
    groups = persist.collapsed(persist.number_key(v.books, v.series), key, **how)
    return groups.select("series_id", "key", F.col("kept.book_id").alias("kept"), (F.size("members") - 1).alias("n_removed"), F.col("kept.is_read").alias("is_read"))


register("D8_persist_actions", lambda v: persist.actions(events(v, states=False)).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n")))
register("K18_upserted", lambda v: persist.written(events(v)).select("book_id", "title", "book_number", "publication_date", "release_date", "edition", "read_status", "record_status"))
register("D8_updated_books", lambda v: persist.job(v.hits, v.books, v.series, AS_OF))
register("W9_batch_duplicates", lambda v: persist.actions(events(v, states=False)).where("action = 'skip'").select("hit_pos", "title"))
register("A38_job_delta", lambda v: persist.job_delta(events(v, states=False)))
register("W5_identity_collapse", lambda v: _collapse(v, persist.identity_key()))
register("W6_number_collapse", lambda v: _collapse(v, F.col("number_key"), by_identifier=True))


# the sweep over what P8 lets through; a few series stand for those that somebody checks at the moment
def sweep(v) -> DataFrame:
    return lists.swept(eligible(v), v.profiles, v.series.where("series_id % 23 = 0"), persist.job_delta(events(v, states=False)), AS_OF)


register("D15_sweep", sweep)
register("A37_sweep_totals", lambda v: lists.sweep_totals(sweep(v)))
register("W6_number_groups", lambda v: persist.collapsed(v.books, t.positive_number(F.col("book_number")), by_identifier=True).select("series_id", F.col("key").alias("book_number"), (F.size("members") - 1).cast("bigint").alias("n_removed")), f"SELECT series_id, book_number, count(*) - 1 AS n_removed FROM books WHERE {LIVE} AND series_id IS NOT NULL AND book_number > 0 GROUP BY ALL HAVING count(*) > 1")

# titles across a series
_VOTE = lambda v: v.books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg((F.count_if(w.has_series_suffix(F.col("title"))) >= F.count_if(~w.has_series_suffix(F.col("title")))).alias("with_suffix"))


def retitled(v, mode: str) -> DataFrame:
    rows = v.books.where(active()).join(v.series.select("series_id", F.col("name").alias("series_name")), "series_id").join(_VOTE(v), "series_id")
    skip = (d.status(F.col("read_status")) == "upcoming") | F.col("book_number").isNull()
    new = F.when(skip, F.col("title")).otherwise(w.for_mode(F.col("title"), F.lit(mode), F.col("series_name"), F.col("book_number"), F.col("with_suffix")))
    return rows.select("book_id", "series_id", F.col("title").alias("old"), new.alias("title"), skip.alias("skipped"))


register("F57_title_modes", lambda v: retitled(v, "match_other_titles").select("book_id", "title"))
register("F60_titles_normalised", lambda v: retitled(v, "new_clean_title").select("book_id", "title", "skipped"))
register("D16_series_titles", lambda v: retitled(v, "clean_up").where("not skipped and old <> title").select("book_id", "series_id", "old", "title"))
register("A31_title_diagnostics", lambda v: retitled(v, "clean_up").groupBy("series_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped") & (F.col("old") != F.col("title"))).alias("updated"), F.count_if(~F.col("skipped") & (F.col("old") == F.col("title"))).alias("unchanged")))

# drops, unions, affected sets
_DROPS = lambda v: v.hits.withColumn("reason", F.when(t.is_placeholder_title(F.col("title")), "filter:placeholder").when(t.is_not_new_release(F.col("title")), "filter:not_new").when(~t.is_english_or_unknown(F.col("language")), "filter:language"))
_DS = f"SELECT *, CASE WHEN {duck.has(duck.normalized('title'), 'untitled')} THEN 'filter:placeholder' WHEN {duck.has(duck.normalized('title'), r'box set|[0-9]+ books?( |$)')} THEN 'filter:not_new' WHEN language = 'fr' THEN 'filter:language' END AS reason FROM candidate_hits"
register("A27_drop_reasons", lambda v: _DROPS(v).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), f"SELECT reason, count(*) AS n FROM ({_DS}) WHERE reason IS NOT NULL GROUP BY reason")
register("L10_drop_list", lambda v: _DROPS(v).where("reason is not null").select(F.struct("title", F.col("hit_pos").alias("id")).alias("identity"), "reason").select(F.col("identity.id").alias("hit_pos"), F.col("identity.title").alias("title"), "reason"), f"SELECT hit_pos, title, reason FROM ({_DS}) WHERE reason IS NOT NULL")
register("U4_targeted_and_fallback", lambda v: (lambda a, b: a.unionByName(b.join(a.select("series_id", "tk").distinct(), ["series_id", "tk"], "left_anti")))(*(v.hits.where(c).select("hit_pos", "series_id", t.core_title_key(F.col("title")).alias("tk")) for c in ("source = 'hardcover'", "source <> 'hardcover'"))),
         f"WITH h AS (SELECT hit_pos, series_id, source, {duck.core_key('title')} AS tk FROM candidate_hits) SELECT hit_pos, series_id, tk FROM h WHERE source = 'hardcover' UNION ALL SELECT hit_pos, series_id, tk FROM h WHERE source <> 'hardcover' AND (series_id, tk) NOT IN (SELECT (series_id, tk) FROM h WHERE source = 'hardcover')")
register("U6_shared_tokens", lambda v: v.cases.select("id", F.size(F.array_intersect(t.tokens(F.col("title")), t.tokens(F.col("series")))).alias("shared"), (F.size(F.array_except(t.tokens(F.col("series")), t.tokens(F.col("title")))) == 0).alias("subset")),
         f"SELECT id, CAST({duck.shared(duck.tokens('title'), duck.tokens('series'))} AS INTEGER) AS shared, {duck.shared(duck.tokens('title'), duck.tokens('series'))} = len({duck.tokens('series')}) AS subset FROM title_cases")
register("U7_affected_series", lambda v: v.books.select("series_id").union(v.hits.select("series_id")).where("series_id is not null").distinct(), "SELECT series_id FROM books WHERE series_id IS NOT NULL UNION SELECT series_id FROM candidate_hits WHERE series_id IS NOT NULL")
register("K17_confirmations", lambda v: v.books.withColumn("decision", F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("dont_know")), (F.col("book_id") % 3 + 1).cast("int"))).join(v.series.select("series_id", F.lit(True).alias("there")), "series_id", "left").select("book_id", F.when(F.col("decision") == "no", "left_unlinked").when(F.col("decision") == "dont_know", "kept_pending").when(F.col("series_id").isNull(), "missing_candidate_series").when(F.col("there"), "linked").otherwise("canonical_series_not_found").alias("status")),
         "SELECT b.book_id, CASE WHEN b.book_id % 3 = 1 THEN 'left_unlinked' WHEN b.book_id % 3 = 2 THEN 'kept_pending' WHEN b.series_id IS NULL THEN 'missing_candidate_series' WHEN s.series_id IS NOT NULL THEN 'linked' ELSE 'canonical_series_not_found' END AS status FROM books b LEFT JOIN series s ON s.series_id = b.series_id")


# ingest over the title cases as a sheet
def sheet(v) -> DataFrame:
    return v.cases.select(F.col("title").alias("Book Title"), F.col("author").alias("Authors"), F.col("series").alias("Series"), F.col("num").cast("string").alias("Book #"), F.col("date_text").alias("Published"), F.when(F.col("id") % 2 == 0, "Finished").otherwise("TBR").alias("Status"), F.col("id").cast("string").alias("Shelf"))


def rows_of(v) -> DataFrame:
    return ingest.typed(ingest.mapped(sheet(v))[0]).withColumn("row_number", F.col("import_raw_row")["Shelf"].cast("bigint") + ingest.FIRST_ROW - 1)


def headers(v) -> DataFrame:
    """Every distinct title, and every distinct word and pair of words of one, as somebody's header."""
    words = F.filter(F.split(t.squeeze(F.col("title")), " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws(" ", F.element_at("w", k), F.element_at("w", k + 1)))
    rows = v.cases.select("title", words.alias("w")).withColumn("pairs", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return rows.select(F.explode(F.concat("w", "pairs", F.array("title"))).alias("header")).where("header is not null").distinct()


_ALIASES = ", ".join(f"('{a}', '{field}')" for field, names in ingest.HEADERS.items() for a in names)
_HWORDS = "list_filter(regexp_split_to_array(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
register(
    "P11_header_map", lambda v: ingest.fields_of(headers(v), "header"),
    f"""WITH w AS (SELECT title, {_HWORDS} AS w FROM title_cases), h AS (SELECT unnest(w) AS header FROM w UNION SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM w UNION SELECT title FROM w WHERE title IS NOT NULL),
aliases(alias, field) AS (VALUES {_ALIASES}) SELECT header, field FROM h LEFT JOIN aliases ON alias = {duck.identity('header')}""",
)
register("P12_typed_rows", lambda v: rows_of(v).select("row_number", "publication_date", "is_read", "is_upcoming", "read_status"))
register("P13_row_errors", lambda v: rows_of(v).select("row_number", F.array_join("errors", ",").alias("errors")), f"SELECT id + 1 AS row_number, concat_ws(',', CASE WHEN {duck.filled('title')} IS NULL THEN 'missing_title' END, CASE WHEN {duck.filled('author')} IS NULL THEN 'missing_author' END) AS errors FROM title_cases")
register("P14_import_preview", lambda v: ingest.preview(rows_of(v)).select("row_number", "title"), "SELECT id + 1 AS row_number, title FROM title_cases WHERE id <= 5")
_MEAN = f"({duck.identity('series')} NOT IN ('', 'n a', 'na', 'none', 'standalone', 'tbd', 'unknown', 'n'))"
register("P15_link_reasons", lambda v: rows_of(v).select("row_number", ingest.link_reason().alias("reason")), f"SELECT id + 1 AS row_number, CASE WHEN {duck.filled('series')} IS NULL THEN 'no_series_name_provided' WHEN NOT {_MEAN} THEN 'series_name_looks_like_placeholder' ELSE 'explicit_series_name' END AS reason FROM title_cases")
register("P16_meaningful_series", lambda v: rows_of(v).select("row_number", t.is_meaningful_series(F.col("series_name"), F.col("author")).alias("value")), f"SELECT id + 1 AS row_number, {_MEAN} AS value FROM title_cases")
register("P17_series_evidence", lambda v: rows_of(v).select("row_number", ingest.has_series_evidence().alias("value")))
register("K7_good_and_bad_rows", lambda v: rows_of(v).groupBy((F.size("errors") == 0).alias("good")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {duck.filled('title')} IS NOT NULL AND {duck.filled('author')} IS NOT NULL AS good, count(*) AS n FROM title_cases GROUP BY good")
register("K8_series_of_import", lambda v: ingest.series_of_rows(rows_of(v).where("size(errors) = 0"), v.series, "p1").select("key", "name", "is_finished", "is_new"))
register("D1_import", lambda v: ingest.imported(rows_of(v), v.series, "p1")[0].select("row_number", F.trim("title").alias("title"), "author", "linked_series", "book_number", "book_number_source", "is_read"))
register("F86_book_payload", lambda v: ingest.payload(ingest.imported(rows_of(v), v.series, "p1")[0]).select("row_number", "title", "author", "linked_series", "book_number", "book_number_source", "series_order", "is_read", F.array_join("given", ",").alias("given")))


def author_entries(v) -> DataFrame:
    """Hits of an author's other books: what is owned is left out, tracked series are matched, the richest of each bare title stays."""
    rows = v.hits.join(entity.owned_flags(v.hits, v.books, v.series).groupBy("hit_pos").agg(F.bool_and("owned").alias("owned")).where("not owned").select("hit_pos"), "hit_pos")
    tracked = v.series.groupBy(t.branding_name(F.col("name")).alias("brand")).agg(F.max("series_id").alias("tracked"))
    rows = rows.withColumns({"bare": t.bare_title_key(F.col("title")), "brand": t.branding_name(F.col("series_name_hint")), "date": F.when(~d.is_placeholder_date(F.col("published_date")), F.col("published_date"))}).join(tracked, "brand", "left")
    rich = F.col("isbn13").isNotNull().cast("int") + F.col("series_number_hint").isNotNull().cast("int") + F.col("date").isNotNull().cast("int")
    nth = F.row_number().over(Window.partitionBy("author", "bare", F.coalesce("series_number_hint", F.lit(-1.0))).orderBy(rich.desc(), "hit_pos", "title"))
    return rows.withColumn("nth", nth).where("nth = 1").select("author", "bare", "title", "tracked", "series_name_hint", "series_number_hint", "date")


register("D13_author_entries", author_entries)
register("P28_series_hydration", lambda v: v.series.join(v.books.where(active()).groupBy("series_id").agg(F.count(F.lit(1)).alias("tracked")), "series_id", "left").select("series_id", F.coalesce("tracked", F.lit(0)).alias("tracked"), d.flag(F.col("has_new_books")).alias("is_new")), f"SELECT s.series_id, coalesce(c.n, 0) AS tracked, s.has_new_books AS is_new FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM books WHERE {LIVE} GROUP BY series_id) c ON c.series_id = s.series_id")
register("K4_series_columns", lambda v: v.series.select("series_id", "profile_id", "name", "author", "genre", "is_finished"), "SELECT series_id, profile_id, name, author, genre, is_finished FROM series")
