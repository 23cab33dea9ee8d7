"""Provider answers, verdict tables and what is left of the scalar rules (inventory S7-S11, J18, F47, D19-D22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksight.functions import text as t
from stacksight.operators import entity
from stacksight.plans import duck
from stacksight.plans.registry import register
from stacksight.sources import providers


def raw_of(v, source: str, body) -> DataFrame:
    return v.hits.where(F.col("source") == source).select("hit_pos", F.to_json(body()).alias("raw"))


def google(v) -> DataFrame:
    ids = lambda: F.array(F.struct(F.lit("ISBN_10").alias("type"), F.lit("0").alias("identifier")), F.struct(F.when(F.col("isbn13").isNotNull(), "ISBN_13").otherwise("OTHER").alias("type"), F.coalesce("isbn13", F.lit("x")).alias("identifier")))
    return raw_of(v, "google_books", lambda: F.struct(F.struct("title", F.when(F.col("hit_pos") % 2 == 0, "A Tale").alias("subtitle"), F.array("author").alias("authors"), F.col("published_date").alias("publishedDate"), "language", ids().alias("industryIdentifiers")).alias("volumeInfo")))


register("S7_google_hits", lambda v: providers.google_hits(google(v), "hit_pos").select("hit_pos", "title", "isbn13", "published_date", "language"), "SELECT hit_pos, title || CASE WHEN hit_pos % 2 = 0 THEN ': A Tale' ELSE '' END AS title, isbn13, published_date, language FROM candidate_hits WHERE source = 'google_books'")
register("S8_openlibrary_hits", lambda v: providers.openlibrary_hits(raw_of(v, "openlibrary", lambda: F.struct("title", F.array("author").alias("author_name"), F.year(F.lit("1998-01-01").cast("date")).alias("first_publish_year"), F.array(F.lit("123"), F.coalesce("isbn13", F.lit("9"))).alias("isbn"), F.array("language").alias("language"), F.lit("/works/1").alias("key"))), "hit_pos").select("hit_pos", "title", "isbn13", "published_date"),
         "SELECT hit_pos, title, isbn13, '1998' AS published_date FROM candidate_hits WHERE source = 'openlibrary'")
register("S9_hardcover_hits", lambda v: providers.hardcover_hits(raw_of(v, "hardcover", lambda: F.struct("title", F.array("author").alias("author_names"), F.col("published_date").alias("release_date"), F.col("upcoming_hint").alias("unreleased"), F.struct(F.col("series_name_hint").alias("name"), F.col("series_number_hint").alias("position"), F.lit(20).alias("books_count"), F.col("series_total_hint").alias("primary_books_count")).alias("series"))), "hit_pos").select("hit_pos", "series_name_hint", "series_number_hint", "series_total_hint", "upcoming_hint"),
         "SELECT hit_pos, series_name_hint, series_number_hint, coalesce(series_total_hint, 20) AS series_total_hint, upcoming_hint FROM candidate_hits WHERE source = 'hardcover'")


def web(v) -> DataFrame:
    return providers.web_hits(raw_of(v, "web_search", lambda: F.struct(F.when(F.col("hit_pos") % 5 != 0, F.col("title")).alias("title"), F.concat(F.lit("https://x/"), F.col("hit_pos").cast("string")).alias("url"))), "hit_pos")


register("S10_web_hits", lambda v: web(v).select("hit_pos", "title", "url"), "SELECT hit_pos, title, 'https://x/' || hit_pos AS url FROM candidate_hits WHERE source = 'web_search' AND hit_pos % 5 <> 0")


def verdicts(v) -> DataFrame:
    n = F.col("hit_pos")
    rows = v.hits.where("source = 'web_search'").groupBy("hit_pos").agg(F.min("title").alias("title"), F.min("author").alias("author"), F.min("published_date").alias("published_date"))
    return rows.select(F.concat(F.lit("https://x/"), n.cast("string")).alias("url"), (n % 3 != 0).alias("accepted"), "title", F.when(n % 2 == 0, F.array("author")).otherwise(F.array().cast("array<string>")).alias("authors"), (n % 7 + 0.5).alias("number"), "published_date", (n % 11 == 0).alias("is_upcoming"))


register("S11_judged_web_hits", lambda v: providers.judged_web_hits(web(v).dropDuplicates(["url"]), verdicts(v), "Target").select("url", F.get("authors", F.lit(0)).alias("author"), "series_number_hint", "upcoming_hint"),
         "SELECT 'https://x/' || hit_pos AS url, CASE WHEN hit_pos % 2 = 0 THEN min(author) ELSE 'Target' END AS author, CAST(hit_pos % 7 AS DOUBLE) AS series_number_hint, hit_pos % 11 = 0 OR min(published_date) = '' AS upcoming_hint FROM candidate_hits WHERE source = 'web_search' AND hit_pos % 5 <> 0 AND hit_pos % 3 <> 0 GROUP BY hit_pos")
register("D20_verdict_cache", lambda v: web(v).select("url").distinct().join(verdicts(v).select("url", "accepted"), "url", "left").select("url", F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected").otherwise("unknown").alias("state")),
         "SELECT DISTINCT 'https://x/' || hit_pos AS url, CASE WHEN hit_pos % 3 <> 0 THEN 'accepted' ELSE 'rejected' END AS state FROM candidate_hits WHERE source = 'web_search' AND hit_pos % 5 <> 0")
register("A29_accepted_rejected", lambda v: verdicts(v).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count(F.lit(1)).alias("entries")),
         "SELECT count(*) FILTER (hit_pos % 3 <> 0) AS accepted, count(*) FILTER (hit_pos % 3 = 0) AS rejected, count(*) AS entries FROM (SELECT DISTINCT hit_pos FROM candidate_hits WHERE source = 'web_search')")
register("D21_dates_refined", lambda v: (lambda dated: v.hits.where(t.blank(F.col("published_date")) & (F.col("source") == "google_books")).select("hit_pos", "title", "series_id", t.title_key(F.col("title")).alias("k")).join(dated, ["series_id", "k"]).select("hit_pos", "title", "found"))(v.hits.where((F.col("source") == "web_search") & ~t.blank(F.col("published_date"))).groupBy("series_id", t.title_key(F.col("title")).alias("k")).agg(F.max("published_date").alias("found"))),
         f"SELECT h.hit_pos, h.title, d.found FROM candidate_hits h JOIN (SELECT series_id, {duck.title('title')} AS k, max(published_date) AS found FROM candidate_hits WHERE source = 'web_search' AND published_date <> '' GROUP BY ALL) d ON d.series_id = h.series_id AND d.k = {duck.title('h.title')} WHERE h.source = 'google_books' AND h.published_date = ''")
register("D19_summary_match", lambda v: v.books.where(F.col("series_id").isNotNull()).select("book_id", "series_id", t.bare_title_key(F.col("title")).alias("k"), F.col("book_number").alias("n")).join(v.hits.select("series_id", "hit_pos", t.bare_title_key(F.col("title")).alias("k"), F.col("series_number_hint").alias("m")), ["series_id", "k"]).groupBy("book_id").agg(F.coalesce(F.min(F.when(F.col("n") == F.col("m"), F.col("hit_pos"))), F.min(F.when(F.col("m").isNull(), F.col("hit_pos")))).alias("hit_pos")).where("hit_pos is not null"),
         f"SELECT * FROM (SELECT b.book_id, coalesce(min(CASE WHEN b.book_number = h.series_number_hint THEN h.hit_pos END), min(CASE WHEN h.series_number_hint IS NULL THEN h.hit_pos END)) AS hit_pos FROM books b JOIN candidate_hits h ON h.series_id = b.series_id AND {duck.bare_key('h.title')} = {duck.bare_key('b.title')} GROUP BY b.book_id) WHERE hit_pos IS NOT NULL")
register("J18_author_alignment", lambda v: v.hits.join(v.series.select("series_id", F.col("author").alias("target")), "series_id").select("hit_pos", "title", t.series_alignment(F.array("author"), F.col("target")).alias("grade")),
         f"SELECT hit_pos, title, {duck.alignment('h.author', 's.author')} AS grade FROM candidate_hits h JOIN series s ON s.series_id = h.series_id")
register("F47_search_url", lambda v: v.books.select("book_id", F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.concat_ws(" ", "title", "author"))).alias("url")), "SELECT book_id, 'https://www.google.com/search?q=' || replace(replace(url_encode(title || ' ' || author), '%20', '+'), '~', '%7E') AS url FROM books")
