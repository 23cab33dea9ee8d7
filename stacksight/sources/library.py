"""Library-shaped views over the TPC-H-like tables: the same SQL text for Spark and for the DuckDB oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The day that stands for today in queries over the views.
AS_OF = "1998-06-01"

VIEWS: dict[str, str] = {
    "profiles": """
SELECT concat('p', CAST(r_regionkey AS STRING)) AS profile_id, r_name AS display_name, r_regionkey = 0 AS is_default,
  DATE '1997-06-01' + CAST(r_regionkey * 7 % 5 AS INT) AS created_at,
  CASE WHEN r_regionkey <> 3 THEN CAST(DATE '1998-06-01' - CAST(r_regionkey * 3 AS INT) AS TIMESTAMP) END AS last_full_discovery_run_at
FROM region
""",
    "series": """
SELECT CAST(c_custkey AS BIGINT) AS series_id, concat('p', CAST(n_regionkey AS STRING)) AS profile_id, c_name AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'Unknown author'
  WHEN c_custkey % 17 = 0 THEN concat('A. Writer', CAST(c_custkey % 97 AS STRING), '; Co Author')
  ELSE concat('Ann Writer', CAST(c_custkey % 97 AS STRING)) END AS author,
  c_mktsegment AS genre, c_custkey % 5 = 0 AS is_finished,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '1998-06-01' - CAST(c_custkey % 600 AS INT) END AS last_checked,
  c_custkey % 19 = 0 AS has_new_books
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "books": """
SELECT CAST(o_orderkey AS BIGINT) AS book_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'p0' ELSE concat('p', CAST(n_regionkey AS STRING)) END AS profile_id,
  CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN CAST(o_custkey + 10000000 AS BIGINT) ELSE CAST(o_custkey AS BIGINT) END AS series_id,
  CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 12 AS DOUBLE) + 0.5 ELSE CAST(o_orderkey % 12 + 1 AS DOUBLE) END AS book_number,
  concat(p_name, CASE WHEN o_orderkey % 53 = 0 THEN ' (Books 1-3)' WHEN o_orderkey % 29 = 0 THEN ': A LitRPG Adventure' WHEN o_orderkey % 23 = 0 THEN ' (Kindle Edition)'
  WHEN o_orderkey % 31 = 0 THEN ' SIGNED' WHEN o_orderkey % 3 = 0 THEN concat(' (', c_name, ' Book ', CAST(o_orderkey % 12 + 1 AS STRING), ')') ELSE '' END) AS title,
  concat('Ann Writer', CAST(o_custkey % 97 AS STRING)) AS author,
  CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'P' THEN 'upcoming' ELSE 'available' END AS read_status,
  o_orderstatus = 'F' AND o_orderkey % 10 <> 0 AS is_read,
  o_orderstatus = 'O' AND o_orderkey % 6 = 0 AS is_missing,
  o_orderstatus = 'P' AND o_orderkey % 4 = 0 AS is_upcoming_auto, false AS is_upcoming_final,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'deleted' WHEN o_orderkey % 2 = 0 THEN 'active' END AS record_status,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS publication_date,
  CASE WHEN o_orderkey % 15 = 0 THEN CAST(o_orderdate AS DATE) + 90 END AS release_date,
  CASE o_orderkey % 5 WHEN 0 THEN 'hardcover' WHEN 1 THEN 'paperback' WHEN 2 THEN 'ebook' WHEN 3 THEN 'audio' END AS edition,
  CASE o_orderkey % 6 WHEN 0 THEN 'user' WHEN 1 THEN 'import' WHEN 2 THEN 'provider' WHEN 3 THEN 'discovery' END AS metadata_source,
  CASE WHEN o_orderkey % 6 = 2 THEN o_orderkey % 9 = 2 END AS needs_reresolution,
  CASE WHEN o_orderkey % 4 = 1 THEN concat('978', lpad(CAST(o_orderkey % 5000 AS STRING), 10, '0')) END AS isbn13,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('B', lpad(CAST(o_orderkey % 7000 AS STRING), 9, '0')) END AS asin,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS read_date,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 6 AS INT) END AS rating,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 25 = 0 THEN concat('Liked ', p_name) END AS review,
  CASE WHEN o_orderkey % 33 = 0 THEN 'lent out' END AS notes,
  CASE WHEN o_orderkey % 6 = 3 THEN concat('https://x/', CAST(o_orderkey AS STRING)) END AS source_url,
  CASE WHEN o_orderkey % 4 = 1 THEN lpad(CAST(o_orderkey % 5000 AS STRING), 10, '0') END AS isbn
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = o_orderkey % 200
""",
    "candidate_hits": """
SELECT CAST(o_custkey AS BIGINT) AS series_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'hardcover' WHEN 1 THEN 'google_books' WHEN 2 THEN 'openlibrary' ELSE 'web_search' END AS source,
  CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS hit_pos,
  concat(p_name, CASE WHEN l_partkey % 5 = 0 THEN concat(' (', c_name, ' Book ', CAST(l_orderkey % 14 + 1 AS STRING), ')') WHEN l_partkey % 37 = 0 THEN ' Box Set' WHEN l_partkey % 41 = 0 THEN ' - untitled' ELSE '' END) AS title,
  concat('Ann Writer', CAST(CASE WHEN l_orderkey % 10 = 9 THEN 98 ELSE o_custkey % 97 END AS STRING)) AS author,
  CASE WHEN l_partkey % 3 = 0 THEN concat('978', lpad(CAST(l_orderkey % 5000 AS STRING), 10, '0')) END AS isbn13,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_orderkey % 14 + 1 AS DOUBLE) END AS series_number_hint,
  CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_orderkey % 20 = 7 THEN 'Other Saga' ELSE c_name END END AS series_name_hint,
  CASE WHEN l_linenumber % 4 = 0 AND o_custkey % 2 = 0 THEN CAST(14 AS INT) END AS series_total_hint,
  CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(year(l_shipdate) AS STRING) ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS published_date,
  CASE WHEN l_partkey % 6 = 0 THEN 'fr' WHEN l_linenumber % 4 = 1 THEN 'en' ELSE '' END AS language,
  l_returnflag = 'N' AND l_suppkey % 4 = 0 AS upcoming_hint
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey
""",
    "notifications": """
SELECT CAST(event_id AS BIGINT) AS notification_id, concat('p', CAST(user_id % 5 AS STRING)) AS profile_id, CAST(user_id AS BIGINT) AS series_id,
  CASE WHEN event_type = 'signup' THEN 'new_book' ELSE 'series_discovery_delta' END AS kind, CAST(event_id % 4 + 1 AS INT) AS count_new_books,
  ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' DAY END AS dismissed_at
FROM events WHERE event_type IN ('purchase', 'signup')
""",
    "title_cases": """
SELECT CAST(id AS BIGINT) AS id, title, series, author, TRY_CAST(num AS DOUBLE) AS num, isbn13, date_text FROM (VALUES
  (1, 'Iron Flame SIGNED', 'The Empyrean', 'Rebecca Yarros', '2', '', '2023-11-07'), (2, 'Iron Flame (Kindle Edition)', 'The Empyrean Series', 'Yarros, Rebecca', '2.0', '9781649374172', '2023-11'),
  (3, 'The Empyrean', 'The Empyrean', 'unknown author', NULL, '', '2023'), (4, 'Onyx Storm #3.5 & More', 'The Empyrean', 'N/A', '3.5', NULL, '2023-02-30'),
  (5, 'Crown: A LitRPG Adventure (Unbound Book 9)', 'Unbound', 'Nicoli Gonnella', '9', '', '1/2/24'), (6, 'Book 13', 'Lifesteal', 'various', '13', '', '45292'),
  (7, 'Lifesteal (Volume 4): an Epic Fantasy LitRPG Saga', 'Lifesteal', 'J.N Chaney; Terry Maggert and 2 more', NULL, '', '13/45/2020'), (8, 'A Jonathan Hunt Thriller', 'Jonathan Hunt Thriller Series', 'Georgia Wagner', NULL, '', ''),
  (9, 'A Little Too Close - Madigan Mountain #2', 'Madigan Mountain', 'Rebecca Yarros, editor', '2', NULL, '2022-01-01'), (10, 'Mage-Provocateur: A Starship''s Mage Universe Novel', 'Starship''s Mage', 'Glynn Stewart', '0', '', '25-12-2021'),
  (11, 'Untitled TBA', 'Dungeon Crawler Carl', NULL, '-1', '', NULL), (12, 'Unbound Book Seven', 'Unbound', 'none', NULL, '', '2021/7/4'), (13, 'Dungeon Crawler Carl 5', 'Dungeon Crawler Carl', 'Matt Dinniman', NULL, '', '7/4/2021'),
  (14, 'The Complete Series: Books One to Three', 'Saga World', 'Ann & Bob and Carl', '1', '', '2021-07-04'), (15, 'Vol. 12: The End ebook', NULL, ' ', '', '', 'soon'), (16, '  ', '', '', 'abc', '', ' 2020 '),
  (17, 'Unbound: Unbound The Fall : (Book Two) : (Unbound Book 2)', 'Unbound', 'Nicoli Gonnella', '2', '', '1999-12-31'), (18, 'Signed Confession, The', 'Crime 101', 'Jane Doe - narrator', '1.25', '', '0'),
  (19, 'Volumes I to IV', 'Old Tales', 'J. Doe', NULL, '', '1900-01-01'), (20, 'Stone: (Book Two) : (Unbound, Book 2)', 'Unbound', 'Nicoli Gonnella', '2', '', '12-1-2020'), (21, 'Heart: Unbound, Book 3', 'Unbound', 'Nicoli Gonnella', '3', '', '2020-12-1')
) AS t(id, title, series, author, num, isbn13, date_text)
UNION ALL
SELECT b.book_id + 1000, b.title, s.name, b.author, b.book_number, b.isbn13, CAST(b.publication_date AS STRING) FROM books b LEFT JOIN series s ON coalesce(b.series_id, -b.book_id) = s.series_id
""",
}

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


class Library:
    """The views of one data folder, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql, used = VIEWS[name], {}
        for t in (*TABLES, *VIEWS):
            marked = _named(sql, t, "{" + t + "}")
            if marked != sql:
                sql, used[t] = marked, self.table(t) if t in TABLES else self.view(t)
        return self.spark.sql(sql, **used)

    profiles = cached_property(lambda self: self.view("profiles"))
    series = cached_property(lambda self: self.view("series"))
    books = cached_property(lambda self: self.view("books"))
    hits = cached_property(lambda self: self.view("candidate_hits"))
    notifications = cached_property(lambda self: self.view("notifications"))
    cases = cached_property(lambda self: self.view("title_cases"))


def _named(sql: str, table: str, to: str) -> str:
    """The SQL with the table of FROM and JOIN replaced."""
    for word in ("FROM ", "JOIN "):
        for end in (" ", "\n"):
            sql = sql.replace(f"{word}{table}{end}", f"{word}{to}{end}")
    return sql


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that they name, put before it."""
    used = {n for n in VIEWS if n in sql}
    used |= {n for n in VIEWS if any(n in VIEWS[u] for u in used)}
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in used)
    if not ctes:
        return sql
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
