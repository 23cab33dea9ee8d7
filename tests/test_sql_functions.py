"""Rules called from Spark SQL text give what the column builders give."""

import pytest
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import sql
from stacksight.functions import text as t
from stacksight.sources.library import AS_OF, Library

ONE = {
    "discovered_title_key": t.discovered_title_key, "identity_text": t.identity_text, "author_identity": t.author_identity, "is_placeholder_author": t.is_placeholder_author, "series_identity": t.series_identity, "title_identity": t.title_identity,
    "title_key": t.title_key, "edition_rank": t.edition_rank, "normalized_text": t.normalized, "core_segment": t.core_segment, "bare_title_key": t.bare_title_key, "is_placeholder_title": t.is_placeholder_title, "branding_name": t.branding_name,
    "is_not_new_release": t.is_not_new_release, "is_english_or_unknown": t.is_english_or_unknown, "words_of": t.tokens, "author_names": t.author_names, "primary_author": t.primary_author, "clean_display_title": t.clean_display_title,
    "edition_from_title": t.edition_from_title, "plain_title": t.plain_title, "plain_words": t.plain_tokens, "is_universe_tie_in": t.is_universe_tie_in, "strict_date": d.strict_date, "flexible_date": d.flexible_date, "plain_number": t.number, "positive_number": t.positive_number,
    "filled_text": t.filled,
}
TWO = {"same_author": t.same_author, "series_book_key": t.series_book_key, "references_series": t.references_series, "partial_series_match": t.partial_series_match}


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    v = Library(spark, "/root/testdata/sf0.001")
    c = v.cases.where("id < 3000")
    odd = spark.createDataFrame([(x,) for x in ("", "  ", None, "Collector's Edition", "a & b", "3.50", "-2", "1e3", "2020-13-01", "1999", "Tome 3", "The  A Book\tSeries", "Ünïcode – Book #2.5", "EN-us", "Hardcover ", "kindle")], "x string")
    parts = [c.select(F.col(k).cast("string").alias("x")) for k in ("title", "series", "author", "num", "date_text")]
    for p in parts:
        odd = odd.union(p)
    df = odd.distinct()
    df.createOrReplaceTempView("odd_texts")
    return df


def test_rules_of_one_text(spark, texts):
    called = spark.sql("SELECT x, " + ", ".join(f"{n}(x) AS {n}" for n in ONE) + " FROM odd_texts").collect()
    built = texts.select("x", *(f(F.col("x")).alias(n) for n, f in ONE.items())).collect()
    by = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert by(called) == by(built) and len(called) > 300


def test_rules_of_two_texts(spark, texts):
    pairs = texts.alias("a").join(texts.where("length(x) < 30").orderBy(F.xxhash64("x")).limit(25).alias("b")).select(F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    pairs.createOrReplaceTempView("odd_pairs")
    called = spark.sql("SELECT x, y, " + ", ".join(f"{n}(x, y) AS {n}" for n in TWO) + " FROM odd_pairs").collect()
    built = pairs.select("x", "y", *(f(F.col("x"), F.col("y")).alias(n) for n, f in TWO.items())).collect()
    assert sorted(map(repr, map(tuple, called))) == sorted(map(repr, map(tuple, built)))


def test_the_others(spark, texts):
    r = spark.sql(f"SELECT number_text(3.0D), number_text(3.5D), number_text(NULL), overlap_ratio(array('a', 'b'), array('b')), is_upcoming(DATE'2000-01-01', NULL, DATE'{AS_OF}'), is_upcoming(NULL, true, DATE'{AS_OF}'), discovery_health(NULL, DATE'{AS_OF}'), discovery_health(DATE'1997-10-01', DATE'{AS_OF}')").first()
    assert tuple(r) == ("3", "3.5", "", 1.0, True, True, "never", "stale")
    assert set(ONE) | set(TWO) | {"number_text", "overlap_ratio", "is_upcoming", "discovery_health", "text_of", "squeezed", "without_article"} == set(sql.RULES)


def test_calls_become_plain_expressions(spark, texts):
    plan = spark.sql("SELECT x FROM odd_texts WHERE title_key(x) = 'stone'")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "title_key" not in plan and "Python" not in plan
