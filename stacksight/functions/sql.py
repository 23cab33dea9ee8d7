"""The scalar rules as temporary SQL functions, so that they can be used from plain Spark SQL.

Each is a SQL user-defined function: its body is an expression over its parameters and earlier rules, and Catalyst puts it
in place of the call, so filters on it are optimised like hand-written ones and nothing leaves the JVM. The fixed values
are those of the column builders.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from stacksight.functions import dates as d
from stacksight.functions import text as t


def _words(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _any(values: tuple[str, ...]) -> str:
    """An alternation as the body of a raw string in double quotes."""
    return "|".join(values)


_TITLE_MARKS = (
    r"(?i)\((?:audible|audible audio|audio cd|kindle|kindle edition|paperback|hardcover|mass market paperback)[^)]*\)", r"(?i)\s*[:\-]\s*(?:audible|kindle|paperback|hardcover)\b.*$", r"(?i)\s+,\s+book\s+\d+\b",
    r"(?i)\((?:signed|autographed)(?:\s+(?:edition|copy))?\)", r"(?i)\s*[:\-]?\s*(?:signed|autographed)(?:\s+(?:edition|copy|by\s+the\s+author))?\s*$",
)


def _without(x: str, patterns: tuple[str, ...]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, r'{p}', '')"
    return x


#: name: parameters, type of the result, body; a rule may call those above it.
RULES: dict[str, tuple[str, str, str]] = {
    "text_of": ("x STRING", "STRING", "coalesce(x, '')"),
    "filled_text": ("x STRING", "STRING", "nullif(trim(coalesce(x, '')), '')"),
    "squeezed": ("x STRING", "STRING", r"trim(regexp_replace(x, r'(?U)\s+', ' '))"),
    "plain_number": ("x STRING", "DOUBLE", rf"CASE WHEN text_of(x) RLIKE r'{t.NUMERIC}' THEN try_cast(trim(x) AS DOUBLE) END"),
    "positive_number": ("x STRING", "DOUBLE", "CASE WHEN plain_number(x) > 0 THEN plain_number(x) END"),
    "number_text": ("n DOUBLE", "STRING", "CASE WHEN n IS NULL THEN '' WHEN n = floor(n) THEN CAST(CAST(floor(n) AS BIGINT) AS STRING) ELSE CAST(n AS STRING) END"),
    "discovered_title_key": ("x STRING", "STRING", "regexp_replace(lower(text_of(x)), '[^a-z0-9]+', '')"),
    "identity_text": ("x STRING", "STRING", "trim(regexp_replace(lower(text_of(x)), '[^a-z0-9]+', ' '))"),
    "author_identity": ("x STRING", "STRING", r"squeezed(regexp_replace(regexp_replace(identity_text(x), r'\band\s+\d+\s+more\b', ''), r'\b(author|narrator|editor)\b', ''))"),
    "same_author": ("a STRING, b STRING", "BOOLEAN", "author_identity(a) <> '' AND author_identity(a) = author_identity(b)"),
    "is_placeholder_author": ("x STRING", "BOOLEAN", f"author_identity(x) IN ({_words(t.PLACEHOLDER_AUTHORS)})"),
    "series_identity": ("x STRING", "STRING", r"squeezed(regexp_replace(identity_text(x), r'\b(series|book series)\b', ''))"),
    "title_identity": ("x STRING", "STRING", f"identity_text({_without('trim(text_of(x))', _TITLE_MARKS)})"),
    "title_key": ("x STRING", "STRING", "nullif(title_identity(x), '')"),
    "series_book_key": ("series STRING, n STRING", "STRING", "CASE WHEN series_identity(series) <> '' AND positive_number(n) IS NOT NULL THEN concat_ws('|', series_identity(series), number_text(positive_number(n))) END"),
    "edition_rank": ("x STRING", "INT", "CASE lower(trim(text_of(x))) " + " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in t.EDITION_RANKS) + " ELSE 1 END"),
    "normalized_text": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(replace(lower(text_of(x)), '&', ' and '), r'[^a-z0-9\s]', ' '), r'\s+', ' '))"),
    "without_article": ("x STRING", "STRING", r"regexp_replace(x, r'^(?:the|an?)\s+', '')"),
    "core_segment": ("x STRING", "STRING", r"regexp_extract(text_of(x), r'^(?s)(.*?)(?:[:,(]|\s+-\s+|$)', 1)"),
    "bare_title_key": ("x STRING", "STRING", "without_article(normalized_text(core_segment(x)))"),
    "is_placeholder_title": ("x STRING", "BOOLEAN", f"concat(' ', normalized_text(x), ' ') RLIKE r'^ +$|{_any(tuple(f' {m} ' for m in t.PLACEHOLDER_TITLES))}'"),
    "branding_name": ("x STRING", "STRING", rf"squeezed(regexp_replace(normalized_text(x), r'{t.BRANDING}', ''))"),
    "is_not_new_release": ("x STRING", "BOOLEAN", f"""normalized_text(x) RLIKE r"{_any((*t.NOT_A_NEW_RELEASE_PATTERNS, *t.NOT_A_NEW_RELEASE))}\""""),
    "is_english_or_unknown": ("x STRING", "BOOLEAN", f"lower(trim(text_of(x))) IN ('', {_words(t.ENGLISH)})"),
    "words_of": ("x STRING", "ARRAY<STRING>", "array_distinct(filter(split(normalized_text(x), ' '), w -> w <> ''))"),
    "overlap_ratio": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / least(size(a), size(b)) ELSE 0D END"),
    "author_names": ("x STRING", "ARRAY<STRING>", r"filter(transform(split(text_of(x), r'(?i)\s*(?:;|,|&|\band\b)\s*'), n -> trim(n)), n -> n <> '')"),
    "primary_author": ("x STRING", "STRING", "coalesce(get(author_names(x), 0), trim(text_of(x)))"),
    "clean_display_title": ("x STRING", "STRING", r"coalesce(nullif(trim(regexp_replace(text_of(x), r'\s-\s+(.+?)\s*#\s*[\d.]+\s*$', '')), ''), text_of(x))"),
    "edition_from_title": ("x STRING", "STRING", r"CASE WHEN lower(text_of(x)) RLIKE r'\b(?:audible(?:\s+audio)?|audio\s*cd|audiobook)\b' THEN 'audio' WHEN lower(text_of(x)) RLIKE r'\bkindle(?:\s+edition)?\b' THEN 'ebook' WHEN lower(text_of(x)) RLIKE r'\bpaperback\b' THEN 'paperback' WHEN lower(text_of(x)) RLIKE r'\bhardcover\b' THEN 'hardcover' ELSE 'unknown' END"),
    "plain_title": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(text_of(x)), r'[^a-z0-9\s]+', ' '), r'\s+', ' '))"),
    "plain_words": ("x STRING", "ARRAY<STRING>", "array_distinct(filter(split(plain_title(x), ' '), w -> w <> ''))"),
    "references_series": ("title STRING, series STRING", "BOOLEAN", "plain_title(title) <> '' AND plain_title(series) <> '' AND (contains(plain_title(title), plain_title(series)) OR (overlap_ratio(plain_words(title), plain_words(series)) >= 0.75 AND size(array_intersect(plain_words(title), plain_words(series))) >= 2))"),
    "partial_series_match": ("title STRING, series STRING", "BOOLEAN", "overlap_ratio(plain_words(title), plain_words(series)) >= 0.5"),
    "is_universe_tie_in": ("x STRING", "BOOLEAN", r"text_of(x) RLIKE r'(?i)\buniverse\s+(?:novel|novella|book|story)\b'"),
    "strict_date": ("x STRING", "DATE", r"CASE WHEN trim(text_of(x)) RLIKE r'^\d{4}-\d{2}-\d{2}$' THEN try_cast(trim(x) AS DATE) WHEN trim(text_of(x)) RLIKE r'^\d{4}$' THEN try_cast(concat(trim(x), '-01-01') AS DATE) END"),
    "flexible_date": ("x STRING", "DATE", r"coalesce(strict_date(x), CASE WHEN trim(text_of(x)) RLIKE r'^\d{4}-\d{2}$' THEN try_cast(concat(trim(x), '-01') AS DATE) END)"),
    "is_upcoming": ("day DATE, hint BOOLEAN, today DATE", "BOOLEAN", "coalesce(day > today, hint, false)"),
    "discovery_health": ("checked DATE, today DATE", "STRING", f"CASE WHEN checked IS NULL THEN 'never' WHEN greatest(0, datediff(today, checked)) <= {d.STALE_AFTER} THEN 'healthy' WHEN datediff(today, checked) <= {d.VERY_STALE_AFTER} THEN 'stale' ELSE 'very_stale' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make every rule a temporary function of the session; their names. Calling it again changes nothing."""
    for name, (parameters, kind, body) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(RULES)
