"""Identity and matching of titles, authors and series names, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rules.
PLACEHOLDER_AUTHORS = ("unknown", "n a", "none", "various")
PLACEHOLDER_TITLES = ("untitled", "unannounced", "unnamed", "unconfirmed title", "tba", "tbd", "to be announced", "to be determined", "to be titled", "working title", "coming soon")
NOT_A_NEW_RELEASE = (
    "omnibus", "box set", "boxset", "compilation", "anthology", "complete series", "bundle", "deluxe edition", "special edition", "collector's edition", "anniversary edition",
    "illustrated edition", "annotated edition", "extended edition", "author's cut", "french edition", "spanish edition", "german edition", "italian edition", "portuguese edition", "dutch edition",
)
NOT_A_NEW_RELEASE_PATTERNS = (r"\btome\s*\d*\b", r"\bseries,?\s+volume\b", r"\b\d+\s+books?\b")
ENGLISH = ("en", "eng", "en-us", "en-gb")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
TITLE_FILLERS = ("a", "an", "the", "book", "books", "novel", "novella", "novellas", "novels", "vol", "vols", "volume", "volumes", "part", "parts", "no", "number", "numbers")
GENRE_TAGLINES = ("thriller", "thrillers", "mystery", "mysteries", "romance", "romances", "saga", "sagas", "epic", "epics", "adventure", "adventures", "drama", "dramas", "chronicle", "chronicles", "tale", "tales", "story", "stories")
EDITION_RANKS = (("hardcover", 5), ("paperback", 4), ("ebook", 3), ("audio", 2))
BRANDING = r"\b(?:series|universe|collection|world|saga)\b"
#: A number as the numeric columns take it; anything else is no number.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"


def bound(*values: Column, use: Callable[..., Column]) -> Column:
    """use(*values) with each value computed once; an expression that names an input several times repeats it otherwise."""
    if not values:
        return use()
    return F.element_at(F.transform(F.array(values[0]), lambda x: bound(*values[1:], use=lambda *rest: use(x, *rest))), 1)


def unless_empty(c: Column) -> Column:
    """The text, null where empty; nullif would compute it twice."""
    return bound(c, use=lambda x: F.when(x != "", x))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank(c: Column) -> Column:
    return F.trim(text(c)) == ""


def filled(c: Column) -> Column:
    """The trimmed text, null where blank."""
    return F.nullif(F.trim(text(c)), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return unless_empty(F.regexp_extract(c, pattern, group))


def number(c: Column) -> Column:
    """A double, null where the text is no plain number."""
    return bound(text(c), use=lambda x: F.when(x.rlike(NUMERIC), F.trim(x).try_cast("double")))


def discovered_title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def identity_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def author_identity(c: Column) -> Column:
    plain = F.regexp_replace(identity_text(c), r"\band\s+\d+\s+more\b", "")
    return squeeze(F.regexp_replace(plain, r"\b(author|narrator|editor)\b", ""))


def same_author(a: Column, b: Column) -> Column:
    """Both named, and equal as identities: the strict rule of writing."""
    return bound(author_identity(a), author_identity(b), use=lambda x, y: (x != "") & (y != "") & (x == y))


def same_author_as_written(a: Column, b: Column) -> Column:
    """Both named, and equal but for case and outer blanks: the lenient rule of discovery."""
    x, y = F.lower(F.trim(text(a))), F.lower(F.trim(text(b)))
    return (x != "") & (y != "") & (x == y)


def is_placeholder_author(c: Column) -> Column:
    return author_identity(c).isin(*PLACEHOLDER_AUTHORS)


def series_identity(c: Column) -> Column:
    return squeeze(F.regexp_replace(identity_text(c), r"\b(series|book series)\b", ""))


def title_identity(c: Column) -> Column:
    t = F.trim(text(c))
    for pattern in (
        r"(?i)\((?:audible|audible audio|audio cd|kindle|kindle edition|paperback|hardcover|mass market paperback)[^)]*\)",
        r"(?i)\s*[:\-]\s*(?:audible|kindle|paperback|hardcover)\b.*$",
        r"(?i)\s+,\s+book\s+\d+\b",
        r"(?i)\((?:signed|autographed)(?:\s+(?:edition|copy))?\)",
        r"(?i)\s*[:\-]?\s*(?:signed|autographed)(?:\s+(?:edition|copy|by\s+the\s+author))?\s*$",
    ):
        t = F.regexp_replace(t, pattern, "")
    return identity_text(t)


def positive_number(c: Column) -> Column:
    return bound(number(c), use=lambda n: F.when(n > 0, n))


def number_text(n: Column) -> Column:
    """3 for 3.0, 3.5 for 3.5, empty for null."""
    return F.when(n.isNull(), F.lit("")).when(n == F.floor(n), F.floor(n).cast("bigint").cast("string")).otherwise(n.cast("string"))


def series_book_key(series: Column, n: Column) -> Column:
    """`series|number`, null where either side is missing."""
    return F.when(n.isNotNull(), bound(series_identity(series), positive_number(n), use=lambda s, p: F.when((s != "") & p.isNotNull(), F.concat_ws("|", s, number_text(p)))))


def title_key(c: Column) -> Column:
    return bound(title_identity(c), use=lambda t: F.when(t != "", t))


def display_title(title: Column, canonical: Column) -> Column:
    return F.coalesce(filled(canonical), text(title))


def edition_rank(c: Column) -> Column:
    e, out = F.lower(F.trim(text(c))), F.lit(1)
    for name, rank in EDITION_RANKS:
        out = F.when(e == name, F.lit(rank)).otherwise(out)
    return out


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def without_article(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:the|an?)\s+", "")


def core_segment(c: Column) -> Column:
    """What stands before the first subtitle mark."""
    return F.regexp_extract(text(c), r"^(?s)(.*?)(?:[:,(]|\s+-\s+|$)", 1)


def bare_title_key(c: Column) -> Column:
    return without_article(normalized(core_segment(c)))


def core_title_key(c: Column, bare: Column | None = None) -> Column:
    """The bare title key (`bare`, where it is there already) with the number that the title tells."""
    return F.concat(bare_title_key(c) if bare is None else bare, F.coalesce(F.concat(F.lit(" "), inferred_number(c).cast("bigint").cast("string")), F.lit("")))


def number_context(c: Column) -> Column:
    """Lower case words; a point between digits stays."""
    marked = F.regexp_replace(F.lower(text(c)), r"(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(marked, "[^a-z0-9.]+", " "))


def inferred_number(c: Column, series: Column | None = None) -> Column:
    """The place in a series that a title tells: `#N`, `book|volume|vol N`, a spelled number, `<series> N`."""

    def told(context: Column, clean: Column, s: Column | None = None) -> Column:
        found = [positive_number(extract(text(c), r"#\s*(\d+(?:\.\d+)?)\b"))]
        found += [positive_number(extract(context, rf"\b{word}\s*(\d+(?:\.\d+)?)\b")) for word in ("book", "volume", r"vol\.?")]
        word = extract(clean, r"\b(?:book|volume|vol\.?)\s+(" + "|".join(NUMBER_WORDS) + r")\b")
        found.append(bound(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), word), use=lambda n: F.when(n > 0, n.cast("double"))))
        if s is not None:
            after = F.when((s != "") & F.startswith(clean, s), F.trim(F.substring(clean, F.length(s) + 1, F.length(clean))))
            found.append(positive_number(extract(after, r"^(\d+)\b")))
            # the name is letters, digits and blanks, so it stands for itself in a pattern
            anywhere = F.call_function("regexp_extract", clean, F.concat(F.lit(r"\b"), s, F.lit(r"\s+(\d+)\b")), F.lit(1))
            found.append(F.when(s != "", positive_number(anywhere)))
        return F.coalesce(*found)

    # a title without any of these marks tells no number, and most have none
    marks = "#|book|vol" if series is None else "#|book|vol|[0-9]"
    return F.when(F.lower(text(c)).rlike(marks), bound(number_context(c), normalized(c), *([] if series is None else [normalized(series)]), use=told))


def is_placeholder_title(c: Column) -> Column:
    padded = F.concat(F.lit(" "), normalized(c), F.lit(" "))
    return padded.rlike("^ +$|" + "|".join(f" {marker} " for marker in PLACEHOLDER_TITLES))


def branding_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(normalized(c), BRANDING, ""))


def is_not_new_release(c: Column) -> Column:
    return normalized(c).rlike("|".join((*NOT_A_NEW_RELEASE_PATTERNS, *NOT_A_NEW_RELEASE)))


def is_english_or_unknown(c: Column) -> Column:
    code = F.lower(F.trim(text(c)))
    return (code == "") | code.isin(*ENGLISH)


def words(c: Column) -> Column:
    """The different words of a normalised text."""
    return F.array_distinct(F.array_remove(F.split(c, " "), ""))


def tokens(c: Column) -> Column:
    return words(normalized(c))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Of two token arrays: shared tokens over the smaller array; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def series_names_compatible(a: Column, b: Column) -> Column:
    return bound(branding_name(a), branding_name(b), use=brands_compatible)


def brands_compatible(x: Column, y: Column) -> Column:
    """Of two branding names: equal, or two shared words or more and one within the other or half of the shorter one shared."""

    def close(s: Column, t: Column) -> Column:
        subset = (F.size(F.array_except(s, t)) == 0) | (F.size(F.array_except(t, s)) == 0)
        return (F.size(F.array_intersect(s, t)) >= 2) & (subset | (overlap_ratio(s, t) >= 0.5))

    return (x != "") & (y != "") & ((x == y) | bound(tokens(x), tokens(y), use=close))


def is_series_variant(title: Column, series: Column, isbn13: Column, hint: Column) -> Column:
    """The title is the series' name, or that with fillers, and neither an ISBN nor a number speaks for a book."""

    def partly(x: Column, y: Column) -> Column:
        own = F.filter(F.array_except(x, y), lambda w: ~w.isin(*TITLE_FILLERS) & ~w.rlike(r"^\d+$"))
        fits = bound(own, use=lambda o: (F.size(o) == 0) | ((F.size(o) == 1) & F.forall(o, lambda w: w.isin(*GENRE_TAGLINES))))
        return (F.size(F.array_intersect(x, y)) >= 2) & fits

    def variant(t: Column, s: Column) -> Column:
        return (t != "") & (s != "") & F.when(t == s, ~F.coalesce(hint == 1, F.lit(False))).otherwise(F.coalesce(hint == 0, F.lit(True)) & bound(words(t), words(s), use=partly))

    return blank(isbn13) & bound(branding_name(title), branding_name(series), use=variant)


def is_series_index_entry(title: Column, series: Column, isbn13: Column, has_number: Column) -> Column:
    def index(t: Column, s: Column, stripped: Column, bare: Column) -> Column:
        same = (t == s) | ((stripped != "") & (stripped == s))
        bare_same = (bare != "") & ((without_article(t) == bare) | ((stripped != "") & (without_article(stripped) == bare)))
        return (t != "") & (s != "") & (same | bare_same)

    return blank(isbn13) & ~F.coalesce(has_number, F.lit(False)) & bound(normalized(title), normalized(series), branding_name(title), without_article(normalized(series)), use=index)


def series_hint(c: Column) -> Column:
    first = extract(text(c), r"(?i):\s*a\s+(.+?)\s+(?:universe|series|saga|world)\s+(?:novella|short story|story|book|companion)\b")
    second = extract(text(c), r"\s-\s+(.+?)\s*#\s*[\d.]+\s*$")
    return F.coalesce(F.nullif(squeeze(first), F.lit("")), F.nullif(squeeze(second), F.lit("")))


def clean_display_title(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text(c), r"\s-\s+(.+?)\s*#\s*[\d.]+\s*$", "")), F.lit("")), text(c))


def author_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"(?i)\s*(?:;|,|&|\band\b)\s*"), lambda n: F.trim(n)), lambda n: n != "")


def primary_author(c: Column) -> Column:
    return F.coalesce(F.get(author_names(c), F.lit(0)), F.trim(text(c)))


def author_matches(candidates: Column, target: Column) -> Column:
    """Some name of the target has all its words of two letters or more within one candidate's name."""
    names = F.transform(author_names(target), lambda n: F.filter(F.split(normalized(n), " "), lambda w: F.length(w) > 1))
    match = lambda known: F.exists(names, lambda words: (F.size(words) > 0) & F.exists(known, lambda k: F.forall(words, lambda w: F.contains(k, w))))
    return bound(F.transform(candidates, normalized), use=match)


def edition_from_title(c: Column) -> Column:
    t = F.lower(text(c))
    audio, ebook = t.rlike(r"\b(?:audible(?:\s+audio)?|audio\s*cd|audiobook)\b"), t.rlike(r"\bkindle(?:\s+edition)?\b")
    return F.when(audio, "audio").when(ebook, "ebook").when(t.rlike(r"\bpaperback\b"), "paperback").when(t.rlike(r"\bhardcover\b"), "hardcover").otherwise("unknown")


def same_underlying_book(t1: Column, n1: Column, t2: Column, n2: Column) -> Column:
    a, b = title_key(t1), title_key(t2)
    return F.coalesce((a == b) & (n1.isNull() | n2.isNull() | (n1 == n2)), F.lit(False))


def identity_number(c: Column) -> Column:
    """A number as text (integral ones without a point), other text trimmed, empty for null."""
    n = number(c)
    return F.when(n.isNotNull(), number_text(n)).otherwise(F.trim(text(c)))


def header_key(c: Column) -> Column:
    return identity_text(c)


def title_or_series_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), ":+$", ""), r"\s+", " ")


def cache_key(c: Column) -> Column:
    return F.lower(squeeze(text(c)))


def query_variants(c: Column) -> Column:
    """The text as it is and before its subtitle, without repeats and blanks."""
    raw, core = F.trim(text(c)), F.trim(core_segment(c))
    return F.filter(F.array_distinct(F.array(raw, core)), lambda q: q != "")


def group_key(isbn13: Column, title: Column) -> Column:
    return F.when(~blank(isbn13), F.concat(F.lit("isbn:"), F.trim(text(isbn13)))).otherwise(F.concat(F.lit("title:"), core_title_key(title)))


def has_series_number(c: Column) -> Column:
    return text(c).rlike(r"(?i)\bbook\s*#?\s*\d+(?:\.\d+)?\b|#\s*\d+(?:\.\d+)?\b|\bvol(?:ume)?\.?\s*\d+(?:\.\d+)?\b|\bepisode\s*\d+(?:\.\d+)?\b|\bpart\s*\d+(?:\.\d+)?\b")


def is_meaningful_series(series: Column, author: Column) -> Column:
    """A series cell that names a series, not a placeholder or a dash with the author's name."""
    s = F.trim(text(series))
    key = header_key(series)
    bare = F.trim(F.regexp_replace(s, r"^[\s\-‐-―_.:]+", ""))
    marked_author = (bare != "") & (bare != s) & (F.lower(bare) == F.lower(F.trim(text(author))))
    return (key != "") & ~key.isin("n a", "na", "none", "standalone", "tbd", "unknown", "n") & ~marked_author


def plain_title(c: Column) -> Column:
    """Letters, digits and single blanks, without the rule for `&`."""
    return identity_text(c)


def plain_tokens(c: Column) -> Column:
    return words(plain_title(c))


def title_stem(c: Column) -> Column:
    return plain_stem(plain_title(c))


def plain_stem(plain: Column) -> Column:
    """The stem of a plain title."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(book|volume|vol|series)\s*\d+\b", " "), r"\s+", " "))


def references_series(title: Column, series: Column) -> Column:
    t, s = plain_title(title), plain_title(series)
    x, y = plain_tokens(title), plain_tokens(series)
    return (t != "") & (s != "") & (F.contains(t, s) | ((overlap_ratio(x, y) >= 0.75) & (F.size(F.array_intersect(x, y)) >= 2)))


def partial_series_match(title: Column, series: Column) -> Column:
    return overlap_ratio(plain_tokens(title), plain_tokens(series)) >= 0.5


def title_pattern_match(title: Column, series: Column, known_titles: Column) -> Column:
    """The title names the series, or shares its stem with a known title."""
    stem = title_stem(title)
    x = plain_tokens(stem)
    known = F.exists(known_titles, lambda k: (title_stem(k) != "") & ((title_stem(k) == stem) | (overlap_ratio(x, plain_tokens(title_stem(k))) >= 0.75)))
    return (plain_title(title) != "") & (references_series(title, series) | F.coalesce(known, F.lit(False)))


def is_universe_tie_in(c: Column) -> Column:
    return text(c).rlike(r"(?i)\buniverse\s+(?:novel|novella|book|story)\b")


def initials_variant(a: Column, b: Column) -> Column:
    """Of two token arrays of given names: the shorter one may abbreviate the longer one."""
    x, y = F.array_join(F.array_sort(a), ""), F.array_join(F.array_sort(b), "")
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (F.size(a) == 0) | (F.size(b) == 0) | ((F.length(short) <= 6) & F.startswith(long, F.substring(short, 1, 1)))


def series_alignment(candidates: Column, series_author: Column) -> Column:
    """high: the same words; medium: same surname and given names that may be initials; low: nobody to compare; zero: others."""
    split = lambda c: F.filter(F.split(normalized(c), " "), lambda t: t != "")
    own = F.filter(F.transform(author_names(series_author), split), lambda w: F.size(w) > 0)
    theirs = F.filter(F.transform(F.coalesce(candidates, F.array().cast("array<string>")), split), lambda w: F.size(w) > 0)
    same = lambda w, o: F.array_sort(F.array_distinct(w)) == F.array_sort(F.array_distinct(o))
    surname = lambda w: F.element_at(w, -1)
    given = lambda w: F.array_remove(F.array_distinct(w), surname(w))
    exact = lambda own, theirs: F.exists(theirs, lambda w: F.exists(own, lambda o: same(w, o)))
    close = lambda own, theirs: F.exists(theirs, lambda w: F.exists(own, lambda o: (surname(w) == surname(o)) & initials_variant(given(w), given(o))))
    compared = bound(own, theirs, use=lambda x, y: F.when(exact(x, y), "high").when(close(x, y), "medium").otherwise("zero"))
    return F.when(blank(series_author) | (F.size(F.coalesce(candidates, F.array().cast("array<string>"))) == 0), "low").otherwise(compared)
