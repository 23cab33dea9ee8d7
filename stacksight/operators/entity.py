"""Candidate hits of several catalogs to one entity per book: fuse, score, collapse editions, filter, compare with what is owned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.operators import telemetry
from stacksight.operators.intelligence import active, expected_gaps, first_numbers
from stacksight.operators.steps import kept
from stacksight.operators.telemetry import Passes

# The order in which providers are trusted, and what each adds to the confidence of a fused candidate.
PROVIDERS = (("hardcover", 0.4), ("google_books", 0.3), ("openlibrary", 0.25), ("web_search", 0.15))
OTHER_WEIGHT, BONUS, NO_SERIES = 0.1, 0.1, 0.05
COMPLETENESS_FIELDS = 7
LEAST_COMPLETENESS, LEAST_CONFIDENCE = 0.5, 0.35
LOOKAHEAD = 6
SERIES_HINT_LIMIT = 25


def provider_rank(source: Column) -> Column:
    out = F.lit(len(PROVIDERS))
    for k, (name, _) in enumerate(PROVIDERS):
        out = F.when(source == name, F.lit(k)).otherwise(out)
    return out


def provider_weight(source: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in PROVIDERS:
        out = F.when(source == name, F.lit(weight)).otherwise(out)
    return out


def hit_key() -> Column:
    """An ISBN, else the core title with its number, else the normalised title."""
    return F.coalesce(t.filled(F.col("isbn13")), t.unless_empty(t.core_title_key(F.col("title"))), t.normalized(F.col("title")))


def fused(hits: DataFrame, series: DataFrame) -> DataFrame:
    """One candidate per series and key: fields of the most trusted hit, filled up from the others, with confidence and completeness.

    A group's rows stand in order, so a field is the first that is allowed to give one, and the first row stays: one sort
    instead of a comparison of whole orders for each field. Nothing is gathered but a group's sources and series names.
    """
    of = series.select("series_id", F.col("name").alias("target"), F.coalesce("author", F.lit("")).alias("target_author"))
    # dealt by series once, which serves the join and the groups
    rows = hits.where(~t.blank(F.col("title"))).repartition("series_id").join(of, "series_id").withColumns({"key": hit_key(), "r": provider_rank(F.col("source"))})
    rows = rows.withColumns({"by_author": t.author_matches(F.array("author"), F.col("target_author")), "brand": F.when(F.col("series_name_hint").isNotNull(), t.branding_name(F.col("series_name_hint")))})
    ordered = Window.partitionBy("series_id", "target", "target_author", "key").orderBy("r", "hit_pos", "title", "published_date")
    group, has = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), lambda c: ~t.blank(F.col(c))
    first = lambda c, allowed: F.first(F.when(allowed, F.col(c)), ignorenulls=True).over(group)
    english = F.first(F.when(t.is_english_or_unknown(F.col("language")), F.struct("language")), ignorenulls=True).over(group)["language"]  # it may be null
    told = {
        "nth": F.row_number().over(ordered), "author": F.coalesce(first("author", F.col("by_author")), "author"), "author_match": F.bool_or("by_author").over(group), "language": F.coalesce(english, "language"),
        "isbn13": F.max("isbn13").over(group), "published_date": first("published_date", has("published_date")), "series_name_hint": first("series_name_hint", has("series_name_hint")),
        "series_number_hint": first("series_number_hint", F.coalesce(F.col("series_number_hint") != 0, F.lit(False))), "series_total_hint": first("series_total_hint", F.col("series_total_hint").isNotNull()),
        "upcoming_hint": first("upcoming_hint", F.col("upcoming_hint").isNotNull()), "sources": F.collect_set("source").over(group), "brands": F.collect_set("brand").over(group), "n_hits": F.count(F.lit(1)).over(group),
    }
    start = F.struct("r", "hit_pos", "title", "published_date").alias("first")
    groups = rows.select("series_id", "target", "target_author", "key", start, "title", *(c.alias(name) for name, c in told.items())).where("nth = 1").drop("nth").withColumn("sources", F.array_sort("sources"))
    weights = F.aggregate("sources", F.lit(0.0), lambda a, s: a + provider_weight(s))
    # a name is compatible with itself but where nothing of it is left
    several = (F.size("brands") > 1) | F.array_contains("brands", "")
    disagree = several & F.exists("brands", lambda a: F.exists(F.col("brands"), lambda b: ~t.brands_compatible(a, b)))
    plus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    named = ~t.blank(F.col("series_name_hint"))
    score = (
        weights + plus(F.size("sources") > 1, BONUS) + plus(F.col("isbn13").isNotNull(), BONUS) + plus(F.col("author_match"), BONUS) - plus(disagree, BONUS)
        - F.when(~named, F.lit(NO_SERIES)).when(~t.series_names_compatible(F.col("series_name_hint"), F.col("target")), F.lit(BONUS)).otherwise(F.lit(0.0))
    )
    present = [~t.blank(F.col(c)) for c in ("title", "author", "series_name_hint", "isbn13", "published_date")] + [F.col("series_number_hint").isNotNull()]
    complete = sum((p.cast("int") for p in present), F.lit(0)) / COMPLETENESS_FIELDS
    return groups.withColumns({"confidence": F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4), "completeness": F.round(complete, 4)}).drop("brands")


def editions_collapsed(candidates: DataFrame) -> DataFrame:
    """Of candidates that are one book by title and number, only the best where one is better than every other: as good on edition, completeness and confidence, and better on one.

    Candidates without number go with every number of their title.
    """
    rows = candidates.withColumns({"book": F.coalesce(t.title_key(F.col("title")), F.col("key")), "edition": t.edition_rank(t.edition_from_title(F.col("title")))})
    by = Window.partitionBy("series_id", "book")
    rows = rows.withColumn("numbers", F.size(F.collect_set("series_number_hint").over(by)))
    rows = rows.withColumn("group", F.when(F.col("numbers") > 1, F.coalesce("series_number_hint", F.lit(-1.0))).otherwise(F.lit(-1.0)))
    one = Window.partitionBy("series_id", "book", "group")
    best = lambda c: F.max(c).over(one)
    top = (F.col("edition") == best("edition")) & (F.col("completeness") == best("completeness")) & (F.col("confidence") == best("confidence"))
    rows = rows.withColumns({"top": top, "members": F.count(F.lit(1)).over(one)})
    rows = rows.withColumn("tops", F.count_if("top").over(one))
    return rows.where("members = 1 or tops <> 1 or top").drop("numbers", "group", "top", "tops", "members")


def fit_for_series(c: DataFrame) -> Column:
    """The filters of a candidate: author, a real and new title, language, and no entry for the series itself."""
    title, hint = F.col("title"), F.col("series_number_hint")
    named = F.coalesce(F.col("target"), F.col("series_name_hint"), t.series_hint(title))
    has_number = F.coalesce(hint != 0, F.lit(False)) | t.inferred_number(title, F.col("target")).isNotNull()
    return (
        F.col("author_match") & ~t.is_not_new_release(title) & ~t.is_placeholder_title(title) & t.is_english_or_unknown(F.col("language"))
        & ~t.is_series_index_entry(title, named, F.col("isbn13"), has_number) & ~t.is_series_variant(title, named, F.col("isbn13"), hint)
    )


def filtered(candidates: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates that are fit, whose title is not among the excluded (series_id, title_key), the first of each key."""
    rows = candidates.where(fit_for_series(candidates)).withColumn("title_key", t.core_title_key(F.col("title")))
    if excluded is not None:
        rows = rows.join(excluded.select("series_id", "title_key"), ["series_id", "title_key"], "left_anti")
    return rows


def lineup_means(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """(series_id, completeness, mean_confidence) of each series with candidates: the share of whole numbers known up to the highest, told by candidates and the highest owned book (1 where none is known), and the candidates' mean confidence."""
    n = F.when(F.coalesce(F.col("series_number_hint") != 0, F.lit(False)), F.col("series_number_hint")).otherwise(t.inferred_number(F.col("title"), F.col("target")))
    rows = candidates.select("series_id", F.when(n == F.floor(n), n.cast("bigint")).alias("n"), "confidence")
    top = books.where(active() & F.col("series_id").isNotNull() & ~d.flag(F.col("is_missing"))).groupBy("series_id").agg(F.max(F.floor("book_number")).cast("bigint").alias("top")).where("top > 0")
    told = rows.groupBy("series_id").agg(F.collect_set("n").alias("numbers"), F.avg("confidence").alias("mean")).join(top, "series_id", "left")
    known = F.array_union("numbers", F.when(F.col("top").isNotNull(), F.array("top")).otherwise(F.array().cast("array<bigint>")))
    return told.select("series_id", F.coalesce(F.try_divide(F.size(known), F.array_max(known)), F.lit(1.0)).alias("completeness"), F.col("mean").alias("mean_confidence"))


def gate(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """lineup_means rounded, and whether the search by author is needed as well."""
    thin = (F.col("completeness") < LEAST_COMPLETENESS) | (F.col("mean_confidence") < LEAST_CONFIDENCE)
    return lineup_means(candidates, books).select("series_id", F.round("completeness", 6).alias("completeness"), F.round(F.col("mean_confidence") + 1e-9, 3).alias("mean_confidence"), thin.alias("fallback"))


def of_other_series(candidates: DataFrame) -> DataFrame:
    """Candidates whose hint names another series than the one searched for."""
    return candidates.where(named_otherwise())


def named_otherwise() -> Column:
    """Whether a hint names another series than the target."""
    return ~t.blank(F.col("series_name_hint")) & ~t.series_names_compatible(F.col("series_name_hint"), F.col("target"))


#: Sources whose search is for the series itself; the others are asked where those leave a series thin.
TARGETED = ("hardcover", "google_books")


def discovered(hits: DataFrame, series: DataFrame, books: DataFrame, excluded: DataFrame | None = None, passes: Passes | None = None) -> DataFrame:
    """Candidates of every series in two passes: (series_id, key, title, series_number_hint, confidence, tier, place).

    The targeted pass fuses what the sources that are searched for the series have, collapses editions and filters.
    A series whose lineup is then incomplete or of low confidence, or empty, gets the fallback pass: hits of the other
    sources, but for those that name another series, go through the same steps, and add titles that are not there yet.
    Both passes are counted while they run (`passes`), by hits, fused candidates and candidates kept.
    """
    passes = passes or Passes()
    names = series.select("series_id", F.col("name").alias("target"))
    is_targeted = F.col("source").isin(*TARGETED)
    first = passes.watch(hits.where(is_targeted), "targeted", hits=telemetry.rows())
    found = kept(passes.watch(fused(first, series), "targeted", candidates=telemetry.rows()))
    wide = gate(found, books).where(~F.col("fallback")).select("series_id")
    open_series = series.select("series_id").join(wide, "series_id", "left_anti")
    more = hits.where(~is_targeted).join(open_series, "series_id", "left_semi").join(names, "series_id").withColumn("other", named_otherwise())
    more = passes.watch(more, "author_fallback", hits=telemetry.rows(), of_other_series=F.count_if("other")).where("not other").drop("target", "other")
    second = passes.watch(fused(more, series), "author_fallback", candidates=telemetry.rows())
    targeted = filtered(editions_collapsed(found), excluded).withColumn("tier", F.lit("targeted"))
    targeted = kept(passes.watch(targeted, "targeted", kept=telemetry.rows()))
    there = targeted.select("series_id", "title_key").distinct()
    fallback = filtered(editions_collapsed(second), excluded).join(there, ["series_id", "title_key"], "left_anti").withColumn("tier", F.lit("author_fallback"))
    fallback = passes.watch(fallback, "author_fallback", kept=telemetry.rows())
    rows = targeted.unionByName(fallback)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("series_number_hint").asc_nulls_last(), t.normalized(F.col("title")), F.array_min(F.transform("sources", provider_rank)), "tier", "key"))
    return rows.select("series_id", "key", "title", "series_number_hint", "confidence", "tier", place.alias("place"))


def keyed(rows: DataFrame, keep: tuple[str, ...], keys: dict[str, Column]) -> DataFrame:
    """One row for each key that a row has: the columns kept, kind and key. All keys of a table then share one exchange."""
    entries = F.array(*(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in keys.items()))
    return rows.select(*keep, F.explode(F.filter(entries, lambda e: e["key"].isNotNull())).alias("k")).select(*keep, "k.kind", "k.key")


def owned_flags(hits: DataFrame, books: DataFrame, series: DataFrame) -> DataFrame:
    """hit_pos and by which key a hit is owned already: ISBN, title, series and number, or a bare title that only one book has.

    Both sides lay all their keys side by side as (profile, kind, key), so four conditions are one join on equal keys,
    and one aggregate by hit collects what met; an OR of conditions would be a nested loop.
    """
    names = series.select("series_id", F.col("name").alias("series_name"))
    live = books.where(active()).join(names, "series_id", "left")
    known = keyed(live, ("profile_id",), {"isbn": F.col("isbn13"), "title": t.title_key(F.col("title")), "number": t.series_book_key(F.col("series_name"), F.col("book_number")), "bare": t.bare_title_key(F.col("title"))})
    known = known.groupBy("profile_id", "kind", "key").agg(F.count(F.lit(1)).alias("n")).where("kind <> 'bare' or n = 1").select("profile_id", "kind", "key", F.lit(True).alias("met"))
    rows = hits.join(series.select("series_id", "profile_id", F.col("name").alias("series_name")), "series_id").select("hit_pos", "profile_id", "title", "isbn13", "series_name", "series_number_hint", F.monotonically_increasing_id().alias("row"))
    # a hit without any key still has a row, so that it is told
    asked = {
        "isbn": F.col("isbn13"), "title": t.title_key(F.col("title")), "number": t.series_book_key(F.col("series_name"), F.col("series_number_hint")),
        "bare": F.when(F.col("series_number_hint").isNull(), t.bare_title_key(F.col("title"))), "none": F.lit(""),
    }
    met = keyed(rows, ("hit_pos", "profile_id", "row"), asked).join(known, ["profile_id", "kind", "key"], "left")
    by = {"by_isbn": "isbn", "by_title": "title", "by_number": "number", "by_bare_title": "bare"}
    flags = met.groupBy("row", "hit_pos").agg(*(F.coalesce(F.bool_or(F.col("met") & (F.col("kind") == kind)), F.lit(False)).alias(name) for name, kind in by.items()))
    return flags.select("hit_pos", *by, (F.col("by_isbn") | F.col("by_title") | F.col("by_number") | F.col("by_bare_title")).alias("owned"))


def matched(hits: DataFrame, books: DataFrame, series: DataFrame) -> DataFrame:
    """The hits' columns with book_id and reason: the book a hit updates, by the first of identifier (its isbn13), series and number, title; of several books with a key the first.

    All keys of a series meet in one join, and the best of a hit's matches is one minimum.
    """
    names = series.select("series_id", F.col("name").alias("series_name"))
    keys = lambda n: {"0identifier": F.col("isbn13"), "1series_number": t.series_book_key(F.col("series_name"), F.col(n)), "2title": t.title_key(F.col("title"))}
    live = books.where(active() & F.col("series_id").isNotNull()).join(names, "series_id")
    first = keyed(live, ("series_id", "book_id"), keys("book_number")).groupBy("series_id", "kind", "key").agg(F.min("book_id").alias("book_id"))
    rows = hits.join(names, "series_id").select("hit_pos", "series_id", "isbn13", "title", "series_name", "series_number_hint", F.monotonically_increasing_id().alias("row"))
    met = keyed(rows, ("row", "hit_pos", "series_id", "title"), keys("series_number_hint") | {"none": F.lit("")}).join(first, ["series_id", "kind", "key"], "left")
    best = met.groupBy("row", "hit_pos", "series_id", "title").agg(F.min(F.when(F.col("book_id").isNotNull(), F.struct("kind", "book_id"))).alias("best"))
    return best.select("hit_pos", "series_id", "title", F.col("best.book_id").alias("book_id"), F.substring("best.kind", 2, 20).alias("reason"))


def author_identities(books: DataFrame, series: DataFrame) -> DataFrame:
    """(profile_id, author, kind, key, series_id): what a profile owns of an author, whatever the way the name is written. kind is isbn, title (with its number), bare (that one book alone has), number (within its series), or tracked (a series' branding name)."""
    author = t.author_identity(F.col("author"))
    live = books.where(active() & (author != "")).withColumn("author", author)
    held = keyed(live.withColumn("own", F.col("series_id")), ("profile_id", "author", "own"), {"isbn": t.filled(F.col("isbn13")), "title": F.nullif(t.core_title_key(F.col("title")), F.lit("")), "bare": F.nullif(t.bare_title_key(F.col("title")), F.lit("")), "number": F.when(F.col("series_id").isNotNull() & F.col("book_number").isNotNull(), t.number_text(F.col("book_number")))})
    held = held.withColumn("series_id", F.when(F.col("kind") == "number", F.col("own"))).groupBy("profile_id", "author", "kind", "key", "series_id").agg(F.count(F.lit(1)).alias("n")).where("kind <> 'bare' or n = 1").drop("n")
    tracked = series.where(author != "").groupBy("profile_id", author.alias("author"), t.branding_name(F.col("name")).alias("key")).agg(F.max("series_id").alias("series_id"))
    return held.unionByName(tracked.withColumn("kind", F.lit("tracked")))


def dates_backfilled(hits: DataFrame) -> DataFrame:
    """Hits without a date take that of a dated hardcover hit of the series: same ISBN, else same title and author."""
    dated = hits.where((F.col("source") == "hardcover") & d.flexible_date(F.col("published_date")).isNotNull())
    by_isbn = dated.where("isbn13 is not null").groupBy("series_id", "isbn13").agg(F.min_by("published_date", F.struct("hit_pos", "published_date")).alias("d1"))
    by_title = dated.groupBy("series_id", "author", t.title_key(F.col("title")).alias("title_key")).agg(F.min_by("published_date", F.struct("hit_pos", "published_date")).alias("d2"))
    lacking = hits.where(t.blank(F.col("published_date"))).withColumn("title_key", t.title_key(F.col("title")))
    rows = lacking.join(by_isbn, ["series_id", "isbn13"], "left").join(by_title, ["series_id", "author", "title_key"], "left")
    return rows.select("hit_pos", "title", F.coalesce("d1", "d2").alias("published_date")).where("published_date is not null")


def hints_enriched(hits: DataFrame) -> DataFrame:
    """Hits without a series name take the only one that siblings with the same bare title have."""
    bare = t.bare_title_key(F.col("title")).alias("bare")
    named = hits.where(~t.blank(F.col("series_name_hint"))).groupBy("author", bare).agg(F.count_distinct("series_name_hint").alias("n"), F.min("series_name_hint").alias("hint")).where("n = 1")
    return hits.where(t.blank(F.col("series_name_hint"))).select("hit_pos", "author", "title", bare).join(named, ["author", "bare"]).select("hit_pos", "title", F.col("hint").alias("series_name_hint"))


def missing_slots(books: DataFrame, hits: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """Numbers up to the expected total that neither books nor hits have, the first `ahead` of each series."""
    have = books.where(active() & (F.col("book_number") > 0)).select("series_id", F.floor("book_number").alias("n")).unionByName(hits.where("series_number_hint > 0").select("series_id", F.floor("series_number_hint").alias("n")))
    total = hits.groupBy("series_id").agg(F.max("series_total_hint").alias("expected")).where("expected is not null")
    rows = expected_gaps(total, have.where("series_id is not null"))
    return rows.where("size(gaps) > 0").select("series_id", first_numbers(F.col("gaps"), ahead).alias("slots"))


def find(books: DataFrame, hits: DataFrame, top: int = 6, per_provider: int = 3) -> DataFrame:
    """For each book the best candidates among the hits of its series: rank, key, confidence (high, medium, low) and its signals."""
    few = hits.withColumn("nth", F.row_number().over(Window.partitionBy("series_id", "source").orderBy("hit_pos", "title", "isbn13"))).where(F.col("nth") <= per_provider)
    key = t.group_key(F.col("isbn13"), F.col("title"))
    latest = few.groupBy("series_id", key.alias("key"), "source").agg(F.max_by(F.struct("title", "author", "isbn13"), F.struct("hit_pos", "title")).alias("hit"), F.min("hit_pos").alias("first"))
    rank = provider_rank(F.col("source"))
    groups = latest.groupBy("series_id", "key").agg(F.min_by("hit.title", rank).alias("title"), F.max("hit.isbn13").alias("isbn13"), F.collect_set("hit.author").alias("authors"), F.count(F.lit(1)).alias("n_providers"), F.min("first").alias("first"))
    pairs = books.select("book_id", "series_id", F.col("title").alias("wanted"), F.col("author").alias("wanted_author")).join(groups, "series_id")
    by_author, by_isbn, by_title = t.author_matches(F.col("authors"), F.col("wanted_author")), F.col("isbn13").isNotNull(), F.coalesce(t.title_key(F.col("title")).isin(t.title_key(F.col("wanted")), t.title_key(t.core_segment(F.col("wanted")))), F.lit(False))
    rows = pairs.withColumns({"author_match": by_author, "isbn_present": by_isbn, "strong_title_match": by_title})
    signals = F.col("author_match").cast("int") + F.col("isbn_present").cast("int") + F.col("strong_title_match").cast("int")
    rows = rows.withColumn("tier", F.greatest(signals, F.lit(1)))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("tier"), F.desc("n_providers"), "first", "key"))
    name = F.when(F.col("tier") == 3, "high").when(F.col("tier") == 2, "medium").otherwise("low")
    return rows.withColumn("rank", place).where(F.col("rank") <= top).select("book_id", "rank", "key", "title", "isbn13", "author_match", "isbn_present", "strong_title_match", name.alias("confidence"))


def bound(books: DataFrame, found: DataFrame) -> DataFrame:
    """Books with the gaps filled from their best candidate of high or medium confidence, and the provenance of that."""
    best = found.where("rank = 1").select("book_id", F.col("isbn13").alias("found_isbn"), F.col("title").alias("found_title"), "confidence")
    take = F.col("confidence").isin("high", "medium")
    out = books.join(best, "book_id", "left")
    return out.select("book_id", F.when(take, F.coalesce(t.filled(F.col("isbn13")), F.col("found_isbn"))).otherwise(F.col("isbn13")).alias("isbn13"), F.when(take, F.col("found_title")).alias("canonical_title"), F.when(take, "provider").otherwise(F.col("metadata_source")).alias("metadata_source"), F.coalesce(take, F.lit(False)).alias("resolved"))


def reresolved(books: DataFrame, found: DataFrame) -> DataFrame:
    """What becomes of each book that is resolved again: (book_id, outcome, confidence, canonical_title, metadata_source, needs_reresolution, isbn13).

    The best hit found is bound whatever its confidence (a low one keeps the book in the queue), and fills an ISBN only
    where there is none; a book without hits is left as it is. found: as `find` gives it.
    """
    best = found.where("rank = 1").select("book_id", F.col("isbn13").alias("found_isbn"), F.col("title").alias("found_title"), "confidence")
    rows = books.join(best, "book_id", "left")
    hit = F.col("confidence").isNotNull()
    origin = d.provenance(F.col("confidence"))
    return rows.select(
        "book_id", "profile_id", F.when(hit, "updated").otherwise("no_match").alias("outcome"), "confidence", F.col("found_title").alias("canonical_title"), F.when(hit, origin["metadata_source"]).otherwise(F.col("metadata_source")).alias("metadata_source"),
        F.when(hit, origin["needs_reresolution"]).otherwise(F.col("needs_reresolution")).alias("needs_reresolution"), F.coalesce(t.filled(F.col("isbn13")), "found_isbn").alias("isbn13"),
    )


def worth_checking(hits: DataFrame, books: DataFrame, series: DataFrame, known: DataFrame) -> DataFrame:
    """Per series, whether any hit of its author has a number above all that are owned or known to be missing. known: intelligence with gaps."""
    owned = books.where(active() & F.col("series_id").isNotNull()).groupBy("series_id").agg(F.max("book_number").alias("owned"))
    missing = known.select("series_id", F.try_element_at("gaps", F.lit(-1))["hi"].cast("double").alias("missing"))
    ceiling = missing.join(owned, "series_id", "left").select("series_id", F.coalesce(F.greatest("owned", "missing"), F.lit(0.0)).alias("ceiling"))
    rows = hits.join(series.select("series_id", F.coalesce("author", F.lit("")).alias("target_author")), "series_id").join(ceiling, "series_id", "left")
    news = (F.col("series_number_hint") > F.coalesce("ceiling", F.lit(0.0))) & t.author_matches(F.array("author"), F.col("target_author"))
    return rows.groupBy("series_id").agg(F.bool_or(F.coalesce(news, F.lit(False))).alias("worth"))


# what providers disagree on, and how complete and sure the candidates of a series are
LEAST_SERIES_COMPLETENESS, MOST_DISAGREEMENT = 0.8, 0.2


def reconciliation_needs(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(series_id, candidates, series_completeness, disagreement_ratio, mean_completeness, needs): whether a series' fused candidates leave something to reconcile.

    Its lineup has few of the numbers up to its highest, or the hits of too many candidates disagree on number, ISBN or
    series, or the metadata are thin on average. A single candidate has nothing to be reconciled with.
    """
    members = hits.where(~t.blank(F.col("title"))).withColumns({"key": hit_key(), "brand": t.branding_name(t.filled(F.col("series_name_hint")))})
    per = members.groupBy("series_id", "key").agg(F.count_distinct(F.round("series_number_hint", 2)).alias("numbers"), F.count_distinct(t.filled(F.col("isbn13"))).alias("isbns"), F.collect_set(F.when(~t.blank(F.col("series_name_hint")), F.col("brand"))).alias("brands"))
    names = F.exists("brands", lambda a: F.exists(F.col("brands"), lambda b: ~t.brands_compatible(a, b)))
    per = per.select("series_id", "key", ((F.col("numbers") > 1) | (F.col("isbns") > 1) | ((F.size("brands") > 1) & names)).alias("disagree"))
    n = F.when(F.coalesce(F.col("series_number_hint") != 0, F.lit(False)), F.col("series_number_hint")).otherwise(t.inferred_number(F.col("title"), F.col("target")))
    rows = candidates.withColumn("n", n).join(per, ["series_id", "key"], "left")
    whole = F.when(F.col("n") == F.floor("n"), F.col("n"))
    told = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.try_divide(F.count_distinct(whole), F.max(whole)).alias("share"), F.avg(F.coalesce("disagree", F.lit(False)).cast("double")).alias("ratio"), F.avg("completeness").alias("mean"),
    )
    low = (F.coalesce(F.col("share") < LEAST_SERIES_COMPLETENESS, F.lit(False))) | (F.col("ratio") > MOST_DISAGREEMENT) | (F.col("mean") < LEAST_COMPLETENESS)
    return told.select("series_id", "candidates", F.round("share", 6).alias("series_completeness"), F.round("ratio", 6).alias("disagreement_ratio"), F.round(F.col("mean") + 1e-9, 3).alias("mean_completeness"), ((F.col("candidates") >= 2) & low).alias("needs"))
