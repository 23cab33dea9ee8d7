"""Discovered candidates into a library snapshot: an ordered merge per series whose keys grow, two collapses of duplicates, then the sync of reading states.

The merge is ordered by its nature: a candidate that becomes a book can be matched by the next one. Keys, dates and
statuses are native columns; only the order-dependent part, which book a candidate meets and what that book then holds,
is a fold over rows sorted by series, so a series streams through one task and nothing is gathered but its own books.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksight.functions import dates as d
from stacksight.functions import text as t
from stacksight.operators.integrity import healed
from stacksight.operators.intelligence import active, of_own_profile
from stacksight.operators.steps import dealt, kept

#: What a book keeps over a merge and a collapse, and what a keeper takes from a duplicate where it lacks it.
STATE = ("title", "author", "book_number", "isbn13", "asin", "publication_date", "release_date", "edition", "metadata_source", "read_status", "record_status", "is_read", "is_missing", "is_upcoming_auto", "is_upcoming_final")
TAKEN_OVER = ("release_date", "publication_date", "isbn13")
KINDS = {"book_number": "double", "publication_date": "date", "release_date": "date"} | dict.fromkeys(("is_read", "is_missing", "is_upcoming_auto", "is_upcoming_final"), "boolean")
FIELDS = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in STATE)
#: An event is a candidate's outcome (action not null) or a book as the merge leaves it.
EVENTS = f"series_id long, hit_pos long, hit_title string, action string, reason string, coming boolean, book_id long, moved boolean, {FIELDS}"
#: A new book's id is minus the hit_pos that it came with, shifted so that hits of a series with one hit_pos stay apart.
SAME_HIT_BITS = 6


def arriving(hits: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """Hits by the series' own author with their keys, date and status; hits without title are none."""
    of = series.select("series_id", "profile_id", F.col("name").alias("series_name"), F.col("author").alias("series_author"))
    # the day is read once, by all that depends on it
    rows = hits.join(of, "series_id").where(t.same_author(F.col("author"), F.col("series_author")) & ~t.blank(F.col("title"))).withColumn("day", d.flexible_date(F.col("published_date")))
    day, said = F.col("day"), F.lower(F.col("title"))
    coming = F.coalesce(F.col("upcoming_hint"), F.lit(False)) | reduce(lambda a, b: a | b, (said.contains(w) for w in ("upcoming", "preorder", "pre-order"))) | F.coalesce(day > F.lit(as_of).cast("date"), F.lit(False))
    own = F.coalesce(t.filled(F.col("series_name_hint")), F.col("series_name"))
    rows = rows.select(
        "series_id", "profile_id", "hit_pos", F.trim("title").alias("title"), "author", F.upper(t.filled(F.col("isbn13"))).alias("identifier"), t.series_book_key(own, F.col("series_number_hint")).alias("number_key"),
        t.series_book_key(F.col("series_name"), F.col("series_number_hint")).alias("own_number_key"), t.title_key(F.col("title")).alias("title_key"),
        F.col("series_number_hint").alias("book_number"), day.alias("publication_date"), F.when(coming & (day > F.lit(as_of).cast("date")), day).alias("release_date"), coming.alias("coming"), t.edition_from_title(F.col("title")).alias("edition"),
    )
    return rows.withColumn("plain", F.when(F.coalesce("identifier", "number_key", "title_key").isNull(), t.discovered_title_key(F.col("title"))))


def shelved(books: DataFrame, series: DataFrame) -> DataFrame:
    """Active books of a series in its profile, with the keys by which candidates find them."""
    own = of_own_profile(books.where(active() & F.col("series_id").isNotNull()), series).join(series.select("series_id", F.col("name").alias("series_name")), "series_id")
    return own.select("series_id", "book_id", *(F.col(c).cast(KINDS.get(c, "string")).alias(c) for c in STATE), F.upper(t.filled(F.col("isbn13"))).alias("identifier"), t.series_book_key(F.col("series_name"), F.col("book_number")).alias("number_key"), t.title_key(F.col("title")).alias("title_key"))


RANKS = dict(t.EDITION_RANKS)
#: What a fold reads of a row beside the state: a book's keys, and of a candidate what it brings. `plain` stands only where no other key does.
READ = ("series_id", "arrives", "book_id", "hit_pos", "coming", "identifier", "number_key", "own_number_key", "title_key", "plain")
#: The places of the fields in a state.
TITLE, AUTHOR, NUMBER, ISBN, _, PUBLISHED, RELEASED, EDITION, SOURCE, STATUS, RECORD, IS_READ, MISSING, AUTO, FINAL = range(len(STATE))
#: The state of which outcomes alone depend, beside the title that they show.
FOR_OUTCOMES = ("title", "read_status", "is_upcoming_auto", "is_upcoming_final")


def _rank(edition: str | None) -> int:
    return RANKS.get((edition or "").strip().lower(), 1)


def _refresh(book: list, hit: list, coming: bool | None) -> bool:
    """What a matched book takes from a candidate, whose ISBN is its identifier; whether it went from upcoming to available."""
    was = (book[STATUS] or "").strip().lower() == "upcoming" or bool(book[AUTO]) or bool(book[FINAL])
    book[TITLE], book[AUTHOR], book[SOURCE], book[RECORD], book[MISSING] = hit[TITLE], hit[AUTHOR], "discovery", "active", False
    book[ISBN] = hit[ISBN] or book[ISBN]
    if hit[NUMBER] is not None and not (book[NUMBER] or 0) > 0:
        book[NUMBER] = hit[NUMBER]
    if hit[PUBLISHED] is not None:
        book[PUBLISHED] = hit[PUBLISHED] if book[PUBLISHED] is None else min(book[PUBLISHED], hit[PUBLISHED])
    if book[RELEASED] is None:
        book[RELEASED] = hit[RELEASED]
    if _rank(hit[EDITION]) > _rank(book[EDITION]):
        book[EDITION] = hit[EDITION]
    if coming:
        book[STATUS], book[AUTO] = "upcoming", True
    elif (book[STATUS] or "").strip().lower() != "read":
        book[STATUS], book[AUTO] = "available", False
    return was and not coming


def _new(hit: list, coming: bool | None) -> list:
    known = hit[EDITION] if hit[EDITION] != "unknown" else None
    return [hit[TITLE], hit[AUTHOR], hit[NUMBER], hit[ISBN], None, hit[PUBLISHED], hit[RELEASED], known, "discovery", "upcoming" if coming else "available", "active", False, False, coming, False]


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "date": pa.date32()}
_EVENTS = pa.schema([(n, _ARROW[k]) for n, k in (f.split() for f in EVENTS.split(", "))])


def _events(columns: dict[str, list]) -> pa.RecordBatch:
    """Columns as a batch of EVENTS; those that are not given are null, dates are days."""
    n = len(columns["series_id"])
    of = lambda f: pa.nulls(n, f.type) if f.name not in columns else pa.array(columns[f.name], pa.int32()).cast(f.type) if f.type == pa.date32() else pa.array(columns[f.name], f.type)
    return pa.RecordBatch.from_arrays([of(f) for f in _EVENTS], schema=_EVENTS)


def _values(batch: pa.RecordBatch, name: str) -> list:
    """A column's values, dates as days, nulls where the rows have no such column."""
    if name not in batch.schema.names:
        return [None] * batch.num_rows
    c = batch.column(name)
    return (c.cast(pa.int32()) if c.type == pa.date32() else c).to_pylist()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by series, books before candidates. A candidate updates the book it meets by a key, else it becomes a book whose keys count from there on, unless its fingerprint was there before.

    Columns are read and written whole, and a book is put out when its series ends; rows without an author ask for outcomes only, and get no books.
    """
    series, states = None, False
    by_identifier, by_number, by_title, seen, books, changed = {}, {}, {}, set(), {}, {}
    told = ("series_id", "hit_pos", "hit_title", "action", "reason", "coming", "book_id", "moved")

    for batch in batches:
        states = "author" in batch.schema.names
        out, left = [], []
        for (of, arrives, book_id, hit_pos, coming, identifier, number_key, own_key, title_key, plain), state in zip(zip(*(_values(batch, c) for c in READ)), zip(*(_values(batch, c) for c in STATE))):
            if of != series:
                if states:
                    left += [(series, i, *b) for i, b in changed.items()]
                series, by_identifier, by_number, by_title, seen, books, changed = of, {}, {}, {}, set(), {}, {}
            if not arrives:
                books[book_id] = state
                for keys, key in ((by_identifier, identifier), (by_number, number_key), (by_title, title_key)):
                    if key is not None:
                        keys.setdefault(key, book_id)
                continue
            reason = moved = None
            if identifier is not None and identifier in by_identifier:
                book, reason = by_identifier[identifier], "identifier"
            elif number_key is not None and number_key in by_number:
                book, reason = by_number[number_key], "series_number"
            elif title_key is not None and title_key in by_title:
                book, reason = by_title[title_key], "title"
            fingerprint = identifier or number_key or title_key or plain
            hit = (*state[:ISBN], identifier, *state[ISBN + 1 :])
            if reason:
                action = "update"
                if book not in changed:
                    changed[book] = list(books[book])
                moved = _refresh(changed[book], hit, coming)
            elif fingerprint in seen:
                action, book = "skip", None
            else:
                action, book = "insert", -1 - (hit_pos << SAME_HIT_BITS)
                while book in books:
                    book -= 1
                books[book] = changed[book] = _new(hit, coming)
                for keys, key in ((by_identifier, identifier), (by_number, own_key), (by_title, title_key)):
                    if key is not None:
                        keys[key] = book
            seen.add(fingerprint)
            out.append((of, hit_pos, state[TITLE], action, reason, coming, book, moved))
        if out:
            yield _events(dict(zip(told, map(list, zip(*out)))))
        if left:
            yield _events(dict(zip(("series_id", "book_id", *STATE), map(list, zip(*left)))))
    if states and changed:
        yield _events(dict(zip(("series_id", "book_id", *STATE), map(list, zip(*((series, i, *b) for i, b in changed.items()))))))


def merged(hits: DataFrame, books: DataFrame, series: DataFrame, as_of: str, states: bool = True) -> DataFrame:
    """EVENTS: the outcome of every candidate in order of hit_pos and title, and every book that changed or is new (its book_id is then below zero). Without `states` outcomes only, of which less goes through the fold."""
    come = arriving(hits, series, as_of).withColumn("arrives", F.lit(True))
    # books of series without candidates pass through the fold and leave nothing: cheaper than reading all hits once more to leave them out
    have = shelved(books, series).withColumn("arrives", F.lit(False))
    used = STATE if states else FOR_OUTCOMES
    if not states:
        have = have.select("series_id", "arrives", "book_id", "identifier", "number_key", "title_key", *FOR_OUTCOMES)
    rows = have.unionByName(come.drop("profile_id"), allowMissingColumns=True)
    rows = dealt(rows, "series_id").sortWithinPartitions("series_id", "arrives", "book_id", "hit_pos", "title", "author", "identifier", "number_key", "book_number", "publication_date", "coming")
    return rows.select(*READ, *used).mapInArrow(_merge, EVENTS)


def actions(events: DataFrame) -> DataFrame:
    """hit_pos, series_id, title, book_id, reason, action of each candidate."""
    return events.where("action is not null").select("hit_pos", "series_id", F.col("hit_title").alias("title"), F.when(F.col("action") == "update", F.col("book_id")).alias("book_id"), "reason", "action")


def written(events: DataFrame) -> DataFrame:
    return events.where("action is null").select("series_id", "book_id", *STATE)


def snapshot(books: DataFrame, events: DataFrame) -> DataFrame:
    """The library after the merge: books that no candidate met as they are, the others as it left them, new ones beside them."""
    new = written(events)
    rest = books.join(new.select("book_id"), "book_id", "left_anti").select("series_id", "book_id", *(F.col(c).cast(KINDS.get(c, "string")).alias(c) for c in STATE))
    return rest.unionByName(new)


def job_delta(events: DataFrame) -> DataFrame:
    """What a job brought each series: books inserted, of these not upcoming, and books that went from upcoming to available."""
    own = events.where("action is not null").groupBy("series_id").agg(F.count_if(F.col("action") == "insert").alias("new_books"), F.count_if((F.col("action") == "insert") & ~F.col("coming")).alias("inserted"), F.count_if("moved").alias("moved"))
    return own.select("series_id", "new_books", "inserted", "moved", (F.col("inserted") + F.col("moved")).alias("delta"))


def collapsed(books: DataFrame, key: Column, by_identifier: bool = False, identifier: str = "asin") -> DataFrame:
    """Duplicates by (series, key): the fields of the book kept, and which others go.

    An ordered fold, not a maximum: of two books the one with the higher score stays (read, edition, dated; before them
    the identifier, where asked), the earlier one on a tie; it takes over what it lacks, and is compared with the next
    book as it then is. Books of one key in one series are few, so the fold runs over an array in the JVM.
    """
    score = lambda b: F.struct(*([(~t.blank(b[identifier])).cast("int")] if by_identifier else []), b["is_read"].cast("int"), t.edition_rank(b["edition"]), b["publication_date"].isNotNull().cast("int"))
    entry = F.struct((F.col("book_id") < 0).alias("new"), F.abs("book_id").alias("ord"), "book_id", d.flag(F.col("is_read")).alias("is_read"), *(F.col(c) for c in dict.fromkeys((*TAKEN_OVER, "edition", "read_status", identifier))))
    groups = books.where(active() & F.col("series_id").isNotNull() & key.isNotNull()).groupBy("series_id", key.alias("key")).agg(F.array_sort(F.collect_list(entry)).alias("rows")).where("size(rows) > 1")

    def step(keeper: Column, other: Column) -> Column:
        wins = score(other) > score(keeper)
        either = lambda c: F.when(wins, other[c]).otherwise(keeper[c])
        filled = lambda c: F.when(wins, F.coalesce(other[c], keeper[c])).otherwise(F.coalesce(keeper[c], other[c]))
        read, loser_read = either("is_read"), F.when(wins, keeper["is_read"]).otherwise(other["is_read"])
        own = {c: either(c) for c in ("new", "ord", "book_id", "edition", identifier)} | {c: filled(c) for c in TAKEN_OVER}
        own |= {"is_read": read | loser_read, "read_status": F.when(loser_read & ~read, "read").otherwise(either("read_status"))}
        return F.struct(*(own[c].alias(c) for c in ("new", "ord", "book_id", "is_read", *dict.fromkeys((*TAKEN_OVER, "edition", "read_status", identifier)))))

    keeper = F.aggregate(F.slice("rows", F.lit(2), F.size("rows") - 1), F.get("rows", F.lit(0)), step)
    return groups.select("series_id", "key", keeper.alias("kept"), F.transform("rows", lambda r: r["book_id"]).alias("members"))


def after_collapse(books: DataFrame, groups: DataFrame) -> DataFrame:
    """The snapshot with keepers filled up and the others of their groups deleted; those keep their own fields."""
    each = groups.select("series_id", F.explode("members").alias("book_id"), "kept").select("series_id", "book_id", F.col("kept.book_id").alias("stays"), *(F.col(f"kept.{c}").alias(f"kept_{c}") for c in (*TAKEN_OVER, "read_status", "is_read")))
    mine = F.col("stays") == F.col("book_id")
    out = books.join(each, ["series_id", "book_id"], "left").withColumns({c: F.when(mine, F.coalesce(F.col(f"kept_{c}"), F.col(c))).otherwise(F.col(c)) for c in (*TAKEN_OVER, "read_status", "is_read")})
    out = out.withColumn("record_status", F.when(F.col("stays") != F.col("book_id"), "deleted").otherwise(F.col("record_status")))
    return out.drop("stays", *(f"kept_{c}" for c in (*TAKEN_OVER, "read_status", "is_read")))


def number_key(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books with the key of their series' name and number."""
    return books.join(series.select("series_id", F.col("name").alias("series_name")), "series_id", "left").withColumn("number_key", t.series_book_key(F.col("series_name"), F.col("book_number"))).drop("series_name")


def identity_key(identifier: str = "asin") -> Column:
    return F.coalesce(F.upper(t.filled(F.col(identifier))), F.col("number_key"), t.title_key(F.col("title")))


def job(hits: DataFrame, books: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """The whole job on the series that candidates arrived for: merge, collapse by identity, collapse by number whatever the identifiers, sync of reading states.

    The identifier of candidates is their isbn13, so books are told by it as well. Other series stay as they are.
    """
    events = kept(merged(hits, books, series, as_of))
    touched = events.where("action is not null").select("series_id").distinct()
    rows = number_key(snapshot(books, events).join(touched, "series_id", "left_semi"), series)
    rows = kept(after_collapse(rows, collapsed(rows, identity_key("isbn13"), identifier="isbn13")))
    rows = after_collapse(rows, collapsed(rows, F.col("number_key"), by_identifier=True, identifier="isbn13"))
    sync = healed(rows.where(active()), as_of, ("series_id", "book_id")).select("series_id", "book_id", *(F.col(c).alias(f"new_{c}") for c in ("read_status", "is_missing", "is_upcoming_auto", "is_upcoming_final")))
    rows = rows.drop("number_key").join(sync, ["series_id", "book_id"], "left")
    flags = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in ("read_status", "is_missing", "is_upcoming_auto", "is_upcoming_final")}
    return rows.withColumns(flags).select("series_id", "book_id", *STATE)

