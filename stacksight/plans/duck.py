"""DuckDB SQL for the scalar rules, written against the rules and not derived from the column expressions."""

from __future__ import annotations

from stacksight.functions import text as rules

WORDS = {w: k for k, w in enumerate(rules.NUMBER_WORDS, 1)}


def text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def sub(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    q = lambda s: s.replace("'", "''")
    return f"regexp_replace({x}, '{q(pattern)}', '{q(by)}', '{flags}')"


def get(x: str, pattern: str, group: int = 1, flags: str = "") -> str:
    more = f", '{flags}'" if flags else ""
    pattern = pattern.replace("'", "''")
    return f"nullif(regexp_extract({x}, '{pattern}', {group}{more}), '')"


def has(x: str, pattern: str, flags: str = "") -> str:
    more = f", '{flags}'" if flags else ""
    pattern = pattern.replace("'", "''")
    return f"regexp_matches({x}, '{pattern}'{more})"


def filled(x: str) -> str:
    return f"nullif(trim({text(x)}), '')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def number(x: str) -> str:
    return f"CASE WHEN {has(text(x), rules.NUMERIC)} THEN TRY_CAST(trim({text(x)}) AS DOUBLE) END"


def positive(x: str) -> str:
    return f"CASE WHEN ({number(x)}) > 0 THEN ({number(x)}) END"


def number_text(n: str) -> str:
    return f"CASE WHEN {n} IS NULL THEN '' WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END"


def discovered_title(x: str) -> str:
    return sub(f"lower({text(x)})", "[^a-z0-9]+")


def identity(x: str) -> str:
    return f"trim({sub(f'lower({text(x)})', '[^a-z0-9]+', ' ')})"


def author(x: str) -> str:
    return squeeze(sub(sub(identity(x), r"\band\s+\d+\s+more\b"), r"\b(author|narrator|editor)\b"))


def series(x: str) -> str:
    return squeeze(sub(identity(x), r"\b(series|book series)\b"))


def title(x: str) -> str:
    t = f"trim({text(x)})"
    t = sub(t, r"\((?:audible|audible audio|audio cd|kindle|kindle edition|paperback|hardcover|mass market paperback)[^)]*\)", "", "gi")
    t = sub(t, r"\s*[:\-]\s*(?:audible|kindle|paperback|hardcover)\b.*$", "", "gi")
    t = sub(t, r"\s+,\s+book\s+\d+\b", "", "gi")
    t = sub(t, r"\((?:signed|autographed)(?:\s+(?:edition|copy))?\)", "", "gi")
    t = sub(t, r"\s*[:\-]?\s*(?:signed|autographed)(?:\s+(?:edition|copy|by\s+the\s+author))?\s*$", "", "gi")
    return identity(t)


def normalized(x: str) -> str:
    return f"trim({sub(sub(f'replace(lower({text(x)}), {chr(39)}&{chr(39)}, {chr(39)} and {chr(39)})', '[^a-z0-9' + chr(92) + 's]', ' '), chr(92) + 's+', ' ')})"


def no_article(x: str) -> str:
    return sub(x, r"^(?:the|an?)\s+", "", "")


def core(x: str) -> str:
    return f"regexp_split_to_array({text(x)}, '[:,(]|\\s+-\\s+')[1]"


def bare_key(x: str) -> str:
    return no_article(normalized(core(x)))


def branding(x: str) -> str:
    return squeeze(sub(normalized(x), r"\b(?:series|universe|collection|world|saga)\b"))


def context(x: str) -> str:
    t = sub(f"lower({text(x)})", r"(\d)\.(\d)", "\\1~\\2")
    return squeeze(f"replace({sub(t, '[^a-z0-9~' + chr(92) + 's]', ' ')}, '~', '.')")


def word_number(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{w}' THEN {k}" for w, k in WORDS.items()) + " END"


def inferred(x: str) -> str:
    found = [positive(get(text(x), r"#\s*(\d+(?:\.\d+)?)\b"))]
    found += [positive(get(context(x), rf"\b{w}\s*(\d+(?:\.\d+)?)\b")) for w in ("book", "volume", r"vol\.?")]
    found.append(f"CAST({word_number(get(normalized(x), r'\b(?:book|volume|vol\.?)\s+(' + '|'.join(WORDS) + r')\b'))} AS DOUBLE)")
    return f"coalesce({', '.join(found)})"


def core_key(x: str) -> str:
    n = inferred(x)
    return f"{bare_key(x)} || CASE WHEN ({n}) IS NULL THEN '' ELSE ' ' || CAST(CAST(floor({n}) AS BIGINT) AS VARCHAR) END"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({normalized(x)}, ' '), lambda t: t <> ''))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared(a, b)} / CAST(least(len({a}), len({b})) AS DOUBLE) ELSE 0.0 END"


def names(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text(x)}, '(?i)\\s*(?:;|,|&|\\band\\b)\\s*'), lambda n: trim(n)), lambda n: n <> '')"


def cleaned(x: str) -> str:
    t = f"trim({text(x)})"
    for p, by in ((r"\s+ebook\s*$", ""), (r"\s+kindle\s+edition\s*$", ""), (r"\s*\(unabridged\)\s*$", ""), (r":\s*", ": "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s{2,}", " ")):
        t = sub(t, p, by, "gi")
    w = r"(?:epic|fantasy|adventures?|novels?|sagas?|apocalyptic|apocalypse|progression(?:\s+fantasy)?)"
    tail = rf"(?:{w}\s+)*litrpg(?:\s+{w})*:?(\s*(?:\([^)]*\))?\s*)$"
    t = sub(sub(t, rf":\s*(?:an|a)\s+{tail}", ": A LitRPG\\1", "gi"), rf":\s*{tail}", ": LitRPG\\1", "gi")
    return f"trim({sub(f'trim({t})', chr(92) + 's{2,}', ' ')})"


def name_only(x: str) -> str:
    t = cleaned(x)
    bare = f"trim({sub(sub(sub(t, r'\s*:\s*\([^)]*\)\s*$'), r'\s*:\s*.*$'), r'\s+[-–]\s+.*$')})"
    return f"coalesce(nullif({bare}, ''), {t})"


def strict_date(x: str) -> str:
    t = f"trim({text(x)})"
    return f"CASE WHEN {has(t, r'^\d{4}-\d{2}-\d{2}$')} THEN TRY_CAST({t} AS DATE) WHEN {has(t, r'^\d{4}$')} THEN TRY_CAST({t} || '-01-01' AS DATE) END"


def flexible_date(x: str) -> str:
    t = f"trim({text(x)})"
    return f"coalesce({strict_date(x)}, CASE WHEN {has(t, r'^\d{4}-\d{2}$')} THEN TRY_CAST({t} || '-01' AS DATE) END)"


def joined(x: str) -> str:
    """A list as sorted text; empty for none."""
    return f"coalesce(array_to_string(list_sort({x}), ','), '')"


def alignment(candidate: str, target: str) -> str:
    """How a candidate's author fits those of a series: high, medium, low (nobody to compare) or zero."""
    split = lambda x: f"list_filter(string_split({normalized(x)}, ' '), lambda t: t <> '')"
    own = f"list_filter(list_transform({names(target)}, lambda n: {split('n')}), lambda o: len(o) > 0)"
    w = split(candidate)
    given = lambda x: f"list_filter(list_distinct({x}), lambda y: y <> {x}[-1])"
    joined_ = lambda x: f"array_to_string(list_sort({given(x)}), '')"
    a, b = joined_("o"), joined_(w)
    short, long = f"CASE WHEN length({b}) <= length({a}) THEN {b} ELSE {a} END", f"CASE WHEN length({b}) <= length({a}) THEN {a} ELSE {b} END"
    initials = f"(len({given('o')}) = 0 OR len({given(w)}) = 0 OR (length({short}) <= 6 AND starts_with({long}, ({short})[1:1])))"
    return (
        f"CASE WHEN trim({text(target)}) = '' THEN 'low' WHEN len(list_filter({own}, lambda o: list_sort(list_distinct(o)) = list_sort(list_distinct({w})))) > 0 THEN 'high' "
        f"WHEN len({w}) > 0 AND len(list_filter({own}, lambda o: o[-1] = {w}[-1] AND {initials})) > 0 THEN 'medium' ELSE 'zero' END"
    )
