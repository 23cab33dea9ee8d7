"""Operator 12: personal data by fixed patterns, and by a semi-Markov conditional random field beyond them.

The patterns (base spans) find what is written by the book. The field finds what they miss: addresses with `at` and
`dot` in words or brackets, network addresses with guarded dots, card and phone numbers in other groupings. A text is
cut into segments, each an entity of one kind or other text; the score of an entity sums weights of features of the
whole span (grouping, digits, check sum, separators, borders, word before), entities are bounded in length, and one
dynamic program over all candidate segments chooses borders and kinds together. Weights maximise the likelihood of
segmentations of a bounded sample: base spans of the corpus, copies of them rewritten by the rules in `rewritten`, and
everything near them that is no base span as other text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

# The kinds in their order, and the patterns of base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents that the fit looks at (a hash sample), windows with and without base spans among them that it keeps.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 6000, 1200
#: Characters of text around a base span in a training window.
AROUND = 48
#: Bounds of an entity: groups of digits, and characters of a name before the at sign.
GROUPS, NAME = 8, 64
STEPS, RIDGE = 60, 2e-3

ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[Span]:
    """Each at sign with the characters of a name that run up to it, as far as no earlier match has taken them."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        name = len(before) - len(before.rstrip(LOCAL))
        if name and (m := DOMAIN.match(text, at + 1)):
            yield at - name, 0, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Base spans of a text by start, then kind: leftmost matches of each kind that do not overlap; a match that fails its rule is dropped."""
    out = list(_emails(text))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


# An at sign or a dot as itself, in brackets, or as a word between blanks.
_OPEN, _SHUT = r"[(\[{<]", r"[)\]}>]"
_AT = rf" ?(?:@|{_OPEN} ?(?:@|(?i:at)) ?{_SHUT}) ?| (?i:at) "
_DOT = rf"\.| ?{_OPEN} ?(?:\.|(?i:dot)) ?{_SHUT} ?| (?i:dot) "
SIGN = re.compile(_AT)
REST = re.compile(rf"([A-Za-z0-9-]{{1,63}})((?:(?:{_DOT})[A-Za-z0-9-]{{1,63}}){{1,5}})")
LABELS = re.compile(rf"({_DOT})([A-Za-z0-9-]{{1,63}})")
WRITTEN = re.compile(rf"@|{_OPEN} ?(?i:at) ?{_SHUT}| (?i:dot) ")
RUN = re.compile(r"[+(]{0,2}[0-9]+(?:[ .()/\[\]-]{1,3}[0-9]+)*+")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\W\d_]+(?=\W*$)")


@dataclass
class Candidate:
    start: int
    kind: int
    end: int
    features: list[str] = field(default_factory=list)


def _border(text: str, at: int, step: int) -> str:
    """What lies beside a span: the end of the text, a letter or digit, a blank, or the sign itself."""
    at = at - 1 if step < 0 else at
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "word" if c.isalnum() else "blank" if c.isspace() else c


def _beside(text: str, start: int, end: int) -> list[str]:
    word = WORD.search(text, max(0, start - 24), start)
    return [f"left:{_border(text, start, -1)}", f"right:{_border(text, end, 1)}", f"word:{word[0].lower() if word else ''}"]


def _form(sign: str) -> str:
    core = sign.strip()
    return "word" if core.isalpha() else "sign" if len(core) == 1 else "bracket"


def _addresses(text: str, lo: int, hi: int) -> Iterator[Candidate]:
    """Candidates around each written at sign: names that start at the run's start or behind a dot, ends behind every label from the second on."""
    for sign in SIGN.finditer(text, lo, hi):
        rest = REST.match(text, sign.end(), min(hi, sign.end() + 420))
        before = text[max(lo, sign.start() - NAME) : sign.start()]
        name = before[len(before.rstrip(LOCAL)) :].lstrip(".%+-")
        if not rest or not name:
            continue
        starts = [sign.start() - len(name)]
        if "." in name:
            starts.append(sign.start() - len(name.rpartition(".")[2]))
        forms, at = set(), rest.end(1)
        for n, label in enumerate(LABELS.finditer(text, at, rest.end()), 2):
            forms.add(_form(label[1]))
            how = f"{_form(sign[0])}/{'+'.join(sorted(forms))}"
            tail = label[2]
            last = "letters" if tail.isascii() and tail.isalpha() and 2 <= len(tail) <= 24 else "other"
            for s in starts:
                yield Candidate(s, 0, label.end(), [f"how:{how}", f"at:{_form(sign[0])}", f"labels:{n}", f"last:{last}", f"more:{label.end() < rest.end()}", f"cut:{s != starts[0]}", *_beside(text, s, label.end())])


def _numbers(text: str, lo: int, hi: int) -> Iterator[Candidate]:
    """Candidates among the groups of digits of each run: up to GROUPS neighbours, with a plus sign or bracket before them or without."""
    for run in RUN.finditer(text, lo, hi):
        groups = [m.span() for m in DIGITS.finditer(text, run.start(), run.end())]
        for i, (first, _) in enumerate(groups):
            digits = ""
            for j in range(i, min(len(groups), i + GROUPS)):
                digits += text[groups[j][0] : groups[j][1]]
                if len(digits) > 19:
                    break
                if len(digits) < 4:
                    continue
                last, n = groups[j][1], j - i + 1
                lens = [b - a for a, b in groups[i : j + 1]]
                signs = [text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
                head = first
                while head > run.start() and head > first - 2 and text[head - 1] in "+(":
                    head -= 1
                kinds = []
                if n == 4 and max(lens) <= 3 and all(_octet(text[a:b]) for a, b in groups[i : j + 1]):
                    kinds.append(1)
                if len(digits) >= 13:
                    kinds.append(2)
                if 7 <= len(digits) <= 15:
                    kinds.append(3)
                for kind in kinds:
                    start = head if kind == 3 else first
                    lead = text[start:first]
                    shape = lead + "".join(f"{a}{b}" for a, b in zip(map(str, lens), [*signs, ""], strict=True))
                    if kind == 2:
                        f = [f"luhn:{luhn(digits)}", f"n:{len(digits)}", f"luhn+n:{luhn(digits)}{len(digits)}", f"signs:{''.join(sorted(set(signs)))}", f"even:{set(lens[:-1]) <= {4} and lens[-1] <= 4 or n == 1}"]
                    elif kind == 1:
                        f = [f"signs:{'|'.join(sorted(set(signs)))}", f"one:{len(set(signs)) == 1}", f"long:{sum(x > 1 for x in lens)}"]
                    else:
                        f = [f"shape:{shape}", f"lead:{lead}", f"n:{len(digits)}", f"groups:{n}", f"signs:{''.join(sorted(set(''.join(signs))))}", f"zeros:{digits.startswith('00')}", f"bracket:{'(' in lead or any('(' in s for s in signs)}"]
                    yield Candidate(start, kind, last, [*f, f"whole:{i == 0 and j + 1 == len(groups)}", *_beside(text, start, last)])


def candidates(text: str, lo: int = 0, hi: int | None = None) -> list[Candidate]:
    hi = len(text) if hi is None else hi
    out = list(_numbers(text, lo, hi))
    if WRITTEN.search(text, lo, hi):
        out += _addresses(text, lo, hi)
    out.sort(key=lambda c: (c.end, c.start, c.kind))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    kinds: frozenset[int]
    #: Score of an entity right behind another one.
    adjacent: float = 0.0

    def score(self, c: Candidate) -> float:
        kind, get = KINDS[c.kind], self.weights.get
        return get(kind, 0.0) + sum(get(f"{kind} {f}", 0.0) for f in c.features)


def best(spans: list[Candidate], scores: list[float], adjacent: float) -> list[Candidate]:
    """The segmentation with the highest score; spans in order of their ends. Other text scores 0."""
    # each state: score, and the chain of entities that reaches it; `other` has ended other text or an entity before, `entity` ends in one right here
    nodes = sorted({c.start for c in spans} | {c.end for c in spans})
    place = {x: k for k, x in enumerate(nodes)}
    other: list[tuple[float, tuple | None]] = [(0.0, None)]
    entity: list[tuple[float, tuple | None]] = [(-np.inf, None)]
    k = 0
    for x in range(1, len(nodes)):
        other.append(max(other[x - 1], entity[x - 1], key=lambda s: s[0]))
        top: tuple[float, tuple | None] = (-np.inf, None)
        while k < len(spans) and spans[k].end == nodes[x]:
            at = place[spans[k].start]
            free, follows = other[at], (entity[at][0] + adjacent, entity[at][1])
            score, chain = free if free[0] >= follows[0] else follows
            if score + scores[k] > top[0]:
                top = (score + scores[k], (k, chain))
            k += 1
        entity.append(top)
    chain = max(other[-1], entity[-1], key=lambda s: s[0])[1]
    out = []
    while chain:
        out.append(spans[chain[0]])
        chain = chain[1]
    return out[::-1]


def likelihood(spans: list[Candidate], scores: np.ndarray, adjacent: float) -> tuple[float, np.ndarray, float]:
    """log of the sum over all segmentations, the probability of each entity, and the expected number of neighbours without text between."""
    nodes = sorted({c.start for c in spans} | {c.end for c in spans})
    place = {x: k for k, x in enumerate(nodes)}
    n = len(nodes)
    ahead: list[list[int]] = [[] for _ in range(n)]
    for k, c in enumerate(spans):
        ahead[place[c.start]].append(k)
    other, entity = np.full(n, -np.inf), np.full(n, -np.inf)
    other[0], k = 0.0, 0
    add = np.logaddexp
    for x in range(1, n):
        other[x] = add(other[x - 1], entity[x - 1])
        while k < len(spans) and spans[k].end == nodes[x]:
            at = place[spans[k].start]
            entity[x] = add(entity[x], scores[k] + add(other[at], entity[at] + adjacent))
            k += 1
    total = add(other[-1], entity[-1])
    # from a node to the end, where other text or an entity has just ended
    after_other, after_entity = np.zeros(n), np.zeros(n)
    p, neighbours = np.zeros(len(spans)), 0.0
    for x in range(n - 2, -1, -1):
        free = joined = after_other[x + 1]
        for k in ahead[x]:
            end = scores[k] + after_entity[place[spans[k].end]]
            free, joined = add(free, end), add(joined, end + adjacent)
            follows = np.exp(entity[x] + adjacent + end - total)
            p[k] = np.exp(other[x] + end - total) + follows
            neighbours += follows
        after_other[x], after_entity[x] = free, joined
    return float(total), p, float(neighbours)


def rewritten(kind: int, span: str) -> list[str]:
    """Other ways to write an entity, which the patterns of base spans do not know."""
    if kind == 0:
        name, _, domain = span.partition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name} (at) {domain.replace('.', ' (dot) ')}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} [at] {domain}", f"{name}(at){domain}", f"{name} @ {domain}", f"{name}@{domain.replace('.', '[.]')}"]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", "(.)"), span.replace(".", " . ")]
    digits = "".join(c for c in span if c.isdigit())
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), " - ".join(fours)]
    plain = span[1:]
    country, _, rest = plain.partition(" ")
    return [f"00{plain}", f"(+{country}) {rest}" if rest else f"(+{digits[:2]}) {digits[2:]}", plain.replace("-", "/"), *([rest] if sum(c.isdigit() for c in rest) >= 9 else [])]


def training_windows(windows: list[str]) -> list[tuple[str, list[Span]]]:
    """Windows with their true spans: as they are, and with each base span that overlaps no other rewritten in turn."""
    out = []
    for text in windows:
        spans = base_spans(text)
        out.append((text, spans))
        for k, (start, kind, end) in enumerate(spans):
            if any(o != k and s < end and e > start for o, (s, _, e) in enumerate(spans)):
                continue
            for new in rewritten(kind, text[start:end]):
                moved = len(new) - (end - start)
                shifted = [(s + moved * (s >= end), o, e + moved * (s >= end)) for j, (s, o, e) in enumerate(spans) if j != k]
                out.append((text[:start] + new + text[end:], sorted([*shifted, (start, kind, start + len(new))])))
    return out


def fit(windows: list[str], *, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Weights by gradient steps on the likelihood of the true segmentations. A kind without any example is never predicted."""
    names: dict[str, int] = {}
    lattices, kinds = [], set()
    for text, true in training_windows(windows):
        spans = candidates(text)
        if not spans:
            continue
        at = {(c.start, c.kind, c.end): k for k, c in enumerate(spans)}
        gold = [at[s] for s in true if s in at]
        # base spans of two kinds may overlap; a segmentation holds the first
        taken, end = [], -1
        for k in sorted(gold, key=lambda k: (spans[k].start, -spans[k].end)):
            if spans[k].start >= end:
                taken.append(k)
                end = spans[k].end
        kinds |= {spans[k].kind for k in taken}
        rows = [[names.setdefault(KINDS[c.kind], len(names)), *(names.setdefault(f"{KINDS[c.kind]} {f}", len(names)) for f in c.features)] for c in spans]
        y = np.zeros(len(spans))
        y[taken] = 1
        pairs = sum(spans[a].end == spans[b].start for a, b in zip(taken[:-1], taken[1:], strict=True)) if taken else 0
        lattices.append((spans, np.concatenate(rows), np.cumsum([0, *map(len, rows)])[:-1], np.repeat(np.arange(len(rows)), [len(r) for r in rows]), y, pairs))
    w, adjacent = np.zeros(len(names)), -2.0
    for name, k in names.items():
        w[k] = -1.0 if name in KINDS else 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = np.zeros(len(w) + 1)
        for spans, ids, starts, row, y, pairs in lattices:
            _, p, neighbours = likelihood(spans, np.add.reduceat(w[ids], starts), adjacent)
            g[:-1] += np.bincount(ids, (p - y)[row], minlength=len(w))
            g[-1] += neighbours - pairs
        g = g / max(1, len(lattices)) + ridge * np.append(w, adjacent)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, adjacent = w - move[:-1], adjacent - move[-1]
    return Model({n: float(w[k]) for n, k in names.items()}, frozenset(kinds), float(adjacent))


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """What the field finds beside the base spans, which stay as they are: candidates that touch one are no candidates."""
    if not model.kinds or not text:
        return []
    taken = sorted((s, e) for s, _, e in base)
    free, out, lo = [], [], 0
    starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    for c in candidates(text):
        if c.kind not in model.kinds:
            continue
        k = int(np.searchsorted(starts, c.end))  # base spans that start before its end
        if not k or ends[k - 1] <= c.start:
            free.append(c)
    # candidates that overlap are decided together; stretches without any are other text
    free.sort(key=lambda c: c.start)
    while lo < len(free):
        hi, end = lo + 1, free[lo].end
        while hi < len(free) and free[hi].start <= end:
            end = max(end, free[hi].end)
            hi += 1
        group = sorted(free[lo:hi], key=lambda c: (c.end, c.start, c.kind))
        out += [(c.start, c.kind, c.end) for c in best(group, [model.score(c) for c in group], model.adjacent)]
        lo = hi
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text around each base span (`hit`), and around each run of digits or written sign that is none."""
    for batch in batches:
        out = []
        for text in batch.column(0):
            text = text.as_py()
            spans, end = base_spans(text), -1
            for s, _, e in spans:
                if s >= end:
                    out.append((True, text[max(0, s - AROUND) : e + AROUND]))
                    end = e + AROUND
            lone = [c for c in candidates(text) if not any(s < c.end and e > c.start for s, _, e in spans)] if len(spans) < 64 else []
            end = -1
            for c in sorted(lone, key=lambda c: c.start):
                if c.start >= end:
                    out.append((False, text[max(0, c.start - AROUND) : c.end + AROUND]))
                    end = c.end + AROUND
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.string())], ["hit", "window"])


def train(docs: DataFrame, *, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> Model:
    """A model from a hash sample of about `documents` documents, and of their windows at most `windows` with base spans and as many without."""
    rows = _texts(docs)
    n = rows.count()
    dealt = F.pmod(F.xxhash64(F.lit("personal"), "doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, documents / max(1, n))))
    found = rows.where(dealt & F.col("text").isNotNull()).select("text").mapInArrow(_windows, "hit boolean, window string").distinct()
    order = F.xxhash64(F.lit("window"), "window")
    keep = [r["window"] for hit in (True, False) for r in found.where(F.col("hit") == hit).orderBy(order, "window").limit(windows).collect()]
    return fit(keep)


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            counts, hashes, spans, added = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, model)
                counts.append([sum(k == x for _, k, _ in base) for x in range(len(KINDS))])
                hashes.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(sorted(base + more)))
                added.append(len(more))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield repeats.arrow_rows(ROWS, [batch.column(0), *(pa.array(table[:, k]) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())])

    return run


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added: a row for every row with a doc_id.

    Spans are kind:start:end in code points, by start, then kind, then end. A null text is empty and has none; rows that
    repeat a doc_id are each searched; other columns are not looked at; an empty table gives no rows. A text is searched
    whole, in time in proportion to its length. Added spans overlap neither base spans nor each other; of two
    segmentations with one score the one whose spans end first in order of kind stays.
    """
    return _texts(docs).mapInArrow(_found(model), ROWS)
