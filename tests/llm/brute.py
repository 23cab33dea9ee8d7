"""Plain statements of the rules, to compare the operators with on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def substring_dedup(texts: dict, span: int = 200) -> dict:
    """op1: doc -> (n_bytes, n_removed, n_spans, sha256)."""
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = defaultdict(int)
    for t in raw.values():
        for p in range(len(t) - span + 1):
            seen[t[p : p + span]] += 1
    out = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def passage_dedup(texts: dict, span: int = 13) -> dict:
    """op8: doc -> (n_words, n_removed, sha256)."""
    words = {d: WORD.findall((t or "").encode()) for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        w = words[d]
        for p in range(len(w) - span + 1):
            first.setdefault(tuple(w[p : p + span]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < d:
                gone[p : p + span] = [True] * span
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingles(text, size: int) -> frozenset:
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_duplicates(texts: dict, size: int, percent: int = 80) -> dict:
    """op6: doc -> (n_shingles, component)."""
    sets = {d: shingles(t, size) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            index[s].append(d)
    for d in sorted(sets):
        common = defaultdict(int)
        for s in sets[d]:
            for o in index[s]:
                if o < d:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in texts}


def corpus(seed: int, n: int = 60) -> dict:
    """Documents with copies, near copies, shared passages, periodic stretches, odd bytes, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(40)]
    words = lambda k: " ".join(r.choices(vocabulary, k=k))
    passages = [words(r.randint(14, 70)) for _ in range(4)]
    texts = {}
    for d in range(n):
        kind = r.randrange(8)
        if kind == 0 and texts:
            text = texts[r.choice(sorted(texts))]
        elif kind == 1 and texts:
            w = (texts[r.choice(sorted(texts))] or "a b").split(" ")
            for _ in range(1 + len(w) // 60):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        elif kind == 2:
            text = words(r.randint(0, 30)) + " " + r.choice(passages) + " " + words(r.randint(0, 30))
        elif kind == 3:
            text = r.choice(passages)[r.randint(0, 40) :] + "\n" + r.choice(passages)
        elif kind == 4:
            text = words(5) + " " + (r.choice(vocabulary) + " ") * r.randint(5, 90)
        elif kind == 5:
            text = (words(2) + " ") * r.randint(10, 60)
        else:
            text = words(r.randint(0, 150))
        texts[d * 3 + 1] = text
    texts[5000], texts[5001], texts[5002] = None, "", " \t\n"
    return texts


def table(spark, texts: dict, **extra):
    return spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string").repartition(3)


def divergence(rows: list, least: int = 10, top: int = 10) -> set:
    """op11: (lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= least]

        def shares(words):
            n = Counter(words)
            total = sum(n[t] for t in kept)
            return {t: (1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)), n[t]) for t in kept}

        q = shares(w for d in own for w in d[2])
        p = {s: shares(w for d in own if d[1] == s for w in d[2]) for s in {d[1] for d in own}}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(o, sum(f(p[s][t][0], p[o][t][0]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t][0], q[t][0])) for t in kept if p[s][t][1] and p[s][t][0] > q[t][0]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def lloyd(rows: dict, clusters: int = 16, rounds: int = 3) -> dict:
    """op13: vec_id -> (cluster, distance, cluster_inertia, inertia, centroid hash) of kept integer points."""
    first = sorted(rows, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:clusters]
    centroids = [rows[i] for i in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        best = {i: min((gap(v, c), k) for k, c in enumerate(centroids)) for i, v in rows.items()}
        if r < rounds:
            for k in range(len(centroids)):
                if mine := [rows[i] for i in rows if best[i][1] == k]:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = Counter()
    for d, k in best.values():
        own[k] += d
    return {i: (k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, (d, k) in best.items()}
