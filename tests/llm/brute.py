"""Plain Python versions of the stages, for small tables."""

import re
from collections import Counter, defaultdict
from math import log

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_rules(text):
    words = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def gram_buckets(text):
    raw = (text or "").encode()
    return [((((raw[i] * 257 + raw[i + 1]) * 257 + raw[i + 2]) * 0x9E3779B1) % 2**32) >> 16 for i in range(len(raw) - 2)]


def quality_verdict(docs, labels):
    """Whether each (doc_id, text) is kept; ``labels`` are (doc_id, quality)."""
    good = {}
    for k, q in labels:
        good[k] = min(good.get(k, q), q)
    target, raw = Counter(), Counter()
    for k, text in docs:
        raw.update(gram_buckets(text))
        if good.get(k) == 1:
            target.update(gram_buckets(text))
    t, r = sum(target.values()) + 0.5 * 65536, sum(raw.values()) + 0.5 * 65536

    def llr(text):
        own = gram_buckets(text)
        return sum(log((target[b] + 0.5) / t) - log((raw[b] + 0.5) / r) for b in own) / len(own) if own else 0.0

    scores = [llr(text) for _, text in docs]
    fine = sorted(x for x, (k, _) in zip(scores, docs) if good.get(k) == 1)
    poor = [x for x, (k, _) in zip(scores, docs) if good.get(k) == 0]
    seen = sorted({*fine, *poor})
    best, threshold = None, seen[0] - 1
    for cut in [seen[0] - 1, *((a + b) / 2 for a, b in zip(seen, seen[1:]))]:
        lost, caught = sum(x < cut for x in fine) / len(fine), sum(x < cut for x in poor) / len(poor)
        if lost <= 0.002 and (best is None or caught - 10 * lost > best + 1e-12):
            best, threshold = caught - 10 * lost, cut
    out = []
    for x, (_, text) in zip(scores, docs):
        n, *_, repeats = base_rules(text)
        out.append(n >= 10 and 100 * repeats <= 20 * n and x >= threshold - 1e-7)
    return out, scores


def components(docs):
    """(set size, smallest key of the component) of each key of (key, text)."""
    sets = {}
    for d in docs:
        w = WORD.findall(low(d[1]))
        sets[d[0]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def mix_copies(docs, sql):
    """Copies of each key of (doc_id, text, source), by the SQL of the mix."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    return dict(con.execute(f"SELECT doc_id, max(copies) FROM ({sql}) GROUP BY 1").fetchall())
