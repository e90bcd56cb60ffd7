"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, fmod, log

import duckdb
import numpy as np
import pytest

from biblio.llm import pii, ranked, trie

from .conftest import SCHEMA, documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def search_by_hand(docs, items, k=20):
    """(item, rank, doc, score) of all items, in order of the rows."""
    texts = [(i, TERM.findall(low(t))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_docs, total = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(TERM.findall(low(text)))
    out = []
    for item, query in wanted.items():
        scores = []
        for i, t in texts:
            tf = Counter(t)
            m = 75 + (25 * len(t) * n_docs) // total
            score = sum(q * floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w, q in query.items() if tf[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("held", [3, 1 << 21])
def test_search_against_brute_force(spark, tables, monkeypatch, held):
    """Shards of one document or of many; ties of copies, odd texts, items without terms or with two rows."""
    monkeypatch.setattr(ranked, "HELD", held)
    got = ranked.op11_ranked_search(spark, tables).select("item_id", "rank", "doc_id", "score").collect()
    items = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    assert sorted_rows(got) == sorted_rows(search_by_hand([(d[0], d[1]) for d in documents()], [tuple(r) for r in items]))


def test_search_in_blocks_with_null_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ROWS", 4)
    rng = random.Random(5)
    docs = [(i if i % 7 else None, prose(rng, 30) + " Ünï 7" * (i % 3), i, "x") for i in range(60)]
    docs += docs[:5]
    items = [(k, prose(rng, 6) + " Ünï", "y") for k in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, term int, item string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string, doc string")
    got = ranked.search(df, asked, k=7).collect()
    assert sorted_rows(got) == sorted_rows(search_by_hand([d[:2] for d in docs], [x[:2] for x in items], 7))


def test_best_skips_and_is_exact():
    rng = np.random.default_rng(1)
    saved = 0
    for trial in range(30):
        n = int(rng.integers(1, 30_000))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            doc = np.flatnonzero(rng.random(n) < rng.choice([0.0005, 0.01, 0.3, 0.9]))
            lists.append((doc, rng.integers(1, rng.choice([3, 50, 10_000]), len(doc))))
        total = np.zeros(n, np.int64)
        for doc, score in lists:
            total[doc] += score
        k = int(rng.integers(1, 25))
        least = int(np.sort(total)[-min(n, 3 * k)]) if trial % 2 else 0
        seen = {}
        doc, score = ranked.best(lists, n, k, least, seen)
        want = [(-int(total[d]), d) for d in np.flatnonzero(total >= max(least, 1))]
        got = sorted((-int(s), int(d)) for d, s in zip(doc, score, strict=True))
        assert got[:k] == sorted((a, int(b)) for a, b in want)[:k] and len(got) == len(set(got))
        saved += sum(len(d) for d, _ in lists) - seen.get("n", 0)
    assert saved > 0


def crc(c):
    return zlib.crc32(str(c).encode()) % 6


def trie_by_hand(rows):
    """Nodes of (conv, turn, role, text) rows, as the query returns them."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            talks[conv].append((turn is not None, turn or 0, role, said, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in talks.items()}
    built = {c: own.get(c - int(fmod(c, 100)), [])[: crc(c)] + ts[crc(c) :] for c, ts in own.items()}
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TALK = "conv_id long, turn long, role string, text string"


def talks(seed, n):
    """Conversations with shared beginnings, copies, ties, gaps and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *rng.sample(range(-300, 1500), 25)]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2060) for t in range(4)]
    rows += [(3000, t, "user", "again") for t in range(23)] + [(3001, t, "user", "again") for t in range(12)] + [(None, 1, "user", "nobody")]
    return rows + rows[:10]


@pytest.mark.parametrize("segment", [2, 9, trie.SEGMENT])
def test_trie_against_brute_force(spark, segment):
    """Whole paths, and paths in segments whose totals meet level by level; copies lie over several ranges."""
    rows = talks(segment, 40)
    if segment == 2:  # a level for each two turns
        rows = [r for r in rows if (r[0] is None or r[0] < 2010) and (r[1] or 0) < 3]
    df = spark.createDataFrame(rows, TALK + "").repartition(3)
    got = trie.prefix_trie(trie.shared_heads(trie.turns_of(df)), segment).select(NODE).collect()
    assert sorted_rows(got) == sorted_rows(trie_by_hand(rows))


def test_trie_query_against_sql_and_repeats(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet/*.parquet'")
    got = trie.op12_prefix_trie(spark, tables)
    assert sorted(got.columns) == sorted(NODE)
    assert sorted_rows(got.select(NODE).collect()) == sorted_rows(con.execute(f"SELECT {', '.join(NODE)} FROM ({trie.OP12_SQL})").fetchall())


def test_skeleton_numbers_are_depth_first():
    """Numbers and ends from the prefix array agree with the trie of all paths of the ranges."""
    rng = random.Random(4)
    for _ in range(200):
        keys = sorted("".join(f"{rng.choice('ab'):0>32}" for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(2, 30)))
        cuts = sorted(rng.sample(range(1, len(keys)), min(len(keys) - 1, rng.randint(1, 6))))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        edge = [-1] + [trie.agree(a[-1], b[0], 0) for a, b in zip(parts, parts[1:])]
        skeleton = trie.Skeleton(np.array(edge), np.array([trie.agree(p[0], p[-1], 0) for p in parts]))
        nodes = {}
        for q in range(1, len(parts)):
            for depth in range(edge[q] + 1):
                nodes.setdefault(parts[q][0][: depth * 32], set()).add((skeleton.number(q, depth), skeleton.end(q, depth)))
        order = sorted(nodes)
        assert [nodes[p] for p in order] == [{(k, k + sum(x.startswith(p) for x in order))} for k, p in enumerate(order)]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_hand(text):
    out = []
    for k, (_, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
            fine = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(number) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, 9 <= len(number) <= 15)[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def identifiers(text):
    """(start, end, said, patterns) of runs of words with a digit or an @, one space apart."""
    words = [m.span() for m in re.finditer(r"[^\x09-\x0D\x20:=\x22'<>\[\],;|]+", text) if re.search("[0-9@]", m[0])]
    runs = []
    for a, b in words:
        if runs and text[runs[-1][1] : a] == " ":
            runs[-1][1] = b
        else:
            runs.append([a, b])
    out = []
    for k, (a, b) in enumerate(runs):
        left, right = text[runs[k - 1][1] if k else 0 : a][-64:].lower(), text[b : runs[k + 1][0] if k + 1 < len(runs) else len(text)][:64].lower()
        said = text[a:b]
        a += len(said) - len(re.sub("^[^A-Za-z0-9+]+", "", said))
        b -= len(said) - len(re.sub("[^A-Za-z0-9]+$", "", said))
        before, after = left.split(), right.split()
        found = []
        if len(before) > 1:
            found.append((2, " ".join(before[-2:])))
        if before and after:
            found.append((1, before[-1], after[0]))
        if before:
            found.append((0, before[-1]))
        if a < b:
            out.append((a, b, text[a:b].lower(), found))
    return out


def allows(kind, said):
    n = len(re.sub("[^0-9]", "", said))
    return ("@" in said, bool(re.fullmatch("[0-9a-f]*[.:][0-9a-f]*[.:][0-9a-f.:]*", said)), bool(re.fullmatch(r"[0-9\x20-]+", said)) and 12 <= n <= 19, bool(re.fullmatch(r"[0-9\x20().+/-]+", said)) and 7 <= n <= 15)[kind]


def personal_by_hand(texts):
    """(base, spans) of each text."""
    bases, edges, places = [base_by_hand(t) for t in texts], {}, []
    for k, text in enumerate(texts):
        for a, b, said, found in identifiers(text):
            over = [x for x in bases[k] if x[0] < b and x[2] > a]
            same = [x for x in over if (x[0], x[2]) == (a, b)]
            kind = same[0][1] if same else -2 if over else -1
            if kind == -2:
                continue
            if kind == -1:
                places.append((k, a, b, said, found))
            for p in found:
                edges[p, said] = max(kind, edges.get((p, said), -1))
    labels, sure = {}, {}
    for _ in range(pii.ROUNDS):
        sums, against = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: [0.0] * 4)
        for (p, said), own in edges.items():
            kind, score = (own, 1.0) if own >= 0 else labels.get(said, (-1, 0.0))
            for k in range(4):
                mine = score if k == kind else 0.0
                sums[p][k] += mine
                against[p][k] += (1 - mine) * (pii.OPEN if kind in (-1, k) and allows(k, said) else 1)
        sure = {}
        for p in sums:
            share, _, best = max((sums[p][k] / (sums[p][k] + against[p][k] + 1), -k, k) for k in range(4))
            if share >= pii.MIN_SCORE and sums[p][best] >= pii.MIN_SEEDS:
                sure[p] = (best, share)
        miss = defaultdict(lambda: 1.0)
        for (p, said), kind in edges.items():
            if kind < 0 and p in sure and allows(sure[p][0], said):
                miss[said, sure[p][0]] *= 1 - sure[p][1]
        labels = {}
        for (said, kind), m in sorted(miss.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            labels.setdefault(said, (kind, 1 - m))
    spans = [list(b) for b in bases]
    for k, a, b, said, found in places:
        fits = [(-sure[p][1], sure[p][0]) for p in found if p in sure and allows(sure[p][0], said)]
        if fits:
            spans[k].append((a, min(fits)[1], b))
    return [(b, sorted(s)) for b, s in zip(bases, spans, strict=True)]


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def luhn_number(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if base_by_hand(body + c))


def personal_texts():
    rng = random.Random(8)
    texts = ["", "no data here", "é😀 a@b.c_d@e.fg +1 (555) 123-4567.", "1.2.3.4.5 256.1.1.1 007.0.0.255", "4111 1111 1111 1111 4111-1111-1111-1112", "x@y @z.w a@@b.c 1-2-3"]
    texts += [f"{prose(rng, 8)} desk line +49 351 55{k}-12{rng.randint(10, 99)} today {prose(rng, 3)}" for k in range(30)]
    for k in range(9):
        texts.append(f"pay with card {luhn_number(rng)} now; mail me: who{k}@site{k}.example.com thanks")
        texts.append(f"the {rng.choice(['+49 30 1234567' + str(k), f'10.0.0.{k}', f'in 19{k}5', luhn_number(rng)])} of {prose(rng, 4)}")
    texts += ["desk line (0351) 77 88 99-1 today", "reach line 0351 123456{} soon".format(1), "desk line 0351 1234561 today", "pay with card 1234 5678 9012 3456 now", "mail me: someone@intranet thanks", "mail me: 12 of them", "desk line 12 today", "the 19956667 of"]
    texts += [f"desk line 030 99{k}1234 today, hot reach 030 99{k}1234 soon" for k in range(9)] + ["hot reach 040 7654321 soon"]
    return texts


def test_personal_data_against_brute_force(spark):
    texts = personal_texts()
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = {r["doc"]: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc", pii.written("base").alias("base"), pii.written("spans").alias("spans")).collect()}
    want = personal_by_hand(texts)
    for k, (base, spans) in enumerate(want):
        assert (got[k]["base"], got[k]["spans"]) == (told(base), told(spans)), texts[k]
    added = {texts[k][a:b] for k, (base, spans) in enumerate(want) for a, _, b in set(spans) - set(base)}
    assert {"0351 1234561", "1234 5678 9012 3456", "someone@intranet", "040 7654321"} <= added and "12" not in added and "19956667" not in added


def test_personal_data_of_long_odd_and_repeated_rows(spark, tmp_path):
    long = ["9" * 150_000, "a" * 150_000 + "@", "a@" * 20_000, "1.2.3.4 " * 3000 + "é", "+1 (" * 20_000, "x" * 100_000 + " 4111111111111111", "1 " * 30_000]
    rows = [(k, t) for k, t in enumerate(long)] + [(None, None), (None, "me@here.org"), (7, "ip 10.0.0.1"), (7, "ip 10.0.0.1")]
    spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, base string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_personal_data(spark, str(tmp_path)).collect()
    plain = {3: [(8 * i, 1, 8 * i + 7) for i in range(3000)], 5: [(100_001, 2, 100_017)]}  # the plain patterns take quadratic time here
    want = []
    for i, (k, t) in enumerate(rows):
        base = plain.get(i, []) if i < len(long) else base_by_hand(t or "")
        counts = [sum(x[1] == kind for x in base) for kind in range(4)]
        want.append((k, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base)))
    assert sorted_rows(tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) for r in got) == sorted_rows(want)


def test_personal_data_runs_without_python(spark, tables):
    plan = pii.searched(spark.read.parquet(f"{tables}/documents.parquet").selectExpr("doc_id as doc", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
