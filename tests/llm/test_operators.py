"""The numbered operators against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblio.llm import chat, fingerprint, jaccard, language, mixing, packing, pages, quality, sharding, suffix_tree
from biblio.llm import tables as tables_
from biblio.llm.registry import ORACLE, QUERIES

from . import brute
from .brute import WORD, base_rules, low
from .brute import components as brute_components
from .conftest import documents

FULL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert [r for r in got if "conv_id" not in r or r["conv_id"] != -1] == []


def test_language_predicts_held_out_texts(spark):
    got = language.op1_language_id(spark, FULL)
    truth = spark.read.parquet(f"{FULL}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out and lang is not null")
    n, right = held.count(), held.filter("lang = lang_pred").count()
    assert n > 20 and right / n > 0.95
    for r in got.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_undetermined_and_bounds(spark, tables):
    got = {r["doc_id"]: r for r in language.op1_language_id(spark, tables).collect()}
    for k in (200, 201, 202, 203):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_identified_keeps_ties_and_unlabelled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcabc", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language.identified(docs).orderBy("doc_id").collect()] == [1, 2]
    monkeypatch.setattr(language, "learn", lambda d: language.build({"a": "abcabcabc", "b": "abcabcabc"}))
    assert [r["doc_id"] for r in language.identified(docs).collect()] == [1]


def test_identified_drops_clearly_wrong_labels_only(spark):
    rng = random.Random(6)
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    a, b = "the thing and other whether this there".split(), "élan çaux où même voilà êtes très".split()
    rows = [(k, line((a, b)[k % 2], 90), ("en", "fr")[k % 2], 0.5) for k in range(60)]
    rows += [(100, line(a, 900), "fr", 0.5), (101, line(a, 8), "fr", 0.5), (102, line(a, 60) + line(b, 60), "fr", 0.5), (103, line(b, 90), None, 0.5), (104, line("жук кот дом".split(), 90), "xx", 0.5), (105, "12 34", "en", 0.5)]
    got = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert sorted(got) == [*range(60), 101, 102, 103, 104] and got[103]["lang"] == "fr" and got[101]["lang"] == "fr" and got[104]["score"] == 0.5


def parse(text, train):
    """Phrases of a greedy parse: each the longest string that occurs in the training text, or a symbol it lacks."""
    n, at = 0, 0
    while at < len(text):
        k = at + 1
        while k <= len(text) and text[at:k] in train:
            k += 1
        at = max(k - 1, at + 1)
        n += 1
    return n


def test_cross_parsing_counts_longest_matches():
    model = language.build({"a": "abcabcabd", "b": "zzzz"})
    text = b"abcabdxabd"
    cost = language.phrases(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert cost[0] == parse(text, b"abcabcabd") * model.cost[0]


@pytest.mark.parametrize("block", [3, 16, 512])
def test_whole_texts_are_parsed(monkeypatch, block):
    """Blocks do not show, not even in texts without end that keep parses apart, or between bytes of a character."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(2)
    train = {"a": "".join(rng.choice("abc ") for _ in range(300)), "b": "é" * 50 + "aab" * 40, "c": "a" * 37}
    model = language.build(train)
    texts = ["", "a" * 1500, "é" * 700 + "aab" * 90, *("".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 2, 15, 16, 17, 900, 4000))]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = language.phrases(model, np.frombuffer(raw, np.uint8), offsets)
    for text, costs in zip(texts, got, strict=True):
        for k, name in enumerate(model.languages):
            assert costs[k] == parse(text.encode(), train[name].encode()) * model.cost[k]


def test_language_against_brute_force(spark, tables, docs):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    train = {k: bytes(language._plain(np.frombuffer(v.encode(), np.uint8))) for k, v in language.training_texts(df.filter(~language.held_out())).items()}
    assert sorted(train) == ["en", "fr"]
    for r in language.op1_language_id(spark, tables).collect():
        texts = {d[1] or "" for d in docs if d[0] == r["doc_id"]}
        text = bytes(language._plain(np.frombuffer(texts.pop().encode(), np.uint8)))
        if not re.search(r"[^\W\d_]", text.decode()):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cost = sorted((parse(text, t) * np.log2(len(t)), k) for k, t in train.items())
        assert r["lang_pred"] == cost[0][1] and r["score"] == pytest.approx(1 - cost[0][0] / cost[1][0])


def test_mix_meets_targets(spark, tables, docs):
    rows = mixing.op2_mix_sources(spark, tables).collect()
    assert len(rows) == len(docs)
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}
    source = {d[0]: d[3] for d in docs}
    total, per, taken, target = 0, Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        per[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        total += r["size"]
    order = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, room = {}, 1.5 * total, list(order)
    while room:
        share = left / sum(weight[s] for s in room)
        full = [s for s in room if weight[s] * share > 2 * per[s]]
        if not full:
            want |= {s: weight[s] * share for s in room}
            break
        for s in full:
            want[s] = 2 * per[s]
            left -= want[s]
            room.remove(s)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = {(r["doc_id"], r["taken"]) for r in mixing.op2_mix_sources(spark, tables).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_takes_documents_in_pareto_order(spark, monkeypatch):
    """In each source, documents by random odds over inclusion odds until the sampled words are met."""
    monkeypatch.setattr(mixing, "MEET", 16)
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(rng.integers(0, 400)), f"s{k % 3}") for k in range(600)] + [(700, None, "s1"), (700, "", None)]
    got = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    source = {r[0]: r[2] for r in rows}
    by = defaultdict(list)
    for r in got:
        by[source[r["doc_id"]] if r["size"] else None].append(r)
    uneven = 0
    for s in ("s0", "s1", "s2"):
        drawn = sorted((r for r in by[s] if r["order_odds"] is not None), key=lambda r: r["order_odds"])
        part = [r["taken"] % r["size"] if r["taken"] < 2 * r["size"] else r["size"] for r in drawn]
        whole = [p in (0, r["size"]) for p, r in zip(part, drawn, strict=True)]
        assert sum(not w for w in whole) <= 1  # one document at most is cut
        assert abs(sum(r["taken"] for r in by[s]) - by[s][0]["target"]) <= 1
        uneven += len({round(r["taken"] / r["size"]) for r in by[s]}) > 1
    assert uneven


def test_suffix_tree_base_score(spark, tables, docs):
    got = suffix_tree.op3_suffix_tree_score(spark, tables).collect()
    counts = Counter()
    tokens = [(d[0], [*WORD.findall(low(d[1])), None]) for d in docs]
    for k, t in tokens:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((k, len(t), sum(counts[x] > 0 for x in t), round(sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for k, t in tokens)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def brute_suffix_tree(train):
    """log10 probability of a list of tokens, by a model kept in dictionaries."""
    counts = Counter(x for t in train for x in t)
    total, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    least = max(suffix_tree.MIN_SHARE * total, 4)
    symbols = {x for x, n in counts.items() if n >= max(suffix_tree.MIN_SHARE * total, 2)}
    sym = lambda x: x if x in symbols else "other"
    root = {x: (counts[x] + 0.5) / scale for x in symbols}
    root["other"] = 1 - sum(root.values())
    kept = {}  # context -> (rest, shares)

    def share(context, x, depth):
        p = root[x]
        for d in range(1, min(depth, len(context)) + 1):
            found = kept.get(context[len(context) - d :])
            if found:
                p = found[0] * p + found[1].get(x, 0.0)
        return p

    wanted = None
    for d in range(1, suffix_tree.DEPTH + 1):
        pairs = Counter()
        for t in train:
            s = [sym(None), *map(sym, t)]
            pairs.update((tuple(s[j - d : j]), s[j]) for j in range(d, len(s)) if wanted is None or tuple(s[j - d : j]) in wanted)
        sizes = Counter()
        for (c, _), n in pairs.items():
            sizes[c] += n
        level = {}
        for c, size in sizes.items():
            if size < least:
                continue
            own = {x: n for (k, x), n in pairs.items() if k == c and n >= 2}
            rest = (suffix_tree.PRIOR + size - sum(own.values())) / (size + suffix_tree.PRIOR)
            before = {x: share(c, x, d - 1) for x in own}
            gain = sum(n * np.log((n / (size + suffix_tree.PRIOR) + rest * before[x]) / before[x]) for x, n in own.items()) + (size - sum(own.values())) * np.log(rest)
            if gain >= suffix_tree.MIN_GAIN:
                level[c] = (rest, {x: n / (size + suffix_tree.PRIOR) for x, n in own.items()})
        kept |= level
        wanted = {(*c, x) for (c, x), n in pairs.items() if n >= least}

    def in_tree(t, j):
        s = [sym(None), *map(sym, t)]
        c = tuple(s[max(0, j + 1 - suffix_tree.DEPTH) : j + 1])
        return (counts[t[j]] + 0.5) / scale * share(c, s[j + 1], suffix_tree.DEPTH) / root[s[j + 1]]

    deep = defaultdict(Counter)
    p_of = {}
    for t in train:
        for j in range(suffix_tree.DEEP, len(t)):
            deep[tuple(t[j - suffix_tree.DEEP : j])][t[j]] += 1
            p_of[tuple(t[j - suffix_tree.DEEP : j + 1])] = in_tree(t, j)
    told = {}
    for c, after in deep.items():
        size = sum(after.values())
        own = {x: n for x, n in after.items() if n >= suffix_tree.REPEATS}
        rest = (suffix_tree.PRIOR + size - sum(own.values())) / (size + suffix_tree.PRIOR)
        value = {x: n / (size + suffix_tree.PRIOR) / p_of[(*c, x)] + rest for x, n in own.items()}
        if own and sum(n * np.log(value[x]) for x, n in own.items()) + (size - sum(own.values())) * np.log(rest) >= suffix_tree.MIN_GAIN:
            told[c] = (rest, value)

    def score(t):
        total = 0.0
        for j in range(len(t)):
            p = in_tree(t, j)
            c = tuple(t[j - suffix_tree.DEEP : j]) if j >= suffix_tree.DEEP else None
            if c in told:
                p *= told[c][1].get(t[j], told[c][0])
            total += log10(p)
        return total

    return score


def test_suffix_tree_score_against_brute_force(spark, tables, docs):
    """With all deep contexts, as which of them are chosen goes by a hash that only the operator has."""
    tokens = [(d[0], [*WORD.findall(low(d[1])), None]) for d in docs]
    score = brute_suffix_tree([t for k, t in tokens if zlib.crc32(str(k).encode()) % 5 != 1])
    want = sorted((k, len(t), round(score(t), 3)) for k, t in tokens)
    got = sorted((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in suffix_tree.scored(spark.read.parquet(f"{tables}/documents.parquet"), every=1).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-4, abs=2e-3)


def test_repeated_passages_score_higher(spark):
    """A text that the corpus holds twice gains far more over the base than one it holds once."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.scored(df).collect()}
    train = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 != 1]
    twice = [got[k] for k in train if k < 40 and zlib.crc32(str(1000 + k).encode()) % 5 != 1]
    once = [got[k] for k in train if k >= 40]
    assert min(twice) > max(once) + 5


def repeated_rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(100)]
    return rows + [(1000 + 1000 * j + k, rows[k][1]) for j, n in enumerate((40, 9, 8, 7, 6, 5)) for k in range(n)]


@pytest.mark.parametrize(
    ("bucket", "hot", "bits", "head", "share"),
    [(1 << 19, 1 << 17, 1 << 29, 1 << 22, 1 / 32_768), (100, 1 << 17, 1 << 29, 4000, 1 / 3000), (1000, 4, 256, 1 << 22, 1 / 32_768)],
    ids=["as it is", "many buckets, rare words", "hot contexts, full filter"],
)
def test_all_deep_contexts_count(spark, monkeypatch, bucket, hot, bits, head, share):
    """The query gives what dictionaries give, whatever the buckets, the filter and the way that a context takes."""
    rows = repeated_rows()
    tokens = [(k, [*t.split(), None]) for k, t in rows]
    for name, value in (("BUCKET", bucket), ("HOT", hot), ("FILTER_BITS", bits), ("HEAD", head), ("MIN_SHARE", share), ("learn", partial(suffix_tree.learn, min_share=share))):
        monkeypatch.setattr(suffix_tree, name, value)
    score = brute_suffix_tree([t for k, t in tokens if zlib.crc32(str(k).encode()) % 5 != 1])
    want = sorted((k, len(t), score(t)) for k, t in tokens)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(suffix_tree.learn(df)[0].hot) > 0 or hot > 4
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in suffix_tree.scored(df).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-5)


def test_suffix_tree_gains_on_held_out_texts(spark):
    held = suffix_tree.op3_suffix_tree_score(spark, FULL).filter("held_out")
    base, score = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_suffix_tree_is_a_distribution(spark, tables):
    tree, _ = suffix_tree.learn(spark.read.parquet(f"{tables}/documents.parquet"))
    n = len(tree.root)
    for code in (0, 1, n + 1):
        p = suffix_tree.suffix_share(tree, np.full(n, code), np.arange(n), len(tree.levels))
        assert abs(p.sum() - 1) < 1e-9


def parts(text):
    return {p.rstrip(" ") for p in re.findall(r"(?:[^ \t\n\x0b\x0c\r]+[ \t\x0b\x0c\r]*){1,32}", text)}


def like(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(spark, tables, docs):
    got = sorted(fingerprint.op4_fingerprints(spark, tables).collect(), key=lambda r: (-r["doc_id"], r["n_chars"]))
    rows = sorted(((d[0], d[1] or "") for d in docs), key=lambda d: (-d[0], d[1]))
    prints = {}
    for i, ((k, text), r) in enumerate(zip(rows, got, strict=True)):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (k, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(parts(text), parts(edited)))
        assert r["near_next"] == pytest.approx(like(parts(text), parts(after)))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited == text:
            assert r["fingerprint"] == r["edited_fingerprint"]


def test_fingerprints_give_back_all_digests(spark):
    """Whatever the number of paragraphs, also where cells are so few that groups must be retried or written out."""
    rows = [(n, [int(x) for x in np.random.default_rng(n).integers(-(2**63), 2**63, n)]) for n in (0, 1, 2, 7, 9, 40, 300, 3000)]
    df = spark.createDataFrame(rows, "n int, found array<long>")
    for r, (n, found) in zip(df.select("n", fingerprint.fingerprint(F.col("found")).alias("m"), fingerprint.written(fingerprint.fingerprint(F.col("found"))).alias("w")).orderBy("n").collect(), rows, strict=True):
        assert r["n"] == n and sorted(r["m"]["digests"]) == sorted(found)
        base, *groups = r["w"].split("|")
        assert sum(int(c.split(":")[1], 16) for c in base.split(".")[1:] if c) == 3 * n
        assert len(groups) == max(1, 1 << int(np.ceil(np.log2(max(n, 1) / 8)))) if n > 8 else len(groups) == 1
        whole = [[tuple(int(x, 16) for x in c.split(":")) for c in g.split(".")[1:] if c] for g in groups]
        assert sum(n for g, cells in zip(groups, whole) for _, n, _, _ in cells) in range(n, 3 * n + 1)
        for g, cells in zip(groups, whole):
            size = int(g.split(".")[0]) // 3
            if 3 * size in (3 * k for k in fingerprint.SIZES):
                sums = [0, 0, 0]
                for at, _, d, _ in cells:
                    sums[at // size] ^= d
                assert sums[0] == sums[1] == sums[2]


def test_differences_are_peeled_at_the_size_that_tells_them(spark):
    """Few changes come from the base, more from sketches of groups, retried larger; none digest by digest."""
    rng = random.Random(12)
    new = lambda n: [rng.getrandbits(63) for _ in range(n)]
    pairs, want = [], []
    for kept, gone, come in [(0, 0, 0), (0, 1, 0), (50, 1, 2), (9, 0, 3), (40, 40, 40), (0, 30, 0), (3, 200, 7), (300, 150, 150), (0, 6, 90), (5, 0, 0)]:
        both = new(kept)
        pairs.append((both + new(gone), new(come) + both))
        want.append(gone + come)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    marks = df.select("i", fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    told = fingerprint.with_difference(marks, "a", "b", "d").select("i", "d").orderBy("i").collect()
    assert [r["d"]["n"] for r in told] == want
    by = [set(r["d"]["by"]) for r in told]
    assert by[0] == by[1] == by[2] == {fingerprint.BASE_CELLS} and all(0 not in x for x in by)
    assert any(16 in x for x in by) and sum(x != {fingerprint.BASE_CELLS} for x in by) >= 4


def test_fingerprint_of_a_very_long_text(spark, tmp_path):
    words = [f"w{i % 7919}x{i // 7919}" for i in range(200_000)]
    rows = [(2, " ".join(words)), (1, " ".join(words[:150_000]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in fingerprint.op4_fingerprints(spark, str(tmp_path)).collect():
        text, after = rows[2 - r["doc_id"]][1], rows[r["doc_id"] - 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["near_edited"] == pytest.approx(like(parts(text), parts(edited))) and r["near_next"] == pytest.approx(like(parts(text), parts(after)))


@pytest.mark.parametrize("range_bytes, coarse", [(1 << 20, 512), (4000, 512), (2000, 3), (500, 4)])
def test_next_document_by_ranges(spark, tables, docs, monkeypatch, range_bytes, coarse):
    monkeypatch.setattr(fingerprint, "COARSE", coarse)
    rows = [(d[0] ** 2 if d[0] else None, d[1] or "") for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    got = sorted(((r["doc_id"], r["t"], r["n"]) for r in fingerprint.with_next(df, "doc_id", "t", ["t"], range_bytes).select("doc_id", "t", F.col("_next.t").alias("n")).collect()), key=str)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    assert got == sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=str)


WORDS_200 = " ".join(f"w{i}" for i in range(200))
ODD_PAGES = ['<body class="has-sidebar"><p>{}</p></body>', '<div class="content with-sidebar">{}</div>', '<div class="page-header-wrapper"><p>{}</div>', '<section id="share">{}</section>', '<div class="post ad-free"><p>{}</p></div>', '<article><p class="notice">short<p>{}</article>', '<article><ul><li class="menu">one<li>{}</ul></article>', '<p title="a>b">{}</p>', "<!-- <p>no --><p>{}<script>var a='<p>no</p>'</script>", "<table><tr><td class=ad>no<td>{}</table>"]


@pytest.mark.parametrize("page", ODD_PAGES)
def test_main_text_of_odd_pages(page):
    """What surrounds the content, or stands unclosed before it, takes nothing of it away."""
    cost = {k: pages.MOST for k in ("p.notice", "li.menu", "td.ad")}
    assert pages.main_text(page.format(WORDS_200), cost) == WORDS_200


def test_elements_around_the_content_cost_nothing():
    inside, outside = pages.tag_counts('<body class="x"><nav class="n"><a>m</a></nav><div class="wrap"><article><p>t</p></article><div class="ad">no</div></div></body>')
    assert not {"body.x", "div.wrap"} & (inside.keys() | outside.keys()) and {"nav.n", "div.ad"} <= outside.keys() and inside["p"] == 1


def test_region_scores_most():
    rng = random.Random(8)
    for _ in range(200):
        items = [("t", "", "", "w " * rng.randint(0, 6)) if rng.random() < 0.5 else ("<", "b", rng.choice(["b", "i"]), "") for _ in range(30)]
        cost = {"b": 2.5, "i": 4.0}
        value = [float(len(x[3].split())) if x[0] == "t" else -cost[x[2]] for x in items]
        a, b = pages.region(items, [0] * len(items), cost)
        best = max((sum(value[i:j]) for i in range(31) for j in range(i, 31)), default=0.0)
        assert sum(value[a:b]) == pytest.approx(max(best, 0.0))


def test_tags_are_scanned_in_linear_time():
    import time

    for page in ("<a b='" * 100_000, "<p><b>" * 50_000, "<" * 300_000, "</a" * 100_000 + ">"):
        began = time.process_time()
        pages.main_text(page, {})
        assert time.process_time() - began < 10


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href="/a">menu</a></nav><div class="ad">Buy this now and more</div>
<article><h1>Head&amp;line</h1><p>One  two &lt;three&gt;<br>four</p><aside>side words here</aside><p><b>Bold</b> text{extra}</p><form><input><button>Send</button></form></article><div class="comments"><p>reader says a lot of things here</p></div><footer>foot</footer></body></html>"""


def made_page(rng, k):
    """A page and the text of its article; some pages mark it, readers' comments stand behind it or in it."""
    line = lambda n: " ".join(rng.choice(brute_words) for _ in range(n))
    brute_words = "stone river cloud marks light under paper seven".split()
    paragraphs = [line(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f'<li class="item" id="m{rng.randint(1, 999)}"><a href="/x">{line(2)}</a></li>' for _ in range(8))
    named = (lambda j: f'class="comment" id="comment-{rng.randint(1, 9999)}"') if k % 3 else (lambda j: "class='comment'")
    comments = "".join(f"<div {named(j)}><p>{line(30)}</p></div>" for j in range(3))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    hole = "<noscript>" if k % 7 == 0 else "<noscript>turn it on</noscript>" if k % 7 == 1 else ""
    tag = "article" if k % 4 else "div"
    inner = comments if k % 5 == 0 else f"<article><p>{line(20)}</p></article>" if k % 5 == 1 and k % 4 else ""
    html = f'<html><body><div class="top" role="banner">{line(4)}</div><ul class="menu">{menu}</ul>{hole}<{tag}>{body}{inner}</{tag}>{"" if inner else comments}<div class="side">{line(9)}</div></body></html>'
    return html, "\n".join(paragraphs)


def test_main_text_of_made_pages(spark):
    """All of the article and nothing else: no comment, with or without an id, inside the article or behind it."""
    rng = random.Random(21)
    made = [made_page(rng, k) for k in range(260)]
    long_ = "<body><article>" + "".join(f"<p>word{k} and so on</p>" for k in range(40_000)) + "</article></body>"
    rows = [(k, html, "x", 5) for k, (html, _) in enumerate(made)] + [(900, long_, "x", 5), (901, None, None, None), (3, made[3][0], "x", 5)]
    df = spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in pages.extract(df, pages.learn(df)).collect()}
    wrong = [k for k, (_, text) in enumerate(made) if got[k]["text"] != text]
    assert not wrong, (len(wrong), made[wrong[0]], got[wrong[0]]["text"])
    assert got[900]["text"].count("\n") == 39_999 and got[901]["text"] == "" and got[900]["n_chars"] == len(got[900]["text"])


def test_main_text(spark, tmp_path):
    rows = [(1, "u", PAGE.format(extra="")), (2, "u", None), (3, "u", ""), (4, "u", "<p></p><br>"), (5, "u", PAGE.format(extra=" more" * 20))] + [(10 + i, "u", PAGE.format(extra=" x" * i)) for i in range(8)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in pages.op5_main_text(spark, str(tmp_path)).collect()}
    assert got[1]["text"] == "Head&line\nOne two <three> four\nBold text"
    assert [got[k]["text"] for k in (2, 3, 4)] == ["", "", ""]
    assert got[5]["text"].endswith("Bold text" + " more" * 20) and got[5]["n_chars"] == len(got[5]["text"])


def test_quality_rules(spark, tables, docs):
    got = sorted(tuple(r)[:8] for r in quality.op6_quality_rules(spark, tables).collect())
    want = sorted((d[0], *base_rules(d[1])) for d in docs)
    assert [g[:6] for g in got] == want
    for g in got:
        assert g[6] == (g[1] < 10 or 100 * g[5] > 20 * g[1]) and not (g[6] and g[7])


def test_quality_verdict_against_brute_force(spark, tables, docs):
    labels = [tuple(r)[:2] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    want, scores = brute.quality_verdict([(d[0], d[1]) for d in docs], labels)
    got = sorted((r["doc_id"], r["kept"], round(r["llr"], 4)) for r in quality.op6_quality_rules(spark, tables).collect())
    assert [g[:2] for g in got] == sorted((d[0], k) for d, k in zip(docs, want, strict=True))
    assert [g[2] for g in got] == pytest.approx([x for _, _, x in sorted((d[0], k, x) for d, k, x in zip(docs, want, scores, strict=True))], abs=2e-4)


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_quality_learns_from_all_labels(spark, monkeypatch, few):
    """More labels of a kind than a sample would hold, broadcast or shuffled: all count, and all choose the threshold."""
    monkeypatch.setattr(tables_, "BROADCAST_ROWS", few)
    rng = random.Random(5)
    good = ["".join(rng.choice("abcdefgh ") for _ in range(24)) for _ in range(20_600)]
    bad = ["".join(rng.choice("efghijkl ") for _ in range(24)) for _ in range(20_300)]
    frame = pa.table({"doc_id": range(len(good) + len(bad)), "text": good + bad, "quality": [1] * len(good) + [0] * len(bad)})
    df = spark.createDataFrame(frame.to_pandas()).repartition(4)
    verdict = quality.learn(df, df)
    counts = []
    for texts in (good, good + bad):
        offsets = np.cumsum([0, *map(len, texts)])
        bucket, inside = quality.grams(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
        counts.append(np.bincount(bucket[inside], minlength=1 << quality.BITS))
    target, raw = counts
    size = 1 << quality.BITS
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))
    assert verdict.ratio == pytest.approx(ratio, abs=1e-6)
    scores = quality.llr(verdict.ratio, np.frombuffer("".join(good + bad).encode(), np.uint8), np.cumsum([0, *map(len, good + bad)]))
    fine, poor = np.sort(scores[: len(good)]), np.sort(scores[len(good) :])
    seen = np.unique(scores)
    cuts = np.append(seen[0] - 1, (seen[:-1] + seen[1:]) / 2)
    lost, caught = np.searchsorted(fine, cuts) / len(fine), np.searchsorted(poor, cuts) / len(poor)
    worth = np.where(lost <= quality.MAX_TRUSTED_LOSS, caught - 10 * lost, -np.inf)
    assert verdict.threshold == pytest.approx(cuts[np.argmax(worth)], abs=1e-8)


def test_quality_ratio_is_the_mean_log_ratio():
    ratio = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    texts = [b"abcd", b"ab", b"", b"xyzxyz"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality.llr(ratio, raw, offsets)
    for k, t in enumerate(texts):
        one, inside = quality.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert got[k] == pytest.approx(ratio[one].mean() if len(one) else 0.0, abs=1e-6)


def test_chat_round_trip(spark, tables):
    got = {r["conv_id"]: r for r in chat.op7_chat_format(spark, tables).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    want = {
        -1: [("user", tricky), ("assistant", tricky)],
        1: [("user", "hi <|im_end|>"), ("assistant", "back\\slash <| \\| x")],
        2: [("system", ""), ("user", ""), ("assistant", "ok\n"), ("assistant", "ok\n")],
        3: [("assistant", "<<|im_start|>")],
        None: [("user", "nobody")],
    }
    assert got.keys() == want.keys()
    for k, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got[k]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "\\n", "a\nb", "<|im_end|>", "<\\|", "\\<|", "|", "\n", "<|im_start|>user\n<|im_end|>\n", "\\\\n|n", "x" * 100_000 + "<|"])
def test_any_role_and_text_reads_back(text):
    formatted, spans = chat.render([(text, "one"), ("assistant", text), ("user", text)])
    assert chat.parse(formatted) == [(text, "one"), ("assistant", text), ("user", text)]
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == (["one", text] if text == "assistant" else [text])


def test_replies_to_nothing_begin_paths(spark):
    """Parents that are missing, later or the message itself: cycles cannot hold a path."""
    rows = [("c", 1, 1, 2, "user", "a"), ("c", 1, 2, 1, "assistant", "b"), ("c", 1, 3, 99, "user", "c"), ("c", 1, 4, 3, "assistant", "d"), ("c", 1, 5, 5, "user", "e"), ("c", 1, 6, 7, "user", "f"), ("c", 1, 7, 6, "user", "g")]
    m = spark.createDataFrame([(*r, 0.0) for r in rows], "_t string, tree long, node long, parent long, role string, text string, score double")
    got = {r["leaf"]: [t for _, t in chat.parse(r["formatted"])] for r in chat.format_paths(m, best=9).collect()}
    assert got == {2: ["a", "b"], 4: ["c", "d"], 5: ["e"], 7: ["f", "g"]}


def test_reply_tree_takes_the_best_branch(spark):
    rows = [("c1", 1, 1, None, "user", "q", 0.0), ("c1", 1, 2, 1, "assistant", "bad", 0.1), ("c1", 1, 3, 1, "assistant", "good", 0.9), ("c1", 1, 4, 3, "user", "thanks", 0.0), ("c1", 1, 5, 2, "user", "hm", 0.2)]
    m = spark.createDataFrame(rows, "_t string, tree long, node long, parent long, role string, text string, score double")
    one = chat.format_paths(m).collect()
    assert [t for _, t in chat.parse(one[0]["formatted"])] == ["q", "good", "thanks"]
    assert sorted(r["leaf"] for r in chat.format_paths(m, best=2).collect()) == [4, 5]


def test_jaccard_components(spark, tables, docs):
    got = jaccard.op8_jaccard_join(spark, tables).collect()
    want = brute_components(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_jaccard_chains_and_small_sets(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(24)]  # each links to its neighbours only
    rows += [(100 + n, " ".join(words[:n])) for n in range(1, 30)]  # prefixes of each other
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_components(rows)
    for small in (None, 40):  # wherever the boundary lies between subsets and lists
        for r in jaccard.linked(spark.read.parquet(str(tmp_path / "documents.parquet")), small=small).collect():
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("long", [2, 64])
def test_jaccard_groups_of_near_copies(spark, monkeypatch, long):
    """Many copies around the threshold, with passages that all share, in lists short and long."""
    monkeypatch.setattr(jaccard, "LONG", long)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(90):
        text = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text)))
    passage = [f"p{i}" for i in range(30)]
    rows += [(200 + k, " ".join([f"y{k}_{i}" for i in range(rng.choice([4, 8, 40]))] + passage)) for k in range(40)]
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize("long", [8, 64])
def test_jaccard_common_part_below_the_threshold_pairs_nothing(spark, monkeypatch, long):
    """Texts of one large common part that is too small to link: all its lists are known as long, and no pair comes of them."""
    monkeypatch.setattr(jaccard, "LONG", long)
    common = [f"s{i}" for i in range(150)]
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(30)), *common])) for i in range(100)]
    rows += [(200 + i, " ".join([*(f"v{k}" for k in range(30 - i)), *common])) for i in range(4)]
    found, across = [], jaccard.across

    def watched(members, parts, classes):
        pairs = across(members, parts, classes)
        open_ = members.filter(jaccard.early(F.col("n"), F.col("at"))).groupBy("sig").count().agg(F.max("count")).first()[0]
        found.append((pairs.count(), open_))
        return pairs

    monkeypatch.setattr(jaccard, "across", watched)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)
    pairs, longest = found[0]
    assert pairs == 0 and (longest or 0) <= 4


def test_jaccard_smaller_set_of_a_pair_is_early(spark):
    rows = [(n, m, i, j) for n in range(4, 40) for m in range(4, 40) for i in range(0, n, 3) for j in range(0, m, 3)]
    df = spark.createDataFrame(rows, "n int, m int, i int, j int")
    n, m, i, j = (F.col(c) for c in "nmij")
    late = F.when(n <= m, ~jaccard.early(n, i)).otherwise(False) | F.when(m <= n, ~jaccard.early(m, j)).otherwise(False)
    assert df.filter(jaccard.may_link(n, m, i, j) & late).isEmpty()


def test_parity_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, m = (int(x) for x in rng.integers(1, 400, 2))
        pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
        a, b = (np.sort(rng.permutation(pool)[:k]) for k in (n, m))
        bits, size = jaccard.bitmaps(np.concatenate([a, b]), np.array([0, n, n + m]))
        x, y = bits[: size[0]].view(np.uint64), bits[size[0] :].view(np.uint64)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))
        u, v = jaccard.minis(np.concatenate([a, b]), np.array([0, n, n + m])).view(np.uint64)
        assert sum(int(w).bit_count() for w in u ^ v) <= len(np.setxor1d(a, b))


def test_jaccard_bounds_hold():
    """Random linked sets share what the bounds ask for, in whatever order shingles come."""
    rng = np.random.default_rng(5)
    for _ in range(4000):
        n = int(rng.integers(4, 90))
        both = rng.permutation(1000)[: int(np.ceil(0.8 * n)) + int(rng.integers(0, n // 5 + 1))]
        room = int(len(both) / 0.8) - len(both)
        left = int(rng.integers(0, room + 1))
        a = np.sort(np.concatenate([both, 1000 + rng.permutation(500)[:left]]) * 7919 % 10007)
        b = np.sort(np.concatenate([both, 2000 + rng.permutation(500)[: room - left]]) * 7919 % 10007)
        x, y = len(a), len(b)
        assert 100 * len(both) >= 80 * (x + y - len(both))
        places = [(i, j) for i, v in enumerate(a[: jaccard.prefix_size(x)]) for j, w in enumerate(b[: jaccard.prefix_size(y)]) if v == w]
        assert places and min(x - places[0][0], y - places[0][1]) >= (4 * (x + y) + 8) // 9
        assert len(np.intersect1d(a[: jaccard.prefix_size(x, 2)], b[: jaccard.prefix_size(y, 2)])) >= 2


def test_deduplicated_keeps_one_of_each(spark, tables, docs):
    kept = [r["doc_id"] for r in jaccard.deduplicated(spark.read.parquet(f"{tables}/documents.parquet")).collect()]
    want = brute_components(docs)
    assert sorted(kept) == sorted(k for k, (n, c) in want.items() if k == c)


def test_null_ids_are_documents(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[100 * k : 100 * k + 60]) for k in range(3)]
    near = [t.replace(t.split()[30], "changed") for t in texts]
    rows = [(None, t, "s") for t in texts + near[:2]] + [(7, near[2], "s"), (8, "other words that stand alone here", "s"), (None, "one more text without an id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["n_shingles"], r["component_id"] or 0) for r in jaccard.op8_jaccard_join(spark, str(tmp_path)).collect())
    assert got == [(2, 0), (2, 8), *[(56, 0)] * 4, *[(56, 7)] * 2]
    kept = jaccard.deduplicated(docs)
    parts = [{r["text"] for r in kept.collect()} & set(pair) for pair in zip(texts, near, strict=True)]
    assert kept.count() == 5 and [len(p) for p in parts] == [1, 1, 1] and parts[2] == {near[2]}
    assert {r["text"] for r in mixing.mixed(docs, share=2.0).collect()} == {r[1] for r in rows}


def test_deduplicated_does_not_depend_on_the_split(spark):
    words = [f"w{i}" for i in range(900)]
    rows = [(2 * k + j, " ".join([*words[60 * k : 60 * k + 59], f"end{j}"]), f"s{k}") for k in range(15) for j in range(2)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, source string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.deduplicated(docs).collect()) == sorted(r for r in rows if r[0] % 2 == 0)


def test_packing(spark, tables, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.op9_retrieval_packing(spark, tables).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs:
        ids = [*tok.encode(d[1] or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[d[0]], key=lambda r: r["start"])
        times = sum(x[0] == d[0] for x in docs)
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("corpus", [False, True])
def test_bm25_order(corpus):
    """The neighbours' order is that of a plain BM25 over words that another document has too."""
    rng = np.random.default_rng(3)
    texts = [[int(x) for x in rng.zipf(1.4, rng.integers(1, 60)) % 90] for _ in range(50)]
    df = Counter(w for t in texts for w in set(t))
    given = np.array([3 * df[w] for w in range(90)])
    n_docs = 500 if corpus else 50
    index = packing.Bm25(50, np.repeat(np.arange(50), [len(t) for t in texts]), np.concatenate([np.array(t) for t in texts]), *((given, 500) if corpus else ()))
    mean = sum(map(len, texts)) / 50

    def score(q, d):
        total = 0.0
        for w in sorted(set(texts[q])):
            tf = texts[d].count(w)
            if tf and df[w] > 1:
                n = 3 * df[w] if corpus else df[w]
                total += np.log(1 + (n_docs - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
        return total

    for q in range(50):
        want = {d: score(q, d) for d in range(50)}
        got = index.neighbours(q).tolist()
        assert set(got) == {d for d, x in want.items() if x > 0}
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_frequencies_are_exact(spark, tables, docs, monkeypatch):
    monkeypatch.setattr(packing, "SUPPORT", 2)
    got = packing.frequencies(spark.read.parquet(f"{tables}/documents.parquet"), "text")
    want = Counter(w for d in docs for w in set(WORD.findall(d[1] or "")))
    assert sorted(got.docs.tolist()) == sorted(n for n in want.values() if n > 1) and got.n_docs == len(docs)
    assert got.mean == pytest.approx(sum(len(WORD.findall(d[1] or "")) for d in docs) / len(docs))


def test_packing_finds_neighbours_in_other_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"topic{i}word{j}" if j % 3 else f"the{j}" for j in rng.integers(0, 60, 150)) for i in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "a"))
    docs = spark.read.parquet(str(tmp_path / "a")).repartition(2, F.col("doc_id") < 100)
    sequences = defaultdict(set)
    for r in packing.packed(docs).collect():
        sequences[r["doc_id"]].add(r["sequence_id"])
    assert sum(bool(sequences[k] & sequences[100 + k]) for k in range(30)) >= 26


def test_shards_span_batches():
    texts = [f"{k} " * 5 for k in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t]), pa.array([k // 10])], names=["doc_id", "text", "lead"]) for k, t in enumerate(texts)]
    got = list(packing.shards_of(batches, 180))
    assert [k for keys, *_ in got for k in keys.to_pylist()] == list(range(50))
    assert [raw.tobytes().decode() for _, _, raw, _ in got] == ["".join(texts[a:b]) for a, b in zip(np.cumsum([0, *(g[1] for g in got)])[:-1], np.cumsum([g[1] for g in got]), strict=True)]
    assert max(g[1] for g in got) > 5 and all(keys[-1].as_py() % 10 == 9 for keys, *_ in got)


def test_words_are_encoded_alike():
    words = ["the", "don't", "it's", "naïve!!", "ñandú's", "É", "ß", "İx", "²x", "x²", "a_b", "漢字,", "a1b2", "%%%", "ª", "a<|endoftext|>", "<|endoftext|>", "x|", "é́", "the.", "ÀÿÖ×", "÷", "à", "Ãí", "ÇA!", "éa!b", "œuf", "THE", "x\u00a0y"]
    path = packing.default_tokenizer()
    tok = packing.tokenizer(path)[0]
    want = [tok.encode(w, add_special_tokens=False).ids for w in words]
    for got, ids in zip(packing.encode_words(path, words), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids
    known = packing.WordIds(path)
    data = [w.encode() for w in words]
    end = np.cumsum([len(x) for x in data])
    start = end - [len(x) for x in data]
    raw = np.frombuffer(b"".join(data), np.uint8)
    for own in (slice(0, 9), slice(5, None), slice(0, None)):  # words met before and new ones
        at, size, pool = known.of(np.arange(len(words), dtype=np.uint64)[own], raw, start[own], end[own])
        assert [pool[a : a + n].tolist() for a, n in zip(at, size, strict=True)] == want[own]


def test_sharding(spark, tables, docs):
    rows = sharding.op10_external_shuffle(spark, tables).collect()
    want = sorted((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_moves_whole_documents(spark, tables, monkeypatch):
    written = []
    settled = sharding.settled
    monkeypatch.setattr(sharding, "settled", lambda df: written.append(settled(df)) or written[-1])
    sharding.op10_external_shuffle(spark, tables)
    moved = [tuple(x) for r in next(x for x in written if "_rows" in x.columns).collect() for x in r["_rows"]]
    assert Counter(moved) == Counter(tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").collect())


def test_sharding_depends_on_the_records_alone(spark, tables, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("shard", F.lit("x")).withColumn("tags", F.create_map(F.lit("a"), F.col("n_chars")))
    docs = docs.unionByName(docs.filter("doc_id = 3").crossJoin(spark.range(50)).drop("id"))
    places = [sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffled(docs.repartition(k), F.octet_length("doc_id"), bucket_bytes=64).collect()) for k in (2, 3, 8)]
    assert places[0] == places[1] == places[2] and len(places[0]) == docs.count()
    got = sharding.shuffled(docs, F.lit(1), bucket_bytes=64)
    assert got.schema["tags"].dataType.typeName() == "map" and {tuple(r["tags"].items()) for r in got.collect()} == {(("a", n),) for n in {d[4] for d in documents()}}


def test_sharding_spreads_equal_records(spark):
    rows = spark.range(20_000, numPartitions=3).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    buckets = sharding.told_apart(rows, "number").select(F.pmod(F.xxhash64(F.lit(10), F.lit(1), "number"), F.lit(64)).alias("b"))
    sizes = [r["count"] for r in buckets.groupBy("b").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64


def test_sharding_is_a_shuffle(spark):
    df = spark.range(0, 4000, 1, 2).select(F.col("id").alias("doc_id"), F.lit(1000).cast("long").alias("size"))
    got = [r["doc_id"] for r in sharding.shuffled(df, "size", shards=1, bucket_bytes=1 << 18).orderBy("slot").collect()]
    assert sorted(got) == list(range(4000))
    assert abs(np.corrcoef(got, np.arange(4000))[0, 1]) < 0.2


def test_extra_columns_with_clashing_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({"score": F.lit("x"), "kept": F.lit(1), "n_words": F.lit("y"), "shard": F.lit(3)})
    model = language.learn(docs)
    assert language.identify(docs, model).schema["score"].dataType.typeName() == "double"
    assert quality.judge(docs, quality.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))).schema["kept"].dataType.typeName() == "boolean"
    assert jaccard.deduplicated(docs).columns == docs.columns and mixing.mixed(docs).columns == docs.columns


def test_users_columns_do_not_clash(spark, tables):
    """Columns named like inner ones stay as they are, or are not read."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id >= 90")
    own = {"_row": F.lit("r"), "cls": F.lit(1.5), "_mix": F.lit(True), "_copies": F.lit("c"), "_copy": F.lit(2), "lead": F.lit("l"), "_o": F.lit("o"), "own": F.lit("w"), "_t0": F.lit(0), "term": F.lit("t"), "_x": F.create_map(F.lit("k"), F.lit(1))}
    more = docs.withColumns(own)
    plain = sorted(r["doc_id"] for r in jaccard.deduplicated(docs).collect())
    kept = jaccard.deduplicated(more)
    assert kept.columns == more.columns and sorted(r["doc_id"] for r in kept.collect()) == plain and {r["_row"] for r in kept.collect()} == {"r"}
    mix = mixing.mixed(more)
    assert mix.columns == more.columns and Counter(r["doc_id"] for r in mix.collect()) == Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert packing.packed(more).agg(F.sum("length")).first() == packing.packed(docs).agg(F.sum("length")).first()
    assert fingerprint.edited_pairs(more).count() == suffix_tree.scored(more).count() == docs.count()
    talk = spark.read.parquet(f"{tables}/conversations.parquet").withColumns({"node": F.lit("n"), "_t": F.lit("t"), "up": F.lit(1)})
    assert chat.chains(talk).columns == ["_t", "tree", "node", "parent", "role", "text", "score"]


def test_null_ids_are_scored_and_printed(spark):
    rows = [(None, "one two three four five six"), (None, None), (1, "one two three"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in suffix_tree.scored(df).collect()) == [1, 1, 4, 7]
    assert sorted(r["n_chars"] for r in fingerprint.edited_pairs(df).collect()) == [0, 0, 13, 27]
    assert sum(r["length"] for r in packing.packed(df).collect()) == sum(r["doc_tokens"] for r in packing.packed(df).collect() if r["start"] == 0)


def test_pipeline(spark, tables):
    """Each stage against its brute-force version, on what the one before kept."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, stages = docs.columns, dict(c.STAGES)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    def after(name):
        out = stages[name](spark, docs, tables)
        assert out.columns == columns
        return out

    before = rows(docs)
    labels = [tuple(r)[:2] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    docs = after("quality rules")
    kept, _ = brute.quality_verdict([r[:2] for r in before], labels)
    assert rows(docs) == [r for r, k in zip(before, kept, strict=True) if k] and len(set(kept)) == 2
    before = rows(docs)
    docs = after("language ID")
    assert rows(docs) == [r for r in before if re.search(r"[^\W\d_]", r[1] or "")]
    before = rows(docs)
    docs = after("n-gram Jaccard join")
    parts = brute_components(before)
    assert rows(docs) == [r for r in before if parts[r[0]][1] == r[0]]
    before = rows(docs)
    docs = after("mixing sources to target weights")
    copies = brute.mix_copies([(r[0], r[1], r[3]) for r in before], mixing.OP2_SQL)
    assert rows(docs) == sorted((r for r in before for _ in range(copies[r[0]])), key=str) and len(set(copies.values())) > 1
    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = Counter()
    for r in stages["packing"](spark, docs, tables).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {r[0]: copies[r[0]] * (len(tok.encode(r[1], add_special_tokens=False).ids) + 1) for r in before if copies[r[0]]}
    whole = Counter()
    for r in c.run(spark, tables).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == pieces


def test_pipeline_of_nothing_and_of_null_ids(spark, empty, tables, tmp_path):
    import corpus_pipeline as c

    assert c.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 60")
    docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    ids = [r["doc_id"] for r in c.run(spark, str(tmp_path)).collect()]
    assert None in ids and any(ids)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FULL}/{t}.parquet'")
    got = QUERIES[name](spark, FULL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == sorted(want, key=str)
