"""Operators on small fixtures: ported cases and traps."""

import random

import pytest
from pyspark.sql import functions as F

from biblio.operators import arrange, classify, dedup, pages, quality, resolve, search, snapshot, stats, textindex, tree
from biblio.operators.snapshot import GateError
from biblio.sources import records, versions
from biblio.streaming import ingest


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# gates


@pytest.mark.parametrize("old, new, ok", [(100, 95, True), (100, 94, False), (20, 18, False), (0, 0, False), (0, 3, True)])
def test_total_gate_is_strict(old, new, ok):
    if ok:
        snapshot.gate_total(old, new)
    else:
        with pytest.raises(GateError):
            snapshot.gate_total(old, new)


def test_per_key_gate(spark):
    old = frame(spark, "p string", *[("a",)] * 10, *[("b",)] * 10, ("c",))
    new = frame(spark, "p string", *[("a",)] * 7, *[("b",)] * 8)
    assert values(snapshot.gate_per_key(old, new, "p"), "p", "old_n", "new_n") == [("a", 10, 7), ("c", 1, 0)]


def test_bulk_gate(spark):
    d = frame(spark, "k int, status string", *[(i, "changed") for i in range(11)])
    with pytest.raises(GateError):
        snapshot.gate_bulk(d, 10)
    snapshot.gate_bulk(d, 10, approved=True)


# snapshots


def test_synonyms_compare_equal(spark):
    a = frame(spark, "id int, course string", (1, "X"))
    b = frame(spark, "id int, curso string", (1, "X"))
    syn = {"course": ["curso"]}
    assert not snapshot.has_semantic_change(snapshot.comparable(a, syn), snapshot.comparable(b, syn), "id")


def test_diff_ignores_volatile_fields_at_any_depth(spark):
    schema = "id int, m struct<n:int, last_updated:string>, t map<string,string>, generated_at string"
    a = frame(spark, schema, (1, (5, "old"), {"a": "1", "updated_at": "x"}, "t1"), (2, (6, "o"), {}, "t"))
    b = frame(spark, schema, (1, (5, "new"), {"updated_at": "y", "a": "1"}, "t2"), (2, (7, "o"), {}, "t"), (3, (1, ""), None, ""))
    got = {r["id"]: (r["status"], r["changed_fields"]) for r in snapshot.diff(a, b, "id").collect()}
    assert got == {1: ("unchanged", []), 2: ("changed", ["m"]), 3: ("added", [])}


def test_add_only_is_idempotent_and_keeps_rows(spark):
    old = frame(spark, "id int, v string", (1, "a"), (2, "b"))
    new = frame(spark, "id int, v string", (2, "CHANGED"), (3, "c"))
    once = snapshot.add_only(old, new, "id")
    assert values(once, "id", "v") == [(1, "a"), (2, "b"), (3, "c")] == values(snapshot.add_only(once, new, "id"), "id", "v")


def test_upsert_needs_leave_to_change(spark):
    old = frame(spark, "id int, v string", (1, "a"), (2, "b"))
    new = frame(spark, "id int, v string", (2, "B"), (3, "c"))
    with pytest.raises(GateError):
        snapshot.upsert(old, new, "id")
    assert values(snapshot.upsert(old, new, "id", True), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_replace_processed(spark):
    old = frame(spark, "k string, v int", ("a", 1), ("b", 2))
    new = frame(spark, "k string, v int", ("a", 9))
    assert values(snapshot.replace_processed(old, new, new, "k"), "k", "v") == [("a", 9), ("b", 2)]
    assert values(snapshot.replace_processed(old, new, new, "k", full=True), "k", "v") == [("a", 9)]


def test_overlay_is_by_presence(spark):
    base = frame(spark, "id int, a string, b string", (1, "x", "y"), (2, "p", "q"))
    patch = frame(spark, "id int, a string, b string, has_b boolean", (1, "", "zz", False))
    assert values(snapshot.overlay(base, patch, "id", {"b": "has_b"}), "id", "a", "b") == [(1, "", "y"), (2, "p", "q")]


def test_enrich_missing(spark):
    base = frame(spark, "id int, photo string, link string, tags array<string>", (1, "old", "here", ["a"]), (2, None, None, []))
    patch = frame(spark, "id int, photo string, link string, tags array<string>", (1, "new", "other", []), (2, "", "set", ["b"]))
    got = snapshot.enrich_missing(base, patch, "id", {"photo": "replace", "link": "if_absent", "tags": "nonempty"})
    assert [tuple(r) for r in got.orderBy("id").select("id", "photo", "link", "tags", "changes").collect()] == [(1, "new", "here", ["a"], ["photo"]), (2, None, "set", ["b"], ["link", "tags"])]


def test_completeness_and_staging(spark):
    staged, expected = frame(spark, "k string", ("a",), ("z",)), frame(spark, "k string", ("a",), ("b",))
    assert values(snapshot.completeness(staged, expected, "k"), "k", "problem") == [("b", "missing"), ("z", "unknown")]
    assert values(snapshot.completeness(staged, expected, "k", full=False), "k", "problem") == [("z", "unknown")]
    s, p = frame(spark, "kind string, id int", ("t", 1)), frame(spark, "kind string, id int", ("t", 7), ("g", 8))
    assert values(snapshot.staged_or_previous(s, p), "kind", "id") == [("g", 8), ("t", 1)]


def test_manifest_and_report(spark):
    new, old = frame(spark, "path string, hash string", ("a", "1"), ("b", "2")), frame(spark, "path string, hash string", ("a", "1"), ("b", "x"), ("c", "3"))
    assert values(snapshot.manifest_diff(old, new), "path", "status") == [("b", "changed"), ("c", "deleted")]
    assert values(snapshot.manifest_diff(None, new), "path", "status") == [("a", "changed"), ("b", "changed")]
    changes = frame(spark, "id int, status string", *[(i, "added") for i in range(150)])
    r = snapshot.report(changes, "id").first()
    assert (r["n"], len(r["ids"]), r["omitted"]) == (150, 100, 50)
    ids = frame(spark, "p string, v array<string>", ("a", ["1", "2"])), frame(spark, "p string, v array<string>", ("a", ["2", "3"]))
    assert [tuple(x) for x in snapshot.curated_changes(*ids, "p", "v").collect()] == [("a", ["3"], ["1"])]


# duplicates

WORK = "id string, eid string, doi string, title string, year string, journal string, citations int, pii string, refs int"


def test_duplicates_by_doi_and_title(spark):
    w = frame(
        spark, WORK,
        ("20", "e20", "https://doi.org/10.1/X", "T", "2000", None, 5, "p20", None),
        ("10", "e10", "10.1/x.", None, "2000", "J", 3, None, 7),
        ("100", "e100", "10.9/other", "T", "2000", "J", 1, None, None),
        ("30", "e30", None, "Tí-tulo", "1999", "Jo", 1, None, 1), ("31", "e31", "", "ti tulo", "1999", "JO", 9, None, 2), ("32", "e32", None, "ti tulo", None, "JO", 9, None, 2),
    )
    kept, aliases = dedup.deduplicate(w)
    assert dict(values(aliases, "id", "canonical")) == {"10": "10", "20": "10", "100": "100", "30": "30", "31": "30", "32": "32"}
    assert values(kept, "id") == [("10",), ("100",), ("30",), ("32",)]
    m = {r["id"]: r for r in dedup.merge_duplicates(w, aliases, ["title", "journal", "doi"], ["pii"], ["citations"], ["refs"]).collect()}
    assert (m["10"]["title"], m["10"]["journal"], m["10"]["pii"], m["10"]["citations"], m["10"]["refs"]) == ("T", "J", None, 5, 7)
    assert (m["30"]["citations"], m["30"]["refs"]) == (9, 2)
    again, _ = dedup.deduplicate(kept)
    assert values(again, "id") == values(kept, "id")


def test_merge_same_id(spark):
    old = frame(spark, "id int, title string, j string, refs int", (1, "old", "J", 4), (2, "only", "K", 1))
    new = frame(spark, "id int, title string, j string, refs int", (1, None, "", None), (3, "n", None, None))
    assert [tuple(r) for r in dedup.merge_same_id(old, new, "id", ["title"], ["j"], ["refs"]).orderBy("id").collect()] == [(1, None, "J", 4), (2, "only", "K", 1), (3, "n", None, None)]


def test_remap_references(spark):
    e = frame(spark, "author string, work string, position int, corresponding boolean", ("a", "20", 3, False), ("a", "10", None, True), ("a", "gone", 1, False), ("b", "10", 2, None))
    w, al = frame(spark, "id string", ("10",)), frame(spark, "id string, canonical string", ("20", "10"), ("10", "10"))
    assert values(dedup.remap_references(e, w, al), "author", "work", "position", "corresponding") == [("a", "10", 1, True), ("b", "10", 2, False)]


def test_merge_authors_keeps_known_people(spark):
    rows = frame(spark, "work int, seq int, source_id string, name string, person string", (1, 1, "s", "A", "p"), (1, 2, "t", "B", ""), (1, 3, "s", "A", ""))
    r = dedup.merge_authors(rows).first()
    assert [(a["source_id"], a["person"]) for a in r["authors"]] == [("s", "p"), ("t", None)] and r["people"] == ["p"]


# resolution


def test_name_map_precedence(spark):
    prior = frame(spark, "name string, entity_id string", ("Ana", "1"), ("Bo", "1"), ("Bo", "2"), ("Cy", "9"))
    roster = frame(spark, "name string, entity_id string", ("ana", "3"))
    aliases = frame(spark, "name string, entity_id string", ("Dé-x", "4"), ("Ána", "5"))
    m = dict(values(resolve.build_name_map(prior, roster, aliases), "name_key", "entity_id"))
    assert m == {"ana": "5", "cy": "9", "de x": "4"}
    rec = frame(spark, "id int, names array<string>", (1, ["Zed", "ANA"]))
    matched, unmatched = resolve.match_names(rec, "id", "names", resolve.build_name_map(prior, roster, aliases))
    assert [(p["name"], p["entity_id"]) for p in matched.first()["people"]] == [("Zed", None), ("ANA", "5")] and values(unmatched, "name") == [("Zed",)]


def test_waterfall_and_ties(spark):
    entities = frame(spark, "entity string, name string", ("e1", "ana lima"), ("e2", "rui alves"), ("e3", "zzz"))
    authors = frame(spark, "author string, pos int, variants array<string>", ("late", 2, ["ana lima"]), ("first", 1, ["ana lima"]), ("part", 3, ["r alves"]))
    matched, left, counts = resolve.run_waterfall(entities, [("exact", lambda e: resolve.best_match(e, authors, 0.95)), ("near", lambda e: resolve.best_match(e, authors))])
    assert values(matched, "entity", "author", "confidence", "method") == [("e1", "first", 100, "exact"), ("e2", "part", 89, "near")]
    assert values(left, "entity") == [("e3",)] and values(counts, "method", "n") == [("exact", 1), ("near", 1)]
    small, large = (resolve.candidates(entities, authors, 0.2, 2, small=s) for s in (True, False))
    assert values(small, "entity", "rank", "author") == values(large, "entity", "rank", "author")


def test_short_names_match_at_any_size(spark):
    entities = frame(spark, "entity string, name string", ("e1", "ana"), ("e2", "rui oliveira"), ("e3", "mariana souza"), ("e4", "x"), ("e5", None), ("e6", ""))
    authors = frame(spark, "author string, pos int, variants array<string>", ("a", 1, ["mariana souza", None]), ("b", 2, ["li"]), ("c", 3, ["ana", "a"]), ("d", 4, ["joana max"]), ("e", 5, [""]))
    want = resolve.candidates(entities, authors, 0.2, 3, small=True)
    got = resolve.candidates(entities, authors, 0.2, 3)
    assert values(got, "entity", "rank", "author", "score") == values(want, "entity", "rank", "author", "score")
    assert ("e2", "b") in values(got, "entity", "author") and ("e1", "a") in values(got, "entity", "author")


def invented_names(rng, n):
    """Names with common surnames and given names, particles, initials, repeated parts, long ones, and parts of others."""
    given, sur = ["ana", "maria", "mariana", "jo", "joao", "rui", "li", "b"], ["silva", "silva", "silvano", "souza", "alves", "lima", "costa", "max", "o"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1:
            out.append(rng.choice(given + sur))
        elif kind < 0.15:
            out.append(" ".join(rng.choice(given + sur + ["p1", "p2", "p3"]) for _ in range(rng.randint(9, 12))))
        else:
            out.append(" ".join([rng.choice(given), *(rng.choice(given + sur + ["de"]) for _ in range(rng.randint(0, 3))), rng.choice(sur)]))
    return out


@pytest.mark.parametrize("least, k, inclusive", [(0.2, 3, False), (0.3, 5, False), (0.85, 1, True), (0.0, 2, False)])
def test_name_rungs_against_all_pairs(spark, least, k, inclusive):
    rng = random.Random(k)
    names, others = invented_names(rng, 120), invented_names(rng, 330)
    entities = frame(spark, "entity int, name string", *((i, n) for i, n in enumerate(names)))
    authors = frame(spark, "author int, pos int, variants array<string>", *((i, 999 - i, [*others[3 * i : 3 * i + rng.randint(1, 3)], None][: rng.randint(1, 4)]) for i in range(110)))
    got, want = (resolve.candidates(entities, authors, least, k, small, inclusive) for small in (None, True))
    assert values(got, "entity", "rank", "author", "score") == values(want, "entity", "rank", "author", "score")


def test_name_rungs_score_few_pairs(spark, monkeypatch):
    """Names with a few very common parts: what is scored stays within ten times what is returned."""
    rng = random.Random(1)
    given, sur = [f"given{k}" for k in range(40)], [f"surname{k}" for k in range(60)] + ["silva"] * 30
    name = lambda: " ".join([rng.choice(given), rng.choice(given), *rng.sample(sur, rng.randint(1, 2))])
    entities = spark.createDataFrame([(i, name()) for i in range(1500)], "entity int, name string")
    authors = spark.createDataFrame([(i, i, [name()]) for i in range(1500)], "author int, pos int, variants array<string>")
    scored = []
    whole = resolve._scored
    monkeypatch.setattr(resolve, "_scored", lambda pairs, *rest: scored.append(pairs.distinct().count()) or whole(pairs, *rest))
    returned = resolve.candidates(entities, authors, 0.3, 5).count()
    assert returned == 7500 and sum(scored) < 10 * returned


def test_token_roster(spark):
    roster = frame(spark, "entity string, pos int, name string", ("a", 1, "José da Silva"), ("b", 2, "Ana Maria Braga Costa"))
    names = frame(spark, "name string", ("SILVA, Jose",), ("Ana M. Braga Costa Maria",), ("Silva",))
    assert values(resolve.match_tokens(names.withColumn("name", F.regexp_replace("name", "[,.]", "")), roster), "name", "entity") == [("Ana M Braga Costa Maria", "b"), ("SILVA Jose", "a")]
    r2 = frame(spark, "entity string, pos int, name string, short string", ("x", 1, "Ana Bicalho", ""), ("y", 2, "Ana Bicalho", ""))
    assert values(resolve.match_distinctive(frame(spark, "name string", ("ana bicalho",), ("nobody",)), r2), "name", "entity", "score") == [("ana bicalho", "x", 1.0)]


@pytest.mark.parametrize("min_common", [2, 3])
def test_token_roster_against_all_pairs(spark, min_common):
    rng = random.Random(min_common)
    names, others = sorted({*invented_names(rng, 150), "", "de a"}), invented_names(rng, 90)
    stop = {"de", "da", "do", "dos", "das", "e", "a", "o", "em", "no", "na"}
    telling = lambda n: {t for t in n.split() if len(t) > 1 and t not in stop}
    want = []
    for n in names:
        hits = [(-i, f"r{i}") for i, r in enumerate(others) if telling(r) and ((c := len(telling(n) & telling(r))) == len(telling(r)) or len(telling(r)) >= 3 and c >= min_common)]
        want += [(n, min(hits)[1])] if hits else []
    roster = frame(spark, "entity string, pos int, name string", *((f"r{i}", -i, r) for i, r in enumerate(others)))
    assert values(resolve.match_tokens(frame(spark, "name string", *((n,) for n in names * 2)), roster, min_common), "name", "entity") == sorted(want)


def test_distinctive_names_against_all_pairs(spark):
    rng = random.Random(9)
    names, others = sorted({*invented_names(rng, 120), ""}), invented_names(rng, 80)
    roster = frame(spark, "entity string, pos int, name string, short string", *((f"r{i}", i, r, rng.choice(["", None, "max p1", "lima", "rui"])) for i, r in enumerate(others)))
    asked = frame(spark, "name string", *((n,) for n in names))
    p, q = resolve.name_parts(F.col("name")), resolve.name_parts(F.col("other"))
    every = asked.crossJoin(roster.withColumnRenamed("name", "other")).withColumn("score", resolve.advisor_name_similarity(p, q, F.col("short"))).filter("score >= 0.7")
    want = every.groupBy("name").agg(F.max_by(F.struct("entity", "score"), F.struct("score", -F.col("pos"))).alias("b")).select("name", "b.*")
    assert values(resolve.match_distinctive(asked, roster), "name", "entity", "score") == values(want, "name", "entity", "score")


def test_roster_merges(spark):
    m, p = frame(spark, "id int, n string", (1, "a")), frame(spark, "id int, link string", (1, "l"), (2, "k"))
    assert [tuple(r) for r in resolve.merge_roster(m, p).orderBy("id").select("id", "n", "link", "active").collect()] == [(1, "a", "l", True), (2, None, "k", False)]
    works = frame(spark, "id int, work string, areas array<string>", (1, "w1", ["x", "y"]), (1, "w2", ["y"]))
    r = resolve.merge_profile(m, frame(spark, "id int, h int", (1, 3)), works).first()
    assert (r["h"], r["top_areas"], r["works"]) == (3, ["y", "x"], ["w1", "w2"])
    got = resolve.with_default(m, frame(spark, "id int, e string", (9, "z")), "id", "e").first()
    assert got["e"] == ""


# classification


def test_rules(spark):
    rules = [{"topic": "a", "keywords": ["Mecânica"], "title_terms": ["voo"], "exclusions": ["têxtil"]}, {"topic": "b", "keywords": ["nada"]}]
    recs = frame(spark, "id int, title string, subjects string", (1, "Sobre VOO", ""), (2, "x", "mecanica dos sólidos"), (3, "voo", "Textil"), (4, None, None))
    assert sorted(((r["topic"], r["id"]) for r in classify.classify(recs, rules, "id", "title", "subjects").collect()), key=str) == [("a", 1), ("a", 2), ("b", None)]


def test_many_rules_cost_one_pass_and_take_blocks(spark, monkeypatch):
    """Rules as a table, in blocks, with terms inside each other, empty terms, repeated topics and extra columns."""
    rng = random.Random(2)
    vocabulary = ["ab", "abc", "bc", "c", "Éa", "x y", "zz", "q", ""]
    rules = [{"topic": f"t{k % 17}", "keywords": rng.sample(vocabulary[:8], rng.randint(0, 2)), "title_terms": rng.sample(vocabulary, rng.randint(0, 2)), "exclusions": rng.sample(vocabulary[:8], rng.randint(0, 1))} for k in range(40)]
    rows = [(k, "".join(rng.choice("abcéxyz q") for _ in range(rng.randint(0, 9))) or None, "".join(rng.choice("abcéxyz q") for _ in range(rng.randint(0, 9))), "x") for k in range(60)]
    low = lambda t: (t or "").lower().replace("é", "e")
    want = []
    for r in rules:
        hits = []
        for k, title, subjects, _ in rows:
            s, both = low(subjects), f"{low(title)} {low(subjects)}"
            if (any(low(t) in s for t in r["keywords"]) or any(low(t) in both for t in r["title_terms"])) and not any(low(t) in both for t in r["exclusions"]):
                hits.append(k)
        want += [(r["topic"], k) for k in hits or [None]]
    recs = frame(spark, "id int, title string, subjects string, term string", *rows)
    for chars in (1 << 20, 20):
        monkeypatch.setattr(classify, "BLOCK_CHARS", chars)
        got = classify.classify(recs, classify.rule_rows(rules, spark), "id", "title", "subjects")
        assert sorted(((r["topic"], r["id"]) for r in got.collect()), key=str) == sorted(want, key=str)
        assert sorted((r["topic"], r["id"]) for r in classify.classify(recs.limit(0), rules, "id", "title", "subjects").collect()) == sorted((r["topic"], None) for r in rules)


def test_work_rules_strict_and_folded(spark):
    rules = [{"topic": "a", "keywords": ["k1"], "title_terms": ["VLS"], "areas": ["Z"]}]
    w = frame(spark, "id int, title string, abstract string, keywords array<string>, areas array<string>", (1, "the vls", None, [], []), (2, "t", "", ["k1"], []), (3, "t", "", [], ["Z"]), (4, "t", "", ["q"], ["Z"]), (5, "t", None, None, ["Z"]))
    assert values(classify.classify_works(w, rules, "id"), "id") == [(1,), (2,), (3,), (5,)]
    assert values(classify.classify_works(w, rules, "id", strict_reference=True), "id") == [(2,), (3,), (5,)]


# statistics


def test_h_index_and_periods(spark):
    e = frame(spark, "author string, work int, citations long", *[("a", i, c) for i, c in enumerate([5, 4, 4, 1, 0])], ("b", 9, 0))
    assert values(stats.author_scorecard(e), "author", "works", "citations", "h_index") == [("a", 5, 14, 3), ("b", 1, 0, 0)] 
    assert values(stats.h_index(e), "author", "h_index") == [("a", 3), ("b", 0)]
    w = frame(spark, "id int, year int, citations int", (1, 2024, 3), (2, None, 9), (3, 2030, 1), (4, 2020, 0), (5, 2019, 2))
    got = stats.top_cited(w, {"all": None, "2y": 2}, 2, 2024)
    assert values(got, "period", "rank", "id") == [("2y", 1, 1), ("2y", 2, 3), ("all", 1, 2), ("all", 2, 1)]
    y = frame(spark, "year int, citations long", (2013, 9), (2014, 1), (2024, 2), (2025, 5))
    assert values(stats.recent_cumulative(y, 2024), "year", "cumulative") == [(2014, 1), (2024, 3)]
    assert values(stats.yearly_stats(frame(spark, "year string, citations string", ("2020", "3"), ("x", "1"), (None, "2"), ("2020", "y"))), "year", "works", "citations") == [(2020, 2, 3)]


def test_quality_score_and_degrees(spark):
    w = frame(spark, "doi string, abstract string, keywords array<string>, journal string, authors string, subject_areas array<string>, citations int", ("d", "", ["k"], "j", None, [], 0), (None, None, None, None, None, None, None))
    assert [r["quality"] for r in stats.quality_score(w, stats.WORK_WEIGHTS).collect()] == [45, 0]
    t = frame(spark, "year string, course string", ("2020", "Mestrado Acadęmico"), ("2020", "Doutorado"), ("1990", "Doutorado"))
    assert values(stats.recent_degrees(t, 2024), "year", "masters", "doctors") == [(2020, 1, 1)]


# quality


def test_schema_rules(spark):
    df = frame(spark, "id string, kind string, n int, tags array<string>, extra int", ("a", "x", 5, ["t", "t"], 1), ("", "q", 11, [], 1), ("A!", None, None, ["u"], 1))
    rules = quality.Rules(key="id", required=["id", "kind"], enums={"kind": ["x"]}, patterns={"id": "^[a-z]*$"}, bounds={"n": (0, 10)}, min_items={"tags": 1}, unique_items=["tags"], types={"n": "int"}, allowed=["id", "kind", "n", "tags"])
    got = values(quality.validate_schema(df, rules), "rule", "key")
    assert got == sorted([("required:id", ""), ("enum:kind", ""), ("maximum:n", ""), ("min_items:tags", ""), ("unique_items:tags", "a"), ("pattern:id", "A!"), ("required:kind", "A!"), ("additional", "a"), ("additional", ""), ("additional", "A!")])
    with pytest.raises(GateError):
        quality.require(quality.validate_schema(df, rules))


def test_other_rules(spark):
    df = frame(spark, "id string, kind string, path string", ("home", "page", "d/home.json"), ("b", "group", "d/c.json"))
    assert values(quality.protected(df, {"home": "root", "gone": "page"}, "id", "kind"), "key", "message") == [("gone", "missing"), ("home", "type changed")]
    assert values(quality.file_matches_id(df), "key") == [("b",)]
    nested = frame(spark, "id int, a struct<secret:int, b:array<struct<secret:int>>>", (1, (1, [(2,)])))
    assert values(quality.forbidden_fields(nested, ["secret"], "t"), "key") == [("a.b.secret",), ("a.secret",)]
    batch = frame(spark, "id string, kind string, path string", ("n", "page", ""), ("n", "page", ""))
    assert ("unique:id", "n") in values(quality.admit_batch(df, batch, quality.Rules(key="id")), "rule", "key")
    assert values(quality.scan_schemes(frame(spark, "k int, t string, u string", (1, " JavaScript:x", "mailto:a"), (2, "ok", "ftp://x")), "k", ["t"], ["u"]), "rule", "key") == [("link:u", "2"), ("scheme:t", "1")]


def test_sanitize_is_idempotent(spark):
    df = frame(spark, "id int, abstract string, authors array<struct<name:string, mail:string>>, aff array<string>, metadata map<string,string>", (1, "x", [("n", "m")], ["q"], {"source": "s", "z": "1"}), (2, None, [("n", None)], None, {"source": "s"}))
    policy = dict(drop=["abstract"], drop_nested={"authors": ["mail"]}, clear=["aff"], keep_metadata=["source"])
    once = quality.sanitize(df, **policy)
    assert [(r["id"], r["changed"]) for r in once.orderBy("id").collect()] == [(1, True), (2, False)]
    assert "abstract" not in once.columns and once.first()["metadata"] == {"source": "s"}
    assert [r["changed"] for r in quality.sanitize(once.drop("changed"), **policy).collect()] == [False, False]


# pages

LIST = """<table><tr><th>#</th><th>Title</th></tr>
<tr><td>1</td><td><a href="detail.php?num_tese=00012">A <b>title</b></a></td><td><a href="x">Ana</a> etc</td><td>XYZ</td><td>2020</td><td>Mestrado Acadęmico</td><td><a href="/p.pdf">pdf</a></td></tr>
<tr><td>2</td><td>no link</td><td>B</td><td>C</td><td>D</td><td>E</td></tr><tr><td>short</td></tr></table>"""
DETAIL = """<table><tr><td>Orientador:</td><td>Ana  Lima</td></tr><tr><td></td><td>Rui</td></tr><tr><td>Co-Orientador estrangeiro:</td><td>Bo</td></tr><tr><td>Assunto:</td><td>S1</td></tr><tr><td>t</td><td>S2</td></tr>
<tr><td>Resumo:</td><td>R1</td></tr><tr><td>Resumo</td><td>R2</td></tr><tr><td>Texto na íntegra:</td><td><a href="f.pdf">x</a></td></tr><tr><td>Outro</td><td>?</td></tr></table>"""


def test_catalogue_and_detail(spark):
    p = frame(spark, "page_id int, html string", (1, LIST), (2, "<p>none</p>"), (3, "<table><tr><td>x</td></tr></table>"))
    records_, status = pages.extract_catalogue(p, "theses", "http://h/c/list.php")
    r = records_.first()
    assert (r["id"], r["title"], r["author"], r["detail_url"], r["course"], r["pdf_url"], r["year"]) == ("00012", "A title", "Ana", "http://h/c/detail.php?num_tese=00012", "Mestrado Acadêmico", "http://h/p.pdf", "2020")
    assert values(status, "page", "status") == [(1, "ok"), (2, "no table"), (3, "no records")]
    d = pages.extract_detail(frame(spark, "page_id int, html string", (1, DETAIL)), "http://h/c/d.php")
    assert values(d, "field", "value") == sorted([("advisors", "Ana Lima"), ("advisors", "Rui"), ("co_advisors", "Bo"), ("subjects", "S1"), ("subjects", "S2"), ("abstract", "R1"), ("fulltext_url", "http://h/c/f.pdf")])


def test_references_and_links(spark):
    html = """<a href="/a">x</a><img src='b.png'><a target="_blank" rel="noopener" href=c>y</a><a target=_blank rel="noopener noreferrer" href="d">z</a>"""
    p = frame(spark, "page_id int, url string, html string", (1, "http://h/s/i.html", html))
    assert values(pages.extract_references(p), "attr", "value") == [("href", "/a"), ("href", "c"), ("href", "d"), ("src", "b.png")]
    assert pages.unsafe_blank_links(p).count() == 1
    bad = pages.check_links(p, frame(spark, "path string", ("s/b.png",), ("a/index.html",)), "http://h/")
    assert values(bad, "value") == [("c",), ("d",)]
    m = pages.marker_coverage(frame(spark, "page_id int, html string", (1, '<p data-id="x"><p data-id="y">')), frame(spark, "id string", ("x",), ("z",)), "data-id")
    assert values(m, "id", "problem") == [("y", "unexpected"), ("z", "missing")]


def test_scans_count_lines_of_many_matches(spark):
    text = "\n".join("AKIA" + "A1B2C3D4E5F6G7H8" if k % 3 else "api_key =\n'0123456789abcdef0'" for k in range(700))
    lines = {"cloud access key": [], "literal secret": []}
    for k in range(700):
        lines["cloud access key" if k % 3 else "literal secret"].append(1 + k + -(-k // 3))
    got = pages.scan_secrets(frame(spark, "id int, text string, label string", (1, text, "x"), (2, None, "x"), (3, "", "x")), "id", "text")
    assert values(got, "label", "line") == sorted((label, n) for label, own in lines.items() for n in own)


def test_profiles_and_articles_have_no_caps(spark):
    page = "".join(f'<div class="science_cont"><a class="web_s">s{k}</a><p class="trab">{k}</p></div>' for k in range(1200))
    assert len(pages.extract_profile(frame(spark, "page_id int, html string", (1, page))).first()["counters"]) == 1200


def test_scans_give_lines(spark):
    key = "AKIA" + "A" * 16
    df = frame(spark, "k int, t string", (1, f"a\nb {key}\n\n{key} api_key = '0123456789abcdefg'"), (2, "clean"), (3, None))
    assert values(pages.scan_secrets(df, "k", "t"), "label", "line") == [("cloud access key", 2), ("cloud access key", 4), ("literal secret", 4)]
    assert values(pages.scan_unsafe(frame(spark, "k int, t string", (1, "<ScRipt>\n<p onerror = x>")), "k", "t"), "label", "line") == [("event handler", 2), ("script tag", 1)]


def test_binary_audit(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (100).to_bytes(4, "big") + (50).to_bytes(4, "big")
    files = frame(spark, "path string, content binary", ("d/ok.pdf", b"%PDF-1.4"), ("d/x.jpg", b"<html>"), ("d/p.png", png), ("d/Bad Name.pdf", b"%PDF-"), ("d/f.exe", b"MZ"), ("d/e.pdf", None))
    assert set(values(pages.audit_binary_files(files), "path", "problem")) >= {("d/x.jpg", "disguised"), ("d/p.png", "dimensions"), ("d/Bad Name.pdf", "name"), ("d/f.exe", "extension")}
    assert ("d/ok.pdf",) not in values(pages.audit_binary_files(files), "path")


def test_profiles_articles_and_blocks(spark):
    html = """<div class="science_cont"><div class="web_s">Scopus</div><div class="trab">Total: 12</div><div class="cita">34</div><div class="fator">5</div></div><a href="http://s/?authorId=77">s</a><p class="resumo">Sum
 mary</p> Bolsista de Produtividade em Pesquisa do CNPq - Nível 1A"""
    r = pages.extract_profile(frame(spark, "page_id int, html string", (1, html))).first()
    assert (r["counters"][0].asDict(), r["fellowship"], r["source_id"], r["summary"]) == ({"source": "Scopus", "works": 12, "citations": 34, "h_index": 5}, "1A", "77", "Sum mary")
    art = """<div class="artigo-completo"><a class="icone-doi" href="http://dx.doi.org/10.1/q"></a><span data-tipo-ordenacao="1">7</span><span class="transform">A; B . The title . J of X , v. 1<span data-tipo-ordenacao="ano">2019</span></span></div>"""
    a = pages.extract_articles(frame(spark, "page_id int, html string", (1, art))).first()
    assert (a["doi"], a["year"], a["citations_a"], a["title"], a["journal"]) == ("10.1/q", 2019, 7, "The title", "J of X")
    text = "intro\nPROJETO 1\nLinha: Voo\nlivre\n12\nTítulo: X\nFIM\nrest\nPROJETO 2\nLinha: Solo"
    b = pages.extract_blocks(frame(spark, "k int, t string", (1, text)), "k", "t", "^PROJETO", {"line": "^Linha:", "title": "^Título:"}, "^FIM")
    assert values(b, "block", "field", "value") == [(1, "line", "Voo livre"), (1, "title", "X"), (2, "line", "Solo")]


# trees and search


def test_tree_finds_cycles_and_dangling(spark):
    n = frame(spark, "id int, parent int, position int, label string", (1, None, 0, "r"), (2, 1, 1, "a"), (3, 2, 0, "b"), (4, 5, 0, "c"), (5, 4, 0, "d"), (6, 99, 0, "e"))
    assert values(tree.ancestors(n), "id", "depth", "is_cycle", "dangling") == [(1, 0, False, False), (2, 1, False, False), (3, 2, False, False), (4, 1, True, False), (5, 1, True, False), (6, 0, False, True)]
    assert values(tree.active_path(n, frame(spark, "id int", (3,))), "id") == [(1,), (2,), (3,)]
    assert values(tree.removable(n, F.col("id") == 3), "id", "removable")[1:3] == [(2, False), (3, False)]
    assert [r["id"] for r in tree.subtree(n, 1).orderBy("sort_path").collect()] == [1, 2, 3]


def test_deep_trees_cycles_and_gaps(spark):
    """Every node has its way up, at any depth: a long chain, a cycle with a tail, a gap, strings as ids."""
    rows = [(f"n{k:03}", f"n{k - 1:03}" if k else None, k % 3, k) for k in range(150)]
    rows += [(f"c{k}", f"c{(k + 1) % 5}", 0, 0) for k in range(5)] + [("t1", "c3", 0, 0), ("t2", "t1", 0, 0), ("self", "self", 0, 0)]
    rows += [("g1", "gone", 0, 0), ("g2", "g1", 0, 0), (None, "n000", 0, 0), ("odd", None, 0, 0)]
    up = {r[0]: r[1] for r in rows if r[0]}
    want = []
    for k in up:
        path, at = [k], up[k]
        while at is not None and at in up and at not in path:
            path.append(at)
            at = up[at]
        want.append((k, path, len(path) - 1, at in path, at is not None and at not in up))
    df = frame(spark, "id string, parent string, position int, path int", *rows)
    got = tree.ancestors(df)
    assert sorted((r["id"], list(r["path"]), r["depth"], r["is_cycle"], r["dangling"]) for r in got.collect()) == sorted(want)
    assert values(tree.ancestors(df, path=False), "id", "depth", "is_cycle", "dangling") == sorted((k, *x) for k, _, *x in want)
    below = tree.subtree(df, "n010", F.col("id") != "n140").orderBy("sort_path").collect()
    assert [(r["id"], r["depth"], len(r["sort_path"])) for r in below] == [(f"n{k:03}", k - 10, k - 9) for k in range(10, 140)]
    assert values(tree.subtree(df, "c1"), "id", "depth") == [("c0", 1), ("c1", 0), ("c2", 4), ("c3", 3), ("c4", 2), ("t1", 4), ("t2", 5)]
    assert values(tree.active_path(df, frame(spark, "id string", ("n100",), ("t2",), ("nobody",))), "id") == sorted([(f"n{k:03}",) for k in range(101)] + [(f"c{k}",) for k in range(5)] + [("t1",), ("t2",)])
    assert tree.ancestors(df.limit(0)).count() == 0 and tree.subtree(df, "none").count() == 0


def test_text_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(k if k % 9 else None, "".join(rng.choice("aábcd É") for _ in range(rng.choice([0, 2, 9, 60]))) or None, "x", 1) for k in range(200)]
    df = spark.createDataFrame(rows, "doc int, text string, id string, gram int").repartition(3)
    textindex.build(df, "doc", ["text"], str(tmp_path / "index"))
    for query, near in (("", 9), ("Á", 9), ("abc", 9), ("ÁBCD", 100_000), ("abcd", 1), ("a b c", 100_000), ("zzzz", 9), ("abcdabcdabcd", 9)):
        monkeypatch.setattr(textindex, "NEAR", near)
        got = [r["id"] for r in textindex.find(spark, str(tmp_path / "index"), query).collect()]
        want = [r["doc"] for r in search.faceted_search(df, query, ["text"]).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), query


def test_search_and_views(spark):
    d = frame(spark, "id int, t string, f string, who array<string>", (1, "Ação", "x", ["a"]), (2, "acao b", "y", ["b"]))
    assert values(search.faceted_search(d, "AÇÃO", ["t"], {"f": ""}, {"who": "b"}), "id") == [(2,)]
    assert search.faceted_search(d, "", ["t"]).count() == 2
    with pytest.raises(ValueError):
        search.apply_view(d, sort="t", allowed=["id"])
    e = frame(spark, "eid string, title string, cover_date string, doi string, publication_name string, subtype string, citedby string, url string", ("2-s2.0-9", None, "2021-05-01", None, "J", "ar", "x", "u"), ("bad", "t", "", "", "", "", "", ""))
    works, bad = search.normalize_entry(e)
    w = works.first()
    assert (w["year"], w["title"], w["metrics"]["citations"]) == ("2021", "Untitled", 0) and bad.count() == 1
    m = search.master_record(frame(spark, "eid string, title string, year string, kind string, author_names string, author_ids string, journal string, issn string", ("e", "t", "2000", "Conference Paper", "A;B", "1;2", "j", "i"))).first()
    assert (m["type"], m["authors"][1]["source_id"]) == ("conference", "2")
    t = search.graduation_record(frame(spark, "id int, course string, curso string, pdf_url string, fulltext_url string", (1, "", "C", "", "f")), {}).first()
    assert (t["course"], t["pdf_url"]) == ("C", "f")


def test_line_streams_over_many_ranges(spark):
    """One long group and small ones, null groups, over ranges that cut them: as if each were scanned whole."""
    rng = random.Random(3)
    rows = [(g, k, rng.choice(["head", "x", "", "t", "12", "list | a", "list | b", "stop", None]), 7) for g, n in (("a", 900), ("b", 3), (None, 40), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc string, pos int, line string, field int").repartition(5)
    key = lambda r: (r["doc"] or "", r["pos"])
    got = sorted(arrange.carry_forward(df, "doc", "line", ["pos"], ranges=9).collect(), key=key)
    more = sorted(arrange.blocks(df, "doc", F.col("line") == "head", ["pos"], ranges=9).collect(), key=key)
    last, n = {}, {}
    for r, b, (g, k, line, _) in zip(got, more, sorted(rows, key=lambda r: (r[0] or "", r[1])), strict=True):
        last[g] = line if line not in ("", "t", None) else last.get(g, "")
        n[g] = n.get(g, 0) + (line == "head")
        assert (r["doc"], r["pos"], r["line"], b["block"], b["field"]) == (g, k, last[g], n[g], 7)
    lines = df.filter("line is not null").drop("field")
    blocks = [values(arrange.parse_blocks(lines, "doc", "pos", "^head$", {"list": r"^list \| "}, "^stop$", ranges=r).filter("doc is not null"), "doc", "block", "field", "value") for r in (1, 9)]
    assert blocks[0] == blocks[1] and len(blocks[0]) > 50
    sizes = [r["count"] for r in df.repartitionByRange(9, "doc", "pos").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * len(rows) / 9


def test_ordering(spark):
    d = frame(spark, "id int, year string, pos int, old_pos int", (1, "2000", 1, 5), (2, None, 2, None), (3, "2010", 3, 2), (4, "", 4, None))
    assert [r["id"] for r in arrange.by_year_desc(d).collect()] == [3, 1, 2, 4]
    assert [r["id"] for r in arrange.stable_merge_order(d).collect()] == [3, 1, 2, 4]
    assert [r["id"] for r in arrange.new_first(d, F.col("id").isin(1, 3)).collect()] == [3, 1, 2, 4]
    assert [r["id"] for r in arrange.by_rank(d, {"2010": 0}, "year", "pos").collect()] == [3, 1, 2, 4]
    assert arrange.same_set(d, d) and not arrange.same_set(d, d.filter("id > 1"))
    assert [r["position"] for r in arrange.position_of(frame(spark, "v array<string>", (["a", "b"],), (["c"],)), "v", F.lit("b")).collect()] == [2, None]


# sources and streaming


def test_records_and_collections(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.json").write_text('{"id": "b",\n "nome": "B"}')
    (tmp_path / "d" / "a.json").write_text('{"id": "a", "nome": ')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id string, nome string")
    rows = records.read_records(spark, str(tmp_path / "d"), schema).collect()
    assert [r["file_name"] for r in rows] == ["a.json", "b.json"] and rows[1]["nome"] == "B" and rows[0]["_corrupt_record"]
    for name, body in (("w", '{"people": [{"id": "1"}]}'), ("l", '[{"id": "2"}]'), ("x", '{"other": 1}')):
        (tmp_path / f"{name}.json").write_text(body)
    assert values(records.read_collection(spark, str(tmp_path / "w.json"), "people", schema), "id") == [("1",)]
    assert values(records.read_collection(spark, str(tmp_path / "l.json"), "people", schema), "id") == [("2",)]
    with pytest.raises(GateError):
        records.read_collection(spark, str(tmp_path / "x.json"), "people", schema)
    keyed = frame(spark, "m map<string, struct<n:int>>", ({"a": (1,)},))
    assert values(records.explode_keyed_map(keyed, "m"), "id", "n") == [("a", 1)]


def test_promotion(spark, tmp_path):
    df = frame(spark, "id int", (1,), (2,))
    with pytest.raises(GateError):
        records.promote(df, str(tmp_path / "pub" / "staging"), str(tmp_path / "pub"), "v1")
    got = records.promote(df, str(tmp_path / "st"), str(tmp_path / "pub"), "v1", gates=[lambda s: snapshot.gate_total(2, s.count())])
    assert got.count() == 2
    with pytest.raises(GateError):
        records.promote(df.limit(1), str(tmp_path / "st"), str(tmp_path / "pub"), "v2", gates=[lambda s: snapshot.gate_total(2, s.count())])
    assert versions.pointers(spark, str(tmp_path / "pub")) == [1] and versions.pointer(spark, str(tmp_path / "pub"))["version"] == "v1"
    plan = records.preview(df, frame(spark, "id int", (2,), (3,)), "id")
    assert values(plan, "action", "id") == [("create", 3), ("delete", 1)]


def test_text_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.md").write_text("é")
    (tmp_path / "a" / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules" / "y.md").write_text("skip")
    good, bad = records.read_text_tree(spark, str(tmp_path), [".md", ".js"], ["node_modules"])
    assert [r["text"] for r in good.collect()] == ["é"] and bad.count() == 1


def test_commit_survives_a_crash_and_refuses_a_second_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pub")
    old, new = frame(spark, "id int, v string", (1, "a"), (2, "b")), frame(spark, "id int, v string", (2, "c"))
    assert versions.commit(old, root, "v1", "id", expected=0) == 1
    with monkeypatch.context() as m:  # it dies when the files are there and the pointer is not
        m.setattr(versions, "bucket_digests", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.commit(new, root, "v2", "id")
    assert values(versions.read_version(spark, root), "id", "v") == [(1, "a"), (2, "b")]
    with pytest.raises(GateError):
        versions.commit(new, root, "v2", "id", expected=0)
    with monkeypatch.context() as m:  # another writer was faster, after this one had looked
        m.setattr(versions, "pointers", lambda *_: [])
        with pytest.raises(GateError):
            versions.commit(new, root, "v2", "id")
    assert versions.pointers(spark, root) == [1]
    assert versions.commit(new, root, "v2", "id") == 2 and values(versions.read_version(spark, root), "id", "v") == [(2, "c")]
    assert values(versions.read_version(spark, root, "v1"), "id", "v") == [(1, "a"), (2, "b")]
    assert versions.commit(old.limit(0), root, "none", "id") == 3 and versions.read_version(spark, root).count() == 0
    with pytest.raises(LookupError):
        versions.read_version(spark, root, "v9")


def test_versions_are_compared_by_buckets(spark, tmp_path):
    root = str(tmp_path / "pub")
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit("x").alias("_bucket_"), F.current_timestamp().alias("last_updated"))
    changed = rows.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    a, b, c = versions.commit(rows, root, "a", "id"), versions.commit(changed, root, "b", "id"), versions.commit(changed.drop("_bucket_"), root, "c", "id")
    assert [tuple(r) for r in versions.changes(spark, root, a, b).collect()] == [(77, "changed", ["v"])]
    assert versions.changes(spark, root, a, a).count() == 0
    some = versions.differing_buckets(spark, versions.pointer(spark, root, a), versions.pointer(spark, root, b))
    read = versions._rows(spark, versions.pointer(spark, root, a), some)
    assert len(some) == 1 and len(read.inputFiles()) >= 1 and read.count() < 40  # of 2000
    assert "PartitionFilters: [isnotnull(_bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [(_bucket" in read._jdf.queryExecution().toString()
    assert versions.columns_changed(spark, root, b, c) == {"added": [], "dropped": ["_bucket_"]}


def test_ingest_replaces_forces_and_prunes(spark, tmp_path):
    schema = frame(spark, "id int, v string", (1, "a")).schema

    def run(name, **how):
        src, ck, out = (str(tmp_path / f"{name}-{n}") for n in ("src", "ck", "out"))
        frame(spark, "id int, v string", (1, "a"), (2, "b"), (None, "n")).write.parquet(src)
        ingest.incremental_ingest(spark, src, schema, ck, out, "id", **how)
        frame(spark, "id int, v string", (1, "LATE"), (2, "LATE"), (3, "c"), (None, "LATE"), (3, "b")).write.mode("append").parquet(src)
        ingest.incremental_ingest(spark, src, schema, ck, out, "id", **how)
        return sorted((tuple(r) for r in ingest.ingested(spark, out, "id").collect()), key=str)

    assert run("add") == [(1, "a"), (2, "b"), (3, "b"), (None, "n")]
    assert run("all", replace=True) == [(1, "LATE"), (2, "LATE"), (3, "b"), (None, "LATE")]
    assert run("some", force=frame(spark, "id int", (2,))) == [(1, "a"), (2, "LATE"), (3, "b"), (None, "n")]
    there = ingest._before(spark, str(tmp_path / "add-out"), schema, [r[0] for r in spark.range(1).select(versions.bucket_of("id", ingest.BUCKETS)).collect()], 9)
    assert there is None or there.count() < 4


def test_incremental_ingest_resumes(spark, tmp_path):
    src, ck, out = (str(tmp_path / n) for n in ("src", "ck", "out"))
    schema = frame(spark, "id int, v string", (1, "a")).schema
    frame(spark, "id int, v string", (1, "a"), (2, "b")).write.parquet(src)
    ingest.incremental_ingest(spark, src, schema, ck, out, "id")
    frame(spark, "id int, v string", (2, "LATE"), (3, "c")).write.mode("append").parquet(src)
    ingest.incremental_ingest(spark, src, schema, ck, out, "id")
    assert values(ingest.ingested(spark, out), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    ingest.incremental_ingest(spark, src, schema, ck, out, "id")
    assert ingest.ingested(spark, out).count() == 3
