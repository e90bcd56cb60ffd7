"""Rule classification: all rules' terms make one automaton, so a record is read once however many rules there are.

Rules are dicts or a DataFrame (rule, topic, kind, term); ``kind`` names what a term is: ``keywords``, ``title_terms``,
``exclusions``, ``areas``.  They are taken in blocks of whole rules whose terms have about ``BLOCK_CHARS`` characters together;
a block's terms are broadcast and its automaton is built once in each Python worker.  Records never move: a task reads
them in Arrow batches and gives out the rules that hold.

A null text is empty, a null keyword or area is none, an empty term occurs in every text; a topic with several rules has a row for
each that holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from biblio.functions.text import fold_value

BLOCK_CHARS = 32 << 20
KINDS = ("keywords", "title_terms", "exclusions", "areas")

_built: dict[str, object] = {}


class Terms:
    """Terms by number, and an automaton that finds all of them in one pass over a text."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.always = [n for n, t in enumerate(terms) if not t]
        self.automaton = ahocorasick.Automaton()
        for n, term in enumerate(terms):
            if term:
                self.automaton.add_word(term, (n, len(term)))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def last(self, text: str) -> dict[int, int]:
        """Where each term that occurs in a text starts for the last time."""
        found = dict.fromkeys(self.always, len(text))
        if self.any:
            for end, (n, size) in self.automaton.iter(text):
                found[n] = end + 1 - size
        return found


class Rules:
    """The rules of a block: what each term says of which rules."""

    def __init__(self, rows: list[tuple[int, str, str]], searched: tuple[str, ...], form: Callable[[str], str]):
        self.said: dict[tuple[str, str], set[int]] = {}
        for rule, kind, term in rows:
            self.said.setdefault((kind, term if kind == "areas" else form(term)), set()).add(rule)
        self.names = sorted({t for k, t in self.said if k in searched})
        self.terms = Terms(self.names)

    def of(self, kind: str, term: str) -> set[int]:
        return self.said.get((kind, term), set())


def rule_rows(rules: list[dict], spark) -> DataFrame:
    """(rule, topic, kind, term) of rules as dicts; a rule without terms has a row with nulls."""
    rows = [(n, r["topic"], kind, term) for n, r in enumerate(rules) for kind in KINDS for term in r.get(kind) or []]
    bare = [(n, r["topic"], None, None) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows + bare, "rule int, topic string, kind string, term string")


def held_rules(records: DataFrame, key: str, texts: list, rules: DataFrame, searched: tuple[str, ...], form: Callable[[str], str], holds: Callable) -> DataFrame:
    """(rule, key) of all rules that hold; ``holds(block, *texts of a record)`` gives a block's rules for one record."""
    spark = records.sparkSession
    said = rules.filter("term is not null").select("rule", "kind", "term")
    sizes = said.groupBy("rule").agg(F.sum(F.length("term")).cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    source = records.select(F.col(f"`{key}`").alias("key"), *texts)
    schema = StructType([StructField("rule", IntegerType()), StructField("key", source.schema["key"].dataType)])
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in said.filter(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == b).collect()]
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def per_partition(batches, shared=shared, name=name):
            if name not in _built:
                _built.clear()
                _built[name] = Rules(shared.value, searched, form)
            block = _built[name]
            for batch in batches:
                which, row = [], []
                for i, record in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                    held = sorted(holds(block, *record))
                    which += held
                    row += [i] * len(held)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), batch.column(0).take(pa.array(row, pa.int64()))], names=["rule", "key"])

        part = source.mapInArrow(per_partition, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def _listed(rules: list[dict] | DataFrame, records: DataFrame) -> DataFrame:
    return rule_rows(rules, records.sparkSession) if isinstance(rules, list) else rules


def classify(records: DataFrame, rules: list[dict] | DataFrame, key: str, title: str, subjects: str) -> DataFrame:
    """(topic, key) of records by rules; every rule has a row, with a null key if nothing matches.

    A rule has ``topic``, ``keywords`` (looked for in the subjects), ``title_terms`` (in title and subjects) and
    ``exclusions``, which bar a record from it.
    """

    def holds(block: Rules, head: str | None, body: str | None) -> set[int]:
        first = fold_value(head or "") + " "
        found, barred = set(), set()
        for n, at in block.terms.last(first + fold_value(body or "")).items():
            term = block.names[n]
            found |= block.of("title_terms", term)
            if at >= len(first):
                found |= block.of("keywords", term)
            barred |= block.of("exclusions", term)
        return found - barred

    listed = _listed(rules, records)
    hits = held_rules(records, key, [F.col(f"`{title}`"), F.col(f"`{subjects}`")], listed, ("keywords", "title_terms", "exclusions"), fold_value, holds)
    return listed.select("rule", "topic").distinct().join(hits, "rule", "left").select("topic", key)


def classify_works(works: DataFrame, rules: list[dict] | DataFrame, key: str, strict_reference: bool = False) -> DataFrame:
    """(topic, key) of works with ``title``, ``abstract``, ``keywords[]``, ``areas[]``.

    Keywords must equal a rule's; else a term occurs in title or abstract; else, for works without keywords, a subject
    area is shared.  ``strict_reference`` leaves terms as written, so that those with capitals never match.
    """
    form = str if strict_reference else fold_value

    def holds(block: Rules, text: str, keywords: list | None, areas: list | None) -> set[int]:
        found = set()
        for word in keywords or []:
            if word is not None:
                found |= block.of("keywords", form(word))
        for n in block.terms.last(text if strict_reference else fold_value(text)):
            found |= block.of("title_terms", block.names[n])
        if not keywords:
            for area in areas or []:
                found |= block.of("areas", area)
        return found

    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    listed = _listed(rules, works)
    hits = held_rules(works, key, [(F.lower(text) if strict_reference else text).alias("text"), F.col("keywords"), F.col("areas")], listed, ("title_terms",), form, holds)
    return hits.join(F.broadcast(listed.select("rule", "topic").distinct()) if isinstance(rules, list) else listed.select("rule", "topic").distinct(), "rule").select("topic", key)
