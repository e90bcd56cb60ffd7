"""Operator 13: personal data by bootstrapped contextual extraction.

Patterns of the four kinds find the base spans; they are the seeds.  Identifiers are runs of words with a digit or an ``@``.  An
identifier that is a seed lends its kind to its lexical patterns: the two words before it, the word before and the word after, and
the word before alone.  Patterns and identifiers make a graph, held as distinct (pattern, identifier) edges, and are scored in
turns: a pattern's score for a kind is the share of that kind among its identifiers, where what is not labelled counts against it,
in full if its shape rules the kind out and by ``OPEN`` else; an identifier that is no seed has the noisy-or of its sure patterns,
those with ``MIN_SCORE`` or more and ``MIN_SEEDS`` identifiers' worth of evidence, where its shape allows the kind.  After ``ROUNDS`` turns the sure patterns give their kind to the identifiers that stand
in them and overlap no base span.

Texts are read once, and only where they have a digit or an ``@`` are they searched; what goes on are spans and 64-bit hashes.
Everything is an expression of the DataFrame API.  Regular expressions are possessive and begin at edges of runs, so that they
take linear time and no stack on any text.

Defined cases: null text is empty; repeated rows and equal ids stay rows of their own; ties of patterns go to the kind that is
listed first; very long texts are searched whole, offsets come from running sums in blocks of ``BLOCK``; without seeds nothing is
added; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settled, table

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
MIN_SEEDS = 6
MIN_SCORE = 0.8
OPEN = 0.25
ROUNDS = 3
BLOCK = 256
NEAR = 64  # characters that are looked at for the words beside an identifier

_LOCAL = "[A-Za-z0-9._%+-]"
_WORD = r"[^\x09-\x0D\x20:=\x22'<>\[\],;|]"
_PLAIN = r"[^\x09-\x0D\x20:=\x22'<>\[\],;|0-9@]"
_MARKED = rf"{_PLAIN}*+[0-9@]{_WORD}*+"
#: Leftmost matches as those of the plain patterns: only the start of a run, or the end of the last match, can begin one.
PATTERNS = [
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
IDENTIFIER = rf"(?<!{_WORD}){_MARKED}(?:\x20{_MARKED})*+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def running(values: Column) -> Column:
    """The sum of what comes before each value of an array; blocks are summed first, then within."""
    fold = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")), lambda acc: acc["before"])
    whole = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    sums = F.zip_with(blocks, fold(F.transform(blocks, whole)), lambda xs, before: F.transform(fold(xs), lambda x: x + before))
    return F.when(F.size(values) > 0, F.flatten(sums)).otherwise(F.array().cast("array<bigint>"))


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    terms = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.when(i % 2 == 1, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: int, said: Column) -> Column:
    if kind == IP:
        return said.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(digits(said))
    if kind == CARD:
        return F.when(n.between(12, 19), luhn(digits(said))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == PHONE else F.lit(True)


def shapes(said: Column) -> Column:
    """The kinds that an identifier's form allows, as bits."""
    n = F.length(digits(said))
    allows = [said.contains("@"), said.rlike("^[0-9a-f]*[.:][0-9a-f]*[.:][0-9a-f.:]*$"), said.rlike(r"^[0-9\x20-]+$") & n.between(12, 19), said.rlike(r"^[0-9\x20().+/-]+$") & n.between(7, 15)]
    bits = [F.when(a, F.lit(1 << k)).otherwise(F.lit(0)) for k, a in enumerate(allows)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def matches(df: DataFrame, text: str, pattern: str, guard: Column, out: str) -> DataFrame:
    """Add ``out``: (start, end, said) of all matches, and ``<out>_gaps``: the texts before, between and behind them."""
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{out}_said", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{out}_gaps", F.when(F.size(f"{out}_said") > 0, F.split(text, pattern, -1)).otherwise(none))
    steps = F.zip_with(f"{out}_said", F.slice(f"{out}_gaps", F.lit(1), F.size(f"{out}_said")), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("said")))
    df = df.withColumn(f"{out}_steps", steps)
    df = df.withColumn(f"{out}_before", running(F.transform(f"{out}_steps", lambda s: s["gap"] + s["n"])))
    spans = F.zip_with(f"{out}_steps", f"{out}_before", lambda s, b: F.struct((b + s["gap"]).alias("start"), (b + s["gap"] + s["n"]).alias("end"), s["said"].alias("said")))
    return df.withColumn(out, spans).drop(f"{out}_said", f"{out}_steps", f"{out}_before")


def kept(spans: str, kind: int) -> Column:
    """The valid matches of a kind as (start, kind, end)."""
    return F.transform(F.filter(spans, lambda s: valid(kind, s["said"])), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def searched(docs: DataFrame) -> DataFrame:
    """(row, doc, base, ids) of (doc, text): base spans (start, kind, end), and identifiers with their patterns.

    An identifier has ``kind`` if it is a seed, -1 if it overlaps no base span, and is left out else.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc", text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    guards = [F.col("text").contains("@"), F.col("digit"), F.col("digit"), F.col("text").contains("+") & F.col("digit")]
    for k, (name, pattern, guard) in enumerate(zip(KINDS, PATTERNS, guards, strict=True)):
        df = matches(df, "text", pattern, guard, name)
        df = df.withColumn(name, kept(name, k)).drop(f"{name}_gaps")
    df = df.withColumn("base", F.array_sort(F.concat(*KINDS))).drop(*KINDS)
    df = matches(df, "text", IDENTIFIER, F.col("digit") | F.col("text").contains("@"), "ids").drop("text", "digit")
    beside = F.transform("ids", lambda s, i: F.struct(s.alias("s"), F.right(F.try_element_at("ids_gaps", i + 1), F.lit(NEAR)).alias("left"), F.left(F.try_element_at("ids_gaps", i + 2), F.lit(NEAR)).alias("right")))
    df = df.withColumn("ids", beside).drop("ids_gaps")

    def trimmed(x: Column) -> Column:
        said = x["s"]["said"]
        lead = F.length(said) - F.length(F.regexp_replace(said, "^[^A-Za-z0-9+]+", ""))
        behind = F.length(said) - F.length(F.regexp_replace(said, "[^A-Za-z0-9]++$", ""))
        start, end = x["s"]["start"] + lead, x["s"]["end"] - behind
        return F.struct(start.alias("start"), end.alias("end"), F.lower(F.substring(said, lead + 1, F.length(said) - lead - behind)).alias("said"), F.lower(x["left"]).alias("left"), F.lower(x["right"]).alias("right"))

    def judged(x: Column) -> Column:
        over = F.filter("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        same = F.filter(over, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"]))
        kind = F.when(F.size(over) == 0, F.lit(-1)).otherwise(F.coalesce(F.try_element_at(same, F.lit(1))["kind"], F.lit(-2)))
        before, before2 = F.regexp_extract(x["left"], r"(\S+)\s*$", 1), F.regexp_extract(x["left"], r"(\S+\s+\S+)\s*$", 1)
        after = F.regexp_extract(x["right"], r"^\s*(\S+)", 1)
        patterns = F.array(F.when(before2 != "", F.xxhash64(F.lit(2), F.regexp_replace(before2, r"\s+", " "))), F.when((before != "") & (after != ""), F.xxhash64(F.lit(1), before, after)), F.when(before != "", F.xxhash64(F.lit(0), before)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), F.xxhash64(x["said"]).alias("value"), shapes(x["said"]).alias("shape"), F.array_compact(patterns).alias("patterns"))

    told = F.transform(F.transform("ids", trimmed), judged)
    return df.select(F.monotonically_increasing_id().alias("row"), "doc", "base", F.filter(told, lambda x: (x["kind"] > -2) & (x["start"] < x["end"])).alias("ids"))


def sure_patterns(places: DataFrame) -> DataFrame | None:
    """(pattern, kind, score) of the sure patterns after all rounds; None if there are none.

    ``places`` has (pattern, value, kind, shape), a row a place.
    """
    edges = settled(places.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("shape").alias("shape")))
    labels, sure = None, None
    for turn in range(ROUNDS):
        if labels is None:
            held = edges.withColumn("score", (F.col("kind") >= 0).cast("double"))
        else:
            joined = edges.join(labels.withColumnsRenamed({"kind": "_kind", "score": "_score"}), "value", "left")
            held = joined.select("pattern", "shape", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("_kind", F.lit(-1))).alias("kind"), F.when(F.col("kind") >= 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"))
        sums = held.groupBy("pattern").agg(*(f for k in range(4) for f in (F.sum(evidence(k)).alias(f"k{k}"), F.sum(1 - evidence(k) - doubt(k)).alias(f"not{k}"))))
        shares = (F.struct((F.col(f"k{k}") / (F.col(f"k{k}") + F.col(f"not{k}") + 1)).alias("score"), F.lit(-k).alias("k"), F.col(f"k{k}").alias("sum")) for k in range(4))
        scored = sums.withColumn("top", F.greatest(*shares)).select("pattern", (-F.col("top.k")).alias("kind"), "top.score", F.col("top.sum").alias("evidence"))
        sure = settled(scored.filter((F.col("score") >= MIN_SCORE) & (F.col("evidence") >= MIN_SEEDS)).select("pattern", "kind", "score"))
        if sure.isEmpty():
            return None
        if turn < ROUNDS - 1:
            open_ = edges.filter("kind < 0").select("pattern", "value", "shape").join(sure, "pattern").filter(allowed())
            either = open_.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
            best = either.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
            labels = settled(best.select("value", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")))
    return sure


def evidence(kind: int) -> Column:
    return F.when(F.col("kind") == kind, F.col("score")).otherwise(F.lit(0.0))


def doubt(kind: int) -> Column:
    """What an identifier that may or may not be of a kind is spared of counting against it."""
    open_ = F.col("kind").isin(-1, kind) & (F.col("shape").bitwiseAND(F.lit(1 << kind)) > 0)
    return F.when(open_, (1 - OPEN) * (1 - evidence(kind))).otherwise(F.lit(0.0))


def allowed() -> Column:
    """Whether the shape of a row allows its kind."""
    return F.col("shape").bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(4))), F.col("kind") + 1)) > 0


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, base, spans): arrays of (start, kind, end), in order; kinds are places in ``KINDS``."""
    found = settled(searched(docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))))
    each = found.filter(F.size("ids") > 0).select("row", F.explode("ids").alias("x")).select("row", "x.*")
    places = each.select("row", "start", "end", "kind", "value", "shape", F.explode("patterns").alias("pattern"))
    sure = sure_patterns(places.select("pattern", "value", "kind", "shape"))
    if sure is None:
        return found.select("doc", "base", F.col("base").alias("spans"))
    hits = places.filter("kind < 0").drop("kind").join(sure, "pattern").filter(allowed())
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end")).alias("added"))
    joined = found.select("row", "doc", "base").join(added, "row", "left")
    return joined.select("doc", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def written(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
