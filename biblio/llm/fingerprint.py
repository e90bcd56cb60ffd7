"""Operator 4: document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, cut after every ``PART_WORDS`` words) are hashed.  A sketch has three tables of
cells; each digest is added to one cell of each: a count, the xor of digests and the xor of their checks.
The cells of two versions subtract, and peeling recovers the digests that differ: a cell with one digest
gives it away, and it is taken out of its other cells, until all are empty.

A fingerprint holds a small sketch of all digests and a larger one: digests in groups of about ``GROUP`` by their leading
bits, each group in cells of its own, as many (``SIZES``) as it takes to peel the group from them; a group that fails them all
is written as it is.  The larger sketch gives all digests of a version back (its difference from nothing), and so a sketch of any
size.

The likeness of two fingerprints is one less the differing digests' share of all.  Their small sketches subtract, and peeling
recovers what differs.  Where that fails, larger ones do, group by group under the finer of both divisions: each group's
cells subtract and are peeled, and retried at the next of ``RETRIES`` on failure.  Only a group that even the last leaves entangled
(less than one in a billion for what a group holds) is compared digest by digest.

All of it is DataFrame functions.  Work grows with a text's length, but for dealing digests into groups, which costs
the square root of their number for each.  Neighbours in the order of ids are found with windows over ranges of ids, each of about
``RANGE_BYTES`` of text (beyond ``MAX_RANGES`` of them, longer ones); the first documents of a range are sent to the range
before it too.

Defined cases: null text is empty; texts without paragraphs are alike (1.0); a paragraph that recurs in
a text counts once; very long texts have as many groups as they need; documents of one id follow each other by text; a
null id comes last; a single document is its own next; an empty table gives an empty result; columns besides
key and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import narrow_join, settled, table

PART_WORDS = 32
BASE_CELLS = 5  # in each of three tables
GROUP = 8
SIZES = (8, 16, 48)  # cells in each of a group's tables
RETRIES = (8, 16, 48, 144)  # the same for differences of groups
ROUNDS = 10
RANGE_BYTES = 2 << 20
COARSE = 512
MAX_RANGES = 1 << 20
_PARTS = rf"(?:\S++[^\S\n]*+){{1,{PART_WORDS}}}+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def check_of(digest: Column) -> Column:
    return F.hash(digest, F.lit(7))


def entry(digest: Column, cells: Column, salt: int) -> Column:
    """A digest with its check and its cell in each table."""
    spots = [F.pmod(F.hash(digest, F.lit(100 * salt + h)), cells).alias(f"p{h}") for h in range(3)]
    return F.struct(digest.alias("d"), check_of(digest).alias("c"), *spots)


def sketch(found: Column, cells: Column, salt: int) -> Column:
    """Cells (n, d, c) of the three tables, one after the other."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).alias("c"))

    def add(cell, e):
        return F.struct((cell["n"] + 1).alias("n"), cell["d"].bitwiseXOR(e["d"]).alias("d"), cell["c"].bitwiseXOR(e["c"]).alias("c"))

    def tables(entries):
        def table_of(spot):
            return F.transform(F.sequence(F.lit(0), cells - 1), lambda s: F.aggregate(F.filter(entries, lambda e: e[spot] == s), empty, add))

        return F.concat(table_of("p0"), table_of("p1"), table_of("p2"))

    return let(F.transform(found, lambda d: entry(d, cells, salt)), tables)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peeled(cells: Column, per_table: Column, salt: int) -> Column:
    """The digests that peeling recovers from a difference; null if some stay entangled."""

    def single(cell):
        return (F.abs(cell["n"]) == 1) & (cell["c"] == check_of(cell["d"]))

    def take_out(cells_, pure):
        def cell_without(cell, i):
            here = F.filter(pure, lambda k: (i == k["p0"]) | (i == k["p1"] + per_table) | (i == k["p2"] + 2 * per_table))
            return F.aggregate(here, cell, lambda c, k: F.struct((c["n"] - k["s"]).alias("n"), c["d"].bitwiseXOR(k["d"]).alias("d"), c["c"].bitwiseXOR(k["c"]).alias("c")))

        return F.transform(cells_, cell_without)

    def round_(state, _):
        def with_pure(pure):
            return F.when(F.size(pure) == 0, F.struct(state["cells"].alias("cells"), state["got"].alias("got"), F.lit(True).alias("still"))).otherwise(
                F.struct(take_out(state["cells"], pure).alias("cells"), F.concat(state["got"], F.transform(pure, lambda k: k["d"])).alias("got"), F.lit(False).alias("still"))
            )

        singles = F.filter(state["cells"], single)
        keyed = F.array_distinct(F.transform(singles, lambda c: F.struct(c["n"].alias("s"), c["d"].alias("d"), c["c"].alias("c"), *(F.pmod(F.hash(c["d"], F.lit(100 * salt + h)), per_table).alias(f"p{h}") for h in range(3)))))
        return F.when(state["still"], state).otherwise(let(keyed, with_pure))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("got"), F.lit(False).alias("still"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    return let(done, lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["d"] == 0) & (c["c"] == 0)), s["got"]))


def bits_of(n: Column) -> Column:
    """Leading bits that deal so many digests into groups."""
    return F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / GROUP)), F.lit(0)).cast("int")


def groups(found: Column, bits: Column | None = None) -> Column:
    """The digests dealt into a power of two of groups by their leading bits, first coarsely and then finely."""

    def leading(d: Column, bits: Column) -> Column:  # a shift by 64 would be none
        return F.when(bits > 0, F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", d, F.lit(1)), F.lit(63) - bits)).otherwise(F.lit(0).cast("long"))

    def dealt(bits: Column) -> Column:
        half = F.call_function("shiftright", bits, F.lit(1))
        rest = bits - half

        def within(bucket, c):
            first = F.call_function("shiftleft", c, rest)
            return F.transform(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1), lambda g: F.filter(bucket, lambda d: leading(d, bits) == g))

        coarse = F.transform(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), half) - 1), lambda c: F.struct(c.alias("c"), F.filter(found, lambda d: leading(d, half) == c).alias("own")))
        return F.flatten(F.transform(coarse, lambda x: within(x["own"], x["c"])))

    return let(bits_of(F.size(found)) if bits is None else bits, dealt)


def kept_group(group: Column) -> Column:
    """The cells of the smallest sketch that gives the group back, with what it gives; the digests if none does."""

    def attempt(k: int):
        size = F.lit(SIZES[k])

        def given(cells):
            def answer(got):
                return F.when(got.isNotNull(), F.struct(cells.alias("cells"), got.alias("got")))

            return let(peeled(cells, size, k + 1), answer)

        return let(sketch(group, size, k + 1), given)

    plain = F.struct(F.transform(group, lambda d: F.struct(F.lit(1).alias("n"), d.alias("d"), F.lit(0).alias("c"))).alias("cells"), group.alias("got"))
    tries = attempt(len(SIZES) - 1)
    for k in reversed(range(len(SIZES) - 1)):
        tries = _or_else(attempt(k), tries)
    return _or_else(tries, plain)


def _or_else(value: Column, other: Column) -> Column:
    """``other`` where there is no value; it isn't computed where there is one."""
    return let(value, lambda v: F.when(v.isNotNull(), v).otherwise(other))


def fingerprint(found: Column) -> Column:
    """(base, groups, digests): the small sketch, the cells of each group, and the digests that these give back."""

    def of(parts):
        return F.struct(sketch(found, F.lit(BASE_CELLS), 0).alias("base"), F.transform(parts, lambda p: p["cells"]).alias("groups"), F.flatten(F.transform(parts, lambda p: p["got"])).alias("digests"))

    return let(F.transform(groups(found), kept_group), of)


def retried(pairs: Column, size: Column, salt: int) -> Column:
    """Pairs of groups (x, y, n, by), with ``n`` where sketches of this size tell it and none before did."""

    def again(p):
        got = peeled(subtract(sketch(p["x"], size, salt), sketch(p["y"], size, salt)), size, salt)
        return F.when(p["n"].isNotNull(), p).otherwise(let(got, lambda g: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(g.isNotNull(), F.size(g)).alias("n"), F.when(g.isNotNull(), size).alias("by"))))

    return F.transform(pairs, again)


def with_difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: (n, by), the number of digests in one of two fingerprints only, and the sizes of the sketches that told it."""
    x, y = F.col(a), F.col(b)
    df = df.withColumn("_small", peeled(subtract(x["base"], y["base"]), F.lit(BASE_CELLS), 0))
    df = df.withColumn("_bits", bits_of(F.greatest(F.size(x["digests"]), F.size(y["digests"]))))
    none = F.lit(None).cast("int")
    df = df.withColumn("_pairs", F.when(F.col("_small").isNull(), F.zip_with(groups(x["digests"], F.col("_bits")), groups(y["digests"], F.col("_bits")), lambda g, h: F.struct(g.alias("x"), h.alias("y"), none.alias("n"), none.alias("by")))))
    for k, cells in enumerate(RETRIES):
        df = df.withColumn("_pairs", retried(F.col("_pairs"), F.lit(cells), k + 1))
    rest = lambda p: F.size(F.array_except(p["x"], p["y"])) + F.size(F.array_except(p["y"], p["x"]))
    told = F.struct(F.aggregate("_pairs", F.lit(0), lambda n, p: n + F.coalesce(p["n"], rest(p))).alias("n"), F.array_distinct(F.transform("_pairs", lambda p: F.coalesce(p["by"], F.lit(0)))).alias("by"))
    small = F.struct(F.size("_small").alias("n"), F.array(F.lit(BASE_CELLS)).alias("by"))
    return df.withColumn(out, F.when(F.col("_small").isNotNull(), small).otherwise(told)).drop("_small", "_bits", "_pairs")


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """1 less the share of digests that are in one of two fingerprints only."""
    total = F.size(a["digests"]) + F.size(b["digests"])
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - apart["n"] / total)


def written(mark: Column) -> Column:
    """A fingerprint as text: tables of cells, the base first; a cell is its place, count, digest and check in hexadecimal digits."""

    def cells(table_: Column) -> Column:
        told = F.transform(table_, lambda c, i: F.when((c["n"] != 0) | (c["d"] != 0), F.concat_ws(":", F.hex(i), F.hex(c["n"]), F.hex(c["d"]), F.hex(c["c"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))))
        return F.concat_ws(".", F.size(table_).cast("string"), F.array_join(told, "."))

    return F.array_join(F.concat(F.array(cells(mark["base"])), F.transform(mark["groups"], cells)), "|")


def ranges_of(ordered: DataFrame, n: int) -> Column:
    """Number of the range of ids that ``_o`` falls in, descending, of about ``n``.

    Up to ``COARSE`` quantiles cut the ids; more ranges come from dividing what lies between two cuts evenly.
    """
    coarse = min(n, COARSE)
    per = -(-n // coarse)
    found = ordered.agg(F.percentile_approx("_o", [k / coarse for k in range(1, coarse)] or [0.5], 20 * coarse).alias("q"), F.min("_o").alias("a"), F.max("_o").alias("b")).first()
    cuts = sorted(set(found["q"] or []) - {found["b"]}, reverse=True) if coarse > 1 else []
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<bigint>"), lambda c: c >= F.col("_o")))
    if per == 1:
        return place
    bounds = F.array(*(F.lit(float(x)) for x in [found["b"] or 0, *cuts, (found["a"] or 0) - 1]))
    high, low = F.element_at(bounds, place + 1), F.element_at(bounds, place + 2)
    inner = F.floor((high - F.col("_o")) / F.greatest(high - low, F.lit(1.0)) * per).cast("int")
    return place * per + F.least(F.greatest(inner, F.lit(0)), F.lit(per - 1))


def with_next(docs: DataFrame, key: str, text: str, carried: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` plus ``_next``, a struct of the carried columns of the next document by descending key."""
    ordered = docs.withColumn("_o", F.coalesce(F.col(key), F.lit(-(2**63))))
    size = ordered.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = int(min(MAX_RANGES, max(1, -(-size // range_bytes))))
    ranged = ordered.withColumn("_r", ranges_of(ordered, n))
    heads = ranged.groupBy("_r").agg(F.max("_o").alias("_o"))
    ends = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each range
    sent = settled(heads.select("_o", F.coalesce(F.lag("_r").over(Window.orderBy("_r")), F.max("_r").over(ends)).alias("_g")))
    places = F.when(F.col("_g").isNull(), F.array(F.struct(F.col("_r").alias("at"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("_r").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("_g").alias("at"), F.lit(True).alias("guest"))))
    placed = narrow_join(ranged, sent, "_o", "left").withColumn("_x", F.explode(places)).withColumns({"_at": F.col("_x.at"), "_guest": F.col("_x.guest")})
    order = Window.partitionBy("_at").orderBy("_guest", F.desc("_o"), text)
    return placed.withColumn("_next", F.lead(F.struct(*carried)).over(order)).filter(~F.col("_guest")).drop("_o", "_r", "_g", "_x", "_at", "_guest")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, own, edited, following): digests of each text, its edit and the next text."""
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    paired = with_next(plain.withColumn("own", digests(F.col("_text"))), key, "_text", ["_text", "own"])
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    cut = paired.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("_next._text"), F.lit(1), half)))
    return cut.select(key, "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), "own", digests(F.col("_edited")).alias("edited"), F.col("_next.own").alias("following"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = settled(edited_pairs(table(spark, sf_dir, "documents")))  # digests, no texts
    marks = pairs.select("doc_id", "n_chars", "edited_sha256", *(fingerprint(F.col(c)).alias(c) for c in ("own", "edited")), F.when(F.col("following").isNotNull(), fingerprint(F.col("following"))).alias("following"))
    apart = with_difference(with_difference(marks, "own", "edited", "apart_edited"), "own", "following", "apart_next")
    return apart.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), F.col("apart_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.col("apart_next")).alias("near_next"),
    )
