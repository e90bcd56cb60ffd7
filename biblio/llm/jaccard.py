"""Operator 8: n-gram Jaccard join, size-aware with a heavy and a light side.

A document's set holds its distinct five-word shingles.  Two sets link when their Jaccard similarity
is 0.8 or more.  All sets are ordered alike, by hash, with shingles of long lists last, so that linked sets
share a shingle, or any two of them, in a short prefix:

* light: small sets enumerate the 2-subsets of their prefix, and meet in equal subsets;
* heavy: larger sets (and those small ones within reach of their sizes) meet in the inverted lists of the
  shingles of their prefix.

The boundary between them is where enumerating subsets would cost more than scanning lists, by the lengths of
all lists.  Lists are counted over the whole corpus in two passes.  The first counts the shingles of prefixes by hash; a list is
long if more than ``LONG`` documents are in it.  As long lists go last, the next shingles of their documents move up, so the second pass
counts all shingles of crowded documents, in whose prefix one list in ``CROWD`` or more is long.  In the others a shingle moves up in
about one of 4 ``CROWD`` documents at most, as a set is five times its prefix.  The ``LONGEST`` longest of all these go last.  That order only
saves work: any order gives the same links.

Each list is first scanned by one member of it; verified links make components.  Then every member outside of a list's
largest component meets the members of other components, where enough of both sets is left from there on.  The smaller set of such
a pair always stands so early in its list that it could link with one of its own size; those that do not, as texts in which a
common part is too small, are never paired with each other.  Every pair within a list is so either verified, excluded by a
bound, or in one component already; none is capped.

Pairs are first held against parity bitmaps: each shingle toggles one bit, so that bitmaps differ in no more bits than
sets differ in shingles.  What remains is verified on the sets themselves.  In a large group of texts that are all just
below the threshold, each pair is compared by its bitmaps.

Equal sets are one class, known by a 64-bit digest.  Shingles are known by 64-bit hashes.

Defined cases: null text and text without words have an empty set and link with nothing; fewer words than a
shingle make one shingle of the whole; repeated rows share a class; very long texts are sets like any other; a
component is known by its smallest class and named by its smallest id, so that documents with a null ``doc_id``
link like any other, and only a component without any id has a null name; an empty table gives an empty result;
columns besides key and text are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import free_name, in_batches, narrow_join, row_digest, settled, table, with_arrays
from .textbuf import LOWER, as_long, mix, runs, span_hash, trimmed, window_places, windows, words

SHINGLE = 5
LONG = 64
LONGEST = 2_000_000
#: One list in this many of a prefix that is long makes a document crowded.
CROWD = 10
#: Cost of one pair of a list, in signatures enumerated and shuffled.
PAIR_COST = 1 / 2
MOST_SMALL = 64
#: 64-bit words of the bitmap that goes with a set into its lists.
MINI = 4
#: Parts that a long list is dealt into.
SALTS = 64
MINIS = [f"mini{k}" for k in range(MINI)]
#: Entries that a task holds before it passes counts on.
HELD = 1 << 20


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a run and the bounds of each, ascending within it."""
    low = LOWER[raw]
    start, end, counts = words(low, offsets)
    h = span_hash(low, start, end)
    got, doc = windows(h, counts, SHINGLE)
    found, docs = [got], [doc]
    first = np.cumsum(counts) - counts
    for k in range(1, SHINGLE):  # fewer words: the whole sequence
        own = np.flatnonzero(counts == k)
        x = h[first[own]]
        for j in range(1, k):
            x = mix(x) * np.uint64(0xD6E8FEB86659FD93) + h[first[own] + j]
        found.append(mix(x + np.uint64(k)))
        docs.append(own)
    x, d = np.concatenate(found), np.concatenate(docs)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[new], np.searchsorted(d[new], np.arange(len(counts) + 1))


def classes_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The digest of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5BF03635)), dtype=np.uint64)])
    return as_long(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))


def bitmaps(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all sets, one after the other, and the number of 64-bit words of each.

    A set of n has the power of two of words that gives it n bits or more, so that the larger of two bitmaps can be
    folded to the size of the other.
    """
    n = np.diff(bounds)
    size = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64), 0)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(n)), n)
    bit = (h & (64 * size[doc] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(size.sum()), np.uint64)
    np.bitwise_xor.at(out, first[doc] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return as_long(out), size


def minis(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps of ``MINI`` words for all sets, one row a set."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = (h & np.uint64(64 * MINI - 1)).astype(np.int64)
    out = np.zeros((len(bounds) - 1) * MINI, np.uint64)
    np.bitwise_xor.at(out, MINI * doc + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return as_long(out).reshape(-1, MINI)


def prefix_size(n, k: int = 1):
    """Length of the prefix in which a set of n shares k with any linked set."""
    return n - (4 * n + 4) // 5 + k


def lists(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def classed(source: DataFrame) -> DataFrame:
    """``source`` with n_shingles, cls, a bitmap of the set's size and one of ``MINI`` words in the place of ``_text``."""

    def compute(texts: pa.Array):
        n, cls, bits, size, mini = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], [np.zeros((0, MINI), np.int64)]
        for _, _, raw, offsets in runs(texts):
            h, bounds = shingles(raw, offsets)
            n.append(np.diff(bounds))
            cls.append(classes_of(h, bounds))
            b, s = bitmaps(h, bounds)
            bits.append(b)
            size.append(s)
            mini.append(minis(h, bounds))
        return pa.array(np.concatenate(n)), pa.array(np.concatenate(cls)), lists(bits, size), *(pa.array(x) for x in np.concatenate(mini).T)

    fields = ", ".join(["n_shingles long, cls long, bits array<long>", *(f"{c} long" for c in MINIS)])
    return with_arrays(source, compute, fields, ["_text"]).drop("_text")


def list_lengths(source: DataFrame) -> DataFrame:
    """(sig, n): documents that have a shingle in the prefix of their set, by hash; sets of up to three have none."""

    def per_partition(batches):
        held, size = [], 0

        def counts():
            sig, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(sig)), pa.array(n)], names=["sig", "n"])

        for batch in trimmed(batches):
            for _, _, raw, offsets in runs(batch.column(0)):
                h, bounds = shingles(raw, offsets)
                n = np.diff(bounds)
                rank = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                held.append(h[rank < np.repeat(np.where(n > 3, prefix_size(n), 0), n)])
                size += len(held[-1])
            if size > HELD:
                yield counts()
                held, size = [], 0
        yield counts()

    return in_batches(source.select("_text"), per_partition, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))


def crowded_lengths(source: DataFrame, long_lists: np.ndarray) -> DataFrame:
    """(sig, n) of all shingles of crowded documents: one in ``CROWD`` of their prefix or more, by hash, is in ``long_lists``.

    Of a class, its first document in a task is counted.
    """
    shared = source.sparkSession.sparkContext.broadcast(long_lists)

    def per_partition(batches):
        held, size, seen = [], 0, set()

        def counts():
            sig, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(sig)), pa.array(n)], names=["sig", "n"])

        for batch in trimmed(batches):
            for _, _, raw, offsets in runs(batch.column(0)):
                h, bounds = shingles(raw, offsets)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                rank = np.arange(len(h)) - bounds[doc]
                front = np.flatnonzero(rank < np.where(n > 3, prefix_size(n), 0)[doc])
                known = np.bincount(doc[front[member(shared.value, as_long(h[front]))]], minlength=len(n))
                crowded = (known > 0) & (CROWD * known >= prefix_size(n))
                cls = classes_of(h, bounds)
                for i in np.flatnonzero(crowded).tolist():
                    c = int(cls[i])
                    crowded[i] = c not in seen
                    seen.add(c)
                held.append(h[crowded[doc]])
                size += len(held[-1])
            if size > HELD:
                yield counts()
                held, size = [], 0
        yield counts()

    return in_batches(source.select("_text"), per_partition, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))


def member(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted value is in a sorted array."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return known[at] == wanted


def longest_lists(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the longest lists, ascending, and their lengths."""
    got = lengths.filter(F.col("n") > LONG).orderBy(F.desc("n"), "sig").limit(LONGEST).toArrow().sort_by("sig")
    return got.column("sig").to_numpy(), got.column("n").to_numpy()


def boundary(crowd: float) -> int:
    """Largest size at which enumerating 2-subsets of the prefix costs no more than scanning its lists."""
    x = 3
    for n in range(4, MOST_SMALL + 1):
        p = prefix_size(n, 2)
        if p * (p - 1) / 2 <= prefix_size(n) * (1 + PAIR_COST * crowd):
            x = n
    return x


def entries(source: DataFrame, long_lists: tuple[np.ndarray, np.ndarray], small: int) -> DataFrame:
    """(sig, cls, n, at, long) of the first document of a class in a task; ``at`` is -1 for subsets."""
    shared = source.sparkSession.sparkContext.broadcast(long_lists)

    def per_run(raw, offsets, seen):
        sig, rarity = shared.value
        h, bounds = shingles(raw, offsets)
        n = np.diff(bounds)
        cls = classes_of(h, bounds)
        fresh = np.zeros(len(n), bool)
        for i, c in enumerate(cls.tolist()):
            if n[i] > 3 and c not in seen:  # sets of up to three link with equal sets only
                seen.add(c)
                fresh[i] = True
        d = np.repeat(np.arange(len(n)), n)
        d, x = d[fresh[d]], h[fresh[d]]
        late = np.zeros(len(x), np.int64)
        often = np.flatnonzero(member(sig, as_long(x)))
        late[often] = rarity[np.searchsorted(sig, as_long(x[often]))]
        order = np.lexsort((x, late, d))
        x, d, late = x[order], d[order], late[order]
        first = np.searchsorted(d, np.arange(len(n)))
        rank = np.arange(len(d)) - first[d] if len(d) else np.zeros(0, np.int64)
        own = np.flatnonzero((rank < prefix_size(n[d])) & (5 * n[d] >= 4 * small))
        out = [(as_long(x[own]), d[own], rank[own], late[own] > 0)]
        for p in np.unique(prefix_size(n[fresh & (n <= small)], 2)).tolist():
            who = np.flatnonzero(fresh & (n <= small) & (prefix_size(n, 2) == p))
            pre = x[first[who][:, None] + np.arange(p)]
            i, j = np.triu_indices(p, 1)
            subset = as_long(mix(mix(pre[:, i]) * np.uint64(0xA24BAED4963EE407) + pre[:, j])).ravel()
            out.append((subset, np.repeat(who, len(i)), np.full(len(subset), -1), np.zeros(len(subset), bool)))
        got, doc, place, often = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(got), pa.array(cls[doc]), pa.array(n[doc].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(often)], names=["sig", "cls", "n", "at", "long"])

    def per_partition(batches):
        seen: set[int] = set()
        for batch in trimmed(batches):
            for _, _, raw, offsets in runs(batch.column(0)):
                yield per_run(raw, offsets, seen)

    return in_batches(source.select("_text"), per_partition, "sig long, cls long, n int, at int, long boolean")


def met(found: DataFrame) -> DataFrame:
    """Entries whose list holds two classes or more, each class once in a list."""
    # a long list is dealt by class, as it need not be whole to be known as long
    dealt = found.withColumn("_salt", F.when(F.col("long"), F.pmod(F.col("cls"), F.lit(SALTS))).otherwise(0))
    by_list = Window.partitionBy("sig", "_salt")
    several = dealt.withColumn("_a", F.min("cls").over(by_list)).withColumn("_b", F.max("cls").over(by_list)).filter("long or _a <> _b")
    return several.select("sig", "_salt", "cls", "n", "at").distinct().drop("_salt")


def overlap_needed(a: Column, b: Column) -> Column:
    return F.floor((4 * (a + b) + 8) / 9)


def may_link(n: Column, m: Column, at: Column, place: Column) -> Column:
    """Whether sets of n and m can link if what they share lies from these places on.

    That holds in the list of the first shingle they share, where any pair that links passes.
    """
    left = F.least(n - at, m - place) >= overlap_needed(n, m)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & ((at < 0) | left)


def early(n: Column, at: Column) -> Column:
    """Whether a set of n can link with one of its size or larger, if what they share lies from this place on.

    Of any pair that ``may_link``, the smaller set is early in the list, or both if they are of one size.
    """
    return (at < 0) | (n - at >= overlap_needed(n, n))


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not differ in more bits than linked sets can."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("_n"), F.col("bits").alias("_left"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("_right"))
    words_ = F.least(F.size("_left"), F.size("_right"))

    def folded(bits: str) -> Column:
        halves = F.zip_with(F.slice(bits, 1, words_), F.slice(bits, words_ + 1, words_), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > words_, halves).otherwise(F.col(bits))

    differ = F.aggregate(F.zip_with(folded("_left"), folded("_right"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.select("a", "b").join(a, "a").join(b, "b").filter(9 * differ <= F.col("_n") + F.col("_m")).select("a", "b")


def set_of(texts: pa.Array):
    """The class and the set of each text."""
    cls, values, sizes = [np.zeros(0, np.int64)], [], []
    for _, _, raw, offsets in runs(texts):
        h, bounds = shingles(raw, offsets)
        cls.append(classes_of(h, bounds))
        values.append(as_long(h))
        sizes.append(np.diff(bounds))
    return pa.array(np.concatenate(cls)), lists(values, sizes)


def sets_of(wanted: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(cls, members) of the wanted classes, from one text of each."""
    who = settled(narrow_join(classes.select("cls", "_name"), wanted, "cls", "left_semi"))
    texts = narrow_join(source.select("_id", "_text"), settled(who.select(F.col("_name").alias("_id")).distinct()), "_id", "left_semi")
    if not who.filter("_name is null").isEmpty():  # classes whose rows all have null ids
        texts = texts.unionByName(source.filter("_id is null").select("_id", "_text"))
    found = with_arrays(texts.select("_text"), set_of, "cls long, members array<long>", ["_text"]).drop("_text")
    return settled(narrow_join(found, wanted, "cls", "left_semi").dropDuplicates(["cls"]))


def verified(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    near = settled(close(pairs, classes))
    wanted = settled(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    sets = sets_of(wanted, classes, source)
    a = sets.select(F.col("cls").alias("a"), F.col("members").alias("_left"))
    b = sets.select(F.col("cls").alias("b"), F.col("members").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right"))
    return settled(near.join(a, "a").join(b, "b").filter(100 * both >= 80 * (F.size("_left") + F.size("_right") - both)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable over the links, for every class that has one.

    Labels spread along links and then along labels, so that few rounds reach far.
    """
    edges = settled(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settled(edges.select(F.col("a").alias("cls")).distinct().withColumn("label", F.col("cls")))
    while True:
        near = edges.join(now.select(F.col("cls").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("_m")).withColumnRenamed("a", "cls")
        step = now.join(near, "cls").select("cls", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        # a label is a class: follow that class's own label
        owner = step.select(F.col("cls").alias("_of"), F.col("label").alias("_next"))
        after = settled(step.join(owner, F.col("label") == F.col("_of"), "left").select("cls", "_old", F.coalesce(F.least("_next", "label"), "label").alias("label")))
        now = after.select("cls", "label")
        if after.filter("label < _old").isEmpty():
            return now


def scanned(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's best connected member with the others."""
    weight = members.groupBy("cls").agg((F.count(F.lit(1)) / F.max("n")).alias("weight"))
    heads = members.join(weight, "cls").groupBy("sig").agg(F.max(F.struct("weight", "cls", "n", "at")).alias("_h")).select("sig", F.col("_h.cls").alias("_c"), F.col("_h.n").alias("_n"), F.col("_h.at").alias("_at"))
    fits = may_link(F.col("n"), F.col("_n"), F.col("at"), F.col("_at"))
    # among near copies, the best connected is what they are copies of
    return members.join(heads, "sig").filter((F.col("cls") != F.col("_c")) & fits).select(F.least("_c", "cls").alias("a"), F.greatest("_c", "cls").alias("b")).distinct()


def across(members: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within a list whose small bitmaps let them link.

    One of each pair is outside of the list's largest component, so that a large component costs no pairs in itself.
    """
    placed = settled(members.join(parts, "cls", "left").withColumn("part", F.coalesce("label", "cls")).drop("label"))
    sizes = placed.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("_n"), F.max(early(F.col("n"), F.col("at"))).alias("_early"))
    split = sizes.groupBy("sig").agg(F.max(F.struct("_n", "part")).alias("_h"), F.count(F.lit(1)).alias("_parts"), F.max("_early").alias("_early")).filter("_parts > 1 and _early").select("sig", F.col("_h.part").alias("_main"))
    open_ = settled(placed.join(split, "sig").join(classes.select("cls", *MINIS), "cls"))
    one = open_.filter("part <> _main").drop("_main")
    other = open_.select("sig", F.col("cls").alias("_c"), F.col("n").alias("_n"), F.col("at").alias("_at"), F.col("part").alias("_p"), (F.col("part") == F.col("_main")).alias("_in_main"), *(F.col(c).alias(f"_{c}") for c in MINIS))
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in MINIS))
    wanted = (F.col("part") != F.col("_p")) & (F.col("_in_main") | (F.col("cls") < F.col("_c"))) & may_link(F.col("n"), F.col("_n"), F.col("at"), F.col("_at")) & (9 * differ <= F.col("n") + F.col("_n"))
    first = early(F.col("n"), F.col("at"))
    pairs = one.filter(first).join(other, "sig").unionByName(one.filter(~first).join(other.filter(early(F.col("_n"), F.col("_at"))), "sig"))
    return pairs.filter(wanted).select(F.least("cls", "_c").alias("a"), F.greatest("cls", "_c").alias("b")).distinct()


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", row: Column | None = None, small: int | None = None) -> DataFrame:
    """(_row, key, n_shingles, component_id, _component) of every document; ``_row`` is ``row`` or 0.

    ``_component`` is the smallest class of the component, which tells components apart whatever their ids are.
    ``small`` sets the boundary by hand; it changes the work, not the links.
    """
    source = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"), (F.lit(0).cast("long") if row is None else row).alias("_row"))
    own = settled(classed(source))
    classes = settled(own.filter("n_shingles > 0").groupBy("cls").agg(F.min("_id").alias("_name"), F.max("n_shingles").alias("n"), F.first("bits").alias("bits"), *(F.first(c).alias(c) for c in MINIS)))
    lengths = settled(list_lengths(source).filter("n > 1"))
    usual = lengths.filter(F.col("n") <= LONG).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum("n").alias("entries")).first()
    sig, length = longest_lists(lengths)
    if len(sig):
        again = lengths.filter(F.col("n") > LONG).unionByName(crowded_lengths(source, sig))
        sig, length = longest_lists(again.groupBy("sig").agg(F.max("n").alias("n")))
    rarity = np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)
    if small is None:
        small = boundary((usual["pairs"] or 0) / (usual["entries"] or 1))
    members = settled(met(entries(source, (sig, rarity), small)))
    tested = settled(scanned(members))
    links = verified(tested, classes, source)
    parts = components(links)
    more = verified(settled(across(members, parts, classes).join(tested, ["a", "b"], "left_anti")), classes, source)
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    joined = classes.select("cls", "_name").join(parts.select("cls", F.col("label").alias("_component")), "cls", "left")
    least = settled(joined.filter("_component is not null").groupBy("_component").agg(F.min("_name").alias("_least")))
    named = narrow_join(joined, least, "_component", "left").select("cls", F.coalesce("_component", "cls").alias("_component"), F.when(F.col("_component").isNull(), F.col("_name")).otherwise(F.col("_least")).alias("component_id"))
    return narrow_join(own.select("_row", "_id", "n_shingles", "cls"), settled(named), "cls", "left").select("_row", F.col("_id").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), "_component")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key, and all rows without words.

    Rows with a null key are documents of their own, and come after others of their component.  A row is known by a
    64-bit hash of its content, which no other split of the files changes; rows that agree in every column are
    interchangeable, and of those that stay one is taken.
    """
    found = settled(linked(docs, key, text, row_digest(docs)).filter("n_shingles > 0").select("_row", F.col(key).alias("_key"), "_component"))
    first = found.groupBy("_component").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_row")).getField("_row").alias("_row"))
    name = free_name(docs, "_row")
    others = settled(found.join(first.select("_row"), "_row", "left_anti").select(F.col("_row").alias(name)).distinct())
    kept = narrow_join(docs.withColumn(name, row_digest(docs)), others, name, "left_anti")
    twice = settled(found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_row").alias(name)))
    if not twice.isEmpty():
        kept = narrow_join(kept, twice, name, "left_anti").unionByName(narrow_join(kept, twice, name, "left_semi").dropDuplicates([name]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
m AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, m.b FROM r JOIN m ON m.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = n.doc_id"""
