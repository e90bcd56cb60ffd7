"""Operator 12: the prefix trie of all conversations, by a splitter-skeleton.

A conversation is the path of its turns, written as one string of digests of equal length, so that the order of strings is the
order of paths.  Paths are sorted by ranges.  A node whose conversations lie in several ranges is a prefix of a range's
splitter; these nodes are the skeleton.  The trie of the splitter paths is broadcast as its array of common prefixes (how
far the last path of a range agrees with the first of the next, and the first of a range with its last): two numbers a range,
however long paths are.  From it each task tells which of its nodes are in the skeleton, and their numbers in depth-first order.
A sorted range finishes all its other nodes with a stack; of a skeleton node it gives its share, and shares are reduced by node.
Sums over a skeleton node's subtree are differences of running sums in depth-first order.

A path of more than ``SEGMENT`` turns goes on in a further trie, under the digest of what comes before: the last level is built
first, and the totals of its roots hang below the nodes of the level before, so no conversation is held whole.  Digests are the
first 128 bits of SHA-256 over role and text; texts are read once and never sorted or shuffled.

Defined cases: null role and text are empty; turns go by ``turn``, null first, then by role and digest; repeated rows are turns
of their own; rows without a conversation id belong to no conversation and are left out; a conversation without turns ends at
the root; copies of a conversation, however many, are split over ranges (ids break ties), and only the digest of their ids, a
chain over all of them, is made in one task a node, from strings of ``CHUNK`` ids; very long texts only go through a hash; an
empty table gives an empty result; columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_batches, numbered, offsets_before, settled, table, with_arrays
from .textbuf import trimmed

SEGMENT = 1 << 16
CHUNK = 1 << 14
DIGEST = 32  # characters of a turn's digest
ROWS = 4096  # of a batch that a task gives out
#: Rows of nodes, shares and ids as they leave the sorted ranges; ``kind`` tells which.
SCHEMA = "kind int, id long, id_end long, parent_id long, depth long, root string, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, t_children long, t_leaves long, t_saved long, said string, pos long"
NODE, SHARE, ROOT, IDS = range(4)
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, digest, size): the turns of each conversation, numbered from 1; texts only leave digest and length."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, DIGEST)
    narrow = rows.filter(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), digest.alias("digest"), F.length(t).cast("long").alias("size"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("tie")]
    placed = settled(numbered(narrow, order, "place").select("conv", "place", "digest", "size"))
    starts = placed.groupBy("conv").agg(F.min("place").alias("start"))
    return placed.join(starts, "conv").select("conv", (F.col("place") - F.col("start") + 1).alias("at"), "digest", "size")


def shared_heads(turns: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """(conv, at, digest, size) of rebuilt conversations; ``at`` 0 is a mark whose size is the number of turns.

    The first h turns of c are those of the first conversation of its group, h being the CRC of c modulo ``most + 1``.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    known = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = settled(known.select("conv", "base", "h", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")))
    bases = turns.filter((F.col("conv") % group == 0) & (F.col("at") <= most)).withColumnRenamed("conv", "base")
    heads = plan.select("conv", "base", "head").join(bases, "base").filter("at <= head").select("conv", "at", "digest", "size")
    tails = turns.join(plan.select("conv", "h", "head"), "conv").filter("at > h").select("conv", (F.col("head") + F.col("at") - F.col("h")).alias("at"), "digest", "size")
    return heads.unionByName(tails).unionByName(plan.select("conv", F.lit(0).cast("long").alias("at"), F.lit("").alias("digest"), (F.col("head") + F.col("own")).alias("size")))


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv, level, path, sizes, total): the paths in segments; ``total`` is null but for the first."""
    level = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.floor((F.col("at") - 1) / F.lit(segment))).cast("long")
    each = turns.groupBy("conv", level.alias("level")).agg(F.array_sort(F.collect_list(F.when(F.col("at") > 0, F.struct("at", "digest", "size")))).alias("_t"), F.max(F.when(F.col("at") == 0, F.col("size"))).alias("total"))
    return each.select("conv", "level", F.array_join(F.transform("_t", lambda x: x["digest"]), "").alias("path"), F.transform("_t", lambda x: x["size"]).alias("sizes"), "total")


def agree(a: str, b: str, root: int) -> int:
    """Turns that two keys have in common, -1 where not even their roots are equal."""
    m = min(len(a), len(b))
    x, y = np.frombuffer(a[:m].encode(), np.uint8), np.frombuffer(b[:m].encode(), np.uint8)
    apart = np.flatnonzero(x != y)
    n = int(apart[0]) if len(apart) else m
    return -1 if n < root else (n - root) // DIGEST


@dataclass
class Skeleton:
    """The trie of the splitters: ``edge[q]`` turns are common to ranges q - 1 and q at their border, ``within[q]`` to all of q."""

    edge: np.ndarray
    within: np.ndarray

    def __post_init__(self):
        self.carried = np.full(len(self.edge), -1)  # the depth up to which nodes at a border span the one before too
        self.carried[2:] = np.minimum(self.edge[1:-1], self.within[1:-1])
        born = np.maximum(self.edge - self.carried, 0)
        born[:1] = 0
        self.first = np.concatenate([[0], np.cumsum(born)])  # numbers of the nodes that begin at each border

    def number(self, border: int, depth: int) -> int:
        while self.carried[border] >= depth:
            border -= 1
        return int(self.first[border] + depth - self.carried[border] - 1)

    def end(self, border: int, depth: int) -> int:
        """One more than the last number below a node."""
        while border + 1 < len(self.carried) and self.carried[border + 1] >= depth:
            border += 1
        return int(self.first[border + 1])


@dataclass
class Node:
    size: int
    border: int  # of the skeleton, 0 if the node is not known to be in it
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list = field(default_factory=list)
    tail: tuple | None = None
    waiting: list = field(default_factory=list)  # finished children, until the smallest conversation is known


class Range:
    """The sorted paths of one range, below depth ``start``; ``out`` gathers its rows."""

    def __init__(self, index: int, start: int, skeleton: Skeleton):
        self.index, self.start, self.skeleton = index, start, skeleton
        borders = len(skeleton.edge)
        self.left = int(skeleton.edge[index]) if index else -1
        self.right = int(skeleton.edge[index + 1]) if index + 1 < borders else -1
        self.stack: list[Node] = []
        self.root, self.root_least, self.path = None, None, ""
        self.out: list[tuple] = []

    def add(self, conv: int, root: str, root_least: int | None, path: str, sizes: list[int], ends: bool, tail: tuple | None) -> None:
        begins = self.root is None
        common = -1
        if root == self.root:
            common, most = 0, min(len(path), len(self.path)) // DIGEST
            while common < most and path[common * DIGEST : (common + 1) * DIGEST] == self.path[common * DIGEST : (common + 1) * DIGEST]:
                common += 1
        while len(self.stack) > common + 1:
            self.close(False)
        self.root, self.root_least, self.path = root, root_least, path
        for j in range(common + 1, len(sizes) + 1):
            self.stack.append(Node(sizes[j - 1] if j else 0, self.index if begins and j <= self.left else 0))
        node = self.stack[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if ends:
            node.ends.append(conv)
        node.tail = tail or node.tail

    def finish(self) -> None:
        while self.stack:
            self.close(len(self.stack) - 1 <= self.right)

    def child(self, row: tuple, parent_id: int | None, parent: int | None) -> None:
        depth, least, n, children, leaves, saved, said = row
        self.out.append((NODE, None, None, parent_id, self.start + depth, None, least, parent, n, children, leaves, saved, None, None, None, None, said, None))

    def close(self, right: bool) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        if above:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
        border = node.border or (self.index + 1 if right else 0)
        if border:
            number = self.skeleton.number(border, depth)
            parent = self.skeleton.number(border, depth - 1) if depth else None
            root = (self.root, self.root_least) if not depth else (None, None)
            tail = node.tail or (None, None, None)
            self.out.append((SHARE, number, self.skeleton.end(border, depth), parent, depth, root[0], node.least, root[1], node.n, node.children, node.leaves, node.saved, node.size, *tail, None, None))
            for k in range(0, len(node.ends), CHUNK):
                self.out.append((IDS, number, *[None] * 14, ",".join(map(str, node.ends[k : k + CHUNK])), (self.index << 32) + k))
            for row in node.waiting:
                self.child(row, number, None)
            return
        below = node.tail or (0, 0, 0)
        children = node.children + below[0]
        leaves = node.leaves + below[1] if children else 1
        saved = node.saved + below[2] + (node.n - 1) * node.size
        for row in node.waiting:
            self.child(row, None, self.root_least if self.start and not depth else node.least)
        row = (depth, node.least, node.n, children, leaves, saved, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
        if above:
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            if above.border:
                self.child(row, self.skeleton.number(above.border, depth - 1), None)
            else:
                above.waiting.append(row)
        elif self.start:
            self.out.append((ROOT, None, None, None, 0, self.root, None, None, None, children, leaves, saved, *[None] * 6))
        else:
            self.child(row, None, None)


def borders(ranged: DataFrame, root: int) -> tuple[dict[int, int], Skeleton]:
    """The place of each range that holds paths among these, and the skeleton; only prefix lengths reach the driver."""

    def ends(batches):
        first = last = p = None
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0)
                first, last, p = key[0].as_py() if first is None else first, key[-1].as_py(), batch.column(1)[0].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([first]), pa.array([last]), pa.array([agree(first, last, root)], pa.int64())], names=["p", "first", "last", "within"])

    found = settled(in_batches(ranged.select("key", F.col("_p").cast("long")), ends, "p long, first string, last string, within long"))
    held = sorted((r["p"], r["within"]) for r in found.select("p", "within").collect())
    place = {p: q for q, (p, _) in enumerate(held)}
    before = found.sparkSession.createDataFrame([(a, b) for (a, _), (b, _) in zip(held, held[1:], strict=False)], "before long, p long")
    pairs = found.select("p", "first").join(before, "p").join(found.select(F.col("p").alias("before"), "last"), "before")
    common = with_arrays(pairs, lambda a, b: [pa.array([agree(x, y, root) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())], "edge long", ["last", "first"])
    edge = np.full(len(held), -1)
    for r in common.select("p", "edge").collect():
        edge[place[r["p"]]] = r["edge"]
    return place, Skeleton(edge, np.array([w for _, w in held], np.int64))


def reduced(shares: DataFrame, ids: DataFrame) -> DataFrame:
    """Skeleton nodes from the shares of the ranges, with totals over their subtrees."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    tops = [F.max(c).alias(c) for c in ("id_end", "parent_id", "depth", "root", "size", "t_children", "t_leaves", "t_saved")]
    nodes = shares.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("root_least"), *sums, *tops)
    kids = shares.select("id", F.col("parent_id").alias("up")).distinct().groupBy("up").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("up", "id")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    children = F.col("n_children") + none("kids") + none("t_children")
    own = settled(nodes.join(kids, "id", "left").withColumn("n_children", children).withColumn("leaves", F.col("n_leaves") + none("t_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved_tokens") + none("t_saved") + (F.col("n_convs") - 1) * F.col("size")))
    running = offsets_before(own, "id", "leaves", "leaves_before")
    running = settled(offsets_before(running, "id", "saved", "saved_before"))
    last = running.select((F.col("id") + 1).alias("id_end"), (F.col("leaves_before") + F.col("leaves")).alias("leaves_upto"), (F.col("saved_before") + F.col("saved")).alias("saved_upto"))

    def chain(batches):
        at, state = None, None
        for batch in batches:
            for number, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["id", "said"])
                    at, state = number, hashlib.sha256(said.encode())
                else:
                    state.update(f",{said}".encode())
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["id", "said"])

    digests = in_batches(ids.select("id", "said", "pos").repartition("id").sortWithinPartitions("id", "pos").select("id", "said"), chain, "id long, said string")
    out = running.join(last, "id_end").join(digests, "id", "left")
    return settled(out.select("id", "parent_id", "depth", "root", "conv_id", F.coalesce("root_least", "conv_id").alias("least"), "n_convs", "n_children", (F.col("leaves_upto") - F.col("leaves_before")).alias("n_leaves"), (F.col("saved_upto") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("said", F.lit(NO_IDS)).alias("said")))


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "said"]


def solved(paths: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals of the roots) below depth ``start``; ``paths`` has conv, root, root_least, path, sizes, ends and t_*."""
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = paths.withColumn("key", F.concat("root", "path"))
    ranged = settled(keyed.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").withColumn("_p", F.spark_partition_id()))
    shared = spark.sparkContext.broadcast(borders(ranged, 64 if start else 0))

    def per_partition(batches):
        place, skeleton = shared.value
        here = None
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        types = [kinds[f.split(" ")[1]] for f in SCHEMA.split(", ")]

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in trimmed(batches):
            for p, conv, root, root_least, path, sizes, ends, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if here is None:
                    here = Range(place[p], start, skeleton)
                here.add(conv, root, root_least, path, sizes, ends, None if a is None else (a, b, c))
                if len(here.out) >= ROWS:
                    yield given(here.out)
                    here.out = []
        if here is not None:
            here.finish()
            for k in range(0, len(here.out), ROWS):
                yield given(here.out[k : k + ROWS])

    rows = settled(in_batches(ranged.select("_p", "conv", "root", "root_least", "path", "sizes", "ends", "t_children", "t_leaves", "t_saved"), per_partition, SCHEMA))
    skeleton = reduced(rows.filter(F.col("kind") == SHARE), rows.filter(F.col("kind") == IDS))
    done = rows.filter((F.col("kind") == NODE) & F.col("parent_id").isNull()).select(NODES)
    up = skeleton.select(F.col("id").alias("parent_id"), F.col("least").alias("parent_conv_id"))
    below = rows.filter((F.col("kind") == NODE) & F.col("parent_id").isNotNull()).drop("parent_conv_id").join(up, "parent_id").select(NODES)
    inner = skeleton.withColumn("depth", F.col("depth") + start).join(up, "parent_id", "left")
    if start:
        inner = inner.filter(F.col("depth") > start)
    totals = rows.filter(F.col("kind") == ROOT).select("root", "n_children", "n_leaves", "saved_tokens").unionByName(skeleton.filter("depth = 0").select("root", "n_children", "n_leaves", "saved_tokens"))
    return done.unionByName(below).unionByName(inner.select(NODES)), totals


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row a node over (conv, at, digest, size), in which each conversation has a mark at 0 with its number of turns."""
    parts = segments(turns, segment)
    longest = turns.filter("at = 0").agg(F.max("size")).first()[0]
    if longest is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    last = max(longest - 1, 0) // segment
    parts = settled(parts) if last else parts
    levels, now = [], parts.filter("level = 0").withColumns({"root": F.lit(""), "root_least": F.lit(None).cast("long")})
    for level in range(last + 1):
        key = F.sha2(F.concat("root", "path"), 256)
        now = now.withColumn("ends", F.col("total") <= (level + 1) * segment).withColumn("next", F.when(F.size("sizes") == segment, key))
        if level < last:
            now = settled(now)
            least = now.filter("next is not null").groupBy("next").agg(F.min("conv").alias("_least"))
            down = now.filter("not ends").select("conv", "next", F.col("total").alias("_total")).join(least, "next").select("conv", F.col("next").alias("root"), F.col("_least").alias("root_least"), "_total")
            deeper = parts.filter(F.col("level") == level + 1).join(down, "conv").withColumn("total", F.col("_total")).drop("_total")
        levels.append(now)
        now = deeper if level < last else None
    nodes, totals = None, None
    for level in range(last, -1, -1):
        names = {"n_children": "t_children", "n_leaves": "t_leaves", "saved_tokens": "t_saved"}
        if totals is None:
            paths = levels[level].withColumns({c: F.lit(None).cast("long") for c in names.values()})
        else:
            paths = levels[level].join(totals.withColumnsRenamed(names).withColumnRenamed("root", "next"), "next", "left")
        own, totals = solved(paths.select("conv", "root", "root_least", "path", "sizes", "ends", *names.values()), level * segment)
        totals = settled(totals) if level else None
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes.withColumnRenamed("said", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(turns_of(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH RECURSIVE byte AS (SELECT i, i AS x, 0 AS step FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, step + 1 FROM byte WHERE step < 8),
crc_table AS (SELECT list(CAST(x AS BIGINT) ORDER BY i) AS t FROM byte WHERE step = 8),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS place FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM own), crc_table),
part AS (SELECT plan.c, 0 AS piece, own.place, role, text FROM plan JOIN own ON own.c = plan.base AND own.place <= plan.h UNION ALL SELECT own.c, 1, place, role, text FROM own JOIN plan USING (c) WHERE place > h),
turn AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY piece, place) AS d, sha256(concat(length(role), ':', role, text)) AS said, length(text) AS size FROM part),
path AS (SELECT c, d, size, string_agg(said, '') OVER (PARTITION BY c ORDER BY d) AS p FROM turn UNION ALL SELECT c, 0, 0, '' FROM plan),
top AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM path),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM top GROUP BY p, d),
kid AS (SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (p)),
sums AS (SELECT a.p, sum(b.saved) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM full_node b JOIN path w ON w.c = b.conv_id AND w.d <= b.d JOIN full_node a ON a.p = w.p GROUP BY a.p)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sums s ON s.p = n.p LEFT JOIN node u ON n.d > 0 AND u.p = left(n.p, 64 * (n.d - 1))"""
