"""Hierarchies held as (id, parent) rows, of any depth.

Pointers double: each round joins what a node knows of its way up with what the node at the end of that way knows, so a tree of
depth d takes about log2(d) rounds.  Each round is written to the shared folder and read again.  Ways that go on when a round has ended
none are in a cycle or below one.

Ids are unique; rows without an id are left out; a parent that is no node is dangling; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio.sources.shared import written


def _links(nodes: DataFrame) -> DataFrame:
    """(id, up, lost): the parent that exists, and whether one is named that doesn't."""
    rows = nodes.filter("id is not null").select("id", "parent")
    there = rows.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    found = rows.join(there, "parent", "left")
    return written(found.select("id", F.when(F.col("_there"), F.col("parent")).alias("up"), (F.col("parent").isNotNull() & F.col("_there").isNull()).alias("lost")))


def _climbed(start: DataFrame, more: dict[str, Callable[[Column, Column], Column]], rings: bool = False) -> DataFrame:
    """(id, at, steps, live, ...) with every pointer followed to its end; with ``rings``, those that have none until they end in a cycle.

    ``at`` is the node that ``steps`` lead to, ``live`` says that it has a parent.  ``more`` tells how further columns of the two
    halves of a way, first and then, make that of the whole.
    """
    names = ["id", "at", "steps", "live", *more]
    done, now, before = start.filter(~F.col("live")), start.filter("live"), None
    while True:
        left = now.agg(F.count(F.lit(1)), F.count_distinct("at") if rings else F.lit(None)).first()
        # a round that ends no way leaves only ways into cycles, and one that leaves as many ends has all of these on the cycles
        if not left[0] or (rings and left == before):
            break
        before = left
        ends = done.unionByName(now).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("live").alias("_live"), *(F.col(c).alias(f"_{c}") for c in more))
        both = now.join(ends, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_live").alias("live"), *(f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in more.items()))
        both = written(both)
        done, now = done.unionByName(both.filter(~F.col("live"))), both.filter("live")
    return done.unionByName(now).select(names)


def _first_steps(links: DataFrame, **more: Column) -> DataFrame:
    """Ways of one step, of none for nodes without a parent; a way is live if its end has a parent."""
    ends = links.select(F.col("id").alias("up"), F.col("up").isNotNull().alias("_on"))
    return written(links.join(ends, "up", "left").select("id", F.coalesce("up", "id").alias("at"), F.col("up").isNotNull().cast("long").alias("steps"), F.coalesce("_on", F.lit(False)).alias("live"), *(c.alias(n) for n, c in more.items())))


def _cycles(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links with each cycle's nodes made roots, and (id, cycle[]) of these: all its nodes from that one on; None without cycles."""
    climbed = _climbed(_first_steps(links), {}, rings=True)
    on = written(climbed.filter("live").select(F.col("at").alias("id")).distinct())
    if on.isEmpty():
        return links, None
    ring = written(links.join(on, "id").select("id", "up"))
    # the way from each node to the smallest of its cycle: the smallest node met, and the first step that meets it
    way = written(ring.select("id", F.col("up").alias("at"), F.lit(1).cast("long").alias("steps"), F.struct(F.col("id").alias("least"), F.lit(0).cast("long").alias("off")).alias("met"), F.lit(True).alias("new")))
    while not way.filter("new").isEmpty():  # in a cycle that is longer than the ways, one more node meets the smallest
        ends = way.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("met").alias("_met"))
        later = F.struct(F.col("_met.least").alias("least"), (F.col("_met.off") + F.col("steps")).alias("off"))
        way = written(way.join(ends, "at").select("id", F.col("_at").alias("at"), (F.col("steps") * 2).alias("steps"), F.least("met", later).alias("met"), (F.col("_met.least") < F.col("met.least")).alias("new")))
    placed = way.select("id", F.col("met.least").alias("least"), F.col("met.off").alias("off"))
    rings = placed.groupBy("least").agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "id")), asc=False), lambda x: x["id"]).alias("all"))
    # downwards by steps to the smallest is upwards along the cycle; the smallest itself comes last
    at = (F.size("all") - F.col("off")).cast("int")
    turned = placed.join(rings, "least").select("id", F.concat(F.slice("all", at, F.size("all")), F.slice("all", F.lit(1), at - 1)).alias("cycle"))
    cut = links.join(on.withColumn("_on", F.lit(True)), "id", "left").select("id", F.when(F.col("_on").isNull(), F.col("up")).alias("up"), "lost")
    return written(cut), written(turned)


def ancestors(nodes: DataFrame, path: bool = True) -> DataFrame:
    """(id, path, depth, is_cycle, dangling): the way up from each node; depth 0 is a root.

    A way into a cycle goes once around it; one that ends at a parent that is no node is dangling.  Without ``path`` rows stay
    narrow, whatever the depth.
    """
    links, cycles = _cycles(_links(nodes))
    lost = links.select(F.col("id").alias("at"), "lost")
    more = {"path": lambda a, b: F.concat(a, b)} if path else {}
    start = _first_steps(links, **({"path": F.slice(F.array("id"), F.lit(1), F.col("up").isNotNull().cast("int"))} if path else {}))
    ways = _climbed(start, more).join(lost, "at")
    if cycles is None:
        last = F.array("at")
        whole = ways.select("id", *([F.concat("path", last).alias("path")] if path else []), F.col("steps").alias("depth"), F.lit(False).alias("is_cycle"), F.col("lost").alias("dangling"))
    else:
        ways = ways.join(cycles.withColumnRenamed("id", "at"), "at", "left")
        last = F.coalesce("cycle", F.array("at"))
        whole = ways.select("id", *([F.concat("path", last).alias("path")] if path else []), (F.col("steps") + F.size(last) - 1).alias("depth"), F.col("cycle").isNotNull().alias("is_cycle"), (F.col("lost") & F.col("cycle").isNull()).alias("dangling"))
    return whole.withColumn("depth", F.col("depth").cast("int"))


def subtree(nodes: DataFrame, root, visible: Column | None = None) -> DataFrame:
    """(id, parent, depth, sort_path) below a root in order of position and id; invisible nodes hide what is below them."""
    rows = (nodes if visible is None else nodes.filter(visible)).filter("id is not null")
    own = rows.select("id", "parent", F.struct(F.col("position").cast("long").alias("p"), F.col("id").cast("string").alias("i")).alias("_step"))
    top = F.col("id") == F.lit(root)
    links = _links(own.withColumn("parent", F.when(~top, F.col("parent"))))
    below = _climbed(_first_steps(links), {}, rings=True).filter(~F.col("live") & (F.col("at") == F.lit(root))).select("id")
    steps = written(links.join(below, "id").join(own.select("id", "_step"), "id"))
    ways = _climbed(_first_steps(steps, path=F.slice(F.array("_step"), F.lit(1), F.col("up").isNotNull().cast("int"))), {"path": lambda a, b: F.concat(b, a)})
    roots = own.filter(top).select(F.col("id").alias("at"), F.col("_step").alias("_top"))
    return ways.join(roots, "at").join(own.select("id", "parent"), "id").select("id", "parent", F.col("steps").cast("int").alias("depth"), F.concat(F.array("_top"), "path").alias("sort_path"))


def active_path(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Ids of nodes that match or have a matching descendant."""
    links = _links(nodes)
    jump = written(links.filter("up is not null").select("id", "up"))
    reached = written(links.select("id").join(matches.select("id"), "id", "left_semi").distinct())
    n = reached.count()
    while n:
        above = reached.join(jump, "id").select(F.col("up").alias("id"))
        reached = written(reached.unionByName(above).distinct())  # all within twice as many steps
        now = reached.count()
        if now == n:
            break
        n = now
        jump = written(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")))
    return reached


def removable(nodes: DataFrame, protected: Column) -> DataFrame:
    """(id, parent_label, removable): nodes without children that are not protected may go."""
    parents = nodes.select(F.col("id").alias("parent"), F.col("label").alias("parent_label"))
    kids = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("_k", F.lit(True))
    marked = nodes.withColumn("_p", protected).join(parents, "parent", "left").join(kids, "id", "left")
    return marked.select("id", "parent_label", (F.col("_k").isNull() & ~F.col("_p")).alias("removable"))
