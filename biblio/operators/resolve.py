"""Entity resolution: exact maps, identifiers, similarity, waterfalls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblio.functions.names import advisor_name_similarity, best_variant_similarity, distinctive, name_parts
from biblio.functions.text import extract_orcid, fold, fold_items, fold_value, significant_tokens, tokens
from biblio.sources.shared import settled


def match_names(records: DataFrame, key: str, names: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach ids to an array of names, in order, by exact folded name; and the distinct names without one.

    ``mapping`` holds (name_key, entity_id) with one row a key.
    """
    each = records.select(key, F.posexplode(names).alias("pos", "name")).withColumn("name_key", fold(F.col("name"), "library_name"))
    joined = each.join(mapping, "name_key", "left")
    matched = joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "entity_id"))), lambda x: F.struct(x["name"].alias("name"), x["entity_id"].alias("entity_id"))).alias("people"))
    unmatched = joined.filter("entity_id is null").select("name").distinct()
    return records.join(matched, key, "left"), unmatched


def build_name_map(prior: DataFrame, roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_key, entity_id): earlier matches with one id only, then roster names, then curated aliases; later ones win."""

    def keyed(df: DataFrame, rank: int) -> DataFrame:
        return df.select(fold(F.col("name"), "library_name").alias("name_key"), "entity_id", F.lit(rank).alias("_rank"))

    sure = keyed(prior, 1).groupBy("name_key").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_max")).filter(F.col("entity_id") == F.col("_max")).select("name_key", "entity_id", F.lit(1).alias("_rank"))
    ranked = sure.unionByName(keyed(roster, 2)).unionByName(keyed(aliases, 3)).filter("name_key <> ''")
    return ranked.groupBy("name_key").agg(F.max_by("entity_id", F.struct("_rank", "entity_id")).alias("entity_id"))


def match_by_external_id(entities: DataFrame, authors: DataFrame, entity: str, author: str, text: str, extract: Callable[[Column], Column] = extract_orcid) -> DataFrame:
    """(entity, author, score 100): equal identifiers found in a text column of both; one author an identifier."""
    left = entities.select(F.col(entity), extract(F.col(text)).alias("_x")).filter("_x is not null")
    right = authors.select(F.col(author), extract(F.col(text)).alias("_x")).filter("_x is not null").groupBy("_x").agg(F.max(author).alias(author))
    return left.join(right, "_x").select(entity, author, F.lit(100).alias("score"))


#: Distinct parts of a name up to which its sets of parts are keys; the few longer names meet by single parts.
PARTS = 8
CONTAINED, SURNAME = 0.9, 0.7
SURNAME_INITIAL = 0.7 + 0.2


def _key(family: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(family), *cols)


def _earliest(keyed: DataFrame, k: int) -> DataFrame:
    """(key, author) with the k earliest authors of each key."""
    once = keyed.groupBy("key", "author").agg(F.min("pos").alias("pos"))
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("pos", "author"))).filter(F.col("_r") <= k).select("key", "author")


def _whole_keys(name: Column, surname: bool, initial: bool) -> Column:
    """Keys of names that are alike by a rung with one score: equal, same surname and initial, same surname."""
    p = tokens(name)
    keys = [_key(1, name)]
    if initial:
        keys.append(_key(2, F.try_element_at(p, F.lit(-1)), F.substring(F.try_element_at(p, F.lit(1)), 1, 1)))
    if surname:
        keys.append(_key(3, F.try_element_at(p, F.lit(-1))))
    return F.array(*keys)


def _contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): distinct names of several parts that lie within another.

    The first part of the inner name ends a part of the outer, and its second begins the next, or is it if a third follows.
    """
    size = lambda x: F.least(F.length(x), F.lit(3))
    p = tokens(F.col("inner"))
    second = F.when(F.size(p) > 2, F.concat(F.lit("="), p[1])).otherwise(p[1].substr(F.lit(1), size(p[1])))
    left = inner.filter(F.size(p) > 1).select("inner", _key(4, p[0].substr(F.length(p[0]) - size(p[0]) + 1, size(p[0])), second).alias("key"))
    q = tokens(F.col("outer"))
    ends = lambda u: F.array_distinct(F.transform(F.sequence(F.lit(1), size(u)), lambda n: u.substr(F.length(u) - n + 1, n)))
    begins = lambda v: F.array_append(F.transform(F.sequence(F.lit(1), size(v)), lambda n: v.substr(F.lit(1), n)), F.concat(F.lit("="), v))
    both = F.zip_with(F.slice(q, 1, F.size(q) - 1), F.slice(q, 2, F.size(q) - 1), lambda u, v: F.flatten(F.transform(ends(u), lambda x: F.transform(begins(v), lambda y: _key(4, x, y)))))
    right = outer.filter(F.size(q) > 1).select("outer", F.explode(F.array_distinct(F.flatten(both))).alias("key"))
    return left.join(right, "key").filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def _contained_parts(inner: DataFrame, parts: DataFrame) -> DataFrame:
    """(inner, part): distinct names of one part, and the distinct parts they lie within."""
    alone = inner.filter(~F.col("inner").contains(" "))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.transform(F.sequence(F.lit(1), F.length("part") - i + 1), lambda n: F.col("part").substr(i, n))))
    return parts.select("part", F.explode(F.array_distinct(cuts)).alias("inner")).join(alone, "inner")


def _sets(name: Column) -> Column:
    """(n, key) of every set of a name's distinct parts."""
    p = F.array_sort(F.array_distinct(tokens(name)))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.least(F.size(p), F.lit(PARTS))).cast("int") - 1)
    return F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("n"), _key(5, F.array_join(F.filter(p, lambda _, i: F.getbit(m, i) == 1), " ")).alias("key")))


def _long(name: Column) -> Column:
    return F.size(F.array_distinct(tokens(name))) > PARTS


def alike_pairs(entities: DataFrame, authors: DataFrame, passes: Callable[[float], bool], k: int) -> DataFrame:
    """(entity, author): the pairs of the rungs that give all names one score, the k earliest authors for each key."""
    theirs = settled(authors.select("author", "pos", F.explode(F.array_distinct("variants")).alias("outer")).filter("outer <> ''"))
    ours = entities.filter("name <> ''").select("entity", "name")
    surname, initial = passes(SURNAME), passes(SURNAME_INITIAL)
    lists = _earliest(theirs.select(F.explode(_whole_keys(F.col("outer"), surname, initial)).alias("key"), "author", "pos"), k)
    pairs = ours.select("entity", F.explode(_whole_keys(F.col("name"), surname, initial)).alias("key")).join(lists, "key").select("entity", "author")
    if not passes(CONTAINED):
        return pairs
    own, other = settled(ours.select(F.col("name").alias("x")).distinct()), settled(theirs.select(F.col("outer").alias("x")).distinct())
    parts = lambda df: df.select(F.explode(tokens(F.col("x"))).alias("part")).distinct()
    by_name = _earliest(theirs.select(_key(1, F.col("outer")).alias("key"), "author", "pos"), k)
    by_part = _earliest(theirs.select(F.explode(F.array_distinct(F.transform(tokens(F.col("outer")), lambda t: _key(6, t)))).alias("key"), "author", "pos"), k)
    inner, outer = lambda df: df.withColumnRenamed("x", "inner"), lambda df: df.withColumnRenamed("x", "outer")
    within = _contained_pairs(inner(own), outer(other)).select(F.col("inner").alias("name"), _key(1, F.col("outer")).alias("key")).join(by_name, "key")
    around = _contained_pairs(inner(other), outer(own)).select(F.col("outer").alias("name"), _key(1, F.col("inner")).alias("key")).join(by_name, "key")
    within_part = _contained_parts(inner(own), parts(other)).select(F.col("inner").alias("name"), _key(6, F.col("part")).alias("key")).join(by_part, "key")
    named = own.select(F.col("x").alias("name"), F.explode(F.array_distinct(tokens(F.col("x")))).alias("part"))
    around_part = named.join(_contained_parts(inner(other), parts(own)), "part").select("name", _key(1, F.col("inner")).alias("key")).join(by_name, "key")
    contained = within.unionByName(around).unionByName(within_part).unionByName(around_part).select("name", "author").distinct()
    return pairs.unionByName(ours.join(contained, "name").select("entity", "author"))


def sharing_pairs(entities: DataFrame, authors: DataFrame, least: float, k: int) -> DataFrame:
    """(entity, author) that may score by their share of common parts; ``entities`` has ``floor``, the score they still need.

    Names meet by sets of parts.  Of the authors with a set and a number of parts all score alike or better, but those that share
    the entity's surname; so the earliest are enough if k of each surname are among as many more.
    """
    theirs = authors.select("author", "pos", F.size("variants").alias("_v"), F.explode(F.array_distinct("variants")).alias("outer")).filter("outer <> ''")
    most = theirs.agg(F.max("_v")).first()[0] or 1
    p = tokens(F.col("outer"))
    keyed = theirs.filter(~_long(F.col("outer"))).select("author", "pos", F.size(p).alias("size"), F.try_element_at(p, F.lit(-1)).alias("last"), F.explode(_sets(F.col("outer"))).alias("s")).select("author", "pos", "size", "last", "s.*")
    keyed = keyed.filter(F.col("n") / F.col("size") >= least).groupBy("key", "n", "size", "last", "author").agg(F.min("pos").alias("pos"))
    each = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("key", "size", "last").orderBy("pos", "author"))).filter(F.col("_r") <= k)
    lists = each.withColumn("_r", F.row_number().over(Window.partitionBy("key", "size").orderBy("pos", "author"))).filter(F.col("_r") <= k * (most + 1)).select("key", "n", "size", "author")
    own = entities.filter("name <> ''").withColumn("_n", F.size(tokens(F.col("name"))))
    ours = own.filter(~_long(F.col("name"))).select("entity", "_n", "floor", F.explode(_sets(F.col("name"))).alias("s")).filter(F.col("s.n") / F.col("_n") >= F.col("floor")).select("entity", "_n", "floor", "s.key")
    pairs = ours.join(lists, "key").filter(F.col("n") / F.greatest("_n", "size") >= F.col("floor")).select("entity", "author")
    long_ours, long_theirs = own.filter(_long(F.col("name"))), theirs.filter(_long(F.col("outer")))
    by = lambda df, name, who: df.select(who, F.explode(F.array_distinct(tokens(F.col(name)))).alias("part"))
    far = by(long_ours, "name", "entity").join(by(theirs, "outer", "author"), "part").unionByName(by(own, "name", "entity").join(by(long_theirs, "outer", "author"), "part"), allowMissingColumns=True)
    return pairs.unionByName(far.select("entity", "author"))


def _scored(pairs: DataFrame, entities: DataFrame, authors: DataFrame) -> DataFrame:
    return pairs.distinct().join(entities.select("entity", "name"), "entity").join(authors, "author").withColumn("score", best_variant_similarity(F.col("name"), F.col("variants")))


def candidates(entities: DataFrame, authors: DataFrame, min_score: float, k: int, small: bool | None = None, inclusive: bool = False) -> DataFrame:
    """(entity, rank, author, score): the k best authors above a score, or at it if ``inclusive``; ties go to the earlier author.

    ``entities`` has (entity, name), ``authors`` (author, pos, variants[]), all folded as ``author_name``.  Names meet a rung at a
    time: first those that are equal, contained or share a surname, where only the earliest authors of a key can be among the k; then,
    for what an entity still lacks, those that share enough parts.  A pair is scored if it can be among the k, whatever the sizes;
    only where ``small`` is said, the roster is broadcast and scanned, which gives the same rows.
    """
    good = F.col("score") >= min_score if inclusive else F.col("score") > min_score
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "pos"))
    if small:
        scored = entities.join(F.broadcast(authors), best_variant_similarity(F.col("name"), F.col("variants")) > 0).withColumn("score", best_variant_similarity(F.col("name"), F.col("variants")))
    else:
        ours = settled(entities.select("entity", "name"))
        theirs = settled(authors.select("author", "pos", F.filter("variants", lambda v: v.isNotNull()).alias("variants")))
        passes = lambda score: score > min_score or inclusive and score >= min_score
        first = settled(_scored(alike_pairs(ours, theirs, passes, k), ours, theirs).filter(good).withColumn("rank", rank).filter(F.col("rank") <= k))
        floors = first.filter(F.col("rank") == k).select("entity", F.col("score").alias("floor"))
        lacking = ours.join(floors, "entity", "left").withColumn("floor", F.coalesce("floor", F.lit(float(min_score))))
        later = _scored(sharing_pairs(lacking, theirs, min_score, k), ours, theirs)
        cols = ["entity", "author", "pos", "score"]
        scored = first.select(cols).unionByName(later.select(cols)).distinct()
    return scored.filter(good).withColumn("rank", rank).filter(F.col("rank") <= k).select("entity", "rank", "author", "score")


def best_match(entities: DataFrame, authors: DataFrame, threshold: float = 0.85, small: bool | None = None) -> DataFrame:
    """(entity, author, confidence): the best author if good enough; confidence is the percentage, cut off."""
    best = candidates(entities, authors, threshold, 1, small, inclusive=True)
    return best.select("entity", "author", (F.col("score") * 100).cast("int").alias("confidence"))


def run_waterfall(entities: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str = "entity"):
    """Each stage sees the entities that none before matched; returns (matched, unmatched, counts by method)."""
    left, matched = entities, None
    for method, stage in stages:
        found = stage(left).withColumn("method", F.lit(method))
        left = left.join(found.select(key), key, "left_anti")
        matched = found if matched is None else matched.unionByName(found)
    return matched, left, matched.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def match_distinctive(names: DataFrame, roster: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(name, entity, score) by distinctive name parts; ``roster`` has (entity, pos, name, short).

    No rung rests on a first name alone, so none is a key by itself: pairs meet by equal names, by a distinctive part, or by a first
    name together with a surname, the part before it, or a part that the other goes by.
    """

    def keys(p: Column, before: Column, others: Column) -> Column:
        first = lambda family, part: _key(family, p["first"], part)
        shared = F.transform(distinctive(p["all"]), lambda t: _key(2, t))
        by_nick = F.transform(others, lambda t: first(4, t))
        return F.array_distinct(F.concat(F.array(_key(1, p["full"]), first(3, p["last"]), first(5, before)), shared, by_nick))

    left = names.select("name").distinct().withColumn("_p", name_parts(F.col("name")))
    right = settled(roster.select("entity", "pos", "short", name_parts(F.col("name")).alias("_q")))
    p, q = F.col("_p"), F.col("_q")
    nick = tokens(fold(F.coalesce(F.col("short"), F.lit("")), "combining_trim"))
    ours = left.filter(p["full"] != "").select("name", F.explode(keys(p, p["second_to_last"], distinctive(p["all"]))).alias("_k"))
    theirs = right.select("entity", "pos", F.explode(keys(q, q["last"], nick)).alias("_k"))
    ids = ours.join(theirs, "_k").select("name", "entity", "pos").distinct()
    pairs = ids.join(left, "name").join(right, ["entity", "pos"])
    scored = pairs.withColumn("score", advisor_name_similarity(p, q, F.col("short"))).filter(F.col("score") >= threshold)
    return scored.groupBy("name").agg(F.max_by(F.struct("entity", "score"), F.struct("score", -F.col("pos"))).alias("_b")).select("name", "_b.*")


def _pairs_of(parts: Column) -> Column:
    """Keys of all twos of a sorted array."""
    return F.flatten(F.transform(parts, lambda x, i: F.transform(F.slice(parts, i + 2, F.size(parts)), lambda y: _key(2, F.least(x, y), F.greatest(x, y)))))


def match_tokens(names: DataFrame, roster: DataFrame, min_common: int = 3) -> DataFrame:
    """(name, entity): all telling tokens of a roster name are there, or several; the earliest roster entry wins.

    A roster name that must share t of its s tokens shares two of its s - t + 2 rarest, or its only one: these are its keys, so
    that a common first name brings no names together.  Roster names of the same tokens count once, as the earliest.
    """
    telling = lambda name: F.array_sort(F.array_distinct(significant_tokens(F.col(name))))
    left = settled(names.select("name").distinct().withColumn("_t", telling("name")).filter(F.size("_t") > 0))
    own = settled(roster.withColumn("_t", telling("name")).filter(F.size("_t") > 0).groupBy("_t").agg(F.min_by("entity", "pos").alias("entity"), F.min("pos").alias("pos")).withColumn("_r", F.monotonically_increasing_id()))
    often = left.select(F.explode("_t").alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    size = F.size("_t")
    need = F.when(size >= 3, F.least(size, F.lit(max(min_common, 1)))).otherwise(size)
    ranked = own.select("_r", need.alias("_need"), size.alias("_size"), F.explode("_t").alias("_k")).join(often, "_k", "left").groupBy("_r", "_need", "_size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_k").alias("k")))).alias("_all"))
    rare = F.transform(F.slice("_all", F.lit(1), F.col("_size") - F.col("_need") + F.least("_need", F.lit(2))), lambda x: x["k"])
    theirs = ranked.withColumn("_rare", rare).select("_r", F.explode(F.when(F.col("_need") > 1, _pairs_of(F.col("_rare"))).otherwise(F.transform("_rare", lambda x: _key(1, x)))).alias("_k"))
    ours = left.select("name", F.explode(F.concat(_pairs_of(F.col("_t")), F.transform("_t", lambda x: _key(1, x)))).alias("_k"))
    ids = ours.join(theirs, "_k").select("name", "_r").distinct()
    pairs = ids.join(left.select("name", F.col("_t").alias("_own")), "name").join(own, "_r")
    common = F.size(F.array_intersect("_own", "_t"))
    return pairs.filter((common == size) | ((size >= 3) & (common >= min_common))).groupBy("name").agg(F.min_by("entity", "pos").alias("entity"))


def known_authors(works: DataFrame, roster: DataFrame, work: str, ids: str, separator: str = ";") -> DataFrame:
    """(work, author, position) of the listed ids that a roster has."""
    each = works.select(work, F.posexplode(F.split(ids, separator)).alias("_p", "_i")).select(work, F.trim("_i").alias("author"), (F.col("_p") + 1).alias("position"))
    return each.join(roster.select("author"), "author", "left_semi")


def merge_roster(members: DataFrame, profiles: DataFrame, key: str = "id") -> DataFrame:
    """Roster members with their profiles, and profiles without a member, kept as inactive."""
    joined = members.withColumn("active", F.lit(True)).join(profiles, key, "left")
    rest = profiles.join(members.select(key), key, "left_anti").withColumn("active", F.lit(False))
    return joined.unionByName(rest, allowMissingColumns=True)


def merge_profile(people: DataFrame, metrics: DataFrame, works: DataFrame, key: str = "id") -> DataFrame:
    """People with metrics, their five most frequent subject areas, and their works; only where metrics exist."""
    areas = works.select(key, F.explode("areas").alias("area")).groupBy(key, "area").agg(F.count(F.lit(1)).alias("_n"))
    top = areas.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "area"))), 1, 5), lambda x: x["area"]).alias("top_areas"))
    refs = works.groupBy(key).agg(F.sort_array(F.collect_set("work")).alias("works"))
    return people.join(metrics, key).join(top, key, "left").join(refs, key, "left")


def without_matches(entities: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return entities.join(matches.select(key), key, "left_anti")


def aliases_used(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """How many curated aliases the source's names use."""
    return aliases.select(fold(F.col("name"), "library_name").alias("_k")).join(names.select(fold(F.col("name"), "library_name").alias("_k")), "_k", "left_semi").agg(F.count(F.lit(1)).alias("used"))


def author_roster(results: list[DataFrame], affiliation: str) -> DataFrame:
    """One row an author of several search results: current affiliation must contain a text; gaps are filled, areas joined."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r, allowMissingColumns=True)
    here = rows.filter(F.exists(fold_items(F.col("affiliations")), lambda a: a.contains(fold_value(affiliation))))
    return here.groupBy("author").agg(F.min("name").alias("name"), F.min("orcid").alias("orcid"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("areas", F.array().cast("array<string>")))))).alias("areas"))


def keep_referenced(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    return df.join(ref.select(key), key, "left_semi")


def attach_first(df: DataFrame, ref: DataFrame, key: str, values: str, out: str = "advisor") -> DataFrame:
    """The first element of a matching row's array, null without one."""
    return df.join(ref.select(key, F.try_element_at(values, F.lit(1)).alias(out)), key, "left")


def with_default(nodes: DataFrame, other: DataFrame, key: str, col: str, default: str = "") -> DataFrame:
    return nodes.join(other.select(key, col), key, "left").withColumn(col, F.coalesce(col, F.lit(default)))
