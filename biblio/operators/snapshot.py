"""Comparing and updating snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that change without meaning anything (fixed values).
VOLATILE = ("generated_at", "last_updated", "ultima_atualizacao", "updated_at")


class GateError(ValueError):
    """A snapshot that must not be published."""


def comparable(df: DataFrame, synonyms: dict[str, list[str]], text: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Rows with synonyms unified and null as empty: text as strings, lists as arrays."""
    out = df
    for name, others in synonyms.items():
        have = [c for c in (name, *others) if c in df.columns]
        out = out.withColumn(name, F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in have), F.lit(""))).drop(*(c for c in have if c != name))
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text})
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in lists})


def _without(col: Column, kind: T.DataType, names: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        inner = F.struct(*(_without(col[f.name], f.dataType, names).alias(f.name) for f in kept))
        return F.when(col.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _without(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.filter(F.map_entries(col), lambda e: ~e["key"].isin(*names)))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _without(e["value"], kind.valueType, names).alias("value")))
    return col


def semantic(df: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """Rows without volatile fields at any depth; maps become sorted entries, which compare."""
    return df.select(*(_without(F.col(f"`{f.name}`"), f.dataType, tuple(volatile)).alias(f.name) for f in df.schema.fields if f.name not in volatile))


def diff(previous: DataFrame, current: DataFrame, key: str, ignore: tuple[str, ...] = VOLATILE) -> DataFrame:
    """(key, status, changed_fields): added, removed, changed or unchanged, by the columns that both versions have.

    A new or dropped column is no change of a row; ``columns_changed`` of committed versions tells it.
    """
    a, b = semantic(previous, ignore), semantic(current, ignore)
    cols = [c for c in a.columns if c != key and c in b.columns]
    old = a.select(key, F.struct(*cols).alias("_o"))
    new = b.select(key, F.struct(*cols).alias("_n"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_o.`{c}`").eqNullSafe(F.col(f"_n.`{c}`")), F.lit(c)) for c in sorted(cols))))
    both = old.join(new, key, "full_outer").withColumn("_c", changed)
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size("_c") > 0, "changed").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.col("_c")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def completeness(staged: DataFrame, expected: DataFrame, key: str, full: bool = True) -> DataFrame:
    """(key, problem): staged ids nobody expects, and on a full run expected ones that are missing."""
    unknown = staged.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unknown"))
    if not full:
        return unknown
    return unknown.unionByName(expected.select(key).distinct().join(staged.select(key), key, "left_anti").withColumn("problem", F.lit("missing")))


def gate_total(previous_n: int, new_n: int, min_ratio: float = 0.95) -> None:
    """Refuse an empty snapshot and one with strictly fewer than the ratio of rows."""
    if new_n == 0 or new_n < min_ratio * previous_n:
        raise GateError(f"{new_n} rows after {previous_n}")


def gate_per_key(previous: DataFrame, new: DataFrame, key: str, min_ratio: float = 0.8) -> DataFrame:
    """(key, old_n, new_n) of the keys that lost too many rows."""
    old = previous.groupBy(key).agg(F.count(F.lit(1)).alias("old_n"))
    now = new.groupBy(key).agg(F.count(F.lit(1)).alias("new_n"))
    return old.join(now, key, "left").withColumn("new_n", F.coalesce("new_n", F.lit(0))).filter(F.col("new_n") < min_ratio * F.col("old_n"))


def gate_bulk(changes: DataFrame, limit: int, approved: bool = False) -> None:
    """Refuse more changes than a limit without approval."""
    n = changes.filter("status <> 'unchanged'").count()
    if n > limit and not approved:
        raise GateError(f"{n} changes, {limit} allowed")


def has_semantic_change(previous: DataFrame, current: DataFrame, key: str) -> bool:
    return not diff(previous, current, key).filter("status <> 'unchanged'").isEmpty()


def publishable(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The new snapshot if anything changed, else the previous one again."""
    return current if has_semantic_change(previous, current, key) else previous


def upsert(current: DataFrame, incoming: DataFrame, key: str, update_existing: bool = False) -> DataFrame:
    """Replace rows by id and append new ones; never deletes.  Replacing changed rows needs ``update_existing``."""
    if not update_existing:
        shared = diff(current, incoming, key).filter("status = 'changed'")
        if not shared.isEmpty():
            raise GateError("existing rows would change")
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_processed(previous: DataFrame, candidate: DataFrame, keys: DataFrame, key: str, full: bool = False) -> DataFrame:
    """Rows of processed keys are replaced, others kept; a full run replaces everything."""
    if full:
        return candidate
    return previous.join(keys.select(key), key, "left_anti").unionByName(candidate, allowMissingColumns=True)


def add_only(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Insert new ids; nothing is rewritten or deleted."""
    return previous.unionByName(current.join(previous.select(key), key, "left_anti"), allowMissingColumns=True)


def overlay(base: DataFrame, patch: DataFrame, key: str, present: dict[str, str] | None = None) -> DataFrame:
    """``{**base, **patch}``: a patch row's fields replace, even by empty or null ones.

    ``present`` names, for fields that a patch row may lack, the boolean column that says it has them.
    """
    cols = [c for c in patch.columns if c != key and c in base.columns and c not in (present or {}).values()]
    p = patch.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_p_{c}") for c in cols), *(F.col(f).alias(f"_f_{c}") for c, f in (present or {}).items()))
    merged = base.join(p, key, "left")
    use = {c: F.col("_there") & (F.coalesce(F.col(f"_f_{c}"), F.lit(False)) if c in (present or {}) else F.lit(True)) for c in cols}
    return merged.withColumns({c: F.when(use[c], F.col(f"_p_{c}")).otherwise(F.col(c)) for c in cols}).select(*base.columns)


def enrich_missing(df: DataFrame, patch: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Fill from a patch, with the list of changed fields.

    Policies: ``replace`` when different and filled; ``if_absent`` only where nothing is; ``nonempty`` a list that has items.
    """
    p = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in policy))
    joined = df.join(p, key, "left")

    def filled(c: Column, field: str) -> Column:
        return (F.size(c) > 0) if isinstance(df.schema[field].dataType, T.ArrayType) else (c.isNotNull() & (c.cast("string") != ""))

    change = {}
    for c, how in policy.items():
        new, old = F.col(f"_p_{c}"), F.col(c)
        change[c] = F.coalesce(filled(new, c) & (~filled(old, c) | old.isNull() if how == "if_absent" else ~new.eqNullSafe(old)), F.lit(False))
    out = joined.withColumn("changes", F.array_compact(F.array(*(F.when(change[c], F.lit(c)) for c in policy))))
    return out.withColumns({c: F.when(F.array_contains("changes", c), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in policy}).drop(*(f"_p_{c}" for c in policy))


def deactivated(previous: DataFrame, current: DataFrame, key: str, active: str = "active") -> DataFrame:
    """Keys that were active and are not any more."""
    return previous.filter(F.col(active)).select(key).join(current.filter(~F.col(active)).select(key), key, "left_semi")


def curated_changes(previous_ids: DataFrame, ids: DataFrame, key: str, values: str) -> DataFrame:
    """(key, added_ids, removed_ids) of lists that changed."""
    empty = F.array().cast("array<string>")
    both = previous_ids.select(key, F.col(values).alias("_o")).join(ids.select(key, F.col(values).alias("_n")), key, "full_outer")
    old, new = F.coalesce("_o", empty), F.coalesce("_n", empty)
    return both.select(key, F.array_sort(F.array_except(new, old)).alias("added_ids"), F.array_sort(F.array_except(old, new)).alias("removed_ids")).filter("size(added_ids) + size(removed_ids) > 0")


def report(changes: DataFrame, key: str, most: int = 100) -> DataFrame:
    """(status, n, ids, omitted): counts and the first ids of each kind of change."""
    from .arrange import cap

    n = changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    shown = cap(changes, "status", most, [key]).groupBy("status").agg(F.sort_array(F.collect_list(key)).alias("ids"))
    return n.join(shown, "status").withColumn("omitted", F.greatest(F.lit(0), F.col("n") - most))


def staged_or_previous(staged: DataFrame, previous: DataFrame, kind: str = "kind") -> DataFrame:
    """Kinds that were staged, and the previous rows of those that were not."""
    return staged.unionByName(previous.join(staged.select(kind).distinct(), kind, "left_anti"), allowMissingColumns=True)


def manifest_diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, status) from (path, hash) manifests: changed (or new) and deleted files; all are changed without an old one."""
    if old is None:
        return new.select("path", F.lit("changed").alias("status"))
    both = new.select("path", F.col("hash").alias("_n")).join(old.select("path", F.col("hash").alias("_o")), "path", "full_outer")
    return both.select("path", F.when(F.col("_n").isNull(), "deleted").when(~F.col("_n").eqNullSafe(F.col("_o")), "changed").alias("status")).filter("status is not null")


def build_manifest(df: DataFrame, counts: dict[str, Column], updated: str | None = None) -> DataFrame:
    """One row: records, a map of counts, and the latest update."""
    pairs = reduce(lambda a, b: a + b, ([F.lit(k), F.count_if(v)] for k, v in counts.items()), [])
    return df.agg(F.count(F.lit(1)).alias("records"), F.create_map(*pairs).alias("counts"), *([F.max(updated).alias("updated")] if updated else []))
