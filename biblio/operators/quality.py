"""Data quality as DataFrames of problems: (rule, key, message)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshot import GateError

_PROBLEM = ("rule", "key", "message")


@dataclass
class Rules:
    """What a table's rows must be like."""

    key: str
    required: list[str] = field(default_factory=list)
    enums: dict[str, list] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    bounds: dict[str, tuple] = field(default_factory=dict)
    min_items: dict[str, int] = field(default_factory=dict)
    unique_items: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    allowed: list[str] | None = None
    when: list[tuple[str, Column, Column]] = field(default_factory=list)


def _problems(df: DataFrame, key: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    if not checks:
        return df.select(F.lit("").alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("message")).filter(F.lit(False))
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.coalesce(message, F.lit("")).alias("message"))) for rule, bad, message in checks)))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("_x")).select("_x.rule", "key", "_x.message")


def _empty(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.col(c).isNull() | (F.trim(c) == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.col(c).isNull() | (F.size(c) == 0)
    return F.col(c).isNull()


def validate_schema(df: DataFrame, rules: Rules) -> DataFrame:
    """All violations, in one pass over the rows."""
    text = {c: F.col(c).cast("string") for c in df.columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))}
    checks = [(f"required:{c}", _empty(df, c) if c in df.columns else F.lit(True), F.lit(c)) for c in rules.required]
    checks += [(f"enum:{c}", F.col(c).isNotNull() & ~F.col(c).isin(list(v)), text[c]) for c, v in rules.enums.items()]
    checks += [(f"pattern:{c}", F.col(c).isNotNull() & ~F.col(c).rlike(p), text[c]) for c, p in rules.patterns.items()]
    for c, (low, high) in rules.bounds.items():
        if low is not None:
            checks.append((f"minimum:{c}", F.col(c) < low, text[c]))
        if high is not None:
            checks.append((f"maximum:{c}", F.col(c) > high, text[c]))
    checks += [(f"min_items:{c}", F.coalesce(F.size(c), F.lit(0)) < n, F.lit(c)) for c, n in rules.min_items.items()]
    checks += [(f"unique_items:{c}", F.size(c) != F.size(F.array_distinct(c)), F.lit(c)) for c in rules.unique_items]
    checks += [(f"type:{c}", F.lit(df.schema[c].dataType.simpleString() != t), F.lit(df.schema[c].dataType.simpleString())) for c, t in rules.types.items() if c in df.columns]
    if rules.allowed is not None:
        checks += [("additional", F.lit(True), F.lit(c)) for c in sorted(set(df.columns) - set(rules.allowed))]
    checks += [(f"when:{name}", cond & ~F.coalesce(must, F.lit(False)), F.lit(name)) for name, cond, must in rules.when]
    return _problems(df, rules.key, checks)


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.lit(f"unique:{','.join(cols)}").alias("rule"), F.concat_ws("|", *(F.col(c).cast("string") for c in cols)).alias("key"), F.col("_n").cast("string").alias("message"))


def conditional_required(df: DataFrame, key: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    return validate_schema(df, Rules(key=key, when=rules))


def protected(df: DataFrame, expected: dict[str, str], key: str, kind: str) -> DataFrame:
    """Members that must exist and keep their type."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{key} string, _kind string")
    found = F.broadcast(want).join(df.select(F.col(key).cast("string").alias(key), F.col(kind).alias("_now"), F.lit(True).alias("_there")), key, "left")
    message = F.when(F.col("_there").isNull(), "missing").when(~F.col("_now").eqNullSafe(F.col("_kind")), "type changed")
    return found.withColumn("message", message).filter("message is not null").select(F.lit("protected").alias("rule"), F.col(key).alias("key"), "message")


def file_matches_id(df: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    return _problems(df, key, [("file_name", ~name.eqNullSafe(F.col(key).cast("string")), name)])


def forbidden_fields(df: DataFrame, forbidden: list[str], key: str) -> DataFrame:
    """Fields that must not be in a public table, at any depth of structs; one problem a field."""

    def walk(kind: T.DataType, at: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield f"{at}{f.name}", f.name
                yield from walk(f.dataType, f"{at}{f.name}.")
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, at)

    bad = [(p,) for p, name in walk(df.schema, "") if name in forbidden]
    rows = df.sparkSession.createDataFrame(bad, "key string") if bad else df.sparkSession.createDataFrame([], "key string")
    return rows.select(F.lit("forbidden").alias("rule"), "key", F.lit(f"not public in {key}").alias("message"))


def _any_filled(names: list[str]):
    return lambda x: F.coalesce(*(F.when(x[f].isNotNull(), F.lit(True)) for f in names), F.lit(False))


def _without_fields(names: list[str]):
    return lambda x: x.dropFields(*names)


def sanitize(df: DataFrame, drop: list[str] = (), drop_nested: dict[str, list[str]] = {}, clear: list[str] = (), keep_metadata: list[str] | None = None) -> DataFrame:
    """A public form of rows, with ``changed`` where something was there to remove."""
    changed = F.lit(False)
    edits = {}
    for c in drop:
        if c in df.columns:
            changed = changed | F.col(c).isNotNull()
    for c, fields in drop_nested.items():
        kind = df.schema[c].dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        there = [f for f in fields if f in inner.names]
        if there:
            if isinstance(kind, T.ArrayType):
                changed = changed | F.coalesce(F.exists(c, _any_filled(there)), F.lit(False))
                edits[c] = F.transform(c, _without_fields(there))
            else:
                for f in there:
                    changed = changed | F.col(f"{c}.{f}").isNotNull()
                edits[c] = F.col(c).dropFields(*there)
    for c in clear:
        changed = changed | F.col(c).isNotNull()
        edits[c] = F.lit(None).cast(df.schema[c].dataType)
    if keep_metadata is not None and "metadata" in df.columns:
        changed = changed | F.coalesce(F.exists(F.map_keys("metadata"), lambda k: ~k.isin(keep_metadata)), F.lit(False))
        edits["metadata"] = F.map_filter("metadata", lambda k, _: k.isin(keep_metadata))
    return df.withColumns({**edits, "changed": F.coalesce(changed, F.lit(False))}).drop(*drop)


def unparseable(df: DataFrame, path: str = "path") -> DataFrame:
    """Files whose JSON could not be read (``_corrupt_record``)."""
    # Spark refuses a scan of that column alone, so the condition also looks at the others
    others = F.to_json(F.struct(*(F.col(c) for c in df.columns if c not in ("_corrupt_record", path)))).isNotNull()
    return df.filter(F.col("_corrupt_record").isNotNull() & others).select(F.lit("parse").alias("rule"), F.col(path).alias("key"), F.substring("_corrupt_record", 1, 80).alias("message"))


def referential_integrity(df: DataFrame, key: str, rules: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Foreign keys (column, parent table, parent column) without a parent."""
    out = None
    for c, parent, parent_col in rules:
        missing = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(parent_col).alias(c)), c, "left_anti").select(F.lit(f"reference:{c}").alias("rule"), F.col(key).cast("string").alias("key"), F.col(c).cast("string").alias("message"))
        out = missing if out is None else out.unionByName(missing)
    return out


def admit_batch(previous: DataFrame, batch: DataFrame, rules: Rules) -> DataFrame:
    """Problems that bar a batch: its own repeated ids, and anything wrong in the collection it would make."""
    whole = previous.join(batch.select(rules.key), rules.key, "left_anti").unionByName(batch, allowMissingColumns=True)
    return unique(batch, [rules.key]).unionByName(validate_schema(whole, rules)).unionByName(unique(whole, [rules.key])).distinct()


def require(problems: DataFrame) -> None:
    """Raise if there are problems, naming the first few."""
    first = problems.limit(5).collect()
    if first:
        raise GateError("; ".join(f"{r['rule']} {r['key']} {r['message']}" for r in first))


#: Address beginnings that are never allowed, and schemes that links may have (fixed values).
FORBIDDEN_SCHEMES = ("javascript:", "data:text/html", "vbscript:")
ALLOWED_SCHEMES = ("http", "https", "mailto")


def scan_schemes(df: DataFrame, key: str, texts: list[str], links: list[str]) -> DataFrame:
    """Forbidden prefixes anywhere, and schemes of link fields that are not allowed."""
    checks = [(f"scheme:{c}", F.lower(F.ltrim(F.col(c))).rlike("^(?:" + "|".join(FORBIDDEN_SCHEMES) + ")"), F.col(c)) for c in texts]
    for c in links:
        scheme = F.lower(F.regexp_extract(F.trim(F.col(c)), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
        checks.append((f"link:{c}", (scheme != "") & ~scheme.isin(*ALLOWED_SCHEMES), F.col(c)))
    return _problems(df, key, checks)
