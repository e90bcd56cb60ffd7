"""Nested values as (path, value) rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@F.udtf(returnType="path: string, value: string")
class JsonLeaves:
    """Every leaf of a JSON text, with its path."""

    def eval(self, text: str):
        try:
            todo = [("$", json.loads(text))] if text else []
        except ValueError:
            todo = []
        while todo:
            path, value = todo.pop()
            if isinstance(value, dict):
                todo += [(f"{path}.{k}", v) for k, v in value.items()]
            elif isinstance(value, list):
                todo += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
            else:
                yield path, None if value is None else value if isinstance(value, str) else json.dumps(value)


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON column; texts that are no JSON have none."""
    return df.select(key, F.col(text).alias("_text")).lateralJoin(JsonLeaves(F.col("_text").outer())).select(key, "path", "value")
