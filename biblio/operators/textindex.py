"""A written index of folded texts, for substring search that looks at few rows.

``build`` folds each text once and writes two tables: the folded texts, numbered as they are written, and posting lists of their
``GRAM``-grams.  Lists are made a segment of consecutive texts at a time and sorted by gram in each file, so that nothing is shuffled; a
list holds the places of a gram's texts in their block of 65,536 numbers.  ``find`` takes the lists of the query's rarest grams, keeps the
texts that are on all of them, reads these and looks for the query in them, so that answers are those of a scan.

Defined cases: a null text is empty; an empty query is in every text; a query shorter than a gram is looked for in all folded texts;
repeated rows are found each; a null id is found like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio.functions.text import fold, fold_value
from biblio.sources.shared import settled

GRAM = 4
#: Characters of a segment; a longer text is one by itself.
SEGMENT = 1 << 22
#: Lists that a query reads at most; more would cut candidates that the look at the texts cuts as well.
LISTS = 3
#: Candidates up to which they are broadcast and looked up; with more, all texts are looked at.
NEAR = 100_000
PLACE = 16


def _hashed(codes: np.ndarray) -> np.ndarray:
    """48 bits for each ``GRAM`` code points in a row; grams that share them share a list, which costs a look at a text."""
    n = max(len(codes) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : k + n]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(PLACE)
    return h


def _codes(utf8: bytes) -> np.ndarray:
    return np.frombuffer(utf8.decode().encode("utf-32-le"), "<u4")


def _lists(codes: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of a segment in order, where the list of each begins, and the ascending places of all lists."""
    place = np.repeat(places.astype(np.uint16), lengths)
    keys = _hashed(codes)
    keys <<= np.uint64(PLACE)
    keys |= place[: 1 - GRAM]
    keys = keys[place[: 1 - GRAM] == place[GRAM - 1 :]]  # a gram ends in the text that it began in
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    places, keys = (keys & np.uint64((1 << PLACE) - 1)).astype("<u2"), keys >> np.uint64(PLACE)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[begins].astype(np.int64), np.append(begins, len(keys)), places


def _postings(batches):
    """(gram, block, n, places) of batches of (number, text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers, texts = batch.column(0).to_numpy(), batch.column(1)
        blocks, lengths, bytes_ = numbers >> PLACE, pc.utf8_length(texts).to_numpy(), pc.binary_length(texts).to_numpy()
        upto, ends, data = np.append(0, np.cumsum(lengths.astype(np.int64))), np.append(0, np.cumsum(bytes_.astype(np.int64))), pa.concat_arrays([texts]).cast(pa.large_binary())
        first, raw = np.frombuffer(data.buffers()[1], np.int64)[data.offset], data.buffers()[2]
        turns = np.append(np.flatnonzero(np.diff(blocks)) + 1, len(numbers))
        at = 0
        while at < len(numbers):
            to = max(at + 1, min(turns[np.searchsorted(turns, at, "right")], np.searchsorted(upto, upto[at] + SEGMENT, "right") - 1))
            if upto[to] - upto[at] >= GRAM:
                codes = _codes(raw[first + ends[at] : first + ends[to]].to_pybytes())
                grams, begins, places = _lists(codes, lengths[at:to], numbers[at:to] & ((1 << PLACE) - 1))
                if len(grams):
                    lists = pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer((begins * 2).astype(np.int32)), pa.py_buffer(places)])
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), blocks[at])), pa.array(np.diff(begins)), lists], names=["gram", "block", "n", "places"])
            at = to


def _numbers(batches):
    """(number) of each place of batches of (block, places)."""
    for batch in batches:
        for block, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array((block << PLACE) + np.frombuffer(places, "<u2").astype(np.int64))], names=["number"])


def build(df: DataFrame, key: str, texts: list[str], path: str) -> None:
    """Write the index of the texts, joined by spaces, below a path."""
    whole = F.concat_ws(" ", *(F.coalesce(F.col(f"`{t}`"), F.lit("")) for t in texts))
    root, spark = path.rstrip("/"), df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("id"), fold(whole, "combining").alias("text"))
    rows.select("id", "text", F.monotonically_increasing_id().alias("number")).withColumn("block", F.shiftright("number", PLACE)).write.mode("overwrite").parquet(f"{root}/texts")
    folded = spark.read.parquet(f"{root}/texts").filter(F.length("text") >= GRAM).select("number", "text")
    lists = folded.mapInArrow(_postings, "gram long, block long, n long, places binary")
    lists.sortWithinPartitions("gram").write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/lists")


def find(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the texts that contain a query, whatever its accents and case."""
    root, low = path.rstrip("/"), fold_value(query)
    texts = spark.read.parquet(f"{root}/texts")
    hit = F.col("text").contains(low)
    if len(low) < GRAM:
        return texts.filter(hit).select("id")
    own = np.unique(_hashed(_codes(low.encode()))).tolist()
    held = spark.read.parquet(f"{root}/lists").filter(F.col("gram").isin(own))
    counts = held.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()  # a row for each gram of the query
    if len(counts) < len(own):  # a gram that no text has
        return texts.limit(0).select("id")
    rare = [r["gram"] for r in counts[:LISTS]]
    met = held.filter(F.col("gram").isin(rare)).select("block", "places").mapInArrow(_numbers, "number long").groupBy(F.col("number").alias("_number")).agg(F.count(F.lit(1)).alias("_n"))
    met = settled(met.filter(F.col("_n") == len(rare)).select("_number"))
    if met.count() > NEAR:
        return texts.filter(hit).select("id")
    blocks = [r[0] for r in met.select(F.shiftright("_number", PLACE)).distinct().collect()]
    return texts.filter(F.col("block").isin(blocks)).join(F.broadcast(met), F.col("number") == F.col("_number"), "left_semi").filter(hit).select("id")
