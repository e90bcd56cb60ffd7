"""Operator 11: ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

The queries are a stated set, taken in blocks of about ``BLOCK_ROWS`` (item, term) rows.  One pass over the texts makes an
inverted index of a block's terms: a shard holds the documents of a run of a scanned partition, at most ``HELD`` postings and
one document, and lies in the shared folder by a checkpoint.  Frequencies come from the index, over all documents.

Within a shard each item is answered so: the lists of its rare terms, those with at most a ``SHORT``-th of the shard's
documents, are summed term at a time into accumulators.  The accumulators are then one more iterator, sorted by document and
bounded by the largest sum.  It and the long lists are merged document at a time, ``RANGE`` documents at once: iterators whose
bounds together stay below the score of the k-th best document are not merged but probed, from the highest bound down, and
only where a document can still reach that score.  What no iterator can lift there is skipped.

Scores are integers and the k-th best score only ever grows, so what comes out is exact.  Shards return k rows an item at most;
they meet in two steps, by item and one of ``SALTS`` parts, then by item.

Defined cases: rows of one item id make one item with all their terms; a null item id is an id; null and empty texts have no
terms; equal scores go by ascending document id, null ids last; repeated rows rank each on their own; very long texts are
indexed whole; empty tables give an empty result; columns that are not named are not read, whatever their names.  A single
item's distinct terms are held in a task; terms are known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .tables import in_batches, settled, table
from .textbuf import LOWER, as_long, runs, span_hash, trimmed, words

BLOCK_ROWS = 1 << 20
HELD = 1 << 21
SHORT = 32
RANGE = 2048
SALTS = 64

#: All ASCII but digits and letters stands between terms.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a run, and how many each text has."""
    low = LOWER[raw]
    start, end, counts = words(low, offsets, BETWEEN)
    return span_hash(low, start, end), counts


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times) of all items."""
    source = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    schema = StructType([StructField("item", source.schema["item"].dataType), StructField("term", LongType())])

    def per_partition(batches):
        for batch in trimmed(batches):
            for row, n, raw, offsets in runs(batch.column(1)):
                h, counts = terms(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + np.repeat(np.arange(n), counts))), pa.array(as_long(h))], names=["item", "term"])

    return in_batches(source, per_partition, schema).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class Block:
    """Some of the items: their ids, their distinct terms' hashes, sorted, and for each item (places of its terms, times)."""

    ids: pa.Array
    term: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]


def block_of(rows: pa.Table) -> Block:
    coded = pc.dictionary_encode(rows.column("item").combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    who = coded.indices.to_numpy(zero_copy_only=False)
    term, place = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
    times = rows.column("times").to_numpy()
    order = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[order], np.arange(1, len(coded.dictionary)))
    return Block(coded.dictionary, term, list(zip(np.split(place[order], cuts), np.split(times[order], cuts), strict=True)) if len(who) else [])


def packed32(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def postings(docs: DataFrame, term: np.ndarray) -> DataFrame:
    """The index of given terms over (doc, text): a row a shard (``term`` -1, its documents and their sizes), then one a list.

    ``n`` is the number of documents with a term, or on a list; ``total`` all terms of a shard's documents.
    """
    known = docs.sparkSession.sparkContext.broadcast(term)
    kind = docs.schema["doc"].dataType
    schema = StructType.fromDDL("shard long, term int, n long, total long, at binary, tf binary").add("docs", ArrayType(kind)).add("sizes", ArrayType(LongType()))
    ids_type = None

    def shard(number: int, ids: list[pa.Array], held: list, n: int, total: int):
        doc, which, tf = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in range(3))
        sizes = np.concatenate([np.zeros(0, np.int64), *(h[3] for h in held)])
        mine, at = np.unique(doc, return_inverse=True)
        order = np.argsort(which, kind="stable")
        at, which, tf = at[order], which[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
        stop = np.append(first[1:], len(which))[: len(first)]
        used = pa.concat_arrays(ids).take(pa.array(mine)) if ids else pa.array([], ids_type)
        rows = len(first)
        lists = lambda values, inner: pa.ListArray.from_arrays(pa.array([0, *([len(values)] * (rows + 1))], pa.int32()), values.cast(inner) if inner else values)
        a, b = ([b"", *(packed32(x[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True))] for x in (at, tf))
        columns = [pa.array(np.full(rows + 1, number)), pa.array(np.concatenate([[-1], which[first]]), pa.int32()), pa.array(np.concatenate([[n], stop - first])), pa.array([total, *[0] * rows], pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), lists(used, None), lists(pa.array(sizes[mine]), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def per_partition(batches):
        vocabulary = known.value
        number = TaskContext.get().partitionId() << 32
        ids, held, n_rows, n_held, n, total = [], [], 0, 0, 0, 0
        for batch in trimmed(batches):
            for row, rows, raw, offsets in runs(batch.column(1)):
                h, counts = terms(raw, offsets)
                n, total = n + int((counts > 0).sum()), total + len(h)
                doc = np.repeat(np.arange(rows), counts)
                which = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                ours = vocabulary[which] == h if len(vocabulary) else np.zeros(len(h), bool)
                pair, tf = np.unique(doc[ours] * max(len(vocabulary), 1) + which[ours], return_counts=True)
                held.append((pair // max(len(vocabulary), 1) + n_rows, pair % max(len(vocabulary), 1), tf, counts))
                ids.append(batch.column(0).slice(row, rows))
                n_rows, n_held = n_rows + rows, n_held + len(pair)
                if n_held >= HELD:
                    yield shard(number, ids, held, n, total)
                    number += 1
                    ids, held, n_rows, n_held, n, total = [], [], 0, 0, 0, 0
        if ids:
            yield shard(number, ids, held, n, total)

    return in_batches(docs.select("doc", "text"), per_partition, schema)


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.where(df > 0, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))), 0).astype(np.int64)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def norms(sizes: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Each document's length against the mean; whole numbers of any size, as the product may pass 64 bits."""
    return np.array([75 + (25 * n * n_docs) // total for n in sizes.tolist()], np.int64)


def summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators, by document, of some lists of (documents, scores)."""
    doc, score = np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(doc, kind="stable")
    doc, score = doc[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[first], np.add.reduceat(score, first)


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) among which are all of the k best whose score is ``least`` or more, by sums over the lists.

    A list holds documents in ascending order and scores above 0.  ``seen`` counts the postings that were looked at.
    """
    lists = [x for x in lists if len(x[0])]
    short = [x for x in lists if len(x[0]) * SHORT <= n_docs]
    merged = [x for x in lists if len(x[0]) * SHORT > n_docs]
    least = max(least, 1)
    if short:
        accumulators = summed(short)
        least = max(least, kth(accumulators[1], k))
        merged.append(accumulators)
    merged = sorted(merged, key=lambda x: int(x[1].max()))
    bound = np.cumsum([int(s.max()) for _, s in merged])
    found_doc, found_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n_found, low = 0, 0
    at = [0] * len(merged)
    while low < n_docs:
        lead = int(np.searchsorted(bound, least))  # below it, all bounds together don't reach the score
        if lead == len(merged):
            break
        ahead = []
        for i in range(lead, len(merged)):  # skip to the next document of an iterator that leads
            at[i] += int(np.searchsorted(merged[i][0][at[i] :], low))
            if at[i] < len(merged[i][0]):
                ahead.append(int(merged[i][0][at[i]]))
        if not ahead:
            break
        low = min(ahead)
        total = np.zeros(RANGE, np.int64)
        for i in range(lead, len(merged)):
            doc, score = merged[i]
            upto = at[i] + int(np.searchsorted(doc[at[i] : at[i] + RANGE], low + RANGE))
            total[doc[at[i] : upto] - low] += score[at[i] : upto]
            if seen is not None:
                seen["n"] = seen.get("n", 0) + upto - at[i]
            at[i] = upto
        alive = np.flatnonzero(total)
        for i in range(lead - 1, -1, -1):
            alive = alive[total[alive] + bound[i] >= least]
            if not len(alive):
                break
            doc, score = merged[i]
            to = np.searchsorted(doc, alive + low)
            hit = doc[np.minimum(to, len(doc) - 1)] == alive + low
            total[alive[hit]] += score[to[hit]]
            if seen is not None:
                seen["n"] = seen.get("n", 0) + len(alive)
        alive = alive[total[alive] >= least]
        if len(alive):
            found_doc.append(alive + low)
            found_score.append(total[alive])
            n_found += len(alive)
            if n_found >= k:
                scores = np.concatenate(found_score)
                least = max(least, kth(scores, k))
                keep = scores >= least
                found_doc, found_score = [np.concatenate(found_doc)[keep]], [scores[keep]]
                n_found = int(keep.sum())
        low += RANGE
    return np.concatenate(found_doc), np.concatenate(found_score)


def answers(index: DataFrame, block: Block, weight: np.ndarray, n_docs: int, total: int, k: int, item_type, doc_type) -> DataFrame:
    """(item, doc, score, shard): the k best documents of each shard for each item."""
    shared = index.sparkSession.sparkContext.broadcast((block, weight))
    schema = StructType([StructField("item", item_type), StructField("doc", doc_type), StructField("score", LongType()), StructField("shard", LongType())])

    def search(number: int, ids: pa.Array, lists: dict[int, tuple[np.ndarray, np.ndarray]], least: np.ndarray):
        block = shared.value[0]
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        who, which, scores = [], [], []
        for i, (places, times) in enumerate(block.parts):
            own = [(lists[p][0], lists[p][1] * t) for p, t in zip(places.tolist(), times.tolist(), strict=True) if p in lists]
            doc, score = best(own, len(ids), k, int(least[i]))
            top = np.lexsort((rank[doc], -score))[:k]
            if len(top) == k:
                least[i] = max(least[i], int(score[top[-1]]))
            who.append(np.full(len(top), i))
            which.append(doc[top])
            scores.append(score[top])
        who, which, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (who, which, scores))
        return pa.RecordBatch.from_arrays([block.ids.take(pa.array(who)), ids.take(pa.array(which)), pa.array(scores), pa.array(np.full(len(who), number))], names=schema.names)

    def per_partition(batches):
        block, weight = shared.value
        least = np.zeros(len(block.parts), np.int64)
        number, ids, norm, lists = None, None, None, {}
        for batch in trimmed(batches):
            shard, term, at, tf, docs, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("shard", "term", "at", "tf", "docs", "sizes"))
            for j, (s, t) in enumerate(zip(shard.to_pylist(), term.to_pylist(), strict=True)):
                if t < 0:  # a shard begins
                    if number is not None:
                        yield search(number, ids, lists, least)
                    number, ids, lists = s, docs[j].values, {}
                    norm = norms(sizes[j].values.to_numpy(), n_docs, total)
                elif weight[t] > 0:
                    doc = np.frombuffer(at[j].as_py(), "<i4").astype(np.int64)
                    score = weight[t] * impacts(np.frombuffer(tf[j].as_py(), "<i4").astype(np.int64), norm[doc])
                    lists[t] = (doc[score > 0], score[score > 0])
        if number is not None:
            yield search(number, ids, lists, least)

    return in_batches(index, per_partition, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): each item's k highest-scoring documents with a score above 0."""
    source = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    rows = settled(item_terms(items, item, item_text))
    blocks = -(-rows.count() // BLOCK_ROWS)
    item_type, doc_type = rows.schema["item"].dataType, source.schema["doc"].dataType
    found = docs.sparkSession.createDataFrame([], StructType([StructField("item", item_type), StructField("doc", doc_type), StructField("score", LongType()), StructField("shard", LongType())]))
    for b in range(blocks):
        block = block_of(rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow())
        index = settled(postings(source, block.term))
        counts = index.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow().to_pylist()
        whole = next((r for r in counts if r["term"] < 0), {"n": 0, "total": 0})
        df = np.zeros(len(block.term), np.int64)
        for r in counts:
            if r["term"] >= 0:
                df[r["term"]] = r["n"]
        if whole["total"]:
            found = found.unionByName(answers(index, block, term_weights(df, whole["n"]), whole["n"], whole["total"], k, item_type, doc_type))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = found.withColumn("part", F.pmod("shard", F.lit(SALTS)) if blocks else F.lit(0))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("item", "rank", "doc", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
WITH t AS (SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
i AS (SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS v FROM p JOIN w USING (term) JOIN d ON d.r = p.r, s),
v AS (SELECT item_id, r, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM v JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
