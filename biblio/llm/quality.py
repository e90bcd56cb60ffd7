"""Operator 6: quality rules with a hashed n-gram log-likelihood ratio.

Base rules look at the words of a text.  The method's verdict compares two multinomials over hashed
byte n-grams: one of trusted (target) documents, one of the whole raw corpus.  A text's score is the
mean of log(target / raw) over its n-grams; a text below a fixed threshold is rejected.  The target
is all rows labelled good; the raw corpus is all of it, and all rows with a label choose the threshold.  Labels meet the
documents in joins, which broadcast them only where they are few.

Defined cases: null text has no words and fails the base rule; very long texts are judged whole; a text shorter than an n-gram scores
0; without labels of both kinds every text passes the verdict; repeated rows score alike; an
empty table gives an empty result; columns with the names of new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_batches, narrow_join, numbered, offsets_before, settled, table, with_arrays
from .textbuf import IS_SPACE, mix, runs, span_hash, trimmed, window_places, windows, words

BITS = 16
GRAM = 3
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of the trusted documents that the threshold may reject at most.
MAX_TRUSTED_LOSS = 0.002
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)  # bytes that begin a character
_MARK[:128] = _MARK[192:] = True


@dataclass
class Verdict:
    ratio: np.ndarray  # float32 of each bucket: log(target / raw)
    threshold: float


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that begins at each byte, and whether it lies within one document."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(257) + raw[k : k + n]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return bucket, inside


def gram_counts(docs: DataFrame, text: str, trusted: str) -> DataFrame:
    """(bucket, target n, raw n) over all documents."""

    def per_partition(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in trimmed(batches):
            flag = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, n, raw, offsets in runs(batch.column(0)):
                bucket, inside = grams(raw, offsets)
                counts[1] += np.bincount(bucket[inside], minlength=1 << BITS)
                for d in np.flatnonzero(flag[at : at + n]):
                    own = bucket[offsets[d] : max(offsets[d], offsets[d + 1] - GRAM + 1)]
                    counts[0] += np.bincount(own, minlength=1 << BITS) if len(own) > 4096 else 0
                    if len(own) <= 4096:
                        np.add.at(counts[0], own, 1)
        found = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[0][found]), pa.array(counts[1][found])], names=["bucket", "target", "raw"])

    parts = in_batches(docs.select(text, trusted), per_partition, "bucket int, target long, raw long")
    return parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def llr(ratio: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log ratio over the n-grams of each document."""
    bucket, inside = grams(raw, offsets)
    value = np.zeros(len(raw) + 1)
    if len(bucket):
        np.cumsum(np.where(inside, ratio[bucket], 0), dtype=np.float64, out=value[1 : len(bucket) + 1])
        value[len(bucket) + 1 :] = value[len(bucket)]
    n = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return np.where(n > 0, np.round((value[offsets[1:]] - value[offsets[:-1]]) / np.maximum(n, 1), 9), 0.0)


def labelled(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(_id, _good) of every id with a label: 1 if all its labels say good, 0 if one says bad."""
    own = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(quality).alias("_good"))
    return own.filter("_good in (0, 1)")


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Verdict:
    own = settled(labelled(labels))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    marked = narrow_join(texts, own, "_id", "left")
    target, raw = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for b, t, r in gram_counts(marked.withColumn("_trusted", F.coalesce(F.col("_good") == 1, F.lit(False))), "_text", "_trusted").collect():
        target[b], raw[b] = t, r
    if not target.sum() or own.select("_good").distinct().count() < 2:
        return Verdict(np.zeros(1 << BITS, np.float32), -np.inf)
    ratio = (np.log((target + 0.5) / (target.sum() + 0.5 * len(target))) - np.log((raw + 0.5) / (raw.sum() + 0.5 * len(raw)))).astype(np.float32)
    # scores join, not texts
    return Verdict(ratio, choose_threshold(narrow_join(score(texts, ratio, "_text").select("_id", "llr"), own, "_id")))


def choose_threshold(scored: DataFrame) -> float:
    """The highest cut between the scores of (_good, llr) that rejects most bad texts for the good ones it loses.

    Distinct scores are numbered in order; a cut lies before each, and what it rejects is counted over all smaller ones.
    """
    good = F.col("_good") == 1
    steps = numbered(scored.groupBy("llr").agg(F.count_if(good).alias("_g"), F.count_if(~good).alias("_b")), [F.col("llr")], "_k")
    steps = settled(steps.select("llr", "_g", "_b", "_k"))
    n_good, n_bad = steps.agg(F.sum("_g"), F.sum("_b")).first()
    if not n_good or not n_bad:
        return -np.inf
    cuts = offsets_before(offsets_before(steps, "_k", "_g", "_lost"), "_k", "_b", "_caught")
    lost, caught = F.col("_lost") / F.lit(float(n_good)), F.col("_caught") / F.lit(float(n_bad))
    cuts = cuts.withColumn("_worth", caught - 10 * lost).filter(lost <= MAX_TRUSTED_LOSS)
    at = cuts.orderBy(F.desc("_worth"), "_k").first()
    before = steps.filter(F.col("_k") == at["_k"] - 1).first()
    return float((before["llr"] + at["llr"]) / 2 if before else at["llr"] - 1)


def score(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` plus ``llr``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def compute(texts: pa.Array):
        return (pa.array(np.concatenate([np.zeros(0), *(llr(shared.value, raw, offsets) for _, _, raw, offsets in runs(texts))])),)

    return with_arrays(docs, compute, "llr double", [text])


def rules(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a run."""
    n_docs = len(offsets) - 1

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    start, end, counts = words(raw, offsets)
    hashes = span_hash(raw, start, end)
    # lines: they end at \n or with the document
    nl = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], nl + 1]))
    line_start = line_start[line_start < len(raw)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    stop = np.concatenate([np.searchsorted(nl, line_start), []]).astype(np.int64)
    line_end = np.minimum(np.append(nl, len(raw))[stop], offsets[line_doc + 1])
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    key = span_hash(raw, line_start, line_end) ^ mix(line_doc.astype(np.uint64))
    n_lines = np.bincount(line_doc, minlength=n_docs)
    distinct = np.bincount(line_doc[np.unique(key, return_index=True)[1]], minlength=n_docs)
    # words inside repeated windows
    places, _ = window_places(counts, WINDOW)
    repeats = np.zeros(n_docs, np.int64)
    if len(places):
        h, doc = windows(hashes, counts, WINDOW)
        h ^= mix(doc.astype(np.uint64) + np.uint64(1 << 40))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        at = places[twice]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        upto = np.concatenate([[0], np.cumsum(counts)])
        repeats = covered[upto[1:]] - covered[upto[:-1]]
    return [counts, per_doc(~IS_SPACE[raw] & _MARK[raw]), per_doc(_SYMBOL[raw]), n_lines - distinct, repeats]


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, verdict: Verdict, text: str = "text") -> DataFrame:
    """``docs`` plus the columns of ``FIELDS``."""
    shared = docs.sparkSession.sparkContext.broadcast(verdict)

    def compute(texts: pa.Array):
        v = shared.value
        parts = [[] for _ in range(6)]
        for _, _, raw, offsets in runs(texts):
            for out, x in zip(parts, [*rules(raw, offsets), llr(v.ratio, raw, offsets)], strict=True):
                out.append(x)
        cols = [np.concatenate([np.zeros(0, np.int64 if k < 5 else np.float64), *x]) for k, x in enumerate(parts)]
        failed = (cols[0] < MIN_WORDS) | (100 * cols[4] > MAX_REPEAT_PERCENT * cols[0])
        return [*(pa.array(x) for x in cols), pa.array(failed), pa.array(~failed & (cols[5] >= v.threshold))]

    return with_arrays(docs, compute, FIELDS, [text])


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the verdict."""
    return judge(docs, learn(docs, labels)).filter("kept").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verdict = learn(docs, table(spark, sf_dir, "labels"))
    out = judge(docs, verdict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
