"""Operator 9: lexical retrieval packing.

Shards are lexical: a document's place is told by its heaviest terms among those that ``SUPPORT`` documents or more
have, by document frequencies over the whole corpus.  Documents meet by their first term; where more documents
have it than a task should hold, by the first two, and where even these are too many, by a hash besides.  Copies so meet
wherever they lie in the files.  What meets in a task is put in the order of its terms and cut into shards of about
``SHARD_BYTES`` of text, where the first term changes if it can.

A shard's documents are tokenised and indexed by BM25 over its words, weighted by the corpus.  A document
fills whole windows by itself; what is left of it is a seed, or joins a seed's window: the seed's index
query, of all its words, returns its best neighbours that are still unused, which fill the window greedily,
the last one cut to fit.  The end of a shard is cut into sequences whose lengths are powers of two, so
nothing is padded.

Every document of every shard is packed, whole, and every one of its words is in the index and the query.  A task holds
one shard at a time (or one longer document) and one Arrow batch.  Frequencies are exact; the driver holds those of the
``TERMS`` most frequent words at most, and a word without one weighs as its shard counts it.

Defined cases: null or empty text is the end id alone; very long texts fill windows of their own and are a shard by
themselves; equal texts and repeated rows are packed each on their own; ties of a score go to the earlier document;
an empty table gives an empty result; columns besides key and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_batches, table, with_arrays
from .textbuf import LOWER, runs, span_hash, trimmed, words

WINDOW = 2048
END_ID = 1
SHARD_BYTES = 4 << 20
PATH = 4  # terms that tell a document's place
SUPPORT = 16
TERMS = 1 << 20
TERM_BITS = 44  # of a word's hash
#: Documents that may meet by one term, or by two.
MEET = 4_000
K1, B = 1.2, 0.75
CACHE_WORDS = 600_000
#: (document, word) pairs that a task holds before it passes counts on.
HELD = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words that the tokenizer's own rules split into letters and what follows them, whatever surrounds them.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_LAST_PLAIN = "\u012b"  # up to here, characters are in composed form and one lower-case character each

_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: The lead byte of the accented letters of Latin-1, and the second bytes that are no letters.
_ACCENT, _NO_LETTER = 0xC3, (0x97, 0xB7)
#: How merges write a byte of other than ASCII letters: itself as a character if that is visible, else one from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_UNSEEN = [b for b in range(256) if b not in _VISIBLE]
_WRITTEN = np.array([list(chr(b if b in _VISIBLE else 256 + _UNSEEN.index(b)).encode()) if b >= 128 else [b, 0] for b in range(256)], np.uint8)

_tokenizers: dict[str, tuple] = {}
_known: dict[str, "WordIds"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def tokenizer(path: str):
    """The tokenizer of a file, its merges for words that are split already, the same for ASCII words, and ids that end words."""
    if path not in _tokenizers:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        tok = Tokenizer.from_file(path)
        pieces = Tokenizer(tok.model)
        pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            bpe = json.load(f)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in bpe["merges"]]
        # words come here once, so a cache would only cost
        plain = Tokenizer(models.BPE(vocab=bpe["vocab"], merges=merges, end_of_word_suffix=bpe["end_of_word_suffix"], cache_capacity=0))
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        _tokenizers[path] = (tok, pieces, plain, ends)
    return _tokenizers[path]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all spans, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def encode_plain(path: str, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, sizes, ids) of the words that are Latin-1 letters and then signs, if any: the tokenizer splits between these."""
    size = end - start
    low = LOWER[raw[spread(start, size)]]
    word = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    lead = low == _ACCENT
    second = np.concatenate([[False], lead[:-1]])
    second[first] = False
    low = np.where(second & (low < 0x9F) & (low != 0x97), low + np.uint8(0x20), low)
    letter = _LETTER[low] | (second & (low >= 0x80) & ~np.isin(low, _NO_LETTER)) | (lead & ~second)
    sign = _SIGN[low] & ~second
    after = np.concatenate([[False], sign[:-1]])
    after[first] = False
    bad = ~(letter | sign) | (letter & after)
    bad[first] |= ~letter[first]
    plain = np.bincount(word[bad], minlength=len(size)) == 0
    keep = plain[word]
    low, word, turn = low[keep], word[keep], (sign & ~after)[keep]
    begins = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    gap = turn | begins  # a space goes before each part
    wide = low >= 128
    stop = np.cumsum(1 + wide + gap)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    out[stop - 1 - wide] = _WRITTEN[low, 0]
    out[stop[wide] - 1] = _WRITTEN[low[wide], 1]
    parts = np.bincount(word[gap], minlength=len(size))[plain]
    tok, ends = tokenizer(path)[2:]
    cuts = (stop - 2 - wide)[begins][::2048].tolist()
    texts = [out[x:y].tobytes().decode() for x, y in zip(cuts, [*cuts, len(out)][1:], strict=True)] if cuts else []
    ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False))])
    stops = np.concatenate([[0], (np.flatnonzero(ends[ids]) + 1)[np.cumsum(parts) - 1]]) if len(parts) else np.zeros(1, np.int64)
    return np.flatnonzero(plain), np.diff(stops), ids


class WordIds:
    """Ids of the words that a worker has met, by hash."""

    def __init__(self, path: str):
        self.path = path
        self.key, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def of(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, pool) of the ids of each word; ``keys`` are sorted hashes of the spans."""
        if len(self.key):
            here = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
            new = np.flatnonzero(self.key[here] != keys)
        else:
            new = np.arange(len(keys))
        if len(self.key) + len(new) > CACHE_WORDS:  # the words of this shard stay, the common ones are among them
            known = np.setdiff1d(np.arange(len(keys)), new)
            old, size = self.at[here[known]], self.size[here[known]]
            self.key, self.size, self.pool = keys[known], size, self.pool[spread(old, size)]
            self.at = np.cumsum(size) - size
        if len(new):
            which, size, ids = encode_plain(self.path, raw, start[new], end[new])
            sizes, values = np.zeros(len(new), np.int64), [self.pool, ids]
            at = np.zeros(len(new), np.int64)
            sizes[which], at[which] = size, len(self.pool) + np.cumsum(size) - size
            hard = np.setdiff1d(np.arange(len(new)), which)
            got = encode_words(self.path, [raw[a:b].tobytes().decode() for a, b in zip(start[new[hard]].tolist(), end[new[hard]].tolist(), strict=True)])
            sizes[hard] = [len(x) // 4 for x in got]
            at[hard] = len(self.pool) + len(ids) + np.cumsum(sizes[hard]) - sizes[hard]
            self.pool = np.concatenate([*values, np.frombuffer(b"".join(got), "<u4")])
            key = np.concatenate([self.key, keys[new]])
            order = np.argsort(key, kind="stable")
            self.key, self.at, self.size = key[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]
        here = np.searchsorted(self.key, keys)
        return self.at[here], self.size[here], self.pool


def encode_words(path: str, batch: list[str]) -> list[bytes]:
    """Ids of each word, as little-endian 32-bit integers.

    Words of letters and signs are split here and merged by the tokenizer's model, many at a time; its normaliser and
    pattern, which cost several times more, see the others.
    """
    tok, pieces, _, ends = tokenizer(path)
    out: list[bytes] = [b""] * len(batch)
    parts, owner, hard = [], [], []
    for k, word in enumerate(batch):
        m = _PLAIN.fullmatch(word)
        if m and m[1].isalpha() and max(word) <= _LAST_PLAIN:
            parts.append(m[1].lower())
            owner.append(k)
            if m[2]:
                parts.append(m[2])
                owner.append(k)
        else:
            hard.append(k)
    for k0 in range(0, len(parts), 4096):
        ids = np.array(pieces.encode(" ".join(parts[k0 : k0 + 4096]), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        data, a = ids.tobytes(), 0
        for k, b in zip(owner[k0 : k0 + 4096], (4 * stops).tolist(), strict=True):
            out[k] += data[a:b]
            a = b
    for k, e in zip(hard, tok.encode_batch_fast([batch[k] for k in hard], add_special_tokens=False), strict=True):
        out[k] = np.array(e.ids, "<u4").tobytes()
    return out


def encode(path: str, raw: np.ndarray, offsets: np.ndarray):
    """Ids of all documents of a run, the places where documents begin, and (doc, term) of its words.

    The tokenizer drops white space and never joins what it separates, so that the ids of a text are
    those of its words; each distinct word is encoded once.
    """
    if path not in _known:
        _known[path] = WordIds(path)
    start, end, counts = words(raw, offsets)
    uniq, first, term = np.unique(span_hash(raw, start, end), return_index=True, return_inverse=True)
    at, size, pool = _known[path].of(uniq, raw, start[first], end[first])
    n = size[term]
    doc = np.repeat(np.arange(len(counts)), counts)
    per_doc = np.bincount(doc, weights=n, minlength=len(counts)).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    ids = np.full(bounds[-1], END_ID, "<u4")
    into = np.cumsum(n) - n + doc  # each document before has one end id
    ids[spread(into, n)] = pool[spread(at[term], n)]
    return ids, bounds, doc, term, uniq


def term_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def doc_terms(raw: np.ndarray, offsets: np.ndarray):
    """(doc, term, times) of each document's distinct words, by document, and its number of words."""
    start, end, counts = words(raw, offsets)
    h = span_hash(raw, start, end)
    docs_, terms, times = [], [], []
    rows = 1 << (64 - TERM_BITS)
    upto = np.concatenate([[0], np.cumsum(counts)])
    for at in range(0, len(counts), rows):  # one sort of document and term together
        here = slice(upto[at], upto[min(at + rows, len(counts))])
        d = np.repeat(np.arange(len(counts[at : at + rows]), dtype=np.uint64), counts[at : at + rows])
        both = np.sort((d << np.uint64(TERM_BITS)) | term_of(h[here]).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        docs_.append((both[first] >> np.uint64(TERM_BITS)).astype(np.int64) + at)
        terms.append((both[first] & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64))
        times.append(np.diff(np.append(first, len(both))))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *x]) for x in (docs_, terms, times)), counts


@dataclass
class Frequencies:
    term: np.ndarray  # sorted
    docs: np.ndarray  # that have it
    n_docs: int
    mean: float  # words of a document

    def of(self, term: np.ndarray) -> np.ndarray:
        """Documents that have each term, 0 where that is not known."""
        if not len(self.term):
            return np.zeros(len(term), np.int64)
        at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        return np.where(self.term[at] == term, self.docs[at], 0)


def frequencies(docs: DataFrame, text: str) -> Frequencies:
    """In how many documents words occur, over the whole corpus."""

    def per_partition(batches):
        held, size, total = [], 0, np.zeros(2, np.int64)

        def counts():
            term, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

        for batch in trimmed(batches):
            for _, n, raw, offsets in runs(batch.column(0)):
                _, term, _, words_ = doc_terms(raw, offsets)
                total += n, int(words_.sum())
                held.append(term)
                size += len(term)
                if size > HELD:
                    yield counts()
                    held, size = [], 0
        yield counts()
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array(total)], names=["term", "n"])  # documents and words

    rows = in_batches(docs.select(text), per_partition, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    often = rows.filter((F.col("term") < 0) | (F.col("n") >= SUPPORT)).orderBy(F.col("term") >= 0, F.desc("n"), "term").limit(TERMS + 2).toArrow().sort_by("term")
    term, n = often.column("term").to_numpy(), often.column("n").to_numpy()
    n_words, n_docs = (int(n[term == k].sum()) for k in (-2, -1))
    return Frequencies(term[term >= 0], n[term >= 0], n_docs, max(n_words / max(n_docs, 1), 1e-9))


def idf_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: np.ndarray, idf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def paths(raw: np.ndarray, offsets: np.ndarray, frequency: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """The ``PATH`` terms of each document that tell its place, -1 where it has fewer, and how many documents have them."""
    d, term, tf, size = doc_terms(raw, offsets)
    own = frequency.of(term)
    d, term, tf, own = (x[own > 0] for x in (d, term, tf, own))
    weight = bm25(tf, idf_of(own, frequency.n_docs), size[d], frequency.mean)
    out, df = np.full((len(size), PATH), -1, np.int64), np.zeros((len(size), PATH), np.int64)
    for k in range(PATH):  # the heaviest of each document, then the heaviest of what is left
        if not len(d):
            break
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        top = np.maximum.reduceat(weight, first)
        at = np.flatnonzero(weight == np.repeat(top, np.diff(np.append(first, len(d)))))
        at = at[np.concatenate([[True], d[at[1:]] != d[at[:-1]]])]  # ties: the smallest term
        out[d[at], k], df[d[at], k] = term[at], own[at]
        rest = np.ones(len(d), bool)
        rest[at] = False
        d, term, own, weight = (x[rest] for x in (d, term, own, weight))
    return out, df


def lexical(docs: DataFrame, frequency: Frequencies) -> DataFrame:
    """(doc_id, text, lead) where documents meet by their terms, in the order of these."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def compute(texts: pa.Array):
        found = [paths(raw, offsets, shared.value) for _, _, raw, offsets in runs(texts)]
        terms = np.concatenate([np.zeros((0, PATH), np.int64), *(x for x, _ in found)])
        df = np.concatenate([np.zeros((0, PATH), np.int64), *(x for _, x in found)])
        both = np.where(terms[:, 1] < 0, df[:, 0], np.minimum(df[:, 0], df[:, 1]))
        second = np.where(df[:, 0] > MEET, terms[:, 1], -1)
        parts = np.where((df[:, 0] > MEET) & (both > MEET), -(-both // MEET), 1)
        parts = np.where(terms[:, 0] < 0, -(-shared.value.n_docs // MEET), parts)  # no term at all
        return [pa.array(x) for x in (*terms.T, second, parts)]

    names = [f"_t{k}" for k in range(PATH)]
    fields = ", ".join(f"{n} long" for n in [*names, "_second", "_parts"])
    placed = with_arrays(docs, compute, fields, ["text"]).withColumn("_h", F.xxhash64("doc_id", "text"))
    return placed.repartition(names[0], "_second", F.pmod("_h", "_parts")).sortWithinPartitions(*names, "_h", "doc_id", "text").select("doc_id", "text", F.col(names[0]).alias("lead"))


def shards_of(batches, shard_bytes: int):
    """(keys, documents, bytes, offsets) of each shard of a range, over any number of batches."""
    keys, lead = pa.array([], pa.int64()), np.zeros(0, np.int64)
    raw, offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
    more = True
    batches = iter(batches)
    while more:
        batch = next(batches, None)
        more = batch is not None
        for row, n, r, o in runs(batch.column(1), 1 << 60) if more else ():
            keys = pa.concat_arrays([keys, batch.column(0).slice(row, n)])
            lead = np.concatenate([lead, batch.column(2).slice(row, n).to_numpy(zero_copy_only=False)])
            raw, offsets = np.concatenate([raw, r]), np.concatenate([offsets, o[1:] + offsets[-1]])
        at, n = 0, len(lead)
        while at < n:
            upto = max(int(np.searchsorted(offsets, offsets[at] + shard_bytes, "right")) - 1, at + 1)
            if upto >= n and more:
                break
            if upto < n:
                half = max(int(np.searchsorted(offsets, offsets[at] + shard_bytes // 2)), at + 1)
                turns = np.flatnonzero(lead[half : upto + 1] != lead[half - 1 : upto])
                upto = half + int(turns[-1]) if len(turns) else upto
            yield keys[at:upto], upto - at, raw[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
            at = upto
        keys, lead, raw, offsets = keys[at:], lead[at:], raw[offsets[at] :], offsets[at:] - offsets[at]


class Bm25:
    """Inverted index of the documents of a shard; ``df`` holds how many documents of ``n_corpus`` have each term."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, df: np.ndarray | None = None, n_corpus: int | None = None):
        n_terms = int(term.max()) + 1 if len(term) else 1
        pair = np.sort(doc * n_terms + term)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(pair)))
        d, t = pair[first] // n_terms, pair[first] % n_terms
        own = np.bincount(t, minlength=n_terms)
        use = own[t] > 1  # a word of one document finds no neighbour
        size = np.bincount(doc, minlength=n_docs)
        mean = max(size.mean(), 1e-9) if n_docs else 1
        d, t, tf = d[use], t[use], tf[use]
        idf = idf_of(own if df is None else np.maximum(own, df), n_docs if n_corpus is None else n_corpus)
        weight = bm25(tf, idf[t], size[d], mean)
        by_term = np.argsort(t, kind="stable")
        self.n = n_docs
        self.post_doc, self.post_weight = d[by_term], weight[by_term]
        self.post_at = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_terms))])
        self.doc_term = t  # by document, as ``pair`` is
        self.doc_at = np.searchsorted(d, np.arange(n_docs + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a word with the seed, best first."""
        terms = self.doc_term[self.doc_at[seed] : self.doc_at[seed + 1]]
        at = spread(self.post_at[terms], self.post_at[terms + 1] - self.post_at[terms])
        score = np.bincount(self.post_doc[at], weights=self.post_weight[at], minlength=self.n)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack(sizes: np.ndarray, index: Bm25) -> list[tuple[int, int, int, int, int]]:
    """(doc, start, length, sequence, offset) of every piece of a shard."""
    out = []
    seq = 0
    left = sizes.tolist()  # tokens of each document that are not placed
    for d, n in enumerate(left):
        for k in range(n // WINDOW):
            out.append((d, k * WINDOW, WINDOW, seq, 0))
            seq += 1
        left[d] = n % WINDOW
    total = sizes.tolist()
    used = [n == 0 for n in left]
    at = 0
    carry = -1  # a document whose window was full before it ended seeds the next one
    rest = sum(left)
    while rest:
        if carry < 0:
            while used[at]:
                at += 1
            carry = at
        seed, free, offset = carry, WINDOW, 0
        carry = -1
        queue, behind = [seed], 0
        near = None
        while free and rest:
            if queue:
                d = queue.pop()
            else:
                if near is None:
                    near = index.neighbours(seed).tolist()
                while behind < len(near) and used[near[behind]]:
                    behind += 1
                if behind < len(near):
                    d = near[behind]
                else:
                    while used[at]:
                        at += 1
                    d = at
            n = min(left[d], free)
            out.append((d, total[d] - left[d], n, seq, offset))
            left[d] -= n
            rest -= n
            free -= n
            offset += n
            if left[d]:
                carry = d
            else:
                used[d] = True
        seq += 1
    if out and out[-1][4] + out[-1][2] < WINDOW:  # the last window: cut it at powers of two
        tail = [p for p in out if p[3] == seq - 1]
        out = [p for p in out if p[3] != seq - 1]
        seq -= 1
        room = used_up = 0
        todo = sum(p[2] for p in tail)
        for d, start, n, _, _ in tail:
            while n:
                if not room:
                    seq += used_up > 0
                    room, used_up = 1 << (todo.bit_length() - 1), 0
                take = min(n, room)
                out.append((d, start, take, seq, used_up))
                start, n, room, used_up, todo = start + take, n - take, room - take, used_up + take, todo - take
    return out


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents; columns are those of ``SCHEMA``."""
    path = path or default_tokenizer()

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    frequency = frequencies(source, "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def per_partition(batches):
        first = TaskContext.get().partitionId() << 36
        for keys, n, raw, offsets in shards_of(trimmed(batches), shard_bytes):
            ids, bounds, doc, term, uniq = encode(path, raw, offsets)
            sizes = np.diff(bounds)
            pieces = np.array(pack(sizes, Bm25(n, doc, term, shared.value.of(term_of(uniq)), shared.value.n_docs)), np.int64).reshape(-1, 5)
            d, start, length, seq, offset = pieces.T
            begin = bounds[d] + start
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [keys.take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[d]), pa.array(seq + first), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            first += int(seq.max()) + 1 if len(seq) else 0

    return in_batches(lexical(source, frequency), per_partition, SCHEMA)


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
