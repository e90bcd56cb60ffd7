"""Operator 3: language-model scoring with a probabilistic suffix tree over tokens.

Symbols are the frequent tokens (at least ``MIN_SHARE`` of all) and one class for all others.  A context is
a sequence of one to ``DEPTH`` symbols.  It is kept if it makes up at least ``MIN_SHARE`` of all places and its
next-symbol distribution diverges from that of its longest kept suffix: its count times the divergence,
less what smoothing costs, must reach ``MIN_GAIN``.  Distributions are smoothed towards the suffix's, and the root
is the base distribution.  A token is scored in the state of the longest kept suffix of what precedes it in
its text (a text begins after an end token); within the class of other tokens the base shares hold.  The
probabilities of all tokens and one unknown word add up to one in every state.

Beyond these, deep contexts are ``DEEP`` words themselves, of any frequency.  Such a context is kept by the same divergence
test against the tree; words that follow it ``REPEATS`` times or more have a share of their own.  So passages that the corpus
holds twice are told from those it holds once.

All training texts are counted: tokens by hash, symbols by context, one pass for each length, and all deep contexts.  What is
broadcast is bounded by shares of the corpus, hence at any size: ``1 / MIN_SHARE`` contexts of a length,
``PAIRS`` (context, symbol) pairs of a length, ``HEAD`` words with their counts.  Counts of rarer words meet the documents in
joins.  Deep contexts meet by buckets of their hash: one shuffle finds those that training texts hold twice or more, as no other
can be kept; places in these go through a second one, each with a hash of its text, and are counted and valued in their bucket.
A filter of at most ``FILTER_BITS`` bits tells them; fuller, it lets more places through, which are counted like the others and
drop out.  Contexts of ``HOT`` places or more, which would crowd a bucket, go through joins of their own.

Defined cases: null text is empty and scores its end alone; without training texts all counts are 0; very long texts are
counted and scored whole; equal texts score alike; an empty table gives an empty result; columns with the names of new ones
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import held_out
from .tables import in_batches, narrow_join, settled, table, with_arrays
from .textbuf import LOWER, as_long, mix, runs, span_hash, trimmed, words

DEPTH = 3
MIN_SHARE = 1 / 32_768
PAIRS = 1 << 21
HEAD = 1 << 22
PRIOR = 8.0
MIN_GAIN = 10.0
DEEP = 3
REPEATS = 2
HOT = 1 << 17
FILTER_BITS = 1 << 29
BUCKET = 1 << 19  # training tokens for each bucket of deep contexts, about
HELD = 2_000_000  # places that a task holds before it gives them away
UNIT = 1e9  # values of deep places are summed as whole numbers of this part
END_TOKEN = -1  # stands for the end token among hashes of words
OTHER = 0  # the symbol of all tokens that are not frequent


@dataclass
class Level:
    """Kept contexts of one length (codes, sorted) and their explicit (context, symbol) pairs."""

    context: np.ndarray
    rest: np.ndarray  # share of the suffix's distribution in each context's
    pair: np.ndarray  # context's place * symbols + symbol, sorted
    share: np.ndarray  # what is added for that symbol


@dataclass
class Tree:
    head: np.ndarray  # sorted hashes of tokens with known counts
    head_count: np.ndarray
    symbol: np.ndarray  # sorted hashes of frequent tokens; symbol k + 1 is the k-th
    root: np.ndarray  # base probability of each symbol
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted hashes of deep contexts that go by joins

    @property
    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Token hashes of a run, each text closed by its end token, the place of each in its text, tokens of a text."""
    low = LOWER[raw]
    start, end, counts = words(low, offsets)
    last = np.cumsum(counts + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, END_TOKEN, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = as_long(span_hash(low, start, end))
    place = np.arange(len(out)) - np.repeat(last - counts, counts + 1)
    return out, place, counts + 1


def look_up(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted array, or -1."""
    if not len(known):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, at, -1)


def contexts(symbols: np.ndarray, place: np.ndarray, n_symbols: int, end_symbol: int, depth: int):
    """For lengths 1..depth: the code of the symbols before each place, and whether they lie in its text."""
    padded = np.concatenate([np.full(depth, end_symbol, np.int64), symbols])
    code, unit = np.zeros(len(symbols), np.int64), 1
    for d in range(1, depth + 1):
        code = code + padded[depth - d : depth - d + len(symbols)] * unit
        unit *= n_symbols
        yield code, place >= d - 1


def context_hash(tokens_before) -> np.ndarray:
    """Hash of a deep context, given its tokens from the first to the last."""
    h = np.uint64(0)
    for token in tokens_before:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + token.view(np.uint64))
    return as_long(h)


def deep_contexts(token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``DEEP`` tokens before them lie in their text, and the hash of these."""
    at = np.flatnonzero(place >= DEEP)
    return at, context_hash([token[at - k] for k in range(DEEP, 0, -1)]) if len(at) else np.zeros(0, np.int64)


def text_keys(token: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each text's tokens: texts that agree in it score alike."""
    if not len(token):
        return np.zeros(0, np.int64)
    each = mix(token.view(np.uint64) + mix(place.astype(np.uint64) + np.uint64(1)))
    return as_long(mix(np.add.reduceat(each, np.flatnonzero(place == 0))))


def sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    uniq, inv = np.unique(key, return_inverse=True)
    return uniq, np.bincount(inv, weights=n, minlength=len(uniq)).astype(np.int64)


def counted(docs: DataFrame, text: str, keys_of) -> DataFrame:
    """(key, n) over all texts, where ``keys_of(token hashes, places)`` gives the keys of a run."""

    def per_partition(batches):
        kept, held = [], 0
        for batch in trimmed(batches):
            for _, _, raw, offsets in runs(batch.column(0)):
                kept.append(np.unique(keys_of(*tokens(raw, offsets)[:2]), return_counts=True))
                held += len(kept[-1][0])
                if held > 4_000_000:
                    kept = [sums(kept)]
                    held = 0 if len(kept[0][0]) < 2_000_000 else len(kept[0][0]) - 2_000_000
                if len(kept) == 1 and len(kept[0][0]) > 4_000_000:  # bounded memory: the rest is summed by Spark
                    key, n = kept.pop()
                    held = 0
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])
        if kept:
            key, n = sums(kept)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])

    return in_batches(docs.select(text), per_partition, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def columns_of(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got.column(n).to_numpy() for n in names]


def suffix_share(tree: Tree, code: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """Probability of each symbol after its context of ``depth`` symbols, by the levels there are."""
    p, n_symbols = tree.root[symbol], len(tree.root)
    for d, level in enumerate(tree.levels[:depth], 1):
        at = look_up(level.context, code % n_symbols**d)
        kept = np.flatnonzero(at >= 0)
        found = look_up(level.pair, at[kept] * n_symbols + symbol[kept])
        p[kept] = level.rest[at[kept]] * p[kept] + np.where(found >= 0, level.share[found] if len(level.share) else 0.0, 0.0)
    return p


def keep_divergent(tree: Tree, total: tuple[np.ndarray, np.ndarray], pair: np.ndarray, n: np.ndarray, depth: int) -> Level:
    """The level of contexts that pass the divergence test; ``pair`` is context * symbols + next symbol."""
    n_symbols = len(tree.root)
    context, count = total
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    at = look_up(context, pair // n_symbols)
    pair, n, at = pair[at >= 0], n[at >= 0], at[at >= 0]
    explicit = np.bincount(at, weights=n, minlength=len(context))
    rest = (PRIOR + count - explicit) / (count + PRIOR)
    before = suffix_share(tree, pair // n_symbols, pair % n_symbols, depth - 1)
    share = n / (count[at] + PRIOR)
    gain = np.bincount(at, weights=n * np.log((share + rest[at] * before) / before), minlength=len(context)) + (count - explicit) * np.log(rest)
    kept = gain >= MIN_GAIN
    renumbered = np.cumsum(kept) - 1
    own = kept[at]
    return Level(context[kept], rest[kept], renumbered[at[own]] * n_symbols + pair[own] % n_symbols, share[own])


def learn(docs: DataFrame, text: str = "text", depth: int = DEPTH, min_share: float = MIN_SHARE) -> tuple[Tree, DataFrame]:
    """The tree of all training texts, and (key, n) of all their tokens."""
    counts = settled(counted(docs, text, lambda token, place: token))
    own = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = own["n"] or 0, own["v"]
    head, head_count = columns_of(counts.filter(F.col("n") * HEAD >= total), "key", "n")
    order = np.argsort(head)
    head, head_count = head[order].astype(np.int64), head_count[order].astype(np.int64)
    often = head_count >= max(min_share * total, 2)
    tree = Tree(head, head_count, head[often], np.zeros(0), total, distinct)
    p = (head_count[often] + 0.5) / tree.scale
    tree.root = np.concatenate([[max(1 - p.sum(), 1e-12)], p])
    n_symbols = len(tree.root)
    end_symbol = int(look_up(tree.symbol, np.array([END_TOKEN]))[0]) + 1
    shared = docs.sparkSession.sparkContext.broadcast(tree.symbol)
    context = np.flatnonzero(tree.root > 0)  # symbols that may be contexts of length 1, then the frequent pairs
    for d in range(1, depth + 1):
        if n_symbols ** (d + 1) >= 1 << 62 or not len(context):
            break
        wanted = docs.sparkSession.sparkContext.broadcast(context)

        def keys_of(token, place, d=d, wanted=wanted):
            symbol = look_up(shared.value, token) + 1
            code, valid = list(contexts(symbol, place, n_symbols, end_symbol, d))[-1]
            if d > 1:
                valid &= look_up(wanted.value, code) >= 0
            return (code * n_symbols + symbol)[valid]

        grams = settled(counted(docs, text, keys_of))
        at, size = columns_of(grams.groupBy(F.expr(f"key div {n_symbols}L").alias("context")).agg(F.sum("n").alias("n")).filter(F.col("n") >= max(min_share * total, 4)), "context", "n")
        order = np.argsort(at)
        frequent = at[order].astype(np.int64), size[order].astype(np.float64)
        pair, n = columns_of(grams.filter((F.col("n") >= 2) & (F.col("n") * PAIRS >= total)), "key", "n")
        tree.levels.append(keep_divergent(tree, frequent, pair.astype(np.int64), n.astype(np.float64), d))
        if d == DEEP:
            parts = [frequent[0][frequent[1] >= HOT] // n_symbols**k % n_symbols for k in range(DEEP - 1, -1, -1)]
            parts = [x[np.all(parts, axis=0)] for x in parts]  # words themselves, not the class of others
            if len(parts[0]):
                tree.hot = np.sort(context_hash([tree.symbol[x - 1] for x in parts]))
        # a longer context is frequent only if both its ends are: the pairs just counted are its candidates
        context = np.sort(pair[n >= max(min_share * total, 4)]).astype(np.int64)
    return tree, counts


def gains(tree: Tree, token: np.ndarray, place: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """log10 of each token's probability in its state over its base probability; only of the places ``at``, if given."""
    at = np.arange(len(token)) if at is None else at
    symbol = look_up(tree.symbol, token) + 1
    n_symbols, depth = len(tree.root), len(tree.levels)
    end_symbol = int(look_up(tree.symbol, np.array([END_TOKEN]))[0]) + 1
    base = tree.root[symbol[at]]
    p = base.copy()
    for level, (code, valid) in zip(tree.levels, contexts(symbol, place, n_symbols, end_symbol, depth), strict=True):
        known = look_up(level.context, code[at])
        kept = np.flatnonzero(valid[at] & (known >= 0))
        found = look_up(level.pair, known[kept] * n_symbols + symbol[at[kept]])
        p[kept] = level.rest[known[kept]] * p[kept] + np.where(found >= 0, level.share[found] if len(level.share) else 0.0, 0.0)
    return np.log10(p / base)


@dataclass
class Repeated:
    """A filter that passes all deep contexts that training texts hold twice or more, but hot ones, and maybe some others."""

    bucket_bits: int
    bits: np.ndarray  # a slice of bytes for each bucket

    def bucket(self, context: np.ndarray) -> np.ndarray:
        return (context.view(np.uint64) >> np.uint64(64 - self.bucket_bits)).astype(np.int64)

    def rest(self, context: np.ndarray) -> np.ndarray:
        """The 24 bits of a context's hash below those of its bucket: a bucket has about as many contexts at every size."""
        return (context.view(np.uint64) >> np.uint64(40 - self.bucket_bits)).astype(np.uint32) & np.uint32(0xFFFFFF)

    def passes(self, context: np.ndarray) -> np.ndarray:
        share = len(self.bits) >> self.bucket_bits
        first, rest = self.bucket(context) * share, self.rest(context)
        out = np.ones(len(context), bool)
        for at in filter_places(rest, share):
            out &= (self.bits[first + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def filter_places(rest: np.ndarray, share: int):
    """The two bits of each context in its bucket's slice of ``share`` bytes."""
    h = mix(rest.astype(np.uint64) + np.uint64(1))
    for k in (0, 32):
        yield ((h >> np.uint64(k)) % np.uint64(share * 8)).astype(np.int64)


def array_of(parts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the slices of ``parts`` between ``ends``, which begin at 0."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(parts, kind))


def flat(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a column of lists, row after row."""
    return np.concatenate([np.zeros(0, np.int8), *(x.flatten().to_numpy(zero_copy_only=False) for x in table.column(name).chunks)])


def repeated_contexts(docs: DataFrame, tree: Tree, text: str = "text") -> Repeated:
    """The filter of training texts ``docs``."""
    bucket_bits = min(max((tree.tokens // BUCKET).bit_length(), 1), 20)
    n_bytes = min(max(1 << max(tree.tokens - 1, 1).bit_length(), 1024), FILTER_BITS) // 8
    share = max(n_bytes >> bucket_bits, 8)
    seen = Repeated(bucket_bits, np.zeros(0, np.uint8))
    hot = docs.sparkSession.sparkContext.broadcast(tree.hot)

    def given(parts):
        h = np.sort(np.concatenate(parts).view(np.uint64)).view(np.int64)
        h = h[np.append([True, True][: len(h)], h[2:] != h[:-2])]  # twice is enough
        bucket, first = np.unique(seen.bucket(h), return_index=True)
        planes = seen.rest(h).view(np.uint8).reshape(-1, 4)[:, :3]  # byte by byte, as sorted high bytes compress well
        rows = [planes[a:b].T.tobytes() for a, b in zip(first, np.append(first[1:], len(h)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rows, pa.binary())], names=["bucket", "context"])

    def per_partition(batches):
        parts, held = [], 0
        for batch in trimmed(batches):
            for _, _, raw, offsets in runs(batch.column(0)):
                _, h = deep_contexts(*tokens(raw, offsets)[:2])
                parts.append(h[look_up(hot.value, h) < 0] if len(hot.value) else h)
                held += len(parts[-1])
                if held > 2 * HELD:
                    yield given(parts)
                    parts, held = [], 0
        if held:
            yield given(parts)

    def twice(rows: pa.Table) -> pa.Table:
        planes = [np.frombuffer(x.as_py(), np.uint8).reshape(3, -1).astype(np.uint32) for x in rows.column("context")]
        rest = np.sort(np.concatenate([low | middle << 8 | high << 16 for low, middle, high in planes]))
        rest = rest[1:][rest[1:] == rest[:-1]]
        own = np.zeros(share * 8, bool)
        for at in filter_places(rest, share):
            own[at] = True
        return pa.table({"bucket": rows.column("bucket")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    parts = in_batches(docs.select(text), per_partition, "bucket long, context binary")
    bits = np.zeros((1 << bucket_bits, share), np.uint8)
    for row in parts.groupBy("bucket").applyInArrow(twice, "bucket long, bits binary").collect():  # FILTER_BITS at most
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return Repeated(bucket_bits, bits.reshape(-1))


def score(docs: DataFrame, shared: Broadcast, seen: Broadcast, text: str = "text") -> DataFrame:
    """``docs`` plus n_tokens, head_known, head_base, gain, a hash of the text, the hashes and counts of its rarer words,
    its places in hot deep contexts, and (bucket, token) of rarer words in other deep contexts that may be kept.

    ``shared`` and ``seen`` are the tree and the filter.  Places in hot contexts are (context, token, ratio): ratio is the token's probability in its state over its base probability.
    """

    def compute(texts: pa.Array):
        t = shared.value
        cols: list[list] = [[], [], [], [], []]
        rare_hash, rare_n, rare_len = [], [], []
        deep: list[list] = [[], [], [], []]
        met: list[list] = [[], [], []]
        for _, n_docs, raw, offsets in runs(texts):
            token, place, n_tokens = tokens(raw, offsets)
            at = look_up(t.head, token)
            in_head = at >= 0
            c = np.where(in_head, t.head_count[at] if len(t.head) else 0, 0)
            doc = np.repeat(np.arange(n_docs), n_tokens)
            gain = gains(t, token, place)
            per_doc = [n_tokens, *(np.bincount(doc, weights=w, minlength=n_docs) for w in (in_head, np.log10((c + 0.5) / t.scale), gain)), text_keys(token, place)]
            places, context = deep_contexts(token, place)
            hot = look_up(t.hot, context) >= 0
            ours = places[hot]
            for out, x in zip(deep, (context[hot], token[ours], 10.0 ** gain[ours], np.bincount(doc[ours], minlength=n_docs)), strict=True):
                out.append(x)
            cool = np.flatnonzero(~hot & ~in_head[places])
            cool = cool[seen.value.passes(context[cool])]
            ours = places[cool]
            for out, x in zip(met, (seen.value.bucket(context[cool]), token[ours], np.bincount(doc[ours], minlength=n_docs)), strict=True):
                out.append(x)
            for out, x in zip(cols, per_doc, strict=True):
                out.append(x)
            h, d = token[~in_head], doc[~in_head]
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            rare_hash.append(h[first])
            rare_n.append(np.diff(np.append(first, len(h))))
            rare_len.append(np.bincount(d[first], minlength=n_docs))
        kinds = (np.int64, np.int64, np.float64, np.float64, np.int64)
        done = [pa.array(np.concatenate([np.zeros(0, k), *x]).astype(k)) for x, k in zip(cols, kinds, strict=True)]
        lists = []
        for lengths, xs, types in (
            (rare_len, (rare_hash, rare_n), (np.int64, np.int64)),
            (deep[3], deep[:3], (np.int64, np.int64, np.float32)),
            (met[2], met[:2], (np.int64, np.int64)),
        ):
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))])
            lists += [array_of(np.concatenate([np.zeros(0, k), *x]).astype(k), ends, pa.from_numpy_dtype(k)) for x, k in zip(xs, types, strict=True)]
        return [*done, *lists]

    fields = (
        "n_tokens long, head_known long, head_base double, gain double, text_key long, rare array<long>, rare_n array<long>, "
        "deep_context array<long>, deep_token array<long>, deep_ratio array<float>, met_bucket array<long>, met_token array<long>"
    )
    return with_arrays(docs, compute, fields, [text])


def deep_places(docs: DataFrame, shared: Broadcast, seen: Broadcast, text: str = "text", held: str = "held_out") -> DataFrame:
    """(bucket, held, context, code, rare, p, text_key): places in deep contexts that may be kept, by bucket and sorted.

    The lists of a row have an element for each place: the context, the token's place in ``tree.head``, or -1, and its
    probability in the tree, or for -1 that over its base probability; ``rare`` has the tokens of the places with -1.
    """
    names = ["bucket", "held", "context", "code", "rare", "p", "text_key"]

    def given(parts):
        context, code, token, p, key, is_held = (np.concatenate(x) for x in zip(*parts, strict=True))
        for now in (False, True):
            own = np.flatnonzero(is_held == now)
            own = own[np.argsort(context[own].view(np.uint64), kind="stable")]
            if not len(own):
                continue
            bucket, ends = np.unique(seen.value.bucket(context[own]), return_index=True)
            ends = np.append(ends, len(own))
            unknown = code[own] < 0
            rare_ends = np.concatenate([[0], np.cumsum(unknown)])[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket),
                    pa.array(np.full(len(bucket), now)),
                    array_of(context[own], ends, pa.int64()),
                    array_of(code[own], ends, pa.int32()),
                    array_of(token[own][unknown], rare_ends, pa.int64()),
                    array_of(p[own], ends, pa.float32()),
                    array_of(key[own], ends, pa.int64()),
                ],
                names=names,
            )

    def per_partition(batches):
        t = shared.value
        parts, n_held = [], 0
        for batch in trimmed(batches):
            flag = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, n_docs, raw, offsets in runs(batch.column(0)):
                token, place, n_tokens = tokens(raw, offsets)
                at, context = deep_contexts(token, place)
                mine = seen.value.passes(context)
                if len(t.hot):
                    mine &= look_up(t.hot, context) < 0
                at, context = at[mine], context[mine]
                code = look_up(t.head, token[at])
                base = np.where(code >= 0, (t.head_count[code] + 0.5) / t.scale if len(t.head) else 1.0, 1.0)
                doc = np.repeat(np.arange(n_docs), n_tokens)[at]
                p = base * 10.0 ** gains(t, token, place, at)
                parts.append((context, code.astype(np.int32), token[at], p.astype(np.float32), text_keys(token, place)[doc], flag[first : first + n_docs][doc]))
                n_held += len(at)
                if n_held > HELD:
                    yield from given(parts)
                    parts, n_held = [], 0
        if n_held:
            yield from given(parts)

    return in_batches(docs.select(text, held), per_partition, "bucket long, held boolean, context array<long>, code array<int>, rare array<long>, p array<float>, text_key array<long>")


def valued(context: np.ndarray, token: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the deep level adds to the log10 probability of each place; ``counts`` tells those of training texts.

    All places of the contexts that occur must be there.  It is 0 where the context is not kept.
    """
    if not len(context):
        return np.zeros(0)
    order = np.lexsort((token, context))
    c, t = context[order], token[order]
    new_context = np.append(True, c[1:] != c[:-1])
    new_pair = new_context | np.append(True, t[1:] != t[:-1])
    pair = np.cumsum(new_pair) - 1
    of = (np.cumsum(new_context) - 1)[new_pair]  # the context of each pair
    n = np.bincount(pair, weights=counts[order])
    least = np.minimum.reduceat(p[order].astype(np.float64), np.flatnonzero(new_pair))
    often = n >= REPEATS
    size, told = np.bincount(of, weights=n), np.bincount(of, weights=n * often)
    rest = (PRIOR + size - told) / (size + PRIOR)
    value = np.where(often, np.log10(n / (size[of] + PRIOR) / least + rest[of]), np.log10(rest)[of])
    gain = np.bincount(of, weights=np.where(often, n * value, 0.0)) * np.log(10) + (size - told) * np.log(rest)
    kept = (told > 0) & (gain >= MIN_GAIN)
    out = np.zeros(len(context))
    out[order] = np.where(kept[of], value, 0.0)[pair]
    return out


def deep_sums(places: DataFrame, rare: DataFrame, scale: float) -> DataFrame:
    """(text_key, units): what ``deep_places`` add to their texts, in parts of ``UNIT``, summed over texts of one key.

    ``rare`` has (bucket, token, n) of the rarer words that occur in a bucket.
    """

    def per_bucket(rows: pa.Table, known: pa.Table) -> pa.Table:
        context, code, p, key = (flat(rows, name) for name in ("context", "code", "p", "text_key"))
        lengths = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy(zero_copy_only=False) for x in rows.column("context").chunks)]).astype(np.int64)
        held = np.repeat(rows.column("held").to_numpy().astype(bool), lengths)
        token, p = code.astype(np.int64), p.astype(np.float64)
        unknown = np.flatnonzero(code < 0)
        if len(unknown):
            token[unknown] = flat(rows, "rare")
            word, n = known.column("token").to_numpy(), known.column("n").to_numpy()
            order = np.argsort(word)
            at = look_up(word[order], token[unknown])
            p[unknown] *= (np.where(at >= 0, n[order][at] if len(n) else 0, 0) + 0.5) / scale
        units = np.rint(valued(context, token, p, ~held) * UNIT).astype(np.int64)
        some = np.flatnonzero(units)
        some = some[np.argsort(key[some], kind="stable")]
        first = np.flatnonzero(np.append(True, key[some][1:] != key[some][:-1])) if len(some) else some
        return pa.table({"text_key": pa.array(key[some][first].astype(np.int64)), "units": pa.array(np.add.reduceat(units[some], first) if len(some) else units[some])})

    found = places.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(per_bucket, "text_key long, units long")
    # two whole numbers hold the sum over any number of texts, and add up alike in any order
    high, low = F.sum(F.shiftright("units", 32)), F.sum(F.col("units").bitwiseAND(F.lit((1 << 32) - 1)))
    return found.groupBy("text_key").agg(high.alias("high"), low.alias("low")).select("text_key", (F.col("high").cast("double") * float(1 << 32) + F.col("low")).alias("units"))


def deep_level(places: DataFrame, counts: DataFrame, scale: float) -> tuple[DataFrame, DataFrame]:
    """(context, token, value) and (context, rest) of the hot deep contexts that pass the divergence test.

    ``places`` has (context, token, ratio) of all training texts.  ``value`` and ``rest`` are what a token's log10
    probability gains on that in the tree: a token that follows often enough, and any other.
    """
    often = settled(places.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"), F.min("ratio").cast("double").alias("ratio")).filter(F.col("n") >= REPEATS))
    wanted = settled(often.select("context").distinct())
    sizes = narrow_join(places, wanted, "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    tokens_ = settled(often.select("token").distinct())
    base = settled(narrow_join(counts.select(F.col("key").alias("token"), F.col("n").alias("_n")), tokens_, "token", "left_semi"))
    known = narrow_join(often, base, "token").withColumn("p", (F.col("_n") + 0.5) / scale * F.col("ratio"))
    own = known.groupBy("context").agg(F.sum("n").alias("told"))
    level = settled(sizes.join(own, "context").withColumn("rest", (PRIOR + F.col("size") - F.col("told")) / (F.col("size") + PRIOR)))
    pairs = known.join(level, "context").withColumn("value", F.log10(F.col("n") / (F.col("size") + PRIOR) / F.col("p") + F.col("rest")))
    gain = F.sum(F.col("n") * F.col("value")) * float(np.log(10)) + F.first((F.col("size") - F.col("told")) * F.log("rest"))
    kept = settled(pairs.groupBy("context").agg(gain.alias("gain"), F.first("rest").alias("_rest")).filter(F.col("gain") >= MIN_GAIN).select("context", F.log10("_rest").alias("rest")))
    return settled(pairs.join(kept.select("context"), "context", "left_semi").select("context", "token", "value")), kept


def hot_sums(scored: DataFrame, counts: DataFrame, scale: float) -> DataFrame:
    """(_row, hot): what hot deep contexts add to each document."""
    places = scored.select("_row", "held_out", F.explode(F.arrays_zip("deep_context", "deep_token", "deep_ratio")).alias("x")).select("_row", "held_out", F.col("x.deep_context").alias("context"), F.col("x.deep_token").alias("token"), F.col("x.deep_ratio").alias("ratio"))
    pairs, contexts_ = deep_level(places.filter("not held_out").drop("_row", "held_out"), counts, scale)
    reached = narrow_join(places.select("_row", "context", "token"), contexts_, "context").join(pairs, ["context", "token"], "left")
    return reached.groupBy("_row").agg(F.sum(F.coalesce("value", "rest").cast("decimal(28,12)")).cast("double").alias("hot"))


def scored(documents: DataFrame, every: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents, learned from those not held out.

    All deep contexts are counted, as ``every`` 1 has always asked for.
    """
    if every != 1:
        raise ValueError("all deep contexts are counted")
    docs = documents.select("doc_id", held_out(rest=1).alias("held_out"), "text")
    train = docs.filter(~F.col("held_out"))
    tree, counts = learn(train)
    sc = docs.sparkSession.sparkContext
    shared, seen = sc.broadcast(tree), sc.broadcast(repeated_contexts(train, tree))
    scored = settled(score(docs, shared, seen).drop("text").withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("_row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("times"))
    more = F.log10((F.col("n") + 0.5) / 0.5) * F.col("times")
    met = scored.filter("not held_out").select(F.explode(F.arrays_zip("met_bucket", "met_token")).alias("x")).select(F.col("x.met_bucket").alias("bucket"), F.col("x.met_token").alias("key")).distinct()
    met = met.join(counts.filter(F.col("n") >= REPEATS), "key").select("bucket", F.col("key").alias("token"), "n")
    deep = deep_sums(deep_places(docs, shared, seen), met, tree.scale)
    # texts of one key have equal sums, so an even share of theirs is each one's
    alike = scored.groupBy("text_key").agg(F.count(F.lit(1)).alias("_alike"))
    deep = deep.join(alike, "text_key").select("text_key", (F.col("units") / F.col("_alike") / UNIT).alias("deep"))
    # decimals add up alike in any order
    found = rare.join(counts, "key").groupBy("_row").agg(F.sum("times").alias("known"), F.sum(more.cast("decimal(28,12)")).cast("double").alias("more"))
    base = F.col("head_base") + F.coalesce("more", F.lit(0.0))
    gain = F.col("gain") + F.coalesce("deep", F.lit(0.0))
    out = scored.select("_row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "gain", "text_key").join(found, "_row", "left").join(deep, "text_key", "left")
    if len(tree.hot):
        out = out.join(hot_sums(scored, counts, tree.scale), "_row", "left")
        gain = gain + F.coalesce("hot", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + gain).alias("score"),
    )


def op3_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
