"""Operator 1: language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language.  A text is cut greedily into
phrases, each the longest string that occurs in the language's text (Ziv-Merhav cross-parsing), and
the language that needs the fewest phrases, normalised by the size of its text, wins.

Texts are parsed whole.  Many blocks of ``BLOCK`` bytes advance together, one byte at a time, through a dense transition
table, each as if a text began with it; then each is parsed again from the state in which the block before it ended, up
to the byte where both parses agree, which is soon, and so on until no block ends in another state.  Memory is bounded by
``train_bytes`` for each of 64 languages; more languages share that.

Defined cases: null, empty or letterless text is ``und`` with score 0; with no labelled text at all
every text is ``und``; very long texts are parsed whole like any other; equal phrase counts go to the first language by name; a repeated row is
predicted like any other; an empty table gives an empty result; columns named ``lang_pred`` or
``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import free_name, table, with_arrays
from .textbuf import LOWER, runs

BLOCK = 512
TRAIN_BYTES = 24_000
#: Texts up to so many characters are drawn, whole; longer ones only for a language that has no other.
TRAIN_CHARS = 3_000
TRAIN_DOCS = 64
USUAL_LANGUAGES = 64
MAX_LANGUAGES = 4_096
#: How far the second language must lie behind, and over how many characters, for a label to be held wrong.
CLEAR = 0.5
CLEAR_CHARS = 200
_FLAG = np.int32(1 << 30)


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    width: int  # symbols, the last of which is padding
    tables: list[np.ndarray]  # per language, state * width + symbol -> next state * width, with a flag
    cost: list[float]  # per language, what a phrase costs


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in goto[p]:
            goto[p][s] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(s) == q:
                    goto[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return goto


def _plain(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other bytes of letters as they are, the rest as a space."""
    out = LOWER[raw]
    out[(out < 97) | ((out > 122) & (out < 128))] = 32
    return out


def build(samples: dict[str, str]) -> Model:
    """The model of one training text for each language."""
    languages = sorted(samples)
    plain = [_plain(np.frombuffer(samples[x].encode(), np.uint8)) for x in languages]
    seen = np.unique(np.concatenate([*plain, np.array([32], np.uint8)]))
    symbol = np.full(256, len(seen), np.uint8)  # a byte that no language has
    symbol[seen] = np.arange(len(seen))
    symbol = symbol[_plain(np.arange(256, dtype=np.uint8))]
    width = len(seen) + 2
    tables = []
    for text in plain:
        goto = suffix_automaton(symbol[text].tolist())
        lone = len(goto)  # the state after a symbol that the language lacks: it is a phrase by itself
        dense = np.full((lone + 1, width), _FLAG | (lone * width), np.int32)
        for s, to in goto[0].items():
            dense[:, s] = _FLAG | (to * width)  # no transition: a phrase ends, and the next begins with this symbol
        for state, moves in enumerate(goto):
            if moves:
                dense[state, list(moves)] = np.fromiter(moves.values(), np.int32, len(moves)) * width
        dense[:, width - 1] = np.arange(lone + 1, dtype=np.int32) * width
        tables.append(dense.ravel())
    return Model(languages, symbol, width, tables, [float(np.log2(max(len(t), 2))) for t in plain])


def phrases(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cost of each document (rows) in each language (columns)."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.full(first[-1] * BLOCK, model.width - 1, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = model.symbol[raw]
    steps = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    starts = first[:-1][sizes > 0]
    later = np.setdiff1d(np.arange(first[-1]), starts)  # blocks that go on with a text
    goes_on = np.zeros(first[-1] + 1, bool)
    goes_on[later] = True
    out = np.empty((len(sizes), len(model.tables)))
    trace = np.empty(steps.shape, np.int32)
    for k, dense in enumerate(model.tables):
        ended = np.zeros(first[-1], np.int32)
        state = np.zeros(first[-1], np.int32)
        for i, column in enumerate(steps):
            np.add(state, column, out=state)
            np.take(dense, state, out=trace[i], mode="clip")
            ended += trace[i] >> 30
            np.bitwise_and(trace[i], _FLAG - 1, out=state)
        ended[starts] += 1 - (trace[0, starts] >> 30)  # a text's first phrase ends none
        again = later
        while len(again):
            state = trace[BLOCK - 1, again - 1] & (_FLAG - 1)
            for i in range(BLOCK):
                now = dense[state + steps[i, again]]
                before = trace[i, again]
                ended[again] += (now >> 30) - (before >> 30)
                trace[i, again] = now
                state = now & (_FLAG - 1)
                apart = state != before & (_FLAG - 1)
                again, state = again[apart], state[apart]
                if not len(again):
                    break
            again = again[goes_on[again + 1]] + 1  # these ended in another state than they did
        total = np.concatenate([[0], np.cumsum(ended)])
        out[:, k] = (total[first[1:]] - total[first[:-1]]) * model.cost[k]
    return out


def training_texts(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, str]:
    """A bounded sample of labelled texts: of each language up to ``train_docs``, and ``train_bytes`` characters.

    The ``max_languages`` most frequent labels are learned.  Which rows are drawn depends on a hash
    of key and text only.
    """
    fits = F.char_length(F.col(text)) <= TRAIN_CHARS
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("all"), F.count_if(fits).alias("fit")).orderBy(F.desc("all"), "lang").limit(max_languages).collect()
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string"), text), F.lit(1 << 30))
    rate = None
    for row in counts:
        most = F.when(fits if row["fit"] else F.lit(True), F.lit(int(min(1.0, 2 * train_docs / (row["fit"] or row["all"])) * (1 << 30))))
        rate = F.when(F.col(lang) == row["lang"], most) if rate is None else rate.when(F.col(lang) == row["lang"], most)
    if rate is None:
        return {}
    share = max(train_bytes * USUAL_LANGUAGES // max(len(counts), USUAL_LANGUAGES), 256)
    drawn = labelled.withColumn("_draw", draw).filter(F.col("_draw") < rate).select(F.col(lang).alias("lang"), F.substring(text, 1, train_bytes).alias("text"), "_draw").orderBy("_draw", "text").limit(4 * train_docs * len(counts)).collect()
    samples: dict[str, str] = {}
    taken: dict[str, int] = {}
    texts: set[str] = set()
    for row in drawn:
        have = samples.get(row["lang"], "")
        if row["text"] not in texts and taken.get(row["lang"], 0) < train_docs and len(have) < share:
            texts.add(row["text"])
            samples[row["lang"]] = (have + " " + row["text"])[:share]
            taken[row["lang"]] = taken.get(row["lang"], 0) + 1
    return samples


def learn(docs: DataFrame, **how) -> Model:
    return build(training_texts(docs, **how))


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", by: str = "score") -> DataFrame:
    """``docs`` plus ``pred`` and ``by``, how far the second language lies behind (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array, letters: pa.Array):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, n, raw, offsets in runs(texts):
            if not m.languages:
                best.append(np.zeros(n, np.int64))
                score.append(np.zeros(n))
                continue
            cost = phrases(m, raw, offsets)
            order = np.sort(cost, axis=1)
            best.append(np.argmin(cost, axis=1))
            second = order[:, min(1, order.shape[1] - 1)]
            score.append(np.where(second > 0, 1 - order[:, 0] / np.maximum(second, 1e-9), 0.0) if order.shape[1] > 1 else np.ones(n))
        b, s = np.concatenate(best), np.concatenate(score)
        known = letters.fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
        return pa.array(names[np.where(known, b, len(m.languages))], pa.string()), pa.array(np.where(known, s, 0.0))

    marked = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return with_arrays(marked, compute, f"{pred} string, {by} double", [text, "_letters"]).drop("_letters")


def identified(docs: DataFrame, clear: float = CLEAR, least: int = CLEAR_CHARS) -> DataFrame:
    """The documents whose language is told, without those whose label a clear prediction contradicts.

    Documents without letters go.  A prediction is clear if the second language lies ``clear`` behind or more, over a text of
    ``least`` characters: texts in two languages, short ones and ties stay as they are.  Where ``lang`` is null it becomes the
    language that was told, if no other ties with it.  Where no language could be learned nothing is told, and all stay.
    """
    model = learn(docs)
    if not model.languages:
        return docs
    pred, by = free_name(docs, "lang_pred"), free_name(docs, "score")
    told = identify(docs, model, pred=pred, by=by)
    against = F.col("lang").isin(model.languages) & (F.col("lang") != F.col(pred)) & (F.col(by) >= clear) & (F.char_length("text") >= least)
    kept = told.filter((F.col(pred) != "und") & ~F.coalesce(against, F.lit(False)))
    return kept.withColumn("lang", F.coalesce("lang", F.when(F.col(by) > 0, F.col(pred)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(key: str = "doc_id", mod: int = 5, rest: int = 0):
    """Whether the crc32 of the key as text leaves this remainder; a null key counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
