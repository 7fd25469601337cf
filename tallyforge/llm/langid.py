"""Language identification: a linear-chain conditional random field labels every word, by forward-backward.

Emission features of a word, hashed into 2**FEATURE_BITS weights for each language: affixes of one to four bytes, inner n-grams of two
and three bytes, and the whole word (its lexicon entry). Transitions between neighbouring words' languages are learned with them, by
AdaGrad on the conditional log-likelihood of a bounded sample of labelled texts. A text's language is the one with the largest mean
posterior over its words, and that mean is the score.

Labels are of whole texts, so a training text alone would only teach that a language never changes. Every third batch of the sample is
therefore spliced: its texts are cut into stretches of SPLICE words on average, dealt anew, so that languages change within a sequence
and the transitions learn both to stay and to move, as code-switched text asks for.

Forward-backward runs on all words of many texts at once: texts are cut into blocks of BLOCK words, each block's product of transfer
matrices is formed side by side, a pass over blocks joins them, and a second pass inside the blocks gives every word's posterior. That
is exact for texts of any length.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without lang are predicted like others and teach
nothing; without any labelled rows every text is `und`; repeated rows get equal predictions; an empty table gives no rows. lang and
doc_id are read for training alone; other columns are kept by `keep` and not read by `predict`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import runtime
from tallyforge.llm.text import ALNUM, Words, mix, ragged, slices

#: The sample: SAMPLE texts of at most SAMPLE_BYTES, shared equally by the languages. Passes over it, and the step.
SAMPLE, SAMPLE_BYTES, EPOCHS, STEP = 1200, 1 << 14, 2, 0.3
#: Every so many batches one is spliced; words of its stretches on average.
SPLICED, SPLICE = 3, 12
FEATURE_BITS, BLOCK = 18, 32
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTERS = ALNUM.copy()
_LETTERS[48:58] = False


def _feature(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code.astype(np.uint64) + np.uint64(kind << 40)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


class Distinct:
    """The distinct words of a slice and their features: three arrays of fixed-place features, and ragged inner ones."""

    def __init__(self, words: Words):
        keys, first, self.back = np.unique(words.hashes, return_index=True, return_inverse=True)
        s, e = words.starts[first], words.ends[first]
        size = e - s
        low = _LOWER[words.data]
        low = np.concatenate([low, np.zeros(4, np.uint32)])
        grams = [low[:-3]]
        for n in range(1, 4):
            grams.append(grams[-1] | low[n : len(low) - 3 + n] << np.uint32(8 * n))
        self.n = len(keys)
        self.fixed = [(np.flatnonzero(size >= 0), _feature(keys, 0))]
        for n in range(1, 5):
            ok = np.flatnonzero(size >= n)
            self.fixed.append((ok, _feature(grams[n - 1][s[ok]], n)))
            self.fixed.append((ok, _feature(grams[n - 1][e[ok] - n], 8 + n)))
        self.inner = []
        for n in (2, 3):
            ok = np.flatnonzero(size >= n)
            count = size[ok] - n + 1
            self.inner.append((ok, count, _feature(grams[n - 1][ragged(s[ok], count)], 16 + n)))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), weights.dtype)
        for ok, f in self.fixed:
            out[ok] += weights[f]
        for ok, count, f in self.inner:
            if len(ok):
                out[ok] += np.add.reduceat(weights[f], np.cumsum(count) - count, axis=0)
        return out

    def spread(self, gradient: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """The gradient of the weights from that of the scores."""
        every = [*self.fixed, *((np.repeat(ok, count), f) for ok, count, f in self.inner)]
        rows, feature = (np.concatenate(x) for x in zip(*every, strict=True))
        return np.stack([np.bincount(feature, gradient[rows, k], shape[0]) for k in range(shape[1])], axis=1)


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, moves: bool = False):
    """Each word's distribution over labels. emission, transition: log scores; first[i]: words before text i.

    moves: also the expected number of moves between each two labels, over all neighbouring words.
    """
    n, k = emission.shape
    if not n:
        return (emission, np.zeros((k, k))) if moves else emission
    step = np.exp(transition - transition.max())
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    head = np.cumsum(blocks) - blocks  # of each text, its first block
    total = int(blocks.sum())
    of = np.repeat(np.arange(len(size)), blocks)
    begin = first[:-1][of] + (np.arange(total) - head[of]) * BLOCK
    length = np.minimum(BLOCK, first[1:][of] - begin)
    grid = begin[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < length[:, None]
    x = np.where(real[:, :, None], e[np.minimum(grid, n - 1)], 1.0)
    starts = np.zeros(total, bool)
    starts[head[blocks > 0]] = True

    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        move = product @ step
        if t == 0:
            move[starts] = np.eye(k)  # nothing comes before a text's first word
        move *= x[:, t, None, :]
        move /= move.max(axis=(1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], move, product)

    into, out = np.ones((total, k)), np.ones((total, k))  # forward before each block's first word, backward after its last
    order = np.argsort(-blocks, kind="stable")
    for b in range(1, int(blocks.max(initial=0))):
        at = head[order[: np.searchsorted(-blocks[order], -b)]] + b
        v = np.einsum("di,dij->dj", into[at - 1], product[at - 1])
        into[at] = v / v.max(axis=1, keepdims=True)
    last = head + blocks - 1
    for b in range(1, int(blocks.max(initial=0))):
        at = last[order[: np.searchsorted(-blocks[order], -b)]] - b
        v = np.einsum("dij,dj->di", product[at + 1], out[at + 1])
        out[at] = v / v.max(axis=1, keepdims=True)

    forward = np.empty((total, BLOCK, k))
    a = into
    for t in range(BLOCK):
        a = np.where(starts[:, None], a, a @ step) if t == 0 else a @ step
        a = a * x[:, t]
        a /= a.max(axis=1, keepdims=True)
        forward[:, t] = a
    backward = np.empty((total, BLOCK, k))
    b = out
    for t in range(BLOCK - 1, -1, -1):
        backward[:, t] = b
        moved = (x[:, t] * b) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        b = np.where(real[:, t, None], moved, b)
    forward, backward = forward[real], backward[real]
    got = forward * backward
    got /= got.sum(axis=1, keepdims=True)
    if not moves:
        return got
    inner = np.ones(n, bool)
    inner[first[:-1][size > 0]] = False  # words with one before them in their text
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] * step * (e[at] * backward[at])[:, None, :]
    return got, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Model:
    """Learned labels, feature weights and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.weights, self.transition = labels, weights, transition

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of some texts, and each one's distribution over self.labels."""
        words = Words(data, offs, _LETTERS, lower=True)
        if not len(words):
            return words, np.zeros((0, len(self.labels)))
        distinct = Distinct(words)
        return words, posteriors(distinct.scores(self.weights).astype(np.float64)[distinct.back], words.first, self.transition)


def spliced(first: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts in another order, and the new texts' borders: stretches of SPLICE words on average, dealt into as many sequences."""
    n = int(first[-1])
    edge = rng.random(n) < 1 / SPLICE
    edge[first[:-1][np.diff(first) > 0]] = True
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, n))
    by = rng.permutation(len(start))
    order = ragged(start[by], size[by])
    ends = np.cumsum(size[by])
    some = ends[np.linspace(0, len(ends) - 1, len(first)).astype(int)[1:]] if len(ends) else np.zeros(0, np.int64)
    return order, np.unique(np.concatenate([[0], some, [n]]))


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, batch: int = 24) -> Model:
    labels = sorted(set(langs))
    k, index = len(labels), {x: i for i, x in enumerate(labels)}
    weights, seen = np.zeros((1 << FEATURE_BITS, k)), np.full((1 << FEATURE_BITS, k), 1e-6)
    transition, seen_t = np.zeros((k, k)), np.full((k, k), 1e-6)
    parts, rng = [], np.random.default_rng(7)
    order = rng.permutation(len(texts)).tolist()
    for a in range(0, len(order), batch):
        rows = order[a : a + batch]
        for lo, hi, data, offs in slices(pa.array([texts[i] for i in rows], pa.string())):
            words = Words(data, offs, _LETTERS, lower=True)
            if len(words):
                distinct, gold = Distinct(words), np.repeat([index[langs[i]] for i in rows[lo:hi]], np.diff(words.first))
                back, first = distinct.back, words.first
                if len(parts) % SPLICED == SPLICED - 1:
                    places, first = spliced(first, rng)
                    back, gold = back[places], gold[places]
                parts.append((distinct, back, first, gold))
    for _ in range(epochs if k > 1 else 0):
        for distinct, back, first, gold in parts:
            emission = distinct.scores(weights)[back]
            p, moves = posteriors(emission, first, transition, moves=True)
            rest = -p
            rest[np.arange(len(gold)), gold] += 1
            # Words of one text stand or fall together, so a step is over the batch's texts, not its words.
            by_word = np.stack([np.bincount(back, rest[:, j], distinct.n) for j in range(k)], axis=1) / len(first)
            gradient = distinct.spread(by_word, weights.shape)
            touched = np.flatnonzero(gradient.any(axis=1))
            seen[touched] += gradient[touched] ** 2
            weights[touched] += STEP * gradient[touched] / np.sqrt(seen[touched])
            inner = np.ones(len(gold), bool)
            inner[first[:-1][np.diff(first) > 0]] = False
            at = np.flatnonzero(inner)
            made = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
            g = (made - moves) / max(1, len(at)) - 1e-3 * transition
            seen_t += g**2
            transition += STEP * g / np.sqrt(seen_t)
    return Model(labels, weights.astype(np.float32), transition)


def train(docs: DataFrame, teaches: Column | None = None) -> Model | None:
    """A model from rows of doc_id, text, lang that satisfy `teaches` and have a lang. None without such rows.

    The sample is bounded: SAMPLE texts in all, chosen by a hash of doc_id and equally for each language. Of a text of over SAMPLE_BYTES it
    has a stretch of whole words, at a place chosen by a hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull())
    if teaches is not None:
        rows = rows.filter(teaches)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, SAMPLE // len(counts))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    odds = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * each / n)))), F.col("lang"))
    chars = SAMPLE_BYTES // 4  # of four bytes at most
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    cut = F.substring("text", place, F.lit(chars))
    whole = F.nullif(F.regexp_extract(cut, r"(?s)^\S*\s+(.*)\s", 1), F.lit(""))
    part = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.coalesce(whole, cut))
    some = rows.filter(F.col("text").isNotNull() & (share < odds)).withColumn("text", part)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    got = some.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).select("text", "lang").orderBy("lang", "text").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (mean posterior) and n_words for each row of doc_id, text."""
    runtime.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, n_words long"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS weights for each language, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                lang, score, n_words = _judge(sent.value, batch.column(1).slice(lo, hi - lo), data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lang, score, n_words], names=["doc_id", "lang_pred", "score", "n_words"])

    return rows.mapInArrow(run, schema)


def _judge(model: Model | None, texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    n = len(offs) - 1
    if model is None:
        return pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))
    words, p = model.words(data, offs)
    size = np.diff(words.first)
    mean = np.zeros((n, len(model.labels)))
    some = np.flatnonzero(size)
    if len(some):
        mean[some] = np.add.reduceat(p, words.first[:-1][some], axis=0) / size[some, None]
    best = mean.argmax(axis=1)
    has = (size > 0) & pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    lang = np.where(has, np.array(model.labels, dtype=object)[best], UNKNOWN)
    return pa.array(lang, pa.string()), pa.array(np.where(has, np.minimum(mean.max(axis=1), 1.0), 0.0)), pa.array(size)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and runs: array of (start, end, lang, words, p), stretches of neighbouring words with the same best label; start and end in UTF-8 bytes."""
    runtime.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("p", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                words, p = sent.value.words(data, offs)
                best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
                out = []
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    cuts = [a, *(a + 1 + np.flatnonzero(best[a + 1 : b] != best[a : b - 1])).tolist(), b] if b > a else []
                    out.append([{"start": int(words.starts[x] - offs[i]), "end": int(words.ends[y - 1] - offs[i]), "lang": sent.value.labels[best[x]], "words": y - x, "p": float(p[x:y, best[x]].mean())} for x, y in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.list_(item))], names=["doc_id", "runs"])

    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,end:long,lang:string,words:long,p:double>>")


def keep(docs: DataFrame, model: Model | None, least: float = 0.0, fill: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told: not `und`, and with a score of `least` or more. Where the column `fill` is null it takes the language found."""
    spark = runtime.prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at, into = docs.columns.index("text"), None if fill is None or model is None else docs.columns.index(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(at)):
                lang, score, _ = _judge(sent.value, batch.column(at).slice(lo, hi - lo), data, offs)
                some = batch.slice(lo, hi - lo)
                if into is not None:
                    columns = list(some.columns)
                    columns[into] = pc.coalesce(columns[into], lang.cast(columns[into].type))
                    some = pa.RecordBatch.from_arrays(columns, schema=some.schema)
                yield some.filter(pc.and_(pc.not_equal(lang, UNKNOWN), pc.greater_equal(score, least)))

    return docs.mapInArrow(run, docs.schema)
