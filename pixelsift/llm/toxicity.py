"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is embedded as the mean of the vectors of its byte n-grams (hashed into buckets), so a misspelling
that was never seen shares most of its vectors with the words it resembles. The embeddings of a window of
consecutive words are averaged, each distinct word once and padding as zero, and go through a linear softmax of two classes. A document's score is that
of its most toxic window, so a long text with one insult isn't averaged away.

Training: on windows, in numpy, embeddings and softmax together (AdaGrad). The labelled rows are a bounded
sample: of each label at most :data:`PER_CLASS` rows and :data:`FIT_BYTES` bytes of text, those with the smallest
hash of their id; a row is taken whole or not at all. Every pass uses every window of every sampled clean row. The
first passes use every window of every toxic row too, which then all count as toxic; in the later ones each toxic
row stands with its currently most toxic window, as documents are scored. Either label weighs the same in total
(clean ones double in the first passes), so nothing is left out to balance them. The 0.5 mark is set where the
sample's labels are told apart best, over whole texts. Everything else covers all rows and whole texts: after
training a word is one number, so scoring is a table look-up per word and a running mean, without any shuffle.

Defined results: null, empty and blank texts score 0; texts of any length are scored over all their windows;
repeated rows score alike; labels that are null are ignored, of several labels of an id the larger counts, of
several texts of an id the smallest is learned from; without labels of both kinds all scores are 0; ids may be of
any type, a null id is never held out; an empty table gives an empty table; other columns are ignored by
:func:`score` (those in ``carry`` go along, unless named like a column of the result) and carried by :func:`clean`.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsift.llm._store import keep
from pixelsift.llm._text import mix, settled

#: Labelled rows of each class that the classifier is fitted on, and bytes of their texts, at most.
PER_CLASS = {0: 5000, 1: 1500}
FIT_BYTES = {0: 32 << 20, 1: 16 << 20}
WINDOW, STRIDE = 32, 16
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
#: Passes over all windows of the sample, of which the first take all windows of toxic rows and the others their top
#: one; few windows get more passes, at most MOST_PASSES, until there are STEPS updates. Windows in an update.
WARM, PASSES, MOST_PASSES, STEPS, BATCH, RATE = 0.6, 8, 40, 2500, (64, 512), 0.25
#: Words whose number a worker remembers, and texts scored together.
REMEMBERED, TOGETHER = 500_000, 64

_STRIP = b".,;:!?\"'()[]"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, one word after the other, and how many each has."""
    marked = [b"<" + (w.strip(_STRIP) or w) + b">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    end = np.repeat(start + size, size)
    hashes, owners = [], []
    for n in GRAMS:
        if len(b) >= n:
            at = np.flatnonzero(np.arange(len(b)) + n <= end)
            h = np.full(len(at), n, np.uint64)
            for i in range(n):
                h = (h ^ b[at + i]) * np.uint64(0x100000001B3)
            hashes.append(h)
            owners.append(word[at])
    place = np.arange(len(b), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)
    hashes.append(np.add.reduceat(mix(b * np.uint64(0x9E3779B97F4A7C15) + place), start))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    flat = ((np.concatenate(hashes)[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)  # the upper 16 bits: BUCKETS of them
    return flat, np.bincount(owner, minlength=len(words))


def window_starts(n: int) -> list[int]:
    """Windows of :data:`WINDOW` words, :data:`STRIDE` apart, that cover all n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Model:
    """Bucket vectors, the softmax's weights, and the shift that puts the mark at 0.5."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        #: What each bucket adds to the log-odds: its vector times the softmax's difference of classes.
        self.weights, self.bias = weights, bias
        self._known: dict[bytes, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def _learn(self, words: set[bytes]) -> None:
        if len(self._known) + len(words) > REMEMBERED:
            self._known.clear()
        new = [w for w in words if w not in self._known]
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            flat, n = grams(part)
            at = np.cumsum(n) - n
            self._known.update(zip(part, (np.add.reduceat(self.weights[flat].astype(np.float64), at) / n).tolist(), strict=True))

    def score(self, texts: list[bytes | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        out = []
        for lo in range(0, len(texts), TOGETHER):
            cut = [t.lower().split() if t else [] for t in texts[lo : lo + TOGETHER]]
            self._learn(set().union(*cut))
            out += [self._odds(words) for words in cut]
        return (1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))).tolist()

    def _odds(self, words: list[bytes]) -> float:
        if not words:
            return -np.inf
        value = np.fromiter(map(self._known.__getitem__, words), np.float64, len(words))
        # a word counts once in a window: where it doesn't occur between the window's start and itself
        before = earlier(value)
        starts = np.array(window_starts(len(words)))
        most = -np.inf
        for lo in range(0, len(starts), 1 << 14):
            at = starts[lo : lo + (1 << 14), None]
            place = at + np.arange(min(WINDOW, len(words)))
            most = max(most, np.where(before[place] < at, value[place], 0).sum(1).max())
        return self.bias + most / WINDOW


def earlier(values: np.ndarray) -> np.ndarray:
    """Where each value occurred last before its place, or -1."""
    order = np.argsort(values, kind="stable")
    before = np.full(len(values), -1, np.int32)
    same = values[order[1:]] == values[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def fit(examples: list[tuple[int, bytes | None]], seed: int = 1) -> Model:
    """Train on (label, text)."""
    labels = np.array([y for y, _ in examples], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    ids, before, starts, owners = array("i"), array("i"), array("i"), array("i")  # words once, windows as their starts: the driver's memory is small
    for doc, (_, text) in enumerate(examples):
        words = text.lower().split() if text else []
        if words:
            own, at = np.array([vocab.setdefault(x, len(vocab)) for x in words], np.int32), len(ids)
            was = earlier(own)
            ids.frombytes(own.tobytes())
            before.frombytes(np.where(was >= 0, was + at, -1).astype(np.int32).tobytes())
            first = window_starts(len(words))
            starts.extend(at + s for s in first)
            owners.extend([doc] * len(first))
    if not starts:
        return Model()
    word, before, begin, owner = (np.frombuffer(x, np.int32) for x in (ids, before, starts, owners))
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))  # the last window of each text
    closed = np.append(begin[last[:-1] + 1], len(word))[np.searchsorted(last, np.arange(len(owner)))]  # where the text of each window ends
    names = list(vocab)
    del vocab
    parts = [grams(names[lo : lo + (1 << 14)]) for lo in range(0, len(names), 1 << 14)]
    flat, start = np.concatenate([f for f, _ in parts]), np.concatenate([[0], *[n for _, n in parts]]).cumsum()
    del parts, names
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    acc_e, acc_s, acc_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    toxic_win = np.flatnonzero(labels[owner] == 1)
    clean_win = np.flatnonzero(labels[owner] == 0)

    def words_in(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of windows, and which of them count: those in the text, each distinct word once."""
        at = begin[windows, None]
        place = at + np.arange(WINDOW)
        inside = place < closed[windows, None]
        place = np.minimum(place, len(word) - 1)
        return place, inside & (before[place] < at)

    def words_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = start[ids + 1] - start[ids]
        where = np.repeat(start[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return flat[where], n, np.concatenate([[0], np.cumsum(n)[:-1]])

    def odds_of_words() -> np.ndarray:
        value = emb @ (soft[:, 1] - soft[:, 0])
        return np.add.reduceat(value[flat], start[:-1]) / np.diff(start)

    def odds_of_windows() -> np.ndarray:
        value, out = odds_of_words(), np.empty(len(begin))
        for lo in range(0, len(begin), 1 << 14):
            place, mask = words_in(np.arange(lo, min(lo + (1 << 14), len(begin))))
            out[lo : lo + (1 << 14)] = np.where(mask, value[word[place]], 0).sum(1)
        return out / WINDOW + bias[1] - bias[0]

    def step(batch: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        nonlocal soft, bias
        place, mask = words_in(batch)
        ids, inverse = np.unique(word[place][mask], return_inverse=True)
        g, n, at = words_of(ids)
        vec = np.add.reduceat(emb[g], at, axis=0) / n[:, None]
        row = np.repeat(np.arange(len(batch)), mask.sum(1))
        share = 1 / WINDOW
        hidden = np.stack([np.bincount(row, vec[inverse, k] * share, len(batch)) for k in range(DIM)], 1).astype(np.float32)
        z = hidden @ soft + bias
        prob = np.exp(z - z.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(batch)), y] -= 1
        prob *= (weight / weight.sum())[:, None].astype(np.float32)
        d_hidden = prob @ soft.T
        ds, db = hidden.T @ prob, prob.sum(0)
        acc_s[...] += ds**2
        acc_b[...] += db**2
        soft = soft - RATE * ds / np.sqrt(acc_s)
        bias = bias - RATE * db / np.sqrt(acc_b)
        dw = np.stack([np.bincount(inverse, d_hidden[row, k] * share, len(ids)) for k in range(DIM)], 1) / n[:, None]
        of_word = np.repeat(np.arange(len(ids)), n)
        de = np.stack([np.bincount(g, dw[of_word, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
        acc_e[...] += (de**2).mean(1)
        emb[...] -= RATE * de / np.sqrt(acc_e)[:, None]

    def top_windows() -> np.ndarray:
        odds = odds_of_windows()[toxic_win]
        order = np.lexsort((-odds, owner[toxic_win]))
        docs = owner[toxic_win][order]
        return toxic_win[order[np.r_[True, docs[1:] != docs[:-1]]]]

    size = int(np.clip(len(begin) // 200, *BATCH))
    rounds = min(MOST_PASSES, max(PASSES, -(-STEPS * size // len(begin))))
    for turn in range(rounds):
        warm = turn < rounds * WARM
        pos = toxic_win if warm else top_windows()
        weigh = np.array([1.0, len(clean_win) / len(pos) / (2 if warm else 1)])
        every = rng.permutation(np.concatenate([pos, clean_win]))
        for lo in range(0, len(every), size):
            batch = every[lo : lo + size]
            y = labels[owner[batch]]
            step(batch, y, weigh[y])
    most = np.full(len(labels), -np.inf)
    np.maximum.at(most, owner, odds_of_windows())
    seen = np.isfinite(most)
    order = np.argsort(-most[seen], kind="stable")
    y, value = labels[seen][order], most[seen][order]
    # the clean rows of the sample stand for all clean rows, which are more
    right = np.cumsum(y) / max(1, y.sum()) - 4 * np.cumsum(1 - y) / max(1, (1 - y).sum())
    ends = np.flatnonzero(right >= right.max() - 1e-12)
    lo, hi = ends[0], min(ends[-1] + 1, len(value) - 1)
    mark = 0.3 * value[lo] + 0.7 * value[hi]  # toxic rows that weren't seen score lower than those of the sample
    mark = max(mark, float(bias[1] - bias[0]) + 1)  # few words, which say nothing, aren't toxic
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0] - mark))


def _sampled(usable: DataFrame, most: int) -> list:
    """The ``most`` rows of (_id, _y) with the smallest hash of their id, by way of a histogram of the hashes."""
    hashed = usable.withColumn("_h", F.xxhash64("_id")).withColumn("_b", F.shiftrightunsigned("_h", 52))
    cut, n = 0, 0
    for r in hashed.groupBy("_b").count().orderBy("_b").collect():  # at most 4096 rows
        cut, n = r._b, n + r["count"]
        if n >= most:
            break
    return sorted(hashed.where(F.col("_b") <= cut).collect(), key=lambda r: (r._b, r._h, str(r._id)))[:most]  # most, and the rest of a 4096th


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(id as text) mod 5 isn't ``held_out``."""
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != held_out))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    )
    chosen = [r for y in (0, 1) for r in _sampled(usable.where(F.col("_y") == y), PER_CLASS[y])]
    if len({r._y for r in chosen}) < 2:
        return Model()
    kind = T.StructType([usable.schema["_id"], T.StructField("_y", T.IntegerType()), T.StructField("_n", T.IntegerType())])
    few = F.broadcast(docs.sparkSession.createDataFrame([(r._id, r._y, n) for n, r in enumerate(chosen)], kind))  # at most sum(PER_CLASS) rows

    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    picked = keep(texts.join(few, F.col("_doc") == F.col("_id")).groupBy("_n", "_y").agg(F.min("_text").alias("_text")), "sample")
    left, taken = dict(FIT_BYTES), []
    for r in picked.select("_n", "_y", F.octet_length("_text").alias("b")).orderBy("_n").collect():
        if r.b <= left[r._y]:  # a text that doesn't fit is passed over whole
            left[r._y] -= r.b
            taken.append(r._n)
    rows = sorted((r._n, r._y, bytes(r._text)) for r in picked.where(F.col("_n").isin(taken)).collect()) if taken else []
    return fit([(y, text) for _, y, text in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: the id (or the columns in ``carry``), held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    made: dict = {}

    def run(batches):
        own = made.get("model")
        if own is None:
            own = made["model"] = Model(*shared.value)
        for batch in batches:
            scores = pa.array(own.score(batch.column(2).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["row", "held_out", "score"])

    carried = [c for c in ([id_col] if carry is None else carry) if c not in ("held_out", "score", "predicted")]
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
    # the carried columns travel as one struct, so their names can't meet others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    scored = rows.mapInArrow(settled(run), T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in carried], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)
    made: dict = {}

    def run(batches):
        own = made.get("model")
        if own is None:
            own = made["model"] = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([x < 0.5 for x in own.score(batch.column(at).cast(pa.binary()).to_pylist())], pa.bool_()))

    return docs.mapInArrow(settled(run), docs.schema)
