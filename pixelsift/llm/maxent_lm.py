"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

log P(word | history) = log P(class | history) + log P(leaf | class, history) + log P(word | leaf). All of the first
two is log-linear in hashed features of the history. The classes share one softmax, over the last words, word pairs,
skips and pairs of classes. Inside a class, the words are the leaves of a binary tree, by the bits of their hashes,
and each step down is a softmax of two: the counts below either branch, plus learned weights for (node, last word),
(node, last two words) and (node, word before the last). So word n-grams decide between any two words of a class
that don't share a leaf. The few words of a leaf have their smoothed share of its training tokens; every leaf keeps
half a count for words it never saw, so all words have a probability, and all of them sum to one.

Every word goes into the features by its own hash. What is learned grows with the input: rows of class weights with
the number of distinct words, levels of the trees too, cells of tree weights with the number of training tokens, up to
:data:`MOST` (what a worker holds in memory); all counts are exact at any size.

Steps, each over all training documents and all their tokens:

1. Counts of words, and of word-ending types by preceding type: counted in numpy per task, then
   aggregated by Spark. The endings are clustered into classes by what precedes them (a table of fixed size).
2. Distributed gradient updates: in each of :data:`ROUNDS` rounds every task starts from the shared
   weights, makes sparse AdaGrad updates on its share of the texts (each is used, whole, in one round), and
   sends back its changes, which are averaged by use (class weights) or by their summed squared gradients (tree
   weights), in packed chunks that are summed in a stream.
3. Scoring in sparse numpy batches. The counts of the most frequent words come from a table of bounded size
   (:data:`KNOWN` words); all other tokens find theirs in a join with the whole count table, so counts are
   exact and nothing that grows with the corpus is broadcast or collected.

Defined results: null and empty texts are one end token; texts of any length are scored whole; null ids are never
held out; rows with equal ids or texts are scored each by itself; without training tokens all counts are 0; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsift.llm._store import keep
from pixelsift.llm._text import bounds, mix, normalise, spans

#: Classes (the last is that of the end token), ending types, coarse types that precede.
CLASSES, TYPES, COARSE = 32, 2048, 64
#: Features of a token for its class, and for each step down the tree of its class.
FEATURES, TREE_FEATURES = 8, 3
#: Rounds of updates, tokens in an update, step sizes of either table.
ROUNDS, BATCH, RATE, TREE_RATE = 2, 2048, 0.3, 0.15


class Shape(NamedTuple):
    """Sizes of what is learned, as powers of two: rows of class weights, levels of the trees, cells of tree weights."""

    rows: int
    levels: int
    cells: int


#: Least and most of each; rows are numbered in 16 bits.
LEAST, MOST = Shape(13, 4, 14), Shape(16, 10, 21)


def shape_for(distinct: int, n_tokens: int) -> Shape:
    """About a row for four words, a leaf for two, and a cell for a training token."""
    want = Shape(distinct.bit_length() - 2, (distinct // (2 * CLASSES)).bit_length(), n_tokens.bit_length())
    return Shape(*(min(max(x, lo), hi) for x, lo, hi in zip(want, LEAST, MOST)))


#: Words whose counts are broadcast, and slots of their table.
KNOWN, SLOTS = 1 << 17, 1 << 19
#: Bytes of text that one learner takes, at least, tokens whose trees are stepped at once, and uses of a row in an
#: update that are summed one by one.
LEARNER_BYTES, AT_ONCE, FEW = 16 << 20, 512, 24
#: Distinct words that a task counts before it sends them; chunks that the weights are sent in.
FLUSH, CHUNKS = 1_000_000, 64
#: Bytes of text that are tokenised together.
TOGETHER = 1 << 18

END = np.uint64(0x9AE16A3B2F90404F)
END_TYPE = TYPES - 1
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True


def tokens(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and ending type of each token; the last one is the end."""
    return _tokens(normalise(text))


def _tokens(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of a normalised text."""
    at = bounds(norm)
    words = np.append(spans(norm, 1, at), END)
    kinds = np.full(len(words), END_TYPE, np.int64)
    if len(norm):
        b = np.frombuffer(norm, np.uint8)
        starts, ends = at
        ends = ends - (_PUNCTUATION[b[ends - 1]] & (ends - starts > 1))
        code = np.zeros(len(ends), np.uint64)
        for k in (1, 2, 3):
            code = code * np.uint64(257) + np.where(ends - k >= starts, b[np.maximum(ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        kinds[:-1] = (mix(code) % np.uint64(TYPES - 1)).astype(np.int64)
    return words, kinds


def many(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of several texts, one after the other: hashes, ending types, and how many each text has."""
    norms = [normalise(t) for t in texts]
    words, kinds = _tokens(b" ".join(n for n in norms if n))
    n = np.array([x.count(b" ") + 1 if x else 0 for x in norms], np.int64)
    ends = np.cumsum(n)
    return np.insert(words[:-1], ends, END), np.insert(kinds[:-1], ends, END_TYPE), n + 1


def groups(texts: list[bytes | None]):
    """Texts in groups of about :data:`TOGETHER` bytes, so that numpy's cost per call is shared."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or b"")
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counter(batches):
    """Rows (word, type, n), and (cell, -1, n) for pairs of a type and the coarse type before it."""
    cells = np.zeros(TYPES * COARSE, np.int64)
    held: list = []
    size = 0

    def send():
        words, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
        coded = pa.array(words.view(np.int64)).dictionary_encode()
        which = coded.indices.to_numpy()
        kind = np.empty(len(coded.dictionary), np.int32)
        kind[which] = kinds  # equal words have equal endings
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(kind), pa.array(np.bincount(which))], names=["word", "kind", "n"])

    for batch in batches:
        for part in groups(batch.column(0).to_pylist()):
            words, kinds, _ = many(part)
            held.append((words, kinds))
            size += len(words)
            pairs = (kinds[1:] * COARSE + kinds[:-1] % COARSE)[kinds[:-1] != END_TYPE]
            cells += np.bincount(pairs, minlength=len(cells))
            if size >= 4 * FLUSH:
                yield send()
                held, size = [], 0
    if held:
        yield send()
    used = np.flatnonzero(cells)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), -1, np.int32)), pa.array(cells[used])], names=["word", "kind", "n"])


def cluster(cells: np.ndarray, rounds: int = 15) -> np.ndarray:
    """The class of each ending type: types that follow the same types belong together."""
    table = cells.reshape(TYPES, COARSE).astype(np.float64)
    weight = table.sum(1)
    share = np.sqrt((table + 0.1 * (table.sum(0) + 1) / (table.sum() + COARSE)) / (weight[:, None] + 0.1))
    share /= np.linalg.norm(share, axis=1, keepdims=True)
    k = CLASSES - 1
    centres = share[np.argsort(-weight, kind="stable")[:k]].copy()
    own = np.zeros(TYPES, np.int64)
    for _ in range(rounds):
        own = (share @ centres.T).argmax(1)
        for c in range(k):
            mine = own == c
            if weight[mine].sum() > 0:
                centres[c] = (share[mine] * weight[mine, None]).sum(0)
                centres[c] /= np.linalg.norm(centres[c])
    own[END_TYPE] = CLASSES - 1
    return own


class Words:
    """Counts of the most frequent words: one probe; a word that lost its slot counts as not listed."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        slot = (words % np.uint64(SLOTS)).astype(np.int64)
        slot, words, counts = slot[::-1], words[::-1], counts[::-1]  # the most frequent is written last
        self.keys[slot], self.counts[slot] = words, counts

    def find(self, words: np.ndarray) -> np.ndarray:
        slot = (words % np.uint64(SLOTS)).astype(np.int64)
        return np.where(self.keys[slot] == words, self.counts[slot], 0)


def _back(sizes: np.ndarray, n: int):
    """A function that gives the token k before each, in the same text."""
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(x: np.ndarray, k: int, fill) -> np.ndarray:
        out = np.roll(x, k)
        out[place < k] = fill
        return out

    return back


def features(words: np.ndarray, kinds: np.ndarray, classes: np.ndarray, shape: Shape, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each token, from what precedes it: rows of class weights, and the hashes of its tree features."""
    sizes = np.array([len(words)]) if sizes is None else sizes  # tokens of each text
    back = _back(sizes, len(words))
    w1, w2, w3 = (back(words, k, np.uint64(7)) for k in (1, 2, 3))
    c = classes[kinds].astype(np.uint64) + np.uint64(1)
    c1, c2, c3, c4, c5 = (back(c, k, np.uint64(0)) for k in (1, 2, 3, 4, 5))
    rows = np.empty((len(w1), FEATURES), np.uint16)
    rows[:, 0] = 0
    pair = lambda a, b, c=np.uint64(0): (a * np.uint64(64) + b) * np.uint64(64) + c
    two = w1 * np.uint64(3) ^ w2
    most = np.uint64((1 << shape.rows) - 1)
    for k, x in enumerate((w1, w2, w3, two, pair(c1, c2), pair(c2, c3, c1), pair(c3, c4, c5)), 1):
        rows[:, k] = (((mix(x ^ mix(np.array([k], np.uint64))) >> np.uint64(32)) * most) >> np.uint64(32)) + np.uint64(1)
    return rows, np.stack([mix(w1), mix(two + np.uint64(1)), mix(w2 + np.uint64(2))])


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The weights of each token's features summed, less the largest: classes by tokens, as numpy is fast along long rows."""
    at = rows[:, 1:].T.astype(np.intp)
    z = np.take(weights, at[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for row in at[1:]:
        z += np.take(weights, row, axis=0, out=more, mode="clip")  # all rows are inside; other modes copy once more
    z += weights[0]  # the first feature is every token's
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    return z


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities of all classes for each token."""
    z = _sums(weights, rows)
    return (z - np.log(np.exp(z).sum(0))).T


def path(words: np.ndarray, target: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The nodes from the root of each word's class to its leaf, level by level, and which branch (0, 1) is taken at each."""
    leaf = (words >> np.uint64(64 - shape.levels)).view(np.int64)
    deep = np.arange(shape.levels)[:, None]
    heap = (leaf | (1 << shape.levels)) >> (shape.levels - deep)
    bits = (leaf >> (shape.levels - 1 - deep)) & 1
    heap += target.astype(np.int64) << shape.levels
    return heap, bits


def cells(hashes: np.ndarray, nodes: np.ndarray, shape: Shape) -> np.ndarray:
    """Cells of tree weights for (feature, level, token)."""
    at = nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * 0xD1342543DE82EF95 % (1 << 64))
    at = (hashes * np.uint64(0xD1342543DE82EF95))[:, None] + at
    at >>= np.uint64(64 - shape.cells)
    return at.view(np.int64)


def _right(tree: np.ndarray, base: np.ndarray, at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Probability of the right branch at each node; never quite 0 or 1, so that every word keeps some."""
    z = np.take(base, nodes, mode="clip")
    for own in np.take(tree, at, mode="clip"):
        z += own
    np.clip(z, -15, 15, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def log_steps(tree: np.ndarray, base: np.ndarray, hashes: np.ndarray, nodes: np.ndarray, bits: np.ndarray, shape: Shape) -> np.ndarray:
    """Log-probability of each word's leaf within its class."""
    right = _right(tree, base, cells(hashes, nodes, shape), nodes)
    # a step is likelier than 1e-7, so the product of ten stays far above the least float
    return np.log(np.abs((1 - bits) - right.astype(np.float64)).prod(0))


def masses(counts: np.ndarray, distinct: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """From tokens and words in each leaf (classes by leaves): a leaf's mass, and the log-odds of the right branch at
    each node when nothing is learned."""
    leaf = counts + 0.5 * (distinct + 1)
    base = np.zeros((CLASSES, 1 << shape.levels), np.float32)
    sums = leaf
    for d in reversed(range(shape.levels)):
        both = sums.reshape(CLASSES, 1 << d, 2)
        base[:, 1 << d : 2 << d] = np.log(both[:, :, 1] / both[:, :, 0])
        sums = both.sum(2)
    return leaf.ravel(), base.ravel()


class _Learner:
    """AdaGrad on copies of the shared weights."""

    def __init__(self, start: tuple, base: np.ndarray, shape: Shape):
        # arrays that come by a broadcast have a data type object of their own, and by that numpy's ``add.at`` is 20 times slower
        self.start, self.base, self.shape = start, base.view(np.float32), shape
        self.weights, self.tree = (x.astype(np.float32) for x in start)
        self.grown, self.use = np.full(len(self.weights), 1e-6, np.float32), np.zeros(len(self.weights), np.float32)
        self.bent = np.ones(len(self.tree), np.float32)

    def update(self, words: np.ndarray, rows: np.ndarray, hashes: np.ndarray, target: np.ndarray) -> None:
        error = _sums(self.weights, rows)
        np.exp(error, out=error)
        error *= np.float32(-1 / len(target)) / error.sum(0)
        error[target, np.arange(len(target))] += np.float32(1 / len(target))
        self._step(np.zeros(1, np.int64), error.sum(1)[None], len(target))  # the first feature is every token's
        error = np.ascontiguousarray(error.T)
        flat = rows[:, 1:].ravel()
        order = np.argsort(flat, kind="stable")  # 16-bit integers: a radix sort
        flat = flat[order]
        order //= FEATURES - 1
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(first, len(flat)))
        by_use = np.argsort((len(flat) - n).astype(np.uint16), kind="stable")  # 16 bits again: at most BATCH * 7
        first, n = first[by_use], n[by_use]
        many = int(np.searchsorted(-n, -FEW))  # rows met more than FEW times come first
        step = np.take(error, order[first], axis=0)
        for k in range(1, min(FEW, int(n[0]))):
            more = int(np.searchsorted(-n, -k))
            step[many:more] += np.take(error, order[first[many:more] + k], axis=0)
        if many:
            at = np.repeat(first[:many] - (np.cumsum(n[:many]) - n[:many]), n[:many]) + np.arange(n[:many].sum())
            step[:many] = np.add.reduceat(np.take(error, order[at], axis=0), np.cumsum(n[:many]) - n[:many], axis=0)
        self._step(flat[first], step, n)
        for lo in range(0, len(words), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            nodes, bits = path(words[part], target[part], self.shape)
            at = cells(hashes[:, part], nodes, self.shape)
            miss = np.subtract(bits, _right(self.tree, self.base, at, nodes), dtype=np.float32).ravel()
            square = miss * miss
            miss *= np.float32(TREE_RATE)
            for own in at.reshape(TREE_FEATURES, -1):
                np.add.at(self.bent, own, square)
                size = np.take(self.bent, own, mode="clip")
                np.sqrt(size, out=size)
                np.add.at(self.tree, own, np.divide(miss, size, out=size))

    def _step(self, row: np.ndarray, step: np.ndarray, n) -> None:
        row = row.astype(np.intp)
        grown = np.take(self.grown, row)
        grown += np.einsum("ij,ij->i", step, step) / np.float32(CLASSES)
        self.grown[row] = grown
        step *= (np.float32(RATE) / np.sqrt(grown))[:, None]
        step += np.take(self.weights, row, axis=0, mode="clip")
        whole = np.dtype((np.void, step[0].nbytes))  # a row as one value is stored at once
        self.weights.view(whole).reshape(-1)[row] = step.view(whole).reshape(-1)
        self.use[row] += n

    def changes(self):
        """Packed chunks: rows of class weights that were used, and all cells of tree weights."""
        each = len(self.weights) // CHUNKS
        change = self.weights - self.start[0]
        for c in range(CHUNKS):
            at = np.flatnonzero(self.use[c * each : (c + 1) * each])
            if len(at):
                yield c, at.astype(np.int16), self.use[at + c * each], change[at + c * each]
        each = len(self.tree) // CHUNKS
        change, bent = self.tree - self.start[1], self.bent - 1
        for c in range(CHUNKS):
            part = slice(c * each, (c + 1) * each)
            if bent[part].any():
                yield CHUNKS + c, np.empty(0, np.int16), np.minimum(bent[part], 60_000).astype(np.float16), change[part]


def _training(docs: DataFrame, text_col: str, shared, start: tuple, turn: int, shape: Shape, learners: int) -> tuple:
    """One round of updates by so many learners; the averaged weights."""
    spark = docs.sparkSession
    begin = spark.sparkContext.broadcast(start)

    def run(batches):
        classes, base = shared.value
        own = _Learner(begin.value, base, shape)
        held: list = []
        size = seen = 0

        def learn():
            words, rows, hashes, target = (np.concatenate(x, axis=axis) for x, axis in zip(zip(*held, strict=True), (0, 0, 1, 0)))
            for lo in range(0, len(target), BATCH):
                part = slice(lo, lo + BATCH)
                own.update(words[part], rows[part], hashes[:, part], target[part])

        for batch in batches:
            for texts in groups(batch.column(0).to_pylist()):
                mine = texts[(turn - seen) % ROUNDS :: ROUNDS]
                seen += len(texts)
                if mine:
                    words, kinds, sizes = many(mine)
                    held.append((words, *features(words, kinds, classes, shape, sizes), classes[kinds]))
                    size += len(words)
                if size >= BATCH:
                    learn()
                    held, size = [], 0
        if size:
            learn()
        for c, at, use, change in own.changes():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (at, use, change.astype(np.float16))]], names=["chunk", "at", "use", "change"])

    def total(batches):
        sums: dict = {}
        for batch in batches:
            for c, at, use, change in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                change = np.frombuffer(change, np.float16).astype(np.float64)
                if c < CHUNKS:
                    each = (1 << shape.rows) // CHUNKS
                    u, d = sums.setdefault(c, (np.zeros(each), np.zeros((each, CLASSES))))
                    at, use = np.frombuffer(at, np.int16), np.frombuffer(use, np.float32).astype(np.float64)
                    u[at] += use
                    d[at] += use[:, None] * change.reshape(-1, CLASSES)
                else:
                    u, d = sums.setdefault(c, (np.zeros(len(change)), np.zeros(len(change))))
                    use = np.frombuffer(use, np.float16).astype(np.float64)
                    u += use
                    d += use * change
        for c, (u, d) in sums.items():
            mean = (d / np.maximum(u.reshape(-1, *[1] * (d.ndim - 1)), 1e-9)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["chunk", "change"])

    # learners are joined tasks, without a shuffle: each sends all it learned, whatever the size of its share
    sent = docs.select(F.col(text_col).cast("binary")).coalesce(learners).mapInArrow(run, "chunk int, at binary, use binary, change binary")
    found = sent.repartitionById(2 * CHUNKS, F.col("chunk")).mapInArrow(total, "chunk int, change binary").collect()  # 2 * CHUNKS rows, as large as the weights
    weights, tree = (x.copy() for x in start)
    for r in found:
        change = np.frombuffer(bytes(r.change), np.float32)
        if r.chunk < CHUNKS:
            each = len(weights) // CHUNKS
            weights[r.chunk * each : (r.chunk + 1) * each] += change.reshape(each, CLASSES)
        else:
            each = len(tree) // CHUNKS
            tree[(r.chunk - CHUNKS) * each : (r.chunk - CHUNKS + 1) * each] += change
    return weights, tree


class Model(NamedTuple):
    """All that scoring needs but the counts of rare words, which stay in a table."""

    known: Words
    classes: np.ndarray
    mass: np.ndarray
    base: np.ndarray
    weights: np.ndarray
    tree: np.ndarray
    shape: Shape
    n_tokens: int
    n_words: int

    def log10(self, words: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per token: the log10 probability of its leaf over the leaf's mass, to which log10(count + 0.5) is to be added."""
        target, out = self.classes[kinds], np.empty(len(words))
        rows, hashes = features(words, kinds, self.classes, self.shape, sizes)
        for lo in range(0, len(words), BATCH):
            part = slice(lo, lo + BATCH)
            t, w = target[part], words[part]
            nodes, bits = path(w, t, self.shape)
            z = _sums(self.weights, rows[part])
            out[part] = z[t, np.arange(len(t))] + log_steps(self.tree, self.base, hashes[:, part], nodes, bits, self.shape)
            out[part] -= np.log(np.exp(z, out=z).sum(0))
            out[part] -= np.log(self.mass[(t << self.shape.levels) + (w >> np.uint64(64 - self.shape.levels)).astype(np.int64)])
        return out / np.log(10)


def _frequent(words: DataFrame) -> Words:
    """The words above a count that at most :data:`KNOWN` have, by way of a histogram of the counts."""
    bins = words.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).count().orderBy(F.col("b").desc()).collect()  # at most 8 * 64 rows
    cut, n = 1 << 10, 0
    for r in bins:
        if n + r["count"] > KNOWN:
            break
        cut, n = r.b, n + r["count"]
    top = words.where(F.floor(F.log2("n") * 8) >= cut).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most KNOWN rows
    return Words(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of these documents, and the table of all their words' counts (word, n)."""
    spark = docs.sparkSession
    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(_counter, "word long, kind int, n long")
    counts = keep(counted.groupBy("word", "kind").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind >= 0")
    table = np.zeros(TYPES * COARSE, np.int64)
    for r in counts.where("kind < 0").toPandas().itertuples():  # at most TYPES * COARSE rows
        table[r.word] = r.n
    classes = cluster(table)
    whole = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = whole.n or 0, whole.v
    shape = shape_for(v_all, n_all)
    of_kind = F.element_at(F.array(*[F.lit(int(c)) for c in classes]), F.col("kind") + 1)
    leaf = F.shiftrightunsigned("word", 64 - shape.levels).cast("int")
    n_leaf, v_leaf = np.zeros((CLASSES, 1 << shape.levels)), np.zeros((CLASSES, 1 << shape.levels))
    for r in words.groupBy(of_kind.alias("c"), leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas().itertuples():  # at most CLASSES * 2 ** levels rows
        n_leaf[r.c, r.leaf], v_leaf[r.c, r.leaf] = r.n, r.v
    mass, base = masses(n_leaf, v_leaf, shape)
    shared = spark.sparkContext.broadcast((classes, base))
    learned = np.zeros((1 << shape.rows, CLASSES), np.float32), np.zeros(1 << shape.cells, np.float32)
    learners = max(1, (docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first().b or 0) // LEARNER_BYTES)
    for turn in range(ROUNDS):
        learned = _training(docs, text_col, shared, learned, turn, shape, learners)
    return Model(_frequent(words), classes, mass, base, *learned, shape, n_all, v_all), words.select("word", "n")


def score_with(docs: DataFrame, model: Model, words: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == held_out, F.lit(False))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            n, n_known, listed_log, model_log, rare = [], [], [], [], []
            for texts in groups(batch.column(3).to_pylist()):
                words, kinds, sizes = many(texts)
                found = own.known.find(words)
                gained = own.log10(words, kinds, sizes)
                start = np.cumsum(sizes) - sizes
                n += sizes.tolist()
                n_known += np.add.reduceat((found > 0).astype(np.int64), start).tolist()
                listed_log += np.add.reduceat(np.where(found > 0, np.log10(found + 0.5), 0.0), start).tolist()
                model_log += np.add.reduceat(gained, start).tolist()
                rare += [w[f == 0].view(np.int64) for w, f in zip(np.split(words, start[1:]), np.split(found, start[1:]), strict=True)]
            made = [pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(listed_log, pa.float64()), pa.array(model_log, pa.float64()), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["row", "id", "held_out", "n_tokens", "listed", "listed_log", "model_log", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).cast("binary"))
    made = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("listed", T.LongType()), ("listed_log", T.DoubleType()), ("model_log", T.DoubleType()), ("rare", T.ArrayType(T.LongType())))]
    scored = keep(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *made])), "scored")
    looked = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    rest = looked.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.count("n").alias("rare_known"))
    joined = scored.drop("rare").join(rest, "row", "left")
    log = F.col("listed_log") + F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (log - F.col("n_tokens") * float(np.log10(model.n_tokens + 0.5 * (model.n_words + 1)))).alias("base_score"), (log + F.col("model_log")).alias("score"),
    )


def score(docs: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents whose crc32(id as text) mod 5 isn't ``held_out`` and score all of them."""
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == held_out, F.lit(False))
    model, words = train(docs.where(~out), text_col)
    return score_with(docs, model, words, held_out, id_col, text_col)
