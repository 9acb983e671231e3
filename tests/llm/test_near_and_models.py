import pickle
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelsift.llm import components, jaccard_join, maxent_lm, toxicity
from pixelsift.llm._text import normalise, shingles, spans
from pixelsift.llm.trie import PrefixTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def linked_by_hand(texts):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(texts):
        low[find(k)] = min(low.get(find(k), (True, 0)), (i is None, i or 0))
    return Counter((i, len(sets[k]), i if not sets[k] else None if low[find(k)][0] else low[find(k)][1]) for k, (i, _) in enumerate(texts))


def corpus(seed, n, groups, size, edits):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(pool) for _ in range(25)] for _ in range(3)]
    bases = [[rng.choice(pool) for _ in range(size)] for _ in range(groups)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.7:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(pool)
        else:
            w = [rng.choice(pool) for _ in range(rng.randint(0, 50))] + rng.choice(shared)
        out.append((i * 3 + 1, " ".join(w)))
    return out


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_join_against_brute_force(docs):
    odd = [(2, None), (5, ""), (8, " \n"), (11, "One two"), (14, "one  TWO"), (None, "one two three four five six"), (None, "One two three four five six"), (17, "É b"), (20, "é b"), (23, "q " * 60_000), (26, "q " * 70_000)]
    texts = corpus(1, 150, 4, 60, 4) + odd
    df = docs(*texts, extra=("c", "h", "component_id"))
    assert result(jaccard_join.linked(df)) == linked_by_hand(texts)
    assert jaccard_join.linked(df.limit(0)).count() == 0


def test_long_lists_and_small_blocks(docs, monkeypatch):
    """Near copies in groups far above the bounds, with links that only the last step can find."""
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "QUERIES", 5)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "_join_blocks", lambda batches, order: iter(()))  # step 3 finds nothing
    texts = corpus(2, 120, 2, 50, 5)
    assert result(jaccard_join.linked(docs(*texts))) == linked_by_hand(texts)


def test_one_order_and_other_ids(docs, monkeypatch):
    """Whatever part of the order is by frequency, and for ids of any type."""
    texts = corpus(3, 120, 3, 50, 5)
    want = linked_by_hand(texts)
    for ranked in (0, 30):
        monkeypatch.setattr(jaccard_join, "RANKED", ranked)
        assert result(jaccard_join.linked(docs(*texts))) == want
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 100)
    df = docs(*texts).withColumn("doc_id", F.col("doc_id").cast("decimal(20,2)"))
    assert Counter((int(r.doc_id), r.n_shingles, int(r.component_id)) for r in jaccard_join.linked(df).collect()) == want


def test_order():
    rng = np.random.default_rng(3)
    s = np.unique(rng.integers(0, 1 << 60, 40, dtype=np.uint64))
    order = jaccard_join.Order(s[10:20].copy(), rng.permutation(10) + 1)
    got = order.sort(s)
    assert (got[:30] == np.concatenate([s[:10], s[20:]])).all() and (order.places(got[30:]) == np.arange(1, 11)).all()
    other = order.sort(s[5:30])
    assert [x for x in got.tolist() if x in set(other.tolist())] == other.tolist()


def test_one_of_each(docs):
    texts = [(3, "a b c d e f g"), (1, "A b c d e  f g"), (2, "x"), (4, None), (5, ""), (2, "x")]
    left = jaccard_join.one_of_each(docs(*texts, extra=("n",)))
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 4, 5])


def test_tree_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = [rng.integers(0, 1 << 60, rng.integers(1, 50), dtype=np.uint64) for _ in range(4)]
        sets = []
        for _ in range(60):
            b = base[rng.integers(4)]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.25], rng.integers(0, 1 << 60, rng.integers(0, 4), dtype=np.uint64)])))
        sets = [s for s in sets if len(s)]
        known = np.unique(np.concatenate(sets))[::3]
        order = jaccard_join.Order(known, rng.permutation(len(known)) + 1)
        tree = PrefixTree(sets, np.array([len(s) for s in sets]), order.places)
        for s in sets:
            want = {k for k, x in enumerate(sets) if 175 * len(np.intersect1d(s, x)) >= 75 * (len(s) + len(x))}
            assert set(tree.query(s, len(s)).tolist()) == want


def test_hashes_of_long_texts(monkeypatch):
    from pixelsift.llm import _text

    text = ("alpha beta " * 3000 + "x" * 70_000 + " gamma delta").encode()
    whole = spans(normalise(text), 5)
    monkeypatch.setattr(_text, "BLOCK", 100)
    assert (spans(normalise(text), 5) == whole).all()
    assert len(shingles(normalise(b"a b"), 5)) == 1 and len(shingles(b"", 5)) == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.v: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {v: c for v, c in up.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_language_model(docs):
    rng = random.Random(2)
    vocab = {k: [f"{k}{rng.choice('aeiou')}{rng.choice('rstln')}{i % 90}{k}" for i in range(90)] for k in ("xa", "yo", "zu")}
    texts = [(i, " ".join(rng.choice(vocab[("xa", "yo", "zu")[i % 3]]) for _ in range(rng.randint(20, 80)))) for i in range(400)]
    texts += [(1001, None), (1002, ""), (1003, "Never seen"), (1003, "Never seen"), (None, "null id"), (1004, texts[0][1] + " " + "zz" * 40_000)]
    rows = maxent_lm.score(docs(*texts, extra=("row", "rare"))).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in texts:
        if not held(i):
            counts.update([*words(t), "\0end"])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = [*words(t), "\0end"]
        want[i, held(i), len(w), sum(x in counts for x in w), total, round(sum(log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    tested = [r for r in rows if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in tested) > 0.95 * sum(r.base_score for r in tested)  # logs: less negative is better
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert maxent_lm.score(docs((1, "x")).limit(0)).count() == 0


FULL = 1 << 64


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB % FULL
    return x ^ x >> 31


def log10_by_hand(m, text):
    """The log10 probability of a text, token by token in plain Python, from the model's tables and the counts of its words."""
    w, kinds = maxent_lm.tokens(text)
    w, kinds, c = w.tolist(), kinds.tolist(), [int(x) + 1 for x in m.classes[kinds]]
    at = lambda x, i, k, none: x[i - k] if i >= k else none
    total = 0.0
    for i, word in enumerate(w):
        w1, w2, w3 = (at(w, i, k, 7) for k in (1, 2, 3))
        c1, c2, c3, c4, c5 = (at(c, i, k, 0) for k in (1, 2, 3, 4, 5))
        two = w1 * 3 % FULL ^ w2
        rows = [0]
        for k, x in enumerate((w1, w2, w3, two, (c1 * 64 + c2) * 64, (c2 * 64 + c3) * 64 + c1, (c3 * 64 + c4) * 64 + c5), 1):
            rows.append((scramble(x ^ scramble(k)) >> 32) * ((1 << m.shape.rows) - 1) // (1 << 32) + 1)
        z = [sum(float(m.weights[r, j]) for r in rows) for j in range(maxent_lm.CLASSES)]
        log_p = z[c[i] - 1] - np.logaddexp.reduce(z)
        leaf, node, first = word >> 64 - m.shape.levels, 1, (c[i] - 1) << m.shape.levels
        for d in range(m.shape.levels):
            seen = float(m.base[first + node])
            for h in (w1, two + 1, w2 + 2):
                key = (scramble(h % FULL) + (first + node) * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95 % FULL
                seen += float(m.tree[key >> 64 - m.shape.cells])
            bit = leaf >> m.shape.levels - 1 - d & 1
            log_p -= np.logaddexp(0, -seen if bit else seen)
            node = 2 * node + bit
        total += (log_p - np.log(m.mass[first + leaf])) / np.log(10)
    return total


def test_scores_of_the_language_model_by_hand(docs):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(pool[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randint(1, 60)))) for i in range(150)] + [(200, None), (201, "never seen w1"), (202, "x" * 300_000)]
    df = docs(*texts)
    model, table = maxent_lm.train(df.where("doc_id < 100"))
    counts = {r.word: r.n for r in table.collect()}
    assert sum(counts.values()) == model.n_tokens and model.tree.any() and model.weights.any()
    got = {r.doc_id: r.score for r in maxent_lm.score_with(df, model, table).collect()}
    for i, t in texts:
        own = maxent_lm.tokens((t or "").encode())[0].view(np.int64).tolist()
        want = log10_by_hand(model, (t or "").encode()) + sum(log10(counts.get(x, 0) + 0.5) for x in own)
        assert abs(got[i] - want) < 1e-3 * max(1, len(own))


def test_probabilities_sum_to_one():
    """Over all classes and leaves, after some history; a leaf's words and its half count make up its mass."""
    rng = np.random.default_rng(1)
    shape = maxent_lm.Shape(13, 4, 14)
    n = rng.integers(0, 50, (maxent_lm.CLASSES, 16)).astype(float)
    mass, base = maxent_lm.masses(n, np.minimum(n, 3), shape)
    assert np.allclose(mass, (n + 0.5 * (np.minimum(n, 3) + 1)).ravel())
    weights, tree = rng.normal(0, 1, (1 << 13, maxent_lm.CLASSES)).astype(np.float32), rng.normal(0, 1, 1 << 14).astype(np.float32)
    w, k = maxent_lm.tokens(b"some words, and more words of a text")
    rows, hashes = maxent_lm.features(w, k, np.arange(maxent_lm.TYPES) % maxent_lm.CLASSES, shape)
    classes = np.exp(maxent_lm.log_classes(weights, rows))
    assert np.allclose(classes.sum(1), 1, atol=1e-4)
    leaves = np.arange(16, dtype=np.uint64) << np.uint64(60)
    for c in (0, 5):
        nodes, bits = maxent_lm.path(leaves, np.full(16, c), shape)
        one = lambda t, c=c, nodes=nodes, bits=bits: np.exp(maxent_lm.log_steps(t, base, np.repeat(hashes[:, 4:5], 16, 1), nodes, bits, shape))
        assert abs(one(tree).sum() - 1) < 1e-4 and np.abs(one(tree) - one(tree * 0)).max() > 0.01
        assert np.allclose(one(tree * 0), mass.reshape(-1, 16)[c] / mass.reshape(-1, 16)[c].sum(), atol=1e-4)
    short, less = maxent_lm.features(w[:3], k[:3], np.arange(maxent_lm.TYPES) % maxent_lm.CLASSES, shape)
    assert (short == rows[:3]).all() and (less == hashes[:, :3]).all()  # features look back only


def test_features_reach_back():
    """The word three back has a feature of its own, the types one to five back have theirs; two words reach the trees."""
    kinds, classes, shape = np.arange(6), np.arange(maxent_lm.TYPES) % maxent_lm.CLASSES, maxent_lm.MOST
    w = np.arange(100, 106).astype(np.uint64)
    row = lambda w, k: [x[..., 5] if x.dtype == np.uint64 else x[5] for x in maxent_lm.features(w, k, classes, shape)]
    assert maxent_lm.FEATURES == 8 and maxent_lm.BATCH == 2048
    for back, changed, below in ((3, {3}, set()), (2, {2, 4}, {1, 2}), (1, {1, 4}, {0, 1})):
        other = w.copy()
        other[5 - back] += np.uint64(1000)
        assert [set(np.flatnonzero(a != b)) for a, b in zip(row(w, kinds), row(other, kinds))] == [changed, below]
    for back, changed in ((5, {7}), (4, {7}), (3, {6, 7}), (2, {5, 6}), (1, {5, 6})):
        other = kinds.copy()
        other[5 - back] += 10
        assert set(np.flatnonzero(row(w, kinds)[0] != row(w, other)[0])) == changed


def test_word_pairs_decide_within_a_class(docs):
    """Two words of one class and equal counts are told apart by the word before them."""
    rng = random.Random(7)
    texts = []
    for i in range(600):
        w = []
        for _ in range(40):
            w += rng.choice((["red", "xaing"], ["blue", "xbing"]))
        texts.append((i, " ".join(w)))
    model, _ = maxent_lm.train(docs(*texts))
    right, wrong = (model.log10(*maxent_lm.many([t])) for t in (b"red xaing blue xbing", b"red xbing blue xaing"))
    assert right.sum() > wrong.sum() + 1 and model.classes[maxent_lm.tokens(b"xaing")[1][0]] == model.classes[maxent_lm.tokens(b"xbing")[1][0]]


def test_what_is_learned_grows():
    a, b, c = (maxent_lm.shape_for(v, n) for v, n in ((1000, 20_000), (30_000, 900_000), (10_000_000, 1 << 40)))
    assert all(x <= y <= z for x, y, z in zip(a, b, c)) and a < b < c == maxent_lm.MOST


@pytest.fixture(scope="module")
def toxic_texts():
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ta", "no", "ri", "sel", "um"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["idiot", "moron", "worthless", "idiots", "morons"]
    rows = []
    for i in range(700):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + len(w) // 50):
                w.insert(rng.randrange(len(w)), rng.choice(bad[:3]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows, plain


def test_toxicity(spark, docs, toxic_texts):
    rows, plain = toxic_texts
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    odd = [(5001, None), (5002, ""), (5003, "x" * 200_000), (None, "plain"), (5004, " ".join(plain[:40] + ["mooron", "idiott", "m0ron"])), (5005, " ".join(plain * 20 + ["idiot", "moron"]))]
    df = docs(*[(i, t) for i, t, _ in rows], *odd, extra=("score", "_y"))
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    tested = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p for y, p in tested if y) >= 0.9 * sum(y for y, _ in tested) and sum(p for y, p in tested if not y) <= 0.03 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert not got[5001].predicted and not got[5002].predicted and got[5004].predicted and got[5005].predicted
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, r in got.items() if not r.predicted)


def score_by_hand(model, text):
    """The score from the weights alone: means of n-grams, windows of 32 words 16 apart, each distinct word once."""
    w = (text or b"").lower().split()
    if not w:
        return 0.0
    full = FULL

    def value(word):
        b = b"<" + (word.strip(b".,;:!?\"'()[]") or word) + b">"
        hashes = [sum(scramble((c * 0x9E3779B97F4A7C15 + i) % full) for i, c in enumerate(b)) % full]
        for n in (3, 4, 5):
            for i in range(len(b) - n + 1):
                h = n
                for c in b[i : i + n]:
                    h = (h ^ c) * 0x100000001B3 % full
                hashes.append(h)
        buckets = [(h * 0x9E3779B97F4A7C15 % full) >> 48 for h in hashes]
        return sum(float(model.weights[x]) for x in buckets) / len(buckets)

    starts = [0] if len(w) <= 32 else [*range(0, len(w) - 32, 16), len(w) - 32]
    most = max(sum(value(x) for x in set(w[s : s + 32])) for s in starts)
    return 1 / (1 + np.exp(-(model.bias + most / 32)))


def test_scores_by_hand(toxic_texts):
    rows, _ = toxic_texts
    model = toxicity.fit([(y, t.encode()) for _, t, y in rows[:300]])
    texts = [t.encode() for _, t, _ in rows[300:360]] + [None, b"", b" \n", b"!!! a", "É, «x» idiot!".encode(), b"same " * 100, b"x" * 5000]
    assert np.allclose(model.score(texts), [score_by_hand(model, t) for t in texts], atol=1e-6)


def test_toxicity_of_other_ids_and_names(spark, docs, toxic_texts):
    """Ids of any type, several rows of an id, clashing names, and a bound on the bytes of the sample."""
    rows, _ = toxic_texts
    df = docs(*[(i, t) for i, t, _ in rows], rows[0][:2], extra=("_score", "_row", "held_out", "text_")).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(f"d{i}", 0, y) for i, _, y in rows], "doc_id string, quality int, toxic int")
    out = toxicity.score(df, toxicity.train(df, labels), carry=["doc_id", "_score", "_row", "held_out"])
    assert out.columns == ["doc_id", "_score", "_row", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + 1 and all(r._score == 7 and r.held_out == (zlib.crc32(r.doc_id.encode()) % 5 == 0) for r in got)
    truth = {f"d{i}": y for i, _, y in rows}
    assert sum(r.predicted == truth[r.doc_id] for r in got) > 0.97 * len(got)


def test_the_sample_is_bounded(spark, docs, monkeypatch):
    rows = [(i, "word " * (5000 if i % 50 == 3 else 100)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "PER_CLASS", {0: 40, 1: 30})
    monkeypatch.setattr(toxicity, "FIT_BYTES", {0: 10_000, 1: 20_000})
    monkeypatch.setattr(toxicity, "fit", lambda examples: seen.extend(examples) or toxicity.Model())
    toxicity.train(docs(*rows), labels)
    assert Counter(y for y, _ in seen)[0] == 20 and 0 < Counter(y for y, _ in seen)[1] <= 30 and all(len(t) == 500 for _, t in seen)


def test_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs((1, "bad")), labels)
    assert [r.score for r in toxicity.score(docs((1, "bad"), (2, None)), model).collect()] == [0.0, 0.0]
    assert toxicity.score(docs((1, "x")).limit(0), model).count() == 0


def test_toxicity_is_fitted_on_whole_texts(spark, docs, monkeypatch):
    """Every word of long labelled rows of both labels reaches the fit."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3000 + i))) for i in range(1, 9)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda examples: seen.extend(examples) or toxicity.Model())
    toxicity.train(docs(*rows), labels)
    got = {w for _, x in seen for w in (x if isinstance(x, bytes) else b" ".join(x)).split()}
    assert got == {w.encode() for i, t in rows for w in t.split() if zlib.crc32(str(i).encode()) % 5 != 0}
    assert {y for y, _ in seen} == {0, 1}


def test_weights_that_were_sent_are_updated_fast():
    """Arrays that come by a broadcast have a data type object of their own, for which numpy leaves its fast scatter."""
    shape = maxent_lm.Shape(13, 4, 14)
    start = np.zeros((1 << 13, maxent_lm.CLASSES), np.float32), np.zeros(1 << 14, np.float32)
    base = np.zeros(maxent_lm.CLASSES << 4, np.float32)
    words, kinds = maxent_lm.tokens(b"some words, and more words of a text " * 20)
    classes = np.arange(maxent_lm.TYPES) % maxent_lm.CLASSES
    rows, hashes = maxent_lm.features(words, kinds, classes, shape)
    made, sent = maxent_lm._Learner(start, base, shape), maxent_lm._Learner(*pickle.loads(pickle.dumps((start, base))), shape)
    for own in (made, sent):
        own.update(words, rows, hashes, classes[kinds])
        assert all(x.dtype is np.dtype(np.float32) for x in (own.weights, own.tree, own.base))
    assert made.tree.any() and (made.tree == sent.tree).all() and (made.weights == sent.weights).all()
