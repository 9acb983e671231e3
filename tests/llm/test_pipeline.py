"""Each stage's rows against what plain Python makes of its input."""

import os
import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, tmp_path):
    rng = random.Random(5)
    pool = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choice(pool) for _ in range(60))
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(20, 60)))
        if i % 6 == 0:
            text += " idiot moron worthless"
        if i % 10 == 1:
            text += "\n" + passage
        rows.append((i, text, f"s{i % 4}"))
    rows += [(1000 + i, rows[2][1] + " extra", "s1") for i in range(3)] + [(2000, None, None), (2001, "", "s0")]
    folder = str(tmp_path)
    df = docs(*rows, extra=("slot",))
    df.write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    now, names = spark.read.parquet(os.path.join(folder, "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert out.columns == df.columns, name
        out.write.parquet(os.path.join(folder, f"stage{k}"))
        out = spark.read.parquet(os.path.join(folder, f"stage{k}"))
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            bad = {i for i in range(300) if i % 6 == 0}
            assert len(bad & set(ids)) <= 2 and len(set(range(300)) - bad - set(ids)) <= 5 and 2000 in ids
        elif name == "line_dedup":
            assert sum(passage in (r.text or "") for r in out.collect()) == 1
            # 1001 and 1002 are copies of 1000: nothing of them is left, so they go; texts that were empty stay
            assert set(ids) == {r.doc_id for r in now.collect()} - {1001, 1002}
            assert all((r.text or "").split() or r.doc_id in (2000, 2001) for r in out.collect())
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        elif name == "jaccard_join":
            assert {2, 2000, 2001} <= set(ids) and not {1000, 1001, 1002} & set(ids) and max(ids.values()) == 1
        elif name == "mixing":
            assert max(ids.values()) <= 3
        names.append(name)
        now = out
    assert names == ["toxicity", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]
    assert all(r.n_tokens == len(r.token_ids) for r in now.collect())
    again = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert again == Counter((r.doc_id, r.ids_sha256) for r in now.collect())


def test_stages_against_brute_force(spark, docs):
    """Rows of line_dedup, jaccard_join, mixing and encoding, each on its own input, with all their columns."""
    import hashlib
    import zlib
    from array import array
    from math import floor

    import public_tokenizers
    import tiktoken
    from test_line_dedup import brute
    from test_mixing_and_media import levels
    from test_near_and_models import linked_by_hand

    from pixelsift.llm import byte_bpe, mixing

    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(8)
    pool = [f"word{i}" for i in range(200)]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(5, 30))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))), f"s{i % 4}") for i in range(80)]
    for i in range(80, 120):
        w = rows[i % 7][1].split(" ")
        w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w), "s1"))
    rows += [(2000, None, None), (2001, "", "s0"), (2002, "é  漢\n1.5", "s2")]
    df = docs(*rows, extra=("slot",))
    own = df.collect()

    left = brute([(i, t) for i, t, _ in rows], 50)
    assert any(left[i] != t for i, t, _ in rows)
    gone = {i for i, t, _ in rows if (t or "").split() and not left[i].split()}
    assert gone
    want = Counter((r.doc_id, left[r.doc_id], r.lang, r.source, None if left[r.doc_id] is None else len(left[r.doc_id]), r.slot) for r in own if r.doc_id not in gone)
    assert Counter(map(tuple, stages["line_dedup"](spark, df, "").collect())) == want

    kept = Counter(i for i, _, c in linked_by_hand([(i, t) for i, t, _ in rows]) if c is None or c == i)
    assert len(kept) < len(rows)
    assert Counter(map(tuple, stages["jaccard_join"](spark, df, "").collect())) == Counter(tuple(r) for r in own if r.doc_id in kept)

    size = {r.doc_id: len((r.text or "").split()) for r in own}
    sizes = Counter()
    for r in own:
        sizes[r.source] += size[r.doc_id]
    target = levels(sizes)
    crc = spark.createDataFrame([(r.doc_id, zlib.crc32((r.text or "").encode()), k) for r in own for k in range(mixing.SEEDS)], "i long, c long, k int")
    draws = {(r.i, r.k): (r.h % (1 << 30)) / (1 << 30) for r in crc.selectExpr("i", "k", "xxhash64(i, c, k) AS h").collect()}
    copies = {}
    for s in sizes:
        rate = min(3.0, target[s] / sizes[s]) if sizes[s] else 0.0
        mine = [r.doc_id for r in own if r.source == s]
        tries = [{i: floor(rate) + (draws[i, k] < rate - floor(rate)) for i in mine} for k in range(mixing.SEEDS)]
        copies |= min(tries, key=lambda t: abs(sum(n * size[i] for i, n in t.items()) - target[s]))
    want = Counter()
    for r in own:
        if copies[r.doc_id]:
            want[tuple(r)] += copies[r.doc_id]
    assert Counter(map(tuple, stages["mixing"](spark, df, "").collect())) == want

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in own:
        ids = coder.encode_ordinary(r.text or "")
        want[r.doc_id, r.lang, r.source, r.n_chars, r.slot, len(ids), tuple(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    got = stages["byte_bpe"](spark, df, "").collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, r.slot, r.n_tokens, tuple(r.token_ids), r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_empty_tables_and_very_long_texts(spark, docs):
    """Every stage takes an empty table and a text of a million characters; clashing columns are carried."""
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    names = ("_text", "n_tokens", "_row", "runs", "copies", "component_id", "score")
    long = "\n".join(f"line {i} " + "word " * 20 for i in range(8000)) + "x" * 100_000
    df = docs((1, long), (2, "a b"), (None, None), extra=names)
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        labels.write.parquet(os.path.join(folder, "labels.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, df.limit(0), folder).count() == 0, name
            out = stage(spark, df, folder).collect()
            assert {r.doc_id for r in out} <= {1, 2, None} and any(r.doc_id == 1 for r in out), name
