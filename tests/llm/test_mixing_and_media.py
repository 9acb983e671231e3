import hashlib
import io
import random
import wave
import zlib
from collections import Counter

import numpy as np

from pixelsift.llm import media, mixing


def levels(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left = {}, set(names)
    rest = sum(sizes.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            left.remove(s)
    return target


def test_targets_and_taken(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "B", "é", None, "tiny"]) if i else "lone") for i in range(3000)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = levels(sizes)
    df = docs(*rows, extra=("size", "rate"))
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and r.taken == r["size"] * r.copies
        taken[r.source] += r.taken
    for s in sizes:
        if sizes[s] > 1000:
            assert abs(taken[s] - want[s]) < 0.01 * want[s]
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in mixing.mix_plan(df.repartition(7)).collect())
    copies = {r.doc_id: r.copies for r in got}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_many_sources(docs, monkeypatch):
    """Beyond the bound of a broadcast, with many sources and long chains of resharing, the results are the same."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 4 ** rng.randint(0, 5))), f"h{rng.randrange(400)}" if i % 9 else None) for i in range(1500)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = levels(sizes)
    first = mixing.mix_plan(docs(*rows)).collect()
    monkeypatch.setattr(mixing, "SMALL", 10)
    second = mixing.mix_plan(docs(*rows)).collect()
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in first)
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))


def test_odd_documents(docs):
    assert mixing.mix_plan(docs((1, "x")).limit(0)).count() == 0
    got = {r.doc_id: r for r in mixing.mix_plan(docs((1, None, "a"), (2, " \n", "a"), (3, " x y\vz", None), (None, "q", "b"))).collect()}
    assert got[1].size == 0 and got[1].target == 0 and got[2].taken == 0 and got[3].size == 3 and got[None].size == 1
    assert mixing.mixed(docs((1, "x")).limit(0)).count() == 0
    (long,) = mixing.mix_plan(docs((1, "word " * 300_000))).collect()
    assert (long["size"], long.copies) == (300_000, 1)
    rows = mixing.mix_plan(docs(*[(1, "a b", "s")] * 5)).collect()
    assert len({r.copies for r in rows}) == 1


def test_wav_round_trip(docs):
    texts = [(1, None), (2, ""), (3, "é" * 40), (4, "a b c " * 20_000), (5, "x" * 64), (6, "a b c " * 20_000)]
    got = {r.doc_id: r for r in media.media_features(media.with_media(docs(*texts, extra=("media",)))).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        with wave.open(io.BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert list(r.fingerprints) == sorted(r.fingerprints)
    assert got[4].feature == got[6].feature != got[3].feature
    assert media.media_features(media.with_media(docs((1, "x")).limit(0))).count() == 0


def by_hand(payload):
    """Frames, peaks and pairs in plain Python, with a DFT by its definition."""
    n = 1 + max(0, -(-(len(payload) - 128) // 64))
    samples = [x - 128.0 for x in payload] + [0.0] * (128 + (n - 1) * 64 - len(payload))
    window = np.hanning(128)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(1, 65), np.arange(128)) / 128)
    power = [np.abs(turn @ (np.array(samples[64 * i : 64 * i + 128]) * window)) for i in range(n)]
    found = []
    for i in range(n):
        k = int(np.argmax(power[i]))
        near = [power[j][k] for j in (i - 1, i + 1) if 0 <= j < n]
        if power[i][k] > 0 and all(power[i][k] >= x for x in near):
            found.append((i, k + 1))
    codes = [found[-1][0] << 32 | found[-1][1] << 17] if found else []
    for a, (t, b) in enumerate(found):
        for u, c in found[a + 1 : a + 4]:
            if u - t <= 32:
                codes.append(t << 32 | b << 17 | c << 8 | u - t)
    return sorted(codes)


def test_fingerprints_by_hand():
    rng = random.Random(6)
    for size in (1, 3, 10, 40):
        payload = bytes(rng.randrange(256) for _ in range(64 * size))
        assert media.fingerprints(np.frombuffer(payload, np.uint8)).tolist() == by_hand(payload)


def test_a_tone_has_its_bin():
    t = np.arange(64 * 400)
    tone = (128 + 100 * np.sin(2 * np.pi * 8 * t / media.FRAME)).astype(np.uint8)
    _, bins = media.peaks(tone)
    assert set(bins.tolist()) == {8}
    whole = media.peaks(np.tile(tone, 30))
    small = media.BLOCK
    try:
        media.BLOCK = 100
        assert all((a == b).all() for a, b in zip(whole, media.peaks(np.tile(tone, 30))))
    finally:
        media.BLOCK = small
