import hashlib
import re
import zlib
from collections import Counter

from pixelsift.llm import exact_dedup, sharding

TEXTS = [(5, "a b"), (3, "a\t\n b"), (9, "a b "), (1, None), (2, ""), (4, "x" * 300_000), (8, "x" * 300_000), (7, "é b"), (6, "A b")]


def test_groups(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = {r.doc_id: r for r in exact_dedup.duplicate_groups(docs(*TEXTS, extra=("keep_id", "_md5"))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        same = [j for j, u in TEXTS if norm(u) == norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_survivors_ties_and_nulls(docs):
    df = docs(*TEXTS, (3, "a\t\n b"), (None, "a b"), (None, "only"), extra=("keep_id",))
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([3, 9, 1, 4, 7, 6, None])
    assert exact_dedup.duplicate_groups(docs(*TEXTS).limit(0)).count() == 0


def check_shards(rows, texts, shards):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    want = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_shards_are_even(docs):
    texts = [(i, "w" * (i * 37 % 400)) for i in range(3000)]
    sizes = check_shards(sharding.shard(docs(*texts, extra=("slot", "size")), 10).collect(), texts, 10)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 10


def test_copies_of_one_record_are_spread(spark, docs):
    texts = [(7, "same " * 50)] * 2000 + [(i, "other") for i in range(100, 2100)]
    rows = sharding.shard(docs(*texts).repartition(16), 8).collect()
    sizes = check_shards(rows, texts, 8)
    assert max(sizes) - min(sizes) <= 266
    assert max(Counter(r.shard for r in rows if r.doc_id == 7).values()) < 260


def test_equal_records_only(docs):
    """Whatever the number of copies, shards and input partitions: at most one record's size between any two shards."""
    for n, shards, parts in ((2000, 8, 1), (2000, 40, 16), (2001, 40, 1), (30, 40, 3)):
        texts = [(7, "same " * 50)] * n
        got = sharding.shard(docs(*texts).repartition(parts), shards).collect()
        sizes = check_shards(got, texts, shards)
        assert max(sizes) - min(sizes) <= 266, (n, shards, parts)
    other = sharding.shard(docs(*[(7, "same " * 50)] * 30).repartition(9), 40).collect()
    assert Counter((r.virtual_slot, r.split, r.shard, r.slot) for r in got) == Counter((r.virtual_slot, r.split, r.shard, r.slot) for r in other)


def test_a_very_long_text(docs):
    texts = [(1, "x" * 3_000_000), *[(i, "w" * 100) for i in range(2, 300)], (None, "w"), (None, "w")]
    sizes = check_shards(sharding.shard(docs(*texts), 4).collect(), texts, 4)
    rest = sorted(sizes)[:3]
    assert max(sizes) == 3_000_016 and rest[-1] - rest[0] <= 116


def test_odd_tables(docs):
    texts = [(None, None), (None, "x"), (1, ""), (1, "")]
    check_shards(sharding.shard(docs(*texts), 40).collect(), texts, 40)
    assert sharding.shard(docs((1, "x")).limit(0), 40).count() == 0


def test_map_versions_and_growth(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.shard(docs(*[(i, "t" * i) for i in range(500)]), 4, map_path=path)
    first, second = (sharding.load_map(spark, path, v) for v in (1, 2))
    assert set(first) == set(second) and set(second.values()) == {0, 1, 2, 3}
    sizes = {s: 10 + s[0] % 7 for s in second}
    before = sharding.rebalance(sizes, second, 4)
    after = sharding.rebalance(sizes, before, 5)
    moved = [s for s in sizes if before[s] != after[s]]
    load = Counter()
    for s, shard in after.items():
        load[shard] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 20
    assert sum(sizes[s] for s in moved) < 0.3 * sum(sizes.values())
