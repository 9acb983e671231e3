"""Exact n-gram Jaccard join of whole texts: five-word shingles, 100 * intersection >= 75 * union.

Texts are lower-cased (A-Z) and cut into words; a text's set holds the hashes of its distinct shingles.
Copies of one word sequence form a class, found by a 128-bit hash, and only classes are joined. Every step
is exact (up to 64-bit hash collisions of shingles); none caps a list or drops a candidate.

1. *Who can have a partner.* In any fixed order two linked sets of sizes n and m share at least L elements
   among the first n - ceil(3n/4) + L (and m - ...). Each task sends those prefixes, in order of hashes and
   by hash range, as packed arrays; what repeats within a task is counted there and sent once. A class stays if
   enough of its prefix occurs in other classes. Nine in ten drop out here; only the rest keep their sets.
2. *The order.* One global order of all elements holds for every trie and prefix: those that few sets hold first, by
   hash, then the :data:`RANKED` most frequent ones, by frequency. Tries are written from its end, so that
   partial overlaps are shared; prefixes are taken from its beginning.
3. *Local joins.* Sets meet in buckets of their smallest hashes. Blocks of a bucket are stored in prefix
   trees (:class:`~pixelsift.llm.trie.PrefixTree`); subtrees are pruned by remaining-length bounds. A block sends a
   spanning forest of its links, not its pairs, and components are formed. This finds most links cheaply; it need not
   find all.
4. *The rest.* Linked sets share an element of their prefixes. Lists of an element whose sets are all in one
   component are finished. All others are checked in tries: sets of different components that meet in a short list, by a
   trie of each set's possible partners; long lists that share members are taken together: the members outside their
   largest component are the queries, in blocks, against blocks of those members whose size allows a link. Each
   trie sends a forest again.
5. The components of all links, with the smallest id of each, go back to the documents.

Groups of near copies of any size thus cost a few rows per member; the only pairs ever listed are those
of different components in lists of at most :data:`SHORT` members.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of
fewer than five words is one shingle; texts of any length are taken whole, one at a time; ids may be of any type that
has an order; null ids lose against others when a component is named; rows with equal texts are always linked (also
rows with equal ids); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixelsift.llm._store import keep, release
from pixelsift.llm._text import mix, normalise, settled, shingles
from pixelsift.llm.components import components
from pixelsift.llm.trie import PrefixTree, needed

#: Words in a shingle.
WORDS = 5
#: Entries that a task gathers before it sends them.
FLUSH = 2_000_000
#: Bytes of text for each hash range of step 1, which one worker holds.
RANGE_BYTES = 32 << 20
#: Buckets of step 3 that each set goes to, and sets in a block.
KEYS, BLOCK = 3, 512
#: Longest list whose pairs are listed; queries and members in a trie of the longer ones.
SHORT, QUERIES, MEMBERS = 64, 256, 1024
#: Elements whose place in the order is by their frequency, at most; all others come before them.
RANKED = 1 << 17
#: Linked sets differ in size by less than this factor, so they are in the same class of sizes or in adjoining ones.
SIZE_STEP = 1.4


def _extra(n):
    return n // 8 + 1


def _class(norm: bytes) -> tuple[bytes, int]:
    h = hashlib.blake2b(norm, digest_size=16).digest()
    return h, int.from_bytes(h[:8], "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _emitter(parts: int, id_type: pa.DataType):
    """Per batch of (id, key, text): rows about documents (kind 0), packed prefixes (1) and counts (2)."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", id_type), ("key", pa.int64()), ("h", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("once", pa.binary()), ("owner", pa.binary()), ("often", pa.binary())])

    def rows(kind: int, size: int, **cols):
        given = {"kind": pa.array(np.full(size, kind), pa.int32()), **cols}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def send(prefixes: list, classes: list):
        e, own = np.concatenate(prefixes), np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
        order = np.argsort(e, kind="stable")
        e, own = e[order], own[order]
        new = np.concatenate([[True], e[1:] != e[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        count = np.bincount(own[many[group]], minlength=len(prefixes))
        ids = np.array(classes, np.int64)
        some = np.flatnonzero(count)
        if len(some):
            yield rows(2, len(some), part=pa.array((ids[some] % parts).astype(np.int32)), c=pa.array(ids[some]), n=pa.array(count[some]))
        once, owner, often = e[~many[group]], ids[own[~many[group]]], e[new & many[group]]
        where, where_often = (once % np.uint64(parts)).astype(np.int64), (often % np.uint64(parts)).astype(np.int64)
        order, order_often = np.argsort(where, kind="stable"), np.argsort(where_often, kind="stable")
        once, owner, often = once[order], owner[order], often[order_often]
        cut, cut_often = np.searchsorted(where[order], np.arange(parts + 1)), np.searchsorted(where_often[order_often], np.arange(parts + 1))
        used = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_often) > 0))
        yield rows(
            1, len(used), part=pa.array(used.astype(np.int32)), once=pa.array([once[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()),
            owner=pa.array([owner[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()), often=pa.array([often[cut_often[p] : cut_often[p + 1]].tobytes() for p in used], pa.binary()),
        )

    def run(batches):
        prefixes, classes, seen, held, sent = [], [], set(), 0, 0
        for batch in batches:
            hs, cs, ns = [], [], []
            for text in batch.column(2):
                norm = normalise(text.as_py())
                h, c = _class(norm)
                s = shingles(norm, WORDS)
                n = len(s)
                hs.append(h)
                cs.append(c)
                ns.append(n)
                if n and c not in seen:
                    seen.add(c)
                    prefixes.append(s[: n - (3 * n + 3) // 4 + _extra(n)].copy())
                    classes.append(c)
                    held += len(prefixes[-1])
                if held >= FLUSH:
                    yield from send(prefixes, classes)
                    prefixes, classes, seen, held = [], [], set(), 0
            # rows about documents are dealt round: copies of one text needn't meet here
            where = (np.arange(sent, sent + len(hs)) + (cs[0] if cs else 0)) % parts
            sent += len(hs)
            yield rows(0, len(hs), part=pa.array(where.astype(np.int32)), id=batch.column(0), key=batch.column(1), h=pa.array(hs, pa.binary()), c=pa.array(cs, pa.int64()), n=pa.array(ns, pa.int64()))
        if prefixes:
            yield from send(prefixes, classes)

    def count(batches):
        """Pass documents and counts on; of the packed prefixes of this range, count per class what other classes have too."""
        once, owner, often = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for batch in batches:
            kind = batch.column(0).to_numpy()
            packed = np.flatnonzero(kind == 1)
            for i in packed:
                once.append(np.frombuffer(batch.column(7)[i].as_py(), np.uint64))
                owner.append(np.frombuffer(batch.column(8)[i].as_py(), np.int64))
                often.append(np.frombuffer(batch.column(9)[i].as_py(), np.uint64))
            if len(packed) < len(kind):
                yield batch.filter(pa.array(kind != 1)).select([0, 2, 3, 4, 5, 6])
        e, own = np.concatenate(once), np.concatenate(owner)
        many = np.unique(np.concatenate(often))
        if not len(e):
            return
        order = np.lexsort((own, e))
        e, own = e[order], own[order]
        first = np.concatenate([[True], (e[1:] != e[:-1]) | (own[1:] != own[:-1])])  # one for each element and class
        e, own = e[first], own[first]
        group = np.cumsum(np.concatenate([[True], e[1:] != e[:-1]])) - 1
        shared = np.bincount(group)[group] > 1
        if len(many):
            at = np.minimum(np.searchsorted(many, e), len(many) - 1)
            shared |= many[at] == e
        c, n = np.unique(own[shared], return_counts=True)
        if len(c):
            whole = rows(2, len(c), c=pa.array(c), n=pa.array(n.astype(np.int64)))
            yield whole.select([0, 2, 3, 4, 5, 6])

    return run, count


def _sets(batches):
    """(c, h, text) to (c, n, items) where the text is that of the class."""
    for batch in batches:
        out: dict = {"c": [], "n": [], "items": []}
        for c, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            norm = normalise(text)
            if _class(norm)[0] == h:
                s = _signed(shingles(norm, WORDS))
                out["c"].append(c)
                out["n"].append(len(s))
                out["items"].append(s)
        yield pa.RecordBatch.from_arrays([pa.array(out["c"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["items"], pa.list_(pa.int64()))], names=["c", "n", "items"])


def _items(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _buckets(batches):
    for batch in batches:
        keys = []
        for i in range(batch.num_rows):
            s = _items(batch.column(2), i)
            keys.append([int(_signed(mix(s ^ mix(np.array([k + 1], np.uint64))).min(keepdims=True))[0]) for k in range(KEYS)])
        for k in range(KEYS):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keys], pa.int64()), *batch.columns], names=["key", "c", "n", "items"])


class _Forest:
    """Union-find that remembers which unions mattered."""

    def __init__(self):
        self.up: dict = {}
        self.edges: list = []

    def find(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((max(a, b), min(a, b)))


def _edge_batch(edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


class Order:
    """The global order: elements that aren't ``common`` by hash, then those by their place (from 1, the most frequent last)."""

    def __init__(self, common: np.ndarray, place: np.ndarray):
        self.common, self.place = common, place

    def places(self, elements: np.ndarray) -> np.ndarray:
        """The place of each element, 0 for those that go by their hash."""
        if not len(self.common):
            return np.zeros(len(elements), np.int64)
        at = np.minimum(np.searchsorted(self.common, elements), len(self.common) - 1)
        return np.where(self.common[at] == elements, self.place[at], 0)

    def sort(self, s: np.ndarray) -> np.ndarray:
        """A set, sorted by hash, in the global order."""
        return s[np.argsort(self.places(s), kind="stable")]


def global_order(sets: DataFrame) -> Order:
    """Elements above a frequency that at most :data:`RANKED` have, by way of a histogram of the frequencies."""
    counts = keep(sets.select(F.explode("items").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "frequent")
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).count().orderBy(F.col("b").desc()).collect()  # at most 8 * 64 rows
    cut, n = 1 << 10, 0
    for r in bins:
        if n + r["count"] > RANKED:
            break
        cut, n = r.b, n + r["count"]
    top = counts.where(F.floor(F.log2("n") * 8) >= cut).toPandas().sort_values(["n", "e"])  # at most RANKED rows
    hashes = top["e"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return Order(hashes[by_hash], by_hash + 1)


def _local(block: dict, order: Order) -> list:
    ids, sets = list(block), [s for _, s in block.values()]
    sizes = np.array([n for n, _ in block.values()], np.int64)
    tree, forest, met = PrefixTree(sets, sizes, order.places), _Forest(), set()
    # the most typical sets first: they find most of the others
    typical = [tree.frequency[np.searchsorted(tree.universe, s)].mean() for s in sets]
    for i in np.argsort(typical)[::-1]:
        if ids[i] not in met:
            for k in tree.query(sets[i], int(sizes[i])):
                met.add(ids[k])
                forest.join(ids[i], ids[k])
    return forest.edges


def _join_blocks(batches, order: Order):
    """Links in blocks of consecutive rows with one key."""
    key, block = None, {}
    for batch in batches:
        keys, cs, ns = (batch.column(i).to_pylist() for i in range(3))
        out = []
        for i in range(batch.num_rows):
            if keys[i] != key or len(block) >= BLOCK:
                if len(block) > 1:
                    out += _local(block, order)
                key, block = keys[i], {}
            block[cs[i]] = (ns[i], _items(batch.column(3), i))
        yield _edge_batch(out)
    if len(block) > 1:
        yield _edge_batch(_local(block, order))


def _prefixes(batches, order: Order):
    """The elements of each set's prefix in the global order: (e, c, n, pos)."""
    for batch in batches:
        e, c, n, pos = [], [], [], []
        for i in range(batch.num_rows):
            s, size = order.sort(_items(batch.column(2), i)), batch.column(1)[i].as_py()
            p = size - (3 * size + 3) // 4 + 1
            e.append(_signed(np.ascontiguousarray(s[:p])))
            c.append(np.full(p, batch.column(0)[i].as_py()))
            n.append(np.full(p, size))
            pos.append(np.arange(p))
        if e:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (e, c, n, pos)], names=["e", "c", "n", "pos"])


def _join_units(batches, order: Order):
    """Queries (role 0) against members (role 1) of one unit; links between different components."""

    def links(queries: dict, members: dict) -> list:
        ids = list(members)
        tree, forest = PrefixTree([members[c][2] for c in ids], np.array([members[c][1] for c in ids], np.int64), order.places), _Forest()
        for comp, n, s in queries.values():
            for k in tree.query(s, n):
                forest.join(comp, members[ids[k]][0])
        return forest.edges

    unit, sides = None, ({}, {})
    for batch in batches:
        units, roles, cs, comps, ns = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for i in range(batch.num_rows):
            if units[i] != unit:
                if sides[0] and sides[1]:
                    out += links(*sides)
                unit, sides = units[i], ({}, {})
            sides[roles[i]][cs[i]] = (comps[i], ns[i], _items(batch.column(5), i))
        yield _edge_batch(out)
    if sides[0] and sides[1]:
        yield _edge_batch(links(*sides))


def _remaining(sets: DataFrame, comps: DataFrame, order) -> DataFrame:
    """Step 4: all links between different components, as edges (a, b) of components."""
    spark = sets.sparkSession
    lists = sets.mapInArrow(settled(lambda batches: _prefixes(batches, order.value)), "e long, c long, n long, pos long")
    lists = keep(lists.join(comps.select(F.col("v").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c")), "lists")
    open_ = keep(lists.groupBy("e").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("m")).where("_lo != _hi").select("e", "m"), "open")
    live = keep(lists.join(open_, "e"), "live")

    # short lists: a trie of each set's possible partners
    a, b = (live.where(F.col("m") <= SHORT).select("e", *[F.col(x).alias(f"{x}_{s}") for x in ("c", "n", "pos", "comp")]) for s in "ab")
    need = F.floor((3 * (F.col("n_a") + F.col("n_b")) + 6) / 7)
    pairs = (
        a.join(b, "e").where((F.col("c_a") < F.col("c_b")) & (F.col("comp_a") != F.col("comp_b")))
        .where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need).select("c_a", "c_b", "comp_a", "comp_b").distinct()
    )
    pairs = keep(pairs, "pairs")
    blocks = pairs.groupBy("c_a", "comp_a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_tb"))
    asked = blocks.select("c_a", F.explode(F.sequence(F.lit(0), F.col("_tb") - 1)).alias("t"), F.lit(0).alias("role"), F.col("c_a").alias("c"), F.col("comp_a").alias("comp"))
    partners = pairs.join(blocks.select("c_a", "_tb"), "c_a").select("c_a", F.pmod(F.xxhash64("c_b"), F.col("_tb")).cast("int").alias("t"), F.lit(1).alias("role"), F.col("c_b").alias("c"), F.col("comp_b").alias("comp"))
    units = asked.unionByName(partners).select(F.xxhash64("c_a", "t").alias("unit"), "role", "c", "comp")

    long_ = live.where(F.col("m") > SHORT).select("e", "c", "comp", "n").distinct()
    if long_.limit(1).count():
        units = units.unionByName(_long_lists(long_))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = units.join(sets, "c").select("unit", "role", "c", "comp", "n", "items")
    return whole.repartition(n, "unit").sortWithinPartitions("unit", "role").mapInArrow(settled(lambda batches: _join_units(batches, order.value)), "a long, b long")


def _long_lists(long_: DataFrame) -> DataFrame:
    """Units (unit, role, c, comp) for lists of many members, (e, c, comp, n): those that share members are an area."""
    areas = components(long_.select(F.col("c").alias("a"), F.col("e").alias("b")))
    size_class = F.floor(F.log(F.col("n")) / float(np.log(SIZE_STEP))).cast("int")
    members = keep(long_.select("c", "comp", size_class.alias("k")).distinct().join(areas.select(F.col("v").alias("c"), F.col("comp").alias("area")), "c"), "members")
    main = members.groupBy("area", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("area").agg(F.max(F.struct("_n", "comp"))["comp"].alias("_main"))
    near = F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1))
    every = members.groupBy("area", "k").agg(F.count(F.lit(1)).alias("_n")).select("area", near.alias("k"), "_n").groupBy("area", "k").agg(F.ceil(F.sum("_n") / MEMBERS).cast("int").alias("_tb"))
    outside = keep(members.join(main, "area").where(F.col("comp") != F.col("_main")).drop("_main"), "outside")
    plan = keep(outside.groupBy("area", "k").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_qb")).join(every, ["area", "k"]), "plan")
    block = lambda seed, n: F.pmod(F.xxhash64("c", F.lit(seed)), F.col(n)).cast("int")
    queries = outside.join(plan, ["area", "k"]).select("area", "k", "c", "comp", F.lit(0).alias("role"), block(1, "_qb").alias("q"), F.explode(F.sequence(F.lit(0), F.col("_tb") - 1)).alias("t"))
    targets = members.select("area", "c", "comp", near.alias("k")).join(plan, ["area", "k"]).select("area", "k", "c", "comp", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)).alias("q"), block(2, "_tb").alias("t"))
    return queries.unionByName(targets).select(F.xxhash64("area", "k", "q", "t").alias("unit"), "role", "c", "comp")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id that links lead to."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first().b or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    kind = rows.schema["id"].dataType
    emit, count = _emitter(parts, to_arrow_type(kind))
    packed = rows.mapInArrow(settled(emit), f"kind int, part int, id {kind.simpleString()}, key long, h binary, c long, n long, once binary, owner binary, often binary")
    found = keep(packed.repartitionById(parts, F.col("part")).mapInArrow(settled(count), f"kind int, id {kind.simpleString()}, key long, h binary, c long, n long"), "found")

    release(spark)
    each = found.where("kind = 0").select("id", "key", "h", "c", "n")
    low = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key"))
    classes = keep(each.groupBy("h").agg(low.alias("_low"), F.max("c").alias("c"), F.max("n").alias("n")).select("h", "c", "n", F.col("_low.id").alias("first"), F.col("_low.key").alias("key")), "classes")
    counts = found.where("kind = 2").groupBy("c").agg(F.sum("n").alias("shared"))
    least = F.expr("(3 * n + 3) div 4 div 8 + 1")
    able = keep(classes.where("n > 0").join(counts, "c").where(F.col("shared") >= least).select("c", "h", "first", F.col("key").alias("_key")), "able")
    texts = rows.join(able, F.col("id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("_key"))).select("c", "h", "text")
    sets = keep(texts.mapInArrow(settled(_sets), "c long, n long, items array<long>").dropDuplicates(["c"]), "sets")

    near = sets.mapInArrow(settled(_buckets), "key long, c long, n long, items array<long>").hint("rebalance", F.col("key")).sortWithinPartitions("key")
    order = spark.sparkContext.broadcast(global_order(sets))
    comps = components(near.mapInArrow(settled(lambda batches: _join_blocks(batches, order.value)), "a long, b long"))
    comps = keep(comps, "comps")
    release(spark)
    rest = keep(_remaining(sets, comps, order), "rest")
    if rest.limit(1).count():
        comps = components(comps.select(F.col("v").alias("a"), F.col("comp").alias("b")).unionByName(rest))
    smallest = F.min(F.struct(F.col("first").isNull().alias("no"), "first"))
    named = comps.join(classes.select(F.col("c").alias("v"), "first"), "v")
    names = named.groupBy("comp").agg(smallest.alias("_s"))
    of_class = keep(comps.join(names, "comp").select(F.col("v").alias("c"), F.col("_s.first").alias("name"), F.lit(True).alias("linked")), "names")
    final = keep(classes.join(of_class, "c", "left").select("h", F.when(F.col("linked"), F.col("name")).otherwise(F.col("first")).alias("name")), "final")
    return each.join(final, "h").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose id names their component; of rows that agree in id and text, one."""
    stay = keep(linked(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("_stay")).count(), "stay")
    release(docs.sparkSession)
    ids = stay.select("_stay")
    left = docs.join(ids, docs[id_col].eqNullSafe(ids["_stay"]), "left_semi")
    return left.dropDuplicates([id_col, text_col]) if stay.where(F.col("count") > 1).limit(1).count() else left
