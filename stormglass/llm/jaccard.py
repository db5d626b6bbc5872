"""Exact Jaccard links between documents on word shingles, found with signature trees.

Two documents link when 100 * |A and B| >= percent * |A or B|, for A and B the sets of distinct
shingles (64-bit hashes). The steps:

1. *Classes.* Documents with equal sets form a class; only classes are compared.
2. *Buckets.* Let p = n - ceil(percent * n / 100) + 1 and l = (p + 1) div 2. In one order of
   all shingles (rare ones by hash, then the most frequent ones by frequency) two linked sets
   share at least the smaller l of their shingles among the first p + l - 1 of either. Those are
   the bucket keys. A class with fewer shared keys than any partner would demand has no link
   and leaves. The table of frequent shingles has a fixed size and only decides the order,
   hence the cost.
3. *Star.* Every class is compared with the bucket leader with which it shares most buckets,
   if those are as many as sets of their two sizes share at least. Links found so far are merged
   to components, so groups of near copies collapse in linear work.
4. *Groups.* Buckets that still hold several components and have the same smallest class are one
   group: near copies share dozens of buckets and are then compared in a few groups. Of the groups
   of a class the largest are left out as long as their buckets are fewer than l together: the
   smallest group that two linked sets share is kept by both.
5. *Trees.* The members of a group, sorted by size, form a tree:
   a node holds the size range and the OR of its members' shingle bitmaps. Pairs of nodes are
   walked from the root; a pair is dropped if no two of its members can overlap enough:
   overlap <= (largest n - bits set) + bits common to both nodes. Leaf pairs are bounded pair
   by pair. A big group is cut into blocks of bounded total size, and block pairs with compatible
   sizes go to different tasks, each with the full sets of its members. A surviving candidate is
   verified there at once, unless links found before in the task already joined its components;
   every other pair of components is tested, so one walk misses no link between components.

Defined cases: null or empty texts, and texts without words, have no shingles and link with
nothing; fewer words than the size are one shingle. A document with a null id is in its class
but never names a component; a component of such documents only is null. Rows with one id and
different texts are separate. Other columns are ignored by `components_of`, and kept by `apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import let_go, materialise
from . import text as T
from .columns import keeps_columns
from .graph import components

SIZE, PERCENT = 4, 85
FREQUENT = 65_536       # entries of the table that orders frequent shingles
BATCH_FREQUENT = 8      # a shingle is reported from a batch that holds it in so many documents
BLOCK = 1_024           # members of a group that go to a task together, fewer if
FULL = 4_096            # they have more shingles than this on average
LEAF, FANOUT = 32, 8
LIMIT_BROADCAST = 2_000_000  # ids broadcast to filter texts; with more, the join shuffles


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    data = T.LOWER[data]
    starts, ends, bounds = T.word_spans(data, offsets)
    words = T.byte_spans(data, starts, ends)
    h, first = T.windows(words, bounds, size)
    at = np.searchsorted(first, bounds)
    n_words = np.diff(bounds)
    whole = T.span_hashes(words, bounds[:-1], bounds[1:])
    return [np.unique(h[at[i]:at[i + 1]]) if k >= size else whole[i:i + 1] if k else h[:0]
            for i, k in enumerate(n_words.tolist())]


def _batch_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in T.text_slices(column, T.CACHE_BYTES) for s in shingle_sets(data, offsets, size)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64)
    return T.list_array(pa.array(T.signed(flat)), bounds)


def _class_id(s: np.ndarray) -> int:
    bounds = np.array([0]), np.array([len(s)])
    return int(T.signed(T.span_hashes(s, *bounds))[0])


def _frequent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = _batch_sets(batch.column(0), size)
        if sets:
            h = np.concatenate(sets)
            del sets
            h.sort()
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            often = n >= BATCH_FREQUENT
            yield pa.RecordBatch.from_pydict({"h": T.signed(h[first[often]]), "n": n[often]})


def frequent_shingles(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """The most frequent shingles, least frequent first; at most FREQUENT of them."""
    counts = docs.select(text).mapInArrow(lambda it: _frequent(it, size), "h long, n long")
    rows = (counts.groupBy("h").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "h").limit(FREQUENT).collect())
    return np.array([r[0] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def key_counts(n: int, percent: int) -> tuple[int, int]:
    """Bucket keys of a set of size n, and l: how many of them linked sets share at least."""
    p = n - (percent * n + 99) // 100 + 1
    share = (p + 1) // 2
    return min(n, p + share - 1), share


def _least_shared(n, percent: int):
    """l of a set of size n, as a Column."""
    return F.floor((n - F.ceil(n * percent / F.lit(100)) + 2) / 2)


def _least_with_any(n, percent: int):
    """l of the smallest partner of a set of size n, as a Column."""
    return _least_shared(F.ceil(n * percent / F.lit(100)), percent)


def _least_of_pair(a, b, percent: int):
    """How many bucket keys linked sets of sizes a and b share at least, as a Column.

    Of the keys of either all but n - overlap are in the other set; those of the set whose keys end
    first in the common order are among the other's keys.
    """
    def beyond(n):  # keys - n
        return F.least(n, n - F.ceil(n * percent / F.lit(100)) + _least_shared(n, percent)) - n
    return F.least(beyond(a), beyond(b)) + F.ceil((a + b) * percent / F.lit(100 + percent))


class _Order:
    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent)
        self.keys = frequent[self.rank]

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket keys of a set: rare ones, and frequent ones if the rare are too few."""
        length, _ = key_counts(len(s), percent)
        if not len(self.keys):
            return s[:length], s[:0]
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        often = self.keys[at] == s
        rare = s[~often][:length]
        rest = s[often][np.argsort(self.rank[at[often]])]
        return rare, rest[:length - len(rare)]


def _sets(batches: Iterator[pa.RecordBatch], size: int, percent: int, order: _Order
          ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, classes, prefixes, seen = batch.column(0), [], [], ([], []), set()
        for s in _batch_sets(batch.column(1), size):
            sizes.append(len(s))
            c = _class_id(s) if len(s) else None
            classes.append(c)
            # One copy in a batch is enough to fill the buckets.
            keys = order.prefix(s, percent) if len(s) and c not in seen else (s[:0], s[:0])
            for lists, part in zip(prefixes, keys):
                lists.append(part)
            seen.add(c)
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids, "n": pa.array(sizes, pa.int64()), "cls": pa.array(classes, pa.int64()),
            "rare": _lists(prefixes[0]), "often": _lists(prefixes[1])})


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(cls, shingles) of each document that has shingles."""
    for batch in batches:
        sets = [x for x in _batch_sets(batch.column(0), size) if len(x)]
        yield pa.RecordBatch.from_pydict({"cls": pa.array([_class_id(x) for x in sets], pa.int64()),
                                          "shingles": _lists(sets)})


def _fits(a, b, percent: int):
    """Sizes that may link: the smaller is at least `percent` of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def bitmap_bytes(n: int) -> int:
    """Bytes of the bitmap of a set of n: a power of two, at least four bits a shingle."""
    return max(32, 1 << (max(1, n) - 1).bit_length() >> 1)


def bitmap(s: np.ndarray) -> bytes:
    width = bitmap_bytes(len(s)) * 8
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class _Members:
    """Members of one or two blocks of a group, with their bitmaps at any smaller width.

    rows: (component, shingles). Components are merged as links are found.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.comp = np.array([r[0] for r in rows], dtype=np.int64)
        self.sets = [r[1] for r in rows]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.own = [np.frombuffer(bitmap(s), dtype=np.uint64) for s in self.sets]
        self._cache: dict[tuple, np.ndarray] = {}

    def bits(self, ids: tuple[int, int], width: int) -> np.ndarray:
        """Bitmaps of rows ids[0] .. ids[1] - 1 folded to `width` bytes, as 64-bit words."""
        key = (*ids, width)
        if key not in self._cache:
            out = []
            for b in self.own[ids[0]:ids[1]]:
                while b.nbytes > width:
                    b = b[:len(b) // 2] | b[len(b) // 2:]
                out.append(b)
            self._cache[key] = np.stack(out)
        return self._cache[key]


class _Node:
    """A range of members: size range, OR of bitmaps, and most shingles hidden by equal bits."""

    def __init__(self, m: _Members, lo: int, hi: int, children: list[_Node]):
        self.lo, self.hi, self.children = lo, hi, children
        self.least, self.most = int(m.n[lo]), int(m.n[hi - 1])
        self.width = bitmap_bytes(self.least)
        own = m.bits((lo, hi), self.width)
        self.bits = np.bitwise_or.reduce(own, axis=0)
        self.hidden = int((m.n[lo:hi] - np.bitwise_count(own).sum(axis=1)).max())


def _tree(m: _Members, lo: int, hi: int) -> _Node:
    """The tree over members lo .. hi - 1, which are sorted by size."""
    level = [_Node(m, a, min(a + LEAF, hi), []) for a in range(lo, hi, LEAF)]
    while len(level) > 1:
        level = [_Node(m, level[a].lo, level[min(a + FANOUT, len(level)) - 1].hi, level[a:a + FANOUT])
                 for a in range(0, len(level), FANOUT)]
    return level[0]


def _need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def _may_link(a: _Node, b: _Node, percent: int) -> bool:
    if min(a.most, b.most) * 100 < max(a.least, b.least) * percent:
        return False
    if a.width != b.width:  # hidden shingles are counted at a node's own width
        return True
    common = int(np.bitwise_count(a.bits & b.bits).sum())
    return min(a.hidden, b.hidden) + common >= _need(a.least, b.least, percent)


def _leaf_pairs(m: _Members, a: _Node, b: _Node, percent: int):
    """Pairs (i, j) of two leaves that may link, those of the largest bound on the overlap first."""
    width = min(a.width, b.width)
    x, y = m.bits((a.lo, a.hi), width), m.bits((b.lo, b.hi), width)
    n, k = m.n[a.lo:a.hi, None], m.n[None, b.lo:b.hi]
    bound = np.minimum(n - np.bitwise_count(x[:, None, :] & ~y[None, :, :]).sum(axis=2),
                       k - np.bitwise_count(~x[:, None, :] & y[None, :, :]).sum(axis=2))
    ok = (bound >= _need(n, k, percent)) & (m.comp[a.lo:a.hi, None] != m.comp[None, b.lo:b.hi])
    if a is b:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    best = np.argsort(-bound[i, j], kind="stable")
    return zip((i[best] + a.lo).tolist(), (j[best] + b.lo).tolist())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def tree_links(rows: list[tuple[int, np.ndarray]], split: int, percent: int) -> list[tuple[int, int]]:
    """Links (component, smaller component) that join the components of a group as far as any do.

    rows: (component, shingles), sorted by the number of shingles in rows[:split] and in
    rows[split:]; with split = 0 all pairs inside are compared, else all pairs across.
    """
    m = _Members(rows)
    stack = ([(_tree(m, 0, split), _tree(m, split, len(rows)))] if split
             else [(t, t) for t in [_tree(m, 0, len(rows))]])
    found = []
    while stack:
        a, b = stack.pop()
        one = m.comp[a.lo]
        if (m.comp[a.lo:a.hi] == one).all() and (m.comp[b.lo:b.hi] == one).all():
            continue
        if not _may_link(a, b, percent) and a is not b:
            continue
        if a.children or b.children:
            left, right = a.children or [a], b.children or [b]
            stack += [(x, y) for p, x in enumerate(left) for q, y in enumerate(right) if a is not b or p <= q]
            continue
        for i, j in _leaf_pairs(m, a, b, percent):
            if m.comp[i] != m.comp[j] and linked(m.sets[i], m.sets[j], percent):
                low, high = sorted((int(m.comp[i]), int(m.comp[j])))
                m.comp[m.comp == high] = low
                found.append((high, low))
    return found


def _walk(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (leader, i, j), side and size; one tree walk for each task."""
    key, rows, split, out = None, [], 0, []

    def close():
        return tree_links(rows, split, percent) if len(rows) > 1 and (key[1] == key[2] or split) else []

    def batch_of(links):
        return pa.RecordBatch.from_pydict({name: pa.array([x[at] for x in links], pa.int64())
                                           for at, name in enumerate(("u", "v"))})

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("leader", "i", "j", "side", "comp")]
        lists = batch.column("shingles")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for r, (leader, i, j, side, comp) in enumerate(zip(*cols)):
            if (leader, i, j) != key:
                out += close() if key else []
                key, rows, split = (leader, i, j), [], 0
            if side == 1 and not split:
                split = len(rows)
            rows.append((comp, flat[at[r]:at[r + 1]]))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    out += close() if key else []
    yield batch_of(out)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the full sets."""
    pairs = materialise(pairs, "pairs")
    # Only the sets that a pair names are moved; each side is told apart before its join.
    x, y = (full.toDF(c, s).join(pairs.select(c).distinct(), c, "left_semi") for c, s in (("a", "x"), ("b", "y")))
    both = (pairs.join(x, "a").join(y, "b")
            .select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"),
                    (F.size("x") + F.size("y")).alias("all")))
    return (both.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both")))
            .select("a", "b").distinct())


def _held_by_several(keys: DataFrame, by: str) -> DataFrame:
    """The distinct rows of keys held by several values of `by`, whatever the size of a bucket."""
    buckets = (keys.groupBy("token").agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
               .filter("lo < hi").select("token"))
    return keys.join(buckets, "token", "left_semi").distinct()


def _rare_held_by_several(keys: DataFrame) -> DataFrame:
    """The same for classes and keys outside the table of frequent ones, in one shuffle.

    A bucket of these is small. Sorted by class, the last row of a class stays if another
    class comes before or after; no row is buffered.
    """
    row = Window.partitionBy("token").orderBy("cls")
    near = keys.withColumns({"_next": F.lead("cls").over(row),
                             "_first": F.first("cls").over(row.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.col("_next").isNull() | (F.col("_next") != F.col("cls"))
    other = F.col("_next").isNotNull() | (F.col("_first") != F.col("cls"))
    return near.filter(last & other).drop("_next", "_first")


def _shared(shared: DataFrame, percent: int) -> DataFrame:
    """The rows (token, cls, n, ..) of classes with enough keys; each key is held by several."""
    enough = (shared.groupBy("cls").agg(F.count("*").alias("k"), F.min("n").alias("n"))
              .filter(F.col("k") >= _least_with_any(F.col("n"), percent)).select("cls"))
    return shared.join(enough, "cls", "left_semi")


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of classes with their component so far."""
    return rows.join(comps.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _groups(live: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(leader, cls, n, comp, block): the groups of buckets that hold several components."""
    members = _placed(live.select("token", "cls", "n"), comps)
    buckets = (members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                            F.min("cls").alias("leader")).filter("lo < hi").select("token", "leader"))
    held = materialise(members.join(buckets, "token").groupBy("leader", "cls").agg(
        F.count("*").alias("k"), F.min("n").alias("n"), F.min("comp").alias("comp")), "groups")
    sizes = held.groupBy("leader").agg(F.count("*").alias("size"))
    larger = (Window.partitionBy("cls").orderBy(F.desc("size"), F.desc("leader"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = materialise(held.join(sizes, "leader").withColumn("k", F.sum("k").over(larger))
                       .filter(F.col("k") >= _least_with_any(F.col("n"), percent)).drop("k", "size"), "groups")
    several = (held.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .filter("lo < hi").select("leader"))
    place = (Window.partitionBy("leader").orderBy("n", "comp", "cls")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.sum(F.greatest("n", F.lit(FULL))).over(place)
    return materialise(held.join(several, "leader", "left_semi").withColumn(
        "block", F.floor((room - 1) / (BLOCK * FULL))), "members")


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(leader, i, j) of the pairs of blocks of a group whose sizes may link."""
    blocks = members.groupBy("leader", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = blocks.toDF("leader", "i", "least_i", "most_i"), blocks.toDF("leader", "j", "least_j", "most_j")
    return left.join(right, "leader").filter(
        (F.col("i") <= F.col("j")) & (F.col("most_i") * 100 >= F.col("least_j") * percent)).select("leader", "i", "j")


def _tree_tasks(members: DataFrame, tasks: DataFrame, full: DataFrame) -> DataFrame:
    """The members of both blocks of each task (leader, i, j), with components and sets."""
    sides = tasks.select("leader", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(
        tasks.filter("i < j").select("leader", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    return members.join(sides, ["leader", "block"]).join(full, "cls").select(
        "leader", "i", "j", "side", "cls", "n", "comp", "shingles")


def link_classes(docs: DataFrame, text: str, doc_id: str, size: int = SIZE, percent: int = PERCENT
                 ) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document, and (node, component) of the linked classes."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(_Order(frequent_shingles(docs, "text", size)))
    sets = materialise(docs.mapInArrow(
        lambda it: _sets(it, size, percent, order.value),
        "doc_id long, n long, cls long, rare array<long>, often array<long>"), "sets")

    rare, often = (sets.select("cls", "n", F.explode(c).alias("token")) for c in ("rare", "often"))
    shared = materialise(_rare_held_by_several(rare).unionByName(_held_by_several(often, "cls")), "shared")
    let_go(spark)  # the shuffle of all keys is the largest one
    live = materialise(_shared(shared, percent), "live")
    # Fewer classes, so fewer shared keys.
    live = materialise(_shared(materialise(_held_by_several(live, "cls"), "shared"), percent), "live")
    let_go(spark)

    leaders = live.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("l")).select(
        "token", F.col("l.cls").alias("leader"), F.col("l.n").alias("leader_n"))
    star = (live.join(leaders, "token")
            .filter((F.col("cls") != F.col("leader")) & _fits(F.col("n"), F.col("leader_n"), percent))
            .groupBy("cls", "leader").agg(F.count("*").alias("shared"), F.min("n").alias("n"),
                                          F.min("leader_n").alias("leader_n"))
            .filter(F.col("shared") >= _least_of_pair(F.col("n"), F.col("leader_n"), percent))
            .groupBy("cls").agg(F.max(F.struct("shared", "leader")).alias("best"))
            .select(F.col("cls").alias("a"), F.col("best.leader").alias("b")))
    needed = materialise(
        sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        .join(live.select("cls").distinct(), "cls").select("doc_id").distinct(), "needed")
    if needed.count() <= LIMIT_BROADCAST:
        needed = F.broadcast(needed)
    texts = docs.join(needed.withColumnRenamed("doc_id", "_id"),
                      F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    full = texts.mapInArrow(lambda it: _full_sets(it, size), "cls long, shingles array<long>")
    full = full.join(live.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    full = materialise(full, "full")
    let_go(spark)

    links = materialise(_verified(star, full, percent), "links")
    comps = materialise(components(links.toDF("u", "v")), "components")
    members = _groups(live, comps, percent)
    let_go(spark)
    walked = materialise(
        _tree_tasks(members, _block_pairs(members, percent), full)
        .repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side", "n", "cls")
        .mapInArrow(lambda it: _walk(it, percent), "u long, v long"), "walked")
    if walked.limit(1).count():
        comps = materialise(components(comps.toDF("u", "v").union(walked)), "components")
    return sets.select("doc_id", "n", "cls"), comps


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    sets, comps = link_classes(docs, text, doc_id, size, percent)
    placed = sets.join(comps.toDF("cls", "component"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    names = (placed.filter("component IS NOT NULL").groupBy("component")
             .agg(F.min("doc_id").alias("component_id")))
    return placed.join(names, "component", "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@keeps_columns("_row")
def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE,
          percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest (id, row), with all its columns.

    Rows are told apart by a written number, so rows that repeat an id are separate documents and
    rows without an id take part; those come after all ids. Rows without shingles are kept, one
    for each id, and all that have no id.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sets, comps = link_classes(rows, text, "_row", size, percent)
    placed = (sets.withColumnRenamed("doc_id", "_row").join(comps.toDF("cls", "component"), "cls", "left")
              .select("_row", F.coalesce("component", "cls").alias("_component"))
              .join(rows.select("_row", F.col(doc_id).alias("_id")), "_row"))
    alone = F.when(F.col("_component").isNull(), F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("row "), "_row")))
    stay = placed.groupBy("_component", alone.alias("_alone")).agg(
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")).alias("_first")).select("_first._row")
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)
