"""N-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one class,
known by a hash of the set. A forest of signature trees covers the classes, and a dual traversal walks
pairs of its nodes from the top, dropping every pair whose largest possible overlap is too small:

* Roots are size ranges that grow by 1 / threshold, so sets that may link lie in the same range or in
  neighbouring ones; other pairs of roots are dropped.
* Below a root the hash space is cut into a few regions more than linked sets of that size can have tokens
  that differ. A set that fills more regions than it can have differing tokens agrees with any linked set on all tokens
  of a filled region at least. A node per region and content holds the classes that agree there; pairs of different nodes
  are dropped. What is left are pairs inside one node, found by one shuffle by node. Frequent passages do no harm, as a
  node needs a whole region.
* Classes that links already connect form a child of their nodes. Children hold OR-combined token bitmaps and
  size ranges of all their classes; children that share nodes are paired once. Pairs of children, then of a class and a child,
  then of two classes are dropped by these bounds, and the rest is compared exactly, token set by token set.

To spare comparisons inside large groups, rounds first compare the classes of each node with one hub, another hub
in each round, and connect what links. The traversal then takes every pair that is still unconnected. The
result is exact for components: a pair is left out only if its bound is too small or it is connected already.

A set that fills too few regions is cut again with another hash until it fills enough. Of two linked sets the one that is content
first shares a filled region with the other, which has been cut in the same ways up to there. So no pair rests on chance, at any size.

Defined cases: null and empty texts have an empty set and link with nothing; a text with fewer words than a shingle is one
shingle; repeated rows share a class and are each returned; a row with a null id gets a null component and lends no link; an
empty table gives an empty result; an input column named like a result is replaced.
"""

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.llm.graph import components
from tagmill.storage import as_lookup, cleared_shuffles, lasting, lookup_join, settle, temporary

# 64-bit words of a bitmap, which is kept once per class; sparse for most sets, so that the bounds are tight.
BITMAP = 16
# Words that a worker remembers; all its tasks share them.
MOST_KEPT = 100_000
ROUNDS = 6


class Likeness(NamedTuple):
    """Words per shingle and the least Jaccard similarity, in percent."""

    words: int = 5
    percent: int = 80


class WordHashes(dict):
    """Hashes of words, remembered; emptied before it grows large."""

    def __missing__(self, word):
        if len(self) > MOST_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mix(x):
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text, lower-cased in A-Z."""
    words = raw.lower().split() if raw else []  # for bytes, both know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    value = np.full(count, width, np.uint64)
    for place in range(width):
        value = mix(value + codes[place : place + count])
    return np.unique(value)


def class_of(tokens: np.ndarray) -> int:
    """One 64-bit number per set (signed)."""
    spread = mix(tokens)
    both = np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(tokens), len(tokens)], np.uint64)
    for part in (1, 2):
        both[0] = mix(both[:1] + both[part : part + 1])[0]
    return int(both[:1].view(np.int64)[0])


class Ranges:
    """Size ranges, and how many regions each needs."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("the similarity must be above 50 percent")
        self.percent, self.starts, self.cuts = percent, [1], {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return bisect.bisect_right(self.starts, size) - 1

    def differing(self, size: int, index: int) -> int:
        """Most tokens in which a set of ``size`` and a linked one differ, neither larger than the range allows."""
        return min(size * (100 - self.percent) // self.percent, (100 - self.percent) * 2 * (self.starts[index + 1] - 1) // (100 + self.percent))

    def regions(self, index: int) -> int:
        """Regions of a range: so many that sets of all its sizes mostly fill more than they can differ in; 1 if only equal sets link."""
        if index not in self.cuts:
            while len(self.starts) < index + 2:
                self.starts.append(self.starts[-1] * 100 // self.percent + 1)
            largest = self.starts[index + 1] - 1
            regions = self.differing(largest, index) + 1
            if regions > 1:
                # Fewest tokens to spare: the smallest size, or the one from which on the range bounds what can differ.
                bounded = -(-self.differing(largest, index) * self.percent // (100 - self.percent))
                sizes = (self.starts[index], min(bounded, largest))
                while not all(self.filled(n, regions) > self.differing(n, index) for n in sizes) and regions < 2 * largest:
                    regions += 1 + regions // 32
            self.cuts[index] = regions
        return self.cuts[index]

    @staticmethod
    def filled(size: int, regions: int) -> float:
        """Regions that a set fills, less two deviations."""
        one, two = (1 - 1 / regions) ** size, max(1 - 2 / regions, 0.0) ** size
        spread = max(regions * one + regions * (regions - 1) * two - (regions * one) ** 2, 0.0)
        return regions * (1 - one) - 2 * spread**0.5


def node_keys(tokens: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Keys of the tree nodes that a set belongs to, in its own size range and the next."""
    found, own = [], ranges.of(len(tokens))
    for index in (own, own + 1):
        regions = ranges.regions(index)
        if regions == 1:
            continue
        wanted = ranges.differing(len(tokens), index) + 1
        edges = (np.arange(1, regions, dtype=np.float64) * (2.0**64 / regions)).astype(np.uint64)
        cut, full = 0, 0
        while full < wanted:
            ordered = tokens if not cut else np.sort(mix(tokens + np.uint64(cut)))
            ends = np.concatenate(([0], np.searchsorted(ordered, edges), [len(ordered)]))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ordered ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
            filled = ends[1:] > ends[:-1]
            place = mix(np.arange(1, regions + 1, dtype=np.uint64) + np.uint64(index << 40)) + mix(np.array([cut], np.uint64))
            found.append(mix(mix(sums[ends[1:]] - sums[ends[:-1]]) + place)[filled])
            cut, full = cut + 1, int(filled.sum())
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def described(docs: DataFrame, likeness: Likeness, text: str, with_keys: bool = False) -> DataFrame:
    """``doc``, the size ``n`` of its set, its class ``c`` (null for an empty set) and, on request, the ``keys`` of its tree nodes."""

    @F.arrow_udf("struct<n:bigint,c:bigint" + (",keys:array<bigint>>" if with_keys else ">"))
    def describe(raw: pa.Array) -> pa.Array:
        ranges, sizes, classes, found = Ranges(likeness.percent), [], [], []
        for value in raw:
            tokens = shingle_set(value.as_py(), likeness.words)
            sizes.append(len(tokens))
            classes.append(class_of(tokens) if len(tokens) else None)
            if with_keys:
                found.append(node_keys(tokens, ranges) if len(tokens) else tokens)
        columns = [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())]
        if with_keys:
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in found]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate([np.empty(0, np.uint64), *found]))))
        return pa.StructArray.from_arrays(columns, names=["n", "c", "keys"][: len(columns)])

    rows = packed(docs).withColumn("d", describe(F.col("doc").getField(text).cast("binary")))
    return rows.select("doc", "d.*")


def profiles(docs: DataFrame, likeness: Likeness, text: str) -> DataFrame:
    """``c``, size, token set, and its bitmap (``b0``...) with the count of its bits."""

    def profile(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [shingle_set(v.as_py(), likeness.words) for v in batch.column(0)[start : start + 256]]
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                maps = np.zeros((len(sets), BITMAP), np.uint64)
                for row, tokens in enumerate(sets):
                    place = tokens % np.uint64(64 * BITMAP)
                    np.bitwise_or.at(maps[row], place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_of(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate(sets))),
                        *[signed(np.ascontiguousarray(maps[:, i])) for i in range(BITMAP)],
                    ],
                    names=["c", "n", "tokens", *[f"b{i}" for i in range(BITMAP)]],
                )

    schema = "c bigint, n bigint, tokens array<bigint>, " + ", ".join(f"b{i} bigint" for i in range(BITMAP))
    rows = docs.select(F.col(text).cast("binary").alias("raw")).mapInArrow(profile, schema)
    return rows.withColumn("bits", sum((F.bit_count(f"b{i}") for i in range(BITMAP)), F.lit(0)))


def enough(overlap, a_size, b_size, percent):
    """Whether an overlap makes sets of these sizes similar enough."""
    return overlap * 100 >= (a_size + b_size - overlap) * percent


def linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by their whole token sets. Only sets that the pairs name are shuffled; few pairs
    are broadcast, so that the sets move only once."""
    pairs, small = as_lookup(pairs, "pairs")
    known = F.broadcast if small else lambda ids: ids

    def side(name):
        own = tokens.join(known(pairs.select(F.col(name).alias("c")).distinct()), "c", "left_semi")
        return own.select(F.col("c").alias(name), F.col("n").alias(f"{name}_n"), F.col("tokens").alias(f"{name}_tokens"))

    both = side("a").join(known(pairs), "a").join(side("b"), "b")
    fits = enough(F.least("a_n", "b_n"), F.col("a_n"), F.col("b_n"), percent)
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(fits).where(enough(overlap, F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def pair_of(left, right):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def with_components(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return shared.withColumn("component", F.col("c"))
    rows = shared.join(found.withColumnRenamed("node", "c"), "c", "left")
    return rows.withColumn("component", F.coalesce("component", "c"))


def scored(shared: DataFrame) -> DataFrame:
    """Add the number of meetings of a class: the classes it meets, summed over its nodes.

    What others were copied from shares more with each copy than two copies share.
    """
    met = shared.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return shared.join(met.groupBy("c").agg(F.sum("met").alias("met")), "c")


def hub_pairs(shared: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """Each class with the hub of its node, where links do not connect them yet.

    The first hub is the class with most meetings, later ones are drawn by hash.
    """
    rank = F.xxhash64("c", F.lit(turn)) if turn else -F.col("met")
    order = F.struct(rank.alias("o"), "c", "component")
    rows = with_components(shared, found).withColumn("hub", F.min(order).over(Window.partitionBy("key")))
    return rows.where(F.col("component") != F.col("hub.component")).select(*pair_of(F.col("c"), F.col("hub.c"))).distinct()


def possible(a, b, percent):
    """Whether two nodes may hold linked classes: the tokens of one that lie outside the
    bits of the other bound the overlap, and so do the sizes."""
    common = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.col(f"{b}.b{i}"))) for i in range(BITMAP)), F.lit(0))
    both = F.col(f"{a}.least") + F.col(f"{b}.least")
    # The least overlap of linked sets, and by how much the bits in common must exceed it: the long sum stands once.
    needed = F.ceil(F.greatest(F.col(f"{a}.least") * percent / 100, F.col(f"{b}.least") * percent / 100, both * percent / (100 + percent)))
    spare = F.greatest(F.col(f"{a}.bits") - F.col(f"{a}.most"), F.col(f"{b}.bits") - F.col(f"{b}.most"))
    return (F.least(f"{a}.most", f"{b}.most") >= needed) & (common >= needed + spare)


def leaves(maps: DataFrame) -> DataFrame:
    """Classes as the lowest nodes of the tree."""
    return maps.withColumn("least", F.col("n")).withColumnRenamed("n", "most")


def plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose bounds leave a link possible; their token sets are not needed for that."""
    side, x, y = leaves(maps), F.col("x.c") == F.col("p.a"), F.col("y.c") == F.col("p.b")
    both = pairs.alias("p").join(side.alias("x"), x).join(side.alias("y"), y & possible("x", "y", percent))
    return both.select("p.a", "p.b")


def traversed(shared: DataFrame, found: DataFrame | None, maps: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes whose groups of linked classes share a node, and that may be similar enough.

    Two groups share many nodes when their texts are alike, but are paired once, and so are their classes.
    """
    rows = with_components(shared, found)
    spread = Window.partitionBy("key")
    open_ = rows.withColumn("lo", F.min("component").over(spread)).withColumn("hi", F.max("component").over(spread))
    open_ = settle(open_.where("lo <> hi").select("key", "component", "c"), "open")
    members = settle(leaves(maps).join(open_.select("c", "component").distinct(), "c"), "members")
    ors = [F.bit_or(f"b{i}").alias(f"b{i}") for i in range(BITMAP)]
    sizes = [F.min("least").alias("least"), F.max("most").alias("most"), F.min("bits").alias("bits"), F.count(F.lit(1)).alias("rows")]
    children = settle(members.groupBy("component").agg(*sizes, *ors), "children")
    nodes = open_.select("key", "component").distinct().join(children, "component")
    # Of two children the smaller one is opened first, so that its classes meet the other as a whole.
    smaller = F.expr("struct(x.rows, x.component) < struct(y.rows, y.component)")
    top = nodes.alias("x").join(nodes.alias("y"), (F.col("x.key") == F.col("y.key")) & smaller & possible("x", "y", percent))
    top = settle(top.select(F.col("x.component").alias("p"), F.col("y.component").alias("q")).distinct(), "top")
    x, y = F.col("x.component") == F.col("t.p"), F.col("y.component") == F.col("t.q")
    opened = top.alias("t").join(members.alias("x"), x).join(children.alias("y"), y & possible("x", "y", percent))
    opened = settle(opened.select("x.c", "t.q"), "opened")
    x, y = F.col("x.c") == F.col("t.c"), F.col("y.component") == F.col("t.q")
    met = opened.alias("t").join(members.alias("x"), x).join(members.alias("y"), y & possible("x", "y", percent))
    return met.select(*pair_of(F.col("x.c"), F.col("y.c")))


def linked_classes(docs: DataFrame, sets: DataFrame, classes: DataFrame, likeness: Likeness, text: str, ident: str) -> DataFrame | None:
    """``node, component`` of all classes that link with another; None if there is no link. ``sets`` has ``id, c, keys``."""
    spread = Window.partitionBy("key")
    keys = sets.where("c IS NOT NULL AND id IS NOT NULL").select(F.explode("keys").alias("key"), "c")
    keys = keys.withColumn("lo", F.min("c").over(spread)).withColumn("hi", F.max("c").over(spread))
    shared = settle(keys.where("lo <> hi").select("key", "c").distinct(), "nodes")
    shared = settle(scored(shared), "nodes")
    wanted = shared.select("c").distinct().join(classes, "c").select(F.col("first").alias("_first"))
    texts = docs.select(F.col(ident).alias("_first"), F.col(text).alias("text"))
    tokens = settle(profiles(lookup_join(texts, wanted, "_first", "left_semi"), likeness, "text"), "profiles")
    if tokens.count() > tokens.select("c").distinct().count():  # rows repeated under one id: one profile per class
        tokens = settle(tokens.dropDuplicates(["c"]), "profiles")
    maps = tokens.drop("tokens")
    links, found = None, None
    for turn in range(ROUNDS):
        pairs = settle(hub_pairs(shared, found, turn), "pairs")
        likely = settle(plausible(pairs, maps, likeness.percent), "likely")
        fresh = settle(linked(likely, tokens, likeness.percent), "links")
        tried, gained = pairs.count(), fresh.count()
        if gained:
            links = fresh if links is None else links.union(fresh)
            found = components(links)
        if gained * 20 <= tried:
            break
    rest = settle(traversed(shared, found, maps, likeness.percent), "pairs")
    fresh = settle(linked(rest, tokens, likeness.percent), "links")
    if not fresh.isEmpty():
        links = fresh if links is None else links.union(fresh)
        found = components(links)
    return found


def near_duplicates(docs: DataFrame, likeness: Likeness = Likeness(), text="text", ident="doc_id", keep_text=True, keep_class=False) -> DataFrame:
    """All input columns with ``n_shingles`` and ``component_id``, the least id reachable by links.

    Without ``keep_text`` the text is left out, and the other columns are written once. With ``keep_class``, ``class_key`` is
    the class of the row's set and ``component_key`` the key of its group of linked classes (both null for an empty set). Groups of
    unrelated texts have different keys, also where their ids clash.
    """
    ident_of = F.col("doc").getField(ident)
    rows = described(docs, likeness, text, with_keys=True).withColumn("id", ident_of)
    if keep_text:
        # The texts are hashed again for the keys and at the end, which takes less disk than a copy of either.
        keyed, rows = rows, described(docs, likeness, text).withColumn("id", ident_of)
        sets = settle(rows.select("id", "n", "c"), "sets")
    else:
        keyed = settle(rows.withColumn("doc", F.col("doc").dropFields(text)), "sets")
        rows = sets = keyed.drop("keys")
    with temporary(docs.sparkSession, "join"), cleared_shuffles(docs.sparkSession):
        classes = sets.where("c IS NOT NULL AND id IS NOT NULL").groupBy("c").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        classes = settle(classes, "classes")
        found = linked_classes(docs.where(F.col(ident).isNotNull()), keyed, classes, likeness, text, ident)
        if found is None:
            grouped = classes.withColumn("component", F.col("c")).withColumn("component_id", F.col("first"))
        else:
            joined = classes.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
            least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
            grouped = joined.join(least, "component")
        # Other documents are their own component.
        needed = "copies > 1 OR component_id <> first" + (" OR component <> c" if keep_class else "")
        with lasting():
            moved = settle(grouped.where(needed).select("c", "component", "component_id"), "moved")
    out = lookup_join(rows, moved, "c", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.withColumn("component_id", own).withColumnRenamed("n", "n_shingles")
    out = out.withColumn("component_key", F.coalesce("component", "c")).withColumnRenamed("c", "class_key")
    return unpacked(out, ["n_shingles", "component_id", *(["class_key", "component_key"] if keep_class else [])])
