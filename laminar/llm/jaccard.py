"""N-gram Jaccard join of documents by signature trees.

Sets of equal shingles are one set, known by a 64-bit hash of its shingles. The root of the forest deals sets to families by keys that any linked pair must
share: shingles are dealt to parts by hash, and two sets that differ in at most D shingles agree on one of D + 1 parts. Below
EXACT, where parts would become as many as shingles, the root deals by bands of minima instead, which miss a pair at the
threshold with a probability of MISSED at most.
Members of a large family are first compared with a few representatives of it; what links with one is settled, and only leaves
that no representative has joined are compared with each other. Families are split into leaves by hash within a size range;
a unit is a pair of leaves. In it, a tree over each leaf holds OR-combined shingle bitmaps and size ranges at every level,
a dual traversal drops node pairs whose largest possible overlap is too small, level after level, and what is left
is compared shingle by shingle unless it is connected already.

Null or empty texts and those without words have an empty set and link with nothing. Rows of equal sets link, repeated
rows included; rows that share a doc_id are judged each by its own text; rows without a doc_id count as one document that comes last and shows
a null component only where it links with no other. Other columns, clashing names included, play no part.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import NO_ID, WORD_BASE, fresh, keyed, mix, prefix, signed, span_hash, steps, unkeyed, word_hashes, written
from laminar.operators.components import components, with_least

#: Words of a shingle; link when 100 * intersection >= THRESHOLD * union.
WORDS, THRESHOLD = 3, 90
#: Size classes grow by this factor; sets in a leaf; children of a node of a leaf's tree; representatives of a family
#: that is larger than a leaf.
CLASS, LEAF, FAN, REPRESENTATIVES = 1.5, 256, 4, 3
#: From this threshold on keys are exact; below it, minima in a band, and the probability that all bands miss a pair.
EXACT, ROWS, MISSED = 90, 5, 1e-4


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, sorted in each text, and where each text's begin."""
    hashes, first = word_hashes(texts, lower=True)
    n_words = np.diff(first)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    of = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(of)) - (np.cumsum(n) - n)[of] + first[of]
    end = np.minimum(start + words, first[of + 1])
    sums = prefix(hashes, WORD_BASE)
    shingle = mix(span_hash(sums, start, end, WORD_BASE) + (end - start).astype(np.uint64)) if len(of) else np.zeros(0, np.uint64)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
    shingle, of = shingle[new], of[new]
    return shingle, np.searchsorted(of, np.arange(len(texts) + 1))


def bounds(n: int) -> list[int]:
    """Upper ends of the size classes up to the one of a set of n."""
    out = [16]
    while out[-1] <= n:
        out.append(int(out[-1] * CLASS) + 1)
    return out


def most_apart(size: int, threshold: int) -> int:
    """Shingles that are in one of two linked sets only, at most, if both have fewer than `size`."""
    return 2 * (size - 1) * (100 - threshold) // (100 + threshold)


@lru_cache(4096)
def parts_of(size: int, threshold: int) -> int:
    """Parts for a class of sets below `size`: more than most_apart and the empty parts that its smallest set has, so
    that two linked sets agree on a part that is not empty."""
    apart = most_apart(size, threshold)
    least, parts = threshold / 100 * size / CLASS, apart + 2
    while parts - apart <= 2 + 1.3 * parts * exp(-least / parts):
        parts += max(1, apart // 20)
    return parts


def keys_of(shingles: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of which two linked, different sets share one. Sets near the end of their size class have the next one's too.

    A set with so many empty parts that all parts it agrees on might be empty has keys for them as well."""
    n, out = len(shingles), []
    if 100 * n < threshold * (n + 1):  # too few shingles to link with any other set
        return np.zeros(0, np.uint64)
    ends = bounds(n)
    classes = [ends[-1]]
    if 100 * n >= threshold * ends[-1]:
        classes.append(int(ends[-1] * CLASS) + 1)
    for size in classes:
        if not (apart := most_apart(size, threshold)):
            continue
        parts = parts_of(size, threshold)
        part = (mix(shingles ^ np.uint64(size)) % np.uint64(parts)).astype(np.int64)
        empty = np.bincount(part, minlength=parts) == 0
        with np.errstate(over="ignore"):
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, shingles)
            key = mix(sums + mix(np.uint64(size) * np.uint64(1_000_003) + np.arange(parts, dtype=np.uint64)))
        out.append(key if empty.sum() >= parts - apart else key[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray, first: np.ndarray, threshold: int) -> np.ndarray:
    """One row of keys a set: each hashes ROWS minima of the set under as many hash functions."""
    bands = int(np.ceil(log(MISSED) / log(1 - (threshold / 100) ** ROWS)))
    out = np.zeros((len(first) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(first))  # sets too small to link are left out by the caller
    if not len(full):
        return out
    factors = mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(factors):
            least = np.minimum.reduceat(shingles * factor, first[full])
            out[full, k // ROWS] = mix(out[full, k // ROWS] + mix(least + np.uint64(k + 1)))
    return out


def _sets(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Size, two hashes and keys of every document's set."""

    def make(batches):
        for whole in batches:
            for batch in steps(whole):
                shingles, first = shingle_sets(batch.column("text"), words)
                n = np.diff(first)
                a, b = _hashes(shingles, first)
                if threshold >= EXACT:
                    keys = [signed(keys_of(shingles[i:j], threshold)) for i, j in zip(first[:-1], first[1:])]
                else:
                    keys = [signed(k[: len(k) * bool(100 * m >= threshold * (m + 1))]) for k, m in zip(band_keys(shingles, first, threshold), n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array(n.astype(np.int64)), pa.array(signed(a)), pa.array(signed(b)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_key", "n", "a", "b", "keys"])

    return docs.mapInArrow(make, "doc_key long, n long, a long, b long, keys array<long>")


def _hashes(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set."""
    with np.errstate(over="ignore"):
        a = np.r_[np.uint64(0), np.cumsum(mix(shingles))]
        b = np.r_[np.uint64(0), np.cumsum(mix(shingles ^ np.uint64(0x5BD1E995)))]
        return mix(a[first[1:]] - a[first[:-1]]), mix(b[first[1:]] - b[first[:-1]])


def _with_shingles(members: DataFrame, words: int) -> DataFrame:
    """members (with a) and the sorted shingle hashes of the texts whose set has that hash a."""
    names = [c for c in members.columns if c != "text"]

    def make(batches):
        for whole in batches:
            for batch in steps(whole):
                shingles, first = shingle_sets(batch.column("text"), words)
                mine = signed(_hashes(shingles, first)[0]) == batch.column("a").to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(shingles)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "shingles"]).filter(pa.array(mine))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name != "text")
    return members.mapInArrow(make, f"{kinds}, shingles array<long>")


class Tree:
    """One leaf's sets, ordered by their smallest shingles, under levels of nodes with FAN children each, up to a root.

    Level 0 are the sets themselves. A node holds the OR of its sets' bitmaps, their least and largest size, and the
    most shingles that any of them has beyond its bits."""

    def __init__(self, sets: list[np.ndarray], at: np.ndarray, words: int):
        self.at = np.array(sorted(at, key=lambda i: (int(sets[i][0]), len(sets[i]))))
        bits = words * 64
        size = np.array([len(sets[i]) for i in self.at])
        flat = np.zeros((len(self.at), bits), bool)
        for row, i in enumerate(self.at):
            flat[row, (sets[i] % np.uint64(bits)).astype(np.int64)] = True
        bitmap = np.packbits(flat, axis=1).view(np.uint64)
        #: (bitmap, least size, largest size, slack) of every node, a level a tuple.
        self.levels = [(bitmap, size, size, size - np.bitwise_count(bitmap).sum(1).astype(np.int64))]
        while len(self.levels[-1][0]) > 1:
            union, low, high, slack = self.levels[-1]
            begin = np.arange(0, len(union), FAN)
            self.levels.append((np.bitwise_or.reduceat(union, begin, axis=0), np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin), np.maximum.reduceat(slack, begin)))


def enough(overlap, small_a, small_b, threshold: int):
    """Whether sets of at least these sizes could link with that overlap."""
    return 100 * overlap >= threshold * (small_a + small_b - overlap)


def traverse(x: Tree, y: Tree, threshold: int, step_words: int = 1 << 18):
    """Pairs of sets that the largest possible overlap does not rule out: both trees from the roots down, level by level.

    Node pairs are judged in steps of about `step_words` words of bitmap."""
    step = max(16, step_words // x.levels[0][0].shape[1])
    depth = max(len(x.levels), len(y.levels))
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    i = j = np.zeros(1, np.int64)
    for k in range(depth - 1, -1, -1):
        (ux, lx, hx, sx), (uy, ly, hy, sy) = level(x, k), level(y, k)
        if k < depth - 1:
            i, j = _children(i, j, len(level(x, k + 1)[0]), len(ux), len(level(y, k + 1)[0]), len(uy))
        if x is y:
            i, j = i[i <= j], j[i <= j]
        fits = np.zeros(len(i), bool)
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            most = np.bitwise_count(ux[a] & uy[b]).sum(1).astype(np.int64) + np.minimum(sx[a], sy[b])
            fits[at : at + step] = enough(np.minimum(most, np.minimum(hx[a], hy[b])), lx[a], ly[b], threshold)
        i, j = i[fits], j[fits]
    if x is y:
        i, j = i[i < j], j[i < j]
    yield from zip(x.at[i].tolist(), y.at[j].tolist())


def _children(i: np.ndarray, j: np.ndarray, nx: int, mx: int, ny: int, my: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of node pairs; a tree whose root is reached already (as many nodes below as here) stands still."""
    fan = np.arange(FAN)
    down = lambda at, n, m: at[:, None] if n == m else at[:, None] * FAN + fan
    a, b = down(i, nx, mx), down(j, ny, my)
    p = np.broadcast_to(a[:, :, None], (len(i), a.shape[1], b.shape[1])).ravel()
    q = np.broadcast_to(b[:, None, :], (len(i), a.shape[1], b.shape[1])).ravel()
    inside = (p < mx) & (q < my)
    return p[inside], q[inside]


def links_in(sets: list[np.ndarray], leaf: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within a unit: between its two leaves, or within its only one."""
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    words = 1
    while words * 64 < 8 * max(map(len, sets)):
        words *= 2
    trees = [Tree(sets, np.flatnonzero(leaf == k), words) for k in np.unique(leaf)]
    found = []
    for i, j in traverse(trees[0], trees[-1], threshold):
        a, b = top(i), top(j)
        if a == b:
            continue
        small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[place] == small).sum())
        if 100 * both >= threshold * (len(small) + len(large) - both):
            parent[b] = a
            found.append((i, j))
    return found


def _links(units: DataFrame, threshold: int) -> DataFrame:
    """Links within each unit. Rows of a unit come one after the other, at most two leaves of them."""

    def solve(rows):
        unit, node, leaf, sets = rows
        if len(unit) < 2:
            return []
        return [(node[i], node[j]) for i, j in links_in(sets, np.array(leaf), threshold)]

    def run(batches):
        held = ([], [], [], [])
        out: list = []
        for batch in batches:
            lists = batch.column("shingles")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, (u, k, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "leaf")))):
                if held[0] and held[0][-1] != u:
                    out += solve(held)
                    held = ([], [], [], [])
                for part, value in zip(held, (u, k, f, flat[at[i] : at[i + 1]].copy())):
                    part.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
                out = []
        out = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def _settled(members: DataFrame, threshold: int, rounds: int = REPRESENTATIVES) -> tuple[DataFrame, DataFrame]:
    """a and class of members that a representative of their family has joined, and the links found on the way.

    Only families larger than a leaf have representatives: in each round the one of those not yet joined whose hash is least, compared
    with every member of its family. It travels to each slot of its family, never to one task for all of them.
    Members of one class link with one representative; a representative that links with members of an earlier class
    takes that class's name, so that members with equal class are connected."""
    spark = members.sparkSession
    classes = spark.createDataFrame([], "a long, class long")
    stars = spark.createDataFrame([], "a long, b long")
    sizes = members.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > LEAF)
    sizes = written(sizes.select("family", F.ceil(F.col("m") / F.lit(LEAF)).cast("int").alias("slots")), "large-families")
    if sizes.isEmpty():
        return classes, stars
    at = F.pmod(F.xxhash64("a", F.lit(3)), F.col("slots")).cast("int")
    large = members.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, "family").withColumn("slot", at)
    for k in range(rounds):
        left = large.select("a", "family").join(classes, "a", "left_anti")
        chosen = left.groupBy("family").agg(F.min_by("a", F.xxhash64("a", F.lit(k))).alias("rep"))
        reps = large.join(chosen, "family").where("a = rep").select("family", "slots", "rep", F.col("n").alias("rep_n"), F.col("shingles").alias("rep_shingles"))
        spread = reps.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
        both = F.size(F.array_intersect("shingles", "rep_shingles"))
        close = (100 * F.least("n", "rep_n") >= threshold * F.greatest("n", "rep_n")) & (100 * both >= threshold * (F.col("n") + F.col("rep_n") - both))
        met = written(large.join(spread.hint("merge"), ["family", "slot"]).where(close).select("a", "family", "rep"), "joined")
        stars = stars.unionByName(met.where("a <> rep").select("a", F.col("rep").alias("b")))
        # Earlier classes that this representative reaches become one with its own.
        named = met.join(classes, "a", "left").select("a", "family", "rep", F.col("class").alias("old"))
        least = named.groupBy("family").agg(F.min(F.coalesce("old", "rep")).alias("class"))
        fresh_ones = named.where("old IS NULL").select("a", "family").join(F.broadcast(least) if sizes.count() <= SMALL else least, "family").select("a", "class")
        merged = named.where("old IS NOT NULL").select(F.col("old").alias("class"), "family").distinct().join(least.withColumnRenamed("class", "now"), "family").select("class", "now").distinct()
        again = classes.join(F.broadcast(merged) if sizes.count() <= SMALL else merged, "class", "left").select("a", F.coalesce("now", "class").alias("class"))
        classes = written(again.unionByName(fresh_ones), "classes")
    return classes, stars


def _units(members: DataFrame, settled: DataFrame) -> DataFrame:
    """Members dealt to units: pairs of leaves of one family, of one band or of neighbouring ones, but no two leaves of one class.

    No task holds more than about 2 * LEAF sets of a unit."""
    members = members.join(settled.hint("merge"), "a", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    place = ["family", "band", "class"]
    sizes = members.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(LEAF)).cast("int").alias("leaves"))
    leaves = written(sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("slot")), "leaves")
    x, y = (leaves.select("family", F.col("band").alias(f"band_{s}"), F.col("class").alias(f"class_{s}"), F.col("slot").alias(f"slot_{s}")) for s in "xy")
    order = (F.struct("band_x", "class_x", "slot_x") <= F.struct("band_y", "class_y", "slot_y")) & (F.col("band_y") - F.col("band_x") <= 1)
    apart = (F.col("class_x") != F.col("class_y")) | (F.col("class_x") == 0)
    pairs = x.join(y, "family").where(order & apart).withColumn("unit", F.xxhash64("family", "band_x", "class_x", "slot_x", "band_y", "class_y", "slot_y"))
    ends = F.array_distinct(F.array(*[F.struct(F.col(f"band_{s}").alias("band"), F.col(f"class_{s}").alias("class"), F.col(f"slot_{s}").alias("slot")) for s in "xy"]))
    dealt = pairs.select("family", "unit", F.explode(ends).alias("end")).select("family", "unit", "end.*")
    slots = leaves.select(*place, "leaves").distinct()
    slotted = members.join(F.broadcast(slots) if slots.count() <= SMALL else slots, place).withColumn("slot", F.pmod(F.xxhash64("a"), F.col("leaves")).cast("int"))
    units = slotted.join(dealt, [*place, "slot"]).select("unit", F.col("a").alias("node"), F.xxhash64(*place, "slot").alias("leaf"), "shingles")
    # By ranges: tasks get equal numbers of rows, to within a unit, where hashing would send some of them several units.
    return units.repartitionByRange("unit").sortWithinPartitions("unit", "leaf", "node")


#: Rows of a table of families that may be broadcast.
SMALL = 50_000


def linked(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row of docs.

    Keys are shuffled as (key, set hash): first for each key's smallest and largest set, summed map-side, then, for
    keys that more than one set holds, to tie the sets to families; the join is by merge at every size, so that its shuffle
    grows as the input. Only sets in families are read again with their
    shingles; a family of m sets makes units of two leaves, so no task holds more than 2 * LEAF sets."""
    whole = keyed(docs, "text")
    rows = written(_sets(whole, words, threshold), "shingle-sets")
    keys = rows.select("a", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("key", "low")
    families = components(keys.join(shared.hint("merge"), "key").where("a <> low").select("low", "a").distinct(), "low", "a")
    families = families.select(F.col("node").alias("a"), F.col("component").alias("family"))

    sets = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_key").alias("node"))
    members = sets.join(families, "a").select(F.col("node").alias("doc_key"), "a", "n", "family")
    with_sets = _with_shingles(whole.join(members.hint("merge"), "doc_key").select("doc_key", "a", "n", "family", "text"), words)
    with_sets = with_sets.groupBy("doc_key", "a", "n", "family").agg(F.max("shingles").alias("shingles"))
    step = float(np.log(100 / threshold))
    with_sets = written(with_sets.withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("int")).drop("doc_key"), "family-members")
    settled, stars = _settled(with_sets, threshold)
    found = components(_links(_units(with_sets, settled), threshold).unionByName(stars))

    named = sets.join(found.select(F.col("node").alias("a"), "component"), "a", "left")
    named = with_least(named.select("n", "a", "b", F.coalesce("component", "a").alias("u"), F.col("node").alias("v")), rows.count())
    same = rows.select("doc_key", "n", "a", "b").join(named.select("n", "a", "b", F.col("m").alias("component")), ["n", "a", "b"], "left")
    return same.select(unkeyed().alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_key"), F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of its component; rows without an id stay."""
    name = fresh(docs, "_kept_id")
    first = linked(docs, words, threshold).where("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col(name), "left")
    return kept.where(F.col("doc_id").isNull() | F.col(name).isNotNull()).select(*docs.columns)
