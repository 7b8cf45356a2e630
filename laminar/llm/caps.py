"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A filter is a direction: one random codeword on each half of the dimensions. A vector passes a filter when its product with
the direction exceeds a threshold; of all pairs of codewords it finds those it passes by list decoding, from the two
halves' products alone. Vectors are joined on filters and verified by cosine in double precision.

The filters grow with the table: codewords as the root of the number of vectors, so that a filter holds as many vectors at
every size, and the threshold so that two vectors of the least cosine share a filter about as often at every size. A vector
then passes some filters more (39, 52 and 85 at 10,000, 50,000 and a million vectors of 64 numbers), not a multiple of them. Tests measure the recall against brute force.

Equal vectors are one point with a weight. A vector that is null, empty or zero, or that holds null or non-finite numbers,
links with nothing; so do vectors of different lengths. Repeated rows are vectors of their own; rows without a vec_id
share one node that comes last. Other columns, clashing names included, play no part.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import NO_ID, written
from laminar.operators.components import components

#: Least cosine of a link; codewords of each half for a table of VECTORS; filters in the cap around the middle of two vectors
#: of the least cosine, and the power of the books' growth at which they become more.
LEAST, CODEWORDS, VECTORS, SHARED, GROWTH = 0.9, 1024, 10_000, 21.0, 0.3
#: A vector that passes fewer filters than this lowers its own threshold by EASE until it has them; its near neighbours lie
#: as unluckily and do the same.
FEWEST, EASE = 8, 0.3
#: Points of one filter that are compared in one piece; a fuller filter is compared block by block.
BLOCK = 256
SEED = 20_240_229


def words_of(width: int, codewords: int) -> int:
    """Codewords of a book over `width` dimensions: few of them need few."""
    return min(codewords, 2 * 4 ** (min(width, 12) - 1)) if width else 1


def size_of_books(rows: int) -> int:
    """Codewords of each half for a table of so many vectors."""
    return max(16, ceil(CODEWORDS * sqrt(rows / VECTORS)))


@lru_cache(8)
def codebooks(dim: int, codewords: int) -> tuple[np.ndarray, np.ndarray]:
    """Two books of random codewords; a pair of them is a direction of length 1. Few dimensions need few codewords: one of
    them takes only the two signs."""
    rng = np.random.default_rng([SEED, dim])
    halves = [(dim + 1) // 2, dim // 2]
    books = []
    for width in halves:
        book = rng.standard_normal((words_of(width, codewords), max(width, 1)))
        if width == 1:
            book[:, 0] = 1, -1
        book *= np.sqrt(width / dim) / np.linalg.norm(book, axis=1, keepdims=True)
        books.append(book[:, :width])
    return books[0], books[1]


def decode(x: np.ndarray, codewords: int, product: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that each row of x, of length 1, passes, by row; see FEWEST for rows that pass few."""
    row, code = _passed(x, codewords, product)
    few = np.flatnonzero(np.bincount(row, minlength=len(x)) < FEWEST)
    ease = EASE / np.sqrt(x.shape[1])
    while len(few) and (product := product - ease) > 0:
        more, found = _passed(x[few], codewords, product)
        kept = ~np.isin(row, few)
        row, code = np.r_[row[kept], few[more]], np.r_[code[kept], found]
        few = few[np.bincount(more, minlength=len(few)) < FEWEST]
    order = np.lexsort((code, row))
    return row[order], code[order]


def _passed(x: np.ndarray, codewords: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    first, second = codebooks(x.shape[1], codewords)
    a, b = x[:, : first.shape[1]] @ first.T, x[:, first.shape[1] :] @ second.T
    row, i = np.nonzero(a >= (least - b.max(1))[:, None])
    order = np.argsort(-b, axis=1)
    ranked = np.take_along_axis(b, order, 1)
    # A row's second halves in falling order: as many pass with a first half as exceed what that one leaves open.
    need = least - a[row, i]
    count = np.zeros(len(row), np.int64)
    for at in np.flatnonzero(np.bincount(row, minlength=len(x))):
        mine = slice(*np.searchsorted(row, [at, at + 1]))
        count[mine] = np.searchsorted(-ranked[at], -need[mine], "right")
    whole = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count)
    return row[whole], i[whole] * codewords + order[row[whole], nth]


@lru_cache(64)
def threshold(dim: int, codewords: int, least: float) -> float:
    """The product from which a filter is passed: such that a cap around the middle of two vectors at `least` holds SHARED filters,
    and more of them the larger the books, since both vectors pass a filter of the cap the less often the smaller it is.

    The share of directions within a product c of a fixed one is about (1 - c^2)^((dim - 1) / 2) / (c sqrt(2 pi dim)); the middle's
    product is that of the two over sqrt((1 + least) / 2)."""
    filters = words_of((dim + 1) // 2, codewords) * words_of(dim // 2, codewords)
    wanted = SHARED * max(1.0, codewords / CODEWORDS) ** GROWTH
    low, high = 1e-3, 1 - 1e-9
    for _ in range(60):
        c = (low + high) / 2
        share = exp((dim - 1) / 2 * log(1 - c * c)) / (c * sqrt(2 * pi * dim))
        low, high = (c, high) if filters * share > wanted else (low, c)
    return low * sqrt((1 + least) / 2)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(points: DataFrame, codewords: int, products: dict[int, float]) -> DataFrame:
    """A row (dim, filter, h1, node) for every filter a point passes."""

    def run(batches):
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            step = max(1, min(256, (1 << 19) // codewords))
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                for k in range(0, len(of), step):
                    part = batch.take(pa.array(of[k : k + step]))
                    row, code = decode(_matrix(part.column("v"), int(dim)), codewords, products[int(dim)])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, np.int32)), pa.array(code), part.column("h1").take(at), part.column("node").take(at)], names=["dim", "filter", "h1", "node"])

    return points.select("h1", "node", "v").mapInArrow(run, "dim int, filter long, h1 long, node long")


def compare(x: np.ndarray, own: list[np.ndarray], block: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows linked that have no filter in common before this one (own); across blocks if there are two."""
    close = np.triu(x @ x.T >= least, 1)
    if block.min() != block.max():
        close &= block[:, None] != block[None]
    if not close.any():
        return np.zeros((0, 2), np.int64)
    busy = np.flatnonzero(close.any(0) | close.any(1))
    sizes = [len(own[i]) for i in busy]
    code, column = np.unique(np.concatenate([own[i] for i in busy]), return_inverse=True)
    shared = np.zeros((len(busy), len(busy)), np.float32)
    row = np.repeat(np.arange(len(busy)), sizes)
    for k in range(0, len(code), 8192):
        here = (column >= k) & (column < k + 8192)
        holds = np.zeros((len(busy), min(8192, len(code) - k)), np.float32)
        holds[row[here], column[here] - k] = 1
        shared += holds @ holds.T
    pairs = np.argwhere(close[np.ix_(busy, busy)] & (shared == 0))
    return busy[pairs]


def _compared(units: DataFrame, least: float) -> DataFrame:
    """For every unit: weights of new partners by point, and links that connect what is linked in it."""

    def solve(held):
        node, weight = np.array([h[1] for h in held]), np.array([h[2] for h in held])
        pairs = compare(np.array([h[3] for h in held]), [h[4] for h in held], np.array([h[5] for h in held]), least)
        if not len(pairs):
            return []
        got = np.zeros(len(held), np.int64)
        np.add.at(got, pairs[:, 0], weight[pairs[:, 1]])
        np.add.at(got, pairs[:, 1], weight[pairs[:, 0]])
        out = [(int(node[i]), int(got[i]), None) for i in np.flatnonzero(got)]
        parent = list(range(len(held)))

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in pairs.tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[b] = a
                out.append((int(node[i]), 0, int(node[j])))
        return out

    def run(batches):
        held: list = []
        for batch in batches:
            out: list = []
            dims = np.diff(batch.column("v").offsets.to_numpy())
            vectors: list = [None] * len(batch)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                for i, v in zip(of, _matrix(batch.column("v").take(pa.array(of)), int(dim))):
                    vectors[i] = v
            at, flat = batch.column("own").offsets.to_numpy(), batch.column("own").values.to_numpy()
            plain = [batch.column(c).to_pylist() for c in ("unit", "node", "weight", "block")]
            for i, (unit, node, weight, block) in enumerate(zip(*plain)):
                if held and held[0][0] != unit:
                    if len(held) > 1:
                        out += solve(held)
                    held = []
                held.append((unit, node, weight, vectors[i], flat[at[i] : at[i + 1]].copy(), block))
            yield _rows(out)
        yield _rows(solve(held) if len(held) > 1 else [])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "n", "other"])

    return units.mapInArrow(run, "node long, n long, other long")


def linked(vectors: DataFrame, least: float = LEAST, codewords: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Filters are dealt as ids first. A point then goes out once a filter that another one passes too, with its vector and the shared filters
    it passes before that one; a pair counts in its smallest common filter only, so nothing is counted twice and no list of pairs is built. Filters with more than BLOCK
    points are compared as pairs of blocks, each its own unit, so a crowd of near copies spreads over all tasks and each
    unit hands on sums and a spanning forest, not its pairs. codewords: by the number of rows where none is given."""
    kind = vectors.schema["embedding"].dataType
    kind = "double" if getattr(kind, "elementType", None) is not None and kind.elementType.simpleString() != "float" else "float"
    v = F.col("embedding").cast(f"array<{kind}>")
    ok = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_key"), F.when(ok, F.transform(v, lambda x: x + F.lit(0.0).cast(kind))).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), F.col("v")))
    points = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_key").alias("node"), F.count("*").alias("weight"), F.max("v").alias("v"))
    points = written(points, "points")
    codewords = codewords or size_of_books(points.count())
    products = {r[0]: threshold(r[0], codewords, least) for r in points.select(F.size("v")).distinct().collect()}
    passed = _filtered(points, codewords, products)
    shared = passed.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").select("dim", "filter", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    met = passed.join(shared.hint("merge"), ["dim", "filter"]).groupBy("h1", "node").agg(F.array_sort(F.collect_list(F.struct("filter", "blocks"))).alias("held"))
    with_v = points.select("h1", "node", "weight", "v").join(met.hint("merge"), ["h1", "node"]).select("node", "weight", "v", F.size("v").alias("dim"), "held", F.posexplode("held").alias("at", "one"))
    dealt = with_v.select("node", "weight", "v", "dim", "one.filter", "one.blocks", F.slice("held.filter", F.lit(1), F.col("at")).alias("own"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    units = dealt.withColumn("block", block).withColumn("xy", F.explode(others)).withColumn("unit", F.xxhash64("dim", "filter", "xy.x", "xy.y"))
    spread = units.select("unit", "node", "weight", "v", "own", "block").repartition("unit").sortWithinPartitions("unit", "node")
    found = written(_compared(spread, least), "links")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    tied = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "a", "b")
    judged = points.select("h1", "h2", "node", "weight").join(sums, "node", "left").join(tied, "node", "left")
    judged = judged.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    met = rows.select("vec_key", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2").join(judged, ["h1", "h2"], "left")
    own = F.coalesce("component", "vec_key")
    shown = lambda c: F.when(c != NO_ID, c)
    return met.select(shown(F.col("vec_key")).alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), shown(own).alias("component_id"), (F.col("vec_key") == own).alias("kept"))
