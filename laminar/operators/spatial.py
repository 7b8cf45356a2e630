"""Joins by place: overlapping boxes, points in cubes, nearest points of distinct groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.scratch import written

#: Keys that one row of copies holds, keys of a cell from which it is split into units, and result rows of an Arrow batch; about as many each.
COPIES, CROWD, ROWS = 1024, 8192, 1 << 17


def _cells(df: DataFrame, axes: list[str], size: float, lo: str, hi: str) -> DataFrame:
    for k in axes:
        ends = [F.floor(f(f"{lo}{k}", f"{hi}{k}") / size) for f in (F.least, F.greatest)]
        df = df.withColumn(f"c_{k}", F.explode(F.sequence(*ends)))
    return df


def _units(batches, keys: list[str]):
    """Runs of rows with equal keys, over the borders of batches: (values of the keys, table)."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], 0)])
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            now = tuple(c[begin].item() for c in columns)
            if now != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _slices(n: np.ndarray, most: int):
    """Ends of runs of n whose sum is `most` at most, or which are one."""
    upto, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of n each, one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _least_of(x, y):  # NaN is the greatest number, as in SQL
    return np.fmin(x, y)


def _reaches(x, y):
    return (x >= y) | np.isnan(x)


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """As `stats.rounded`: halves of the scaled double away from zero."""
    if digits is None:
        return x
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x)


def _meeting(cell: np.ndarray, size: float, low: np.ndarray, high: np.ndarray, part: np.ndarray | None, least: float):
    """Pairs (i, j, volume) of a cell's boxes, i = j included, that the cell owns; with `part`, those of different parts only.

    A sweep along the first axis: in order of low ends, what meets a box there and is not before it is one range."""
    order = np.argsort(low[:, 0], kind="stable")
    low, high = low[order], high[order]
    home = np.floor(np.nan_to_num(np.fmin(low, high) / size))
    begin = np.arange(len(low))
    n = np.maximum(np.searchsorted(low[:, 0], high[:, 0], "right"), begin + 1) - begin
    for first, last in _slices(n, ROWS):
        i = np.repeat(begin[first:last], n[first:last])
        j = _ranges(begin[first:last], n[first:last])
        if part is not None:
            apart = part[order[i]] != part[order[j]]
            i, j = i[apart], j[apart]
        for a in reversed(range(low.shape[1])):
            fits = (np.maximum(home[i, a], home[j, a]) == cell[a]) & _reaches(high[i, a], low[j, a]) & _reaches(high[j, a], low[i, a])
            i, j = i[fits], j[fits]
        volume = np.ones(len(i))
        for a in range(low.shape[1]):
            volume = volume * (_least_of(high[i, a], high[j, a]) - np.maximum(low[i, a], low[j, a]))
        large = (volume > least) | np.isnan(volume)
        yield order[i[large]], order[j[large]], volume[large]


def _expanded(i: np.ndarray, j: np.ndarray, value: np.ndarray, at: np.ndarray, keys: np.ndarray, unique: bool):
    """Pairs of keys, smaller first, of pairs of boxes, a bounded number at a time; keys[at[i]:at[i + 1]] are box i's."""
    n = np.diff(at)
    for first, last in _slices(n[i], ROWS):
        a, b = i[first:last], j[first:last]
        one = keys[_ranges(at[a], n[a])]
        a, b, v = (np.repeat(x, n[a]) for x in (a, b, value[first:last]))
        for first_key, last_key in _slices(n[b], ROWS):
            here = slice(first_key, last_key)
            m = n[b[here]]
            p, q, overlap = np.repeat(one[here], m), keys[_ranges(at[b[here]], m)], np.repeat(v[here], m)
            same = a[here] == b[here]
            if same.any() or not unique:
                fits = np.where(np.repeat(same, m), p < q, p != q)
                p, q, overlap = p[fits], q[fits], overlap[fits]
            yield np.minimum(p, q), np.maximum(p, q), overlap


def box_overlaps(boxes: DataFrame, key: str, axes: list[str], size: float, least: float = 0.0, digits: int | None = None) -> DataFrame:
    """Pairs of boxes (lo_k, hi_k) whose common volume exceeds `least`, each found in the one cell that owns it; digits: the volume rounded.

    Equal boxes are one row with their keys, in rows of some COPIES keys, and are compared once: only the result is as long as the pairs.
    Rows meet in their cells on Arrow batches, so that candidate pairs are no rows of Spark. A cell of more than CROWD keys is split into
    parts, and each pair of its parts is a unit of work of its own; the tables broadcast hold such boxes and cells only."""
    ends = [f"{e}_{k}" for e in ("lo", "hi") for k in axes]
    cells = [f"c_{k}" for k in axes]
    whole = boxes.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in ends])
    whole = whole.where(" AND ".join(f"{c} IS NOT NULL" for c in whole.columns))  # na.drop() would take NaN for null
    often = whole.groupBy(*ends).agg(F.count("*").alias("n")).where(F.col("n") > COPIES)
    salt = F.pmod(F.xxhash64("key"), F.coalesce(F.ceil(F.col("n") / COPIES), F.lit(1)))
    copies = whole.join(F.broadcast(often), ends, "left").groupBy(*ends, salt.alias("salt")).agg(F.collect_list("key").alias("keys"))
    dealt = _cells(copies, axes, size, "lo_", "hi_")
    crowded = dealt.groupBy(*cells).agg(F.sum(F.size("keys")).alias("n")).where(F.col("n") > CROWD).select(*cells, F.ceil(F.col("n") / CROWD).alias("n"))
    dealt = dealt.join(F.broadcast(crowded), cells, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*ends, "salt"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    unit = [*cells, "part_a", "part_b"]
    dealt = dealt.select(*cells, F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", *ends, "keys")
    kind = dict(whole.dtypes)["key"]
    names = [f"a_{key}", f"b_{key}", "overlap"]

    def pairs(batches):
        for now, table in _units(batches, unit):
            lists = table.column("keys").combine_chunks()
            keys, at = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            if len(keys) < 2:
                continue
            low, high = (np.stack([table.column(f"{e}_{k}").to_numpy() for k in axes], 1) for e in ("lo", "hi"))
            part = table.column("part").to_numpy() if now[-2] != now[-1] else None
            told, keys = keys.type, keys.to_numpy(zero_copy_only=False)
            unique = len(np.unique(keys)) == len(keys)
            for i, j, volume in _meeting(np.array(now[: len(axes)]), size, low, high, part, least):
                for found in _expanded(i, j, _rounded(volume, digits), at, keys, unique):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (told, told, pa.float64()))], names=names)

    # A set number of tasks: pairs grow faster than the boxes that AQE would join tasks by.
    spark = boxes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *unit).sortWithinPartitions(*unit).mapInArrow(pairs, f"{names[0]} {kind}, {names[1]} {kind}, overlap double")


def points_in_cubes(points: DataFrame, labels: DataFrame, axes: list[str], size: int) -> DataFrame:
    """Label of each point's voxel, and whether its cube is covered at all: unlabelled and uncovered are not the same.

    labels: one row per labelled voxel, by integer coordinates."""
    cube = lambda df: [F.floor(F.col(k) / size).alias(f"cube_{k}") for k in axes]  # noqa: E731,ARG005
    at = points.select("*", *cube(points), *[F.floor(k).alias(f"vox_{k}") for k in axes])
    covered = labels.select(*cube(labels)).distinct().withColumn("covered", F.lit(True))
    named = labels.select(*[F.col(k).cast("long").alias(f"vox_{k}") for k in axes], "label")
    out = at.join(covered, [f"cube_{k}" for k in axes], "left").join(named, [f"vox_{k}" for k in axes], "left")
    return out.select(*points.columns, F.coalesce("covered", F.lit(False)).alias("covered"), "label")


def nearest_groups(queries: DataFrame, points: DataFrame, axes: list[str], reach: float, exclude: int, ties: list[str] | None = None) -> DataFrame:
    """Of each query (qid, grp, coordinates) the nearest two groups of points (tag, coordinates) within `reach`.

    A group counts when it is at least `exclude` away from the query's own. Points meet queries in cells of side `reach`,
    so one ring of neighbours holds all that may count: an equi-join, then a minimum per group, then two of those.
    d is Infinity, w null, where there is none."""
    ring = F.explode(F.array(*[F.array(*[F.lit(o) for o in offset]) for offset in _offsets(len(axes))]))
    near = queries.select("*", ring.alias("o")).select("*", *[(F.floor(F.col(k) / reach) + F.col("o")[i]).alias(f"c_{k}") for i, k in enumerate(axes)]).drop("o")
    cells = points.select("tag", *[F.col(k).alias(f"p_{k}") for k in axes], *[F.floor(F.col(k) / reach).alias(f"c_{k}") for k in axes])
    square = sum(((F.col(k) - F.col(f"p_{k}")) * (F.col(k) - F.col(f"p_{k}")) for k in axes), F.lit(0.0))
    met = near.join(cells, [f"c_{k}" for k in axes]).where(F.abs(F.col("tag") - F.col("grp")) >= exclude).withColumn("d2", square).where(F.col("d2") <= reach * reach)
    best = met.groupBy("qid", "tag").agg(F.min("d2").alias("d2")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "tag"))).where("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    two = best.groupBy("qid").agg(pick("tag", 1).alias("w1"), F.sqrt(pick("d2", 1)).alias("d1"), pick("tag", 2).alias("w2"), F.sqrt(pick("d2", 2)).alias("d2"))
    none = F.lit(float("inf"))
    return queries.select("qid").join(two, "qid", "left").select("qid", "w1", F.coalesce("d1", none).alias("d1"), "w2", F.coalesce("d2", none).alias("d2"))


def nearest(queries: DataFrame, points: DataFrame, axes: list[str], first: float, allowed=None, by: tuple = (), keep: tuple = (), growth: float = 4.0) -> DataFrame:
    """queries (qid, the columns `by`, axes) with the nearest point that agrees in `by` and is `allowed`: d, and its columns `keep`.

    allowed: a condition on the query's columns and on p_<keep>. Of equally near points the one with the least `keep` counts; d and
    the rest are null where no point is allowed, or where a coordinate is null. qid is unique and not null.
    Shells: points lie in one cell each, three times `first` wide, which queries within that reach of it meet; what is found within the reach
    is nearest of all. Only queries still open go on, to a reach `growth` times as far, until none is open or it spans all there is."""
    asked = queries.na.drop(subset=axes)
    ends = [f(k).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in axes]
    spans = [df.select(*[F.col(k).cast("double").alias(k) for k in axes]).agg(*ends).first() for df in (asked, points.na.drop(subset=axes))]
    widest = 0.0
    if all(s[0] is not None for s in spans):
        widest = sum((max(s[f"hi_{k}"] for s in spans) - min(s[f"lo_{k}"] for s in spans)) ** 2 for k in axes) ** 0.5
    side = points.na.drop(subset=axes).select(*by, *[F.col(k).alias(f"p_{k}") for k in dict.fromkeys([*axes, *keep])])
    square = sum(((F.col(k) - F.col(f"p_{k}")) * (F.col(k) - F.col(f"p_{k}")) for k in axes), F.lit(0.0))
    parts, reach, still = [], first, asked
    while True:
        keys, near, cells = [*by, *(f"c_{k}" for k in axes)], still, side
        for k in axes:
            low, high = (F.floor((F.col(k) + way * reach) / (3.0 * reach)) for way in (-1, 1))
            near = near.withColumn(f"c_{k}", F.explode(F.sequence(low, high)))
            cells = cells.withColumn(f"c_{k}", F.floor(F.col(f"p_{k}") / (3.0 * reach)))
        met = near.join(cells, keys)
        met = (met if allowed is None else met.where(allowed)).withColumn("d2", square).where(F.col("d2") <= reach * reach)
        best = met.groupBy("qid").agg(F.min(F.struct("d2", *[F.col(f"p_{k}") for k in keep])).alias("best"))
        parts.append(written(best, "nearest"))
        if reach >= widest:
            break
        still = written(still.join(parts[-1].select("qid"), "qid", "left_anti"), "nearest-open")
        if still.isEmpty():
            break
        reach *= growth
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return queries.join(found, "qid", "left").select(*queries.columns, F.sqrt("best.d2").alias("d"), *[F.col(f"best.p_{k}").alias(f"near_{k}") for k in keep])


def _offsets(n: int) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for _ in range(n):
        out = [[*o, s] for o in out for s in (-1, 0, 1)]
    return out


def tile_census(cells: DataFrame, bad: DataFrame, by: str, tile: int = 24, least: int = 164) -> DataFrame:
    """Tiles of the grid with enough valid cells, and whether a pair has both ends in one. bad: v1, u1, v2, u2."""
    at = lambda c: F.floor(F.col(c) / tile)
    tiles = cells.where("valid").groupBy(by, at("v").alias("tv"), at("u").alias("tu")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hit = bad.where((at("v1") == at("v2")) & (at("u1") == at("u2"))).select(by, at("v1").alias("tv"), at("u1").alias("tu")).distinct().withColumn("bad", F.lit(True))
    return tiles.join(hit, [by, "tv", "tu"], "left").select(by, "tv", "tu", "n", F.coalesce("bad", F.lit(False)).alias("bad"))
