"""Excision: the cheapest grid vertices whose removal takes every transverse contact off a surface."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.operators import census, mesh
from laminar.operators.components import components
from laminar.operators.regions import code
from laminar.scratch import written


def constraints(contacts: DataFrame) -> DataFrame:
    """cid and coverage: the eight corner vertices of the two quads of each transverse contact, each quad pair once."""
    hit = contacts.where("verdict = 'transverse'").select("s1", "v1", "u1", "s2", "v2", "u2").distinct()
    corners = [code(F.col(f"s{i}"), F.col(f"v{i}") + dv, F.col(f"u{i}") + du) for i in (1, 2) for dv in (0, 1) for du in (0, 1)]
    return hit.select(F.array_sort(F.array_distinct(F.array(*corners))).alias("coverage"), F.xxhash64("s1", "v1", "u1", "s2", "v2", "u2").alias("cid"))


def reduced(found: DataFrame) -> DataFrame:
    """Distinct coverages with their number, without those that hold another one whole.

    Containment is an equi-join on vertices: of two sets that share as many vertices as the smaller has, the larger goes. Only sets below
    the largest size can lie within another, and only those above the least can hold one: sets of one size, the usual case, meet none."""
    sets = written(found.groupBy("coverage").agg(F.count("*").alias("n"), F.min("cid").alias("cid")), "coverages")
    span = sets.agg(F.min(F.size("coverage")).alias("least"), F.max(F.size("coverage")).alias("most")).first()
    if span.least == span.most:
        return sets
    flat = sets.select("cid", F.size("coverage").alias("size"), F.explode("coverage").alias("x"))
    a, b = (flat.where(fits).select(F.col("cid").alias(f"cid_{t}"), F.col("size").alias(f"size_{t}"), "x") for t, fits in (("a", F.col("size") < span.most), ("b", F.col("size") > span.least)))
    shared = a.join(b, "x").where("size_a < size_b").groupBy("cid_a", "size_a", "cid_b").agg(F.count("*").alias("m"))
    return sets.join(shared.where("m = size_a").select(F.col("cid_b").alias("cid")).distinct(), "cid", "left_anti")


def independent(sets: DataFrame) -> DataFrame:
    """component of each set, named by its least cid: sets tied by a shared vertex, or by vertices that are corners of one quad.

    What is tied are cells of 2 x 2 vertices, all corners of one quad: ties between cells are far fewer than ties between sets."""
    whole = lambda x: x.bitwiseAND(F.lit(~(1 << 20 | 1)).cast("long"))
    within = sets.select(F.array_distinct(F.transform("coverage", whole)).alias("cells"))
    corners = sets.select(F.explode("coverage").alias("x")).distinct()
    near = F.array(*[F.col("x") - dv * (1 << 20) - du for dv in (0, 1) for du in (0, 1)])
    around = corners.select(whole(F.col("x")).alias("cell"), F.explode(near).alias("quad")).groupBy("quad").agg(F.collect_set("cell").alias("cells"))  # four at most
    ties = [t.where(F.size("cells") > 1).select(F.array_min("cells").alias("a"), F.explode("cells").alias("b")).where("a <> b") for t in (within, around)]
    tied = components(ties[0].unionByName(ties[1]), "a", "b")
    at = sets.withColumn("cell", whole(F.col("coverage")[0]))
    cells = at.groupBy("cell").agg(F.min("cid").alias("cid")).join(tied, F.col("cell") == F.col("node"), "left").select("cell", "cid", F.coalesce("component", "cell").alias("part"))
    cells = written(cells, "cover-cells")
    named = cells.select("cell", "part").join(cells.groupBy("part").agg(F.min("cid").alias("component")), "part").select("cell", "component")
    return at.join(named, "cell").drop("cell")


class Cover:
    """A covering problem as arrays: which sets each vertex covers, and which quads, with their areas, it takes away.

    Numbers stay in arrays, of four bytes where they can: a component may hold most sets of a large surface."""

    def __init__(self, ends: np.ndarray, vertex: np.ndarray, by: np.ndarray, quad: np.ndarray, area: np.ndarray):
        """vertex: those of one set after the other, of which set k has [ends[k], ends[k + 1]); by, quad, area: what each vertex takes."""
        self.n = len(ends) - 1
        self.names = np.unique(vertex).astype(np.int64)
        self.vertex = np.searchsorted(self.names, vertex).astype(np.int32)
        self.set = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))
        ours = np.flatnonzero(np.isin(by, self.names))
        ours = ours[np.lexsort([quad[ours], by[ours]])]
        self.by = np.searchsorted(self.names, by[ours]).astype(np.int32)
        quads = np.unique(quad[ours])
        self.quad = np.searchsorted(quads, quad[ours]).astype(np.int32)
        self.area = np.zeros(len(quads))
        self.area[self.quad] = area[ours]

    @classmethod
    def of(cls, cover: list[np.ndarray], incident: dict[int, list[tuple[int, float]]]) -> Cover:
        taken = [(x, q, a) for x, near in incident.items() for q, a in near]
        columns = [np.array([t[k] for t in taken], kind) for k, kind in enumerate((np.int64, np.int64, float))]
        return cls(np.cumsum([0, *map(len, cover)]), np.concatenate([*cover, np.zeros(0, np.int64)]).astype(np.int64), *columns)

    def price(self, gone: np.ndarray) -> np.ndarray:
        """Of each vertex, the area it takes that is not gone yet."""
        return np.bincount(self.by, self.area[self.quad] * ~gone[self.quad], len(self.names))

    def greedy(self) -> np.ndarray:
        """The vertex that covers most open sets for the area it newly takes, until none is open; the least vertex on a tie.

        A heap holds each vertex at its present worth; a choice renews only vertices that share a set or a quad with it."""
        sets_of, of_set, quads_of, of_quad = self._lists()
        area, open_, gone = memoryview(self.area), bytearray(b"\1" * self.n), bytearray(len(self.area))
        gain = np.bincount(self.vertex, minlength=len(self.names)).tolist()

        def cost(i):
            """A vertex's worth below zero: heaps give the least first."""
            price = 0.0
            for q in quads_of(i):
                price += 0.0 if gone[q] else area[q]
            return -(gain[i] / price) if price > 0 else (-np.inf if gain[i] else 0.0)

        ids = list(range(len(self.names)))  # one object each, that heap entries share
        now = [cost(i) for i in ids]
        heap = list(zip(now, ids))
        heapq.heapify(heap)
        chosen, left, full = [], len(np.unique(self.set)), 2 * len(heap) + 1000
        while left and heap:
            w, best = heapq.heappop(heap)
            if w != now[best] or not gain[best]:
                continue
            chosen.append(best)
            renew = set()
            for c in sets_of(best):
                if open_[c]:
                    open_[c], left = 0, left - 1
                    for i in of_set(c):
                        gain[i] -= 1
                        renew.add(i)
            for q in quads_of(best):
                if not gone[q]:
                    gone[q] = 1
                    renew.update(of_quad(q))
            for i in renew:
                if (w := cost(i)) != now[i]:
                    now[i] = w
                    if gain[i]:
                        heapq.heappush(heap, (w, ids[i]))
            if len(heap) > full:  # outdated entries go, so that the heap stays in proportion to the vertices
                heap = [(now[i], i) for i in ids if gain[i]]
                heapq.heapify(heap)
        return np.array(chosen, np.int64)

    def chosen(self) -> np.ndarray:
        return self.names[self.needed(self.greedy())]

    def _lists(self):
        """Functions that give the sets of a vertex, the vertices of a set, the quads of a vertex and the vertices of a quad, as lists."""

        def lists(key, value, n):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            flat, ends = memoryview(np.ascontiguousarray(value)), memoryview(np.searchsorted(key, np.arange(n + 1)))
            return lambda i: flat[ends[i] : ends[i + 1]].tolist()

        pairs = ((self.vertex, self.set, len(self.names)), (self.set, self.vertex, self.n), (self.by, self.quad, len(self.names)), (self.quad, self.by, len(self.area)))
        return [lists(*x) for x in pairs]

    def needed(self, chosen: np.ndarray) -> np.ndarray:
        """chosen without what is redundant: of the vertices whose sets all have another one, the one that gives back most area
        goes, the least vertex on a tie, until each is the only one of some set."""
        sets_of, _, quads_of, of_quad = self._lists()
        kept = np.zeros(len(self.names), bool)
        kept[chosen] = True
        times, users = (np.bincount(k[kept[i]], minlength=n).tolist() for k, i, n in ((self.set, self.vertex, self.n), (self.quad, self.by, len(self.area))))
        area, kept = memoryview(self.area), bytearray(kept)

        def back(i):
            total = 0.0
            for q in quads_of(i):
                total += area[q] if users[q] == 1 else 0.0
            return total

        now = {i: back(i) for i in chosen.tolist()}
        heap = [(-w, i) for i, w in now.items()]
        heapq.heapify(heap)
        while heap:
            w, i = heapq.heappop(heap)
            if not kept[i] or -w != now[i] or any(times[c] < 2 for c in sets_of(i)):
                continue  # a vertex once alone in a set stays so: none is ever added
            kept[i] = 0
            for c in sets_of(i):
                times[c] -= 1
            for q in quads_of(i):
                users[q] -= 1
                if users[q] == 1:
                    for k in of_quad(q):
                        if kept[k]:
                            now[k] = back(k)
                            heapq.heappush(heap, (-now[k], k))
        return np.flatnonzero(np.frombuffer(kept, np.uint8))


def greedy(cover: list[np.ndarray], incident: dict[int, list[tuple[int, float]]]) -> list[int]:
    """Vertices that cover every set at a low area, none of them redundant."""
    return Cover.of(cover, incident).chosen().tolist()


def exact(cover: list[np.ndarray], incident: dict, bound: float, most: int = 20_000) -> tuple[list[int] | None, bool]:
    """Branch and bound below a known area: a cheaper choice or None, and whether that is proven within `most` nodes."""
    area = lambda chosen: sum({q: a for x in chosen for q, a in incident.get(x, ())}.values())
    best, limit, nodes = None, bound, 0
    stack: list[list[int]] = [[]]
    while stack:
        if (nodes := nodes + 1) > most:
            return best, False
        chosen = stack.pop()
        if area(chosen) >= limit - 1e-12:
            continue
        left = [c for c in cover if not any(int(x) in chosen for x in c)]
        if not left:
            best, limit = chosen, area(chosen)
            continue
        stack += [[*chosen, int(x)] for x in min(left, key=len)]
    return best, True


def solve(sets: DataFrame, quad_areas: DataFrame, small: int = 12) -> DataFrame:
    """Vertices to remove (component, vertex) and how each component was solved: proven optimal where it is small.

    A component is the unit of the choice, one group, held as Arrow tables and plain arrays; components spread over tasks."""
    sets = written(sets.select("component", "cid", "coverage"), "cover-sets")
    flat = sets.select("component", F.explode("coverage").alias("vertex")).distinct()
    corner = F.explode(F.array(*[F.lit(dv * (1 << 20) + du) for dv in (0, 1) for du in (0, 1)]))
    at = quad_areas.select(code(F.col("surface_id"), F.col("v"), F.col("u")).alias("quad"), "area").select("quad", "area", corner.alias("o")).select("quad", "area", (F.col("quad") + F.col("o")).alias("vertex"))
    incident = flat.join(at, "vertex").select(F.col("component").alias("part"), "vertex", "quad", "area")

    def run(key, c: pa.Table, i: pa.Table) -> pa.Table:
        sets = c.column("coverage").combine_chunks().take(pa.array(np.argsort(c.column("cid").to_numpy(), kind="stable")))
        whole = Cover(sets.offsets.to_numpy(), sets.flatten().to_numpy(), *[i.column(k).to_numpy() for k in ("vertex", "quad", "area")])
        if len(sets) > small:
            c = i = sets = None
            chosen, how = whole.chosen(), "greedy"
        else:
            near: dict[int, list[tuple[int, float]]] = {}
            for x, q, a in zip(*[i.column(k).to_pylist() for k in ("vertex", "quad", "area")]):
                near.setdefault(x, []).append((q, a))
            chosen = whole.chosen().tolist()
            cost = sum({q: a for x in chosen for q, a in near.get(x, ())}.values())
            better, proven = exact([np.asarray(x) for x in sets.to_pylist()], near, cost)
            chosen, how = (better or chosen), "optimal" if proven else "greedy"
        return pa.table({"component": pa.array([key[0].as_py()] * len(chosen), pa.int64()), "vertex": pa.array(chosen, pa.int64()), "method": pa.array([how] * len(chosen), pa.string())})

    return sets.groupBy("component").cogroup(incident.groupBy("part")).applyInArrow(run, "component long, vertex long, method string")


def without(vertices: DataFrame, removed: DataFrame) -> DataFrame:
    """vertices with the removed ones (vertex) marked -1 in all planes and not valid; all others bit for bit as before."""
    gone = removed.select("vertex").distinct().withColumn("_gone", F.lit(True))
    out = vertices.withColumn("_c", code(F.col("surface_id"), F.col("v"), F.col("u"))).join(gone, F.col("_c") == F.col("vertex"), "left")
    planes = {k: F.when(F.col("_gone"), F.lit(-1.0).cast("float")).otherwise(F.col(k)) for k in "xyz"}
    return out.withColumns(planes | {"valid": F.col("valid") & F.col("_gone").isNull()}).select(vertices.columns)


def excise(vertices: DataFrame, rounds: int = 8, **how) -> tuple[DataFrame, DataFrame, str]:
    """Removes vertices until the census, taken anew from the written result, has no transverse contact under either diagonal.

    Returned: the surface, the removed vertices, and clean, stalled or iteration_limit."""
    base = written(mesh.areas(mesh.quads(vertices)).where("retained").select("surface_id", "v", "u", "area"), "quad-areas")
    now, removed, before = written(vertices, "surface"), None, None
    for _ in range(rounds):
        quads = mesh.quads(now)
        found = [census.contacts(mesh.triangles(quads, d), **how) for d in (0, 1)]
        sets = written(constraints(found[0].unionByName(found[1])), "constraints")
        n = sets.count()
        none = vertices.sparkSession.createDataFrame([], "vertex long")
        if not n:
            return now, none if removed is None else removed, "clean"
        if before is not None and n >= before:
            return now, removed, "stalled"
        before = n
        chosen = written(solve(independent(reduced(sets)), base).select("vertex"), "removed")
        removed = chosen if removed is None else written(removed.unionByName(chosen), "removed")
        now = written(without(now, chosen), "surface")
    return now, removed, "iteration_limit"


def certificate(before: DataFrame, after: DataFrame, budget: float = 0.01) -> DataFrame:
    """Areas before and after, what is kept, whether the removed share stays in the budget, and whether it is clean by emptiness."""
    a = mesh.areas(mesh.quads(before)).where("retained").groupBy("surface_id").agg(F.sum("area").alias("area_before"), F.count("*").alias("quads_before"))
    b = mesh.areas(mesh.quads(after)).where("retained").groupBy("surface_id").agg(F.sum("area").alias("area_after"), F.count("*").alias("quads_after"))
    out = a.join(b, "surface_id", "left").na.fill(0, ["area_after", "quads_after"])
    kept = F.col("area_after") / F.col("area_before")
    return out.select("*", kept.alias("retained_fraction"), (1 - kept <= budget).alias("within_budget"), (F.col("quads_after") == 0).alias("clean_by_emptiness"))
