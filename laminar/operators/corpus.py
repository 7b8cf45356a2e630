"""Corpus reports: retention, gates, cores, duplicates, rosters, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def truncated_pct(share, digits: int = 3):
    """A share as a percentage cut, never rounded up."""
    return F.floor(share * 100 * 10**digits + F.lit(1e-9)) / 10**digits


def retention(parts: DataFrame, by: list[str], area: str = "area", removed: str = "removed", base: str = "base_area") -> DataFrame:
    """Kept area over two denominators: the own area, and the area on the base it was priced on; gaps are counted."""
    out = parts.groupBy(*by).agg(
        F.sum(area).alias("area_in"), F.sum(F.when(F.col(removed), F.col(area)).otherwise(0.0)).alias("area_removed"),
        F.sum(base).alias("area_base"), F.count_if(F.col(base).isNull()).alias("n_gaps"), F.count("*").alias("n_parts"),
    )
    kept = F.col("area_in") - F.col("area_removed")
    return out.select(*by, "n_parts", "n_gaps", "area_in", "area_removed", (kept / F.col("area_in")).alias("retained_own"), (1 - F.col("area_removed") / F.col("area_base")).alias("retained_base"))


def area_core(parts: DataFrame, by: str, area: str, order: list[str], fraction: float = 0.999) -> DataFrame:
    """The smallest prefix, by falling area, that reaches a fraction of each group's area: a row stays while the sum before it is short."""
    w = Window.partitionBy(by).orderBy(F.desc(area), *order)
    before = F.coalesce(F.sum(area).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(area).over(Window.partitionBy(by))
    return parts.withColumn("_before", before).withColumn("_whole", whole).where(F.round(F.col("_before"), 6) < F.round(F.col("_whole") * fraction, 6)).drop("_before", "_whole")


def recovery(pieces: DataFrame, parent: str, piece: str, area: str, kept: str) -> DataFrame:
    """Of each parent: share of the largest kept piece, kept pieces, pieces over 1 %, and whether nothing is left."""
    sums = pieces.where(kept).groupBy(parent, piece).agg(F.sum(area).alias("a"))
    whole = pieces.groupBy(parent).agg(F.sum(area).alias("whole"))
    agg = whole.join(sums, parent, "left").groupBy(parent, "whole").agg(F.max("a").alias("main"), F.count("a").alias("descendants"), F.count_if(F.col("a") > 0.01 * F.col("whole")).alias("fragments"))
    return agg.select(parent, F.coalesce(F.col("main") / F.col("whole"), F.lit(0.0)).alias("r_main"), "descendants", "fragments", (F.col("descendants") == 0).alias("destroyed"))


def dispositions(rows: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    """A column per state, in a fixed order, and a total."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states], F.count("*").alias("n_total"))


def gate(rows: DataFrame, name: str, fails, key: str, shown: int = 20) -> DataFrame:
    """One condition over a corpus: whether it holds, how many offend, and the first of them by name."""
    bad = F.when(fails, F.col(key))
    out = rows.agg(F.count("*").alias("n_checked"), F.count(bad).alias("n_offenders"), F.slice(F.sort_array(F.collect_list(bad)), 1, shown).alias("offenders"))
    return out.select(F.lit(name).alias("condition"), "n_checked", "n_offenders", (F.col("n_offenders") == 0).alias("holds"), F.array_join(F.transform("offenders", lambda x: x.cast("string")), ",").alias("offenders"))


def coverage(roster: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Roster against results in both directions: ok, missing or extra."""
    a, b = roster.select(key).distinct().withColumn("_a", F.lit(True)), results.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def duplicates(rows: DataFrame, content: list[str], name: str) -> DataFrame:
    """Rows with equal content: the smallest name is canonical, the others are its duplicates."""
    w = Window.partitionBy(*content)
    first = F.min(name).over(w)
    return rows.withColumn("canonical", first).withColumn("duplicate_of", F.when(F.col(name) != first, first)).withColumn("n_equal", F.count("*").over(w))


def manifest(rows: DataFrame, by: list[str], path: str, size: str, digest: str) -> DataFrame:
    """One digest per group over its sorted rows; a row without a size is declared but absent."""
    line = F.concat_ws("|", F.col(path).cast("string"), F.coalesce(F.col(size).cast("string"), F.lit("absent")), F.coalesce(F.col(digest).cast("string"), F.lit("absent")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("n_rows"))


def resume_plan(work: DataFrame, done: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """What to do with each unit of work: run, rerun with the first reason that applies, or skip."""
    past = done.select(key, F.lit(True).alias("_done"), F.col("terminal").alias("_terminal"), *[F.col(c).alias(f"_{c}") for c in watched])
    out = work.join(past, key, "left")
    decision = F.when(F.col("_done").isNull(), "run").when(~F.coalesce("_terminal", F.lit(False)), "rerun_previous_failure")
    for c in watched:  # an unknown past value is a mismatch
        decision = decision.when(~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)), f"rerun_{c}_changed")
    return out.select(key, decision.otherwise("skip").alias("decision"))


def drift(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field, what differs between two versions of a table; nulls equal nulls."""
    a = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in fields], F.lit(1).alias("_a"))
    b = after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in fields], F.lit(1).alias("_b"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in fields]))
    return a.join(b, key, "full_outer").select(key, cells.alias("d")).select(key, "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


def shard(rows: DataFrame, order: list[str], index: int, of: int) -> DataFrame:
    """Every of-th row after sorting, from `index` on."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("_n") % of == index).drop("_n")


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last record of each key wins."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def missing_numbers(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers that each group lacks between its least and greatest."""
    ends = rows.where(F.col(number).isNotNull()).groupBy(by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = ends.select(by, F.explode(F.sequence("lo", "hi")).alias(number))
    return every.join(rows.select(by, number).distinct(), [by, number], "left_anti")


def same_identity(a: DataFrame, b: DataFrame, key: str, part: str, digest: str) -> DataFrame:
    """Of each key of either table: whether both name the same parts with the same digests; null where one side has no usable part.

    A part is usable when it has a digest; parts without one count as absent. A part given twice counts once."""
    side = lambda t, n: t.where(F.col(part).isNotNull() & F.col(digest).isNotNull()).select(key, F.col(part).cast("string").alias("_p"), F.col(digest).cast("string").alias("_d")).distinct().withColumn(n, F.lit(1))
    met = side(a, "_a").join(side(b, "_b"), [key, "_p", "_d"], "full_outer").groupBy(key).agg(F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("odd"))
    keys = a.select(key).unionByName(b.select(key)).distinct()
    return keys.join(met, key, "left").select(key, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("odd") == 0).alias("same"))


def published_agrees(published: DataFrame, found: DataFrame, key: str, part: str, digest: str) -> DataFrame:
    """Of each key found: whether every digest that is published for it equals the one found; null where none is published.

    A published part that was not found, or has no digest there, disagrees. found: one row for a key and part."""
    listed = published.where(F.col(digest).isNotNull()).select(key, part, F.col(digest).alias("_published"))
    met = listed.join(found.select(key, part, F.col(digest).alias("_found")), [key, part], "left")
    said = met.groupBy(key).agg(F.every(F.coalesce(F.col("_published") == F.col("_found"), F.lit(False))).alias("agrees"))
    return found.select(key).distinct().join(said, key, "left")


def verification(records: DataFrame, by: str, checked, status, censused, clean, ok) -> DataFrame:
    """One row over a corpus' verification records: counts of what was checked, matched, censused and clean, and states by `by` (a few).

    Conditions are columns; a null one does not hold, and a censused record that is not known to be clean is not clean. Names are
    rows of `verification_failures`, so that no list grows with the corpus."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    counts = {
        "n_records": F.lit(True), "n_checked": holds(checked), "n_match": holds(checked) & holds(status), "n_mismatch": holds(checked) & ~holds(status),
        "n_censused": holds(censused), "n_clean": holds(censused) & holds(clean), "n_not_clean": holds(censused) & ~holds(clean),
        "n_ok": holds(ok), "n_failed": ~holds(ok),
    }
    sums = records.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    states = records.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("state")).agg(F.count("*").alias("n"))
    listed = states.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "state", "n"))), ",").alias("states"))
    return sums.crossJoin(listed)


def verification_failures(records: DataFrame, name: str, status, clean, ok) -> DataFrame:
    """A row for each failed record, with the first problem that applies."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    why = F.when(~holds(status), "digest differs").when(~holds(clean), "not clean").otherwise("refused")
    return records.where(~holds(ok)).select(name, why.alias("problem"))
