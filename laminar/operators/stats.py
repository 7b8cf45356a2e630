"""Statistics of the studies: percentiles, ranks, survival, bands, permutation tests, event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, p90, p99 (linear interpolation) and max of what is not null."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), p.alias("p"), F.max(value).alias("max"))
    return out.select(*by, "n", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("median", "p90", "p99"))], "max")


def rank_auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with averaged ties; null where a class is empty.

    Scores are counted per value first, so that a window holds distinct values, not rows."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(positive).alias("pos"))
    w = Window.partitionBy(*by).orderBy(score)
    below = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))
    auc = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auc"))


def auc_verdict(auc, geometry=None):
    """Whether a signal stands, and whether a plain measure does as well."""
    plain = F.when(auc > 0.75, "STANDS").when(auc > 0.65, "SUGGESTIVE").otherwise("DEAD")
    return plain if geometry is None else F.when(F.abs(geometry - 0.5) + 0.5 >= auc - 0.05, "CONFOUNDED").otherwise(plain)


def survival(rows: DataFrame, by: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Number and share of values above each threshold."""
    arms = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) > t).alias("n_above")) for t in thresholds])
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), arms.alias("s"))
    return out.select(*by, "n", F.explode("s").alias("s")).select(*by, "n", "s.*", F.when(F.col("n") > 0, F.col("s.n_above") / F.col("n")).alias("share"))


def rounded(value, digits: int):
    """value to so many digits, halves away from zero, of the scaled double as SQL engines and C take it; F.round goes by the shortest
    decimal of the unscaled one, which puts 135.015 (a hundred times that is 13501.499...) at 135.02."""
    return F.round(value * 10.0**digits) / 10.0**digits


def bands(rows: DataFrame, by: str, value: str, ratio: float = 1.4, gap: float = 0.05) -> DataFrame:
    """Sorted values split where the next is at least `ratio` times and `gap` more: band number, ends and size."""
    w = Window.partitionBy(by).orderBy(value)
    last = F.lag(value).over(w)
    cut = F.coalesce(((F.col(value) >= last * ratio) & (F.col(value) - last >= gap)).cast("int"), F.lit(0))
    return rows.select(by, value).distinct().withColumn("cut", cut).withColumn("band", F.sum("cut").over(w)).groupBy(by, "band").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n_values"))


def size_model(rows: DataFrame, size: str, bad: str, edges: list[float], q: float) -> DataFrame:
    """Observed and modelled rate 1 - (1 - q)**size by band of size."""
    band = F.lit(0)
    for e in edges:
        band = band + (F.col(size) >= e).cast("int")
    return rows.withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"), F.avg(F.col(bad).cast("double")).alias("observed"), F.avg(1 - F.pow(F.lit(1 - q), F.col(size).cast("double"))).alias("modelled"))


def permutation_null(rows: DataFrame, score: str, positive: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Observed AUC, and the share of label permutations that reach it.

    A permutation is a seeded hash order of the rows of which the first n_pos are positive; each round is a group of its
    own, so rounds spread over tasks."""
    real = rank_auc(rows, [], score, positive)
    n_pos = int(real.first().n_pos or 0)
    keyed = rows.select(score, F.xxhash64(*rows.columns).alias("k"))
    spread = keyed.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    w = Window.partitionBy("round").orderBy(F.xxhash64("k", "round", F.lit(seed)), "k")
    null = rank_auc(spread.withColumn("p", F.row_number().over(w) <= n_pos), ["round"], score, "p")
    return null.agg(F.count("*").alias("rounds"), F.collect_list("auc").alias("a")).withColumn("auc", F.lit(real.first().auc)).select("rounds", "auc", (F.size(F.filter("a", lambda x: x >= F.col("auc"))) / F.col("rounds")).alias("p"))


def confusion(rows: DataFrame, found: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1; null where undefined."""
    n = lambda f, t: F.count_if(F.col(found).eqNullSafe(F.lit(f)) & F.col(truth).eqNullSafe(F.lit(t)))
    out = rows.groupBy(*(by or [])).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"))
    precision, recall = (F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))) for x in ("fp", "fn"))
    return out.select(*(by or []), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def enrichment(rows: DataFrame, flagged: str, differs: str) -> DataFrame:
    """Rate of `differs` among flagged rows and controls, unknowns left out, and the ratio of the two."""
    rate = lambda f: F.avg(F.when(F.col(flagged).eqNullSafe(F.lit(f)), F.col(differs).cast("double")))
    out = rows.agg(rate(True).alias("rate_flagged"), rate(False).alias("rate_control"), F.count_if(F.col(differs).isNull()).alias("n_unknown"))
    return out.withColumn("enrichment", F.when(F.col("rate_control") > 0, F.col("rate_flagged") / F.col("rate_control")))


def thinned(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced in order, ends included."""
    total = rows.count()
    if total <= n:
        return rows
    at = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_n").isin(at)).drop("_n")


def hashed_sample(rows: DataFrame, by: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each class, lowest by seeded hash: the same rows whatever the partitioning."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def crossing_status(n):
    return F.when(n > 0, "present").otherwise("none")


#: The ratio of two period estimates that still agree, both ends included.
PERIOD_RATIO = (0.8, 1.25)


def period_status(turning, consistent, neighbour):
    """Whether two estimates of a period agree; null and NaN are unmeasurable."""
    gone = turning.isNull() | F.isnan(turning)
    none = neighbour.isNull() | F.isnan(neighbour) | (neighbour <= 0)
    ratio = turning / neighbour
    return F.when(gone, "unavailable").when(~F.coalesce(consistent, F.lit(False)), "disagreed").when(none, "unavailable").when(ratio.between(*PERIOD_RATIO), "agreed").otherwise("disagreed")


#: Separations, in revolutions, between the three ranges.
NEARBY, WIDE = 0.15, 1.6


def separation_band(separation):
    """A literal range of the separation, for grouping only."""
    return F.when(separation.isNull(), "no crossing").when(separation < NEARBY, f"< {NEARBY} rev").when(separation < WIDE, f"{NEARBY} - {WIDE} rev").otherwise(f">= {WIDE} rev")


def verdict(crossing, period, separation):
    """What was measured, in a few words; a separation in revolutions only where both periods agree."""
    known = (period == "agreed") & separation.isNotNull()
    said = F.concat(F.lit("crosses itself; widest separation "), F.format_string("%.2f", separation), F.lit(" revolutions"))
    return F.when(crossing == "none", "does not cross itself").when(known, said).when(period == "disagreed", "crosses itself; periods disagree").otherwise("crosses itself; period unavailable")
