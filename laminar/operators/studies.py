"""Operators of the studies: profiles, descriptors, agreement of measurements, certificate checks, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(profile: Column) -> Column:
    """An array over its largest absolute value; null where that is zero."""
    top = F.array_max(F.transform(profile, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(profile, lambda x: x / top))


def contrast(profile: Column, near: int) -> Column:
    """Mean of the first `near` values less the mean of the others."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(F.slice(profile, 1, near)) - mean(F.slice(profile, near + 1, F.size(profile)))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def band_centres(profiles: DataFrame, key: str, profile: str, threshold: float, taps: int = 5) -> DataFrame:
    """Runs in which the moving mean exceeds a threshold: band number, centre and length. Gaps and islands over positions."""
    flat = profiles.select(key, F.posexplode(profile).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy(key).orderBy("i")
    mean = F.avg("x").over(w.rowsBetween(-(taps // 2), taps // 2))
    lit = flat.withColumn("m", F.round(mean, 9)).where(F.col("m") > threshold)
    run = lit.withColumn("run", F.col("i") - F.row_number().over(w))
    bands = run.groupBy(key, "run").agg(F.avg("i").alias("centre"), F.count("*").alias("length"))
    return bands.withColumn("band", F.row_number().over(Window.partitionBy(key).orderBy("centre"))).drop("run")


def agreement(rows: DataFrame, by: list[str], declared: str, measured: str, within: float = 0.2) -> DataFrame:
    """Ratio of measured to declared: median, quartiles, share within a tolerance, and Pearson's r."""
    both = rows.where(F.col(declared).isNotNull() & F.col(measured).isNotNull() & (F.col(declared) != 0)).withColumn("ratio", F.col(measured) / F.col(declared))
    q = F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = both.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.abs(F.col("ratio") - 1) <= within).cast("double")).alias("share_within"), F.corr(declared, measured).alias("r"))
    return out.select(*by, "n", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "share_within", "r")


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per matched key, largest and median of either side and the ratio of the largest."""
    side = lambda df, t: df.groupBy(key).agg(F.max(value).alias(f"max_{t}"), F.median(value).alias(f"median_{t}"))
    return side(a, "a").join(side(b, "b"), key).withColumn("ratio", F.when(F.col("max_b") != 0, F.col("max_a") / F.col("max_b")))


def problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Names of the checks each row fails, sorted; a check that cannot be decided fails."""
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))
    return rows.select(key, F.array_join(failed, ",").alias("problems"), F.size(failed).alias("n_problems"))


def disagreements(recorded: DataFrame, computed: DataFrame, key: str, fields: list[str], hard: list[str]) -> DataFrame:
    """Fields that differ between a record and its recomputation; fields not recorded are passed over."""
    arms = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"r.{c}").cast("double").alias("recorded"), F.col(f"c.{c}").cast("double").alias("computed"), F.lit(c in hard).alias("hard")) for c in fields]))
    met = recorded.alias("r").join(computed.alias("c"), F.col(f"r.{key}") == F.col(f"c.{key}")).select(F.col(f"r.{key}").alias(key), arms.alias("d"))
    return met.select(key, "d.*").where(F.col("recorded").isNotNull() & ~F.col("recorded").eqNullSafe(F.col("computed")))


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where("r = 1").drop("r")


def sweep(rows: DataFrame, value: str, label: str, thresholds: list[float]) -> DataFrame:
    """Size and label rate of what reaches each threshold, from one pass."""
    arms = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) >= t).alias("n"), F.count_if((F.col(value) >= t) & F.col(label)).alias("n_hit")) for t in thresholds]
    out = rows.agg(F.array(*arms).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("n_hit") / F.col("n")))


def widest_gaps(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k widest steps between neighbouring values of each group."""
    w = Window.partitionBy(by).orderBy(value)
    steps = rows.select(by, value).distinct().withColumn("after", F.lead(value).over(w)).where("after IS NOT NULL").withColumn("gap", F.round(F.col("after") - F.col(value), 6))
    return steps.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("gap"), value))).where(F.col("rank") <= k)


def names(column: Column) -> dict[str, Column]:
    """Parts of a segment's name: winding number, voxel size in micrometres, and the name without its folder."""
    pick = lambda pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    return {"winding": pick(r"-w(\d{3})(?:_|$)").cast("int"), "voxel_um": pick(r"(\d+(?:\.\d+)?)um").cast("double"), "name": F.element_at(F.split(column, "/"), -1)}
