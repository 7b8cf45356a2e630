"""Meshes that the driver's tables hold: a view both Spark and SQL can state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sheet folded over itself: a row for each embedding, its 64 values out and back over the same ground.
FOLDED = """
SELECT CAST({surface} AS BIGINT) AS surface_id, CAST({row} AS INTEGER) AS v, CAST(u AS INTEGER) AS u,
  CAST(CASE WHEN u < 32 THEN 6.0 * (u + 0.0737 * {shift}) ELSE 6.0 * (63 - u + 0.2 + 0.0313 * {shift}) END AS FLOAT) AS x,
  CAST(CASE WHEN u < 32 THEN 6.0 * ({row} + 0.0719 * {shift}) ELSE 6.0 * ({row} + 0.0719 * {shift}) + 0.7 END AS FLOAT) AS y,
  CAST(6.0 * CAST(e AS DOUBLE) AS FLOAT) AS z
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_sheet(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    """One surface with a row per vec_id; by_label: a surface per label, rows numbered in order of vec_id."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "embeddings")
    if by_label:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    cells = rows.select("*", F.posexplode("embedding").alias("u", "e"))
    said = FOLDED.format(surface="label" if by_label else "0", row="r" if by_label else "vec_id", shift="label" if by_label else "0")
    wide = _doubles(said, "CAST({} AS DOUBLE)")
    return cells.selectExpr(*[c.strip() for c in _columns(wide)])


def _doubles(sql: str, form: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"\b\d+\.\d+\b", lambda m: form.format(m[0]), sql)


def _columns(sql: str) -> list[str]:
    """Columns of a select list, split at commas outside parentheses."""
    body, depth, out, part = sql.strip().removeprefix("SELECT"), 0, [], ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def folded_sql(by_label: bool = False) -> str:
    """The same view in DuckDB's SQL."""
    if by_label:
        rows = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)"
    else:
        rows = "embeddings"
    said = FOLDED.format(surface="label" if by_label else "0", row="r" if by_label else "vec_id", shift="label" if by_label else "0")
    wide = _doubles(said, "{}::DOUBLE")
    return f"{wide} FROM (SELECT *, unnest(range(0, len(embedding))) AS u, unnest(embedding) AS e FROM {rows})"
