"""What the corpus operators share: scratch tables, keys for rows without an id, and word hashes over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminar.scratch import scratch_path, shared_dir, written  # noqa: F401

#: Stands for a missing id: rows without one count together as one document that comes last.
NO_ID = 2**63 - 1
#: Text bytes that one step of a numpy kernel looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict = {}


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a key that is never null, with the columns asked for; other columns, clashing names included, stay out."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), *columns)


#: With doc_key, tells rows apart that share an id or have none: a hash of the text. Rows equal in both are copies.
ROW = ["doc_key", "tie"]


def rows_keyed(docs: DataFrame) -> DataFrame:
    """doc_key, tie and text of every row."""
    return keyed(docs, F.xxhash64("text").alias("tie"), "text")


def copies_counted(rows: DataFrame) -> DataFrame:
    """rows with `copy`: 0 for the first row of a key, more for those that repeat it."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*ROW).orderBy("tie")) - 1)


def unkeyed(name: str = "doc_key"):
    return F.when(F.col(name) != NO_ID, F.col(name))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as keep it apart from df's columns."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(int(base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(n, base, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
            up[0] = down[0] = 1
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Running sums from which span_hash takes any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span lies."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES):
    """Slices of a batch that hold about `size` bytes of text, or one longer row."""
    texts = batch.column(column)
    _, at = buffers(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ of the texts, and where each text's words begin among them."""
    data, at = buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix(data.astype(np.uint64) + np.uint64(1), _P)
    return span_hash(sums, starts, stops, _P), np.searchsorted(starts, at)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


WORD_BASE = _Q
