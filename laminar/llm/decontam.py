"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

Words are lower-cased (A-Z only) runs of 0-9, a-z and everything beyond ASCII. A block of two words is looked up in a
shift table that skips positions no window can end at; where the shift is none, the suffix block selects the
windows to compare word by word. Windows of one length form one search, since the shortest bounds the skip.

A benchmark of MOST windows or fewer is broadcast whole, each worker building its tables once. Of a larger one only the shift
tables are broadcast, as hashed tables of a fixed size; the windows themselves stay distributed, and positions without a
shift meet them in an equi-join on the hash of the window's words, where the words are compared.

Null or empty texts have no words and are clean; an item without words matches nothing; an empty benchmark leaves
all documents clean; items of equal text are all reported, items of one id once, and a null item_id as "". Repeated
documents are reported each. Other columns play no part in the report and pass through `clean` untouched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import ROW, fresh, rows_keyed, unkeyed, written

WINDOW = 10
#: Windows of a benchmark that is broadcast whole; beyond them, cells of a hashed shift table (one for each window length).
MOST, CELLS = 200_000, 1 << 20

_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if re.match(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([b])) else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Search:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[tuple, set]] = {}

    def add(self, window: tuple, item: int) -> None:
        for j in range(self.block, self.length + 1):
            key = b" ".join(window[j - self.block : j])
            if self.shift.get(key, self.default) > self.length - j:
                self.shift[key] = self.length - j
        self.bucket.setdefault(b" ".join(window[-self.block :]), {}).setdefault(window, set()).add(item)

    def run(self, words: list[bytes], spans: list[int], items: set) -> None:
        """Appends start and end of each occurrence, and adds the items it belongs to."""
        length, default, shift, bucket = self.length, self.default, self.shift.get, self.bucket
        n, i = len(words), length - 1
        if self.block == 1:
            for i, word in enumerate(words):
                if word in bucket:
                    spans += i, i + 1
                    items.update(bucket[word][(word,)])
            return
        while i < n:
            key = words[i - 1] + b" " + words[i]
            if step := shift(key, default):
                i += step
                continue
            found = bucket[key].get(tuple(words[i - length + 1 : i + 1]))
            if found:
                spans += i - length + 1, i + 1
                items |= found
            i += 1


def windows(words: list[bytes], size: int) -> list[tuple]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def build(items: list[tuple[str, str]], size: int) -> tuple[list[Search], list[str]]:
    searches: dict[int, Search] = {}
    for at, (_, text) in enumerate(items):
        for window in windows(words_of(text), size):
            searches.setdefault(len(window), Search(len(window))).add(window, at)
    return list(searches.values()), [item for item, _ in items]


_built: dict = {}


def _tables(sent, size: int):
    """The search tables of a broadcast benchmark, built once a worker."""
    key = (sent.id, size)
    if key not in _built:
        _built.clear()
        _built[key] = build(sent.value, size)
    return _built[key]


class _Sent:
    def __init__(self, spark, value):
        self.sent = spark.sparkContext.broadcast(value)
        self.id = self.sent._jbroadcast.id()

    @property
    def value(self):
        return self.sent.value


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.selectExpr("coalesce(cast(item_id as string), '') AS item", "text").where("text IS NOT NULL")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item and words (joined by a blank) of every window."""

    def cut(batches):
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                mine = {b" ".join(w) for w in windows(words_of(text), size)}
                items += [item] * len(mine)
                found += [w.decode() for w in mine]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], names=["item", "words"])

    return _items(benchmark).mapInArrow(cut, "item string, words string")


def _covered(spans: list[int], n: int) -> int:
    """Words inside any span."""
    if len(spans) < 2:
        return 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans[0::2], 1)
    np.add.at(change, spans[1::2], -1)
    return int((np.cumsum(change) > 0).sum())


REPORT = "n_words long, n_hit long, items array<string>, spans array<int>"


def _report(n_words: list, spans: list, items: list) -> list:
    """The columns of REPORT."""
    hit = [_covered(at, n) for at, n in zip(spans, n_words)]
    return [pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]


def _searched(docs: DataFrame, sent: _Sent, size: int) -> DataFrame:
    """REPORT after doc_key, by one pass with the whole benchmark at hand."""

    def report(batches):
        searches, ids = _tables(sent, size)
        for batch in batches:
            n_words, items, spans = [], [], []
            for text in batch.column("text"):
                words, hit, at = words_of(text.as_py()), set(), []
                for search in searches:
                    search.run(words, at, hit)
                n_words.append(len(words))
                items.append(sorted({ids[i] for i in hit}))
                spans.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), *_report(n_words, spans, items)], names=["doc_key", "n_words", "n_hit", "items", "spans"])

    return docs.select("doc_key", "text").mapInArrow(report, f"doc_key long, {REPORT}")


def shifts(found: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """By window length a hashed shift table: per cell the least shift of the blocks that fall on it.

    Each task hands in its own least shifts, which are summed to a minimum per cell before they reach the driver: at
    most `cells` small integers a length, however large the benchmark is."""

    def least(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for words in batch.column("words").to_pylist():
                window = words.encode().split(b" ")
                n = len(window)
                block = min(2, n)
                table = tables.setdefault(n, np.full(cells, n - block + 1, np.uint8))
                for j in range(block, n + 1):
                    cell = zlib.crc32(b" ".join(window[j - block : j])) % cells
                    table[cell] = min(table[cell], n - j)
        for n, table in tables.items():
            hit = np.flatnonzero(table < n - min(2, n) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), n, np.int32)), pa.array(hit.astype(np.int32)), pa.array(table[hit].astype(np.int32))], names=["n", "cell", "shift"])

    rows = found.select("words").mapInArrow(least, "n int, cell int, shift int").groupBy("n", "cell").agg(F.min("shift").alias("shift")).toArrow()
    n, cell, shift = (rows.column(c).to_numpy() for c in ("n", "cell", "shift"))
    out = {}
    for k in np.unique(n):
        out[int(k)] = np.full(cells, k - min(2, k) + 1, np.uint8)
        out[int(k)][cell[n == k]] = shift[n == k]
    return out


def candidates(words: list[bytes], n: int, table) -> list[int]:
    """Where a window of n words may begin: the skip loop over a hashed shift table."""
    block, cells, i, out = min(2, n), len(table), n - 1, []
    while i < len(words):
        if step := table[zlib.crc32(b" ".join(words[i - block + 1 : i + 1])) % cells]:
            i += int(step)
            continue
        out.append(i - n + 1)
        i += 1
    return out


def _hash(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) - (1 << 63)


def _hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """ROW, start, stop and items of every occurrence, with the benchmark distributed.

    A third of all documents may hold one passage: its windows are then one hot hash of the join, which AQE splits, since the
    benchmark's side holds every different window once."""
    found = written(_windows(benchmark, size), "windows")
    tables = docs.sparkSession.sparkContext.broadcast(shifts(found))

    def seek(batches):
        for batch in batches:
            out: list = []
            for key, tie, text in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text"))):
                words = words_of(text)
                for n, table in tables.value.items():
                    for at in candidates(words, n, table):
                        said = b" ".join(words[at : at + n])
                        out.append((key, tie, at, at + n, _hash(said), said.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[*ROW, "start", "stop", "hash", "words"])

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("words"), batch.column("items"), pa.array([_hash(w.encode()) for w in batch.column("words").to_pylist()], pa.int64())], names=["said", "items", "hash"])

    listed = found.groupBy("words").agg(F.collect_set("item").alias("items")).mapInArrow(hashed, "said string, items array<string>, hash long")
    spots = docs.mapInArrow(seek, "doc_key long, tie long, start int, stop int, hash long, words string")
    return spots.join(listed.hint("merge"), "hash").where("words = said").select(*ROW, "start", "stop", "items")


def _met(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """REPORT after doc_key of every row of docs, with the benchmark distributed."""
    per = _hits(docs, benchmark, size).groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def report(batches):
        for batch in batches:
            n_words = [len(words_of(t)) for t in batch.column("text").to_pylist()]
            spans = [[x for s in sorted((s["start"], s["stop"]) for s in row or ()) for x in s] for row in batch.column("spots").to_pylist()]
            items = [x or [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), *_report(n_words, spans, items)], names=["doc_key", "n_words", "n_hit", "items", "spans"])

    return docs.join(per, ROW, "left").select("doc_key", "text", "spots", "items").mapInArrow(report, f"doc_key long, {REPORT}")


def _small(benchmark: DataFrame, size: int, most: int) -> list | None:
    """The benchmark's items where all their windows are `most` at most: counted before anything is collected."""
    n = F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    held = _items(benchmark).agg(F.sum(F.greatest(n - size, F.lit(1))).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if (held.n or 0) > most or (held.chars or 0) > 100 * most:
        return None
    return [(r.item, r.text) for r in _items(benchmark).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans (start, end, start, ...) of every row of docs.

    Without a shuffle where the benchmark is broadcast; otherwise candidate positions and texts are shuffled once."""
    rows = rows_keyed(docs)
    few = _small(benchmark, size, most)
    found = _met(rows, benchmark, size) if few is None else _searched(rows, _Sent(docs.sparkSession, few), size)
    return found.select(unkeyed().alias("doc_id"), "n_words", "n_hit", "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    few = _small(benchmark, size, most)
    if few is None:
        tie = fresh(docs, "tie")
        hit = _hits(rows_keyed(docs), benchmark, size).select(F.col("tie").alias(tie)).distinct()
        return docs.withColumn(tie, F.xxhash64("text")).join(hit, tie, "left_anti").select(*docs.columns)
    sent = _Sent(docs.sparkSession, few)

    def keep(batches):
        searches, _ = _tables(sent, size)
        for batch in batches:
            free = []
            for text in batch.column("text"):
                words, at, hit = words_of(text.as_py()), [], set()
                for search in searches:
                    if not at:
                        search.run(words, at, hit)
                free.append(not at)
            yield batch.filter(pa.array(free, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
