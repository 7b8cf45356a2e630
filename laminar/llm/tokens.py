"""Token counts by a two-tier lookup of pre-tokens, and token ids as range-ordered ORC files.

The word vocabulary drops white space, so a text's tokens are those of its pieces between blanks, one after the
other. `WordEncoder` keeps the ids of pieces it has met; what it has not met is split and merged by the library.
Any other vocabulary is encoded by its library text by text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.llm.common import buffers, keyed, steps, unkeyed

#: Frequent pieces that are broadcast, and pieces whose counts one task hands in; both bound what reaches the driver.
FREQUENT, PER_TASK = 65_536, 16_384
#: Pieces that a worker counts or keeps at once.
COUNTING, KEPT = 200_000, 400_000
#: A document of more tokens is over the limit.
LIMIT = 2048

#: The settings of the vocabulary for which pieces between blanks are independent.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Blanks at which a text is cut; other white space stays in a piece and is the library's to handle.
_BLANKS = re.compile("[ \t\n\r]+")
#: Pieces of these characters are split here as the library would: their classes, case and normal form are not in doubt.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """piece -> ids as little-endian 32-bit integers. Holds `kept` pieces at most, besides the fixed ones."""

    def __init__(self, path: str, fixed: dict[str, bytes] | None = None, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.fixed, self.kept = fixed or {}, kept
        self.update(self.fixed)

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= self.kept:
                self.parts.clear()
            shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = self.parts[part] = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.kept + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        if _PLAIN.fullmatch(piece) and "<|" not in piece:
            ids = b"".join([self._part(x) for x in _SPLIT.findall(piece.lower())])
        else:
            ids = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str, plain: bool = False) -> bytes:
        return b"".join([self[x] for x in (text.split() if plain else pieces(text))])


class TextEncoder:
    """Any other vocabulary: whole texts through its library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: model.encode(text)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.ids = lambda text: whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str, plain: bool = False) -> bytes:
        return array("I", self.ids(text)).tobytes()


def pieces(text: str) -> list[str]:
    """What lies between blanks. str.split() is the faster way, right where the text holds no rarer white space."""
    found = text.split()
    if text.isascii() and not _RARE_ASCII.search(text):
        return found
    if _RARE.search(text):
        return [x for x in _BLANKS.split(text) if x]
    return found


_RARE_ASCII = re.compile("[\x0b\x0c\x1c-\x1f]")
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


#: First bytes of the rarer white space in UTF-8, and of much else.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def plain(texts: pa.Array) -> list[bool]:
    """Of each text, whether no byte of it can begin rarer white space, so that str.split() finds its pieces."""
    data, at = buffers(texts)
    out = np.ones(len(texts), bool)
    out[np.searchsorted(at, np.flatnonzero(_SUSPECT[data]), "right") - 1] = False
    return out.tolist()


def word_level(path: str) -> bool:
    """Whether pieces between blanks can be encoded one by one with this vocabulary."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    try:
        first, second = said["pre_tokenizer"]["pretokenizers"]
        return (
            [x["type"] for x in said["normalizer"]["normalizers"]] == _NORMALIZER
            and first["pattern"] == {"Regex": _PIECES} and first["behavior"] == "Removed" and first["invert"]
            and second["type"] == "ByteLevel" and not second["add_prefix_space"] and not second["use_regex"]
            and said["model"]["type"] == "BPE" and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"])
        )
    except (KeyError, TypeError, ValueError):
        return False


_encoders: dict = {}


def _encoder(path: str):
    """The worker's encoder of a vocabulary; it outlives tasks, and with it the pieces it has met."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if word_level(path) else TextEncoder(path)
    return _encoders[path]


def frequent_pieces(docs: DataFrame, most: int = FREQUENT, per_task: int = PER_TASK) -> list[str]:
    """The pieces that all documents hold most often, approximately. Each task counts its own documents, dropping the rarest when
    its table is full, and hands in its `per_task` leading pieces; only those sums are shuffled, never pre-tokens."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    seen.update(pieces(text.as_py()))
                    if len(seen) > COUNTING:
                        seen = Counter(dict(seen.most_common(COUNTING // 4)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    sums = docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in sums.orderBy(F.desc("n"), "piece").limit(most).collect() if len(r.piece) <= 64]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs, repeated rows and null ids included.

    A null or empty text has 0 bytes and 0 tokens. Columns of docs other than doc_id and text play no part.
    Tier one is a broadcast table of frequent pieces, of `most` entries at most; tier two each worker's own bounded
    cache in front of the library. No pre-token is shuffled and a lost executor's tasks simply run again.
    """
    spark = docs.sparkSession
    table = None
    if word_level(path):
        known = WordEncoder(path)
        table = spark.sparkContext.broadcast({x: len(known[x]) // 4 for x in frequent_pieces(docs, most)})

    def count(batches):
        first = table.value if table is not None else {}
        encoder = _encoder(path)
        second: dict[str, int] = {}
        for whole in batches:
            for batch in steps(whole):
                n_bytes, n_tokens = [], []
                for text, p in zip(batch.column("text").to_pylist(), plain(batch.column("text"))):
                    text = text or ""
                    n_bytes.append(len(text.encode()))
                    if table is None:
                        n_tokens.append(len(encoder.encode(text)) // 4)
                        continue
                    n = 0
                    for piece in text.split() if p else pieces(text):
                        if (k := first.get(piece)) is None and (k := second.get(piece)) is None:
                            if len(second) >= KEPT:
                                second.clear()
                            k = second[piece] = len(encoder.__missing__(piece)) // 4
                            encoder.pop(piece, None)
                        n += k
                    n_tokens.append(n)
                tokens = pa.array(n_tokens, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), tokens, pa.array(np.array(n_tokens, np.int64) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


#: One row a document: its key, its row in its part, the number of its ids with the end id, the ids, and the part it lies in.
ORC_SCHEMA = "doc_key long, row long, n_tokens int, ids array<int>, part int"
#: Rows that an entry of the row index covers.
STRIDE = 1000


def write_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Token ids of every text, the end id after each, as ORC files under `path` in ascending order of doc_id.

    Texts (not the longer ids) are dealt by ranges of doc_id and sorted, then encoded and written in the same stage, so
    file order is id order; each row says which of its part it is. Ids are run-length coded integers; a row index entry covers STRIDE
    documents and a Bloom filter lies on doc_key, so readers take stripes side by side or skip them by id. A null text is empty, rows
    of one id lie together in the order of their texts, null ids come last, and without rows there is no part.
    """

    def encode(batches):
        encoder, end = _encoder(vocabulary), array("I", [end_id]).tobytes()
        done = 0
        for whole in batches:
            for batch in steps(whole):
                texts = batch.column("text")
                rows = [encoder.encode(text or "", p) + end for text, p in zip(texts.to_pylist(), plain(texts))]
                sizes = np.array([len(x) // 4 for x in rows], np.int32)
                at = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(sizes, out=at[1:])
                ids = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(rows))])
                own = pa.array(np.arange(done, done + len(rows)))
                done += len(rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_key"), own, pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), ids)], names=["doc_key", "row", "n_tokens", "ids"])

    (
        keyed(docs, "text").repartitionByRange("doc_key").sortWithinPartitions("doc_key", "text")
        .mapInArrow(encode, "doc_key long, row long, n_tokens int, ids array<int>")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_key").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(STRIDE)).option("orc.stripe.size", str(16 << 20)).orc(path)
    )


def read_orc(spark, path: str) -> DataFrame:
    """What the files of write_orc hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (unsigned, of
    the ids as little-endian 32-bit integers).

    Parts are summed from the n_tokens column alone, a row a part; inside a part the running sum follows the rows as they lie there."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8)
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "part", "row")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_key", "part", "row", "n_tokens", "ids_crc32"])

    raw = spark.read.schema(ORC_SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.select("doc_key", "part", "row", "ids").mapInArrow(digest, "doc_key long, part int, row long, n_tokens long, ids_crc32 long")
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(parts, "part").select(unkeyed().alias("doc_id"), start.alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the given documents, from the row groups that the files' index and Bloom filters do not rule out."""
    wanted = spark.read.schema(ORC_SCHEMA).orc(path).where(F.col("doc_key").isin([int(i) for i in doc_ids]))
    return wanted.select(unkeyed().alias("doc_id"), "ids")
