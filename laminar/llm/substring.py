"""Substring dedup by hashed blocks and windows; these stand in for a relative Lempel-Ziv parse, no longest match is sought.

Every document is cut into blocks: runs of windows (20 consecutive words) that share an anchor, the leftmost
smallest of their hashed 5-word seeds. Where a window occurs again, its anchor does too, so equal passages are cut into
equal blocks wherever they lie. Every distinct block has a first place in the corpus; a block that is not at its first
place goes as a whole. Where a repeated passage ends inside a block, blocks that share an anchor with a
different block are checked window by window against the first place of each window.

A window goes when its words also start earlier: in a smaller doc_id, or further up in the same document. Null and empty
texts, and those of fewer than 20 words, have no window. Rows that share a doc_id, and all rows without one
(they come last), are ordered by a hash of the text; of rows with the same text, one comes first. Other columns, clashing names included, play no part.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import ROW, WORD_BASE, copies_counted, mix, prefix, rows_keyed, signed, span_hash, steps, unkeyed, word_hashes, written

#: Words of a window, and of the seeds that anchor it.
WINDOW, SEED = 20, 5


class Parsed:
    """Windows and blocks of a batch of texts. Positions count words over the whole batch."""

    def __init__(self, texts: pa.Array, window: int, seed: int):
        words, self.first = word_hashes(texts)
        self.n_words = np.diff(self.first)
        self.sums = prefix(words, WORD_BASE)
        self.window = window
        n = np.maximum(self.n_words - window + 1, 0)
        self.text_of = np.repeat(np.arange(len(texts)), n)
        before = np.cumsum(n) - n
        self.starts = np.arange(len(self.text_of)) - before[self.text_of] + self.first[self.text_of]
        if not len(self.starts):
            self.block_start = self.block_text = np.zeros(0, np.int64)
            self.seed = self.key = np.zeros(0, np.uint64)
            self.block_of = np.zeros(0, np.int64)
            return
        at = np.arange(len(words) - seed + 1)
        value, where, have = span_hash(self.sums, at, at + seed, WORD_BASE), at, 1
        seeds, span = value, window - seed + 1
        while have < span:
            step = min(have, span - have)
            later = value[step:] < value[:-step]
            where = np.where(later, where[step:], where[:-step])
            value = np.minimum(value[step:], value[:-step])
            have += step
        anchor = where[self.starts]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (self.text_of[1:] != self.text_of[:-1])]
        begin = np.flatnonzero(fresh)
        last = np.r_[begin[1:], len(fresh)] - 1
        self.block_of = np.cumsum(fresh) - 1
        self.block_start, self.block_text = self.starts[begin], self.text_of[begin]
        self.seed = seeds[anchor[begin]]
        shape = ((anchor[begin] - self.block_start) * (window + 1) + self.starts[last] - self.block_start).astype(np.uint64)
        self.key = mix(span_hash(self.sums, self.block_start, self.starts[last] + window, WORD_BASE) ^ mix(shape + np.uint64(1)))


def _earliest(text: np.ndarray, seed: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each text first has each key; entries come in the order of their positions."""
    order = np.lexsort((key, seed, text))
    t, s, k = text[order], seed[order], key[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])] if len(order) else np.zeros(0, bool)
    return order[new]


def _blocks(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Every document's different blocks, where they come first: the document, first word, seed hash and the hash of all its words."""

    def parse(batches):
        for whole in batches:
            for batch in steps(whole):
                p = Parsed(batch.column("text"), window, seed)
                new = _earliest(p.block_text, p.seed, p.key)
                of = p.block_text[new]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(batch.column(k).to_numpy()[of]) for k in ROW), pa.array((p.block_start[new] - p.first[of]).astype(np.int32)), pa.array(signed(p.seed[new])), pa.array(signed(p.key[new]))],
                    names=[*ROW, "at", "seed", "block"],
                )

    return docs.mapInArrow(parse, "doc_key long, tie long, at int, seed long, block long")


def _checked(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Every window of the blocks in `ats`, with its hash next to its block's seed."""

    def expand(batches):
        for whole in batches:
            for batch in steps(whole):
                p = Parsed(batch.column("text"), window, seed)
                if not len(p.starts):
                    continue
                wanted = _marked(p, batch.column("ats"))[p.block_of]
                start, of, anchor = p.starts[wanted], p.text_of[wanted], p.seed[p.block_of[wanted]]
                words = span_hash(p.sums, start, start + window, WORD_BASE)
                new = _earliest(of, anchor, words)
                start, of = start[new], of[new]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(batch.column(k).to_numpy()[of]) for k in ROW), pa.array((start - p.first[of]).astype(np.int32)), pa.array(signed(anchor[new])), pa.array(signed(words[new]))],
                    names=[*ROW, "at", "seed", "words"],
                )

    return docs.mapInArrow(expand, "doc_key long, tie long, at int, seed long, words long")


def _positions(p: Parsed, lists: pa.Array, among: np.ndarray) -> np.ndarray:
    """Where `among` has the word positions that the lists of each text hold."""
    sizes = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    word = (at + p.first[of])[at < p.n_words[of]]
    place = np.searchsorted(among, word)
    return place[(place < len(among)) & (among[np.minimum(place, len(among) - 1)] == word)]


def _marked(p: Parsed, lists: pa.Array) -> np.ndarray:
    """Which blocks begin at a listed word."""
    out = np.zeros(len(p.block_start), bool)
    out[_positions(p, lists, p.block_start)] = True
    return out


def _removed(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs with first places: a block's in `ats`, a checked window's in `wins`. Any other window goes, and all of a copy."""

    def drop(batches):
        for whole in batches:
            for batch in steps(whole):
                p = Parsed(batch.column("text"), window, seed)
                gone = np.zeros(int(p.first[-1]) + 1, np.int32)
                if len(p.starts):
                    stays = _marked(p, batch.column("ats"))[p.block_of]
                    stays[_positions(p, batch.column("wins"), p.starts)] = True
                    stays &= batch.column("copy").to_numpy()[p.text_of] == 0
                    np.add.at(gone, p.starts[~stays], 1)
                    np.add.at(gone, p.starts[~stays] + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                n_removed, kept, factors = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    mine = covered[p.first[i] : p.first[i + 1]]
                    words = text.encode().split() if text else []
                    n_removed.append(int(mine.sum()))
                    kept.append(b" ".join(compress(words, (~mine).tolist()) if n_removed[-1] else words).decode())
                    edges = np.flatnonzero(np.diff(np.r_[False, mine, False])) if n_removed[-1] else np.zeros(0, int)
                    factors.append(edges.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_key"), pa.array(p.n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, pa.list_(pa.int32()))],
                    names=["doc_key", "n_words", "n_removed", "kept_text", "spans"],
                )

    return docs.mapInArrow(drop, "doc_key long, n_words long, n_removed long, kept_text string, spans array<int>")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words, one space between) and spans (start, end, ... of the removed
    words) of every row of docs.

    About two words in seventeen begin a block. Blocks are shuffled by seed, as five numbers each, under a
    partial aggregation, and the first places written, so that what follows reads them twice without a second shuffle; only blocks of a seed with different blocks are shuffled again, in a join whose hot seeds AQE
    splits. Texts are shuffled once, by document, and never gathered by content."""
    whole = rows_keyed(docs)
    blocks = _blocks(whole, window, seed)
    first = F.min(F.struct(*ROW, "at")).alias("first")
    seeds = blocks.groupBy("seed").agg(F.min("block").alias("low"), F.max("block").alias("high"), first)
    seeds = written(seeds.select("first.*", F.when(F.col("low") != F.col("high"), F.col("seed")).alias("seed")), "seeds")
    alone = seeds.where("seed IS NULL").select(*ROW, "at")
    several = seeds.where("seed IS NOT NULL").select("seed")
    distinct = blocks.join(several.hint("merge"), "seed", "left_semi").groupBy("seed", "block").agg(first).select("first.*")
    at_edges = distinct.groupBy(*ROW).agg(F.collect_set("at").alias("ats"))
    windows = _checked(whole.join(at_edges.hint("merge"), ROW), window, seed)
    checked = windows.groupBy("seed", "words").agg(first).select("first.*")
    firsts = alone.select(*ROW, "at", F.lit(None).cast("int").alias("win")).unionByName(checked.select(*ROW, F.lit(None).cast("int").alias("at"), F.col("at").alias("win")))
    firsts = firsts.groupBy(*ROW).agg(F.collect_set("at").alias("ats"), F.collect_set("win").alias("wins"))
    met = copies_counted(whole.join(firsts.hint("merge"), ROW, "left"))
    none = F.array().cast("array<int>")
    found = _removed(met.select("doc_key", "text", "copy", F.coalesce("ats", none).alias("ats"), F.coalesce("wins", none).alias("wins")), window, seed)
    return found.select(unkeyed().alias("doc_id"), "n_words", "n_removed", "kept_text", "spans")
