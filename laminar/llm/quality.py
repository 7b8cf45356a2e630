"""Quality classifier by co-training: a content view and a metadata view teach each other, then judge together.

Content: shape statistics of the whole text, and the shares of its words by hashed cell. Metadata: language and source, alone and
together, hashed; nothing that the text itself shows, so that each view can teach the other. Both start from a
bounded sample of labelled rows; in each round each view judges every unlabelled document and hands its most confident
pseudo-labels, a share of all of them, to the other, which is fitted anew by Newton steps whose gradients and Hessians
are summed over all tasks; held-out labels calibrate each view and the sum of the two. All documents are scored.

A document that both views choose in a round is handed both ways; none is handed again in a later round. Documents
without an id have no label. Null or empty texts have all-zero content and are scored so; null metadata is a value of its own. Repeated ids in
the labels count each; a tie at the threshold is kept. Without labels of both classes every score is 0.5 and all
rows are kept. Other columns, clashing names included, play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import SPACE, buffers, mix, steps, word_hashes, written

#: Labelled rows the models may be fitted on: the lowest by hash of id. Rounds, and the share of all unlabelled
#: documents that a view hands on in a round, as far as their margins pass SURE.
LABELLED, ROUNDS, HANDED, SURE = 20_000, 4, 0.025, 2.2
#: Newton steps of a fit, at most; largest change of a weight after which no other follows; bins of a margin's size.
STEPS, SETTLED, BINS = 12, 1e-3, 4096
#: Share of the labelled rows that is held out for calibration; score from which a document is kept.
HELD_OUT, KEEP = 0.25, 0.5
#: Hashed cells of metadata, and how many of them a row has.
META, PARTS = 128, 3

_CLASS = np.zeros(256, np.uint8)
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[0x80:] = 6
_CLASS[SPACE] = 7
#: Shape numbers, hashed cells of words, and both.
SHAPE, WORDS = 20, 108
CONTENT = SHAPE + WORDS


def content(texts: pa.Array) -> np.ndarray:
    """One row of CONTENT numbers a text."""
    data, at = buffers(texts)
    n = len(texts)
    size = np.diff(at).astype(float)
    out = np.zeros((n, CONTENT))
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8) if len(data) else np.zeros((n, 8))
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], 1)
    out[:, :8] = kinds / np.maximum(size, 1)[:, None]
    out[:, 8] = kinds[:, 1] / letters
    out[:, 9] = np.log1p(size)
    hashes, first = word_hashes(texts, lower=True)
    words = np.diff(first)
    many = np.maximum(words, 1)
    out[:, 10] = np.log1p(words)
    out[:, 11] = size / many
    of = np.repeat(np.arange(n), words)
    if len(hashes):
        again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        out[:, 12] = np.bincount(of[1:][again], minlength=n) / many
        order = np.lexsort((hashes, of))
        h, o = hashes[order], of[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
        out[:, 13] = np.bincount(o[fresh], minlength=n) / many
        runs = np.flatnonzero(fresh)
        some = np.flatnonzero(words)
        out[some, 14] = np.maximum.reduceat(np.diff(np.r_[runs, len(h)]), np.searchsorted(o[runs], some)) / many[some]
    lines = np.bincount(owner[data == 0x0A], minlength=n) + 1 if len(data) else np.ones(n)
    out[:, 15] = np.log1p(lines)
    out[:, 16] = np.log1p(size / lines)
    out[:, 17] = kinds[:, 5] / many
    out[:, 18] = kinds[:, 4] / many
    out[:, 19] = kinds[:, 3] / many
    if len(hashes):
        cell = (mix(hashes) % np.uint64(WORDS)).astype(np.int64)
        share = np.bincount(of * WORDS + cell, minlength=n * WORDS).reshape(n, WORDS) / many[:, None]
        out[:, SHAPE:] = np.sqrt(share)
    out[size == 0] = 0
    return out


def _slot(kind: str, value) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % META


def slots(lang: list, source: list) -> np.ndarray:
    """The three columns of metadata that are one: of the language, of the source, and of both together."""
    rows = [(_slot("lang", a), _slot("source", b), _slot("both", f"{a}/{b}")) for a, b in zip(lang, source)]
    return np.array(rows, float).reshape(-1, PARTS)


def spread(short: np.ndarray) -> np.ndarray:
    """Metadata in META columns; what falls on the same one adds up."""
    out = np.zeros((len(short), META))
    for k in range(PARTS):
        np.add.at(out, (np.arange(len(short)), short[:, k].astype(int)), 1)
    return out


def metadata(lang: list, source: list) -> np.ndarray:
    return spread(slots(lang, source))


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1.0) -> tuple:
    """Logistic regression by Newton steps on standardised columns: mean, scale, weights with the constant last."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return mean, scale, w


def margin(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


WIDTHS = (CONTENT + 1, META + 1)


def _raw(model: tuple) -> np.ndarray:
    """Weights of a model on columns as they are."""
    mean, scale, w = model
    return np.r_[w[:-1] / scale, w[-1] - np.sum(w[:-1] * mean / scale)]


def _sums(x: np.ndarray, y: np.ndarray, v: np.ndarray, short: np.ndarray | None = None) -> np.ndarray:
    """Number, sums and squares of the columns (with a constant one), gradient and Hessian at raw weights v, end to end.

    With `short`, x is metadata, whose few entries a row are added one by one."""
    z = np.c_[x, np.ones(len(x))]
    p = sigmoid(np.clip(z @ v, -30, 30))
    weight = p * (1 - p) + 1e-6
    if short is None:
        h = (z * weight[:, None]).T @ z
    else:
        k = z.shape[1]
        at = np.c_[short.astype(int), np.full((len(z), 1), META)]
        pairs = (at[:, :, None] * k + at[:, None, :]).ravel()
        h = np.bincount(pairs, np.repeat(weight, at.shape[1] ** 2), k * k)
    return np.r_[len(z), z.sum(0), (z * z).sum(0), z.T @ (p - y), h.ravel()]


def _newton(total: np.ndarray, v: np.ndarray, ridge: float = 1.0) -> tuple[tuple, float]:
    """The model one Newton step after raw weights v, and the largest change of a weight; columns standardised as in fit."""
    k = len(v)
    n, first, second, g = total[0], total[1 : k + 1], total[k + 1 : 2 * k + 1], total[2 * k + 1 : 3 * k + 1]
    h = total[3 * k + 1 :].reshape(k, k)
    mean = first[:-1] / n
    spread2 = second[:-1] / n - mean**2
    scale = np.sqrt(np.where(spread2 > 1e-12 * np.maximum(second[:-1] / n, 1e-6), spread2, 1.0))
    turn = np.diag(np.r_[1 / scale, 1.0])
    turn[:-1, -1] = -mean / scale
    w = np.r_[v[:-1] * scale, v[-1] + np.sum(v[:-1] * mean)]
    step = np.linalg.solve(turn @ h @ turn.T + ridge * np.eye(k), turn @ g + ridge * w)
    return (mean, scale, w - step), float(np.abs(step).max())


def _bins(margins: np.ndarray) -> np.ndarray:
    """Bin of a margin's size, so that every task cuts at the same place."""
    return np.minimum((np.abs(margins) * (BINS / 30)).astype(int), BINS - 1)


def _choices(history: list, x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which view handed on each row with what label, by (models, cuts) of the rounds so far: (2, n) of -1, 0 or 1; and the rows never chosen."""
    given = np.full((2, len(x[0])), -1)
    free = np.ones(len(x[0]), bool)
    for models, cuts in history:
        margins = [margin(m, f) for m, f in zip(models, x)]
        picks = [free & (np.abs(a) > SURE) & (_bins(a) >= cut) for a, cut in zip(margins, cuts)]
        for k in (0, 1):
            given[k][picks[k]] = margins[k][picks[k]] > 0
        free &= ~(picks[0] | picks[1])
    return given, free


def histogram(history: list, models: list, c: np.ndarray, short: np.ndarray) -> np.ndarray:
    """How many rows still free each view is sure of, by bin."""
    x = (c, spread(short))
    _, free = _choices(history, x)
    margins = [margin(m, f)[free] for m, f in zip(models, x)]
    return np.concatenate([np.bincount(_bins(a[np.abs(a) > SURE]), minlength=BINS) for a in margins]).astype(float)


def gradients(history: list, weights: list, c: np.ndarray, short: np.ndarray) -> np.ndarray:
    """_sums of both views over the rows that the other view handed them."""
    x = (c, spread(short))
    given, _ = _choices(history, x)
    out = []
    for k in (0, 1):
        y = given[1 - k]
        got = y >= 0
        out.append(_sums(x[k][got], y[got], weights[k], short[got] if k else None))
    return np.concatenate(out)


def _cut(counts: np.ndarray, wanted: float) -> int:
    """Lowest bin of the most certain rows, `wanted` of them or as many more as their last bin holds."""
    return max(int(np.searchsorted(-np.cumsum(counts[::-1])[::-1], -wanted, "right")) - 1, 0)


def co_train(xc, xm, y, n_free: int, over, rounds: int = ROUNDS, handed: float = HANDED) -> dict | None:
    """The two views' models, their calibrations and the model of both. None without labels of both classes.

    xc, xm, y: the labelled rows. over(f, *given) is the sum of f(*given, c, short) over the n_free unlabelled documents."""
    held = np.random.default_rng(0).random(len(y)) < HELD_OUT  # rows come in order of id: a fixed draw, no stride
    if len(y) < 20 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    known, truth = (xc[~held], xm[~held]), y[~held].astype(float)
    models, history = [fit(x, truth) for x in known], []
    ends = np.cumsum([1 + 3 * k + k * k for k in WIDTHS])
    for _ in range(rounds if n_free else 0):
        counts = over(histogram, history, models).reshape(2, BINS)
        if not counts.any():
            break
        history.append((models, [_cut(n, handed * n_free) for n in counts]))
        weights = [np.zeros(k) for k in WIDTHS]  # from nought, as fit: steps from the last round's weights need not settle
        for _ in range(STEPS):
            parts = np.split(over(gradients, history, weights), ends[:1])
            models, moved = zip(*(_newton(_sums(x, truth, v) + part, v) for x, v, part in zip(known, weights, parts)))
            if max(moved) < SETTLED:
                break
            weights = [_raw(m) for m in models]
    margins = np.c_[margin(models[0], xc[held]), margin(models[1], xm[held])]
    scales = [fit(margins[:, [k]], y[held].astype(float)) for k in (0, 1)]
    calibrated = np.c_[margin(scales[0], margins[:, [0]]), margin(scales[1], margins[:, [1]])]
    return {"models": list(models), "scales": scales, "both": fit(calibrated, y[held].astype(float))}


def judge(model: dict | None, xc, xm) -> tuple:
    if model is None:
        half = np.full(len(xc), 0.5)
        return half, half, half
    a = margin(model["scales"][0], margin(model["models"][0], xc)[:, None])
    b = margin(model["scales"][1], margin(model["models"][1], xm)[:, None])
    return sigmoid(a), sigmoid(b), sigmoid(margin(model["both"], np.c_[a, b]))


def _plain(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    get = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(get("doc_id", "long"), get("text", "string"), get("lang", "string"), get("source", "string"))


def _features(rows: DataFrame) -> DataFrame:
    """Content and short metadata of every row, made where the rows are."""

    def make(batches):
        for whole in batches:
            for batch in steps(whole):
                c = content(batch.column("text"))
                m = slots(*(batch.column(k).to_pylist() for k in ("lang", "source")))
                lists = [pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())) for x in (c, m)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "c", "m"])

    return rows.mapInArrow(make, "doc_id long, c array<float>, m array<float>")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _over(rows: DataFrame):
    """Sums over rows of c and m: one row of numbers a task, added up in order of the tasks."""

    def total(f, *given):
        sent = rows.sparkSession.sparkContext.broadcast(given)

        def add(batches):
            from pyspark import TaskContext

            out = None
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    some = batch.slice(at, 4096)
                    part = f(*sent.value, _matrix(some.column("c"), CONTENT), _matrix(some.column("m"), PARTS))
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "sums"])

        parts = rows.select("c", "m").mapInArrow(add, "part int, sums binary").collect()
        sent.destroy()
        return sum(np.frombuffer(bytes(r.sums)) for r in sorted(parts, key=lambda r: r.part))

    return total


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> dict | None:
    """Starts from at most `labelled` labelled documents, those whose ids hash lowest, and learns from all without a label.

    Texts are read once and not shuffled; a document's features (some 100 bytes) are written and meet the labelled ids
    in a join. A round takes one pass over them to find its cuts and one for every Newton step."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    made = written(_features(_plain(docs)), "quality-features")
    ids = made.select("doc_id").where("doc_id IS NOT NULL").distinct()
    chosen = given.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(labelled).collect()
    if not chosen:
        return None
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, y int"))
    got = made.join(keys, "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    y = got.column("y").to_numpy()
    c, m = (np.array(got.column(k).to_pylist(), float).reshape(len(y), -1) for k in ("c", "m"))
    unlabelled = made.where("doc_id IS NOT NULL").join(given.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(made.where("doc_id IS NULL"))
    unlabelled = written(unlabelled.select("c", "m"), "quality-unlabelled")
    return co_train(c, spread(m), y, unlabelled.count(), _over(unlabelled))


def scored(docs: DataFrame, model: dict | None, keep: float = KEEP) -> DataFrame:
    """doc_id, p_content, p_metadata, score and kept of every row of docs, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for whole in batches:
            for batch in steps(whole):
                m = metadata(*(batch.column(k).to_pylist() for k in ("lang", "source")))
                a, b, s = judge(sent.value, content(batch.column("text")), m)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.round(x, 6)) for x in (a, b, s)), pa.array(np.round(s, 6) >= keep)], names=["doc_id", "p_content", "p_metadata", "score", "kept"])

    return _plain(docs).mapInArrow(score, "doc_id long, p_content double, p_metadata double, score double, kept boolean")
