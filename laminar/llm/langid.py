"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text: a naive Bayes model of byte trigrams, whose counts come from all documents that declare a language. Declared language and
address suffix: how often each goes with each text guess, over all documents. Host: counts of text guesses, smoothed
towards those of the address suffix, which are smoothed towards those of all documents. Log evidence is summed.

Null or empty texts, and texts without letters, carry no text evidence and are rejected. A null declared language, host
or address is no evidence. Ties go to the language that sorts first. Repeated rows are judged each; with no document that
declares a language every row is rejected. Other columns, clashing names included, pass through untouched: the verdict is one
struct after them, whose name gives way. A value that less than RARE of the declaring documents declare is no language of the
model, at any size; such documents are judged among the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from laminar.llm.common import buffers, fresh, steps, written

#: Cells of a language's trigram table; least share of the declaring documents that makes a declared value a language. The
#: model is broadcast: 1 / RARE languages at most, 256 KB each.
CELLS, RARE = 1 << 16, 1e-3
#: Pseudo-counts: of a trigram cell, of a host, of a suffix, of a declared language.
GRAM, HOST, SUFFIX, DECLARED = 0.5, 20.0, 50.0, 1.0
#: Trigrams that count as independent evidence, at most; posterior that is needed; trigrams that are needed.
WEIGHT, NEEDED, FEWEST = 40.0, 0.6, 1
#: Rows of a prior table that may be broadcast.
SMALL = 50_000

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def _grams(texts: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of all texts and the text each belongs to; runs of other characters count as one blank."""
    data, at = buffers(texts)
    data = _LETTERS[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    kept[at[:-1][at[:-1] < len(data)]] = True  # a text's first byte stays, whatever the one before it ends with
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[kept]
    data = data[kept].astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    same = owner[:-2] == owner[2:]
    code = code * np.uint32(2654435761)
    return (code[same] >> np.uint32(32 - int(cells).bit_length() + 1)).astype(np.int64), owner[:-2][same]


def train(docs: DataFrame, declared: str = "lang", rare: float = RARE, cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log probabilities of trigram cells, from every document that declares a language.

    Each task sums its documents to one row a language; the rows of all tasks are summed by Spark."""
    said = docs.select(F.col(declared).cast("string").alias("tongue")).where("tongue IS NOT NULL").groupBy("tongue").agg(F.count("*").alias("n"))
    said = written(said, "langid-declared-values")
    all_said = said.agg(F.sum("n")).first()[0] or 0
    spoken = [r[0] for r in said.where(F.col("n") >= rare * all_said).orderBy("tongue").collect()]
    if not spoken:
        return [], np.zeros((0, cells), np.float32)
    known = {x: i for i, x in enumerate(spoken)}

    def count(batches):
        sums = np.zeros((len(spoken), cells), np.int64)
        for whole in batches:
            for batch in steps(whole):
                tongue = np.array([known.get(x, -1) for x in batch.column("tongue").to_pylist()], np.int64)
                cell, owner = _grams(batch.column("text"), cells)
                of = tongue[owner]
                for i in np.unique(tongue[tongue >= 0]):
                    sums[i] += np.bincount(cell[of == i], minlength=cells)
        for i in np.flatnonzero(sums.sum(1)):
            hit = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, np.int32)), pa.array(hit.astype(np.int32)), pa.array(sums[i][hit])], names=["tongue", "cell", "n"])

    found = docs.select("text", F.col(declared).cast("string").alias("tongue")).mapInArrow(count, "tongue int, cell int, n long").groupBy("tongue", "cell").agg(F.sum("n").alias("n"))
    table = np.full((len(spoken), cells), GRAM)
    rows = found.toArrow()
    np.add.at(table, (rows.column("tongue").to_numpy(), rows.column("cell").to_numpy()), rows.column("n").to_numpy())
    return spoken, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _scored(docs: DataFrame, spoken: list[str], model: np.ndarray, extra: str) -> DataFrame:
    """docs with `extra`: log likelihoods by language, tempered to WEIGHT trigrams, and the number of trigrams."""
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    names = docs.columns

    def score(batches):
        table = sent.value
        cells, n = table.shape
        for whole in batches:
            for batch in steps(whole):
                cell, owner = _grams(batch.column("text"), cells)
                count = np.bincount(owner, minlength=len(batch))
                out = np.zeros((len(batch), n))
                if len(cell):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    for k in range(n):
                        out[owner[first], k] = np.add.reduceat(table[:, k][cell], first)
                out *= np.minimum(1.0, WEIGHT / np.maximum(count, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * n + 1, n, dtype=np.int32)), pa.array(out.ravel()))
                made = pa.StructArray.from_arrays([lists, pa.array(count, pa.int64())], names=["fit", "grams"])
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, extra])

    made = StructType([StructField("fit", ArrayType(DoubleType())), StructField("grams", LongType())])
    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(extra, made)]))


def host_and_suffix(docs: DataFrame, url: str | None = "url", host: str | None = "source"):
    """Host and address suffix: of the address where there is one, else the host column and no suffix."""
    if url and url in docs.columns:
        name = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
        return F.nullif(name, F.lit("")), F.nullif(F.element_at(F.split(name, r"\."), -1), F.lit(""))
    return (F.col(host).cast("string") if host and host in docs.columns else F.lit(None).cast("string")), F.lit(None).cast("string")


def markup_language(html):
    """The language a page's root element declares, without its region."""
    said = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.nullif(said, F.lit(""))


def of_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text without markup, scripts and styles, and lang as the root element declares it."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select("page_id", "url", bare.alias("text"), markup_language(F.col("html")).alias("lang"))


def judged(docs: DataFrame, declared: str = "lang", url: str | None = "url", host: str | None = "source", needed: float = NEEDED, into: str = "language") -> DataFrame:
    """Every row of docs and, after its own columns, one struct of lang, posterior, grams and accepted; it is called `into`,
    with underscores after it where docs has such a column.

    The priors are grouped sums over all documents: three small tables that meet the documents by broadcast while they
    have SMALL rows at most, else by a shuffled join whose hot hosts AQE splits. Texts are not shuffled otherwise."""
    into = fresh(docs, into)
    verdict = lambda lang, posterior, grams, accepted: F.struct(lang.alias("lang"), posterior.alias("posterior"), grams.alias("grams"), accepted.alias("accepted")).alias(into)
    spoken, model = train(docs, declared)
    if not spoken:
        return docs.select("*", verdict(F.lit(None).cast("string"), F.lit(0.0), F.lit(0).cast("long"), F.lit(False)))
    n = len(spoken)
    of_host, of_suffix = host_and_suffix(docs, url, host)
    ready = docs.select("*", F.col(declared).cast("string").alias("_langid_said"), of_host.alias("_langid_host"), of_suffix.alias("_langid_suffix"))
    scored = _scored(ready, spoken, model, "_langid_s")
    guess = F.when(F.col("_langid_s.grams") > 0, F.array_position("_langid_s.fit", F.array_max("_langid_s.fit")).cast("int") - 1)
    lean = _scored(ready.select("text", "_langid_said", "_langid_host", "_langid_suffix"), spoken, model, "_langid_s").select("_langid_said", "_langid_host", "_langid_suffix", guess.alias("g")).where("g IS NOT NULL")
    counted = lean.groupBy("_langid_said", "_langid_host", "_langid_suffix", "g").agg(F.count("*").alias("n"))

    counted = written(counted, "langid-evidence")
    by = [F.sum(F.when(F.col("g") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)]
    total = [float(x or 0) for x in counted.agg(*by).first()]
    overall = [(x + 1.0) / (sum(total) + n) for x in total]

    def sums(key: str) -> DataFrame:
        return counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*by).alias("c"))

    whole = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    p = [(F.get("c", F.lit(i)) + SUFFIX * overall[i]) / (whole + SUFFIX) for i in range(n)]
    suffixes = sums("_langid_suffix").select("_langid_suffix", F.array(*p).alias("suffix_p"))
    pairs = counted.where("_langid_host IS NOT NULL").select("_langid_host", "_langid_suffix").distinct().groupBy("_langid_host").agg(F.max("_langid_suffix").alias("_langid_suffix"))
    above = sums("_langid_host").join(pairs, "_langid_host", "left").join(suffixes, "_langid_suffix", "left")
    parent = [F.coalesce(F.get("suffix_p", F.lit(i)), F.lit(overall[i])) for i in range(n)]
    hosts = above.select(F.col("_langid_host").alias("h_key"), F.array(*[F.log((F.get("c", F.lit(i)) + HOST * parent[i]) / (whole + HOST)) for i in range(n)]).alias("h_log"))
    said = sums("_langid_said").select(F.col("_langid_said").alias("d_key"), F.array(*[F.log((F.get("c", F.lit(i)) + DECLARED) / F.lit(total[i] + DECLARED * n)) for i in range(n)]).alias("d_log"))
    hosts, said = written(hosts, "langid-hosts"), written(said, "langid-declared")

    def near(prior: DataFrame) -> DataFrame:
        return F.broadcast(prior) if prior.limit(SMALL + 1).count() <= SMALL else prior

    met = scored.join(near(hosts), F.col("_langid_host") == F.col("h_key"), "left").join(near(said), F.col("_langid_said") == F.col("d_key"), "left")
    logs = [F.get("_langid_s.fit", F.lit(i)) + F.coalesce(F.get("h_log", F.lit(i)), F.lit(float(np.log(overall[i])))) + F.coalesce(F.get("d_log", F.lit(i)), F.lit(0.0)) for i in range(n)]
    met = met.withColumn("_langid_logs", F.array(*logs)).withColumn("_langid_top", F.array_max("_langid_logs"))
    posterior = 1.0 / F.aggregate(F.transform("_langid_logs", lambda x: F.exp(x - F.col("_langid_top"))), F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(x) for x in spoken]), F.array_position("_langid_logs", F.col("_langid_top")).cast("int"))
    grams = F.col("_langid_s.grams")
    return met.select(*docs.columns, verdict(best, F.round(posterior, 6), grams, (grams >= FEWEST) & (posterior >= needed)))
