"""Every registered corpus query over a small folder of tables, against plain Python."""

import array
import hashlib
import os
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laminar.llm import langid, quality
from laminar.llm.queries import ORACLES, QUERIES

SPEAK = {"en": "the and of to with that this from are was have for not you", "fr": "le la et les des que dans avec une est pour pas vous être", "de": "der die und das nicht mit auch auf für ist ein wir ihr über"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "fr", "de"])
        words = [rng.choice(SPEAK[lang].split()) + rng.choice(["", "", "s", "en", "é"]) for _ in range(rng.randint(1, 90))]
        rows.append([i, " ".join(words[:40]) + "\n" + " ".join(words[40:]), lang if rng.random() < 0.9 else None, f"src{i % 4}" if i % 9 else None])
    passage = " ".join(f"item{k}" for k in range(30))
    for i in (3, 50, 51):
        rows[i][1] += "\n" + passage + " end"
    for i in range(160, 175):
        w = rows[0][1].split(" ")
        w[rng.randrange(len(w))] = f"n{i}"
        rows.append([i, " ".join(w), "en", "src0"])
    rows += [[180, None, None, None], [181, "", "en", None], [182, " \t\n", None, "src1"], [183, "word " * 4000, "en", "src1"], [184, rows[1][1], "fr", "src2"]]
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "word word word"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(rows[i][2] == "en"), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    near = np.random.default_rng(4).standard_normal((60, 64))
    near[30:] = near[:30] + np.random.default_rng(5).standard_normal((30, 64)) * 0.3
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(near)] + [(60, None), (61, [0.0] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    pages = [(i, f"https://h{i % 5}.example.{r[2] or 'org'}/{i}", f"<html lang='{r[2]}'><p>{r[1]}</p>" if r[2] else f"<p>{r[1]}</p>") for i, r in enumerate(rows[:120])]
    spark.createDataFrame([*pages, (500, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), rows, vectors


def rows_of(spark, folder, name):
    frame = QUERIES[name](spark, folder[0])
    out = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r[1:] for r in out}, frame.columns


def test_every_query_is_tested():
    assert set(QUERIES) == {"op1_substring_dedup", "op2_mix_by_raking", "op3_token_counts", "op4_embedding_near_dedup", "op5_quality_cotraining", "op6_language_id", "op6_pages_language", "op7_decontaminate", "op8_token_ids_orc", "op9_line_dedup", "op10_ngram_jaccard"}


def test_op1(spark, folder):
    assert rows_of(spark, folder, "op1_substring_dedup")[0] == brute.substring([r[:2] for r in folder[1]])


@pytest.mark.parametrize("name", ["op2_mix_by_raking", "op9_line_dedup"])
def test_queries_with_sql(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder[0]):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder[0]}/{f}/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder[0]).select(*names).collect()
    plain = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want.fetchall()), key=str)


def test_op3_and_op8(spark, folder):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids for i, t, *_ in folder[1]}
    got, names = rows_of(spark, folder, "op3_token_counts")
    assert names == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 2048) for i, t, *_ in folder[1]}
    start, want = 0, {}
    for i in sorted(ids):
        x = [*ids[i], 2]
        want[i] = (start, len(x), zlib.crc32(array.array("I", x).tobytes()))
        start += len(x)
    assert rows_of(spark, folder, "op8_token_ids_orc")[0] == want


def test_op4(spark, folder):
    want = brute.links(folder[2])
    got, names = rows_of(spark, folder, "op4_embedding_near_dedup")
    assert names == ["vec_id", "n_links", "component_id", "kept"]
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()} and sum(n for n, _ in want.values()) > 20


def test_op5_equals_co_training_in_memory(spark, folder):
    """All features in one matrix, picks by sorting, fits over whole tables; then the registered query's scores."""
    rows = folder[1]
    texts = pa.array([r[1] for r in rows], pa.string())
    xc, xm = quality.content(texts).astype(np.float32).astype(float), quality.metadata([r[2] for r in rows], [r[3] for r in rows])
    given = [(i, int(rows[i][2] == "en")) for i in range(120)]
    want = brute.co_trained(xc, xm, given, quality.ROUNDS, quality.HANDED, quality.SURE, quality.HELD_OUT)
    got, names = rows_of(spark, folder, "op5_quality_cotraining")
    assert names == ["doc_id", "p_content", "p_metadata", "score", "kept"] and len(got) == len(rows)
    assert max(abs(got[r[0]][2] - w) for r, w in zip(rows, want)) < 0.02
    assert all(got[r[0]][3] == (got[r[0]][2] >= quality.KEEP) for r in rows)
    assert np.mean([got[r[0]][3] == (r[2] == "en") for r in rows[120:160]]) > 0.8


def test_op6_equals_the_formula(spark, folder):
    want = brute.language([(r[0], r[1], r[2], r[3], None) for r in folder[1]])
    got, names = rows_of(spark, folder, "op6_language_id")
    assert names == ["doc_id", "language", "posterior", "n_grams", "kept"]
    for k, (lang, posterior, grams) in want.items():
        assert got[k][0] == lang and abs(got[k][1] - posterior) < 2e-3 and got[k][2] == grams
        assert got[k][3] == (grams >= langid.FEWEST and got[k][1] >= langid.NEEDED)


def test_op6_of_pages_equals_the_formula(spark, folder):
    found = langid.of_pages(spark.read.parquet(f"{folder[0]}/pages.parquet"))
    name = F.lower(F.regexp_extract("url", "://([^/]+)", 1))
    plain = found.select("page_id", "text", "lang", F.nullif(name, F.lit("")), F.nullif(F.element_at(F.split(name, r"\."), -1), F.lit(""))).collect()
    want = brute.language([tuple(r) for r in plain])
    got, _ = rows_of(spark, folder, "op6_pages_language")
    assert len(got) == 121
    for k, (lang, posterior, grams) in want.items():
        assert got[k][1] == lang and abs(got[k][2] - posterior) < 2e-3 and got[k][3] == grams


def test_op7(spark, folder):
    items = [(1, " ".join(f"item{k}" for k in range(30))), (2, "word word word"), (3, None)]
    got, names = rows_of(spark, folder, "op7_decontaminate")
    assert names == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got == brute.decontam([r[:2] for r in folder[1]], items) and sum(v[4] for v in got.values()) == 4


def test_op10(spark, folder):
    assert rows_of(spark, folder, "op10_ngram_jaccard")[0] == brute.jaccard([r[:2] for r in folder[1]])


def test_null_cells_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """The queries over nulls in every column, repeated rows, more columns than they know, and no rows at all."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = docs.unionByName(docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2)).unionByName(docs.where("doc_id < 4"))
    odd = odd.withColumns({c: F.lit("mine") for c in ("language", "mix", "tie", "doc_key", "topic", "ids", "c", "m", "shingles", "kept_text", "n_words")})
    tables = {"documents": odd, "benchmark": spark.read.parquet(f"{folder[0]}/benchmark.parquet").withColumn("words", F.lit(1)), "labels": spark.read.parquet(f"{folder[0]}/labels.parquet").withColumn("y", F.lit(5)), "pages": spark.read.parquet(f"{folder[0]}/pages.parquet").withColumn("text", F.lit("x")), "embeddings": spark.read.parquet(f"{folder[0]}/embeddings.parquet").withColumn("v", F.lit(1))}
    for kind, change, n in (("odd", lambda x: x, odd.count()), ("none", lambda x: x.limit(0), 0)):
        path = tmp_path / kind
        for name, df in tables.items():
            change(df).write.parquet(f"{path}/{name}.parquet")
        for name, run in QUERIES.items():
            want = n and {"op4_embedding_near_dedup": 62, "op6_pages_language": 121}.get(name, n)
            assert run(spark, str(path)).count() == want, (kind, name)


def test_digests():
    assert brute.substring([(0, "a b")])[0][2] == hashlib.sha256(b"a b").hexdigest()
