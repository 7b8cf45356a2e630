"""The pipeline's stages one after the other, each against plain Python on what the one before kept."""

import array
import random
import zlib

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    speak = {"en": "the and of to with that this from are was have for not you".split(), "fr": "le la et les des que dans avec une est pour pas vous être".split()}
    rows = []
    for i in range(120):
        lang = "fr" if i % 4 == 0 else "en"
        rows.append([i, " ".join(rng.choice(speak[lang]) + rng.choice(["", "s", "é" if lang == "fr" else "ing"]) for _ in range(rng.randint(30, 90))), lang, f"src{i % 3}"])
    for i in range(120, 140):  # near copies of the first
        w = rows[0][1].split(" ")
        w[rng.randrange(len(w))] = f"n{i}"
        rows.append([i, " ".join(w), "fr", "src0"])
    passage = " ".join(f"item{k}" for k in range(14))
    rows[5][1] += " " + passage
    rows[9][1] = rows[9][1] + "\n" + passage.upper() + "."
    rows += [[150, None, "en", "src1"], [151, "", None, None], [152, "12 34 !!", "en", "src1"]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "never seen in any of them at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    told = stages["language_id"](spark, docs, folder)
    assert told.columns == columns
    assert rows(told) == [r for r in rows(docs) if r[0] < 150]

    firsts = stages["ngram_jaccard"](spark, told, folder)
    want = brute.jaccard(rows(told), 5, 80)
    assert firsts.columns == columns and rows(firsts) == [r for r in rows(told) if want[r[0]][1] == r[0]]
    assert not {120, 125, 139} & {i for i, _ in rows(firsts)}

    free = stages["decontamination"](spark, firsts, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute.decontam(rows(firsts), items)
    assert free.columns == columns and rows(free) == [r for r in rows(firsts) if not hit[r[0]][4]]
    assert not {5, 9} & {i for i, _ in rows(free)}

    mixed = stages["mixing"](spark, free, folder)
    assert mixed.columns == columns and set(rows(mixed)) <= set(rows(free)) and len(set(rows(mixed))) > len(rows(free)) / 3
    assert rows(mixed) == rows(stages["mixing"](spark, free.repartition(7), folder))

    whole, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in rows(mixed):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    out = stages["token_ids"](spark, mixed, folder)
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == expected


def test_clashing_columns_and_empty_tables_pass_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = {"language": "mine", "id_lang": "MINE", "id_accepted": "no", "mix": "mine", "mix_kept": "no", "tie": "t", "doc_key": "k", "_kept_id": "x"}
    more = docs.withColumns({k: F.lit(v) for k, v in own.items()})
    kept = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == more.columns, name
        assert [r.asDict() for r in kept.select(*own).distinct().collect()] == [own], name
        none = stage(spark, more.limit(0), folder)
        assert none.columns == more.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, more.limit(0), folder).count() == 0
