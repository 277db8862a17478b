"""Language identification (2): automaton and parsing against brute force, held-out accuracy, defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitchside.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_parsing_is_greedy_longest_match():
    rng = random.Random(4)
    for _ in range(20):
        size = rng.randint(2, 4)
        source = [rng.randrange(size) for _ in range(rng.randint(1, 60))]
        text = [rng.randrange(size + 1) for _ in range(rng.randint(1, 80))]
        table = langid.parse_table(np.array(source), size + 1)
        state, ended = 0, 0
        for c in text:
            entry = table[state, c]
            ended += entry & 1
            state = entry >> 1
        grams = {tuple(source[i:j]) for i in range(len(source)) for j in range(i + 1, len(source) + 1)}
        phrases, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and tuple(text[at:at + n + 1]) in grams:
                n += 1
            phrases, at = phrases + 1, at + n
        assert ended + 1 == phrases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.predict(docs.where(langid.held_out(F.col("doc_id"))), model)
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_defined_cases(spark):
    rows = [(1, "the cat and the dog and the house " * 30, "en", "own"), (2, "le chat et le chien et la maison " * 30, "fr", "own"),
            (3, None, None, "own"), (4, "", "en", "own"), (5, "123 !! \n", "fr", "own"), (6, "the dog", None, "own"),
            (6, "the dog", None, "own"), (None, "le chien et " * 9000, None, "own"), (8, "日本 🙂 \x00", None, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert got[3].score == got[5].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert got[8].lang_pred in ("en", "fr")
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_blocks_do_not_depend_on_the_batch(spark):
    texts = ["le chat et " * k for k in range(1, 150, 7)] + ["the dog and " * 300, "", "x"]
    model = langid.Model({"en": ["the dog and the cat " * 20], "fr": ["le chat et le chien " * 20]})
    whole, _ = model.entropies(texts)
    for t, row in zip(texts, whole):
        assert np.allclose(model.entropies([t])[0][0], row)


def test_copies_do_not_thin_the_sample(spark):
    copies = [("xx", "una gata y un perro")] * 4000
    others = [("xx", f"la casa {j} y el perro") for j in range(20)] + [("en", f"the dog {j} and the cat") for j in range(200)]
    labelled = spark.createDataFrame(copies + others + [("yy", "seul"), (None, "the dog"), ("en", None)], "lang string, text string")
    sample = langid.training_sample(labelled.repartition(5))
    assert {lang: len(texts) for lang, texts in sample.items()} == {"en": 32, "xx": 21, "yy": 1}
    assert all(len(set(texts)) == len(texts) for texts in sample.values())
    assert sample == langid.training_sample(labelled.coalesce(1))
    model = langid.train(labelled)
    assert model.langs == ["en", "xx", "yy"]
    told = langid.predict(spark.createDataFrame([("un perro y la casa",)], "text string"), model)
    assert told.first().lang_pred == "xx"
