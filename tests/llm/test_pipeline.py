"""The corpus pipeline against a brute-force version of its five stages on a small folder of tables."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_packing import bins_one_by_one
from test_repeats import brute_bytes
from test_rules_and_leaks import shingles
from test_setjoin import brute
from tokenizers import Tokenizer

import corpus_pipeline
from pitchside.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    rng = random.Random(12)
    words = {"en": [f"the{a}ing" for a in "abcdefghijklmnopqrst"] + ["the", "and", "of"],
             "fr": [f"le{a}eaux" for a in "abcdefghijklmnopqrst"] + ["le", "et", "de"]}
    benchmark = [(1, " ".join(f"item{j} word{j}" for j in range(12))), (2, "so short"), (3, None)]
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = []
    for d in range(60):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randint(5, 150)))
        kind = rng.random()
        if kind < 0.25 and rows:                                   # copies, some with an edit
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.5 and text:
                cut = text.split(" ")
                cut[rng.randrange(len(cut))] = "edité"
                text = " ".join(cut)
        elif kind < 0.45:
            text += "\n" + passage + "é"
        elif kind < 0.5:
            text += " " + benchmark[0][1].upper()
        elif kind < 0.55:
            text = rng.choice(["", "12 34 !!", None])
        rows.append((d * 5 % 301, text, lang if rng.random() < 0.9 else None, "s", len(text or "")))
    return rows, benchmark


def by_hand(spark, rows, benchmark):
    labelled = spark.createDataFrame(rows, SCHEMA).where(~langid.held_out(F.col("doc_id")))
    model = langid.train(labelled)
    lang, _, bits = model.predict([r[1] or "" for r in rows])
    docs = {r[0]: r[1] or "" for r, x, b in zip(rows, lang, bits) if x != langid.UNDETERMINED and b <= corpus_pipeline.MOST_BITS}
    group = brute(list(docs.items()), 5, 80)
    docs = {d: t for d, t in docs.items() if group[d][1] == d}
    gone = brute_bytes([(d, t.encode()) for d, t in docs.items()], 200, True)
    cut = {}
    for d, t in docs.items():
        at, out = 0, []
        for ch in t:                                               # a character that loses a byte goes whole
            size = len(ch.encode())
            if not any(i in gone[d] for i in range(at, at + size)):
                out.append(ch)
            at += size
        if not gone[d] or "".join(out).strip():
            cut[d] = "".join(out)
    items = [shingles(t) for _, t in benchmark if shingles(t)]

    def holds(text, item):
        padded = " " + " ".join(__import__("re").findall(r"[^\W_]+", text.lower())) + " "
        return sum(f" {x} " in padded for x in item) >= 0.8 * len(item) - 1e-9

    return {d: t for d, t in cut.items() if not any(holds(t, i) for i in items)}


def test_run_against_brute_force(spark, tmp_path):
    rows, benchmark = tables()
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    want = by_hand(spark, rows, benchmark)
    assert 10 < len(want) < len(rows)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert {d: sum(r.length for r in got if r.doc_id == d) for d in {r.doc_id for r in got}} == length
    pieces = [r.length for r in got]
    assert len({r.sequence_id for r in got}) == bins_one_by_one(pieces, 2048)
    for s in {r.sequence_id for r in got}:
        spans = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in spans] == np.concatenate(([0], np.cumsum([n for _, n in spans])[:-1])).tolist()


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    rows, benchmark = tables()
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame(rows[:12], SCHEMA).withColumn("score", F.lit("own"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf_dir).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


def test_short_clean_documents_pass_the_language_stage(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}ing" for a in "abcdefghijklmnoprstw" for b in ("a", "e", "o", "and")]
    rows = [(4 * j, " ".join(rng.choice(words) for _ in range(300)), "en", "s", 0) for j in range(40)]
    short = ["A.", "is", "Hi!", "OK 12", "http 404", "Was orer.", "4734663219866878 $$$ token"]
    junk = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    rows += [(1000 + j, t, None, "s", 0) for j, t in enumerate([*short, junk, "12 !", "", None])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    _, _, bits = model.predict(short)
    assert max(bits) > corpus_pipeline.MOST_BITS                   # the estimate alone would drop clean texts
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, f"file://{tmp_path}").collect()}
    assert kept == {r[0] for r in rows[:40 + len(short)]}
