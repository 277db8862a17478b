"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``language``: documents without letters go, and those of at least ``LEAST_SYMBOLS`` symbols that no learned language
   explains;
2. ``near_duplicates``: of every group linked by word-shingle similarity (five words, 0.8) one document stays;
3. ``repeated_passages``: byte strings of at least 200 bytes that occurred earlier are cut, the first copy stays;
4. ``benchmark``: documents that hold a benchmark item go;
5. ``packing``: what is left is tokenised and packed into training sequences.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import decontam, langid, packing, setjoin, suffix_dedup
from pitchside.llm.textops import materialise
from pitchside.sources.tables import read_table

# Bits per symbol under the best language above which a text counts as no language; texts of the learned languages, also
# mixed ones, need 2 to 4.5 bits, random letters about 7.
MOST_BITS = 6.0
# The last phrase of a text is cut short by its end and costs up to log2(training symbols), 15 bits; only from this many
# symbols (letters, and runs of others as one) on is that little beside MOST_BITS.  Shorter texts with letters stay.
LEAST_SYMBOLS = 100
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.predict(docs, model)
    symbols = F.length(F.regexp_replace("text", r"\P{L}+", " "))
    explained = (F.col("bits_per_symbol") <= MOST_BITS) | (symbols < LEAST_SYMBOLS)
    keep = (F.col("lang_pred") != langid.UNDETERMINED) & explained
    return told.where(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs, keep_first=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("packing", pack),
]

ORACLE_SQL = None   # automata, connected components and the tokenizer are beyond SQL; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
