"""Best-fit packing (1): plan against one-by-one best-fit decreasing, ids against the tokenizer, whole packing."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchside.llm import packing, textops

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_one_by_one(lengths, size):
    open_bins, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(open_bins, length)
        if i == len(open_bins):
            n, room = n + 1, size
        else:
            room = open_bins.pop(i)
        bisect.insort(open_bins, room - length)
    return n


@pytest.mark.parametrize("size", [1, 5, 16, 64, 2048])
def test_plan_equals_best_fit_decreasing(size):
    rng = random.Random(size)
    for _ in range(30):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan, used = packing.best_fit_plan(histogram, size), {}
        for length, n in histogram.items():
            rows = [r for r in plan.tolist() if r[0] == length]
            for rank in range(n):
                _, r0, first, per, offset = [r for r in rows if r[1] <= rank][-1]
                used.setdefault(first + (rank - r0) // per, []).append((offset + (rank - r0) % per * length, length))
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size
        assert len(used) == bins_one_by_one(lengths, size)


def test_cached_ids_equal_the_tokenizers():
    rng = random.Random(1)
    pool = "ab1_-'sS.²½ªºµ¨­ éÉſßĀ\t\n<|>×İΣ日́\x1c\x85\xa0"
    texts = ["", " ", "it's can't we'll", "<|endoftext|> x", "ab áb"] + [
        "".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, packing.Encoder(PATH).encode(texts)):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert got == want, repr(text)


def test_documents_are_packed_whole(spark):
    rng = random.Random(2)
    texts = ["", None, "w", "the end " * 3000] + ["word " * rng.randint(0, 900) for _ in range(60)] + ["same text"] * 5
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = packing.pack_documents(docs, PATH, with_ids=True).cache()
    got = packed.collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length <= 2048
    for i, t, _ in rows:
        ids = [x for r in sorted(by_doc[i], key=lambda r: r.piece) for x in r.ids]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in sorted(by_doc[i], key=lambda r: r.piece)] == [2048 * k for k in range(len(by_doc[i]))]
    sequences = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, sequences.values())) == sum(r.length for r in got) and max(map(len, sequences.values())) <= 2048
    for r in got:
        assert sequences[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert len(sequences) == bins_one_by_one([r.length for r in got], 2048)
    # small salts give the same bins
    again = packing.pack(packed.drop("sequence_id", "offset", "ids"), rows_per_salt=3).collect()
    assert len({r.sequence_id for r in again}) == len(sequences)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).collect() == []


def test_small_caches_change_no_ids():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé'-.1") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    tokenizer, small = Tokenizer.from_file(PATH), packing.Encoder(PATH, cache_bytes=20_000)
    for _ in range(30):                                    # generations and parts are dropped again and again
        texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(8)]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert small.encode(texts) == want
        assert len(small.by_word) < 900 and small.held <= 20_000 + packing.ENTRY_BYTES * 320


def test_rows_without_id_and_repeats_spread_over_salts(spark):
    docs = spark.createDataFrame([(None, "same text of a few words")] * 300 + [(7, "same text of a few words")] * 300, "doc_id long, text string")
    pieces = packing.materialise(packing.tokenised_pieces(docs.repartition(3), PATH), "pieces")
    assert pieces.select("row").distinct().count() == 600
    packed = packing.pack(pieces, rows_per_salt=50)
    assert "row" not in packed.columns
    rows = packed.select("sequence_id", "offset", "length").collect()
    length = rows[0].length
    assert len({(r.sequence_id, r.offset) for r in rows}) == 600 and {r.offset % length for r in rows} == {0}


def test_plain_parts_need_only_the_model():
    encoder, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x180) if packing._PLAIN.fullmatch(chr(c))]
    words = [w for a in letters for w in (a, a + a, f"x{a}y", f"1{a}", f"{a}'s")]
    texts = [" ".join(words[k:k + 50]) for k in range(0, len(words), 50)] + words
    rng = random.Random(3)
    texts += ["".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(3000)]
    texts = [t for t in texts if "<|" not in t]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    encoder.tokenizer = None                               # only texts that are not plain go through the whole tokenizer
    assert encoder.encode(texts) == want


def test_a_word_is_looked_up_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    encoder, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    text, other = "\n one two\tthree\x0b\x0cfour\r\nfive ", "six 日 one"
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in (text, other, "", " \n")]
    assert encoder.encode([text]) == want[:1]
    encoder.by_word = Counted(encoder.by_word)
    assert encoder.encode([text, other, "", " \n"] * 200) == want * 200
    assert encoder.by_word.asked <= 6                      # the words of the plain texts and the empty one between spaces
    assert encoder.encode([]) == [] and encoder.encode([other, "", " \n"]) == want[1:]


def test_no_rows_go_through_other_python_workers(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.col("id").cast("int")).alias("text"))
    plan = packing.pack_documents(docs)._jdf.queryExecution().toString()
    assert "Broadcast" in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(textops, "give_back", lambda: calls.append(1))

    def run(batches):
        for batch in batches:
            yield batch + 1

    assert list(textops.tidy(run)(iter([1, 2]))) == [2, 3] and len(calls) == 1
    task = textops.tidy(run)(iter([1, 2]))
    assert next(task) == 2 and len(calls) == 1
    task.close()                                        # a limit stops reading early
    assert len(calls) == 2
    textops.held("a thing", lambda: 1)
    textops.let_go()
    assert len(calls) == 3 and not textops._HELD
