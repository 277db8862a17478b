"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built on the driver
(a bounded sample, see below).  A text is cut greedily into phrases, each the
longest match of what follows in the language's training text; the fewer phrases
a language needs, the closer the text is to it.  The number of phrases of each
language is normalised by its training size: ``phrases * log2(training symbols)
/ text symbols`` estimates the cross entropy in bits per symbol, and the language
with the smallest value wins.

Walking an automaton needs no suffix links: a phrase ends where no transition
exists, and parsing restarts at the root.  So each automaton is compiled into one
dense table whose entries carry a "phrase ended" bit, and blocks of many texts
walk all tables together, one symbol a step.  A text is parsed whole, in blocks of
``BLOCK`` symbols (a phrase ends with its block).

Symbols are lower-cased letters seen in the training sample, one symbol for any
other letter, and one for every run of other characters.

Training bound: per language the ``DOCS_PER_LANG`` labelled documents with the
smallest hash (copies count once), cut at ``SYMBOLS_PER_LANG`` symbols in total; a
language with fewer distinct texts gives all of them.  The sample is found with one
count of distinct texts per language and one hash threshold (widened for a language
that falls short), so about twice that many rows reach the driver.  Everything else
covers all rows and whole texts.

Defined cases: texts that are null, empty or without letters get ``und`` and score
0; ties go to the alphabetically first language; without training rows every text
is ``und``; repeated rows are judged each for itself; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pitchside.llm.textops import let_go, small_batches, text_slices, tidy

DOCS_PER_LANG = 32
SYMBOLS_PER_LANG = 30_000
BLOCK = 512
BATCH_BYTES = 8 << 20
MAX_SYMBOLS = 96      # letters with a symbol of their own, by frequency in the sample
SHARPNESS = 8.0       # how fast the score approaches 1 with the gap to the next language, per bit
UNDETERMINED = "und"
_LAST = 0x30000       # code points from here on hold no letters that need their own treatment
_OTHER, _GAP = 0, 1


def _letter_table() -> np.ndarray:
    """Code point to lower-cased code point; 0 for everything that is no letter."""
    table = np.zeros(_LAST + 1, dtype=np.uint32)
    for c in range(_LAST):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _folded(text: str, letters: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return letters[np.minimum(points, _LAST)]


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transition table (states x size, -1: none) of the suffix automaton of a symbol sequence."""
    link, longest, moves = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(link)
        link.append(0), longest.append(longest[last] + 1), moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q]), longest.append(longest[p] + 1), moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(moves), size), -1, dtype=np.int32)
    for s, m in enumerate(moves):
        if m:
            table[s, list(m)] = list(m.values())
    return table


def parse_table(symbols: np.ndarray, size: int) -> np.ndarray:
    """Automaton completed for greedy parsing: entry = next state * 2 + (a phrase ended before the symbol).

    A symbol unknown to the language is a phrase of its own: it leads to one more state, the last.
    """
    table = suffix_automaton(symbols.tolist(), size)
    alone = len(table)
    restart = np.where(table[0] >= 0, table[0], alone) * 2
    out = np.where(table >= 0, table * 2, restart + 1)
    out[0] = restart
    return np.vstack([out, restart + 1]).astype(np.int32)


class Model:
    """Tables of all languages behind one another, ready to be sent to the tasks."""

    def __init__(self, samples: dict[str, list[str]], symbols_per_lang: int = SYMBOLS_PER_LANG):
        letters = _letter_table()
        folded = {}
        for lang, texts in sorted(samples.items()):
            some = [np.concatenate([f, np.zeros(1, dtype=f.dtype)]) for f in (_folded(t, letters) for t in texts)]
            if some:
                joined = _squeeze(np.concatenate(some))[:symbols_per_lang]
                if (joined > 0).any():
                    folded[lang] = joined
        seen = np.concatenate([f[f > 0] for f in folded.values()]) if folded else np.zeros(0, dtype=np.uint32)
        value, count = np.unique(seen, return_counts=True)
        own = value[np.argsort(-count, kind="stable")][:MAX_SYMBOLS]
        self.code = np.full(_LAST + 1, _OTHER, dtype=np.uint8)
        self.code[letters == 0] = _GAP
        by_letter = np.zeros(_LAST + 1, dtype=np.uint8)
        by_letter[own] = np.arange(2, len(own) + 2)
        self.code[letters > 0] = by_letter[letters[letters > 0]]
        self.size = len(own) + 2
        self.langs = list(folded)
        tables, base, self.bits = [], 0, []
        for f in folded.values():
            t = parse_table(np.where(f == 0, _GAP, by_letter[f]), self.size)
            tables.append((t + 2 * base).ravel())
            self.bits.append(float(np.log2(max(len(f), 2))))
            base += len(t)
        self.roots = np.cumsum([0] + [len(t) // self.size for t in tables])[:-1].astype(np.int64)
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of every text (rows) under every language, and its number of letters."""
        n_text, n_lang = len(texts), len(self.langs)
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        size = np.array([len(p) for p in points], dtype=np.int64)
        flat = self.code[np.minimum(np.concatenate(points), _LAST)] if n_text else np.zeros(0, dtype=np.uint8)
        owner = np.repeat(np.arange(n_text), size)
        first = np.zeros(len(flat), dtype=bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        keep = np.ones(len(flat), dtype=bool)
        keep[1:] = (flat[1:] != _GAP) | (flat[:-1] != _GAP)
        keep |= first
        flat, owner = flat[keep], owner[keep]
        letters = np.bincount(owner[flat != _GAP], minlength=n_text)
        size = np.bincount(owner, minlength=n_text)
        phrases = np.zeros((n_text, n_lang))
        if len(flat) and n_lang:
            phrases = self._phrases(flat, size, n_text)
        return phrases * np.array(self.bits) / np.maximum(size, 1)[:, None], letters

    def _phrases(self, flat: np.ndarray, size: np.ndarray, n_text: int) -> np.ndarray:
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(n_text), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(size) - size)[owner] + within * BLOCK
        length = np.minimum(size[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")       # longest first: finished blocks leave from the end
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        n_lang = len(self.langs)
        state = np.repeat(self.roots, len(start)).reshape(n_lang, -1).copy()
        ended = np.zeros(state.shape, dtype=np.int64)
        for k in range(int(length.max())):
            n = active[k]
            entry = self.table[state[:, :n] * self.size + flat[start[:n] + k]]
            ended[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        out = np.zeros((n_text, n_lang))
        for j in range(n_lang):
            out[:, j] = np.bincount(owner, weights=ended[j] + 1, minlength=n_text)   # the block's end ends a phrase
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per symbol of the winner."""
        bits, letters = self.entropies(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        weight = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        score = weight[np.arange(len(texts)), best] / weight.sum(axis=1)
        known = letters > 0
        return ([self.langs[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0),
                np.where(known, bits.min(axis=1), 0.0))


def _squeeze(folded: np.ndarray) -> np.ndarray:
    """Runs of zeros (no letter) as one zero."""
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    return folded[keep]


def training_sample(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """``docs_per_lang`` texts per language, those with the smallest hash of the text; all where a language has fewer."""
    usable = (labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
              .select("lang", "text", F.xxhash64("text").alias("hash")))
    # copies fall in or out of the sample together, so the texts are counted without them
    counts = {r.lang: r.n for r in usable.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    place = F.pmod("hash", F.lit(1 << 30))
    expected, short = 2.0 * docs_per_lang, list(out)
    while short:
        # twice the expected share of the hash range; a language with few texts sends them all
        share = F.lit(0.0)
        for lang in short:
            share = F.when(F.col("lang") == lang, F.lit(min(1.0, expected / counts[lang]))).otherwise(share)
        rows = (usable.where(F.col("lang").isin(short)).withColumn("place", place)
                .where(F.col("place") / F.lit(float(1 << 30)) <= share).dropDuplicates(["lang", "hash"]).collect())
        for lang in short:
            mine = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.place, r.hash))
            out[lang] = [r.text for r in mine[:docs_per_lang]]
        # next to never: fewer than half of the expected texts lie below the threshold
        short = [lang for lang in short if len(out[lang]) < min(docs_per_lang, counts[lang])]
        expected *= 2
    return out


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, symbols_per_lang: int = SYMBOLS_PER_LANG) -> Model:
    return Model(training_sample(labelled, docs_per_lang), symbols_per_lang)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits_per_symbol (own columns of these names are replaced)."""
    added = ("lang_pred", "score", "bits_per_symbol")
    docs = docs.drop(*added)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # bounded by the training bound
    schema = StructType(docs.schema.fields + [StructField(added[0], StringType()), StructField(added[1], DoubleType()),
                                              StructField(added[2], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                lang, score, bits = m.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                    names=part.schema.names + list(added))

    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
