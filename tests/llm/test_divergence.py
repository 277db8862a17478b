"""Source divergence (13): terms against a regular expression, rows against exact integers by hand, defined cases."""

import random
import re
from collections import Counter

from pitchside.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, min_docs, most):
    count, seen, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t, n in Counter(terms(text)).items():
            count[lang, source, t] += n
            seen[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = sorted(t for g, t in seen if g == lang and seen[g, t] >= min_docs)

        def shares(of):
            n = {t: sum(count[lang, s, t] for s in of) for t in kept}
            total = sum(n.values())
            return {t: 1 + 10 ** 9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole, by = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in sources if o != s]
            top = [(by[s][t] * -1 + whole[t], t) for t in kept if count[lang, s, t] and by[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < most]
    return sorted(out)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "ÉTÉ", "naïve", "日本", "x1y", "don't", "a-b", " hard", *(f"w{chr(97 + i)}{chr(97 + i)}" for i in range(20))]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "Ünï", None])
        weights = [1 + (len(source or "") * k) % 5 for k in range(len(words))]
        out.append((rng.choice([" ", "\n", "_", "@"]).join(rng.choices(words, weights, k=rng.randint(0, 40))), lang, source))
    return out + [(None, "en", "s9"), ("", "xx", "only"), ("the", "one", "s"), ("a b", "two", "p"), ("", "two", "q")]


def audited(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, "t") for d in docs], "text string, lang string, source string, n int, term string").repartition(4)
    got = D.audit(df, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def test_document_terms():
    for text in [None, "", "A bC\x00d[e]f`g{h}i\x7fj", "ÀB é日本 z\x85q", "x" * 10_000 + "1" + "X" * 10_000]:
        assert [(t.decode(), n) for t, n in D.document_terms(text).items()] == list(Counter(terms(text)).items())


def test_rows_against_exact_integers(spark):
    docs = corpus()
    want = brute(docs, 10, 7)
    assert {w[2] for w in want} == {"pair", "term"} and max(w[5] for w in want if w[2] == "term") == 7
    assert audited(spark, docs, min_docs=10, most=7) == want
    assert audited(spark, docs * 2, min_docs=20, most=7) == brute(docs * 2, 20, 7)     # repeated rows are documents too


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_SOURCES", 2), ("CHUNK_TERMS", 3), ("MOST_CHUNK_TERMS", 5), ("DENSE_TERMS", 2), ("HELD_TERMS", 10)):
        monkeypatch.setattr(D, name, value)
    docs = corpus(200, 5)
    assert audited(spark, docs, min_docs=10, most=50) == brute(docs, 10, 50)


def test_no_kept_terms_and_empty_table(spark):
    docs = corpus(10)
    got = audited(spark, docs, min_docs=1000)
    assert got == brute(docs, 1000, 50) and got and all(r[2] == "pair" and r[4] == 0 for r in got)
    assert audited(spark, []) == []


def test_shares_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 10 ** 12 + 7, 3 * 10 ** 15 + 1, 10 ** 6
    got = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * v)
