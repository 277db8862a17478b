"""Quality rules (9) and benchmark decontamination (10) against plain Python, and their defined cases."""

import re

from pitchside.llm import decontam, quality

WORD = r"[\x20\x09-\x0D]+"


def counts(text):
    t = text or ""
    w = [x for x in re.split(WORD, t) if x]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def test_base_counts(spark):
    texts = [None, "", " \n\t", "a b c", "the cat of " * 8, "x\nx\n \ny\nx", "a|b #c &d <e> é€ \x0b$%*", "one two three four five six seven eight " * 2,
             "p q " * 40, "l\r\nl\r\nl", "w " * 9, "a b c d e f g h a b c d e f g h i a b c d e f g h", "très " * 3000, " nbsp is no separator"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "the " * 30, 1), (3, "a b c", 1)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_verdict_follows_the_table(spark):
    good = " ".join(f"the word{i} of house{i}" for i in range(40))
    rows = [(1, good), (2, good.replace(" ", " | ")), (3, good.upper()), (4, good.replace(" ", "!! ")),
            (5, " ".join(f"zz{i}" for i in range(90)))]
    got = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_containment_is_exact(spark):
    item = " ".join(f"i{j}" for j in range(30))
    words = item.split()
    docs = [(1, "pre " * 5000 + item.upper() + " post" * 5000), (2, " ".join(words[:24])), (3, " ".join(words[:25]) + " x " + item[:9]),
            (4, "nothing here"), (5, None), (6, ""), (7, "so, Short-one! yes"), (None, item), (9, " ".join(reversed(words))), (4, item)]
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (5, item.replace("i29", "zz")), (5, "absent words only in here now")]
    found = decontam.find_items(spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, h string"),
                                spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item_shingles) for r in found.collect()}
    want = {}
    for d in {d for d, _ in docs}:
        text = [t for i, t in docs if i == d]
        for i, t in items:
            s = shingles(t)
            have = {x for x in s for u in text if f" {x} " in " " + " ".join(re.findall(r"[^\W_]+", (u or "").lower())) + " "}
            if s and len(have) >= 0.8 * len(s) - 1e-9 and len(have) / len(s) > want.get((d, i), (0, 1))[0] / want.get((d, i), (0, 1))[1]:
                want[d, i] = (len(have), len(s))
    assert got == want and (1, 1) in got and (7, 2) in got and (None, 1) in got


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "clean text stays as it is", 2), (None, None, 3)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, "A, b c d e f!")], "item_id long, text string")
    assert sorted(r.n for r in decontam.decontaminate(docs, items).collect()) == [2, 3]
    assert decontam.decontaminate(docs, items.limit(0)).count() == 3
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
