"""Toxicity (5) and main text of pages (6): held-out quality and defined cases."""

import numpy as np
from pyspark.sql import functions as F

from pitchside.llm import html_main, html_pages, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    extra = spark.createDataFrame([(None, None, None, "a", None), (-1, "", None, "b", 0), (-2, "x" * 100_000, None, "c", 0)], docs.schema)
    scored = score(docs.unionByName(extra).withColumn("score", F.lit("own"))).cache()
    assert scored.count() == docs.count() + 3
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.9 and np.mean(np.array(clean) >= 0.7) < 0.02
    assert score(docs.limit(0)).collect() == []
    # one class only: the share of toxic rows
    assert {r.score for r in toxicity.train(docs, labels.where("toxic = 0"))(docs).select("score").distinct().collect()} == {0.0}


def test_features_of_one_text_do_not_depend_on_its_batch():
    words = toxicity._Words(["idiot"])
    lexicon = toxicity.Lexicon(np.sort(words.hash), np.array([3.0]), words.stems(4)[0])
    texts = ["You idiot, you!", "", "an 1d10t or i.d.i.o.t there", "SHOUT loud!!! " * 50, "é ß 日本", "idiotic", "x" * 5000]
    whole = toxicity.text_features(texts, lexicon)
    for t, row in zip(texts, whole):
        assert np.allclose(toxicity.text_features([t], lexicon)[0], row), t
    named = {n: whole[:, j] for j, n in enumerate(toxicity.FEATURES)}
    assert named["hits_per_word"][0] == 1 / 3 and named["near_hits_per_word"][0] == 1 / 3 and named["log_hidden"][2] == np.log1p(2)
    assert named["stems_per_word"][5] == 1.0 and named["hits_per_word"][5] == 0.0 and named["shouted_words"][3] == 0.5


def test_chain_labels_unseen_pages():
    model = html_main.default_model()
    right = total = 0
    for page in html_pages.labelled_pages(60, seed=321):
        blocks, labels = html_main.labelled_blocks(page)
        right += sum(a == bool(b) for a, b in zip(model.decode(blocks), labels))
        total += len(labels)
    assert right / total > 0.97


def test_decoding_is_the_best_labelling():
    model = html_main.default_model()
    blocks = html_main.labelled_blocks(html_pages.labelled_pages(3, seed=5)[2])[0][:9]
    unary = model.scores(blocks)

    def value(labels):
        return sum(unary[j][y] for j, y in enumerate(labels)) + sum(model.moves[a][b] for a, b in zip(labels, labels[1:]))

    best = max(value([x >> j & 1 for j in range(len(blocks))]) for x in range(1 << len(blocks)))
    assert np.isclose(value([int(y) for y in model.decode(blocks)]), best)


def test_main_text(spark):
    article = "<h1>A &amp; B</h1><p>One  two\n three.<p>Four &eacute;<br>five</p><script>var x = '<p>no</p>';</script>"
    pages = [
        (1, f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article>{article}</article><footer>&copy; x</footer></body></html>"),
        (2, None), (3, ""), (4, f"<body><article>{article}<p>cut <a hre"), (5, "<nav><a href='/x'>Home</a></nav>"),
        (6, "<article><p>" + "long text. " * 30_000 + "</p></article>"), (6, "<article><p>same id</p></article>"),
    ]
    frame = spark.createDataFrame([(i, "u", h, "own") for i, h in pages], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_main.extract(frame).collect()]
    text = "A & B\nOne two three.\nFour é five"
    assert got[0][1] == text and got[3][1] == text + "\ncut"
    assert got[1][1] == got[2][1] == "" and got[1][2] == 0 and got[4][1] == ""
    assert got[5][1] == ("long text. " * 30_000).strip() and got[6][1] == "same id"
    assert all(n == len(t) for _, t, n in got)
    assert html_main.extract(frame.limit(0)).collect() == []


ARTICLE = "<h1>The title of the page</h1><p>One two three four five six seven eight nine ten.</p><p>Second paragraph of the text here.</p>"
TEXT = "The title of the page\nOne two three four five six seven eight nine ten.\nSecond paragraph of the text here."


def test_unclosed_self_closed_and_custom_elements_lose_nothing():
    model = html_main.default_model()

    def main(before="", inside=""):
        return model.extract(f"<html><body><nav><a href='/'>Home</a></nav>{before}<article>{ARTICLE}{inside}</article><footer>&copy; x</footer></body></html>")

    for before in ("<svg class='i'/>", "<svg><path d='M0'/></svg>", "<button-bar></button-bar>", "<button>", "<select>", "<object>", "<iframe>", "<template>",
                   "<textarea>", "<noscript>", "<script>var a = '<p>no</p>'</script>", "<style>p {}</style >", "<script/>x</script>"):
        assert main(before) == TEXT, before
    extra = "<p>Inline <math><mi>x</mi></math> and <object>fallback</object> stay <my-tag>here</my-tag> too, all of it.</p>"
    assert main(inside=extra) == TEXT + "\nInline x and fallback stay here too, all of it."
    assert main("<script>never closed ") == "" and main("<style>never closed ") == ""


def test_deep_pages_take_linear_work():
    import time

    model = html_main.default_model()

    def took(n):
        page = "<div>" * n + "".join(f"<p>word {i} of the text" for i in range(n // 10)) + "</p>" * n + "<button>" * n
        start = time.process_time()
        model.extract(page)
        return time.process_time() - start

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.5
    blocks = html_main.leaf_blocks("".join(f"<div class='c{chr(97 + i % 26)}{i}'>" for i in range(500)) + "<p>text", {"<div>", "<p>"})
    assert blocks[-1].elements == ("<div>", "<p>") and blocks[-1].leaf == "<p>"


def test_names_of_open_elements_come_and_go():
    blocks = html_main.leaf_blocks("<div class='a'><div class='a b'><p>one</p></div>two</div>three")
    assert [(b.text, set(b.elements), b.leaf) for b in blocks] == [
        ("one", {"<div>", ".a", ".b", "<p>"}, "<p>"), ("two", {"<div>", ".a"}, "<div>"), ("three", set(), "")]


def plain_features(text, words, stems):
    """The features of one text, one word and one byte at a time."""
    import re
    letter = rb"[A-Za-z\x80-\xff]+"
    low, raw = text.lower().encode(), text.encode()
    found = re.findall(letter, low)
    n = max(len(found), 1)
    hit = [w in words for w in found]
    stem = [h or any(len(w) > k and w[:k] in stems for k in toxicity.STEMS) for h, w in zip(hit, found)]
    you = [i for i, w in enumerate(found) if w in {x.encode() for x in toxicity.SECOND_PERSON}]
    apart = [min((abs(i - j) for j in you), default=float("inf")) for i, s in enumerate(stem) if s]
    hits, at_stem = sum(hit), sum(stem)
    runs = re.findall(letter, raw)
    punct = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    is_letter = [bool(re.fullmatch(letter, bytes([b]))) for b in raw]
    inside = (punct | set(b"0123456789")) - set(b"'-")
    symbols = sum(raw[i] in inside and is_letter[i - 1] and is_letter[i + 1] for i in range(1, len(raw) - 1))
    alike = low.translate(bytes.maketrans(*(bytes(map(ord, x)) for x in zip(*toxicity.LOOK_ALIKES.items()))))
    low_letter = [bool(re.fullmatch(letter, bytes([b]))) for b in low]
    bare = bytes(b for i, b in enumerate(low) if not (0 < i < len(low) - 1 and b in punct and low_letter[i - 1] and low_letter[i + 1]))
    hidden = sum(max(sum(w in words for w in re.findall(letter, x)) - hits, 0) for x in (alike, bare))
    size = max(len(raw), 1)
    return [np.log1p(len(found)), hits / n, np.log1p(hits), at_stem / n, np.log1p(at_stem), sum(words[w] for w, h in zip(found, hit) if h) / n,
            sum(1 / (1 + d) for d in apart) / max(at_stem, 1), sum(d <= 3 for d in apart) / n,
            sum(65 <= b <= 90 for b in raw) / max(sum(is_letter), 1), sum(len(r) > 2 and r.isupper() and r.isascii() for r in runs) / n,
            sum(b in punct for b in raw) / size, raw.count(b"!") / size, symbols / n, hidden / n, np.log1p(hidden)]


def test_features_against_plain_python():
    import random
    rng = random.Random(12)
    lexicon_words = {b"idiot": 3.0, b"moron": 2.5, "blöd".encode(): 1.5}
    w = toxicity._Words([k.decode() for k in lexicon_words])
    order = np.argsort(w.hash)
    stems = {b"idio", b"moro", b"stupi"}
    stem_hash = np.sort(np.concatenate([toxicity._Words(["idiox morox"]).stems(4)[0], toxicity._Words(["stupid"]).stems(5)[0]]))
    lexicon = toxicity.Lexicon(w.hash[order], np.array(list(lexicon_words.values()))[order], stem_hash)
    pool = ["idiot", "IDIOT", "1d10t", "i.d.i.o.t", "m0ron", "moronic", "stupidly", "you", "Du", "blöd", "BLÖD", "hello", "WORLD", "a1b", "x-y", "don't",
            "!!!", "?", "é", "日本", "...", "m*ron", "vous", "12", "id!ot"]
    texts = ["", " ", "idiot", "!", "a", "you idiot", "idiot" + "x " * 2000] + [
        " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    got = toxicity.text_features(texts, lexicon)
    for t, row in zip(texts, got):
        want = plain_features(t, lexicon_words, stems)
        assert np.allclose(row, want), (t[:200], [f for f, a, b in zip(toxicity.FEATURES, row, want) if not np.isclose(a, b)])


def test_too_few_rows_to_calibrate_score_the_share(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of a few words") for i in range(12)], "doc_id long, text string")
    for n in (2, 4, 6):
        labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(n)], "doc_id long, toxic int")
        scores = {r.score for r in toxicity.train(docs, labels)(docs).collect()}
        assert scores == {0.5}, (n, scores)
