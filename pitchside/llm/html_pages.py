"""Labelled pages for the main-text model, composed by a rule from tables of page parts.

Every part is written with placeholders and has one label: main text or not.  A
page is a sequence of parts around one article; which parts, containers, class names and
words a page gets is drawn from a seeded generator, so the set is the same everywhere.
"""

from __future__ import annotations

import random

# fixed values: words that fill the labelled pages
WORDS = ("time year people way day man thing woman life child world school state family student group country problem "
         "hand part place case week company system program question work government number night point home water "
         "room mother area money story fact month lot right study book eye job word business issue side kind head "
         "house service friend father power hour game line end member law car city community name president team").split()
LABELS = ("Home", "About us", "Contact", "News", "Sports", "Next", "Previous", "Login", "Privacy", "Terms", "Archive", "FAQ")

# parts around the article: {l} a link text, {s} a sentence, {p} a paragraph
AROUND = (
    '<nav><ul><li><a href="/x">{l}</a></li><li><a href="/y">{l}</a></li><li><a href="/z">{l}</a></li></ul></nav>',
    '<nav class="breadcrumb"><a href="/x">{l}</a> &gt; <a href="/y">{l}</a></nav>',
    '<header><h1>{l}</h1><p>{s}</p></header>',
    '<header class="site-header"><div class="logo">{l}</div><a href="/">{l}</a></header>',
    '<div class="header"><span>{l}</span><p>{s}</p></div>',
    '<div id="menu"><ul><li><a href="/x">{l}</a></li><li>{l}</li><li><a href="/y">{l}</a></li></ul></div>',
    '<div class="ad">{s}</div>', '<div class="ads"><p>{p}</p></div>', '<div class="advert">{p}</div>',
    '<div class="advertisement"><a href="/buy">{s}</a></div>', '<div class="banner promo">{s}</div>',
    '<div class="sponsored"><h3>{l}</h3><p>{s}</p></div>',
    '<aside><h3>{l}</h3><p>{p}</p></aside>', '<aside class="sidebar"><ul><li><a href="/r">{s}</a></li><li>{s}</li></ul></aside>',
    '<div class="sidebar"><h4>{l}</h4><p>{s}</p><p>{p}</p></div>', '<div id="sidebar"><p>{p}</p></div>',
    '<div class="related"><h3>{l}</h3><a href="/r">{s}</a><a href="/r">{s}</a></div>',
    '<div class="cookie-notice"><p>{s}</p><button>{l}</button></div>', '<div id="cookie-banner">{p}</div>',
    '<div class="notice">{s}</div>', '<div class="consent">{s}</div>', '<div class="popup modal"><p>{s}</p></div>',
    '<div class="newsletter"><p>{s}</p><form action="/n"><label>{l}</label><input name="mail"></form></div>',
    '<form action="/s"><label>{l}</label><input name="q"><p>{s}</p></form>',
    '<div class="share social"><a href="/f">{l}</a> <a href="/t">{l}</a></div>',
    '<section class="comments"><h3>{l}</h3><p>{p}</p><p>{p}</p></section>',
    '<div id="comments"><div class="comment"><p>{p}</p></div><div class="comment"><b>{l}</b><p>{s}</p></div></div>',
    '<ul class="comment-list"><li class="comment">{p}</li><li class="comment">{s}</li></ul>',
    '<div class="replies"><div class="reply"><p>{p}</p></div></div>',
    '<footer>&copy; 2020 example.org &middot; {s}</footer>', '<footer><p>{s}</p><a href="/p">{l}</a></footer>',
    '<div class="footer"><p>{s}</p><p>{p}</p></div>', '<div id="footer">&copy; {l} <a href="/t">{l}</a></div>',
)
# containers of the article and the blocks inside it
CONTAINERS = (("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"),
              ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"),
              ('<div class="article-body">', "</div>"), ('<div class="post entry">', "</div>"),
              ("<section>", "</section>"), ('<div class="story"><div class="text">', "</div></div>"))
BLOCKS = ("<p>{p}</p>", "<p>{p}</p>", "<p>{p}</p>", "<p>{p}", "<p><b>{p}<br>", "<p>{s}</p>", "<h2>{l}</h2>", "<h3>{s}</h3>",
          "<ul><li>{s}</li><li>{s}</li></ul>", "<blockquote>{p}</blockquote>", "<p>{s} <a href='/w'>{l}</a> {s}</p>",
          "<pre>{s}</pre>", "<table><tr><td>{s}</td><td>{l}</td></tr></table>", "<p>{l}</p>", "<div>{p}</div>")
# parts that may stand inside the article without belonging to it
INSIDE = ('<div class="ad">{s}</div>', '<aside>{p}</aside>', '<div class="share"><a href="/f">{l}</a></div>',
          '<div class="advert"><p>{s}</p></div>', '<div class="related"><a href="/r">{s}</a></div>',
          '<form><label>{l}</label></form>', '<nav><a href="/2">{l}</a></nav>', '<footer>{s}</footer>', '<header><p>{l}</p></header>')


def labelled_pages(n: int = 160, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (html part, is main text); containers are parts without text of their own."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = [rng.choice(WORDS) for _ in range(rng.randint(a, b))]
        if rng.random() < 0.1:
            out = [w.upper() + "!!" for w in out]
        return " ".join(out)

    def fill(part: str) -> str:
        while "{" in part:
            kind = part[part.index("{") + 1]
            if kind == "l":
                text = rng.choice(LABELS)
            elif kind == "s":
                text = words(3, 14).capitalize() + rng.choice([".", ".", "!", ""])
            else:
                text = " ".join(words(5, 18).capitalize() + "." for _ in range(rng.randint(2, 7)))
            part = part.replace("{" + kind + "}", text, 1)
        return part

    pages = []
    for _ in range(n):
        page = [("<html><head><title>" + fill("{s}") + "</title></head><body>", False)]
        page += [(fill(rng.choice(AROUND)), False) for _ in range(rng.randint(0, 4))]
        begin, end = rng.choice(CONTAINERS)
        page.append((begin, False))
        if rng.random() < 0.8:
            page.append((fill("<h1>{s}</h1>"), True))
        for _ in range(rng.randint(1, 9)):
            page.append((fill(rng.choice(BLOCKS)), True))
            if rng.random() < 0.12:
                page.append((fill(rng.choice(INSIDE)), False))
        page.append((end, False))
        page += [(fill(rng.choice(AROUND)), False) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.8:
            page.append((fill(rng.choice(AROUND[-4:])), False))
        pages.append(page)
    return pages
