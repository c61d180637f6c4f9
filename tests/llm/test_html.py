"""Extraction of main texts against the articles that pages were made of, and pages that are hard to read."""

import random
import time

from floorwright.llm import html_blocks, html_extraction

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def make(n, seed=0):
    """Pages and their articles: menus, adverts, comments and footers under telling names around an article."""
    r = random.Random(seed)
    vocab = [f"word{k}" for k in range(500)]
    said = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    pages, texts = [], []
    for _ in range(n):
        title, paragraphs = said(5), [said(r.randrange(15, 60)) + "." for _ in range(r.randrange(2, 6))]
        around = [f"<nav><ul>{''.join(f'<li><a href=/x>{said(2)}</a>' for _ in range(4))}</ul></nav>", f'<div class="ad banner">{said(6)}</div>', f'<aside class="sidebar"><p>{said(8)}</p></aside>']
        r.shuffle(around)
        body = "".join(f"<p>{p.replace(' ', '  ', 1)}</p>" for p in paragraphs)
        comments = f'<section class="comments"><h3>Comments</h3><p>{said(12)}</p></section>' if r.random() < 0.7 else ""
        pages.append(f"<html><head><title>{said(3)}</title><script>var a = '<p>no</p>';</script></head><body>{around[0]}{around[1]}<article><h1>{title} &amp; more</h1>{body}</article>{comments}{around[2]}<footer><p>{said(5)}</p></footer></body></html>")
        texts.append(" ".join([f"{title} & more", *paragraphs]))
    return pages, texts


def test_extract_gives_the_articles(spark):
    pages, texts = make(400)
    rows = [(i, f"u{i}", p, "clash", 7) for i, p in enumerate(pages)]
    rows += [(900, "null", None, "", 0), (901, "empty", "", "", 0), (902, "text", "plain words only", "", 0), rows[3], (None, "no id", pages[5], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = html_extraction.extract(df, html_extraction.fit_from_table(df)).collect()
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    by = {x.url: x.text for x in out}
    assert by["null"] == by["empty"] == ""
    assert by["no id"] == by["u5"]
    assert sum(by[f"u{i}"] == t for i, t in enumerate(texts)) >= 0.99 * len(texts)
    assert len([x for x in out if x.page_id == 3]) == 2


def test_extract_without_rows_or_teacher(spark):
    df = spark.createDataFrame([(1, "u", "<div>one</div><div>two</div>", "", 0)], SCHEMA)
    model = html_extraction.fit_from_table(df)
    assert html_extraction.extract(df, model).first().text == "one two"
    empty = df.limit(0)
    assert html_extraction.extract(empty, html_extraction.fit_from_table(empty)).count() == 0


def test_long_and_broken_pages_are_read_in_time():
    began = time.process_time()
    nested = "<div>x" * 180_000
    got = html_blocks.blocks(nested)
    assert len(got) == 180_000
    model = html_extraction.fit([])
    assert html_extraction.label(model, [got[:20_000]])[0].all()
    lone = "<a '" + "<a " * 350_000
    assert html_blocks.blocks(lone) == []
    assert html_blocks.blocks("<b><i>" * 170_000)[:1] == []
    assert len(html_blocks.blocks("</p>x" * 200_000)) == 1
    assert time.process_time() - began < 30


def test_broken_tags_are_markup():
    said = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert said('<p title="a>one</p><p>two</p>') == ["one", "two"]
    assert said("<p title=\"a>b\" lang='x>y'>one") == ["one"]
    assert said("1 < 2 <3 & <p>x <!-- <p>y</p> --> z") == ["1 < 2 <3 &", "x z"]
    assert html_blocks.blocks('<div class="a b"><section><p>t')[0].path == ("div.a.b", "section", "p")
    assert html_blocks.blocks('<div class="a b"><section class=a><div><p>t')[0].words == ["div", "a", "b", "section", "p"]
