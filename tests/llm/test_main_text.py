"""Main text on held-out pages, misleading names, hostile pages and odd tables."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import html_text as H

PROSE = "Some sentence of the article goes on. " * 6
BODY = f"<p>{PROSE}</p>"


def told(*pages):
    return list(H.main_texts(list(pages), *H.fitted()))


def truth(page):
    nodes = H.nodes_of(root := H.parsed(page))
    return H.text_from(root, {id(n) for n, y in zip(nodes, H.labels_of(nodes), strict=True) if y or n.parent is None})


def test_held_out_pages():
    pages = list(H.generated_pages(200, seed=99))
    scores = []
    for got, page in zip(told(*pages), pages, strict=True):
        a, b = Counter(got.split()), Counter(truth(page).split())
        scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert sum(scores) / len(scores) > 0.96


@pytest.mark.parametrize(
    "page",
    [
        f'<nav><a href=/>m</a></nav><div class="page header-less"><h1>Head line</h1>{BODY}</div><footer>c</footer>',
        f'<main><section class="story tags-of-history"><h1>Head line</h1>{BODY}</section></main>',
        f"<article><header><h1>Head line</h1></header>{BODY}</article>",
        f'<div class="zq">Buy this now please.</div><article><h1>Head line</h1>{BODY}</article>',
    ],
)
def test_names_do_not_decide_alone(page):
    assert told(page) == ["Head line\n" + PROSE.strip()]


@pytest.mark.parametrize("page", ['<a "' * 16000, "x <script " * 8000, '<a b="' * 16001 + ">", "<!" * 20000, "<script>" + "</script" * 20000, "<b>x" * 50000, "<" * 50000], ids=lambda p: p[:6])
def test_hostile_pages_take_no_time(page):
    began = time.time()
    told(page)
    assert time.time() - began < 5


def test_open_quotes_and_comments():
    assert [n.tag for n in H.nodes_of(H.parsed("<p it's>a</p><p b='x>c</p><div>d</div>"))] == ["body", "p", "p", "div"]
    root = H.parsed("a <!-- b <p>c")
    assert "".join(root.parts) == "a " and H.parsed("1 < 2 <p>").parts[:2] == ["1 <", " 2 "]


def test_odd_tables(spark):
    long = "word " * 250_000
    rows = [(1, "u", f"<article><p>{long}</article>"), (1, "u", f"<article><p>{long}</article>"), (2, None, None), (None, "v", ""), (3, "w", f"<article>{BODY}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("x").alias("text"), F.lit(1).alias("n_chars"), F.lit(2).alias("score"))
    got = H.extracted(pages).collect()
    assert [r.text for r in got if r.page_id == 1] == [long.strip()] * 2 and sorted(r.n_chars for r in got) == [0, 0, len(PROSE.strip()), len(long) - 1, len(long) - 1]
    assert H.extracted(pages.where("false")).collect() == []
