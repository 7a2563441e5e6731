import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from anamnesis.llm import decontaminate as D
from anamnesis.llm import html_text, mixing, pii, preference_chat, quality, url_filter
from anamnesis.llm.exact_dedup import exact_groups


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (7, "A")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, digest int")
    got = exact_groups(docs).drop("file", "row").collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == [(-1, -1, 1), (1, 2, 3), (2, 2, 3), (2, 2, 3), (3, 4, 2), (4, 4, 2), (7, 7, 1)]
    assert sum(r.kept for r in got) == 4
    assert {r.text_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert exact_groups(docs.where("false")).collect() == []


def test_mix_takes_each_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "c", None, "é"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, rows_per_range=40).collect()
    again = mixing.mixed(docs.repartition(7), rows_per_range=40).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert 0 <= r.taken <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        over = [s for s in open_ if weight[s] * left / sum(weight[x] for x in open_) >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    target |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6
        assert sum(r.taken for r in mine) == int(target[s] + 1e-9)


def test_edit_matching_finds_what_the_full_table_finds(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(6)] + [(90, None), (91, "x")]
    rows = []
    for k in range(60):
        p = list(items[k % 6][1])
        for _ in range(rng.randint(0, 14)):
            i = rng.randrange(len(p))
            p[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        rows.append((k, " ".join(word() for _ in range(10)) + " " + "".join(p).upper() + "! " + " ".join(word() for _ in range(10))))
    rows += [(100, None), (101, "")]
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        for i, p in items[:6]:
            p, x = D.normalised(p), D.normalised(t)
            column = list(range(len(p) + 1))
            best = len(p)
            for c in x:
                new = [0]
                for j in range(len(p)):
                    new.append(min(column[j] + (p[j] != c), column[j + 1] + 1, new[j] + 1))
                column, best = new, min(best, new[-1])
            if best <= int(len(p) * 0.1):
                want.add((d, i))
    assert got == want and want


def test_preference_prefix_and_masks(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, "user", "x"), (None, 0, "user", "y")]
    rows = {r.pair_id: r for r in preference_chat.preference_rows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    r = rows[0]
    assert (r.n_common, r.prompt, r.chosen) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n")
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|end|>"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad<|end|>"]
    assert rows[1].rejected is None and rows[1].n_common == 0


def test_surrogates_are_consistent_and_distinct(spark):
    texts = ["mail ann.lee@mail.com or +1 (555) 555-0101, Ann.Lee@mail.com; 10.1.2.3 Mrs. Jane Roe", None, "Mr. John Roe 4444 3333 2222 1111 ann.lee@mail.com", "nothing here 12 345"]
    got = [r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[1].text == "" and got[3].text == texts[3] and got[3].n_entities == 0
    assert not any(x in got[0].text + got[2].text for x in ("ann.lee", "Ann.Lee", "555-0101", "10.1.2.3", "Jane", "John", "4444"))
    mail = [w for w in got[0].text.replace(";", " ").replace(",", " ").split() if "@" in w]
    assert len(set(mail)) == 1 and mail[0] in got[2].text
    assert "Mrs. " in got[0].text and "Mr. " in got[2].text


def test_labellers_and_pages(spark):
    patterns, counts = np.array([[1, 1, 1], [0, 1, 1], [0, 0, 1], [-1, -1, -1]]), np.array([900.0, 40, 60, 1])
    q, _, share = quality.fit_labellers(patterns, counts)
    assert q[0] > 0.9 and q[2] < 0.5 and 0.5 < share < 1
    pages = [(1, "http://a/x", "<html><body><nav><a href=/>menu</a></nav><article><h1>T &amp; x</h1><p>one <b>two</b>\n three<div class=comments><p>me too</p></div></article><footer>c</footer>"), (2, None, None), (3, "", "")]
    got = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & x\none two three" and got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""


def test_url_rules(spark):
    urls = ["https://www.Example.org/es/1?x", "http://example.org/en/12", "http://x.org", "http://b.com/de/", "http://a.net/q#z", None, "no scheme", "http://notexample.org/es/"]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[k].rule, got[k].verdict) for k in (0, 1, 3, 7)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/de/", "block"), ("org/", "allow")]
    assert (got[0].host, got[0].path, got[5].host, got[6].path) == ("www.example.org", "/es/1", "", "")
