"""Classifiers on what they were not trained on, and odd tables."""

import random

from pyspark.sql import functions as F

from anamnesis.llm import preference_chat, quality, url_filter

SF = "/root/testdata/sf0.01"


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    bad, good = n.get((0, False), 0), n.get((1, True), 0)
    assert bad / (bad + n.get((0, True), 0)) > 0.6 and good / (good + n.get((1, False), 0)) > 0.98


def test_url_trees_judge_what_no_rule_names(spark):
    # hosts of one suffix are allowed by rule, of another blocked; the trees judge the same forms elsewhere
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    good = lambda tld: f"https://{word(6)}.{tld}/{word(5)}/{word(7)}"
    bad = lambda tld: f"http://{word(4)}{rng.randrange(10**6)}-{word(5)}-{word(4)}.{tld}/{rng.randrange(10**8)}?a={rng.randrange(10**6)}&b={rng.randrange(10**6)}"
    rules = (("allow", "aaa", "/"), ("block", "bbb", "/"))
    urls = [good("aaa") for _ in range(150)] + [bad("bbb") for _ in range(150)] + [good("ccc") for _ in range(100)] + [bad("ccc") for _ in range(100)]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    held = [(got[k].verdict == ("allow" if k < 400 else "block"), got[k].rule) for k in range(300, 500)]
    assert sum(ok for ok, _ in held) >= 190 and all(r is None for _, r in held)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "http://a.org/" + "x" * 1_000_000), (1, "http://a.org/"), (1, "http://a.org/"), (None, None), (2, "")], "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in ("host", "path", "label", "suffix", "share", "n", "total", "score")])
    got = url_filter.judged(rows).collect()
    assert len(got) == 5 and [r.verdict for r in got if r.page_id == 1] == ["allow"] * 3 and {r.host for r in got if r.page_id != 1} == {""}
    assert url_filter.judged(rows.where("false")).collect() == []
    docs = spark.createDataFrame([(1, "word " * 200_000), (1, "word " * 200_000), (None, None), (3, "")], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("pattern", "keep", "score", "posterior")])
    out = quality.scored(docs).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 1}) == 1 and [r.keep for r in out if r.doc_id != 1] == [False, False]
    assert quality.scored(docs.where("false")).collect() == []
    turns = spark.createDataFrame([(0, 0, "user", "q" * 1_000_000), (1, 0, "user", "q" * 1_000_000), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("pair_id", "side", "prompt")])
    row = preference_chat.preference_rows(turns).first()
    assert row.n_common == 1 and row.chosen == "" and row.rejected == "<|assistant|>\n<|end|>\n"
    assert preference_chat.preference_rows(turns.where("false")).collect() == []
