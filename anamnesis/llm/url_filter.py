"""URL filtering: longest-prefix rules first, boosted trees for what no rule names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit

#: (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: URLs that the trees are fitted on at most: those with the least hashes of the ones that a rule labels.
TRAIN_ROWS = 20_000
FEATURES = ("length", "depth", "digits", "entropy", "params", "host_labels", "host_length", "host_digits", "hyphens", "last_length", "suffix_length", "suffix_share", "longest", "fragment", "secure")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; without it empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path it starts with."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    counts = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1]
    share = counts / counts.sum() if len(counts) else counts
    return float(-(share * np.log2(share)).sum())


def lexical(url: pd.Series, host: pd.Series, path: pd.Series, share: pd.Series) -> np.ndarray:
    """The lexical features of each url, one column per name of ``FEATURES``."""
    rows = []
    for u, h, p, s in zip(url.fillna(""), host, path, share, strict=True):
        query = u.partition("#")[0].partition("?")[2]
        labels, last = h.split("."), p.rstrip("/").rpartition("/")[2]
        rows.append((
            len(u), p.count("/"), sum(c.isdigit() for c in u) / (len(u) or 1), _entropy(u), query.count("=") + query.count("&"), len(labels), len(h),
            sum(c.isdigit() for c in h), h.count("-") + p.count("-"), len(last), len(labels[-1]), s, max(map(len, labels)), "#" in u, u.startswith("https"),
        ))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def judged(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per page.

    A rule's verdict goes before the trees'; the trees judge the rest: allow
    where their log-odds are 0 or more. They are fitted on the urls that a rule
    labels (at most ``train_rows``, least hashes first, so the same table gives
    the same trees), without sight of the rules. The shares of the host suffixes
    are counted over all rows and joined to them.
    Null urls and urls without ``://`` have empty host and path; without any
    labelled url the trees allow everything.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("label"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    counts = rows.groupBy("suffix").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(total).select("suffix", (F.col("n") / F.col("total")).alias("share"))  # one row of totals
    rows = rows.join(shares, "suffix").drop("suffix")
    known = rows.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(train_rows).select("url", "host", "path", "share", "label").toPandas()
    trees = fit(lexical(known["url"], known["host"], known["path"], known["share"]), (known["label"] == "allow").to_numpy(float)) if len(known) else Trees(0.0, np.empty((0, 1), int), np.empty((0, 1)), np.empty((0, 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = trees.score(lexical(b["url"], b["host"], b["path"], b["share"]))
            method = np.where(score >= 0, "allow", "block")
            yield b[["page_id", "host", "path", "rule"]].assign(verdict=b["label"].where(b["label"].notna(), method), score=score)

    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, score double")
