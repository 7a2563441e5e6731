"""Surrogates stay distinct and in their format where the ranges set aside are crowded."""

import re

from pyspark.sql import functions as F

from anamnesis.llm import pii


def test_few_free_values(spark):
    # 300 of the 1000 three-digit numbers are entities, and one draw leaves many of them without a value of their own
    one = spark.range(300).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 3, "0").alias("canonical"), F.lit("m").alias("gender"), F.lit("l").alias("script"))
    two = spark.range(40).select(F.lit("ip").alias("kind"), F.concat(F.lit("10.0.0."), F.col("id")).alias("canonical"), F.lit("m").alias("gender"), F.lit("l").alias("script"))
    got = pii.surrogates(one.unionByName(two), rounds=1).collect()
    phones, ips = ([r.content for r in got if r.kind == k] for k in ("phone", "ip"))
    assert len(set(phones)) == len(phones) == 300 and all(re.fullmatch(r"\d{3}", x) and int(x) >= 300 for x in phones)
    assert len(set(ips)) == len(ips) == 40 and all(re.fullmatch(r"\d+(\.\d+){3}", x) for x in ips)


def test_cyrillic_titles(spark):
    texts = ["Пришла г-жа Анна Каренина, и Господин Иван Петров", "Господин Иван Петров ушёл"]
    a, b = (r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect())
    assert "Каренина" not in a and "Петров" not in a + b and "г-жа " in a and a.split("Господин ")[1] == b.split("Господин ")[1].removesuffix(" ушёл")
