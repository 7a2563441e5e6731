"""Surrogates keep persons apart and together, formats, scripts and very long texts."""

import re

from pyspark.sql import functions as F

from anamnesis.llm import pii


def changed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("value", "kind", "file", "row", "map", "entities")])
    rows = {r.doc_id: r for r in pii.pseudonymised(docs).collect()}
    return [rows[k].text for k in range(len(texts))], [rows[k].n_entities for k in range(len(texts))]


def test_persons(spark):
    texts = [
        "Mrs Jane Roe and Mr Jane Roe met Mr Roe; Dr John Doe, later Doe and ROE, met Roeder.",
        "Mr John Roe came. John Roe spoke. Dr John Roe went; John stayed.",
        "Frau Roe", "John Roe, without a title, stays.", "Κύριος Γιάννης Παπάς και Γιάννης", "г-жа Анна Каренина, Каренина",
    ]
    (a, b, c, d, e, f), counts = changed(spark, texts)
    one = re.fullmatch(r"Mrs (\S+) (\S+) and Mr (\S+) (\S+) met Mr (\S+); Dr (\S+) (\S+), later (\S+) and (\S+), met Roeder\.", a).groups()
    assert one[1] == one[3] == one[4] and one[8] == one[1].upper() and one[6] == one[7] != one[1]
    assert one[0] in pii.GIVEN["f"] and one[2] in pii.GIVEN["m"] and one[5] in pii.GIVEN["u"]
    two = re.fullmatch(r"Mr (\S+) (\S+) came\. (\S+) (\S+) spoke\. Dr (\S+) (\S+) went; (\S+) stayed\.", b).groups()
    assert {two[0], two[2], two[4], two[6]} == {two[0]} and two[0] in pii.GIVEN["m"] and {two[1], two[3], two[5]} == {one[1]}
    assert c == f"Frau {one[1]}" and d == texts[3] and counts[3] == 0
    assert re.fullmatch(r"Κύριος (\p{L}+) \p{L}+ και \1".replace(r"\p{L}", "[α-ωΑ-Ω]"), e) and re.fullmatch(r"г-жа [а-яА-Я]+ ([а-яА-Я]+), \1", f)
    assert not re.search("Roe\\b|Jane|John|Doe|Παπάς|Каренина", a + b + c + e + f)


def test_formats(spark):
    texts = ["AKIA" + "A1B2" * 4, "ghp_" + "aB3" * 12, "0f" * 20, "+1 (555) 555-0101", "+4915112345678", "0171 234 5678", "fe80:1::2", "10.1.2.3", "DE44 5001 0517 5407 3249 31", "123-45-6789", "a.b@c.org", "4444-3333-2222-1111"]
    shapes = [
        r"AKIA([A-Z]\d){8}", r"ghp_([a-z][A-Z]\d){12}", r"[0-9a-f]{40}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\+49\d{11}", r"0\d{3} \d{3} \d{4}", r"2001:db8(:[0-9a-f]{1,4}){6}", r"10\.\d+\.\d+\.\d+", r"DE00 \d{4} \d{4} \d{4} \d{4} \d\d",
        r"9\d\d-\d\d-\d{4}", r"[\w.]+@example\.invalid", r"0000-\d{4}-\d{4}-\d{4}",
    ]
    got, counts = changed(spark, texts)
    assert counts == [1] * len(texts) and all(re.fullmatch(s, g) and g != t for s, g, t in zip(shapes, got, texts, strict=True)), got


def test_distinct_people_stay_distinct(spark):
    names = [f"{a}{b}" for a in "BDFGKLMNPRST" for b in ("ane", "oli", "uri", "emo", "ira", "asa")]
    rows = spark.createDataFrame([(kind, n.lower(), g, "l") for n in names for kind, g in (("surname", ""), ("given", "f"), ("given", "m"))], "kind string, canonical string, gender string, script string")
    got = pii.surrogates(rows).collect()
    for kind in ("surname", "given"):
        words = [r.content.lower() for r in got if r.kind == kind]
        assert len(words) == len(set(words)) == (len(names) if kind == "surname" else 2 * len(names)) and not set(words) & {n.lower() for n in names}


def test_odd_texts(spark):
    texts = ["a" + ".a" * 100_000 + "@b.c", "x." * 300_000, "Mr Smith " * 20_000, "1 " * 300_000, None, "", "-" * 10]
    got, counts = changed(spark, texts)
    assert got[0].endswith("@example.invalid") and len(got[0]) < 60 and got[1] == texts[1] and "Smith" not in got[2] and got[4:] == ["", "", texts[6]]
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string")).collect() == []
