"""Passages in versions: equal to the automaton, masks on either side included, and one look at each text however many passages there are."""

import random

from anamnesis.operators import lifecycle as L

VERSIONS, PASSAGES = "version_id long, document_id string, text string", "document_id string, passage string"


def test_equal_to_the_automaton(spark):
    rng = random.Random(4)
    text = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    versions = [(i, f"d{i % 3}", text(rng.randrange(60), "ab \n") if i % 4 else text(rng.randrange(60), "ab \n█")) for i in range(60)]
    versions += [(60, "d0", None), (61, "d1", ""), (62, "d0", "😀é" + "ab" * 40 + "😀"), (63, None, "ab"), (64, "d9", "ab")]
    passages = [(f"d{rng.randrange(3)}", text(rng.randrange(1, 9), "ab \n" if rng.random() < 0.8 else "ab █")) for _ in range(80)]
    passages += [("d0", "😀é" + "ab" * 40), ("d0", "b😀"), ("d0", " \n"), ("d0", ""), (None, "ab"), ("d1", "a" * 70)]
    wanted = {d: L.Passages([p for e, p in passages if e == d]) for d in {d for d, _ in passages if d}}
    want = sorted((v, *s) for v, d, t in versions if d in wanted for s in wanted[d].found(t or ""))
    got = L.redact_versions(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(passages, PASSAGES))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_text_is_not_read_once_for_each_few_passages(spark, monkeypatch):
    """The pairs of a version and an automaton grew with the square of a document's versions."""

    class Never:
        def __init__(self, *_):
            raise AssertionError("an automaton was built for passages without masks")

    monkeypatch.setattr(L, "Passages", Never)
    rows = [(i, "d", f"version {i} begins, and goes on to its end") for i in range(400)]
    found = L.redact_versions(spark.createDataFrame(rows, VERSIONS), spark.createDataFrame([("d", t[:30]) for _, _, t in rows], PASSAGES))
    assert found.count() == 400
