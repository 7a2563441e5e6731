import zlib

import numpy as np
import pytest

from anamnesis.llm.packing import Tokens, cuts, packed, place, sequences, token_ids

PLAIN = Tokens(ranks=None)


def checked(rows, texts, capacity):
    """Every document's pieces are its tokens, and every sequence is filled without a gap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*token_ids(text or "", PLAIN), 0], "<u4")
        got = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert [(r.start, r.start + r.length) for r in got] == cuts(len(ids), capacity)
        assert all(r.length == capacity for r in got[1:]) and len(got) == max(1, -(-len(ids) // capacity))
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
    assert not by_doc
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("per_group", [50_000, 40])
def test_whole_documents_in_gapless_sequences(spark, per_group):
    rng = np.random.default_rng(5)
    words = ["alpha", "β", "数", "12", "<|endoftext|>", "don't", "\n", "  ", "é"]
    texts = {k: " ".join(rng.choice(words, n)) for k, n in enumerate(rng.integers(0, 90, 300))}
    texts |= {1000: None, 1001: "", 1002: "long text " * 5000, 1003: " " * 1_500_000 + "x"}
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in texts.items()], "doc_id long, text string, hash string, piece int").repartition(5)
    rows = packed(docs, capacity=128, pieces_per_group=per_group).collect()
    n = checked(rows, texts, 128)
    assert n <= 1.02 * sum(r.length for r in rows) / 128 + 2


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, "x"), (None, "x"), (2, "x"), (3, None)], "doc_id long, text string")
    rows = packed(docs, capacity=64, ids=True)
    whole = {r.sequence_id: r.ids for r in sequences(rows).collect()}
    for r in rows.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sorted(str(r.doc_id) for r in rows.collect() if r.piece == 0) == ["1", "2", "2", "3", "None"]
    assert packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_place_is_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 33, 200))[::-1]
    sequence, offset, gaps = place(sizes, 32)
    open_gaps = []
    for size, at, start in zip(sizes.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def squares(g):
            after = [*open_gaps]
            after.remove(g)
            after += [g - size] if g > size else []
            return sum(after.count(x) ** 2 for x in set(after))
        fits = [g for g in set(open_gaps) if g >= size]
        gap = 32 - start
        if fits:
            assert squares(gap) == min(map(squares, fits))
            open_gaps.remove(gap)
        else:
            assert gap == 32
        open_gaps += [gap - size] if gap > size else []
    assert sorted(open_gaps) == sorted(g for g in gaps.tolist() if g)


def test_both_libraries_agree_on_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}! {chr(c)}{chr(c)}'{chr(c)} x" for c in points[i : i + 4096])
        assert token_ids(text) == token_ids(text, PLAIN)
