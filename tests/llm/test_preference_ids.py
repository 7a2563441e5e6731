from anamnesis.llm.preference_chat import preference_rows


def test_large_and_negative_ids_keep_their_pairs(spark):
    ids = [2**60 + k for k in range(6)] + [-4, -3, -1, 2**63 - 1]
    turns = [(c, t, "user", f"{c}" if t else "hello") for c in ids for t in range(2)]
    rows = preference_rows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.pair_id, r.chosen_id, r.rejected_id, r.n_common) for r in rows}
    assert got == {(2**59 + k, 2**60 + 2 * k, 2**60 + 2 * k + 1, 1) for k in range(3)} | {(-2, -4, -3, 1), (-1, None, -1, 0), (2**62 - 1, None, 2**63 - 1, 0)}
