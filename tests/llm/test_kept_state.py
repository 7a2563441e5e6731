from pyspark.sql import functions as F

from anamnesis.llm.exact_dedup import exact_groups


def test_a_kept_state_goes_on_with_the_next_table(spark, tmp_path):
    """Ids and sizes after the second table are those of both tables together; nothing of the first is read again but the files of hits."""
    one = [(1, "a"), (2, "b"), (9, "c"), (None, ""), (3, "only here")]
    two = [(5, "a"), (5, "a"), (4, "c"), (7, None), (6, "new"), (8, "é" * 5000)]
    tables = []
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/in put {k}")
        tables.append(spark.read.parquet(f"{tmp_path}/in put {k}"))
    state = f"{tmp_path}/state"
    shown = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    first = [tuple(r) for r in exact_groups(tables[0], state).select(*shown).collect()]
    assert sorted(first, key=str) == sorted([tuple(r) for r in exact_groups(tables[0]).select(*shown).collect()], key=str)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(tables[1], state).collect()}
    assert got == {(5, 5, 3, True), (5, 5, 3, False), (4, 9, 2, False), (7, 7, 2, True), (6, 6, 1, True), (8, 8, 1, True)}
    whole = exact_groups(tables[0].unionByName(tables[1])).where(F.col("doc_id").isin(4, 5, 6, 7, 8))
    assert got == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in whole.collect()}
    assert exact_groups(tables[1].limit(0), state).count() == 0
