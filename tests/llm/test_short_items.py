"""Short benchmark items are searched for as whole words; items are told apart by row."""

from anamnesis.llm.decontaminate import leaks


def test_short_and_repeated_items(spark):
    long = "a passage of the benchmark that is long enough for the pigeonhole search"
    items = [(1, "What is the capital of France?"), (2, "Paris"), (3, "你好世界"), (4, "?!"), (5, long), (5, long + " and some more"), (None, "one two"), (None, "three")]
    rows = [
        (1, "Q: what is the capitol of France"), (2, "somewhat is the capital of francesca"), (3, "In PARIS, we"), (4, "comparisons paris1"),
        (5, "他说你好世界吗"), (6, long + " and some more"), (7, "one two three"), (8, "what is the capital of"), (9, "france what is the capital of france"),
    ]
    got = leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.distance) for r in got) == [(1, 1, 1), (3, 2, 0), (5, 3, 0), (6, 5, 0), (6, 5, 0), (7, 0, 0), (7, 0, 0), (9, 1, 0)]
    assert [(r.start, r.end) for r in got if r.doc_id == 3] == [(3, 8)] and [(r.start, r.end) for r in got if r.doc_id == 9] == [(7, 36)]
