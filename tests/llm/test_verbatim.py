"""Verbatim copies of benchmark items that say too little as templates."""

from sparkloom.llm import templates

ITEMS = [(1, "What is 12 times 7 plus 9 minus 4?"), (2, "Who wrote War and Peace?"), (3, "What is the capital city of France today"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (5, "Natalia had 48 clips in total and then sold 13 of them to her best friends")]
TEXTS = [
    ("What is 12 times 7 plus 9 minus 4?", {1}), ("He asked: what is 12 times 7 plus 9 minus 4? No answer.", {1}), ("What is 12 times 12 plus 9 minus 4?", set()), ("Tell me: Who wrote War and Peace? Tolstoy.", {2}), ("Who wrote Crime and Punishment?", set()),
    ("They asked what is the capital city of France today and left", {3}), ("Count: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", {4}), ("1 2 3 4 5 6 7 8 9 10 11 13 12 14 15 16", set()), ("There is little to tell, as natalia Had 99 Clips in total and Then sold 14 of them to her best friends", {5}), ("", set()),
]


def test_verbatim(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r["doc_id"]: set(r["item_ids"]) for r in templates.find_contaminated(docs, bench).collect()}
    assert found == {k: items for k, (_, items) in enumerate(TEXTS)}
    assert {r["doc_id"] for r in templates.drop_contaminated(docs, bench).collect()} == {k for k, (_, items) in enumerate(TEXTS) if not items}
