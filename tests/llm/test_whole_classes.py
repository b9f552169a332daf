from strataloom.llm import near_dedup


def test_classes_of_null_and_repeated_ids_stay_apart(spark):
    text = lambda k: " ".join(f"{k}word{j}" for j in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("d")), (9, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r["text"][0], r["doc_id"]) for r in near_dedup.keep_one(docs).collect())
    assert kept == [("a", None), ("b", None), ("c", 7), ("d", 7), ("e", 9)]
