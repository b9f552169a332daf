from strataloom.llm import decontaminate

ITEM = "if a train runs 60 km in 2 hours then how far does it get in 5 hours on the same old track?"
OTHER = "if a train runs 75 km in 3 hours then how far does it get in 8 hours on the same old track?"
AGAIN = "if a train runs 90 km in 4 hours then how far does it get in 7 hours on the same old track?"
RUN = "add 1 2 3 4 5 6 7 8 9 10 11 12 up"


def test_other_copies_do_not_hide_a_leak(spark):
    bench = spark.createDataFrame([(0, ITEM), (1, RUN)], "item_id bigint, text string")
    put_in = ITEM.replace("then how", "then tell me please how")
    texts = [
        ITEM + " next: " + OTHER,
        OTHER + " next: " + AGAIN,
        "numbers: " + RUN,
        put_in + " and now for something else " + " ".join(["filler"] * 300) + " " + OTHER,
        "take it: if a train runs 75 km in 3 hours then how far does it get in 8 hours on it",
        ITEM.replace("60 km in 2 hours", "60 km in 60 hours"),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(rows, bench).collect()}
    assert {(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0)} == set(got)
    assert (got[0, 0]["coverage"], got[0, 0]["n_changed"]) == (1, 0) and (got[2, 1]["coverage"], got[2, 1]["n_changed"]) == (1, 0)
    assert got[1, 0]["coverage"] == 1 and got[1, 0]["n_changed"] == 3
    twice = spark.createDataFrame([(0, "take 2 of the red balls and then take 2 of the blue balls away")], "item_id bigint, text string")
    odd = spark.createDataFrame([(0, "take 3 of the red balls and then take 4 of the blue balls away. " * 2)], "doc_id bigint, text string")
    assert decontaminate.leaks(odd, twice).count() == 0
