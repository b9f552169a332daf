"""Texts are read once for the words around runs, though four joins need them."""

from strataloom.llm import passage_dedup


def test_flanks_of_a_place_are_taken_once(spark, monkeypatch, tmp_path):
    told, flanks = str(tmp_path / "told"), passage_dedup._flanks

    def counted(words, first, stop):
        with open(told, "a") as file:
            file.write(f"{words[0]} {first} {stop}\n")
        return flanks(words, first, stop)

    monkeypatch.setattr(passage_dedup, "_flanks", counted)
    shared = " ".join(f"s{j}" for j in range(80))
    texts = [" ".join([*(f"{k}a{j}" for j in range(30)), shared, *(f"{k}b{j}" for j in range(30))]) for k in range(6)]
    rows = passage_dedup.removed_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.last_word) for r in rows) == [(k, 30, 109) for k in range(1, 6)]
    asked = open(told).read().splitlines()
    assert len(asked) == len(set(asked)) > 6
