"""Elements of texts come with their sizes, so that registering deals them out once."""

from rillstone.operators.registry import text_elements


def test_sizes_without_a_shuffle_of_shingles(spark):
    rows = [(1, "a b c d e f g h. a b c d e f g h. one more of eight words or so, here"), (2, "a b c d e"), (3, None)]
    made = text_elements(spark.createDataFrame(rows, "owner long, text string")).collect()
    count = {}
    for r in made:
        count[r.kind, r.owner] = count.get((r.kind, r.owner), 0) + 1
    assert count["sentence", "1"] == 2 and count["shingle", "2"] == 1
    assert all(r["size"] == count[r.kind, r.owner] for r in made)


def test_repeated_owners_are_one(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e g")]
    made = text_elements(spark.createDataFrame(rows, "owner long, text string"))
    assert "size" not in made.columns and made.where("kind = 'shingle'").count() == 3
