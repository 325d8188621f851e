"""Words cut by numpy against the SQL that states the rules."""

from rillstone.functions import spans
from rillstone.functions import text as t
from rillstone.operators.retrieval import Index, term_counts
from rillstone.plans.registry import ask

ROWS = [
    (1, "fooBar HTTPServer XMLHttpRequest ABCd a1B Zz9 parties running is s ss"), (2, "Моряки МИРами ёлкаЁж иями и в Мир мир"), (3, None), (4, ""), (5, "A"),
    (6, "b lower after a row that ends in A"), (7, "наïve café ТестTest tестАБв ЀЂ 日本 x_y 5 55 the The"), (1, "fooBar again, boats and boating"), (None, "no id here"), (None, "no id there"),
]


def _frame(spark):
    return spark.createDataFrame(ROWS, "id long, text string").coalesce(1)


def test_counts_are_those_of_the_sql(spark):
    frame = _frame(spark)
    plain = ask(spark, lambda d: t.term_counts(d, "texts", "id"), texts=frame).collect()
    made = term_counts(frame).collect()
    assert {(r.id, r.term): r.f for r in made} == {(r.id, r.term): r.f for r in plain} and len(made) == len(plain)
    lengths = {}
    for r in plain:
        lengths[r.id] = lengths.get(r.id, 0) + r.f
    assert {r.id: r.dl for r in made} == lengths


def test_texts_are_cut_without_a_shuffle(spark):
    """Words were shuffled twice, by text and word and by text and term, before they were counted."""
    frame = _frame(spark).where("id > 1")
    for df in (spans.row_counts(frame), Index.build(frame).postings):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_those_of_the_sql(spark):
    rows = [(1, "One two three four five six seven eight. Short one! Don't you ever say 'that' again to me, sir?\nA a a a a a a a"), (2, None), (3, ""), (4, "x. " * 9),
            (5, "ОДИН one two three four five six seven-eight nine! ONE TWO three four five six seven eight nine. one two three four five six seven eight nine"),
            (6, "ends here one two three four five six"), (7, "a b c d e f g h"), (8, "?? . ! a b c d e f g h.i j k l m n o p...  a b c d e f g h i.")]
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    plain = ask(spark, lambda d: f"SELECT DISTINCT id, {d.each(t.sentences(d, 'text'))} AS s FROM texts", texts=frame).collect()
    made = spans.row_sentences(frame)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain)) and len(plain) > 6
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()  # repeats were found by a shuffle of whole sentences


def test_shingle_sets(spark):
    import pyarrow as pa

    texts = ["a b c d e f a b c d e f", None, "a b c d", "x b c d e f", "it's 5 o'clock now, yes"]
    out = {}
    for at, grams, begin in spans.shingle_sets(pa.array(texts)):
        out |= {at + i: grams[x:y] for i, (x, y) in enumerate(zip(begin[:-1], begin[1:]))}
    assert [len(out[i]) for i in range(5)] == [6, 0, 0, 2, 1]
    assert len(set(out[0]) & set(out[3])) == 1
