"""Block-max retrieval gives the rows of the plain search."""

import random

import pytest

from rillstone.operators import topk
from rillstone.operators.retrieval import Index


@pytest.mark.parametrize("block,k,tiers", [(64, 5, 4), (3, 2, 2), (2, 40, 3)])
def test_same_rows(spark, monkeypatch, block, k, tiers):
    monkeypatch.setattr(topk, "TIERS", tiers)
    rng = random.Random(block)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 200}x"
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, "w1x w1x"), (902, "w1x w1x")]
    queries = [(q, " ".join(word() for _ in range(rng.randrange(1, 8)))) for q in range(12)] + [(50, ""), (51, "unheard"), (52, texts[5][1]), (53, "w1x w1x w3x")]
    index = Index.build(spark.createDataFrame(texts, "id long, text string"))
    found = topk.BlockIndex.build(index, block).search(spark.createDataFrame(queries, "query_id long, q string"), k)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, index.search(spark.createDataFrame(queries, "query_id long, q string"), k).collect()))
    assert found.work()[1] > 0


def test_rare_words_spare_common_ones(spark, tmp_path):
    """Texts that hold only the common word aren't scored once rarer ones have filled the first k."""
    texts = [(i, f"common{' rare' if i % 100 == 7 else ''} filler{i % 50}x") for i in range(3000)]
    made = topk.BlockIndex.build(Index.build(spark.createDataFrame(texts, "id long, text string")))
    made.save(str(tmp_path))
    found = topk.BlockIndex.load(spark, str(tmp_path)).search(spark.createDataFrame([(1, "common rare")], "query_id long, q string"), 5)
    scored, whole = found.work()
    assert [r.id for r in found.hits.orderBy("rank").collect()] == [7, 107, 207, 307, 407] and scored < whole / 3
    assert topk.BlockIndex.build(Index.build(spark.createDataFrame([], "id long, text string"))).search(spark.createDataFrame([(1, "a")], "query_id long, q string")).hits.count() == 0


def test_no_posting_is_shuffled_to_build(spark, monkeypatch, tmp_path):
    """Built of texts, ids that occur again, null ones and several shards included, an index has the rows of
    the plain search, and its plan deals nothing out but those ids."""
    monkeypatch.setattr(topk, "SHARD", 150)
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 200}x"
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(None, "w1x w2x"), (900, None), (901, "w1x w7x"), (902, "w1x w7x")]
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(6))) for q in range(8)] + [(9, "w1x w1x w7x")], "query_id long, q string")
    for name, more in (("once", []), ("again", [(3, texts[3][1]), (3, "w7x w7x"), (17, "w1x w2x w3x")])):
        frame = spark.createDataFrame(texts + more, "id long, text string")
        made = topk.BlockIndex.of(frame, 4)
        assert made.lists.select("shard").distinct().count() > 4
        made.save(str(tmp_path / name))
        hits = topk.BlockIndex.load(spark, str(tmp_path / name)).search(asked, 5).hits
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, Index.build(frame).search(asked, 5).collect()))
    rows = topk._rows(spark.createDataFrame(texts, "id long, text string"), lambda batch: topk.counted(batch.column(0), batch.column(1)))
    assert "Exchange" not in topk._lists(rows, 1.0, 4)._jdf.queryExecution().executedPlan().toString()
