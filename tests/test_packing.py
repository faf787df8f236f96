import random

import pytest

from chainloom.operators import packing


def plain(items, max_tokens, max_items):
    out, batch, used, n = {}, -1, 0, max_items
    for key, length in sorted(items, key=lambda x: (-x[1], x[0])):
        cost = length + 2
        if n >= max_items or used + cost > max_tokens:
            batch, used, n = batch + 1, 0, 0
        out[key] = batch
        used, n = used + cost, n + 1
    return out


@pytest.mark.parametrize("max_tokens, max_items, sizes", [(25, 16, {}), (100, 5, {"width": 8, "wider": 2}), (37, 1000, {"width": 4, "wider": 3}), (5, 3, {"width": 16, "wider": 4, "hot_rows": 20})])
def test_batches_are_those_of_one_pass(spark, max_tokens, max_items, sizes):
    rng = random.Random(max_tokens)
    items = [(i, rng.choice([0, 1, 3, 9, 9, 9, 30, 90])) for i in range(150)] + [(200 + i, 9) for i in range(10)]
    d = spark.createDataFrame([(i, n, "x") for i, n in items] + [(999, None, "x")], "id long, n long, place string")
    got = {r["id"]: r["batch"] for r in packing.token_batches(d, "id", "n", max_tokens, max_items, **sizes).collect()}
    assert got == plain(items, max_tokens, max_items)
    for b in set(got.values()):
        costs = [n + 2 for i, n in items if got[i] == b]
        assert len(costs) <= max_items and (sum(costs) <= max_tokens or len(costs) == 1)


def test_ten_items_of_eleven_tokens(spark):
    d = spark.createDataFrame([(i, 9) for i in range(10)], "id long, n long")
    assert sorted(r["batch"] for r in packing.token_batches(d, "id", "n", 25).collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert packing.token_batches(d.where("false"), "id", "n", 25).count() == 0


def test_an_output_name_that_is_taken_is_an_error(spark):
    with pytest.raises(ValueError, match="batch"):
        packing.token_batches(spark.createDataFrame([(1, 1)], "id long, batch long"), "id", "batch", 5)
