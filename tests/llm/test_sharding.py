import zlib

import numpy as np
import pytest
from helpers import TEXTS, by, documents, empty

from tablescope.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_the_walk_is_a_permutation(n):
    out = sharding.permuted(np.arange(n), n, 42)
    assert sorted(out.tolist()) == list(range(n))


def test_other_seeds_give_other_orders():
    one, two = (sharding.permuted(np.arange(1000), 1000, s) for s in (1, 2))
    assert (one != two).mean() > 0.9


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    rows = sharding.shard_rows(documents(spark), "doc_id", "text", 4).collect()
    assert len(rows) == len(TEXTS) + 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert {tuple(sorted(s)) for s in slots.values()} <= {tuple(range(2)), tuple(range(3))}
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert (r.shard, r.slot) == (r.place % 4, r.place // 4)


def test_the_same_rows_in_another_order_go_to_the_same_places(spark):
    rows = {i: str(i) for i in range(50)}
    one = by(sharding.shard_rows(documents(spark, rows, ()), "doc_id", "text", 7))
    two = by(sharding.shard_rows(documents(spark, dict(reversed(rows.items())), ()), "doc_id", "text", 7))
    assert one == two


def test_empty_null_keys_and_bad_counts(spark):
    assert sharding.shard_rows(empty(spark), "doc_id", "text", 24).count() == 0
    assert sharding.shard_rows(documents(spark, {None: "a", 1: None}, ()), "doc_id", "text", 24).count() == 2
    with pytest.raises(ValueError):
        sharding.shard_rows(empty(spark), "doc_id", "text", 0)
