"""What the exchange of packed keys sends follows the keys, not blocks times shards, and no shard gets all owners."""

import numpy as np
import pytest

from vantage.llm import exchange


@pytest.fixture
def packed(spark):
    def produce(batch):
        for i in batch.column(0).to_pylist():
            yield (i,), 1, np.array([i if i % 1000 else 1], np.uint64)

    return spark.range(1, 8001, numPartitions=8).mapInArrow(exchange._blocks(produce, 16), "part int, block int, shard int, owners binary, keys binary, at binary")


def test_owners_of_blocks_travel_with_different_shards(packed):
    homes = [r.shard for r in packed.where("owners is not null").select("shard").collect()]
    assert len(homes) == len(set(homes)) == 8


def test_counts_have_no_room_for_owners_that_share_nothing(packed):
    rows = packed.where("shard = 1").drop("shard").toArrow()
    counted = exchange._count(rows)
    sent = sum(len(x or b"") for c in counted.column_names[3:] for x in counted.column(c).to_pylist())
    # Nine owners have the key 1; each block has 1,000 owners.
    assert len(rows) == 8 and 0 < sent <= 9 * 8
    assert sum([np.frombuffer(x, np.uint32).sum() for x in counted.column("counts").to_pylist()]) == 9
