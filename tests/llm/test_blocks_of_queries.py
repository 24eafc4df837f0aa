"""Blocks of queries carry their best from shard to shard."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import maxscore


@pytest.mark.parametrize("sizes", [(5, 5, 5), (5, 1 << 30, 5), (5, 1 << 62, 5), (1 << 62, 5, 1 << 30)])
def test_block_over_shards_matches_brute_force(sizes):
    rng = np.random.default_rng(2)
    shards = [rng.integers(-s, s, (300, 40)) for s in sizes]
    ids = [rng.integers(0, 500, 300) for _ in sizes]
    queries, own = rng.integers(-2, 3, (12, 40)), rng.integers(0, 500, 12)
    queries[3] = 0
    block = maxscore.Block(own, queries, 20)
    for i, v in zip(ids, shards, strict=True):
        block.meet(maxscore.Shard(i, v, 2))
    for n, (q, o) in enumerate(zip(queries, own, strict=True)):
        all_rows = [(-sum(int(x) * int(y) for x, y in zip(q, v, strict=True)), int(i)) for s, t in zip(ids, shards, strict=True) for i, v in zip(s, t, strict=True)]
        want = sorted(r for r in all_rows if r[1] != o)[:20]
        assert [(-int(s), int(i)) for s, i in zip(block.scores[n], block.ids[n], strict=True)] == want


def test_rows_of_the_search_do_not_grow_with_the_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(-40, 40, (600, 6)))], "id long, vector array<long>")
    found = []
    monkeypatch.setattr(maxscore, "_searched", lambda near, own=maxscore._searched: found.append(own(near)) or found[-1])
    monkeypatch.setattr(maxscore, "SHARD", 20)
    monkeypatch.setattr(maxscore, "BLOCK", 8)
    monkeypatch.setattr(maxscore, "CELLS", 4, raising=False)
    rows = maxscore.top_k(frame, F.col("id") % 20 == 0, 5).collect()
    assert len(rows) == 30 * 5 and found[0].count() <= 2 * len(rows)
